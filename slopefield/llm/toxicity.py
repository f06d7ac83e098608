"""Toxicity by a noisy channel: restore obfuscated words, then score the restored text.

*Channel.* A writer meant a word and typed it with digits or signs for letters (1d10t),
with separators between letters (i d i o t, i--d--i--o--t) or with letters repeated
(idiooot). Every token that mixes letters with signs, at any place, may be such a word, and
so may three or more single letters; a last ! | or $ may be a letter or punctuation, so
such a token is read both ways. ``restored`` builds the lattice of intended letters of such a token and takes
its most likely path under a character trigram model and the channel's costs (Viterbi).
The trigram counts come from all documents. Ordinary tokens are their own restoration.

*Score.* Words and word beginnings of the restored text are weighed by the log-odds of
the labelled documents that hold them; the two strongest, their number and their density
enter a logistic regression (Spark ML) that is fitted on documents whose labels
did not make the weights. Copies and near copies count once in training: texts whose
eight min-hashes over three-word shingles are all equal, which for a text pair of
similarity s happens with probability s ** 8; the row of smallest id stands for them.

At most ``train_rows`` labelled documents are used, chosen by a hash of their id. That
bounds the labels and weights that are sent to the tasks; scoring reads every document
whole and shuffles nothing.

Defined cases: a null or empty text scores as a text without evidence; without labels of
both kinds every text has the share of ones (0 without labels) as score; a null label is
no label; several labels of one id count as their largest. Repeated document rows are scored
row by row and count once in training. Texts of any length are scored whole, half a megabyte
of documents at a time, one document at least. Equally likely paths through a lattice go to
the one found first, in the order of ``SIGNS``; equal scores are equal predictions. Further
columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm import kernels as K
from slopefield.llm.common import lean, stored, text_of

# Fixed values of the channel: what a typed sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il",
}
SEPARATORS = " .-_*"
SIGN_COST, REPEAT_COST, SEPARATOR_COST = 1.0, 0.7, 0.2
# A sign that stands for nothing costs more than a rare letter does under the model.
STRAY_COST = 6.0

SYMBOLS = 28  # a to z, any other letter, no letter
_EDGE = 27
PREFIXES = range(3, 9)
LEAST_POSITIVE = 3
# Documents at the base rate that every feature is taken to have been seen in before.
PRIOR = 5.0
FAMILY_WORDS, FAMILY_HASHES = 3, 8

_LETTER = K.byte_class(lambda b: 97 <= b <= 122 or b >= 128)
_SIGN = K.byte_class(lambda b: chr(b) in SIGNS)
_SYMBOL = np.array([b - 97 if 97 <= b <= 122 else 26 if b >= 128 else _EDGE for b in range(256)])
# A continuation byte of UTF-8 is no letter of its own.
_CONTINUED = K.byte_class(lambda b: 128 <= b < 192)


def _symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Letter classes of a batch, an edge between documents, one symbol per character."""
    out = _SYMBOL[data]
    keep = ~_CONTINUED[data]
    starts = np.unique(offsets[:-1])
    out = np.insert(out, starts, _EDGE)
    return np.append(out[np.insert(keep, starts, True)], _EDGE)


def character_model(texts: DataFrame) -> np.ndarray:
    """Log-probability of a letter after two others, counted over all texts.

    The counts of a task are one row of 28 cubed numbers, added by Spark by symbol.
    """
    import pyarrow as pa

    def counted(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for a, b in K.document_slices(offsets):
                s = _symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(code, minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int64)), pa.array(total[used])], names=["code", "n"]
        )

    counts = np.full(SYMBOLS**3, 0.1)
    summed = texts.mapInArrow(lean(counted), "code long, n long").groupBy("code").agg(F.sum("n"))
    for code, n in summed.collect():  # at most 28 cubed rows
        counts[code] += n
    grid = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    # A little of the shorter context, so that rare beginnings stay possible.
    pair = grid.sum(axis=0)
    pair = pair / pair.sum(axis=1, keepdims=True)
    full = grid / grid.sum(axis=2, keepdims=True)
    return np.log(0.9 * full + 0.1 * pair[None, :, :])


def _steps(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for every place of the token, the letters it may stand for and their cost."""
    runs: list[list] = []
    for c in token:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    out: list[list[tuple[str, float]]] = []
    for c, n in runs:
        if c in SEPARATORS:
            out.append([("", SEPARATOR_COST * n)])
        elif c in SIGNS:
            options = [(x * k, SIGN_COST + REPEAT_COST * abs(n - k)) for x in SIGNS[c]
                       for k in range(1, min(n, 2) + 1)]
            out.append([*options, ("", STRAY_COST * n)])
        else:
            out.append([(c * k, REPEAT_COST * (n - k)) for k in range(1, min(n, 2) + 1)])
    return out


def restored(token: str, model: np.ndarray) -> str:
    """The most likely intended word of a lower-case token."""

    def symbol(c):
        return ord(c) - 97 if "a" <= c <= "z" else 26

    best = {(_EDGE, _EDGE): (0.0, "")}
    for options in _steps(token):
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (p, q), (score, word) in best.items():
            for letters, cost in options:
                a, b, s = p, q, score - cost
                for c in letters:
                    x = symbol(c)
                    s += model[a, b, x]
                    a, b = b, x
                if (a, b) not in following or s > following[a, b][0]:
                    following[a, b] = (s, word + letters)
        best = following
    return max((s + model[p, q, _EDGE], w) for (p, q), (s, w) in best.items())[1]


def suspicious_tokens(
    data: np.ndarray, offsets: np.ndarray, doubtful: bool = False
) -> list[tuple[int, str]]:
    """(document, token) of tokens that look obfuscated; data is lower case.

    With ``doubtful`` also what is as likely something else: a token once more with its last
    signs where it is suspicious without them, and three single characters with signs among them.
    """
    if len(data) < 3:
        return []
    letter = _LETTER[data]
    sign = _SIGN[data]
    thrice = np.zeros(len(data), bool)
    thrice[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:] & (data[2:] < 128)
    documents, starts, ends = K.find_runs(data, offsets, _LETTER | _SIGN)
    out = []
    letters, signs, triples = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, sign, thrice))
    mixed = (letters[ends] > letters[starts]) & (signs[ends] > signs[starts])
    # A run of one letter lies inside its token, whatever stands before the token.
    repeated = triples[ends] > triples[np.minimum(starts + 2, ends)]
    for k in np.flatnonzero(mixed | repeated):
        a, b = int(starts[k]), int(ends[k])
        end = b
        while b > a and not letter[b - 1] and data[b - 1] in b"!|$":
            b -= 1
        # Without its last signs, if the token is suspicious then, or else with them.
        bare = bool(repeated[k]) or signs[b] > signs[a]
        for stop in sorted({b} | ({end} if doubtful else set()) if bare else {end}):
            out.append((int(documents[k]), data[a:stop].tobytes().decode("utf-8", "ignore")))
    # Three or more single letters, only separators between each two.
    single = ends - starts == 1
    between = np.isin(data, np.frombuffer(SEPARATORS.encode(), np.uint8))
    link = np.zeros(len(starts), bool)
    if len(starts) > 1:
        others = np.concatenate([[0], np.cumsum(~between)])
        near = (others[starts[1:]] == others[ends[:-1]]) & (starts[1:] > ends[:-1])
        near &= documents[1:] == documents[:-1]
        link[1:] = near & single[1:] & single[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], link.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        held = sum(bool(letter[starts[k]]) for k in range(a - 1, b))
        if b - a >= 3 or held == 3 or (doubtful and b - a == 2 and held):
            raw = data[starts[a - 1] : ends[b - 1]].tobytes().decode("utf-8", "ignore")
            out.append((int(documents[a]), raw))
    return out


class Featurizer:
    """Hashes of the words and word beginnings of restored texts, document by document."""

    def __init__(self, model: np.ndarray):
        self.model, self.hasher, self.known = model, K.ByteHasher(), {}

    def _restored(self, found: list[tuple[int, str]]):
        documents, words = [], []
        for d, token in found:
            if token not in self.known:
                if len(self.known) > 200_000:
                    self.known = {}
                self.known[token] = restored(token, self.model)
            documents.append(d)
            words.append(self.known[token])
        return documents, words

    def _hashed(self, data, documents, starts, ends):
        sums = self.hasher.sums(data)
        yield documents, self.hasher.ranges(sums, starts, ends) ^ np.uint64(1)
        for k in PREFIXES:
            long = ends - starts >= k
            yield documents[long], self.hasher.ranges(sums, starts[long], starts[long] + k)

    def features(self, data: np.ndarray, offsets: np.ndarray):
        """Pairs of arrays (document, feature), all features of the slice."""
        yield from self._hashed(data, *K.find_runs(data, offsets, _LETTER))
        documents, words = self._restored(suspicious_tokens(data, offsets, doubtful=True))
        if words:
            raw = [w.encode() for w in words]
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
            joined = np.frombuffer(b"".join(raw), np.uint8)
            yield from self._hashed(joined, np.array(documents), bounds[:-1], bounds[1:])


def _distinct_features(featurizer: Featurizer, column):
    """Sorted distinct features of each text of an Arrow column."""
    data, offsets = K.text_buffers(column)
    for a, b in K.document_slices(offsets):
        pairs = list(
            featurizer.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        )
        documents = np.concatenate([p[0] for p in pairs])
        features = np.concatenate([p[1] for p in pairs])
        order = np.argsort(documents, kind="stable")
        bounds = np.searchsorted(documents[order], np.arange(b - a + 1))
        for d in range(b - a):
            yield np.unique(features[order[bounds[d] : bounds[d + 1]]])


def _among(features: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which features are among the sorted wanted ones."""
    if not len(wanted):
        return np.zeros(len(features), bool)
    at = np.minimum(np.searchsorted(wanted, features), len(wanted) - 1)
    return wanted[at] == features


def feature_weights(train: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, log-odds), of features in at least LEAST_POSITIVE documents labelled 1.

    Both steps count in Spark; their sizes are bounded by the training rows.
    """
    import pyarrow as pa

    def counted(wanted):
        def run(batches):
            featurizer, found, labels = Featurizer(model), [], []
            for batch in batches:
                mine = list(_distinct_features(featurizer, batch.column(1)))
                features = np.concatenate([np.zeros(0, np.uint64), *mine])
                marks = batch.column(0).to_numpy().astype(np.int64)
                marks = np.repeat(marks, [len(f) for f in mine])
                if wanted is not None:
                    among = _among(features, wanted)
                    features, marks = features[among], marks[among]
                found.append(features)
                labels.append(marks)
            features = np.concatenate(found) if found else np.zeros(0, np.uint64)
            labels = np.concatenate(labels) if labels else np.zeros(0, np.int64)
            names, place = np.unique(features, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.view(np.int64)),
                    pa.array(np.bincount(place, labels, len(names)).astype(np.int64)),
                    pa.array(np.bincount(place, 1 - labels, len(names)).astype(np.int64)),
                ],
                names=["feature", "ones", "zeros"],
            )

        return run

    schema = "feature long, ones long, zeros long"
    total = F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")
    positive = train.where("label = 1").select("label", "text").mapInArrow(lean(counted(None)), schema)
    frequent = (
        positive.groupBy("feature").agg(*total).where(f"ones >= {LEAST_POSITIVE}").select("feature")
    )
    wanted = np.array([r.feature for r in frequent.collect()], np.int64).view(np.uint64)
    summed = train.select("label", "text").mapInArrow(lean(counted(np.sort(wanted))), schema)
    rows = summed.groupBy("feature").agg(*total).collect()
    sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    base = min(max(base, 1e-3), 1 - 1e-3)
    features = np.array([r.feature for r in rows], np.int64).view(np.uint64)
    odds = np.array(
        [
            math.log((r.ones + PRIOR * base) / (r.zeros + PRIOR * (1 - base)))
            - math.log(base / (1 - base))
            for r in rows
        ]
    )
    strong = odds > 1.0
    order = np.argsort(features[strong])
    return features[strong][order], odds[strong][order]


def _evidence(docs: DataFrame, model: np.ndarray, weights, passed: list[str]) -> DataFrame:
    """The passed columns and top1, top2, hits, density of every text: all bounded measures,
    so that a text unlike those learnt from gets no extreme score."""
    import pyarrow as pa

    features, odds = weights
    gate = np.zeros(1 << 16, bool)
    gate[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((features, odds, gate, model))
    count = len(passed)

    def run(batches):
        names, values, gate, chars = shared.value
        featurizer = Featurizer(chars)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(count))
            n = batch.num_rows
            top1, top2, hits = np.zeros(n), np.zeros(n), np.zeros(n)
            for a, b in K.document_slices(offsets):
                where, weight = [], []
                for documents, found in featurizer.features(
                    data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ):
                    likely = np.flatnonzero(gate[(found & np.uint64(0xFFFF)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(names, found[likely]), len(names) - 1)
                    if len(names):
                        real = names[at] == found[likely]
                        where.append(documents[likely][real])
                        weight.append(values[at[real]])
                if not where:
                    continue
                where, weight = np.concatenate(where), np.concatenate(weight)
                order = np.lexsort((-weight, where))
                where, weight = where[order], weight[order]
                first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])[: len(where)])
                sizes = np.diff(np.append(first, len(where)))
                own = a + where[first]
                top1[own], hits[own] = weight[first], sizes
                more = sizes > 1
                top2[own[more]] = weight[first[more] + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in range(count)],
                    pa.array(top1),
                    pa.array(top2),
                    pa.array(np.log1p(hits)),
                    pa.array(np.log1p(100 * hits / (100 + np.diff(offsets)))),
                ],
                names=[*passed, "top1", "top2", "hits", "density"],
            )

    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in passed)
    return docs.select(*passed, "text").mapInArrow(
        lean(run), f"{types}, top1 double, top2 double, hits double, density double"
    )


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """id, label, text of the row of smallest id of all that have equal or nearly equal texts
    and one label: those of one signature, FAMILY_HASHES min-hashes over word shingles."""
    hashes = F.transform(F.split("text", r"\s+"), lambda w: F.xxhash64(w))
    shingles = F.col("_hashes")
    for k in range(1, FAMILY_WORDS):  # null behind the end, which a hash skips
        shingles = F.zip_with(
            shingles, F.slice("_hashes", k + 1, F.size("_hashes")), lambda s, w: F.xxhash64(s, w)
        )
    signature = [
        F.array_min(F.transform("_shingles", lambda s, k=k: F.xxhash64(s, F.lit(k))))
        for k in range(FAMILY_HASHES)
    ]
    return (
        rows.withColumn("_hashes", hashes)
        .withColumn("_shingles", shingles)
        .groupBy("label", F.array(*signature).alias("_family"))
        .agg(F.min(F.struct("id", "text")).alias("least"))
        .select("least.id", "label", "least.text")
    )


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = 20_000,
    row_col: str | None = None,
) -> DataFrame:
    """Per document row: row, id, held_out, score, predicted.

    ``row`` is the column ``row_col`` of ``docs``, or else the place in the scan that scores.
    Labels of ids whose crc32 (of the id as text) is divisible by 5 are never used.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5 == 0
    source = docs.select(
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"),
        F.col(id_col).alias("id"),
        F.lower(text_of(text_col)).alias("text"),
    )
    model = character_model(source.select("text"))
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out)
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(train_rows)
    )
    families = one_of_each_family(source.join(F.broadcast(chosen), "id"))
    train = stored(families.repartition(16), "labelled")
    sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    passed = ["row", "id"]
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 4:
        total = sum(sizes.values())
        base = sizes.get(1, 0) / total if total else 0.0
        scored = source.select("row", "id", F.lit(base).alias("score"))
    else:
        half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))
        folds = [
            _evidence(
                train.where(half == k), model, feature_weights(train.where(half != k), model),
                ["label"],
            )
            for k in (0, 1)
        ]
        fitted = folds[0].unionByName(folds[1])
        inputs = ["top1", "top2", "hits", "density"]
        assembler = VectorAssembler(inputCols=inputs, outputCol="x")
        regression = LogisticRegression(
            featuresCol="x", labelCol="label", regParam=0.001, maxIter=100
        ).fit(assembler.transform(stored(fitted, "evidence")))
        linear = reduce(
            lambda s, t: s + t,
            [F.col(c) * F.lit(float(w)) for c, w in zip(inputs, regression.coefficients)],
            F.lit(float(regression.intercept)),
        )
        evidence = _evidence(source, model, feature_weights(train, model), passed)
        scored = evidence.select("row", "id", (1 / (1 + F.exp(-linear))).alias("score"))
    return scored.select(
        "row", "id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
