"""Repair of conversation structure by dynamic programming with checkpoints.

A repaired conversation has the role initials ``(s?(ua)+)?``. Each turn is kept (cost 0),
given the role user or assistant (1) or deleted (2, the only choice for blank and repeated
turns); turns without text are inserted anywhere (5); a truncated turn that stays costs 5
more. Of the cheapest edits those whose initials (D, I, K, R) are ASCII-least are taken.

Backwards over the turns a vector of four numbers says what the rest costs from each state
of the pattern. Only the vectors at checkpoints are kept: about the square root of the turns
of a segment inside it, and one for every segment (the turns of a conversation that lie in
one part of the sorted table). Walking forward, the vectors of one block at a time are
computed again and the ASCII-least edit of no loss is taken. A conversation that spreads over
many tasks costs a matrix of 4 x 4 numbers for each of its segments: segments are measured
and walked in parallel, and only those matrices meet in one place.

Defined cases: a null role or text counts as one space, a null conversation is a conversation
of its own, null turns come first, and turns of equal number are ordered by role, then by a
hash of their text. An empty role, or one that starts with another letter than s, u or a,
cannot be kept. Conversations without turns cost nothing. Texts of any length are compared
by SHA-256. Further columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopefield.llm.common import joined_with_groups, stored

SPACES = " \t\n\x0b\f\r"

# Costs of the edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 50

# States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)

# Initials and faults of a turn, packed as initial + 4 * fault.
INITIALS = {"s": 1, "u": 2, "a": 3}
SOUND, BLANK, REPEATED, CUT = range(4)
KEPT = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT,
        (ASSISTANT, 2): USER}
LAWFUL = {(1, 2), (2, 3), (3, 2)}


def before(after: tuple, code: int) -> tuple:
    """Costs from each state in front of a turn, from those behind it."""
    cost = [DELETE + c for c in after]
    initial, fault = code & 3, code >> 2
    if fault != BLANK and fault != REPEATED:
        more = TRUNCATED if fault == CUT else 0
        for state in range(4):
            stay = REROLE + after[AFTER[state]]
            to = KEPT.get((state, initial))
            if to is not None:
                stay = min(stay, after[to])
            cost[state] = min(cost[state], more + stay)
    user = min(cost[USER], INSERT + cost[ASSISTANT])
    assistant = min(cost[ASSISTANT], INSERT + cost[USER])
    return min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant


def block_length(turns: int) -> int:
    return max(1, int(turns**0.5))


def checkpoints(codes: bytes, end: tuple) -> tuple[tuple, list[tuple]]:
    """The vector in front of all turns, and the vectors behind each block."""
    size = block_length(len(codes))
    kept, vector = [], end
    for at in range(len(codes) - 1, -1, -1):
        if at == len(codes) - 1 or (at + 1) % size == 0:
            kept.append(vector)
        vector = before(vector, codes[at])
    return vector, kept[::-1]


def walk(codes: bytes, end: tuple, state: int, last: bool = True) -> tuple[int, list[str], list]:
    """(state at the end, edits of each turn, roles they give) of the ASCII-least cheapest way.

    The edits of a turn are what is inserted in front of it and its own edit; the last turn
    of a conversation also has what is inserted behind it. A role is None where the turn
    keeps its own or goes.
    """
    size = block_length(len(codes))
    first, kept = checkpoints(codes, end)
    left = first[state]
    edits, roles = [], []
    for block, start in enumerate(range(0, len(codes), size)):
        turns = codes[start : start + size]
        vectors = [kept[block]]
        for code in reversed(turns):
            vectors.append(before(vectors[-1], code))
        for code in turns:
            here, after = vectors.pop(), vectors[-1]
            initial, fault = code & 3, code >> 2
            more = TRUNCATED if fault == CUT else 0
            done, given = "", []
            while True:
                if left == DELETE + after[state]:
                    done, given = done + "D", [*given, None]
                    left -= DELETE
                    break
                ahead = AFTER[state]
                # The vector in front of a turn allows for insertions there.
                if left - INSERT == here[ahead]:
                    done, given = done + "I", [*given, ROLE[state]]
                    state, left = ahead, left - INSERT
                    continue
                to = KEPT.get((state, initial))
                if to is not None and left == more + after[to]:
                    done, given = done + "K", [*given, None]
                    state, left = to, left - more
                else:
                    done, given = done + "R", [*given, ROLE[state]]
                    state, left = ahead, left - more - REROLE
                break
            edits.append(done)
            roles.append(given)
    while last and left > 0:
        edits[-1] += "I"
        roles[-1].append(ROLE[state])
        state, left = AFTER[state], left - INSERT
    return state, edits, roles


def transfer(codes: bytes) -> list[int]:
    """Cost of a segment from each state in front (rows) to each state behind it (columns)."""
    columns = []
    for state in range(4):
        unit = tuple(0 if s == state else NEVER for s in range(4))
        columns.append(checkpoints(codes, unit)[0])
    return [min(columns[j][i], NEVER) for i in range(4) for j in range(4)]


def before_segment(matrix: list[int], after: tuple) -> tuple:
    return tuple(min(matrix[4 * i + j] + after[j] for j in range(4)) for i in range(4))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with the faults that the check of this operator plants, by conversation and turn."""
    kind = F.crc32(
        F.concat_ws(
            ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
        ).cast("binary")
    ) % F.lit(20)
    rows = turns.select(
        "conv_id", "turn", kind.alias("kind"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


@dataclass(frozen=True)
class Repair:
    """What a repair found; all tables are stored.

    turns: conv, turn, role, text, pos in their order. edits: conv, pos, edit (initials),
    roles. reports: conv, gaps, blank, duplicate, truncated, illegal, cost.
    """

    turns: DataFrame
    edits: DataFrame
    reports: DataFrame


def _in_order(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns sorted over all tasks, with their place; equal keys are parted by row number."""
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n)
          for c, n in ((role, "role"), (text, "text"))],
        F.monotonically_increasing_id().alias("copy"),
    )
    keys = ("conv", "turn", "role", "hash", "copy")
    by = [F.col(c).asc_nulls_first() for c in keys]
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("hash", "copy")
    return stored(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _length_first(column: Column) -> Column:
    return F.concat(F.octet_length(column).cast("string"), F.lit(":"), column)


def _coded(turns: DataFrame) -> DataFrame:
    """conv, turn, pos, code of every turn; texts stay where they are."""
    spaces = F.lit(SPACES)
    initial = F.left("role", F.lit(1))
    code = F.lit(0)
    for letter, number in INITIALS.items():
        code = F.when(initial == letter, number).otherwise(code)
    bare = F.rtrim("text", spaces)
    compact = turns.select(
        "conv", "turn", "pos", code.alias("initial"),
        F.when(bare == "", BLANK)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(SOUND).alias("own"),
        F.sha2(F.concat(
            _length_first(F.coalesce(F.col("conv").cast("string"), F.lit(""))),
            F.col("conv").isNull().cast("string"), _length_first(F.col("role")), F.col("text"),
        ).cast("binary"), 256).alias("digest"),
    )
    compact = stored(compact, "coded")
    repeats = stored(
        compact.groupBy("digest")
        .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("size"))
        .where("size > 1"),
        "repeats",
    )
    marked = joined_with_groups(
        compact, repeats, "digest", "size", compact.count(), F.col("pos")
    )
    fault = (
        F.when(F.col("own") == BLANK, BLANK)
        .when(F.col("first") < F.col("pos"), REPEATED)
        .otherwise(F.col("own"))
    )
    return marked.select("conv", "turn", "pos", (F.col("initial") + 4 * fault).alias("code"))


_FACTS = (
    "turns long, blank long, duplicate long, truncated long, illegal long, head int, tail int, "
    "low long, high long, numbers long"
)
_SEGMENT = f"conv {{kind}}, part long, pos long, codes binary, matrix array<long>, {_FACTS}"


def _facts(turns: list, codes: bytes) -> tuple:
    known = [t for t in turns if t is not None]
    faults = [c >> 2 for c in codes]
    initials = [c & 3 for c in codes]
    illegal = sum(pair not in LAWFUL for pair in zip(initials, initials[1:]))
    return (
        len(codes), faults.count(BLANK), faults.count(REPEATED), faults.count(CUT), illegal,
        initials[0], initials[-1], min(known, default=None), max(known, default=None),
        len(set(known)),
    )


def _segments(coded: DataFrame, kind: str) -> DataFrame:
    """One row per conversation and part of the sorted table, with its cost matrix."""
    import pyarrow as pa

    grouped = coded.groupBy("conv", F.shiftright("pos", 33).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn", "code"))).alias("rows")
    )

    def measured(batches):
        for batch in batches:
            out = []
            for rows in batch.column(2).to_pylist():
                codes = bytes(r["code"] for r in rows)
                facts = _facts([r["turn"] for r in rows], codes)
                out.append((rows[0]["pos"], codes, transfer(codes), *facts))
            columns = list(zip(*out)) if out else [[]] * 13
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())] + [pa.int64()] * 5
            kinds += [pa.int32()] * 2 + [pa.int64()] * 3
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays],
                names=[f.split()[0] for f in _SEGMENT.replace("{kind}", "x").split(", ")],
            )

    return stored(grouped.mapInArrow(measured, _SEGMENT.format(kind=kind)), "segments")


def _reports(segments: DataFrame, kind: str) -> DataFrame:
    """Per conversation: counts, cost, and the vector behind each segment if there are several."""
    import pyarrow as pa

    facts = [f.split()[0] for f in _FACTS.split(", ")]
    grouped = segments.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("part", "matrix", *facts))).alias("rows")
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def folded(batches):
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                total = {n: sum(r[n] for r in rows) for n in counts[1:5]}
                total["illegal"] += sum(
                    (a["tail"], b["head"]) not in LAWFUL for a, b in zip(rows, rows[1:])
                )
                numbered = [r for r in rows if r["low"] is not None]
                distinct = sum(r["numbers"] for r in numbered) - sum(
                    a["high"] == b["low"] for a, b in zip(numbered, numbered[1:])
                )
                total["gaps"] = (
                    numbered[-1]["high"] - numbered[0]["low"] + 1 - distinct if numbered else 0
                )
                vector, bounds = END, []
                for r in reversed(rows):
                    bounds.append({"part": r["part"], "behind": list(vector)})
                    vector = before_segment(r["matrix"], vector)
                total["cost"] = vector[START]
                out.append([total[n] for n in counts] + [bounds[::-1] if len(rows) > 1 else []])
            columns = list(zip(*out)) if out else [[]] * 7
            bound = pa.struct([("part", pa.int64()), ("behind", pa.list_(pa.int64()))])
            arrays = [pa.array(list(c), pa.int64()) for c in columns[:6]]
            arrays.append(pa.array(list(columns[6]), pa.list_(bound)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=["conv", *counts, "bounds"]
            )

    schema = ", ".join(f"{n} long" for n in counts)
    schema = f"conv {kind}, {schema}, bounds array<struct<part: long, behind: array<long>>>"
    return stored(grouped.mapInArrow(folded, schema), "reports")


def _entries(segments: DataFrame, bounds: DataFrame, kind: str) -> DataFrame:
    """conv, part, behind, state in front of every segment of conversations with several."""
    import pyarrow as pa

    def left(batches):
        for batch in batches:
            exits = []
            for codes, behind in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                exits.append([walk(codes, tuple(behind), s, last=False)[0] for s in range(4)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3)), pa.array(exits, pa.list_(pa.int32()))],
                names=["conv", "part", "behind", "exits"],
            )

    walked = _at_segments(segments, bounds, "inner").select("conv", "part", "codes", "behind")
    walked = walked.mapInArrow(
        left, f"conv {kind}, part long, behind array<long>, exits array<int>"
    )
    chained = walked.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("part", "behind", "exits"))).alias("rows")
    )
    state = F.aggregate(
        F.col("rows"),
        F.array(F.lit(START)),
        lambda seen, r: F.concat(seen, F.array(r["exits"][F.element_at(seen, -1)])),
    )
    return stored(
        chained.select("conv", F.explode(F.arrays_zip("rows", state.alias("state"))).alias("r"))
        .where("r.rows IS NOT NULL")
        .select("conv", "r.rows.part", "r.rows.behind", "r.state"),
        "entries",
    )


def _at_segments(segments: DataFrame, more: DataFrame, how: str) -> DataFrame:
    more = more.withColumnsRenamed({"conv": "_conv", "part": "_part"})
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    return segments.join(more, same, how).drop("_conv", "_part")


def _edits(segments: DataFrame, entries: DataFrame, kind: str) -> DataFrame:
    import pyarrow as pa

    placed = _at_segments(segments, entries, "left").select(
        "conv", "part", "pos", "codes", "behind", "state"
    )
    final = placed.where("behind IS NOT NULL").groupBy("conv").agg(F.max("part").alias("part"))
    final = final.withColumn("final", F.lit(True))
    placed = _at_segments(placed, final, "left")

    def walked(batches):
        for batch in batches:
            convs, places, edits, roles = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6)]
            for at, (pos, codes, behind, state, final) in enumerate(zip(*columns)):
                alone = behind is None
                _, mine, given = walk(
                    codes, END if alone else tuple(behind), state or START, alone or bool(final)
                )
                convs += [at] * len(codes)
                places += range(pos, pos + len(codes))
                edits += mine
                roles += given
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(convs, pa.int64())),
                    pa.array(places, pa.int64()),
                    pa.array(edits, pa.string()),
                    pa.array(roles, pa.list_(pa.string())),
                ],
                names=["conv", "pos", "edit", "roles"],
            )

    return stored(
        placed.mapInArrow(walked, f"conv {kind}, pos long, edit string, roles array<string>"),
        "edits",
    )


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> Repair:
    """Faults and cheapest edits of every conversation."""
    ordered = _in_order(turns, conv_col, turn_col, role_col, text_col)
    kind = ordered.schema["conv"].dataType.simpleString()
    segments = _segments(_coded(ordered), kind)
    reports = _reports(segments, kind)
    bounds = reports.select("conv", F.inline("bounds"))
    edits = _edits(segments, _entries(segments, bounds, kind), kind)
    return Repair(ordered, edits, reports.drop("bounds"))


def _letters(column: str) -> Column:
    places = F.sequence(F.lit(1), F.length(column))
    return F.transform(places, lambda i: F.substring(F.col(column), i, F.lit(1)))


def repaired_turns(found: Repair) -> DataFrame:
    """conv, place, edit, role, text of what stays, in the order of ``place`` (pos, number)."""
    edits = found.edits.select(F.col("pos").alias("_pos"), "edit", "roles")
    rows = found.turns.join(edits, F.col("pos") == F.col("_pos"))
    letters = _letters("edit")
    return (
        rows.select(
            "conv", "pos", "role", "text",
            F.posexplode(F.arrays_zip(letters.alias("letter"), "roles")).alias("n", "one"),
        )
        .where("one.letter <> 'D'")
        .select(
            "conv", F.struct("pos", "n").alias("place"), F.col("one.letter").alias("edit"),
            F.coalesce("one.roles", "role").alias("role"),
            F.when(F.col("one.letter") == "I", "").otherwise(F.col("text")).alias("text"),
        )
    )


def repair_digests(turns: DataFrame, found: Repair, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``turns``: the report, the edits and a hash of what stays.

    A hash over a whole conversation can only be taken in its order: its repaired turns
    stream through one task, a batch at a time. Everything before that is spread out.
    """
    import pyarrow as pa

    kind = found.turns.schema["conv"].dataType.simpleString()
    edits = found.edits.select(F.col("pos").alias("_pos"), "edit", "roles")
    rows = found.turns.join(edits, F.col("pos") == F.col("_pos"))
    letters = _letters("edit")
    lines = F.filter(
        F.transform(
            F.arrays_zip(letters.alias("letter"), "roles"),
            lambda e: F.when(e["letter"] == "D", F.lit(None)).otherwise(
                F.concat(
                    F.coalesce(e["roles"], F.col("role")), F.lit(":"),
                    F.when(e["letter"] == "I", "").otherwise(F.col("text")),
                )
            ),
        ),
        lambda line: line.isNotNull(),
    )
    pieces = (
        rows.select("conv", "pos", "edit", F.size(lines).alias("n"),
                    F.array_join(lines, "\n").alias("piece"))
        .repartition("conv")
        .sortWithinPartitions("conv", "pos")
    )

    def hashed(batches):
        import hashlib

        def told(conv, audit, sha):
            return pa.RecordBatch.from_arrays(
                [conv, pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                names=["conv", "audit", "repaired_sha256"],
            )

        name, conv, audit, sha, filled = None, None, None, None, False
        for batch in batches:
            names = batch.column(0).to_pylist()
            columns = zip(names, *(batch.column(i).to_pylist() for i in (2, 3, 4)))
            for at, (mine, edit, n, piece) in enumerate(columns):
                if audit is None or mine != name:
                    if audit is not None:
                        yield told(conv, audit, sha)
                    name, conv = mine, batch.column(0).slice(at, 1)
                    audit, sha, filled = [], hashlib.sha256(), False
                audit.append(edit)
                if n:
                    sha.update((b"\n" if filled else b"") + piece.encode())
                    filled = True
        if audit is not None:
            yield told(conv, audit, sha)

    digests = pieces.mapInArrow(hashed, f"conv {kind}, audit string, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv", "_conv")
    reports = found.reports.withColumnRenamed("conv", "_told")
    names = turns.select(F.col(conv_col).alias("_name")).distinct()
    joined = names.join(reports, F.col("_name").eqNullSafe(F.col("_told")), "left").join(
        digests, F.col("_name").eqNullSafe(F.col("_conv")), "left"
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("_name").alias(conv_col),
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias(
            "repaired_sha256"
        ),
    )
