"""One query per operator over its whole table, and SQL where a second engine can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopefield.llm import (
    collocations,
    conversation_repair,
    decontamination,
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    piece_lattice,
    simhash,
    suffix_dedup,
    token_records,
    toxicity,
    warc,
)
from slopefield.llm.common import table

# Lower-casing of A-Z alone.
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

DIGEST_COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_exact_dedup(spark, sf_dir):
    """Groups of equal texts; the row of largest doc_id stays."""
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op2_token_records(spark, sf_dir):
    """Token ids of all documents written as binary records in id order and read back."""
    import public_tokenizers

    files = token_records.write_records(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    read = token_records.read_records(files, with_ids=False)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_language_id(spark, sf_dir):
    """Language of every document, learnt from the rows that are not held out."""
    import public_tokenizers

    found = language_id.identify(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op4_decontamination(spark, sf_dir):
    """Words of documents inside any 10-word window of a benchmark item."""
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op5_sentencepiece(spark, sf_dir):
    """The four best segmentations of every document, and whether the best decodes to it."""
    import public_tokenizers

    found = piece_lattice.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("piece_bpe_32k.model"),
        n_best=4,
        with_ids=False,
    )
    return found.select(
        F.col("id").alias("doc_id"), "n_pieces", "scores", "ids_crc32", "restored"
    )


def op6_jaccard_join(spark, sf_dir):
    """Components of documents whose 4-word shingle sets overlap by 85 percent."""
    found = jaccard_join.similar_documents(
        table(spark, sf_dir, "documents"), words=4, percent=85
    )
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, learnt from the labels that are not held out."""
    scores = toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return scores.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op8_license_scan(spark, sf_dir):
    """Licences of documents as files of a tree: source / language / number.

    Every tenth document is a licence file, of a directory higher up the rarer it is.
    """
    path = """CASE WHEN doc_id % 250 = 0 THEN concat(source, '/LICENSE-', doc_id)
                   WHEN doc_id % 50 = 0 THEN concat(source, '/', lang, '/LICENSE-', doc_id)
                   WHEN doc_id % 10 = 0
                   THEN concat(source, '/', lang, '/', doc_id DIV 500, '/LICENSE-', doc_id)
                   ELSE concat(source, '/', lang, '/', doc_id DIV 500, '/', doc_id, '.txt') END"""
    files = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", f"{path} AS path", "text", "doc_id % 10 = 0 AS licence_file"
    )
    return license_scan.scan(files).withColumnRenamed("id", "doc_id")


def op9_suffix_dedup(spark, sf_dir):
    """Bytes of documents left when every 200-byte string that repeats is removed."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op10_warc(spark, sf_dir):
    """Pages written as WARC archives and read back."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(archives, with_payload=False)
    return records.withColumnRenamed("id", "page_id").select(*DIGEST_COLUMNS)


def op11_simhash(spark, sf_dir):
    """Components of documents whose fingerprints differ in three bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op12_conversation_repair(spark, sf_dir):
    """Damaged conversations: their faults, cheapest edits and what is left."""
    turns = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damaged(turns))
    return conversation_repair.repair_digests(turns, found)


def op13_collocations(spark, sf_dir):
    """The first 2,000 phrases of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_records": op2_token_records,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_simhash": op11_simhash,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}

SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_decontamination": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}, {lower}),
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item,
                   regexp_extract_all(translate(coalesce(text, ''), {upper}, {lower}),
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item, w[i:i + least(len(w), 10) - 1] AS g
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b
                  WHERE len(w) > 0)),
        dw AS (
            SELECT doc_id, i, n, w[i:i + n - 1] AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT len(g) AS n FROM bw) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (g)),
        words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(DISTINCT item) AS n_items,
                   string_agg(DISTINCT item, ',' ORDER BY item) AS names
            FROM hits GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""".format(
        upper=UPPER, lower=LOWER
    ),
    "op6_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}, {lower}),
                   '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, w[i:i + least(len(w), 4) - 1] AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d
                  WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g)
                WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * c >= 85 * (p.n + q.n - c)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM d
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
        """.format(upper=UPPER, lower=LOWER),
    "op8_license_scan": """
        WITH f AS (
            SELECT doc_id, coalesce(text, '') AS text, doc_id % 10 = 0 AS licence_file,
                   CASE WHEN doc_id % 250 = 0 THEN source || '/LICENSE-' || doc_id
                        WHEN doc_id % 50 = 0 THEN source || '/' || lang || '/LICENSE-' || doc_id
                        WHEN doc_id % 10 = 0
                        THEN source || '/' || lang || '/' || (doc_id // 500) || '/LICENSE-' || doc_id
                        ELSE source || '/' || lang || '/' || (doc_id // 500) || '/' || doc_id || '.txt'
                   END AS path FROM documents),
        l AS (
            SELECT doc_id, licence_file, list_transform(list_filter(string_split(text, chr(10)),
                   lambda x: regexp_matches(x, '{mention}')), lambda x: trim(x)) AS lines
            FROM f WHERE regexp_matches(text, '{mention}')),
        m AS (
            SELECT doc_id, unnest(lines) AS passage FROM l
            UNION ALL SELECT doc_id, array_to_string(lines, ' ') FROM l
            WHERE licence_file AND len(lines) > 1),
        c AS (SELECT passage, count(*) AS copies FROM m GROUP BY passage),
        p AS (
            SELECT DISTINCT passage, copies, unnest(regexp_extract_all(lower(passage),
                   '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS word FROM c),
        n AS (SELECT coalesce(sum(copies), 0) AS total FROM c),
        w AS (SELECT word, sum(copies) AS df FROM p GROUP BY word),
        t AS (
            SELECT DISTINCT licence, unnest(regexp_extract_all(lower(notice),
                   '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS word
            FROM (VALUES {templates}) AS v(licence, notice)),
        ts AS (
            SELECT licence, word, pow(ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0, 2) AS sq
            FROM t LEFT JOIN w USING (word) CROSS JOIN n),
        ps AS (
            SELECT passage, word, pow(ln((1.0 + total) / (1.0 + df)) + 1.0, 2) AS sq
            FROM p JOIN w USING (word) CROSS JOIN n),
        tn AS (SELECT licence, sqrt(sum(sq)) AS norm FROM ts GROUP BY licence),
        pn AS (SELECT passage, sqrt(sum(sq)) AS norm FROM ps GROUP BY passage),
        s AS (
            SELECT passage, licence, round(sum(ps.sq) / (any_value(pn.norm) * any_value(tn.norm)), 6)
                   AS cosine
            FROM ps JOIN t USING (word) JOIN pn USING (passage) JOIN tn USING (licence)
            GROUP BY passage, licence),
        o AS (
            SELECT doc_id, licence AS own_licence, cosine FROM m JOIN s USING (passage)
            WHERE cosine >= 0.6
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
        g AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f),
        offers AS (
            SELECT folder AS directory, min(own_licence) AS offered
            FROM g JOIN o USING (doc_id) WHERE licence_file GROUP BY folder),
        up AS (
            SELECT g.doc_id, offered, directory
            FROM g JOIN offers ON g.folder = directory OR starts_with(g.folder, directory || '/')
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(directory) DESC) = 1)
        SELECT g.doc_id, own_licence, cosine, coalesce(own_licence, offered) AS licence,
               CASE WHEN own_licence IS NOT NULL THEN 'own'
                    WHEN offered IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
               CASE WHEN own_licence IS NULL THEN directory END AS directory
        FROM g LEFT JOIN o USING (doc_id) LEFT JOIN up USING (doc_id)""".format(
        mention=license_scan.MENTION,
        templates=", ".join(f"('{k}', '{v}')" for k, v in license_scan.TEMPLATES.items()),
    ),
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
                     sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first
              FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
        FROM d""",
    "op12_conversation_repair": """
        WITH RECURSIVE t AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
                   CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) AS v(i)),
        k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce([4294967295] || list_transform(string_split(
                       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
                       coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
            FROM conversations, t),
        d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                        ELSE text END AS text
            FROM k, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
            FROM d),
        r AS (
            SELECT *, left(role, 1) AS initial,
                   CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                        WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated'
                        ELSE 'none' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM o),
        s AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM r GROUP BY conv_id),
        a(state, ahead, given) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
        g AS (
            SELECT state, state AS spot, '' AS letters, CAST([] AS VARCHAR[]) AS lines FROM a
            UNION ALL SELECT state, ahead, 'I', [given || ':'] FROM a
            UNION ALL SELECT a.state, b.ahead, 'II', [a.given || ':', b.given || ':']
            FROM a JOIN a AS b ON b.state = a.ahead WHERE a.state < 2),
        kept(spot, initial, ahead) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        e AS (
            SELECT conv_id, i, spot, spot AS ahead, 'D' AS letter, 2 AS price, CAST([] AS VARCHAR[]) AS line
            FROM r, (SELECT DISTINCT spot FROM g)
            UNION ALL SELECT conv_id, i, spot, ahead, 'K', CASE fault WHEN 'truncated' THEN 5 ELSE 0 END,
                   [role || ':' || text]
            FROM r JOIN kept USING (initial) WHERE fault IN ('truncated', 'none')
            UNION ALL SELECT conv_id, i, state, ahead, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 1 END,
                   [given || ':' || text] FROM r, a WHERE fault IN ('truncated', 'none')),
        w AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, '000000000' AS v, CAST([] AS VARCHAR[]) AS lines
            FROM s
            UNION ALL
            SELECT conv_id, i, ahead, min(v), arg_min(lines, v) FROM (
                SELECT w.conv_id, e.i, e.ahead,
                       lpad(CAST(CAST(v[1:9] AS BIGINT) + 5 * length(letters) + price AS VARCHAR), 9, '0')
                       || v[10:] || letters || letter AS v, w.lines || g.lines || line AS lines
                FROM w JOIN g USING (state)
                JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.spot = g.spot)
            GROUP BY conv_id, i, ahead),
        b AS (
            SELECT conv_id, min(v) AS v, arg_min(lines, v) AS lines FROM (
                SELECT w.conv_id, lpad(CAST(CAST(v[1:9] AS BIGINT) + 5 * length(letters) AS VARCHAR), 9, '0')
                       || v[10:] || letters AS v, w.lines || g.lines AS lines
                FROM w JOIN g USING (state) JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
                WHERE g.spot IN (0, 3))
            GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(CAST(v[1:9] AS BIGINT), 0) AS cost,
               coalesce(v[10:], '') AS audit,
               sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c
        LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_collocations": """
        WITH p AS (
            SELECT doc_id, lang, piece, row_number() OVER () AS number FROM (
                SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                       translate(coalesce(text, ''), {upper}, {lower}), '[.,;:!?\\x0A-\\x0D]')) AS piece
                FROM documents)),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, w[i:i + k - 1] AS g, count(*) AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
                  FROM w, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k)
            GROUP BY 1, 2 HAVING count(*) >= 30),
        c AS (SELECT * FROM g WHERE len(g) > 1),
        u AS (
            SELECT x.lang, x.g, x.f AS a, k, l.f AS l, r.f AS r,
                   CAST(2000000 * CAST(x.f AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
            FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM c) AS x
            JOIN g AS l ON l.lang = x.lang AND l.g = x.g[1:k]
            JOIN g AS r ON r.lang = x.lang AND r.g = x.g[k + 1:]),
        b AS (
            SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        i AS (
            SELECT lang, g[s:s + m - 1] AS g, max(f) AS most
            FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS s
                  FROM c, (VALUES (2), (3)) AS t(m) WHERE len(g) > m)
            GROUP BY 1, 2)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (
            SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score,
                   row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC,
                                      encode(array_to_string(b.g, ' '))) AS rank
            FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g
            WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
        JOIN n USING (lang) WHERE rank <= 2000""".format(
        upper=UPPER, lower=LOWER
    ),
}
