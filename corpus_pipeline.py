"""The training-data pipeline over ``documents``: five stages, each over all that came before.

    toxicity        documents whose score is 0.5 or more go
    exact_dedup     of equal texts the row with the largest doc_id stays
    jaccard_join    of each group of near copies (five-word shingles, similarity 0.8 or
                    more, through chains of links) the row with the smallest doc_id stays
    decontaminate   documents with a word inside any window of a benchmark item go
    sentencepiece   the rows that are left, with the ids of their four best segmentations and
                    the text decoded from the best

Each stage is written as Parquet to the shared folder and read again before the next: a
lost executor costs a stage's tasks, not the pipeline. Stages that reject rows first store
their input with a row number as a column, so that null or repeated ids do no harm and no
other file splits can give a row another number. That copy is deleted when the next stage
that makes one begins: by then the result has to be written.

Defined cases: a null text counts as empty in every stage. Empty texts score as texts without
evidence, are equal to each other (one stays), link with nothing, hold no window and have no
pieces. Rows that repeat text and id are judged row by row, and one of them stays. Very long
texts are read whole. Ties: of equal texts the largest doc_id stays, of near copies the
smallest; with ids equal too, one row. An empty table, or empty labels or benchmark tables, go
through all stages. Further columns, whatever their names, are carried to the last stage, which
returns its own.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.llm import decontamination, exact_dedup, jaccard_join, piece_lattice, toxicity
from slopefield.llm.common import BATCH_ROWS, deleted, numbered, stored, table

# The row number, under a name that no column of the documents has.
ROW = "_place_in_stage"
N_BEST = 4


# Numbered copies that the stage before has read; its result lies in Parquet by now.
_read: list[tuple[SparkSession, DataFrame]] = []


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The stage's input with row numbers. What the stage before left goes first: its numbered
    copy, and the shuffle files and broadcasts that Spark drops once the driver has collected
    the tables they belong to."""
    while _read:
        owner, used = _read.pop()
        if owner is spark:
            deleted(used)
    gc.collect()
    spark._jvm.System.gc()
    placed = numbered(docs, ROW)
    _read.append((spark, placed))
    return placed


def _without(placed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of a numbered table whose number (``row``) is not among the rejected."""
    gone = rejected.select(F.col("row").alias("_gone"))
    return placed.join(gone, F.col(ROW) == F.col("_gone"), "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = _numbered(spark, docs)
    scores = toxicity.toxicity_scores(placed, table(spark, sf_dir, "labels"), row_col=ROW)
    return _without(placed, stored(scores.where("predicted = 1").select("row"), "toxic"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = _numbered(spark, docs)
    found = jaccard_join.similar_documents(placed, row_col=ROW)
    return _without(placed, stored(found.where("NOT kept").select("row"), "near-copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = _numbered(spark, docs)
    texts = placed.select(F.col(ROW).alias("row"), "text")
    found = decontamination.contamination(texts, table(spark, sf_dir, "benchmark"), id_col="row")
    return _without(placed, stored(found.where("contaminated").select("row"), "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = public_tokenizers.path("piece_bpe_32k.model")
    # Whoever reads the result makes its batches, so their bound stays with the session.
    for name, bound in BATCH_ROWS.items():
        spark.conf.set(name.replace("__", "."), bound)
    # Encoded and decoded by one worker: a second one would hold a model of its own.
    found = piece_lattice.encode_documents(docs, file, n_best=N_BEST, with_text=True)
    return found.select(
        F.col("id").alias("doc_id"), "n_pieces", "pieces", "scores", "alternatives", "restored",
        "decoded",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

# The first stage learns a model and the last follows a vocabulary: no SQL. The tests hold the
# three stages between them against brute force on whole tables, the last against all
# segmentations of a small fixture, and the first against planted words.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
