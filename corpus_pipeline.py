"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftfacts.llm.common import without
from weftfacts.llm.line_dedup import line_dedup
from weftfacts.llm.mixing import sample
from weftfacts.llm.piece_sampling import encode
from weftfacts.llm.quality_rules import quality_rules
from weftfacts.llm.queries import PIECE_BPE
from weftfacts.llm.simhash import near_duplicates
from weftfacts.session import materialize

#: The most of all tokens that the mixture keeps, and its targets: observed shares to these powers. They are gentle, so
#: that few documents have to go for the targets to hold.
BUDGET, POWERS = 0.8, {"source": 0.8, "lang": 0.85, "topic": 0.85}


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with a number of each row, written, so that every reader sees the same numbers; the number's column)."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id())), key


def _kept(docs: DataFrame, rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return without(rows, gone, key).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that a base rule or their Mahalanobis distance rejects, each by its own verdict."""
    rows, key = _numbered(docs)
    gone = materialize(quality_rules(rows, id_col=key).filter(~F.col("kept")).select(F.col("doc_id").alias(key)))
    return _kept(docs, rows, gone, key)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that three or more documents share, but for their last document; n_chars follows the text."""
    out = line_dedup(docs, carry=tuple(docs.columns))
    new = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return out.select(*[new.get(c, F.col(f"carried.`{c}`").alias(c)) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest doc_id, or where the whole group has none, any one."""
    rows, key = _numbered(docs)
    group = materialize(near_duplicates(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id"))
    # Rows without a doc_id come last; the smallest of a struct takes its fields in turn.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    first = rows.select(key, "doc_id").join(group, key).groupBy("component_id").agg(F.min(order).alias("first"))
    gone = materialize(group.select(key).join(first.select(F.col("first.row").alias(key)), key, "left_anti"))
    return _kept(docs, rows, gone, key)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that brings sources, languages and topics to their target weights."""
    return sample(docs, budget=BUDGET, powers=POWERS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes, lossless of every document left."""
    return encode(docs, PIECE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near), ("mixing", mixing), ("SentencePiece encoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs


#: Robust estimates, sampled segmentations and transitive groups have no SQL; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None
