"""Safe edits: which can be applied together, and the texts after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ORDER = ("offset", "length", "rule_id", "applicability", "replacement")


def plan(edits: DataFrame) -> DataFrame:
    """edits with `conflict`: whether an edit overlaps the one before it in its file, or neither takes text and they touch.

    edits: file_id, offset, length (bytes), replacement, applicability, rule_id. Order: place, then the other columns.
    """
    w = Window.partitionBy("file_id").orderBy(*_ORDER)
    end = F.lag(F.col("offset") + F.col("length")).over(w)
    before = F.lag("length").over(w)
    touching = (F.col("offset") == end) & ((F.col("length") == 0) | (before == 0)) & (F.lag("offset").over(w) == F.col("offset"))
    return edits.withColumn("conflict", F.coalesce((F.col("offset") < end) | touching, F.lit(False)))


def apply(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_id, source, applied): each file after its safe edits. A file with a conflict, or with an edit out of bounds or
    inside a character, is left as it is (applied 0). One row's edits are folded over its bytes in generated code."""
    safe = plan(edits.filter("applicability = 'safe'"))
    by = safe.groupBy("file_id").agg(F.bool_or("conflict").alias("bad"), F.sort_array(F.collect_list(F.struct(F.col("offset").cast("int").alias("o"), F.col("length").cast("int").alias("l"), F.coalesce("replacement", F.lit("")).cast("binary").alias("r")))).alias("es"))
    rows = files.select("file_id", "source", F.col("source").cast("binary").alias("b")).join(by, "file_id", "left")
    inside = "(o <= 0 OR o >= octet_length(b) OR (conv(hex(substring(b, o + 1, 1)), 16, 10) & 192) <> 128)"
    fits = f"forall(es, e -> e.o >= 0 AND e.l >= 0 AND e.o + e.l <= octet_length(b) AND {inside.replace('o ', 'e.o ')} AND {inside.replace('o ', '(e.o + e.l) ')})"
    fold = "aggregate(es, named_struct('t', cast('' AS binary), 'p', 0), (a, e) -> named_struct('t', concat(a.t, substring(b, a.p + 1, e.o - a.p), e.r), 'p', e.o + e.l), a -> concat(a.t, substring(b, a.p + 1)))"
    ok = F.col("es").isNotNull() & ~F.col("bad") & F.expr(fits)
    return rows.select("file_id", F.when(ok, F.expr(f"decode({fold}, 'UTF-8')")).otherwise(F.col("source")).alias("source"), F.when(ok, F.size("es")).otherwise(F.lit(0)).alias("applied"))
