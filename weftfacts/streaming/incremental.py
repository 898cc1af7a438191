"""Findings kept up to date under a stream of edits: each batch costs its changed files and those that depend on them, and
leaves the same findings as a scan of everything would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import reverse_closure
from ..session import materialize

Scan = Callable[[DataFrame, DataFrame], DataFrame]
CHANGES = "file_id string, revision long, source string"


def latest(changes: DataFrame) -> DataFrame:
    """The change of the highest revision of each file; older ones that come late are dropped. A null source deletes."""
    return changes.groupBy("file_id").agg(F.max_by(F.struct("revision", "source"), "revision").alias("c")).select("file_id", "c.revision", "c.source")


def merged(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files after the changes: per file the higher revision stays. Deleted files are kept as rows without a source, so that
    a late older edit does not bring them back."""
    return latest(files.select("file_id", "revision", "source").unionByName(changes.select("file_id", "revision", "source")))


def dirty(before: DataFrame, after: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(id) of files whose text differs, and of all that depend on them over edges (src depends on dst), those of before and
    after alike. Files whose text came back the same are not dirty, whatever their revision."""
    digest = lambda t, n: t.select("file_id", F.sha2(F.coalesce("source", F.lit("\0")), 256).alias(n))
    both = digest(before, "a").join(digest(after, "b"), "file_id", "full")
    changed = materialize(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("file_id").alias("id")))
    return changed if edges is None else reverse_closure(edges, changed).select("id")


class Store:
    """Files, findings and edges as one table a revision under a shared folder; a pointer file names the current one."""

    def __init__(self, spark: SparkSession, path: str, edges: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.path, self.edges = spark, path.rstrip("/"), edges

    def _pointer(self) -> int:
        rows = [int(r[0]) for r in self._read("pointer", "epoch long").collect()]
        return max(rows, default=-1)

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        return self._read(f"files/{self._pointer()}", CHANGES)

    def findings(self) -> DataFrame:
        at = self._pointer()
        return self.spark.read.parquet(f"{self.path}/findings/{at}") if at >= 0 else self.spark.createDataFrame([], "file_id string")

    def apply(self, changes: DataFrame, scan: Scan, epoch: int) -> None:
        """One batch. An epoch that was applied before is skipped, so a batch that is sent again changes nothing.

        scan(dirty files, all files) gives the findings of the dirty files, with a file_id each.
        """
        at = self._pointer()
        if epoch <= at:
            return
        before = self.files()
        merged(before, changes).write.mode("overwrite").parquet(f"{self.path}/files/{epoch}")
        after = self.spark.read.parquet(f"{self.path}/files/{epoch}")
        live = after.filter("source IS NOT NULL")
        edges = self.edges(before.filter("source IS NOT NULL")).unionByName(self.edges(live)).distinct() if self.edges else None
        touched = materialize(dirty(before, after, edges))
        fresh = scan(live.join(touched.withColumnRenamed("id", "file_id"), "file_id", "left_semi"), live)
        if at >= 0:
            kept = self.findings().join(touched.withColumnRenamed("id", "file_id"), "file_id", "left_anti")
            fresh = kept.select(*fresh.columns).unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{self.path}/findings/{epoch}")
        # The new revision counts from here on: what ends half-way before leaves the old one in place.
        self.spark.createDataFrame([(epoch,)], "epoch long").write.mode("append").parquet(f"{self.path}/pointer")


def run(changes: DataFrame, store: Store, scan: Scan, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Applies a stream of changes, one batch at a time; without an interval all that is there, and then it ends."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: store.apply(df, scan, epoch))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
