"""What the corpus operators share: byte tables, Arrow loops, and joins that stay even under hot keys."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, ship  # noqa: F401

#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Slices of a key that any join or streaming pass on it may be spread over.
SALTS = 16


def lower_az(c: Column) -> Column:
    """JVM-side lower-casing of A-Z only."""
    return F.translate(c, _UPPER_AZ, _UPPER_AZ.lower())


def doc_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, null text as empty; other columns can't clash with ours."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most `limit` bytes in `column`, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system; a worker between two tasks would else keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # glibc only
    if trim:
        trim(0)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = 4 << 20) -> DataFrame:
    """mapInArrow with fn on text-bounded pieces of each batch; no row is seen twice and none needs its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", limit):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def salt(c: Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def replicated(df: DataFrame, n: int = SALTS) -> DataFrame:
    """One copy of a narrow, key-unique table per salt."""
    return df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(n)])))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _bits(h: Column) -> Column:
    """Three bits of a 64-bit word, chosen by the upper half of a hash."""
    one = F.lit(1).cast("long")
    parts = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (58, 52, 46)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def bloom(keys: DataFrame, key: Column, max_words: int = 1 << 21) -> Callable[[Column], Column]:
    """A test that is true of every key in the table and false of nearly every other, evaluated in the JVM.

    It is one array of 64-bit words, 16 bits a key and max_words words (16 MB) at most, held as a scalar subquery. Beyond
    max_words * 16 keys it would tell little and the test is true of all. What passes is still to be joined exactly: the
    test only keeps rows that cannot match out of an exchange.
    """
    n = keys.count()
    if not n:
        return lambda c: F.lit(False)
    if n > max_words * 16:
        return lambda c: F.lit(True)
    words = min(max_words, 1 << max(4, (n // 4).bit_length()))
    h = F.xxhash64(key)
    rows = keys.select(F.pmod(h, F.lit(words)).cast("int").alias("w"), _bits(h).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(words, np.int64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy()
    spark = keys.sparkSession
    held = materialize(spark.createDataFrame(pa.table({"words": pa.array([table], pa.list_(pa.int64()))})))

    def test(c: Column) -> Column:
        h = F.xxhash64(c)
        mask = _bits(h)
        return F.get(held.scalar(), F.pmod(h, F.lit(words)).cast("int")).bitwiseAND(mask) == mask

    return test


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in `gone`. Only rows that may be in it are moved; the others stay where they were read."""
    maybe = bloom(gone, F.col(key))
    test = maybe(F.col(key))
    return rows.filter(~test).unionByName(rows.filter(test).join(gone.select(key), key, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns]))
