"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z. A key of at least `min_chars` code points
that at least `min_docs` documents hold loses all its lines but those in the largest doc_id that holds it.

Cost: the 128-bit key hashes are shuffled once, after each document gives a key only once and each map task has combined
its counts, so a line that a third of all documents share is one row a task. Only occurrences of keys that a Bloom filter of
repeated keys lets through meet the repeated keys, in a join salted on both sides. Of the texts, only those that lose lines
(and the few the filter can't tell from them) are moved; the others stay where they are read and don't enter Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bloom, doc_text, map_text, materialize, replicated, salt, text_bytes

_STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONT = bytes(range(0x80, 0xC0))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key, or None when it is too short to count."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.translate(None, _CONT)) < min_chars):
        return None
    return key.translate(LOWER)


def _hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    digest = xxhash.xxh3_128_digest
    return [None if (k := line_key(x, min_chars)) is None else digest(k) for x in text.split(b"\n")]


def _exploder(min_chars: int):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        owner, keys = [], []
        for i, t in enumerate(text_bytes(piece.column("text"))):
            own = set(_hashes(t, min_chars))
            own.discard(None)
            owner += [i] * len(own)
            keys += own
        pair, at = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2), pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays([piece.column("doc_id").take(at), piece.column("th").take(at), pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["doc_id", "th", "h1", "h2"])

    return run


def dropped_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, th, drops): of every text that loses lines, the 16-byte hashes of the keys it loses. docs: doc_id, text, th.

    th tells the texts of one doc_id apart, so that no row carries keys that its text lacks, however many rows share an id
    or have none.
    """
    lines = materialize(map_text(docs.filter(F.octet_length("text") >= min_chars), _exploder(min_chars), "doc_id long, th long, h1 long, h2 long"))
    often = materialize(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2"))
    # Rows that repeat a doc_id are one document: the exact distinct count is taken where it can matter.
    maybe = bloom(often, F.struct("h1", "h2"))
    held = lines.filter(maybe(F.struct("h1", "h2"))).withColumn("salt", salt(F.struct("doc_id", "th"))).join(replicated(often), ["h1", "h2", "salt"])
    held = materialize(held.select("h1", "h2", "salt", "doc_id", "th").distinct())
    keep = held.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")).filter(F.col("n") >= min_docs)
    lost = held.join(replicated(keep.drop("n")), ["h1", "h2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return lost.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))


def _rebuild(min_chars: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops = b.column("drops")
            offsets = drops.offsets.to_numpy()
            flat = drops.values.flatten() if len(drops.values) else None
            packed = np.stack([flat[0].to_numpy(zero_copy_only=False), flat[1].to_numpy(zero_copy_only=False)], 1) if flat else np.zeros((0, 2), np.int64)
            null = drops.is_null().to_pylist()
            n_lines, n_dropped, digest, kept_text = [], [], [], []
            for i, t in enumerate(text_bytes(b.column("text"))):
                n_lines.append(t.count(b"\n") + 1)
                lost = 0
                if not null[i]:
                    gone = {row.tobytes() for row in packed[offsets[i] : offsets[i + 1]]}
                    parts = t.split(b"\n")
                    kept = [x for x, h in zip(parts, _hashes(t, min_chars)) if h not in gone]
                    lost = len(parts) - len(kept)
                    t = b"\n".join(kept)
                n_dropped.append(lost)
                digest.append(hashlib.sha256(t).hexdigest())
                kept_text.append(t.decode() if with_text else None)
            rest = [b.column(c) for c in b.schema.names if c not in ("text", "drops")]
            names = [c for c in b.schema.names if c not in ("text", "drops")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
                [*names, "n_lines", "n_dropped", "kept_sha256", "kept_text"],
            )

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256, kept_text (null unless with_text), and, if `carry` names
    columns of docs, the struct `carried` of them; their names may be any.

    Null and empty texts are one empty line. Rows that repeat a doc_id count as one document and each lose the lines that
    this document loses; rows without a doc_id likewise count as one document, which keeps a key only if no other holds
    it. Lines below min_chars always stay. An empty table gives no rows; columns not in `carry` are not read.
    """
    base = doc_text(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    drops = materialize(dropped_keys(base.withColumn("th", F.xxhash64("text")), min_chars, min_docs))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), *more)
    extra = ["carried"] if carry else []
    result = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text", *extra]
    touched = bloom(drops, F.struct("doc_id", "th"))(F.struct("doc_id", "th"))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    same = whole.filter(~touched).select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if with_text else F.lit(None).cast("string")).alias("kept_text"), *extra)
    some = whole.filter(touched)
    joined = some.join(drops, some["doc_id"].eqNullSafe(drops["doc_id"]) & (some["th"] == drops["th"]), "left").select(some["doc_id"], *extra, "text", "drops")
    schema = T.StructType([f for f in whole.schema.fields if f.name in ("doc_id", "carried")]).add("n_lines", T.LongType()).add("n_dropped", T.LongType()).add("kept_sha256", T.StringType()).add("kept_text", T.StringType())
    out = joined.mapInArrow(_rebuild(min_chars, with_text), schema)
    return same.select(*result).unionByName(out.select(*result))
