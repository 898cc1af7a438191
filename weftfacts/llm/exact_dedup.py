"""Exact dedup by composable polynomial fingerprints, confirmed by chunkwise comparison.

A text's fingerprint is its bytes read as a polynomial in 256 modulo a 126-bit prime. Fingerprints of neighbouring
chunks combine by arithmetic alone, H(a+b) = H(a) * 256^len(b) + H(b), so a huge document is hashed as many chunks on
many tasks. Documents of equal fingerprint are then compared byte by byte, chunk by chunk; a collision splits them.

Cost: one narrow shuffle of all fingerprints. Texts move only where their fingerprint repeats: a Bloom filter of bounded size
holds the others back, and what moves are chunks of CHUNK bytes, keyed by fingerprint and position, so that no task holds a
whole huge document. Fingerprints of over `hot` rows are spread over HOT_SALTS tasks, whose representatives are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bloom, doc_text, lower_az, map_text, materialize, replicated, salt, text_bytes

#: A prime of 126 bits with no special form, so that powers of 256 have a long period.
PRIME = 0x2B3F_9D6C_51E8_A74F_93D1_6EB5_0C27_8BA1
CHUNK = 1 << 16
#: Documents above this many bytes are cut and hashed over many tasks.
HUGE = 64 << 20
#: Rows of one fingerprint above which its comparison is spread, and over how many tasks.
HOT, HOT_SALTS = 10_000, 512
NARROW = "doc_id long, fp binary, x long, text_sha256 string"


def _is_prime(n: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


while not _is_prime(PRIME):
    PRIME += 2


def chunk_hash(data: bytes) -> int:
    return int.from_bytes(data, "big") % PRIME


def combine(left: int, right: int, right_len: int) -> int:
    """The fingerprint of a concatenation from those of its halves."""
    return (left * pow(256, right_len, PRIME) + right) % PRIME


def fingerprint(data: bytes, chunk: int = CHUNK) -> int:
    h = 0
    for i in range(0, len(data), chunk):
        part = data[i : i + chunk]
        h = combine(h, chunk_hash(part), len(part))
    return h


def _pack(h: int, n: int) -> bytes:
    """16 bytes of fingerprint and 6 of length: leading zero bytes don't change a polynomial, the length does."""
    return h.to_bytes(16, "big") + n.to_bytes(6, "big")


def _marked(piece: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    texts = [t.translate(LOWER) for t in text_bytes(piece.column("text"))]
    columns = [piece.column("doc_id"), pa.array([_pack(fingerprint(t), len(t)) for t in texts], pa.binary()), piece.column("x"), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
    names = ["doc_id", "fp", "x", "text_sha256"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())] if with_text else columns, [*names, "norm"] if with_text else names)


def _fingerprints(piece: pa.RecordBatch) -> pa.RecordBatch:
    return _marked(piece, False)


def _with_text(piece: pa.RecordBatch) -> pa.RecordBatch:
    return _marked(piece, True)


def huge_fingerprints(docs: DataFrame, chunk: int = CHUNK * 64) -> DataFrame:
    """(doc_id, fp, x, text_sha256) of documents hashed as chunks on many tasks and put together by combine().

    docs: doc_id, text, x. The chunks of a document are bounded by its length over `chunk`; only their hashes are gathered.
    """
    cut = docs.select("doc_id", "x", F.monotonically_increasing_id().alias("row"), lower_az(F.col("text")).alias("t")).select(
        "doc_id", "row", F.struct("x", F.sha2("t", 256).alias("text_sha256")).alias("own"), F.col("t").cast("binary").alias("b")
    )
    cut = cut.withColumn("pos", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("b"), F.lit(1)) - 1) / chunk).cast("int"))))
    cut = cut.select("doc_id", "row", "own.x", "own.text_sha256", "pos", F.expr(f"substring(b, pos * {chunk} + 1, {chunk})").alias("part")).repartition("row", "pos")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("part").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "row", "x", "text_sha256", "pos")), pa.array([len(p) for p in parts], pa.int64()), pa.array([chunk_hash(p).to_bytes(16, "big") for p in parts], pa.binary())],
                ["doc_id", "row", "x", "text_sha256", "pos", "n", "h"],
            )

    hashed = cut.mapInArrow(hashes, "doc_id long, row long, x long, text_sha256 string, pos int, n long, h binary")
    grouped = hashed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("x").alias("x"), F.first("text_sha256").alias("text_sha256"), F.sort_array(F.collect_list(F.struct("pos", "n", "h"))).alias("parts"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for parts in b.column("parts").to_pylist():
                h = total = 0
                for p in parts:
                    h, total = combine(h, int.from_bytes(p["h"], "big"), p["n"]), total + p["n"]
                fps.append(_pack(h, total))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.binary()), b.column("x"), b.column("text_sha256")], ["doc_id", "fp", "x", "text_sha256"])

    return grouped.mapInArrow(join_up, NARROW)


def _classes(keys: list[str], carry: list[str], schema: pa.Schema):
    """Streams chunks sorted by `keys`; numbers the different ones within a run of equal keys. The first of each keeps its bytes.

    Memory: the different chunks of one run, which is one of CHUNK bytes unless fingerprints collide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, []
        for b in batches:
            parts, cls, kept = b.column("part").to_pylist(), [], []
            for part, key in zip(parts, zip(*(b.column(k).to_pylist() for k in keys))):
                if key != current:
                    current, seen = key, []
                k = next((k for k, other in enumerate(seen) if other == part), len(seen))
                if k == len(seen):
                    seen.append(part)
                    kept.append(part)
                else:
                    kept.append(None)
                cls.append(k)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(cls, pa.int32()), pa.array(kept, pa.binary())], schema=schema)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal texts the largest
    doc_id stays. Rows that repeat a doc_id count singly in group_size and share its verdict. A null doc_id never stays
    unless its whole group has none (then keep_id is null and kept is true for all of it). An empty table gives no rows;
    further columns are not read. `huge`, `hot` and `chunk` decide how work is spread and change no result.
    """
    # x only prepares the filter and sharpens the key: texts equal after lower-casing A-Z have equal x, whatever else has.
    base = doc_text(docs, id_col, text_col).withColumn("x", F.xxhash64(F.lower("text")))
    small = map_text(base.filter(F.octet_length("text") <= huge), _fingerprints, NARROW)
    large = huge_fingerprints(base.filter(F.octet_length("text") > huge))
    narrow = materialize(small.unionByName(large))
    dup = materialize(narrow.groupBy("fp", "x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    maybe, crowded = bloom(dup, F.col("x")), bloom(dup.filter(F.col("n") > hot), F.col("x"))

    alone = F.col("doc_id"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("text_sha256")
    apart = narrow.filter(~maybe(F.col("x"))).select(*alone)
    checked = narrow.filter(maybe(F.col("x"))).join(dup, ["fp", "x"], "left_anti").select(*alone)

    texts = map_text(base.filter(maybe(F.col("x"))), _with_text, NARROW + ", norm binary").withColumn("row", F.monotonically_increasing_id())
    texts = texts.withColumn("salt", F.when(crowded(F.col("x")), salt(F.col("row"), HOT_SALTS)).otherwise(F.lit(0)))
    last = F.floor((F.greatest(F.octet_length("norm"), F.lit(1)) - 1) / chunk).cast("int")
    own = F.when(F.col("pos") == 0, F.struct("doc_id", "text_sha256")).alias("own")
    parts = texts.withColumn("pos", F.explode(F.sequence(F.lit(0), last))).select("fp", "x", "pos", "salt", "row", own, F.expr(f"substring(norm, pos * {chunk} + 1, {chunk})").alias("part"))
    keys = ["fp", "x", "pos", "salt"]
    carried = pa.schema([("fp", pa.binary()), ("x", pa.int64()), ("pos", pa.int32()), ("salt", pa.int32()), ("row", pa.int64()), ("own", pa.struct([("doc_id", pa.int64()), ("text_sha256", pa.string())])), ("cls", pa.int32()), ("part", pa.binary())])
    parts = parts.repartition(*keys).sortWithinPartitions(*keys)
    compared = materialize(parts.mapInArrow(_classes(keys, [*keys, "row", "own"], carried), "fp binary, x long, pos int, salt int, row long, own struct<doc_id:long,text_sha256:string>, cls int, part binary"))
    # Of each slice one chunk a class is left; those of one hot fingerprint, HOT_SALTS at most unless it collides, are compared.
    firsts = compared.filter("part is not null").join(dup.filter(F.col("n") > hot).select("fp", "x"), ["fp", "x"]).select("fp", "x", "pos", "salt", F.col("cls").alias("own_cls"), "part")
    merged = pa.schema([("fp", pa.binary()), ("x", pa.int64()), ("pos", pa.int32()), ("salt", pa.int32()), ("own_cls", pa.int32()), ("cls", pa.int32()), ("part", pa.binary())])
    order = firsts.repartition("fp", "x", "pos").sortWithinPartitions("fp", "x", "pos", "salt", "own_cls")
    same = order.mapInArrow(_classes(["fp", "x", "pos"], [*keys, "own_cls"], merged), "fp binary, x long, pos int, salt int, own_cls int, cls int, part binary").drop("part").withColumnRenamed("cls", "joint")
    named = compared.drop("part").withColumnRenamed("cls", "own_cls").join(same, [*keys, "own_cls"], "left").withColumn("cls", F.coalesce("joint", "own_cls"))
    # A text's class is the list of its chunks' classes; only chunks of collided fingerprints have one other than 0.
    odd = F.to_json(F.sort_array(F.collect_list(F.when(F.col("cls") > 0, F.struct("pos", "cls"))))).alias("odd")
    rows = named.groupBy("fp", "x", "row").agg(odd, F.max("own").alias("own"), F.max("salt").alias("salt")).join(dup, ["fp", "x"], "left_semi")
    rows = materialize(rows.select("fp", "x", "odd", "own.doc_id", "own.text_sha256"))
    groups = replicated(rows.groupBy("fp", "x", "odd").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    copies = rows.withColumn("salt", salt(F.coalesce("doc_id", F.lit(0)))).join(groups, ["fp", "x", "odd", "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return apart.unionByName(checked).unionByName(copies)
