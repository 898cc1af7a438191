"""Sharding by histogram sort: exact byte ranks of probe keys, refined until the splitters are close enough, one exchange.

Rows are ordered by (hash of the text, doc_id, row), so equal texts are neighbours and a group of copies of any size can
still be cut between two of its rows. Each round counts, over all partitions, the exact bytes and rows below every probe
key, and takes one key of each open interval from each batch as candidates of the next round. When every boundary has a
probe within tolerance of its target, or no row lies between, rows are exchanged once. Probes counted on the way cut a large
shard into parts, whose exact row ranks let many tasks number one shard's slots without gaps.

Cost: one pass over the texts writes (key, size, crc); each round scans the narrow table; one exchange of its rows. Only
sums per probe interval and at most SAMPLE candidate keys an interval reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, materialize

#: Candidate keys an open interval sends to the driver in a round, about; probes an open interval gets.
SAMPLE, PROBES = 2048, 48
#: Rows of a part within a shard above which probes cut it.
PART_ROWS = 1 << 21
_SIGN = np.uint64(1 << 63)
_LEAST = -(1 << 63)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The sort key of each row as 24 bytes that order as (h, d, row) do."""
    cols = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN for c in ("h", "d", "row")]
    return np.stack(cols, 1).astype(">u8").view("S24").ravel()


def _pad(keys: list[bytes]) -> np.ndarray:
    return np.array(keys, "S24")


def _round(probes: np.ndarray, open_: np.ndarray, share: float, take: int):
    """Per batch: bytes and rows of each probe interval, and up to `take` keys of each open one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(17)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, size = _keys(batch), batch.column("size").to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, size = keys[order], size[order]
            at = np.searchsorted(probes, keys, side="right")
            first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
            which, ends = at[first], np.concatenate((first[1:], [len(at)]))
            picked = []
            for k, a, z in zip(which.tolist(), first.tolist(), ends.tolist()):
                some = rng.integers(a, z, min(take, z - a)).tolist() if open_[k] and rng.random() < share else []
                if open_[k] and share >= 1:
                    # A key above the interval's own edge, if there is one: the search then ends, whatever the keys.
                    some.append(min(a + (z - a) // 2 + (keys[a + (z - a) // 2] == (probes[k - 1] if k else b"")), z - 1))
                picked.append([keys[i].ljust(24, b"\0") for i in some])
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.add.reduceat(size, first)), pa.array(ends - first, pa.int64()), pa.array(picked, pa.list_(pa.binary()))], ["at", "bytes", "rows", "keys"])

    return run


def _open(counted: dict[bytes, tuple[int, int]], total: tuple[int, int], shards: int, tolerance: float) -> dict[int, list[float]]:
    """By the interval of counted keys that holds them: the boundary targets to which no counted key is close enough."""
    ordered = sorted(counted)
    below = np.array([*(counted[k][0] for k in ordered), total[0]])
    rows = np.array([*(counted[k][1] for k in ordered), total[1]])
    out: dict[int, list[float]] = {}
    for i in range(1, shards):
        t = total[0] * i / shards
        k = int(np.searchsorted(below, t))
        low_bytes, low_rows = (int(below[k - 1]), int(rows[k - 1])) if k else (0, 0)
        if min(below[k] - t, t - low_bytes) > tolerance * total[0] / shards and rows[k] - low_rows > 1:
            out.setdefault(k, []).append(t)
    return out


def find_splitters(narrow: DataFrame, shards: int, tolerance: float) -> tuple[list[bytes], dict[bytes, tuple[int, int]], tuple[int, int]]:
    """(the shards - 1 boundary keys, every counted key with its exact (bytes, rows) below, (bytes, rows) in all).

    A row belongs below a boundary when its key is smaller. narrow: h, d, row, size; no two rows share all three.
    The search ends: a round that finds no new key for an interval takes one from every batch the next time, and an open
    interval always holds a key above its edge, so that each round but those narrows every open interval.
    """
    counted: dict[bytes, tuple[int, int]] = {}
    fresh: set[bytes] = set()
    spans: list[tuple[bytes, bytes]] = [(b"", _END)]  # where candidates are wanted
    total, batches, sparse = (0, 0), 1, False
    while True:
        ordered = sorted({*counted, *fresh})
        edges = [b"", *ordered, _END]
        open_ = np.array([any(lo <= a and z <= hi for lo, hi in spans) for a, z in zip(edges, edges[1:])])
        many = max(1, int(open_.sum()) // len(spans)) if spans else 1
        share, take = 1.0 if sparse else min(1.0, SAMPLE / (batches * many)), max(1, min(64, SAMPLE // (batches * many)))
        out = narrow.select("h", "d", "row", "size").mapInArrow(_round(_pad(ordered), open_, share, take), "at int, bytes long, rows long, keys array<binary>")
        found = {r["at"]: r for r in out.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("keys")).alias("keys")).collect()}
        low_b = low_r = 0
        for k in range(len(edges) - 1):
            if k:
                counted[edges[k]] = (low_b, low_r)
            low_b, low_r = (low_b + found[k]["bytes"], low_r + found[k]["rows"]) if k in found else (low_b, low_r)
        total = (low_b, low_r)
        batches = max([1, *(r["n"] for r in found.values())])
        if not low_r:
            break
        wanted = _open(counted, total, shards, tolerance)
        if not wanted:
            break
        # `edges` are now all counted; interval k of them lies between edges[k] and edges[k + 1].
        fresh, spans, sparse = set(), [], False
        for k, goals in wanted.items():
            spans.append((edges[k], edges[k + 1]))
            keys = sorted(set(found[k]["keys"]) - {edges[k]}) if k in found else []
            if not keys:
                sparse = True
                continue
            low = counted[edges[k]][0] if k else 0
            high = counted[edges[k + 1]][0] if k + 1 < len(edges) - 1 else total[0]
            # Candidates lie evenly by rows, nearly so by bytes: those around the goals, and an even spread besides.
            at = np.linspace(0, len(keys) - 1, 16).tolist()
            for t in goals:
                mid, reach = (t - low) / max(1, high - low) * (len(keys) - 1), max(2.0, 2 * len(keys) ** 0.5)
                at += np.linspace(mid - reach, mid + reach, PROBES - 16).tolist()
            fresh |= {keys[int(min(max(round(x), 0), len(keys) - 1))] for x in at}
    ordered = sorted(counted)
    bounds = [min(ordered, key=lambda k: abs(counted[k][0] - total[0] * i / shards)) if ordered else _END for i in range(1, shards)]
    return bounds, counted, total


_END = b"\xff" * 24


def shard_rows(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: tuple[str, ...] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns in `carry`.

    size is the text's UTF-8 bytes (null: none) plus `overhead`. Law `bytes`: the shards' sizes differ from the mean by at
    most `tolerance` of it or one row's size, whichever is more. Slots count from 0 without gaps in each shard. grown_shard
    is null under this law. Equal texts are neighbours; a group is cut only where a boundary falls inside it. Repeated rows
    and rows without a doc_id are rows like any other. An empty table gives no rows. `carry` names columns of docs (the
    text, say) that ride through the single exchange; it may not name a column above.
    """
    cols = {c: docs[c] for c in carry}
    if set(carry) & {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}:
        raise ValueError("carried columns clash with the result's")
    doc_text(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)  # ships the package
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("d"), F.monotonically_increasing_id().alias("row"),
        *[c.alias(f"c_{k}") for k, c in cols.items()],
    )
    base = materialize(base)
    bounds, known, total = find_splitters(base, shards, tolerance)
    # Within a shard, counted probes cut parts of about part_rows rows.
    starts = [(b"", 0), *[(b, i + 1) for i, b in enumerate(bounds)]]
    cuts: list[tuple[bytes, int, int]] = []
    ordered = sorted(known)
    for (key, shard), (stop, _) in zip(starts, [*starts[1:], (_END, 0)]):
        base_rows = known[key][1] if key in known else 0
        cuts.append((key, shard, 0))
        last = base_rows
        for k in ordered:
            if key < k < stop and known[k][1] - last >= part_rows:
                cuts.append((k, shard, known[k][1] - base_rows))
                last = known[k][1]
    edges = _pad([k for k, _, _ in cuts[1:]])
    part_shard, part_slot = np.array([s for _, s, _ in cuts], np.int32), np.array([o for _, _, o in cuts], np.int64)
    fields = base.schema.fields
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields if f.name.startswith("c_"))
    keyed = "doc_id long, size long, text_crc32 long, h long, d long, row long" + carried

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(edges, _keys(batch), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = -1, 0
        for batch in batches:
            part = batch.column("part").to_numpy()
            slot = np.empty(len(part), np.int64)
            first = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1)) if len(part) else []
            for a, z in zip(first, [*first[1:], len(part)]):
                if part[a] != current:
                    current, seen = part[a], 0
                slot[a:z] = part_slot[current] + seen + np.arange(z - a)
                seen += z - a
            keep = [c for c in batch.schema.names if c.startswith("c_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", *keep)), pa.array(part_shard[part]), pa.array(slot)], ["doc_id", "size", "text_crc32", *keep, "shard", "slot"])

    placed = base.mapInArrow(place, keyed + ", part int")
    placed = placed.repartition(min(len(cuts), 20_000), "part").sortWithinPartitions("part", "h", "d", "row")
    out = placed.mapInArrow(number, "doc_id long, size long, text_crc32 long" + carried + ", shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"c_{c}").alias(c) for c in carry])


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the texts as Parquet under shard=N folders, in slot order within each file, and return what was written."""
    out = shard_rows(docs, carry=("text",), **options)
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
