"""SimHash near-dedup by a segment-popcount embedding and a grid range-join.

A fingerprint's bits are cut into segments of two; the vector of their bit counts is its embedding. Manhattan distance
between embeddings never exceeds Hamming distance, so pairs within `radius` of each other are all found by a range-join on
the grid of embeddings. The axes fall into `blocks` blocks: a pair at Manhattan distance r at most differs in r blocks at
most, hence shares all coordinates of some blocks - r of them, and thus a cell of one of C(blocks, r) axis-aligned grids.
Within a cell the Manhattan distance of the embeddings is tested first, then the Hamming distance.

The number of blocks follows the counted number of different fingerprints by a model of cost: more blocks are more rows to
move, fewer are more comparisons (5 copies of a row at 10^5 fingerprints, 35 at 10^8, 210 at 10^10); every choice finds every
pair. Cells above CELL rows are cut into sub-blocks whose pairs are
compared by different tasks. A pair counts in the first grid that holds it. What leaves a task is a count per fingerprint
and a spanning forest of the links it saw, never all pairs. Equal fingerprints are one row with a weight throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, doc_text, map_text, materialize, popcount, text_bytes
from .components import components

SEED = 42
WIDTH = 4
#: Two-bit segments, and what a random segment's bit count tells, in bits.
_EVEN = 0x5555555555555555
_ENTROPY = 1.5
#: Rows of a cell above which it is cut.
CELL = 2048
#: Cost of moving a row through the exchange, in comparisons.
ROW_COST = 64


def fingerprint(text: bytes) -> int:
    """Majority bits over the XXH64 hashes of all 4-word shingles of an A-Z-lowered text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= WIDTH:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        begin = np.concatenate(([0], ends[: n - WIDTH])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begin, (ends[WIDTH - 1 :] - 1).tolist())]
    count = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for i in range(0, len(h), 1 << 14):  # few rows at once: the bits of a very long text take 64 bytes a shingle
        count += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * count > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(piece: pa.RecordBatch) -> pa.RecordBatch:
    fp = np.array([fingerprint(t) for t in text_bytes(piece.column("text"))], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for (doc_id, text); fp holds the unsigned fingerprint in a signed long."""
    return map_text(docs, _fingerprints, "doc_id long, fp long")


def embed(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in thermometer code (00, 01, 11): the population count of the
    exclusive or of two codes is the Manhattan distance of the vectors."""
    even = np.uint64(_EVEN)
    low, high = x & even, (x >> np.uint64(1)) & even
    return (low | high) | ((low & high) << np.uint64(1))


def _embed_column(c: Column) -> Column:
    low, high = c.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grids(blocks: int, radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """(bit mask of each block of axes, the blocks that each grid looks at)."""
    edge = [round(32 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edge, edge[1:])]
    return masks, list(combinations(range(blocks), blocks - radius))


def plan_blocks(n: int, radius: int) -> int:
    """The blocks at which n random fingerprints cost least: a row for each grid is written, sorted and read, and meets the
    others of its cell there. Every choice finds every pair."""
    if radius == 0:
        return 1

    def cost(blocks: int) -> float:
        cells = 2 ** (_ENTROPY * 32 * (blocks - radius) / blocks)
        return math.comb(blocks, radius) * (ROW_COST + n / cells)

    return min(range(radius + 1, 33), key=cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of the links that join different trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append(k)
    return kept


def _compare(blocks: int, radius: int):
    """Streams rows sorted by (cell, part) and compares those of equal cell; yields (fp, near, other).

    near: documents linked to fp in pairs that belong to this grid; other: a linked fingerprint that joins two trees of
    this batch of links, or null.
    """
    masks, looks = grids(blocks, radius)
    mask = np.array(masks, np.uint64)
    first = np.full(1 << blocks, len(looks), np.int64)  # by the set of equal blocks: the first grid inside it
    for g in range(len(looks) - 1, -1, -1):
        need = sum(1 << b for b in looks[g])
        have = np.arange(1 << blocks)
        first[(have & need) == need] = g

    def pairs(grid: np.ndarray, fp: np.ndarray, side: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray, found: list) -> None:
        ei, ej = embed(fp[i]), embed(fp[j])
        ok = (popcount(ei ^ ej) <= radius) & ((side[i] == 2) | (side[j] == 2) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        ok = popcount(fp[i] ^ fp[j]) <= radius
        i, j = i[ok], j[ok]
        if len(i):
            diff = embed(fp[i]) ^ embed(fp[j])
            equal = np.zeros(len(i), np.int64)
            for b in range(blocks):
                equal |= ((diff & mask[b]) == 0).astype(np.int64) << b
            ok = first[equal] == grid[i]
            i, j = i[ok], j[ok]
            if len(i):
                found.append((fp[i], fp[j], w[i], w[j]))

    def compare(cell: np.ndarray, part: np.ndarray, grid: np.ndarray, fp: np.ndarray, side: np.ndarray, w: np.ndarray) -> list:
        found: list = []
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
        run = np.cumsum(new)
        at = np.arange(len(cell))
        step = 1
        while True:
            at = at[at + step < len(cell)]
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            pairs(grid, fp, side, w, at, at + step, found)
            step += 1
        return found

    def emit(found: list) -> pa.RecordBatch:
        a, b, wa, wb = (np.concatenate(x) for x in zip(*found))
        fps, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        near = np.zeros(len(fps), np.int64)
        np.add.at(near, inverse[: len(a)], wb)
        np.add.at(near, inverse[len(a) :], wa)
        kept = _forest(a.view(np.int64), b.view(np.int64))
        left = np.concatenate([fps, a[kept]]).view(np.int64)
        count = np.concatenate([near, np.zeros(len(kept), np.int64)])
        other = pa.concat_arrays([pa.nulls(len(fps), pa.int64()), pa.array(b[kept].view(np.int64))])
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(count), other], ["fp", "near", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        found: list = []
        size = 0
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "grid", "fp", "side", "w")]
            now[3] = now[3].view(np.uint64)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:].copy() for x in now]
            if cut:
                found += compare(*(x[:cut] for x in now))
                size = sum(len(x[0]) for x in found)
            if size > 1 << 20:
                yield emit(found)
                found, size = [], 0
        if held is not None and len(held[0]):
            found += compare(*held)
        if found:
            yield emit(found)

    return run


def near_links(weighted: DataFrame, radius: int, blocks: int | None = None, cell_rows: int = CELL) -> DataFrame:
    """(fp, near, other) as _compare gives them, for distinct fingerprints (fp, w)."""
    if blocks is None:
        blocks = plan_blocks(weighted.count(), radius)
    masks, looks = grids(blocks, radius)
    code = weighted.withColumn("e", _embed_column(F.col("fp")))
    cells = F.array(*[F.struct(F.lit(g).alias("grid"), F.xxhash64(F.lit(g), F.col("e").bitwiseAND(F.lit(_signed(sum(masks[b] for b in look))))).alias("cell")) for g, look in enumerate(looks)])
    rows = code.select("fp", "w", F.explode(cells).alias("c")).select("fp", "w", "c.grid", "c.cell")
    # One exact count of the cells; only those above the bound are listed.
    sizes = materialize(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows))
    plain = ["cell", "part", "grid", "fp", "side", "w"]
    if sizes.isEmpty():
        cut = rows.select("cell", F.lit(0).alias("part"), "grid", "fp", F.lit(2).alias("side"), "w")
    else:
        # A cut cell's rows fall into k sub-blocks; each pair (p, q), p <= q, of them is one part, compared on its own.
        marked = rows.join(sizes, "cell", "left")
        k = F.ceil(F.coalesce("n", F.lit(1)) / cell_rows).cast("int")
        marked = marked.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int"))
        marked = marked.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        low, high = F.least("own", "mate"), F.greatest("own", "mate")
        side = F.when(low == high, F.lit(2)).when(F.col("own") == low, F.lit(0)).otherwise(F.lit(1))
        cut = marked.select("cell", (low * F.col("k") + high).alias("part"), "grid", "fp", side.alias("side"), "w")
    ordered = cut.select(*plain).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return ordered.mapInArrow(_compare(blocks, radius), "fp long, near long, other long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, blocks: int | None = None, cell_rows: int = CELL) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), n_near (other rows linked directly), component_id.

    Two rows link when their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id that links
    reach, the row's own included. Texts without a word, null and empty ones too, have fingerprint zero and link like any
    other. Repeated rows count each. Rows without a doc_id link too but give no component_id. An empty table gives no rows;
    further columns are not read.

    The rows meet their fingerprint's verdict in one join on fp; only (doc_id, fp) is moved, and AQE splits hot values.
    """
    base = materialize(fingerprints(doc_text(docs, id_col, text_col)))
    weighted = materialize(base.groupBy("fp").agg(F.count(F.lit(1)).alias("w"), F.min("doc_id").alias("low")))
    links = materialize(near_links(weighted.select("fp", "w"), radius, blocks, cell_rows))
    near = links.groupBy("fp").agg(F.sum("near").alias("near"))
    edges = links.filter("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    label = components(edges)
    known = weighted.join(near, "fp", "left").join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    verdict = materialize(known.join(lowest, "root").select("fp", (F.col("w") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id"))
    return base.join(verdict, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
