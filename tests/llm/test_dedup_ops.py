"""Exact dedup, SimHash and line dedup against brute force on small tables."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from weftfacts.llm import exact_dedup as ed
from weftfacts.llm.common import bloom, without
from weftfacts.llm.components import components
from weftfacts.llm.line_dedup import line_dedup
from weftfacts.llm.simhash import fingerprints, near_duplicates, near_links, plan_blocks

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma", "Ünit", "delta", "x", "\t", "eps"]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(25)]
    lines = ["A line that many documents share, é", "  a LINE that many documents share, é\t", "short", "another shared line of twenty"]
    out = [None, "", "", " \n ", "word", "WORD", "x" * 300_000, "long text " * 3000]
    for i in range(120):
        t = rng.choice(base)
        if rng.random() < 0.4:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "zeta"
            t = " ".join(w)
        out.append(t + "".join("\n" + rng.choice(lines) for _ in range(rng.randint(0, 3))))
    return [(i, t, "x", 0) for i, t in enumerate(out)] + [(7, "long text " * 3000, "again", 1), (None, "no id at all, but this line is long", "y", 2), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, salt string, fp int").repartition(3).cache()


def key(r):
    return tuple((x is not None, x) for x in r)


def test_exact_dedup(docs, rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    want = []
    for i, t, *_ in rows:
        n = (t or "").translate(LOW)
        keep = max((x for x in groups[n] if x is not None), default=None)
        want.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    for huge, hot, chunk in ((ed.HUGE, ed.HOT, ed.CHUNK), (5000, 2, 64)):
        got = [tuple(r) for r in ed.exact_dedup(docs, huge=huge, hot=hot, chunk=chunk).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert ed.exact_dedup(docs.limit(0)).collect() == []


def test_fingerprints_compose_and_collisions_are_told_apart(spark, monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(5000))
    for cut in (0, 1, 777, 5000):
        assert ed.combine(ed.chunk_hash(data[:cut]), ed.chunk_hash(data[cut:]), 5000 - cut) == ed.fingerprint(data, 64)
    run = ed._classes(["fp", "pos"], ["doc_id"], ed.pa.schema([("doc_id", ed.pa.int64()), ("cls", ed.pa.int32()), ("part", ed.pa.binary())]))
    first = ed.pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "fp": [b"a"] * 3, "pos": [0] * 3, "part": [b"x", b"y", b"x"]})
    then = ed.pa.RecordBatch.from_pydict({"doc_id": [4, 5], "fp": [b"a"] * 2, "pos": [0, 1], "part": [b"y", b"y"]})
    assert [c for b in run(iter([first, then])) for c in b.column("cls").to_pylist()] == [0, 1, 0, 1, 0]


def test_bloom_passes_every_key(spark):
    keys = spark.range(0, 5000, 7)
    test = bloom(keys, F.col("id"))
    assert spark.range(5000).filter(test(F.col("id")) & (F.col("id") % 7 == 0)).count() == 715
    assert spark.range(5000).filter(test(F.col("id"))).count() < 1000
    assert spark.range(10).filter(bloom(keys.limit(0), F.col("id"))(F.col("id"))).count() == 0
    assert spark.range(10).filter(bloom(keys, F.col("id"), max_words=16)(F.col("id"))).count() == 10
    assert without(spark.range(100), keys, "id").count() == 85


def test_line_dedup_of_rows_without_an_id(spark):
    shared, own = "a line of more than twenty characters", "another line that only this row holds"
    rows = [(None, shared), (None, f"{shared}\n{own}"), (1, shared), (2, f"x\n{shared}"), (2, own), (None, None)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["kept_text"]) for r in got) == [(0, ""), (0, ""), (0, own), (1, ""), (2, own), (2, f"x\n{shared}")]


def test_line_dedup_carries_clashing_columns(spark):
    df = spark.createDataFrame([(1, "t", "a", [1])], "doc_id long, text string, n_lines string, drops array<int>")
    r = line_dedup(df, carry=("n_lines", "drops", "text")).first()
    assert (r["n_lines"], r["carried"]["n_lines"], r["carried"]["drops"], r["carried"]["text"]) == (1, "a", [1], "t")


def simhash(text):
    words = [w for w in "".join(" " if c in WS else c for c in text.translate(LOW)).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, fps, radius=4):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [0] * n
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                near[i] += 1
                near[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return near, [low.get(find(i)) for i in range(n)]


def test_near_duplicates(docs, rows):
    fps = [simhash(t or "") for _, t, *_ in rows]
    near, comp = brute([r[0] for r in rows], fps)
    want = [(i, f"{f:016x}", n, c) for (i, *_), f, n, c in zip(rows, fps, near, comp)]
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert near_duplicates(docs.limit(0)).collect() == []
    assert sum(near) > 30


@pytest.mark.parametrize("blocks,cell_rows", [(5, 2048), (6, 8), (9, 2048)])
def test_grid_finds_every_pair_once(spark, blocks, cell_rows):
    rng = random.Random(blocks)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(15):
            fps.add(x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5))) & (2**64 - 1))
    fps = sorted(f & (2**64 - 1) for f in fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, 1) for f in signed], "fp long, w long")
    out = near_links(df, 4, blocks, cell_rows).collect()
    near, comp = brute(list(range(len(fps))), fps)
    got = Counter()
    for r in out:
        got[r["fp"]] += r["near"]
    assert [got[s] for s in signed] == near
    edges = [(r["fp"], r["other"]) for r in out if r["other"] is not None]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    classes, want = {}, {}
    for s, c in zip(signed, comp):
        classes.setdefault(roots.get(s, s), set()).add(s)
        want.setdefault(c, set()).add(s)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_plan_grows_with_the_number_of_fingerprints():
    assert plan_blocks(1000, 4) <= plan_blocks(10**6, 4) <= plan_blocks(10**9, 4)


def test_fingerprint_column(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in fingerprints(df).collect()} == {1: simhash("a b c d e"), 2: 0}


def test_line_dedup(docs, rows):
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            k = x.strip(WS).translate(LOW)
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    want = []
    for i, t, *_ in rows:
        parts, kept = (t or "").split("\n"), []
        for x in parts:
            own = holders.get(x.strip(WS).translate(LOW), ())
            if len(own) >= 3 and i != max(o for o in own if o is not None):
                continue
            kept.append(x)
        want.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 50
    assert line_dedup(docs.limit(0)).collect() == []
