import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftfacts.llm.mixing import AXES, POWERS, ROOM, mix, reached
from weftfacts.llm.sharding import shard_rows, write_shards

RNG = random.Random(4)
ROWS = [(i, "the same text" if i % 3 == 0 else "".join(RNG.choices("abc é", k=RNG.randint(0, 400))), "x", RNG.choice(["de", "en", None])) for i in range(900)]
ROWS += [(5, "twice", "x", "en"), (5, "twice", "x", "en"), (None, None, None, None), (None, "", None, "en"), (2000, "é" * 3000, "x", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").withColumns({"slot": F.lit("c"), "h": F.lit(1)}).repartition(4).cache()


def test_shards_are_even_gapless_and_whole(docs):
    got = shard_rows(docs, shards=7, part_rows=20).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    largest, by = max(r["size"] for r in got), {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(7))
    mean = sum(r["size"] for r in got) / 7
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    assert all(abs(sum(r["size"] for r in rs) - mean) <= largest + 0.002 * mean for rs in by.values())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    assert shard_rows(docs.limit(0), shards=7).collect() == []


def test_written_shards_hold_the_texts(docs, tmp_path):
    out = write_shards(docs, str(tmp_path / "out"), shards=3)
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(t) for _, t, *_ in ROWS)


def test_more_shards_than_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r["slot"] for r in shard_rows(df, shards=40).collect()) in ([0, 0], [0, 1])


def brute_order(rows):
    """Rows by signed XXH64 of the text (seed 42), then doc_id, as the law says."""
    h = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if x >> 63 else 0)
    return sorted((h(t or ""), -(1 << 63) if i is None else i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)


def test_shards_are_the_sorted_rows_cut_at_the_nearest_rows(docs):
    want = brute_order(ROWS)
    for shards, tolerance in ((7, 0.001), (13, 0.0)):
        got = sorted(shard_rows(docs, shards=shards, tolerance=tolerance, part_rows=50).collect(), key=lambda r: (r["shard"], r["slot"]))
        assert [(-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["text_crc32"]) for r in got] == [w[1:] for w in want]
        # No cut between two neighbouring rows is nearer to a boundary's target, but for the tolerance.
        below = np.concatenate(([0], np.cumsum([r["size"] for r in got])))
        for i in range(1, shards):
            at = sum(r["shard"] < i for r in got)
            target = below[-1] * i / shards
            assert abs(below[at] - target) <= max(np.abs(below - target).min(), tolerance * below[-1] / shards) + 1e-6


def brute_rake(cells, powers, budget):
    """Plain coordinate scaling of every cell's probability, one axis value after another, by bisection."""
    total = sum(cells.values())
    goals = []
    for k, a in enumerate(AXES):
        by = {}
        for c, n in cells.items():
            by[c[k]] = by.get(c[k], 0) + n
        whole = sum(n ** powers[a] for n in by.values())
        goals.append({v: n ** powers[a] / whole for v, n in by.items()})
        budget = min(budget, ROOM * min(n / total / goals[k][v] for v, n in by.items()))
    r = dict.fromkeys(cells, 1.0)
    for _ in range(300):
        for k, goal in enumerate(goals):
            for v, share in goal.items():
                own = [c for c in cells if c[k] == v]
                lo, hi = -60.0, 60.0
                for _ in range(80):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if sum(min(1, r[c] * math.exp(mid)) * cells[c] for c in own) < share * budget * total else (lo, mid)
                for c in own:
                    r[c] *= math.exp(hi)
    return {c: min(1, x) for c, x in r.items()}, goals


@pytest.mark.parametrize("budget", [0.2, 0.9])
def test_mix_against_plain_scaling(spark, budget):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((i, " ".join(["w"] * rng.choice([20, 60, 400])), source, rng.choice(["en", "en", "de", None])))
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), budget=budget).cache()
    cells, own = {}, {}
    for r in got.collect():
        c = tuple(r[a] for a in AXES)
        cells[c] = cells.get(c, 0) + r["tokens"]
        assert own.setdefault(c, r["probability"]) == r["probability"]
    want, goals = brute_rake(cells, POWERS, budget)
    assert budget < 0.5 or max(want.values()) == 1
    for k in range(3):  # the brute force itself converged
        for v, share in goals[k].items():
            kept = sum(want[c] * n for c, n in cells.items())
            assert abs(sum(want[c] * n for c, n in cells.items() if c[k] == v) / kept - share) < 1e-5
    assert all(abs(own[c] - want[c]) < 1e-4 for c in cells)
    for r in reached(got).collect():
        assert abs(r["target"] - r["expected"]) < 1e-5


def test_mix(docs):
    got = mix(docs, budget=0.6).collect()
    assert len(got) == len(ROWS)
    assert len({(r["probability"], r["kept"]) for r in got if r["doc_id"] == 5 and r["tokens"] == 1}) == 1
    assert all(r["kept"] for r in got if r["tokens"] == 0 and r["source"] is None and r["topic"] == "none") and mix(docs.limit(0)).collect() == []
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_mix_on_both_sides_of_the_bound_is_the_same(docs):
    key = lambda r: (r["doc_id"] or -1, r["tokens"], str(r["lang"]), str(r["source"]))
    a, b = mix(docs).collect(), mix(docs, max_cells=0).collect()
    assert sorted((*key(r), r["kept"]) for r in a) == sorted((*key(r), r["kept"]) for r in b)
    a, b = {key(r): r["probability"] for r in a}, {key(r): r["probability"] for r in b}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-7 for k in a)
