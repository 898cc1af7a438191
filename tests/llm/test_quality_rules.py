import random

import numpy as np

from weftfacts.llm.quality_rules import _PAIRS, D, FIXED, FLOOR, chi2_quantile, mcd, quality_rules, text_stats

WS = " \t\n\r\x0b\x0c"


def brute(t):
    words = [w for w in "".join(" " if c in WS else c for c in t).split(" ") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if x.strip(WS):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_base_statistics():
    rng = random.Random(0)
    for _ in range(200):
        t = "".join(rng.choices(["a", "b c", "é", " ", "\n", "#", "|", "the", "\x0b", " "], k=rng.randint(0, 60)))
        assert text_stats(t.encode())[:5] == brute(t)


def make(rng, n, junk):
    words = ["w" + "".join(rng.choices("aeiou", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choices(words, k=rng.randint(80, 300)))
        if i in junk:
            t = " ".join(w + "#$%&" * 6 for w in t.split())
        rows.append((i, t, "en" if i % 3 else None, "hot", "kept"))
    return rows


def test_outliers_are_rejected_and_clean_rows_stay(spark):
    rng, junk = random.Random(1), set(range(0, 60, 3))
    rows = make(rng, 700, junk) + [(None, None, None, None, "x"), (900, "", "en", "hot", "x"), (901, "same three words " * 40, "en", "hot", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base = brute(t or "") if i in (None, 900, 901, 5) else None
        if base:
            assert tuple(got[i][1:6]) == base
    assert {i for i, r in got.items() if i is not None and i < 700 and not r["kept"]} == junk
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (None, 900, 901))
    assert quality_rules(df.limit(0)).collect() == []


KINDS = {
    "capitals": str.upper, "symbols": lambda t: " ".join(w + "#" for w in t.split()), "lines": lambda t: "\n".join(t.split()),
    "repeats": lambda t: " ".join(t.split()[:60]) + " one same line" * 12, "glued": lambda t: " ".join("".join(t.split()[i : i + 4]) for i in range(0, 300, 4)),
}


def test_outliers_of_several_kinds(spark):
    rng = random.Random(3)
    words = ["w" + "".join(rng.choices("aeiou", k=rng.randint(2, 8))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(200, 400)))) for i in range(600)]
    for i, kind in enumerate(list(KINDS) * 12):
        rows.append((1000 + i, KINDS[kind](" ".join(rng.choices(words, k=300)))))
    df = spark.createDataFrame([(i, t, "en", "hot") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules(df).collect()}
    assert {kind: sum(got[1000 + i] for i in range(k, 60, len(KINDS))) for k, kind in enumerate(KINDS)} == dict.fromkeys(KINDS, 0)
    assert all(got[i] for i in range(600))


def test_small_groups_are_measured_by_all_rows_of_their_pool(spark):
    rng, junk = random.Random(4), {7, 21, 35}
    rows = [(1000 + i, t, "en", "hot") for i, t, *_ in make(rng, 300, set())]
    rows += [(i, t, "en", "rare") for i, t, *_ in make(rng, 30, junk)]
    rows += [(100 + i, t, None, "rare") for i, t, *_ in make(rng, 40, junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if not r["kept"]} == {7, 21, 107, 121, 135}


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, D)) * 0.5 + 3
    x[:600] += 20
    df = spark.createDataFrame([("g", i, *map(int, np.round(r * FIXED))) for i, r in enumerate(x)], "g string, doc_id long, " + ", ".join(f"x{i} long" for i in range(D)))
    p = mcd(df).first()
    assert p["n"] == 4000
    assert all(abs(p["m"][i] - 3) < 0.1 for i in range(D))
    assert all(1 / 0.5**2 * 0.4 < p["p"][_PAIRS.index((i, i))] < 1 / 0.5**2 * 1.3 for i in (1, 2, 3, 4, 6, 7))


def test_subset_is_the_one_of_all_with_the_lowest_determinant(spark):
    from itertools import combinations

    rng = np.random.default_rng(5)
    for trial in range(2):
        x = rng.normal(size=(12, D)) * 0.3
        x[:3] += np.array([6.0, -4.0, 3.0, 0, 0, 5.0, 0, 2.0])  # three rows that mask each other
        x = np.round(x * FIXED)
        best = min((tuple(sorted(c)) for c in combinations(range(12), 9)), key=lambda c: np.linalg.slogdet(np.cov(x[list(c)].T / FIXED, bias=True) + np.diag(FLOOR**2))[1])
        df = spark.createDataFrame([("g", i, *map(int, r)) for i, r in enumerate(x)], "g string, doc_id long, " + ", ".join(f"x{i} long" for i in range(D)))
        p = mcd(df).first()
        assert best == tuple(range(3, 12))
        assert np.allclose(p["m"], x[list(best)].mean(0) / FIXED)


def test_groups_of_every_size_are_measured(spark):
    # A group of one clean row stays, one of one absurd row goes, wherever the rest of the table lies.
    rng = random.Random(12)
    rows = [(i, t, "en", "hot") for i, t, *_ in make(rng, 300, set())]
    rows += [(1000, make(rng, 1, set())[0][1], "en", "one"), (1001, make(rng, 1, {0})[0][1], "en", "two"), (1002, make(rng, 1, set())[0][1], "xx", "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality_rules(df).collect() if not r["kept"]} == {1001}
    assert [r["kept"] for r in quality_rules(df.filter("doc_id = 1000")).collect()] == [True]


def test_chi2():
    assert abs(chi2_quantile(0.95, 7) - 14.067) < 1e-3 and D == 8
