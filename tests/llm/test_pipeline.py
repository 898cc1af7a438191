"""Each stage against what its operator says row by row, and against brute force where that is simple."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from weftfacts.llm.mixing import mix  # noqa: E402
from weftfacts.llm.piece_sampling import decode  # noqa: E402
from weftfacts.llm.quality_rules import text_stats  # noqa: E402
from weftfacts.llm.queries import PIECE_BPE  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgo", k=rng.randint(2, 8))) for _ in range(500)]
    shared = "This line of some length is shared by many documents."
    texts = []
    for i in range(150):
        t = "\n".join(" ".join(rng.choices(words, k=25)) for _ in range(8))
        texts.append(t + (f"\n{shared}" if i % 4 == 0 else ""))
    for i in range(20):
        texts.append("tail " + texts[i])  # near copies
    texts += [None, "", "too short", "same three words " * 60]
    # Symbols behind every word: the base rules pass it, the distance from its group rejects it.
    texts.append("\n".join(" ".join(w + "#$%&" for w in line.split()) for line in texts[30].split("\n")))
    rows = [(i, t, ["en", "de", None][i % 3], "hot" if i % 2 else "cold", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "hot", 5)]
    path = str(tmp_path_factory.mktemp("sf") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return path.rsplit("/", 1)[0]


def test_stages(spark, docs):
    now = spark.read.parquet(f"{docs}/documents.parquet")
    before = {r["doc_id"]: r for r in now.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, docs).cache()
        seen.append((name, now, out))
        now = out
    assert all(out.columns == COLUMNS for _, _, out in seen[:-1])
    # Quality rules: what fails a base rule is gone, the rest of these texts is clean and stays.
    q = {r["doc_id"] for r in seen[0][2].collect()}
    bad = {i for i, r in before.items() if (s := text_stats((r["text"] or "").encode()))[0] < 50 or 100 * s[4] > 50 * s[0]}
    odd = max(before)
    assert odd not in bad and q == set(before) - bad - {odd}
    # Line dedup: the shared line stays in its last document only, and no other line goes but repeated ones.
    lines = seen[1][2].collect()
    assert len(lines) == seen[1][1].count()
    assert max(i for i in q if "shared by many" in before[i]["text"]) == next(r["doc_id"] for r in lines if "shared by many" in r["text"])
    assert sum("shared by many" in r["text"] for r in lines) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    # Near duplicates: one of each pair of copies, one of the repeated row.
    kept = sorted(r["doc_id"] for r in seen[2][2].collect())
    assert len(kept) == len(set(kept)) and set(range(20, 150)) <= set(kept)
    assert all(k in kept for k in range(20))
    # Mixing: just the rows that mix() keeps.
    want = sorted(r["doc_id"] for r in mix(seen[2][2], budget=corpus_pipeline.BUDGET, powers=corpus_pipeline.POWERS).collect() if r["kept"])
    assert sorted(r["doc_id"] for r in seen[3][2].collect()) == want and 0 < len(want) < len(kept)
    # Encoding: lossless.
    final = seen[4][2]
    assert all(r["lossless"] for r in final.collect())
    texts = {r["doc_id"]: r["text"] for r in decode(final, PIECE_BPE).collect()}
    assert texts == {r["doc_id"]: r["text"] for r in seen[3][2].collect()}


def test_verdicts_are_of_rows_and_not_of_ids(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefgo", k=rng.randint(2, 8))) for _ in range(120)) for _ in range(7)]
    clean = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3])]
    rows = clean + [(None, "short"), (1, "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars").repartition(2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = corpus_pipeline.quality(spark, df, "")
    assert got.columns == COLUMNS and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(clean, key=key)
    # Groups: an id beside none, only rows without an id, and one id on two texts.
    rows = [(7, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (None, texts[4]), (9, texts[5]), (8, texts[5]), (8, texts[5])]
    want = [(7, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (None, texts[4]), (8, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars").repartition(2)
    got = corpus_pipeline.near(spark, df, "")
    assert got.columns == COLUMNS and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_other_columns_ride_along(spark):
    rng = random.Random(10)
    texts = [" ".join("".join(rng.choices("abcdefgo", k=rng.randint(2, 8))) for _ in range(120)) for _ in range(6)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, [i], {"k": i}, "r") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, drops array<long>, `a.b` map<string,long>, _row string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        assert all(r["drops"] == [r["doc_id"]] and r["a.b"] == {"k": r["doc_id"]} for r in out.collect()), name


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
