import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftfacts.llm.token_counts import counter, token_counts

PATH = "/opt/tokenizers/byte_bpe_50k.json"
POOL = ["a", "s", "t", "ll", "re", "ve", "'", "'", " ", " ", "\n", " ", "　", "1", ".", "é", "Z", "ß", "漢", "😀", "the", "tion", "<|endoftext|>", "\x1c"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["", " ", "'", "it's 'twas we'll", "x" * 5000, "  " * 3000] + ["".join(rng.choices(POOL, k=rng.randint(0, 40))) for _ in range(400)]


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(texts):
    assert counter(PATH).texts(texts).tolist() == library(texts)


def test_chunk_maps_compose_associatively(texts):
    c, rng = counter(PATH), random.Random(1)
    for t in texts[5:150]:
        t = t.replace("<|endoftext|>", "")
        if not t:
            continue
        cuts = sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(4))})
        maps = [c.chunk_map(t[a:b]) for a, b in zip(cuts, cuts[1:])]
        left = right = None
        for m in maps:
            left = m if left is None else c.compose(left, m)
        for m in reversed(maps):
            right = m if right is None else c.compose(m, right)
        assert c.finish(left) == c.finish(right) == int(c.texts([t])[0])


def test_operator_on_odd_rows_and_huge_documents(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, "clash"), (3, "twice", None), (3, "twice", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, library([t or "" for _, t, _ in rows])))
    for huge, cut in ((1 << 20, 1 << 20), (20, 19)):
        got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in token_counts(df, PATH, huge=huge, cut=cut).collect())
        assert got == want
    assert token_counts(df.limit(0), PATH).collect() == []


def test_single_pretokens_by_plain_merging():
    c, rng = counter(PATH), np.random.default_rng(0)
    for _ in range(300):
        data = bytes(rng.integers(97, 123, rng.integers(1, 20)).tolist())
        assert c.word(data.decode()) == len(c.bpe(data))


def test_states_of_one_long_pretoken_are_bounded(monkeypatch):
    from weftfacts.llm import token_counts as tc

    rng = random.Random(4)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    monkeypatch.setattr(tc, "MEMO", 500)
    c = tc.Counter(PATH)
    assert c.word(word) == library([word])[0] and len(c.states) <= 502 and word not in c.memo
