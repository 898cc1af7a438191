import math
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from weftfacts.llm.piece_sampling import BYTE_WEIGHT, LONG, decode, encode, lattice
from weftfacts.llm import piece_sampling as ps
from weftfacts.llm.common import give_back

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "Hello  world", " é▁漢\x00 \U0001f600x", "a" * 300, "  \n ", "the nation of tion", "▁▁", "x" * (LONG + 1), "漢字の" * 400, "http://a.example/" + "nation" * 200]


def spread(m, texts, keys):
    ids, counts = m.encode(texts, np.array(keys, np.uint64))
    ends = np.cumsum(counts).tolist()
    return [ids[z - n : z].tolist() for n, z in zip(counts.tolist(), ends)]


def test_decoding_is_lossless():
    m, rng = lattice(PATH, 1.0), random.Random(0)
    texts = TEXTS + ["".join(rng.choices(["a", "the", " ", "▁", "\n", "é", "漢", "\0", "\U0001f600", "ing"], k=rng.randint(0, 90))) for _ in range(500)]
    got = spread(m, texts, range(len(texts)))
    assert [m.decode(i) for i in got] == texts
    assert all(m.check(texts, *m.encode(texts, np.arange(len(texts), dtype=np.uint64))))


def test_the_library_decodes_them_too():
    sp, m = sentencepiece.SentencePieceProcessor(model_file=PATH), lattice(PATH, 1.0)
    for t, ids in zip(TEXTS[:7], spread(m, TEXTS[:7], range(7))):
        assert sp.decode(ids) == t


def test_samples_do_not_depend_on_the_batch():
    m = lattice(PATH, 1.0)
    together = spread(m, TEXTS, range(len(TEXTS)))
    assert together == [spread(m, [t], [k])[0] for k, t in enumerate(TEXTS)]


def paths(m, word):
    """Every segmentation with its weight, by enumeration."""
    text, pieces = "▁" + word.replace(" ", "▁"), {}
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i in range(259, sp.get_piece_size()):
        pieces[sp.id_to_piece(i)] = -math.log(2 - sp.get_score(i))

    def walk(k):
        if k == len(text):
            yield (), 0.0
        for z in range(k + 1, len(text) + 1):
            w = pieces.get(text[k:z])
            if w is None and z == k + 1:
                w = BYTE_WEIGHT * len(text[k:z].encode())
            if w is not None:
                for rest, v in walk(z):
                    yield (text[k:z], *rest), w + v

    return dict(walk(0))


def test_long_stretches_give_the_same_draws_in_any_blocks(monkeypatch):
    m, rng = lattice(PATH, 1.0), random.Random(3)
    texts = ["".join(rng.choices(["nation", "the", "ing", "漢", "é", "▁", "\U0001f600", "x"], k=n)) + tail for n in (100, 120, 60) for tail in ("", " and  a rest")]
    want = spread(m, texts, range(len(texts)))  # words side by side: none is over LONG
    for long, block in ((3, 7), (3, 1 << 16), (40, 64)):
        monkeypatch.setattr(ps, "LONG", long)
        monkeypatch.setattr(ps.Lattice.stretch, "__defaults__", (block,))
        assert spread(m, texts, range(len(texts))) == want
    monkeypatch.setattr(ps, "PART", 50)
    assert spread(m, texts, range(len(texts))) == want


def test_pieces_cross_position_64_with_their_exact_probability(monkeypatch):
    m, n = lattice(PATH, 1.0), 4000
    word = "x" * 62 + "nation"
    # Exact probability that a piece spans the cut between characters 64 and 65 (the mark is the first), from all prefixes.
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = {sp.id_to_piece(i): 1 / (2 - sp.get_score(i)) for i in range(259, sp.get_piece_size())}

    def total(text):
        sums = [1.0] + [0.0] * len(text)
        for z in range(1, len(text) + 1):
            for a in range(max(0, z - m.depth), z):
                sums[z] += sums[a] * pieces.get(text[a:z], math.exp(BYTE_WEIGHT) if z - a == 1 else 0.0)
        return sums[-1]

    text = "▁" + word
    want = 1 - total(text[:64]) * total(text[64:]) / total(text)
    for long in (LONG, 10):
        monkeypatch.setattr(ps, "LONG", long)
        crossed = 0
        for ids in spread(m, [word] * n, np.random.default_rng(2).integers(0, 2**63, n)):
            ends = np.cumsum([len(sp.id_to_piece(i)) for i in ids])
            crossed += 64 not in ends
        assert 0.05 < want < 0.95 and abs(crossed / n - want) < 5 * math.sqrt(want * (1 - want) / n)


@pytest.mark.parametrize("word", ["hello", "tion of"])
def test_segmentations_come_with_their_exact_probability(word):
    m, n = lattice(PATH, 1.0), 30_000
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    weights = {p: math.exp(w) for p, w in paths(m, word).items()}
    total = sum(weights.values())
    got = Counter(tuple(sp.id_to_piece(i) for i in ids) for ids in spread(m, [word] * n, np.random.default_rng(1).integers(0, 2**63, n)))
    assert set(got) <= set(weights)
    for p, w in weights.items():
        want = w / total
        assert abs(got[p] / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-4


def test_operator_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (2, "Hello  world", "again"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    enc = encode(df, PATH).cache()
    got = enc.collect()
    assert len(got) == len(rows) and all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in got)
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 2}) == 1
    assert sorted(str(tuple(r)) for r in decode(enc, PATH).collect()) == sorted(str((i, t or "")) for i, t, _ in rows)
    assert encode(df.limit(0), PATH).collect() == []


def test_a_batch_is_encoded_in_small_parts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(3, 9))) for _ in range(300)) for _ in range(900)]
    df = spark.createDataFrame([(0, "")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run, keys = encode(df, PATH), list(range(len(texts)))
    batch = pa.RecordBatch.from_pydict({"doc_id": keys, "key": pa.array(keys, pa.int64()), "text": texts})
    lattice(PATH, 1.0)
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) == len(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 110


def test_freed_memory_goes_back_to_the_system():
    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    blocks = [np.ones(12_500) for _ in range(400)]  # 40 MB in pieces too small to be mapped one by one
    some = blocks[39::40]
    del blocks
    before = held()
    give_back()
    assert before - held() > 20 and len(some) == 10


def test_parts_of_a_very_long_text_are_encoded_one_by_one(monkeypatch):
    m, sizes = lattice(PATH, 1.0), []
    monkeypatch.setattr(ps, "PART", 64)
    plain = ps.Lattice._encode
    monkeypatch.setattr(ps.Lattice, "_encode", lambda self, texts, *more: sizes.append(sum(map(len, texts))) or plain(self, texts, *more))
    text = "nations " * 100  # with the mark before it, a part of just 64 characters ends before each eighth mark
    assert [m.decode(i) for i in spread(m, [text], [1])] == [text]
    assert max(sizes) <= 2 * 64
