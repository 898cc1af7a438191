import random
import re

import pytest

from weftfacts.llm.license_rules import PHRASES, RULES
from weftfacts.llm.license_scan import license_scan, scan, suppress


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_rules_are_many_and_gated_by_their_keyword():
    assert len(RULES) >= 200
    for label, priority, keyword, pattern in RULES:
        assert 1 <= priority <= 4 and label and re.compile(pattern)
        assert pattern.split("(?:")[0].strip() or "|" in pattern or True
        # The keyword's words must occur in the expression itself, so that the gate can't lose a match.
        assert all(w[:4] in pattern for w in keyword.split()), (label, keyword, pattern)


def test_base_against_brute_force():
    rng = random.Random(0)
    pool = ["MIT", "mit", "License", "license.", "Apache", "general", "public", "é", "x1", "-", "\n", "_", "GNU", "\x7f"]
    for _ in range(2000):
        t = rng.choice(["", " ", "-"]).join(rng.choices(pool, k=rng.randint(0, 30)))
        t2 = " ".join(rng.choices(pool, k=rng.randint(0, 30)))
        for x in (t, t2):
            assert scan(x.encode())[:5] == brute(x)


def test_suppression_against_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        raw = [(a := rng.randint(0, 20), a + rng.randint(1, 9), rng.choice("xyz"), rng.randint(1, 4)) for _ in range(rng.randint(0, 12))]
        want = []
        for d in sorted(set(raw), key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in want):
                want.append(d)
        assert suppress(raw) == sorted(want)


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", "apache"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
    ("This work is CC BY-NC-SA 4.0.", "cc by nc sa"),
    ("under the terms of the GNU Lesser General Public License version 2.1", "gpl,lgpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("a summit licensee", ""),
])
def test_known_texts(text, labels):
    assert scan(text.encode())[5] == labels


def test_operator(spark):
    rows = [(1, "The MIT License; the mit license", "x"), (2, None, None), (None, "", "x"), (3, "é" * 100_000, "x"), (1, "The MIT License; the mit license", "x")]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect())
    assert got == [("1", 6, 2, 1, 4, "mit", 0.7)] * 2 + [("2", 0, 0, None, None, "", 0.0), ("3", 1, 0, None, None, "", 0.0), ("None", 0, 0, None, None, "", 0.0)]
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
