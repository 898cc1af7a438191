import random
import re

from pyspark.sql import functions as F

import pytest

from weftfacts.llm.pii import _FIRST, _iban_ok, _luhn, assign, detect, render, surrogate, surrogates

KEY = b"a key of the test"
TEXT = 'Mail Ann.Lee7@Example.org or call +1 (504) 555-2652; card 4111 1111 1111 1111, IP 10.2.3.4, ssn 123-45-6789, token = "0c497b5014f705c0be648d68b816f88c", IBAN DE89 3704 0044 0532 0130 00. Mr. John Smith met Ms. Jane Roe; Mr. Smith left. Госпожа Анна Иванова.'


def test_every_kind_is_found():
    kinds = {x[4] or x[2] for x in detect(TEXT)}
    assert kinds == {"email", "phone", "card", "ip", "ssn", "secret", "iban", "first_m", "first_f", "last"}


@pytest.mark.parametrize("text,want", [
    ("Mr. Smith and Mrs. Jones met.", ["Smith", "Jones"]), ("Mr. Smith met Dr. Brown", ["Smith", "Brown"]), ("Mr. Juan Carlos Garcia Lopez", ["Juan", "Carlos", "Garcia", "Lopez"]),
    ("Dr. Jane Roe met Ms. Jane Roe. Jane said Roe left; ROE's dog.", ["Jane", "Roe", "Jane", "Roe", "Jane", "Roe", "ROE"]), ("Herr Dr. Otto von der Weide", ["Otto", "Weide"]),
    ("Mr. Smith. The end. Mr. Roe The end", ["Smith", "Roe"]), ("Prof. J. O'Brien-Lee's", ["O'Brien-Lee"]), ("mr smith and don Juan", ["Juan"]), ("MR. JOHN SMITH", ["JOHN", "SMITH"]),
])
def test_names(text, want):
    assert [text[a:z] for a, z, k, *_ in detect(text) if k == "name"] == want


def test_long_runs_are_read_in_linear_time():
    import time

    began = time.time()
    assert [x[2] for x in detect("a" * 300_000 + " q@r.st " + "b." * 100_000)] == ["email"]
    assert len(detect(" ".join(f"u{i}@ex{i}.org 10.{i % 200}.{i // 200}.1" for i in range(20_000)))) == 40_000
    assert time.time() - began < 5


def test_clean_text_is_left_alone():
    assert detect("In 2020 the 3 of them, at 10:30, paid 1,234.50 for version 1.2.3 on 2020-01-02. ratio = 5; mr x, the token ring") == []


def test_surrogates_keep_type_and_format():
    for k, v in [("card", "4111111111111111"), ("card", "8490294829394201"), ("iban", "DE89370400440532013000"), ("email", "ann.lee7@mail6.example.com"), ("ip", "192.168.4.4"), ("secret", "0c497b5014f705c0"), ("phone", "15045552652")]:
        s = surrogate(KEY, k, v, 0)
        assert s != v and s == surrogate(KEY, k, v, 0) != surrogate(KEY, k, v, 1) and len(s) == len(v) or k == "ip"
    assert _luhn(surrogate(KEY, "card", "4111111111111111", 0)) and not _luhn(surrogate(KEY, "card", "4111111111111112", 0))
    assert _iban_ok(surrogate(KEY, "iban", "DE89370400440532013000", 0))
    assert surrogate(KEY, "ip", "192.168.4.4", 0).startswith("192.168.")
    assert re.fullmatch(r"[а-я]{7}", surrogate(KEY, "last", "иванова", 0))
    assert render("+1 (504) 555-2652", "phone", "15049998888") == "+1 (504) 999-8888"
    assert render("SMITH", "name", "holt") == "HOLT"


def test_names_stay_distinct_when_the_lists_run_out(spark):
    rng = random.Random(0)
    names = sorted({"".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(400)} | {"holt", "reed"})
    rows = [("name", n, ["last", "first_m", "first_f"][k % 3]) for k, n in enumerate(names)]
    got = assign(spark.createDataFrame(rows, "kind string, value string, form string"), KEY).collect()
    assert sorted(r["value"] for r in got) == names
    assert len({r["surrogate"] for r in got}) == len(got) and not {r["surrogate"] for r in got} & set(names)


def test_full_spaces_widen_or_trade_values(spark):
    # Two thirds of 192.168.0.0/16: the surrogates come from the larger private range.
    ips = [("ip", f"192.168.{a}.{b}", "ip") for a in range(170) for b in range(1, 255)]
    # Nearly all emails of one letter at one letter, and a form with no free value at all after one round.
    mails = [("email", f"{chr(97 + i)}@{chr(97 + j)}.de", "email") for i in range(26) for j in range(26)]
    df = spark.createDataFrame(ips + mails, "kind string, value string, form string")
    got = assign(df, KEY).collect()
    assert len(got) == len(ips) + len(mails) == len({(r["kind"], r["surrogate"]) for r in got})
    assert not {r["surrogate"] for r in got} & {r["value"] for r in got}
    assert all(re.fullmatch(r"(192\.168|10\.\d+)\.\d+\.\d+", r["surrogate"]) for r in got if r["kind"] == "ip")
    got = assign(df.filter("kind = 'email'"), KEY, rounds=1).collect()
    assert len(got) == len(mails) == len({r["surrogate"] for r in got}) and all(r["surrogate"] != r["value"] for r in got)


def brute(rows):
    """Every planted entity's places, by plain search of the planted strings."""
    return {(i, s): len(re.findall(rf"(?<!\w){re.escape(s)}(?!\w)", t)) for i, (t, planted) in enumerate(rows) for s in planted}


def test_invented_corpus_against_the_planted_entities(spark):
    rng = random.Random(9)
    people = [(f, last) for f, last in zip(["Jane", "Mary", "Paul", "Jordan", "Zora"], ["Roe", "Stone", "Quade", "Abbe", "Lund"])]
    titles = {"Jane": ["Ms.", "Dr."], "Mary": ["Mrs."], "Paul": ["Mr.", "Prof."], "Jordan": ["Mr.", "Ms."], "Zora": ["Dr."]}
    others = ["ann@ex.org", "bob.x@mail.net", "10.4.5.6", "192.168.7.8", "123-45-6789", "+1 504 555 2652"]
    rows = []
    for _ in range(60):
        first, last = rng.choice(people)
        some = rng.sample(others, 2)
        words = [f"{rng.choice(titles[first])} {first} {last}", f"said {last}", f"and {first}'s cat", *some, "plain words here", some[0]]
        rng.shuffle(words)
        rows.append((" ; ".join(words), [first, last, *some]))
    places = brute(rows)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in surrogates(df, KEY).collect()}
    mapping = {}
    for i, (t, planted) in enumerate(rows):
        assert got[i]["n_entities"] == sum(places[i, s] for s in planted)
        assert not any(re.search(rf"(?<!\w){re.escape(s)}(?!\w)", got[i]["text"]) for s in planted)
        # What stands between the planted strings is unchanged, so the surrogates can be read off.
        parts = re.split("(" + "|".join(map(re.escape, sorted(planted, key=len, reverse=True))) + ")", t)
        m = re.fullmatch("(.+?)".join(map(re.escape, parts[::2])), got[i]["text"])
        for s, new in zip(parts[1::2], m.groups()):
            assert mapping.setdefault(s, new) == new
    assert len(set(mapping.values())) == len(mapping) == 16 and not set(mapping) & set(mapping.values())
    for name, kind in (("Jane", "f"), ("Mary", "f"), ("Paul", "m"), ("Jordan", "n"), ("Zora", "n")):
        assert mapping[name] in _FIRST[kind] or len(mapping[name]) > 6


def test_operator(spark):
    rows = [(1, TEXT, "x"), (2, "again ann.lee7@example.org, John Smith? Mr. Smith!", "x"), (3, None, None), (None, "", "x"), (4, "nothing here", "x"), (2, "again ann.lee7@example.org, John Smith? Mr. Smith!", "x"), (5, "x " * 50_000 + "ann.lee7@example.org", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string").repartition(3)
    got = {}
    for r in surrogates(df, KEY).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    one = got[1][0]
    assert one["n_entities"] == len(detect(TEXT)) and one["kinds"] == "card,email,iban,ip,name,phone,secret,ssn"
    for _, _, _, v, _ in detect(TEXT):
        assert v not in one["text"].lower()
    # The same entities, found again, in the same places; mentions of one entity agree across documents.
    assert [x[2] for x in detect(one["text"])] == [x[2] for x in detect(TEXT)]
    mail = next(x[3] for x in detect(one["text"]) if x[2] == "email")
    assert mail in got[2][0]["text"] and got[5][0]["text"].endswith(mail)
    assert got[2][0] == got[2][1]
    smiths = [x[3] for x in detect(one["text"]) if x[4] == "last"]
    assert smiths[0] == smiths[2] != smiths[1]
    assert (got[3][0]["text"], got[None][0]["text"], got[4][0]["text"]) == ("", "", "nothing here")
    assert surrogates(df.filter(F.lit(False)), KEY).collect() == []
