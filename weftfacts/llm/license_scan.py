"""License scan by ordered signature rules behind a keyword prefilter.

One automaton finds the keywords in a text's words; only rules whose keyword occurs are matched. Detections are then taken
in order of priority, length and position: one whose interval lies inside an accepted detection's interval is suppressed.
Base phrases are counted apart from that and always keep their labels.

Cost: one pass over the texts, no shuffle, nothing broadcast but the rules.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text, map_text, text_bytes
from .license_rules import PHRASES, RULES

#: Delimiters become spaces, A-Z becomes a-z, digits, a-z and all bytes of non-ASCII characters stay.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What the best detection's priority says about how sure it is.
SURE = {4: 1.0, 3: 0.9, 2: 0.7, 1: 0.3}


@lru_cache(1)
def _compiled() -> tuple[ahocorasick.Automaton, list[tuple[str, int, re.Pattern]]]:
    gate: dict[str, list[int]] = {}
    for k, (_, _, keyword, _) in enumerate(RULES):
        gate.setdefault(keyword, []).append(k)
    auto = ahocorasick.Automaton()
    for keyword, rules in gate.items():
        auto.add_word(keyword, tuple(rules))
    auto.make_automaton()
    # Bounded by spaces, which the joined words have at both ends; the one behind is looked at but not consumed.
    return auto, [(label, priority, re.compile("(?<= )(?:" + pattern + ")(?= )")) for label, priority, _, pattern in RULES]


def detect(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the detections that stay, as offsets into ' ' + words + ' '."""
    auto, rules = _compiled()
    active: set[int] = set()
    for _, found in auto.iter(text):
        active.update(found)
    raw = [(m.start(), m.end(), rules[k][0], rules[k][1]) for k in active for m in rules[k][2].finditer(text)]
    return suppress(raw)


def suppress(raw: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Highest priority first, then longest, then first; a detection inside an accepted one goes. Accepted ends are kept as
    a staircase (larger starts with larger ends), so each test is one binary search."""
    kept, starts, ends = [], [], []
    for d in sorted(set(raw), key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        a, z = d[0], d[1]
        k = bisect_left(starts, a + 1) - 1  # the last accepted start at or before a has the largest end of those
        if k >= 0 and ends[k] >= z:
            continue
        kept.append(d)
        k += 1
        while k < len(starts) and ends[k] <= z:
            del starts[k], ends[k]
        starts.insert(k, a)
        ends.insert(k, z)
        if k and starts[k - 1] == a:
            del starts[k - 1], ends[k - 1]
    return sorted(kept)


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(first word's number, label) of every place of a base phrase in b' word word ... '; overlaps count."""
    out = []
    for phrase, label in PHRASES:
        needle, at = f" {phrase} ".encode(), 0
        counted, upto = 0, 0
        while (at := joined.find(needle, at)) >= 0:
            counted += joined.count(b" ", upto, at)
            upto = at
            out.append((counted, label))
            at += 1
    return out


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    words = text.translate(_WORD).split(b" ")
    words = [w for w in words if w]
    joined = b" " + b" ".join(words) + b" "
    base = base_places(joined)
    string = joined.decode()
    found = detect(string)
    base_labels = {label for _, label in base}
    labels = base_labels | {d[2] for d in found}
    score = max([SURE[2] if base else 0.0, *(SURE[d[3]] for d in found)])
    before, upto = [], 0
    for a, *_ in found:  # in order, so each counts on from the last
        before.append((before[-1] if before else 0) + string.count(" ", upto, a))
        upto = a
    spans = [{"first_word": n - 1, "n_words": string.count(" ", a, z) + 1, "label": label, "priority": p} for n, (a, z, label, p) in zip(before, found)]
    return len(words), len(base), min((w for w, _ in base), default=None), max((w for w, _ in base), default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,n_words:long,label:string,priority:int>>"
_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def _scan_batch(piece: pa.RecordBatch) -> pa.RecordBatch:
    rows = [scan(t) for t in text_bytes(piece.column("text"))]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
    cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of letters a-z (any case), digits and non-ASCII characters. n_base counts the places of the base phrases,
    first_word and last_word are the smallest and largest of their starts (words from 0), null if there are none. labels are
    those of the base phrases and of the rules' detections, distinct, sorted and comma-joined; spans are the detections that
    suppression left. score: 0 if nothing was found, up to 1 for the text of a grant. Null and empty texts have no words.
    Repeated rows each count, a null doc_id stays null, an empty table gives no rows, further columns are not read.
    """
    return map_text(doc_text(docs, id_col, text_col), _scan_batch, _SCHEMA)
