"""Token counts by compiled finite-state transducers whose chunk maps compose by prefix scan.

Two deterministic machines count the tokens of byte-level BPE without building them:

* The splitter reads character classes and marks where pre-tokens start. It has 12 states, so a chunk of text is a map
  from 12 entry states to exit states. A batch is cut into short chunks that run side by side for every entry state,
  their maps compose by a parallel prefix scan, and a second run with known entry states gives the marks.
* The counter reads the bytes of a pre-token; each transition says by how much the number of tokens changes. Its state
  holds, for every open suffix that may still become a vocabulary entry, the token that ends before it and the relative
  count. Equal states merge, which makes it finite; transitions are compiled on first use and kept by the worker.

A document above HUGE characters is cut and counted on many tasks. A cut's map gives, for each entry state, the exit
state, the tokens wholly inside, and the open text at both ends; maps compose associatively into the document's count.

Cost: one pass over the texts, no shuffle (huge documents: one of their chunks). Nothing is broadcast but the vocabulary.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, slices

#: Documents above this many characters are cut into pieces of CUT and counted over many tasks.
HUGE, CUT = 32 << 20, 4 << 20
#: Cached pre-tokens a worker keeps; above it the cache starts anew, which changes no result.
MEMO = 1 << 20
#: Longest pre-token whose count is kept.
MEMO_CHARS = 64

# Character classes; the letters that contractions need have their own.
_LETTER, _NUM, _SPACE, _WS, _APOS, _OTHER, _SEP = range(7)
_SPECIAL = {c: 7 + i for i, c in enumerate("stmdrvle")}
N_CLASS = 7 + len(_SPECIAL)
# Splitter states.
FRESH, LET, NUM, OTH, APO, AR, AV, AL, SP1, SPM, WS1, WSM = range(12)
N_STATE = 12
#: What a transition marks: a pre-token starts at this character, at the one before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    nxt, out = np.zeros((N_STATE, N_CLASS), np.uint8), np.zeros((N_STATE, N_CLASS), np.uint8)
    kind = [_LETTER, _NUM, _SPACE, _WS, _APOS, _OTHER, _SEP] + [_LETTER] * len(_SPECIAL)
    closed = {_LETTER: LET, _NUM: NUM, _OTHER: OTH, _APOS: APO, _SPACE: SP1, _WS: WS1}
    joined = closed | {_APOS: OTH}

    def plain(state: int, k: int) -> tuple[int, int]:
        if (state, k) in ((LET, _LETTER), (NUM, _NUM), (OTH, _OTHER), (OTH, _APOS)):
            return state, 0
        return closed[k], HERE

    for s in range(N_STATE):
        for c, k in enumerate(kind):
            char = next((ch for ch, n in _SPECIAL.items() if n == c), "")
            space = k in (_SPACE, _WS)
            if k == _SEP:
                go = FRESH, HERE | (BEFORE if s in (AR, AV, AL) else 0)
            elif s in (AR, AV, AL):
                if char == {AR: "e", AV: "e", AL: "l"}[s]:
                    go = FRESH, 0
                else:
                    to, marks = plain(LET, k)
                    go = to, marks | BEFORE
            elif s == APO:
                if char and char in "stmd":
                    go = FRESH, 0
                elif char and char in "rvl":
                    go = {"r": AR, "v": AV, "l": AL}[char], 0
                elif k in (_OTHER, _APOS):
                    go = OTH, 0
                else:
                    go = closed[k], HERE
            elif s in (SP1, SPM, WS1, WSM):
                if space:
                    go = (SPM if k == _SPACE else WSM), 0
                elif s == SP1:
                    go = joined[k], 0
                elif s == SPM:
                    go = joined[k], BEFORE
                else:
                    go = closed[k], HERE | (BEFORE if s == WSM else 0)
            else:
                go = plain(s, k)
            nxt[s, c], out[s, c] = go
    return nxt, out


NEXT, MARK = _splitter()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point, as the pre-tokenizer's Unicode properties have it."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, k in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUM), (r"\s+", _WS)):
            for m in regex.finditer(pattern, every):
                table[[ord(c) for c in m.group()]] = k
        # Letters and numbers of a later Unicode version than the library's.
        for a, z in ((0x11DE0, 0x11DEA), (0x1246F, 0x12470), (0x12475, 0x12480), (0x12550, 0x12687), (0x16FF4, 0x16FF7)):
            table[a:z] = _OTHER
        # \s of the regex module holds four control characters that White_Space doesn't.
        table[0x1C:0x20] = _OTHER
        table[ord(" ")], table[ord("'")] = _SPACE, _APOS
        for c, k in _SPECIAL.items():
            table[ord(c)] = k
        _classes = table
    return _classes


def _scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix of state maps (one a row): row k becomes the composition of rows 0 to k."""
    step = 1
    while step < len(maps):
        done = maps.copy()
        done[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps, step = done, step * 2
    return maps


def marks(cls: np.ndarray, entry: int = FRESH, width: int = 128) -> tuple[np.ndarray, int]:
    """(marks of every character, exit state) of a text of the given classes."""
    n = len(cls)
    width = max(1, min(width, n))
    if not n:
        return np.zeros(0, np.uint8), entry
    rows = -(-n // width)
    grid = np.full(rows * width, _SEP, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, flat_mark = NEXT.ravel(), MARK.ravel()
    base = (np.arange(N_STATE) * N_CLASS).astype(np.uint8)
    hop = (flat.astype(np.uint8) * N_CLASS).astype(np.uint8)  # next state, premultiplied: 12 * 15 fits in a byte
    cur = np.repeat(base[:, None], rows, 1)
    for j in range(width):
        cur = hop[cur + grid[j]]
    maps = (cur // N_CLASS).T
    state = np.empty(rows, np.uint8)
    state[0] = entry
    if rows > 1:
        state[1:] = _scan(np.ascontiguousarray(maps))[:-1, entry]
    state = (state * N_CLASS).astype(np.uint8)
    found = np.empty((width, rows), np.uint8)
    tail = n - (rows - 1) * width
    last = 0
    for j in range(width):
        at = state + grid[j]
        found[j] = flat_mark[at]
        state = hop[at]
        if j == tail - 1:
            last = int(state[-1]) // N_CLASS
    return np.ascontiguousarray(found.T).ravel()[:n], last


def starts(found: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; -1 when the first character says that the one before it does."""
    here = np.flatnonzero(found & HERE)
    before = np.flatnonzero(found & BEFORE) - 1
    return np.union1d(here, before) if len(before) else here


def open_before_end(state: int) -> bool:
    """Whether, at the end of a text, its last character turns out to start a pre-token."""
    return state in (AR, AV, AL)


class Counter:
    """The counting transducer of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is supported")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word borders aren't supported")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        as_bytes = lambda t: bytes(byte[c] for c in t)
        self.token = {i: as_bytes(t) for t, i in model["vocab"].items() if t not in self.specials}
        ids = {b: i for i, b in self.token.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.single = [ids[bytes([b])] for b in range(256)]
        # A trie of the vocabulary: node -> {byte: node}, and the token that ends at a node. Only merge products are reachable.
        made = {t for _, t in self.merge.values()} | set(self.single)
        self.trie: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for i in sorted(made):
            node = 0
            for b in self.token[i]:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = self.trie[node][b]
            self.ends[node] = i
        self.pair: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.number, self.go, self.memo = [first], {first: 0}, {}, {}

    def bpe(self, data: bytes) -> list[int]:
        """Plain merging; used to compile transitions and as the reference in tests."""
        t = [self.single[b] for b in data]
        while len(t) > 1:
            best = min((self.merge.get(p, (1 << 60, 0))[0], k) for k, p in enumerate(zip(t, t[1:])))
            if best[0] == 1 << 60:
                break
            rank, out, k = best[0], [], 0
            while k < len(t):
                if k + 1 < len(t) and (m := self.merge.get((t[k], t[k + 1]))) and m[0] == rank:
                    out.append(m[1])
                    k += 2
                else:
                    out.append(t[k])
                    k += 1
            t = out
        return t

    def _fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b can stand side by side: merging their bytes gives just them."""
        known = self.pair.get((a, b))
        if known is None:
            known = self.pair[a, b] = self.bpe(self.token[a] + self.token[b]) == [a, b]
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        state, byte = self.states[key >> 8], key & 255
        kept, last, change = [], -1, 0
        for node, before, rel in state:
            to = self.trie[node].get(byte)
            if to is None:
                continue
            t = self.ends[to]
            if last < 0 and t >= 0 and (before < 0 or self._fits(before, t)):
                last, change = t, rel + 1
            if self.trie[to]:
                kept.append((to, before, rel))
        if last < 0:
            raise ValueError("this vocabulary's tokens aren't decided by neighbouring pairs")
        new = (*((n, b, r - change) for n, b, r in kept), (0, last, 0))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        self.go[key] = found = (number << 8, change)
        return found

    def word(self, word: str) -> int:
        """Tokens of one pre-token."""
        state = count = 0
        go = self.go
        for b in word.encode():
            step = go.get(state | b)
            if step is None:
                if len(self.states) > MEMO:
                    # One long pre-token may need more states than fit: all but its own are forgotten.
                    own = self.states[state >> 8]
                    self.reset()
                    if own not in self.number:
                        self.number[own] = len(self.states)
                        self.states.append(own)
                    state, go = self.number[own] << 8, self.go
                step = self._compile(state | b)
            state = step[0]
            count += step[1]
        if len(word) <= MEMO_CHARS:
            self.memo[word] = count
        return count

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.states) > MEMO:
            self.reset()
        got = list(map(self.memo.get, words))
        if None in got:
            memo, word = self.memo, self.word
            got = [memo.get(w) or word(w) if n is None else n for w, n in zip(words, got)]
        return np.array(got, np.int64)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts."""
        owner, parts, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.special and any(s in t for s in self.specials):
                cut = self.special.split(t)
                extra[i] = len(cut) - 1
                owner += [i] * len(cut)
                parts += cut
            else:
                owner.append(i)
                parts.append(t)
        if not parts:
            return extra
        joined = "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = classes()[codes]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        cls[ends] = _SEP
        at = starts(marks(cls)[0])
        cuts = at.tolist()
        counts = self.words([joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)])])
        sep = np.searchsorted(at, ends)  # every separator starts a pre-token of its own
        counts[sep] = 0
        sums = np.concatenate(([0], np.cumsum(counts)))
        per_part = np.diff(np.concatenate(([0], sums[sep])))
        np.add.at(extra, owner, per_part)
        return extra

    def chunk_map(self, text: str) -> list[tuple]:
        """For every entry state: (exit state, whether the character before starts a pre-token, text before the first start, tokens wholly inside, text from the last start or None)."""
        cls = classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        out = []
        for entry in range(N_STATE):
            found, state = marks(cls, entry)
            at = starts(found)
            retro = bool(len(at) and at[0] == -1)
            cuts = at[retro:].tolist()
            if not cuts:
                out.append((state, retro, text, 0, None))
            else:
                inner = self.words([text[a:b] for a, b in zip(cuts, cuts[1:])]) if len(cuts) > 1 else np.zeros(1, np.int64)
                out.append((state, retro, text[: cuts[0]], int(inner.sum()), text[cuts[-1] :]))
        return out

    def _closed(self, text: str) -> int:
        return self.word(text) if text else 0

    def compose(self, left: list[tuple], right: list[tuple]) -> list[tuple]:
        """The map of two neighbouring chunks; associative."""
        out = []
        for exit_, retro, head, inner, tail in left:
            to, retro2, head2, inner2, tail2 = right[exit_]
            if retro2 and tail is None and not head:
                raise ValueError("chunks must not be empty")
            if tail is None:
                # Nothing started in the left chunk; what starts now ends its head.
                if retro2:
                    head, last = head[:-1], head[-1:] + head2
                    out.append((to, retro, head, inner + (self._closed(last) if tail2 is not None else 0) + inner2, last if tail2 is None else tail2))
                else:
                    out.append((to, retro, head + head2, inner2, tail2))
            else:
                if retro2:
                    inner += self._closed(tail[:-1])
                    tail = tail[-1:]
                tail += head2
                if tail2 is None:
                    out.append((to, retro, head, inner, tail))
                else:
                    out.append((to, retro, head, inner + self._closed(tail) + inner2, tail2))
        return out

    def finish(self, whole: list[tuple]) -> int:
        """The tokens of a text with this map, entered afresh."""
        state, _, head, inner, tail = whole[FRESH]
        total = inner
        if tail is None:
            head, tail = "", head
        if open_before_end(state) and len(tail) > 1:
            total += self._closed(tail[:-1])
            tail = tail[-1:]
        return total + self._closed(head) + self._closed(tail)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, huge: int = HUGE, cut: int = CUT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a tokenizers .json of byte-level BPE, present on every executor. Null counts as the empty text: 0 bytes, 0
    tokens. Special strings inside a text are one token each, as the library's default has it. Repeated rows are counted
    each; a null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    base = doc_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                n = c.texts(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = "doc_id long, n_bytes long, n_tokens long"
    small = sized.filter(F.length("text") <= huge).mapInArrow(run, out)
    large = _huge(sized.filter(F.length("text") > huge), path, cut)
    return small.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)


def _huge(sized: DataFrame, path: str, cut: int) -> DataFrame:
    pattern = counter(path).special
    parts = F.split("text", "|".join("\\Q" + s + "\\E" for s in counter(path).specials), -1) if pattern else F.array("text")
    rows = sized.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "n_bytes", "row", F.posexplode(parts).alias("seg", "part"))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("part") - 1, F.lit(0)) / cut).cast("int"))))
    rows = rows.select("doc_id", "n_bytes", "row", "seg", "pos", F.expr(f"substring(part, pos * {cut} + 1, {cut})").alias("text")).repartition("row", "seg", "pos")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            made = [pickle.dumps(c.chunk_map(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_bytes", "row", "seg", "pos")), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "row", "seg", "pos", "map"])

    mapped = rows.mapInArrow(maps, "doc_id long, n_bytes long, row long, seg int, pos int, map binary")
    grouped = mapped.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("seg", "pos", "map"))).alias("maps"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            totals = []
            for chunks in batch.column("maps").to_pylist():
                by_seg: dict[int, list] = {}
                for x in chunks:
                    m = pickle.loads(x["map"])
                    by_seg[x["seg"]] = c.compose(by_seg[x["seg"]], m) if x["seg"] in by_seg else m
                totals.append(len(by_seg) - 1 + sum(c.finish(m) for m in by_seg.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return grouped.mapInArrow(fold, "doc_id long, n_bytes long, n_tokens long")
