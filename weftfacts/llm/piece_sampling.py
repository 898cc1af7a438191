"""Sampled SentencePiece segmentations by forward filtering and backward sampling; decoding is lossless.

A text's pieces form a lattice. Forward filtering sums the weights of all segmentations of every prefix; backward sampling
walks from the end and draws each last piece with its exact conditional probability, so a segmentation comes out with
probability proportional to the product of its pieces' weights. Draws are hashes of the row key and the position, hence
reproducible whatever the partitioning. No piece has a word mark after another character, so the lattice falls apart
before word marks: each different word of a batch is filtered once, all of them side by side, and every occurrence samples
its own path. A stretch of over LONG characters without a word mark (Chinese, Thai, code, addresses) is filtered over its
whole length too, in blocks that hand the last `depth` sums on; sampling then goes back through the blocks, filtering each
again from what it was handed. Nothing is cut, and where a stretch or a block ends changes no probability.

The model's scores order the merges; a piece of rank r weighs (r + 2) to the power -theta. Characters no piece covers
become byte pieces, a literal word mark too, which is what keeps decoding lossless.

Cost: one pass over the texts, no shuffle; nothing is broadcast, the model file is read from its path by each worker. A
lattice takes about 250 bytes for each byte of text, so SLICE bytes of texts or PART characters of one text are taken at
once, whatever a batch holds; what that took goes back to the system at the end of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, give_back, slices

MARK, LITERAL = 0x2581, 0x110000
#: Characters of a stretch above which it is filtered by itself, of its blocks, and of a part of a very long text.
LONG, BLOCK, PART = 512, 1 << 16, 1 << 18
#: Bytes of texts that are encoded together.
SLICE = 1 << 18
#: Log weight of a byte piece, added for each byte of a character that has no piece.
BYTE_WEIGHT = -12.0


class Lattice:
    """The compiled vocabulary of one model file."""

    def __init__(self, path: str, theta: float = 1.0) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        normal = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("a piece crosses a word mark")
                normal.append((i, piece, -theta * np.log(2.0 - sp.get_score(i))))
                self.bytes_of.append(piece.replace("▁", " ").encode())
        if not self.byte_id.all():
            raise ValueError("the model lacks byte pieces")
        chars = sorted({ord(c) for _, p, _ in normal for c in p})
        self.char = np.zeros(0x110001, np.int32)
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.n_bytes = np.ones(0x110001, np.int8)
        self.n_bytes[0x80:], self.n_bytes[0x800:], self.n_bytes[0x10000:] = 2, 3, 4
        self.n_bytes[LITERAL] = 3
        trie: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for i, piece, weight in normal:
            node = 0
            for c in piece:
                node = trie.setdefault((node, int(self.char[ord(c)])), len(trie) + 1)
            ends[node] = (i, weight)
        size = len(trie) + 1
        self.piece, self.weight = np.full(size, -1, np.int32), np.zeros(size, np.float64)
        for node, (i, weight) in ends.items():
            self.piece[node], self.weight[node] = i, weight
        self.depth = max(len(p) for _, p, _ in normal)
        self.root = np.zeros(self.width, np.int32)
        for (node, c), to in trie.items():
            if not node:
                self.root[c] = to
        # Transitions in an open hash table, looked up for many at once.
        self.bits = 20
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for (node, c), to in trie.items():
            k = node * self.width + c
            h = int(self._hash(np.array([k], np.int64))[0])
            while self.key[h] >= 0:
                h = (h + 1) & ((1 << self.bits) - 1)
            self.key[h], self.to[h] = k, to

    def _hash(self, k: np.ndarray) -> np.ndarray:
        return ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's next nodes, 0 where there is none."""
        k = node.astype(np.int64) * self.width + char
        h = self._hash(k)
        found = self.key[h]
        out = np.where(found == k, self.to[h], 0)
        rest = np.flatnonzero((found != k) & (found >= 0))
        while len(rest):
            h[rest] = (h[rest] + 1) & ((1 << self.bits) - 1)
            found = self.key[h[rest]]
            hit = found == k[rest]
            out[rest[hit]] = self.to[h[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def filter(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filtering of words laid end to end, each followed by one code of 0.

        Nodes are laid out by position first, then by word, longest word first, so that all words advance together and a
        position's nodes are contiguous. Returns: per word its row; per position where its nodes begin; per node its first
        edge; and per edge, grouped by the node it ends at: how many characters it takes, its piece (-1: bytes), and the
        running sum of the conditional probabilities.
        """
        order = np.argsort(-length, kind="stable")
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        sized = length[order]
        longest = int(sized[0])
        holds = np.searchsorted(-sized, -np.arange(longest + 1), side="right")  # words of at least r characters
        off = np.concatenate(([0], np.cumsum(holds)))
        n = int(off[-1])
        base = np.concatenate(([0], np.cumsum(length + 1)[:-1]))[order]
        code = np.zeros(n, np.int32)
        for r in range(longest):
            code[off[r] : off[r + 1]] = codes[base[: holds[r]] + r]  # the 0 behind a word that ends here
        char = np.where(code == LITERAL, 0, self.char[code])
        inside = np.ones(n, bool)
        for r in range(longest):
            inside[off[r] + holds[r + 1] : off[r + 1]] = False
        inside[off[longest] :] = False
        char[~inside] = 0
        at = np.flatnonzero(inside)
        level = np.repeat(np.arange(longest + 1), holds)[at]
        word = at - off[level]
        node = np.zeros(len(at), np.int32)
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        bare = inside.copy()
        place = at
        for d in range(self.depth):
            c = char[place]
            node = np.where(c > 0, self._step(node, c), 0) if d else self.root[c]
            alive = node > 0
            node, level, word = node[alive], level[alive] + 1, word[alive]
            if d == 0:
                at = at[alive]
            if not len(node):
                break
            place = off[level] + word
            end = self.piece[node]
            hit = end >= 0
            found.append((d + 1, place[hit], end[hit], self.weight[node[hit]]))
            if d == 0:
                bare[at[hit]] = False
        own = np.flatnonzero(bare)  # characters without a piece of their own
        if len(own):
            r = np.searchsorted(off, own, side="right") - 1
            found.append((1, off[r + 1] + own - off[r], np.full(len(own), -1, np.int32), BYTE_WEIGHT * self.n_bytes[code[own]]))
        # Each list has its end nodes in order; edges go to the next free place of their end node.
        count = np.zeros(n + 1, np.int64)
        for _, stop, _, _ in found:
            count[stop + 1] += 1
        head = np.cumsum(count)
        free, total = head[:-1].copy(), int(head[-1])
        took, piece, weight = np.empty(total, np.int8), np.empty(total, np.int32), np.empty(total)
        for d, stop, p, w in found:
            to = free[stop]
            free[stop] += 1
            took[to], piece[to], weight[to] = d, p, w
        alpha, share = np.zeros(n), np.empty(total)
        for r in range(1, longest + 1):
            a, z = int(off[r]), int(off[r + 1])
            ea, ez = int(head[a]), int(head[z])
            many = head[a + 1 : z + 1] - head[a:z]
            first = head[a:z] - ea
            local = np.repeat(np.arange(z - a), many)
            v = alpha[off[r - took[ea:ez].astype(np.int64)] + local] + weight[ea:ez]
            top = np.maximum.reduceat(v, first)
            e = np.exp(v - top[local])
            whole = np.add.reduceat(e, first)
            alpha[a:z] = np.log(whole) + top
            run = np.cumsum(e)
            share[ea:ez] = (run - (run[first] - e[first])[local]) / whole[local]
            share[head[a + 1 : z + 1] - 1] = 2.0  # the last edge takes what rounding leaves
        return row, off, head, took, piece, share, code

    def _edges(self, codes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
        """Edges that end after `first` and not after `last`, in the order of their ends: (end, characters, piece, weight)."""
        a = max(0, first - self.depth + 1)
        code = codes[a:last]
        char = np.where(code == LITERAL, 0, self.char[code])
        at, node, found, bare = np.arange(len(code)), np.zeros(len(code), np.int32), [], np.ones(len(code), bool)
        for d in range(self.depth):
            inside = at + d < len(code)
            at, node = at[inside], node[inside]
            c = char[at + d]
            node = np.where(c > 0, self._step(node, c), 0) if d else self.root[c]
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            hit = self.piece[node] >= 0
            found.append((at[hit] + d + 1, np.full(int(hit.sum()), d + 1), self.piece[node[hit]], self.weight[node[hit]]))
            if d == 0:
                bare[at[hit]] = False
        own = np.flatnonzero(bare)
        found.append((own + 1, np.ones(len(own), np.int64), np.full(len(own), -1, np.int32), BYTE_WEIGHT * self.n_bytes[code[own]]))
        end, took, piece, weight = (np.concatenate(x) for x in zip(*found))
        end = end + a
        keep = np.flatnonzero(end > first)
        keep = keep[np.argsort(end[keep], kind="stable")]
        return end[keep], took[keep], piece[keep], weight[keep]

    def _forward(self, codes: np.ndarray, first: int, last: int, tail: list[float]) -> tuple[list[float], tuple[np.ndarray, ...], list[int], list[float]]:
        """Log sums of the prefixes that end at first - len(tail) + 1 to last (tail: those up to `first`), the edges, where
        each position's edges begin, and each edge's log weight with the sum before it."""
        edges = self._edges(codes, first, last)
        end, took, _, weight = edges
        head = np.searchsorted(end, np.arange(first + 1, last + 2)).tolist()
        alpha, back, takes, weights = list(tail), [0.0] * len(end), took.tolist(), weight.tolist()
        exp, log = math.exp, math.log
        for k in range(last - first):
            here = len(alpha)
            a, z = head[k], head[k + 1]
            if z - a == 1:
                back[a] = alpha[here - takes[a]] + weights[a]
                alpha.append(back[a])
                continue
            for e in range(a, z):
                back[e] = alpha[here - takes[e]] + weights[e]
            top = max(back[a:z])
            alpha.append(top + log(sum([exp(v - top) for v in back[a:z]])))
        return alpha, edges, head, back

    def stretch(self, codes: np.ndarray, key: np.uint64, place: int, block: int = BLOCK) -> np.ndarray:
        """The sampled ids of one stretch. place: of its first character in the document, which the draws depend on.

        Memory beyond the codes: one block's edges, and `depth` numbers a block.
        """
        starts = list(range(0, len(codes), block))
        tails = [[0.0]]
        for a in starts[:-1]:
            alpha = self._forward(codes, a, min(a + block, len(codes)), tails[-1])[0]
            tails.append(alpha[-self.depth :])
        at, out = len(codes), []
        for a, tail in zip(reversed(starts), reversed(tails)):
            z = min(a + block, len(codes))
            alpha, (_, took, piece, _), head, back = self._forward(codes, a, z, tail)
            draws = _uniform(np.full(z - a, key), place + np.arange(a + 1, z + 1)).tolist()
            took, piece, zero = took.tolist(), piece.tolist(), len(tail) - 1
            while at > a:
                e, stop = head[at - a - 1], head[at - a]
                whole, u, run = alpha[zero + at - a], draws[at - a - 1], 0.0
                while e < stop - 1:
                    run += math.exp(back[e] - whole)
                    if run > u:
                        break
                    e += 1
                at -= took[e]
                if piece[e] >= 0:
                    out.append(piece[e])
                else:
                    c = int(codes[at])
                    out += self.byte_id[list("▁".encode() if c == LITERAL else chr(c).encode())][::-1].tolist()
        return np.array(out[::-1], np.int32)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; number of ids of each). keys: an unsigned 64-bit key a text."""
        # A text begins with a mark of its own; a very long one is taken in parts that begin with its own marks.
        ids, counts, parts, owner, places = [], np.zeros(len(texts), np.int64), [], [], []

        def flush() -> None:
            got, many = self._encode(parts, keys[owner], np.array(places, np.int64))
            np.add.at(counts, owner, many)
            ids.append(got)
            parts.clear(), owner.clear(), places.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            t, a = " " + t, 0
            while a < len(t):
                z = len(t) if len(t) - a <= PART else t.find(" ", a + PART)
                while 0 < z < len(t) and t[z - 1] == " ":
                    z -= 1  # a run of marks begins a word as a whole
                z = z if z > a else len(t)
                parts.append(t[a:z])
                owner.append(i)
                places.append(a)
                if len(parts[-1]) >= PART:
                    flush()
                a = z
        if parts:
            flush()
        return np.concatenate([np.zeros(0, np.int32), *ids]), counts

    def _encode(self, texts: list[str], keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that begin with their mark; places: of each text's first character in its document."""
        joined = "".join(texts)
        raw = np.frombuffer(joined.encode("utf-32-le"), np.int32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        mark = raw == 0x20
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[first] = True
        at = np.flatnonzero(begins)
        length = np.diff(np.concatenate((at, [len(raw)])))
        doc = np.repeat(np.arange(len(texts)), size)[at]
        key, place = keys[doc], at - first[doc] + places[doc]
        total, alone = np.zeros(len(at), np.int64), {}
        for k in np.flatnonzero(length > LONG).tolist():
            codes = raw[at[k] : at[k] + length[k]]
            alone[k] = self.stretch(np.where(codes == 0x20, MARK, np.where(codes == MARK, LITERAL, codes)), key[k], int(place[k]))
            total[k] = len(alone[k])
        some = np.flatnonzero(length <= LONG)
        steps = self._words([joined[a:z] for a, z in zip(at[some].tolist(), (at + length)[some].tolist())], key[some], place[some]) if len(some) else []
        for occ, _, _, before, n in steps:
            total[some[occ]] = before + n
        ends = np.cumsum(total)
        ids = np.empty(int(ends[-1]), np.int32)
        for k, got in alone.items():
            ids[ends[k] - len(got) : ends[k]] = got
        for occ, p, code, before, n in steps:
            spot = ends[some[occ]] - before - n
            plain = p >= 0
            ids[spot[plain]] = p[plain]
            for s, c in zip(spot[~plain].tolist(), code[~plain].tolist()):
                data = "▁".encode() if c == LITERAL else chr(c).encode()
                ids[s : s + len(data)] = self.byte_id[list(data)]
        return ids, np.add.reduceat(total, np.searchsorted(doc, np.arange(len(texts))))

    def _words(self, words: list[str], key: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Backward sampling of all occurrences at once, from the end: per step the occurrences, the pieces (-1: bytes of
        the character), the characters, the ids taken before, and the ids of this step."""
        distinct = dict.fromkeys(words)
        number = dict(zip(distinct, range(len(distinct))))
        which = np.array(list(map(number.__getitem__, words)))
        length = np.fromiter(map(len, number), np.int64, len(number))
        flat = np.frombuffer(("\0".join(number) + "\0").encode("utf-32-le"), np.int32)
        flat = np.where(flat == 0x20, MARK, np.where(flat == MARK, LITERAL, flat))
        row, off, head, took, piece, share, code = self.filter(flat, length)
        live, left, node_row = np.arange(len(words)), length[which], row[which]
        steps = []
        total = np.zeros(len(words), np.int64)
        while len(live):
            e = head[off[left] + node_row]
            u = _uniform(key[live], place[live] + left)
            below = np.flatnonzero(share[e] <= u)
            while len(below):
                e[below] += 1
                below = below[share[e[below]] <= u[below]]
            p = piece[e]
            left = left - took[e]
            was = code[off[left] + node_row]
            n = np.where(p >= 0, 1, self.n_bytes[was]).astype(np.int64)
            steps.append((live, p, was, total[live], n))
            total[live] += n
            go = left > 0
            live, left, node_row = live[go], left[go], node_row[go]
        return steps

    def check(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> list[bool]:
        """Whether each text's ids decode to it; all at once where they all do."""
        data, table = ids.tolist(), self.bytes_of
        if b"".join([table[i] for i in data]) == "".join([" " + t for t in texts if t]).encode():
            lengths = np.fromiter(map(len, self.bytes_of), np.int64, len(table))[ids]
            ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
            if np.diff(ends).tolist() == [len(t.encode()) + 1 if t else 0 for t in texts]:
                return [True] * len(texts)
        ends = np.cumsum(counts).tolist()
        return [self.decode(data[z - n : z]) == t for t, n, z in zip(texts, counts.tolist(), ends)]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; the mark put before the text goes, everything else stays."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids])[1:].decode() if ids else ""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (_mix(key + position.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, theta: float) -> Lattice:
    if (path, theta) not in _lattices:
        _lattices[path, theta] = Lattice(path, theta)
    return _lattices[path, theta]


def encode(docs: DataFrame, path: str, seed: int = 42, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, n_pieces, n_bytes, lossless (decoding gave the very text back).

    The row key is doc_id, or for rows without one a hash of the text; repeated rows get the same ids. Null and empty texts
    have no ids. An empty table gives no rows; further columns are not read.
    """
    base = doc_text(docs, id_col, text_col)
    keyed = base.select("doc_id", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.xxhash64("text"))).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path, theta)
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                texts = piece.column("text").to_pylist()
                ids, counts = m.encode(texts, piece.column("key").to_numpy().view(np.uint64))
                ends = np.cumsum(counts)
                same = m.check(texts, ids, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), lists, pa.array(counts, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_pieces", "n_bytes", "lossless"]
                )
            give_back()

    return keyed.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_bytes long, lossless boolean")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Null ids give the empty text."""
    base = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path, 1.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return base.mapInArrow(run, "doc_id long, text string")
