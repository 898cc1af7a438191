"""PII surrogates: detected entities get keyed, type-consistent replacements, distinct and coreferent across the corpus.

A surrogate is drawn from a keyed hash of (type, canonical value, attempt): digits for digits, letters of the same script
and case for letters, the same punctuation; card numbers keep their Luhn state, IBANs their checksum, addresses their range;
names keep gender and script. Spellings of one entity share a canonical value, so every mention in every document gets the
same surrogate in its own spelling. A name is one entity whatever title stands before it: its role (first or last) and
gender are those of its mentions in the whole corpus, and a first name of either gender gets one that suits both. Names are
detected behind titles; all other mentions of such a name in the same document are mentions too.

Two checks run over the whole entity table: no two entities of a type share a surrogate, and no surrogate is itself an
entity of the corpus; losers draw again, after some attempts from a wider space (longer names, other address ranges). If a
space is so full of entities that none is free, as when a corpus names most of the numbers of some form there are, what is
left trades values in rings: still distinct and coreferent, and no entity keeps its own.

Cost: one pass over the texts finds the spans and writes them beside the texts; documents without entities aren't read by
Python again or moved. The checks shuffle the distinct entities. Mentions meet their surrogates in a salted join.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, materialize, replicated, salt, slices

_TITLES = {
    "m": ("mr", "mister", "herr", "monsieur", "señor", "sr", "don", "sir", "господин", "κύριος"),
    "f": ("mrs", "ms", "miss", "frau", "madame", "mademoiselle", "señora", "señorita", "sra", "doña", "lady", "госпожа", "κυρία"),
    "n": ("dr", "prof", "professor", "doctor"),
}
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}
_FIRST = {
    "m": "Adam Albert Arthur Bruno Caleb Conrad Damian Edgar Emil Felix Frank George Gustav Harold Henry Hugo Ian Isaac Jack Jonas Julian Karl Leo Louis Lukas Martin Max Miles Nathan Noel Oliver Oscar Otto Patrick Paul Philip Ralph Robert Simon Stefan Theodore Tobias Victor Walter William".split(),
    "f": "Ada Agnes Alice Amelia Anna Beatrice Bella Cara Clara Daphne Diana Edith Elena Ella Emma Erica Eva Flora Frida Greta Hannah Helena Ida Irene Iris Jane Julia Karen Laura Lena Lucy Maria Martha Mia Nina Nora Olga Paula Petra Rosa Ruth Sara Sofia Sylvia Thea Ursula Vera Wanda".split(),
    "n": "Alex Ariel Ashley Avery Blake Cameron Casey Charlie Dakota Dana Devon Drew Eden Ellis Emery Finley Frankie Harper Hayden Indigo Jamie Jesse Jordan Jules Kai Kelly Kim Lee Logan Marley Morgan Noel Parker Quinn Reese Riley Robin Rowan Sage Sam Sasha Shay Skyler Taylor".split(),
}
_LAST = "Abbott Barlow Becker Bishop Brandt Carver Castell Cole Dalton Draper Ekman Falk Farrow Fischer Garland Graves Hale Hartmann Holt Ibsen Jarvis Keller Kern Lang Lindqvist Lorenz Marsh Mercer Moreau Nash Norden Osborn Palmer Pike Quill Rademaker Reed Rossi Sanders Seidel Stone Tanner Thorne Ulrich Vance Vogel Ward Weaver Winter York Zeller".split()
_SYLLABLES = "ba be bi bo bu da de di do du fa fe fi ga ge go ha he ka ke ko la le li lo lu ma me mi mo mu na ne ni no pa pe po ra re ri ro ru sa se si so ta te ti to va ve vi wa we".split()

# Around each @: a search from the left would go over a long run of letters again from each of them.
_LOCAL = re.compile(r"[\w.+%-]+\Z")
_DOMAIN = re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63})+")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\b["']?\s*[=:]\s*["']?([A-Za-z0-9_\-+/=.]{8,})""")
_PREFIXED = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})\b")
_CARD = re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d.]\d|\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w|\.\d)")
_TITLE = regex.compile(r"(?<![\p{L}\p{N}])((?i:" + "|".join(sorted(_GENDER, key=len, reverse=True)) + r"))(?:\.\s{0,2}|\s{1,2})(?=\p{Lu})")
_NAME = regex.compile(r"\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*")
_LINK = regex.compile(r" (?:(?:de|del|la|las|los|van|von|der|den|di|da|dos|do|du|le|bin|al|el|zu|ter|ten) )*(?=\p{Lu})")
#: Titles that stand before names in lower case too.
_LOWER_TITLES = {"don", "doña", "señor", "señora", "señorita", "monsieur", "madame", "mademoiselle"}
#: Words that begin a sentence behind a name rather than continue the name.
_NOT_NAMES = set("a an and are as at but by for from had has have he her his i if in is it its not of on or she so that the their then there they this to was we were what when which who will with you der die das und ein eine er sie es im in den dem nicht el la los las un una y en que de se no le les et est il elle des du au ce".split())


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def detect(text: str) -> list[tuple[int, int, str, str, str | None]]:
    """(start, end, type, canonical value, role), in order, not overlapping; earlier types take precedence.

    role: for a name behind a title `last`, `first_m`, `first_f` or `first_n`, null for its other mentions and other types.
    """
    found: list[tuple[int, int, str, str, str | None]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if left and right:
            a = at - len(left.group())
            found.append((a, right.end(), "email", text[a : right.end()].rstrip(".").lower(), None))
        at = text.find("@", at + 1)
    for m in _SECRET.finditer(text) if "=" in text or ":" in text else ():
        found.append((m.start(1), m.end(1), "secret", m.group(1), None))
    if re.search(r"\d", text):
        found += [(m.start(), m.end(), "secret", m.group(), None) for m in _PREFIXED.finditer(text)]
        found += [(m.start(), m.end(), "iban", s, None) for m in _IBAN.finditer(text) if 15 <= len(s := m.group().replace(" ", "")) <= 34 and _iban_ok(s)]
        found += [(m.start(), m.end(), "card", re.sub(r"\D", "", m.group()), None) for m in _CARD.finditer(text)]
        found += [(m.start(), m.end(), "ssn", m.group(), None) for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "ip", m.group(), None) for m in _IP.finditer(text) if all(int(x) < 256 for x in m.group().split("."))]
        found += [(m.start(), m.end(), "phone", d, None) for m in _PHONE.finditer(text) if 7 <= len(d := re.sub(r"\D", "", m.group())) <= 15]
    found += _persons(text)
    # Accepted spans don't overlap, so each has one neighbour to look at on either side.
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for span in found:
        a, z = span[:2]
        k = bisect_right(starts, a)
        if (not k or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= z):
            starts.insert(k, a)
            ends.insert(k, z)
            out.append(span)
    return sorted(out)


def _bare(word: str) -> str:
    """A capitalised word without the ending of a possessive."""
    return word[:-2] if word[-2:].lower() in ("'s", "’s") and len(word) > 2 else word


def _canonical(name: str) -> str:
    return unicodedata.normalize("NFC", name).lower()


def _persons(text: str) -> list[tuple[int, int, str, str, str | None]]:
    """Each word of a name is an entity of its own, so 'Ms. Jane Roe', 'Ms. Roe' and 'Jane' stay one person. Names of any
    length are read behind a title, up to the next title, a possessive, or a word that is no name; particles stay."""
    titled: dict[int, tuple[int, int, str, str, str | None]] = {}
    passed = None  # the gender of a title that stands before another: Herr Dr. Meyer
    for m in _TITLE.finditer(text):
        title = m.group(1).lower()
        if not m.group(1)[0].isupper() and title not in _LOWER_TITLES:
            continue
        gender = _GENDER[title] if _GENDER[title] != "n" or not passed else passed
        at, words, passed = m.end(), [], None
        while n := _NAME.match(text, at):
            word = n.group()
            if word.lower() in _GENDER:
                passed = None if words else gender
                break
            if word.lower() in _NOT_NAMES:
                break
            at = n.end()
            if len(word) == 1 and text[at : at + 1] == ".":
                at += 1  # an initial
            else:
                words.append((n.start(), n.start() + len(_bare(word))))
                if words[-1][1] < at:
                    break
            link = _LINK.match(text, at)
            if not link:
                break
            at = link.end()
        for k, (a, z) in enumerate(words):
            titled[a] = (a, z, "name", _canonical(text[a:z]), "last" if k == len(words) - 1 else f"first_{gender}")
    if not titled:
        return []
    known, out = {t[3] for t in titled.values()}, list(titled.values())
    for n in _NAME.finditer(text):
        if n.start() not in titled:
            word = n.group() if _canonical(n.group()) in known else _bare(n.group())
            if _canonical(word) in known:
                out.append((n.start(), n.start() + len(word), "name", _canonical(word), None))
    return sorted(out)


class _Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n


_SCRIPTS = [(0x3B1, 0x3C9, 0x3C2), (0x430, 0x44F, None), (0x5D0, 0x5EA, None), (0x627, 0x64A, None), (0x905, 0x939, None), (0x4E00, 0x9FA5, None), (0x3041, 0x3096, None), (0x30A1, 0x30FA, None), (0xAC00, 0xD7A3, None)]


def _letter(c: str, d: _Draw) -> str:
    """Another letter of the same script and case."""
    low = c.lower()
    if not low.isalpha() or len(low) != 1:
        return c
    if ord(low) < 0x250:
        new = chr(97 + d.below(26))
    else:
        lo, hi, skip = next(((a, z, s) for a, z, s in _SCRIPTS if a <= ord(low) <= z), (0, 0, None))
        if not lo:
            return c
        new = chr(lo + d.below(hi - lo + 1))
        if skip and ord(new) == skip:
            new = chr(lo)
        if new == "ـ" or not new.isalpha():
            new = chr(lo)
    return new.upper() if c.isupper() and len(new.upper()) == 1 else new


def _shape(s: str, d: _Draw, first: str = "0123456789") -> str:
    """Digit for digit, letter for letter."""
    out, lead = [], True
    for c in s:
        if c.isdigit() and c.isascii():
            out.append(first[d.below(len(first))] if lead else str(d.below(10)))
            lead = False
        else:
            out.append(_letter(c, d))
    return "".join(out)


def _pronounce(d: _Draw, n: int) -> str:
    return "".join(_SYLLABLES[d.below(len(_SYLLABLES))] for _ in range(n))


#: Attempts in a space before a wider one is drawn from, and in all before values are traded.
WIDEN, ROUNDS = 12, 48


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical form of the replacement. kind: the type, for names their role."""
    d, wider = _Draw(key, kind, value, attempt), attempt // WIDEN
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        return _shape(local + "a" * (2 * wider), d) + "@" + ".".join([_shape(x, d) for x in labels[:-1]] + labels[-1:])
    if kind == "card":
        out = value[0] + "".join(str(d.below(10)) for _ in value[1:])
        want = _luhn(value)
        return next(x for k in range(10) if _luhn(x := out[:-1] + str((int(out[-1]) + k) % 10)) == want)
    if kind == "iban":
        body = _shape(value[4:], d).upper()
        rest = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{rest:02d}{body}"
    if kind == "ip":
        a, b, *_ = (int(x) for x in value.split("."))
        private = a in (10, 127) or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32)
        if a == 127 or (private and (a == 10 or wider)):
            head = [a if a == 127 else 10, d.below(256)]  # the largest private range holds for the smaller ones too
        elif private:
            head = [192, 168] if a == 192 else [172, 16 + d.below(16)]
        else:
            head = [x if (x := 11 + d.below(211)) not in (127, 172, 192) else 200, d.below(256)]
        return ".".join(map(str, [*head, d.below(256), 1 + d.below(254)]))
    if kind == "ssn":
        return f"{d.below(1000):03d}-{d.below(100):02d}-{d.below(10000):04d}" if wider else f"{100 + d.below(566):03d}-{1 + d.below(99):02d}-{1 + d.below(9999):04d}"
    if kind == "phone":
        # The country code can't be told from the digits alone; the leading digits that a code may take stay.
        keep = 0 if wider else max(0, len(value) - 10) or (1 if len(value) == 8 else 0)
        rest = value[keep:]
        return value[:keep] + str(2 + d.below(8)) + "".join(str(d.below(10)) for _ in rest[1:])
    if kind == "secret":
        longer = value + value[-1] * (4 * wider)
        return _hex(longer, d) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else longer[: _prefix(value)] + _shape(longer[_prefix(value) :], d)
    if ord(value[0]) >= 0x250:
        return _shape(value + value[-1] * wider, d)  # a name in another script stays in it
    pool = _LAST if kind == "last" else _FIRST[kind[-1]]
    if attempt < 4:
        return pool[d.below(len(pool))].lower()
    return _pronounce(d, 2 + wider) + {"first_f": "na", "first_m": "ron", "last": "sen"}.get(kind, "lin")


def _hex(value: str, d: _Draw) -> str:
    digits = "0123456789ABCDEF" if re.search("[A-F]", value) else "0123456789abcdef"
    return "".join(digits[d.below(16)] for _ in value)


def _prefix(value: str) -> int:
    m = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-", value)
    return m.end() if m else 0


def render(surface: str, kind: str, canonical: str) -> str:
    """The surrogate in the mention's own spelling."""
    if kind in ("card", "phone"):
        digits = iter(canonical)
        return "".join(next(digits, c) if c.isdigit() else c for c in surface)
    if kind == "iban":
        chars = iter(canonical)
        return "".join(next(chars, c) if c != " " else c for c in surface)
    if kind == "email":
        if surface.isupper():
            canonical = canonical.upper()
        return canonical + surface[len(surface.rstrip(".")) :]
    if kind == "name":
        return canonical.upper() if len(surface) > 1 and surface.isupper() else canonical[:1].upper() + canonical[1:]
    return canonical


_SPANS = "array<struct<start:int,stop:int,kind:string,value:string,role:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("role", pa.string())]))


def roles(mentions: DataFrame) -> DataFrame:
    """(kind, value, form) of distinct entities: form is the kind, or for a name its role and gender over all mentions.

    A name is a last name if it is one in as many documents as it is a first name. A first name that both genders bear, or
    only neutral titles, is neutral. mentions: (kind, value, role), one a document and role.
    """
    has = lambda role: F.count_if(F.col("role") == role)
    by = mentions.groupBy("kind", "value").agg(has("last").alias("last"), has("first_m").alias("m"), has("first_f").alias("f"), has("first_n").alias("n"))
    first = F.when((F.col("m") > 0) & (F.col("f") == 0), F.lit("first_m")).when((F.col("f") > 0) & (F.col("m") == 0), F.lit("first_f")).otherwise(F.lit("first_n"))
    return by.select("kind", "value", F.when(F.col("kind") != "name", F.col("kind")).when(F.col("last") >= F.col("m") + F.col("f") + F.col("n"), F.lit("last")).otherwise(first).alias("form"))


def assign(entities: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value, form): different within a kind, and, but for those that trade
    values after `rounds` attempts, none an entity itself."""

    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [surrogate(key, f, v, attempt) for f, v in zip(b.column("form").to_pylist(), b.column("value").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), pa.array(made, pa.string())], ["kind", "value", "surrogate"])

        return run

    out = "kind string, value string, surrogate string"
    done: DataFrame | None = None
    pending, left = entities, entities.count()
    for attempt in range(rounds):
        if not left:
            break
        cand = pending.mapInArrow(draw(attempt), out)
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        free = cand.join(taken, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        won = materialize(won)
        # One table again every few rounds, so that plans stay small.
        done = won if done is None else materialize(done.unionByName(won)) if attempt % 8 == 7 else done.unionByName(won)
        pending = materialize(pending.join(won, ["kind", "value"], "left_anti"))
        left = pending.count()
    if left:
        # Rings of about 100,000 values in keyed order; a value alone in its ring gets a token of no other form.
        ring = F.pmod(F.xxhash64(F.lit(key), "value"), F.lit(1 + left // 100_000))
        order = Window.partitionBy("kind", ring).orderBy(F.xxhash64(F.lit(key), F.lit(1), "value"), "value")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        other = F.coalesce(F.lead("value").over(order), F.first("value").over(every))
        token = F.concat(F.lit("x"), F.sha2(F.concat(F.lit(key), F.encode("value", "utf-8")), 256))
        traded = pending.select("kind", "value", F.when(other == F.col("value"), token).otherwise(other).alias("surrogate"))
        done = traded if done is None else done.unionByName(traded)
    return done if done is not None else entities.sparkSession.createDataFrame([], out)


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_entities, kinds (sorted, comma-joined), text with every entity replaced.

    Null and empty texts have no entities and come back as the empty text. Rows that repeat are treated each, with the same
    surrogates. A null doc_id stays null. An empty table gives no rows; further columns are not read.
    """
    base = doc_text(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                spans = [[dict(zip(("start", "stop", "kind", "value", "role"), x)) for x in detect(t)] for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "text", "spans"])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kinds, texts = [], [], []
            for t, spans, pairs in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "pairs"))):
                to, out, at = {(p["kind"], p["value"]): p["surrogate"] for p in pairs}, [], 0
                for x in spans:
                    out += [t[at : x["start"]], render(t[x["start"] : x["stop"]], x["kind"], to[x["kind"], x["value"]])]
                    at = x["stop"]
                texts.append("".join([*out, t[at:]]))
                counts.append(len(spans))
                kinds.append(",".join(sorted({x["kind"] for x in spans})))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_entities", "kinds", "text"])

    found = materialize(base.mapInArrow(find, f"doc_id long, text string, spans {_SPANS}").withColumn("row", F.monotonically_increasing_id()))
    hit = found.filter(F.size("spans") > 0)
    each = materialize(hit.select("row", F.explode("spans").alias("m")).select("row", "m.kind", "m.value", "m.role").distinct())
    table = assign(materialize(roles(each)), key)
    own = each.select("row", "kind", "value").distinct().withColumn("salt", salt(F.col("row")))
    pairs = own.join(replicated(table), ["kind", "value", "salt"]).groupBy("row").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("pairs"))
    replaced = hit.join(pairs, "row").select("doc_id", "text", "spans", "pairs").mapInArrow(replace, "doc_id long, n_entities long, kinds string, text string")
    clean = found.filter(F.size("spans") == 0).select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"), "text")
    return clean.unionByName(replaced)
