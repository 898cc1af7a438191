"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Tokens per (source, language, topic) cell are raked. A cell's inclusion probability is the product of one factor of its
source, one of its language and one of its topic, at most 1. The factors are fitted in turn until the expected tokens kept
meet the target share of every source, language and topic: a source's factor is solved exactly with the bound of 1 in
force, those of languages and topics are scaled. The share of tokens to keep is a ceiling: where some source, language or
topic has too few tokens for its target, it is lowered to what the targets allow, and the targets hold.

Cost: one pass reads the texts and writes narrow rows; the cells are one aggregation with map-side combining. A round is one
pass over the cells, grouped by source; only sums by (language, topic) reach the driver, which holds these two label sets'
pairs and nothing that grows with sources or rows. Up to MAX_CELLS cells the same rounds run on the driver, on the same
blocks and by the same rule. The probabilities are broadcast within that bound and joined salted beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, replicated, salt, ship

#: Cells whose table may come to the driver and be broadcast; each is under 1 KB.
MAX_CELLS = 20_000
AXES = ("source", "lang", "topic")
#: Target of each axis: its observed token shares to this power, normalised. 1 leaves them, 0 makes them equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Marginals hold within this share of the tokens kept; rounds end when they do, or when PATIENCE rounds gain under 1 in 1000.
TOLERANCE, PATIENCE = 1e-9, 30
#: A value of an axis is asked for at most this share of its tokens, so that its cells need not all be certain.
ROOM = 0.95


def topic_of(text: Column) -> Column:
    """A document's topic by what its text holds; first rule wins."""
    return (
        F.when(text.rlike(r"[0-9]{4}|[0-9]@|@[a-z]"), "records").when(text.contains(" | "), "listing").when(F.octet_length(text) < 600, "short").when(F.octet_length(text) < 6000, "article").otherwise("long")
    )


class Block:
    """Cells of some sources: tokens and (language, topic) number, one source after another."""

    def __init__(self, rows: list[dict]) -> None:
        self.sources = [r["source"] for r in rows]
        many = np.array([len(r["lt"]) for r in rows])
        self.first = np.concatenate(([0], np.cumsum(many)[:-1])).astype(np.int64)
        self.of = np.repeat(np.arange(len(rows)), many)
        self.lt = np.array([x for r in rows for x in r["lt"]], np.int64)
        self.tokens = np.array([x for r in rows for x in r["tokens"]], float)
        self.total = np.add.reduceat(self.tokens, self.first)

    def fit(self, factor: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Probabilities of the cells: min(1, a * factor) with the a of each source that makes its expected tokens the goal,
        or 1 where it has no more. Each step fixes the cells at 1 and solves for the rest, which only ever raises a."""
        x = factor[self.lt]
        a = goal / np.add.reduceat(self.tokens * x, self.first)
        while True:
            full = a[self.of] * x >= 1
            free, fixed = np.add.reduceat(np.where(full, 0.0, self.tokens * x), self.first), np.add.reduceat(np.where(full, self.tokens, 0.0), self.first)
            new = np.maximum(a, np.divide(goal - fixed, free, out=np.where(goal > fixed, np.inf, a), where=free > 0))
            if (new <= a * (1 + 1e-12)).all():
                with np.errstate(invalid="ignore"):
                    return np.minimum(1.0, np.where(np.isinf(new[self.of]), 1.0, new[self.of] * x))
            a = new

    def expected(self, factor: np.ndarray, keep: float, power: float, whole: float) -> np.ndarray:
        """Expected tokens by (language, topic). keep: tokens to keep in all; a source's goal is its share of `whole`."""
        return np.bincount(self.lt, self.tokens * self.fit(factor, keep * self.total**power / whole), len(factor))


class Cells:
    """The cell table in blocks: held here when small, left where it is otherwise. What it computes is the same."""

    def __init__(self, cells: DataFrame, powers: dict[str, float], max_cells: int) -> None:
        self.power = powers["source"]
        cells = cells.filter("tokens > 0")
        pairs = sorted(cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect(), key=lambda r: (str(r["lang"]), r["lang"] is None, str(r["topic"])))
        self.names = [(r["lang"], r["topic"]) for r in pairs]
        langs, topics = sorted({n[0] for n in self.names}, key=lambda v: (str(v), v is None)), sorted({n[1] for n in self.names})
        self.lang, self.topic = np.array([langs.index(n[0]) for n in self.names], np.int64), np.array([topics.index(n[1]) for n in self.names], np.int64)
        seen = np.array([r["tokens"] for r in pairs], float)
        self.total = seen.sum()
        self.goal_lang, self.goal_topic = _goal(np.bincount(self.lang, seen), powers["lang"]), _goal(np.bincount(self.topic, seen), powers["topic"])
        number = {n: i for i, n in enumerate(self.names)}
        by = cells.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.struct("lang", "topic").alias("at"), "tokens"))).alias("cells"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("cells").to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([[number[c["at"]["lang"], c["at"]["topic"]] for c in cs] for cs in lists], pa.list_(pa.int64())), pa.array([[c["tokens"] for c in cs] for cs in lists], pa.list_(pa.int64()))], ["source", "lt", "tokens"])

        self.table = materialize(by.mapInArrow(pack, "source string, lt array<long>, tokens array<long>"))
        per = self.table.select(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, b: a + b).cast("double").alias("t"), F.size("lt").alias("n"))
        n, self.whole, least = per.agg(F.sum("n"), F.sum(F.pow("t", F.lit(self.power))), F.min(F.pow("t", F.lit(1 - self.power)))).first()
        self.small = (n or 0) <= max_cells
        self.block = Block([r.asDict() for r in self.table.collect()]) if self.small and n else None
        self.n = n or 0
        if n:
            # The largest share of tokens at which no value's goal exceeds what it has.
            self.most = min(least * self.whole / self.total, *(np.bincount(self.lang, seen) / self.total / self.goal_lang), *(np.bincount(self.topic, seen) / self.total / self.goal_topic))

    def expected(self, factor: np.ndarray, keep: float) -> np.ndarray:
        if self.block:
            return self.block.expected(factor, keep, self.power, self.whole)
        power, whole = self.power, self.whole

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([Block(b.to_pylist()).expected(factor, keep, power, whole)], pa.list_(pa.float64()))], ["sums"])

        parts = self.table.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(factor))
        for r in parts:
            out[r["at"]] = r["x"]
        return out

    def rake(self, keep: float) -> tuple[np.ndarray, bool]:
        """(factor of each (language, topic), whether all marginals hold) for `keep` expected tokens."""
        b, c = np.ones(len(self.goal_lang)), np.ones(len(self.goal_topic))
        best, stale = np.inf, 0
        while True:
            factor = b[self.lang] * c[self.topic]
            now = self.expected(factor, keep) / keep
            by_lang, by_topic = np.bincount(self.lang, now), np.bincount(self.topic, now)
            worst = max(np.abs(by_lang - self.goal_lang).max(), np.abs(by_topic - self.goal_topic).max())
            if worst < TOLERANCE:
                return factor, True
            best, stale = (worst, 0) if worst < best * 0.999 else (best, stale + 1)
            if stale >= PATIENCE:
                return factor, False
            step = self.goal_lang / by_lang
            b = b * step
            c = c * self.goal_topic / np.bincount(self.topic, now * step[self.lang])
            b, c = b / b.max(), c / c.max()

    def probabilities(self, budget: float) -> tuple[DataFrame, float]:
        """(source, lang, topic, probability of every cell; share of tokens kept)."""
        share = min(budget, ROOM * self.most)
        factor, holds = self.rake(share * self.total)
        if not holds:
            # Targets that hold for a small sample are worth a smaller one; those that contradict each other never hold.
            possible = self.rake(share * self.total / 1024)[1]
            while possible and not holds:
                share *= 0.9
                factor, holds = self.rake(share * self.total)
        keep, power, whole, names = share * self.total, self.power, self.whole, self.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield _table(Block(b.to_pylist()))

        def _table(block: Block) -> pa.RecordBatch:
            p = np.round(block.fit(factor, keep * block.total**power / whole), 7)
            at = [names[i] for i in block.lt]
            return pa.RecordBatch.from_arrays([pa.array([block.sources[i] for i in block.of], pa.string()), pa.array([x for x, _ in at], pa.string()), pa.array([x for _, x in at], pa.string()), pa.array(p)], ["source", "lang", "topic", "probability"])

        schema = "source string, lang string, topic string, probability double"
        if self.block:
            return self.table.sparkSession.createDataFrame(pa.Table.from_batches([_table(self.block)]), schema), share
        return materialize(self.table.mapInArrow(run, schema)), share


def _goal(tokens: np.ndarray, power: float) -> np.ndarray:
    raised = tokens**power
    return raised / raised.sum()


def uniform(id_: Column, fallback: Column, seed: int) -> Column:
    """A number in [0, 1) that only the row's key and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(id_, fallback)), 11) / F.lit(float(1 << 53))


def probabilities(rows: DataFrame, powers: dict[str, float], budget: float, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool, float]:
    """(cell table with probability, whether it is within the bound for a broadcast, share of tokens kept). rows: the axes
    and tokens. Cells without tokens are not in the table."""
    ship(rows.sparkSession)
    cells = Cells(materialize(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))), powers, max_cells)
    if not cells.n:
        return rows.sparkSession.createDataFrame([], "source string, lang string, topic string, probability double"), True, 0.0
    table, share = cells.probabilities(budget)
    return table, cells.small, share


def attach(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows with their cell's probability; null axes are values of their own."""
    named = table.select(*[F.col(a).alias(f"_{a}") for a in AXES], "probability")
    if small:
        named, extra = F.broadcast(named), F.lit(True)
    else:
        rows = rows.withColumn("_salt", salt(F.col("u")))
        named = replicated(named).withColumnRenamed("salt", "_salt2")
        extra = F.col("_salt") == F.col("_salt2")
    on = extra
    for a in AXES:
        on = on & F.col(a).eqNullSafe(F.col(f"_{a}"))
    return rows.join(named, on, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))


Topic = Callable[[Column], Column]


def mix(docs: DataFrame, budget: float = 0.7, seed: int = 11, powers: dict[str, float] = POWERS, topic: Topic = topic_of, max_cells: int = MAX_CELLS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, tokens, probability, kept.

    tokens: words of the text, split at ASCII white space; null counts as the empty text. topic gives the topic of a text
    column. budget: the most of all tokens to keep; less are kept where a target could not be met otherwise. Where the
    targets contradict each other whatever is kept (a language that only one source has, say), sources meet theirs and the
    others come as near as the rounds bring them. kept is drawn by a hash of doc_id and seed (rows without a doc_id: of the
    text), so repeated rows share it and partitioning doesn't matter. Null source and lang are values of their own. Cells
    without tokens are kept whole. An empty table gives no rows.
    """
    rows = materialize(_measured(docs, seed, topic, id_col, text_col, lang_col, source_col))
    table, small, _ = probabilities(rows, powers, budget, max_cells)
    return attach(rows, table, small).select("doc_id", *AXES, "tokens", "probability", (F.col("u") < F.col("probability")).alias("kept"))


def reached(mixed: DataFrame, powers: dict[str, float] = POWERS) -> DataFrame:
    """(axis, value, observed, target, expected): token shares before, asked for, and expected of what mix() keeps."""
    out = None
    for axis in AXES:
        by = mixed.groupBy(F.col(axis).alias("value")).agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("k")).filter("t > 0")
        whole = by.agg(F.sum("t").alias("t0"), F.sum("k").alias("k0"), F.sum(F.pow("t", F.lit(powers[axis]))).alias("g0"))
        one = by.join(F.broadcast(whole)).select(F.lit(axis).alias("axis"), "value", (F.col("t") / F.col("t0")).alias("observed"), (F.pow("t", F.lit(powers[axis])) / F.col("g0")).alias("target"), (F.col("k") / F.col("k0")).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def _measured(docs: DataFrame, seed: int, topic: Topic, id_col: str, text_col: str, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), topic(text).cast("string").alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), uniform(F.col(id_col).cast("long"), F.xxhash64(text), seed).alias("u"), *more,
    )


def sample(docs: DataFrame, budget: float = 0.7, seed: int = 11, powers: dict[str, float] = POWERS, topic: Topic = topic_of, max_cells: int = MAX_CELLS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that mix() keeps, with all their columns as they are. While the cell table is within its bound, no
    text is moved."""
    columns = (topic, id_col, text_col, lang_col, source_col)
    table, small, _ = probabilities(_measured(docs, seed, *columns), powers, budget, max_cells)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return attach(_measured(docs, seed, *columns, every), table, small).filter(F.col("u") < F.col("probability")).select("_row.*")
