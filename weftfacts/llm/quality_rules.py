"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Every text becomes a vector of transformed statistics in fixed point. Per (language, source) the minimum covariance
determinant is sought by concentration steps: distances are binned, the bins that hold the closest `support` share of the
rows form the subset, and its exact integer moments give the next mean and scatter. There are three starts (median and MAD;
the spatial signs; bounded scores), two steps from each, and the start with the lowest determinant goes on until its
determinant no longer falls. Rows beyond the cutoff Mahalanobis distance are rejected. The cutoff comes from the group's own
distances: a scaled chi-square law that has their lower quartile and median, cut at its quantile 1 - tail. Outliers, up to
the quarter that the estimate bears, hardly move the two; the law's degrees of freedom follow, since FLOOR leaves less than
D to vary.

A group's estimate is drawn towards that of its language, and the language's towards the table's, with the weight of `prior`
rows, the table's towards a wide fixed law: so small groups are measured too, and no size switches anything.

Cost: one pass over the texts writes a narrow table; every step is one aggregation of it with map-side combining into at
most BINS rows a group, so a group with a third of all rows is never gathered. Moments are sums of integers, hence equal
whatever the partitioning. Group parameters are one row a group; they are joined back salted.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize, replicated, salt, ship, text_bytes

_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\r\x0b\x0c"
_CAPITALS = bytes(range(65, 91))
_CONT = bytes(range(0x80, 0xC0))
#: The statistics of the vector, each transformed towards symmetry and scaled to integers by FIXED.
FEATURES = ("log_words", "log_word_len", "symbols", "dup_lines", "repeats", "line_len", "distinct", "capitals")
D = len(FEATURES)
FIXED = 1024
BINS = 256


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    counts = Counter(zip(words, words[1:], words[2:]))
    if len(counts) == n:
        return 0
    hit = np.fromiter(map(counts.__getitem__, zip(words, words[1:], words[2:])), np.int64, n) > 1
    cover = np.zeros(n + 2, bool)
    for k in range(3):
        cover[k : k + n] |= hit
    return int(cover.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, distinct words, letters A-Z."""
    words = text.split()
    solid = text.translate(None, _WHITE)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words), len(solid.translate(None, _CONT)), len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), _repeat_words(words), len(lines), len(set(words)), len(text) - len(text.translate(None, _CAPITALS)),
    )


def features(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat: int, n_lines: int, n_distinct: int, n_capitals: int) -> tuple[int, ...]:
    """The transformed vector, in units of 1/FIXED; logs for sizes, square roots for shares."""
    w = max(n_words, 1)
    x = (math.log1p(n_words), math.log1p(word_chars / w), math.sqrt(n_symbols / w), math.sqrt(n_dup_lines / max(n_lines, 1)), math.sqrt(n_repeat / w), math.log1p(n_words / max(n_lines, 1)), math.log(n_distinct / w) if n_words else 0.0, math.sqrt(n_capitals / max(word_chars, 1)))
    return tuple(round(FIXED * v) for v in x)


_NARROW = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"x{i} long" for i in range(D))


def _measure(piece: pa.RecordBatch) -> pa.RecordBatch:
    rows = [text_stats(t) for t in text_bytes(piece.column("text"))]
    stats = np.array(rows, np.int64).reshape(-1, 8)
    x = np.array([features(*r) for r in rows], np.int64).reshape(-1, D)
    cols = [pa.array(np.ascontiguousarray(stats[:, i])) for i in range(5)] + [pa.array(np.ascontiguousarray(x[:, i])) for i in range(D)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"x{i}" for i in range(D))]
    return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("lang"), piece.column("source"), *cols], ["doc_id", "lang", "source", *names])


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_I, _J = np.array(_PAIRS).T
_TWICE = np.where(_I == _J, 1.0, 2.0)
_NAMES = ["g", "s", "n", "logdet", "m", "p"]
_PARAMS = "g string, s int, n long, logdet double, m array<double>, p array<double>"
_ARROW = {"g": pa.string(), "s": pa.int32(), "n": pa.int64(), "logdet": pa.float64(), "m": pa.list_(pa.float64()), "p": pa.list_(pa.float64()), "cutoff": pa.float64()}
#: Least spread of a statistic, in its own unit: a statistic that is constant in a group must not reject by rounding.
FLOOR = np.array([0.25, 0.05, 0.05, 0.05, 0.05, 0.25, 0.05, 0.05])
#: Spread that a table without rows would have, in FLOORs.
WIDE = 8.0
#: Fixed point of the starts' products.
UNIT = 1 << 20
#: Value bins a unit for the medians.
STEP = 64


def _params(g: str, s: int, n: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    return g, s, n, float(np.linalg.slogdet(cov)[1]), mean, np.linalg.inv(cov)[_I, _J] * _TWICE


def _square(upper: np.ndarray) -> np.ndarray:
    full = np.zeros((D, D))
    full[_I, _J] = full[_J, _I] = upper
    return full


def _map_rows(df: DataFrame, make: Callable[[dict], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """mapInArrow over rows of group parameters: make(row) gives the rows that replace it; lists come as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {}
            for c in batch.schema.names:
                col = batch.column(c)
                if pa.types.is_list(col.type):
                    flat, ends = col.flatten(), col.offsets.to_numpy() - col.offsets[0].as_py()
                    if pa.types.is_struct(flat.type):
                        parts = {f.name: x for f, x in zip(flat.type, flat.flatten())}
                        values = {k: (x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if pa.types.is_list(x.type) and len(x) else x.to_numpy(zero_copy_only=False)) for k, x in parts.items()}
                        columns[c] = [{k: v[a:z] for k, v in values.items()} for a, z in zip(ends, ends[1:])]
                    else:
                        values = flat.to_numpy(zero_copy_only=False)
                        columns[c] = [values[a:z] for a, z in zip(ends, ends[1:])]
                else:
                    columns[c] = col.to_pylist()
            out = [r for k in range(batch.num_rows) for r in make({c: v[k] for c, v in columns.items()})]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), _ARROW[c]) for x, c in zip(zip(*out), names)], names)

    return df.mapInArrow(run, schema)


def _starts(row: dict) -> list[tuple]:
    """The starts of one group: its median and MAD, and the same with the correlations of its spatial signs and of its
    bounded scores."""
    mean, spread = row["med"] / STEP, np.sqrt((1.4826 * row["mad"] / STEP) ** 2 + FLOOR**2)
    out = [_params(row["g"], 0, row["n"], mean, np.diag(spread**2))]
    for s, kind in ((1, "signs"), (2, "scores")):
        c = _square(row[kind] / UNIT / row["n"]) + np.eye(D) * 1e-3
        scale = spread / np.sqrt(np.diag(c))
        out.append(_params(row["g"], s, row["n"], mean, c * np.outer(scale, scale)))
    return out


def _flat(params: DataFrame, *more: str) -> DataFrame:
    """Parameters with one column a number, which is what generated code reads fastest."""
    return params.selectExpr("g", "s", "n", *more, *[f"m[{i}] AS m{i}" for i in range(D)], *[f"p[{k}] AS p{i}_{j}" for k, (i, j) in enumerate(_PAIRS)])


_Z = [f"(x{i} / {FIXED}D - m{i})" for i in range(D)]


def _distance() -> Column:
    """Squared Mahalanobis distance of the row to its group's current estimate."""
    return F.expr(" + ".join(f"p{i}_{j} * {_Z[i]} * {_Z[j]}" for i, j in _PAIRS))


def _bin(d2: Column) -> Column:
    """Logarithmic bin of a distance: 16 bins a doubling, from 2^-4 up."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * 16 + 64), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _concentrate(support: float):
    """One step: the closest `support` share of a group by bins, and its mean and scatter with a consistency factor."""

    def make(row: dict) -> list[tuple]:
        bins = row["bins"]
        counts, sums = bins["n"], bins["sums"].astype(float)
        n = int(counts.sum())
        upto = int(np.searchsorted(np.cumsum(counts), math.ceil(support * n))) + 1
        h = int(counts[:upto].sum())
        total = sums[:upto].sum(0) / h
        mean = total[:D] / FIXED
        cov = _square(total[D:] / FIXED**2) - np.outer(mean, mean)
        return [_params(row["g"], row["s"], n, mean, cov * _consistency(round(h / n, 3)) + np.diag(FLOOR**2))]

    return make


def _chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma by its series."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, 1000):
        term *= x / (a + n)
        total += term
        if term < total * 1e-14:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(64):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


@functools.lru_cache(maxsize=2048)
def _consistency(share: float) -> float:
    if share >= 1:
        return 1.0
    q = chi2_quantile(share, D)
    return share / _chi2_cdf(q, D + 2)


def mcd(narrow: DataFrame, support: float = 0.75) -> DataFrame:
    """Parameters per group `g`: n, log determinant, means m, and precision p. narrow: g, doc_id, x0..x7 as integers."""
    bins = [f"floor(x{i} * {STEP} / {FIXED}) AS b{i}" for i in range(D)]
    med = materialize(narrow.selectExpr("g", *bins).groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.median(f"b{i}").alias(f"med{i}") for i in range(D)]))
    mad = materialize(with_params(narrow.selectExpr("g", "doc_id", *bins), med).groupBy("g", "n", *[f"med{i}" for i in range(D)]).agg(*[F.expr(f"median(abs(b{i} - med{i}))").alias(f"mad{i}") for i in range(D)]))
    z = [f"(x{i} / {FIXED}D - med{i} / {STEP}) / sqrt(pow(mad{i} * {1.4826 / STEP}D, 2) + {FLOOR[i] ** 2}D) AS z{i}" for i in range(D)]
    scored = with_params(narrow, mad).selectExpr("g", *z).selectExpr("*", f"greatest({' + '.join(f'z{i} * z{i}' for i in range(D))}, 1e-9D) AS norm", *[f"tanh(z{i}) AS t{i}" for i in range(D)])
    fixed = lambda terms: F.expr("array(" + ", ".join(f"sum(cast(round({t} * {UNIT}) AS bigint))" for t in terms) + ")")
    moments = scored.groupBy("g").agg(fixed(f"z{i} * z{j} / norm" for i, j in _PAIRS).alias("signs"), fixed(f"t{i} * t{j}" for i, j in _PAIRS).alias("scores"))
    middle = mad.select("g", "n", F.array(*[f"med{i}" for i in range(D)]).alias("med"), F.array(*[f"mad{i}" for i in range(D)]).alias("mad"))
    active = materialize(_map_rows(middle.join(moments, "g"), _starts, _NAMES, _PARAMS))

    sums = F.expr("array(" + ", ".join([f"sum(x{i})" for i in range(D)] + [f"sum(x{i} * x{j})" for i, j in _PAIRS]) + ")").alias("sums")

    def step(params: DataFrame) -> DataFrame:
        placed = with_params(narrow, _flat(params)).withColumn("bin", _bin(_distance()))
        by = placed.groupBy("g", "s", "bin").agg(F.count(F.lit(1)).alias("n"), sums)
        rows = by.groupBy("g", "s").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "sums"))).alias("bins"))
        return materialize(_map_rows(rows, _concentrate(support), _NAMES, _PARAMS))

    lowest = lambda t: t.groupBy("g").agg(F.min_by(F.struct(*t.columns), F.struct("logdet", "s")).alias("best")).select("best.*")
    best = materialize(lowest(step(step(active))))
    done, active = None, best
    while not active.isEmpty():
        # Groups whose determinant still falls go on; it is bounded below by that of FLOOR, so this ends.
        old = active.select("g", F.col("logdet").alias("before"), F.struct(*_NAMES).alias("old"))
        new = materialize(step(active).join(old, "g"))
        falls = F.col("logdet") < F.col("before") - 1e-3
        settled = materialize(new.filter(~falls).select("old.*"))
        done = settled if done is None else done.unionByName(settled)
        active = materialize(new.filter(falls).select(*_NAMES))
    return best if done is None else done


def _law(tail: float) -> np.ndarray:
    """Rows of (lower quartile over median, 1 / median, quantile 1 - tail) of chi-square laws of 1 to D degrees of freedom."""
    rows = []
    for k in np.arange(1, D + 0.25, 0.25):
        mid = chi2_quantile(0.5, k)
        rows.append((chi2_quantile(0.25, k) / mid, 1 / mid, chi2_quantile(1 - tail, k)))
    return np.array(rows).T


def _cut(tail: float):
    """The cutoff of one group from the bins of its distances."""
    ratio, unit, far = _law(tail)

    def make(row: dict) -> list[tuple]:
        bins, upto = row["bins"]["bin"], np.cumsum(row["bins"]["n"])
        low, mid = (2 ** ((bins[np.searchsorted(upto, q * upto[-1])] + 0.5 - 64) / 16) for q in (0.25, 0.5))
        at = np.interp(low / mid, ratio, np.arange(len(ratio)))
        k = np.arange(len(ratio))
        # FLOOR is given and not estimated: within its spread a row is never far, however close its group lies.
        return [(row["g"], float(max(far[0], mid * np.interp(at, k, unit) * np.interp(at, k, far))))]

    return make


def with_cutoff(narrow: DataFrame, params: DataFrame, tail: float) -> DataFrame:
    """The parameters with the cutoff of the squared distance of each group."""
    placed = with_params(narrow, _flat(params)).select("g", _bin(_distance()).alias("bin"))
    by = placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    return materialize(params.join(_map_rows(by, _cut(tail), ["g", "cutoff"], "g string, cutoff double"), "g"))


def _drawn(tail: float, prior: float):
    """Parameters of one group, drawn towards its language's, those towards the table's, and those towards the wide law."""
    far = math.log(chi2_quantile(1 - tail, D))

    def make(row: dict) -> list[tuple]:
        mean, cov, cutoff = None, np.diag((WIDE * FLOOR) ** 2), far
        for end in ("_table", "_lang", ""):
            w = row["n" + end] / (row["n" + end] + prior)
            m, c = row["m" + end], np.linalg.inv(_square(row["p" + end] / _TWICE))
            mean = m if mean is None else w * m + (1 - w) * mean
            cov, cutoff = w * c + (1 - w) * cov, w * math.log(row["cutoff" + end]) + (1 - w) * cutoff
        return [(*_params(row["g"], 0, row["n"], mean, cov), math.exp(cutoff))]

    return make


def with_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Each row with its group's parameters; both sides salted, so that no group is one task. Spark broadcasts the
    parameters by itself when their written size is under its threshold."""
    return rows.withColumn("salt", salt(F.coalesce("doc_id", F.lit(0)))).join(replicated(params), ["g", "salt"]).drop("salt")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_words: int = 50, max_repeat_percent: int = 50, support: float = 0.75, tail: float = 1e-9, prior: float = 200,
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    base_failed: under min_words words, or over max_repeat_percent of the words in repeated 3-word windows. Rows that
    pass are measured against their (lang, source) group's estimate and kept unless the squared distance exceeds the
    group's cutoff, the quantile 1 - tail of the law of its distances; both are drawn towards those of the language and of
    the table with the weight of `prior` rows. Null lang and source are groups of their own. distance is null for rows that
    failed. Null and empty texts have no words and fail. Repeated rows each count. An empty table gives no rows; further
    columns are not read.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    narrow = map_text(base, _measure, _NARROW)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    narrow = materialize(narrow.withColumn("base_failed", failed))
    # JSON text of the pair tells null from any string.
    pair, lang = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}), F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    grouped = materialize(narrow.filter(~F.col("base_failed")).withColumn("g", pair).withColumn("g1", lang))
    every = grouped.select(F.explode(F.array("g", "g1", F.lit("*"))).alias("g"), "doc_id", *[f"x{i}" for i in range(D)])
    raw = with_cutoff(every, mcd(every, support), tail)
    named = lambda end: raw.select(*[F.col(c).alias(c + end) for c in raw.columns])
    level = raw.join(grouped.select("g", "g1").distinct(), "g").join(named("_lang"), F.col("g1") == F.col("g_lang")).join(named("_table").filter("g_table = '*'"), F.col("g_table") == F.lit("*"))
    params = materialize(_map_rows(level, _drawn(tail, prior), [*_NAMES, "cutoff"], _PARAMS + ", cutoff double"))
    measured = with_params(grouped, _flat(params, "cutoff")).withColumn("distance", _distance())
    stats = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measured = measured.select(*stats, F.round("distance", 6).alias("distance"), (F.col("distance") <= F.col("cutoff")).alias("kept"))
    rest = narrow.filter("base_failed").select(*stats, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return measured.unionByName(rest)
