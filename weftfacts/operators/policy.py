"""What happens to findings: configuration, suppression, deduplication, baseline, diff and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEIGHTS = {"error": 10, "warning": 3, "info": 1}
CAPACITY = 50


def category(rule_id: Column) -> Column:
    return F.substring_index(rule_id, "/", 1)


def configure(findings: DataFrame, levels: dict[str, str], practice: bool = True, preset: bool = True) -> DataFrame:
    """Rule levels replace severities; `off` drops the rule. The levels are literals: no join. Without practice its rules go;
    without a preset only configured rules stay. Findings of the engine itself (category analysis) are left as they are."""
    own = category(F.col("rule_id")) == "analysis"
    if not practice:
        findings = findings.filter(category(F.col("rule_id")) != "practice")
    level = F.try_element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), F.col("rule_id")) if levels else F.lit(None).cast("string")
    if not preset:
        findings = findings.filter(own | level.isNotNull())
    return findings.withColumn("severity", F.when(own, F.col("severity")).otherwise(F.coalesce(level, F.col("severity")))).filter("severity <> 'off'")


def suppress(findings: DataFrame, directives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the findings that stay, the disabling directives that hid nothing: file_id, rule_id, severity, offset, line).

    directives: file_id, line, action (disable-next-line, disable, enable), rules (none: all), offset. A finding is hidden by
    a disable-next-line on the line before it, or when the last disable or enable on or before its line that concerns its
    rule is a disable; of two on one line the later counts. Findings and directives are united and each finding looks back
    in two windows, (file, line) for directives that concern all rules and (file, rule, line) for those that name it: no
    finding meets all directives of its file.
    """
    columns = findings.columns
    d = directives.select("file_id", "line", "action", "offset", F.when(F.coalesce(F.size("rules"), F.lit(0)) > 0, F.col("rules")).alias("rules"))
    # A next-line directive lies on the line it acts on; what it hides must lie there too.
    at = F.when(F.col("action") == "disable-next-line", F.col("line") + 1).otherwise(F.col("line")).cast("long")
    one = F.struct(at.alias("line"), F.col("offset").cast("long").alias("offset"), (F.col("action") == "enable").alias("enable"))
    block, following = F.when(F.col("action") != "disable-next-line", one), F.when(F.col("action") == "disable-next-line", one)
    lanes = {"all": d.filter("rules IS NULL").withColumn("rule", F.lit(None).cast("string")), "own": d.filter("rules IS NOT NULL").withColumn("rule", F.explode("rules"))}
    kind = findings.schema["file_id"].dataType
    rows = findings.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("file_id").alias("f"), F.col("rule_id").alias("r"), F.col("line").cast("long").alias("l"), F.lit(None).cast("long").alias("o"))
    for lane, table in lanes.items():
        w = Window.partitionBy(*(["f"] if lane == "all" else ["f", "r"])).orderBy("l", F.col("o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        more = table.select(F.col("file_id").cast(kind).alias("f"), F.col("rule").alias("r"), at.alias("l"), F.coalesce("offset", F.lit(0)).cast("long").alias("o"), block.alias("block"), following.alias("next"))
        rows = rows.unionByName(more, allowMissingColumns=True).withColumns({f"{lane}_block": F.last("block", True).over(w), f"{lane}_next": F.last("next", True).over(w)}).filter("row IS NOT NULL").drop("block", "next")
    last = F.greatest("all_block", "own_block")
    hit = lambda c: F.when(F.col(c)["line"] == F.col("l"), F.col(c)["offset"])
    by = F.array_compact(F.array(hit("all_next"), hit("own_next")))
    used = F.when(F.size(by) > 0, by).when(~last["enable"], F.array(last["offset"]))
    judged = rows.select("row", "f", used.alias("used"))
    stays = judged.filter("used IS NULL").select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
    hidden = judged.filter("used IS NOT NULL").select(F.col("f").alias("file_id"), F.explode("used").alias("offset")).distinct()
    idle = d.filter("action <> 'enable'").select(F.col("file_id").cast(kind).alias("file_id"), F.col("offset").cast("long").alias("offset"), "line").join(hidden, ["file_id", "offset"], "left_anti")
    return stays, idle.select("file_id", F.lit("config/unused-suppression").alias("rule_id"), F.lit("warning").alias("severity"), "offset", "line")


def ordered(findings: DataFrame) -> DataFrame:
    """Each finding once, by file, offset, rule and then all other columns."""
    first = [c for c in ("file_id", "offset", "rule_id", "message") if c in findings.columns]
    return findings.dropDuplicates().orderBy(*first, *[c for c in findings.columns if c not in first])


#: Of the fingerprint and of the baseline's file.
BASELINE_VERSION = 1


def fingerprint(*columns: str) -> Column:
    """SHA-256 over the version and length-prefixed fields; a null field is told from every text."""
    parts = [F.lit(f"v{BASELINE_VERSION};")]
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


FINGERPRINTED = ("rule_id", "file_id", "offset", "message")


def new_findings(findings: DataFrame, baseline: DataFrame, *columns: str) -> DataFrame:
    """Without the findings whose fingerprint the baseline holds."""
    row = F.struct(*[F.col(f"`{c}`") for c in findings.columns]).alias("row")
    keyed = findings.select(row, fingerprint(*(columns or FINGERPRINTED)).alias("fingerprint"))
    return keyed.join(baseline.select("fingerprint"), "fingerprint", "left_anti").select("row.*")


def write_baseline(findings: DataFrame, path: str, *columns: str) -> None:
    """The distinct fingerprints as Parquet, with the version of their form."""
    findings.select(fingerprint(*(columns or FINGERPRINTED)).alias("fingerprint")).distinct().withColumn("version", F.lit(BASELINE_VERSION)).write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    other = rows.filter(F.col("version") != BASELINE_VERSION).first()
    if other:
        raise ValueError(f"unsupported baseline version {other['version']}")
    return rows.select("fingerprint")


def exit_code(findings: DataFrame, deny_warnings: bool = False) -> DataFrame:
    """One row, exit_code: 1 if a finding that counts is an error, or a warning when those are denied, else 0."""
    bad = (category(F.col("rule_id")) != "practice") & (F.col("severity").isin("error", "warning") if deny_warnings else F.col("severity") == "error")
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).cast("int").alias("exit_code"))


def changed_findings(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings on changed lines, all of a file whose range has no lines (it is new or renamed), and those of project rules
    at any line of a changed file. ranges: file_id, first_line, last_line."""
    r = ranges.select(F.col("file_id").alias("_f"), F.col("first_line").alias("_a"), F.col("last_line").alias("_z"))
    on = (F.col("file_id") == F.col("_f")) & (F.col("_a").isNull() | F.col("line").between(F.col("_a"), F.col("_z")) | (category(F.col("rule_id")) == "project"))
    return findings.join(r, on, "left_semi")


def score_columns(severity: str = "severity", rule: str = "rule_id") -> list[Column]:
    """Counts and raw weight; practice findings count nowhere."""
    counted = F.col(rule).isNotNull() & (category(F.col(rule)) != "practice")
    out = [F.coalesce(F.sum(F.when(counted & (F.col(severity) == s), 1)), F.lit(0)).cast("long").alias(f"n_{s}") for s in WEIGHTS]
    raw = F.sum(sum((F.when(counted & (F.col(severity) == s), F.lit(w)).otherwise(F.lit(0)) for s, w in WEIGHTS.items()), F.lit(0)))
    return [*out, F.coalesce(raw, F.lit(0)).cast("long").alias("raw")]


def density(raw: Column, files: Column) -> Column:
    """100 without findings, else floor(100 * capacity / (capacity + raw)), capacity 50 a file."""
    cap = F.greatest(files, F.lit(1)) * CAPACITY
    return F.when(raw == 0, F.lit(100)).otherwise(F.floor(F.lit(100) * cap / (cap + raw))).cast("int")


def file_scores(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_id, n_error, n_warning, n_info, raw, score) for every file, those without findings too."""
    grouped = findings.groupBy("file_id").agg(*score_columns())
    joined = files.select("file_id").join(grouped.hint("merge"), "file_id", "left").na.fill(0, ["n_error", "n_warning", "n_info", "raw"])
    return joined.withColumn("score", density(F.col("raw"), F.lit(1)))


def project_score(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, affected_files, counts, raw, score."""
    nothing = [F.lit(None).cast("string").alias(c) for c in ("rule_id", "severity", "affected")]
    both = files.select(F.lit(1).alias("one"), *nothing).unionByName(findings.select(F.lit(0).alias("one"), "rule_id", "severity", F.col("file_id").cast("string").alias("affected")))
    total = both.agg(F.coalesce(F.sum("one"), F.lit(0)).cast("long").alias("files"), F.countDistinct("affected").alias("affected_files"), *score_columns())
    return total.withColumn("score", density(F.col("raw"), F.col("files")))
