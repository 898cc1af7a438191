"""Findings as text, JSON, SARIF and annotation lines, and what the reports sum up. Every format is a column or a small
aggregate; the caller decides whether lines are written by many tasks or fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL, VERSION = "weftfacts", "0.2"


def finding_id() -> Column:
    """Stable id of a finding: its place and rule, and a hash of its severity and message."""
    return F.concat_ws(":", F.col("file_id").cast("string"), "line", "column", "rule_id", F.substring(F.sha2(F.concat_ws("|", "severity", F.coalesce("message", F.lit(""))), 256), 1, 16))


def text_lines(findings: DataFrame) -> DataFrame:
    """(file_id, offset, line_text): file:line:column severity rule message."""
    return findings.select("file_id", "offset", F.concat(F.col("file_id").cast("string"), F.lit(":"), F.col("line"), F.lit(":"), F.col("column"), F.lit(" "), F.col("severity"), F.lit(" "), F.col("rule_id"), F.lit(" "), F.coalesce("message", F.lit(""))).alias("line_text"))


def _escaped(c: Column, more: bool = False) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if more else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotations(findings: DataFrame) -> DataFrame:
    """(file_id, offset, annotation): workflow commands; percent signs, line ends and, in properties, : and , are escaped."""
    level = F.when(F.col("severity") == "info", F.lit("notice")).otherwise(F.col("severity"))
    return findings.select("file_id", "offset", F.concat(F.lit("::"), level, F.lit(" file="), _escaped(F.col("file_id").cast("string"), True), F.lit(",line="), F.col("line"), F.lit(",col="), F.col("column"), F.lit(",title="), _escaped(F.col("rule_id"), True), F.lit("::"), _escaped(F.coalesce("message", F.lit("")))).alias("annotation"))


def json_lines(findings: DataFrame) -> DataFrame:
    """(file_id, offset, json): one object a finding."""
    span = F.struct("offset", "length", "line", "column").alias("span")
    return findings.select("file_id", "offset", F.to_json(F.struct(finding_id().alias("id"), "rule_id", "severity", "message", F.col("file_id").cast("string").alias("file"), span)).alias("json"))


def summary(findings: DataFrame, score: DataFrame) -> DataFrame:
    """One row, json: the report's head. score: as policy.project_score gives it."""
    counts = F.struct(F.col("n_info").alias("info"), F.col("n_warning").alias("warning"), F.col("n_error").alias("error")).alias("by_severity")
    total = (F.col("n_info") + F.col("n_warning") + F.col("n_error")).alias("finding_count")
    return score.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version")).alias("tool"), (F.col("n_error") == 0).alias("ok"), F.struct("score", total, F.col("affected_files").alias("affected_file_count"), counts).alias("summary"))).alias("json"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, json): the driver's rules, each once, in order of their ids."""
    return findings.groupBy("rule_id").agg(F.min("severity").alias("severity")).select("rule_id", F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(_level().alias("level")).alias("defaultConfiguration"))).alias("json")).orderBy("rule_id")


def _level() -> Column:
    return F.when(F.col("severity") == "info", F.lit("note")).otherwise(F.col("severity"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(file_id, offset, json): results with their place and a partial fingerprint."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("offset").alias("byteOffset"), F.col("length").alias("byteLength"))
    place = F.struct(F.struct(F.struct(F.col("file_id").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select("file_id", "offset", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), _level().alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(finding_id().alias("id")).alias("partialFingerprints"))).alias("json"))


def hotspots(facts: DataFrame, k: int = 5) -> DataFrame:
    """(file_id, bindings, scopes, template_reads, weight) of the k heaviest files; ties by id, none of weight 0."""
    by = facts.selectExpr(
        "file_id", "coalesce(aggregate(blocks, 0, (n, b) -> n + size(b.g_bindings)), 0) AS bindings", "coalesce(aggregate(blocks, 0, (n, b) -> n + size(b.g_scopes)), 0) AS scopes",
        "size(filter(expressions, x -> arrays_overlap(x.identifiers, transform(flatten(transform(blocks, b -> b.g_bindings)), g -> g.name)))) AS template_reads",
    )
    return by.withColumn("weight", F.col("bindings") + F.col("scopes") + F.col("template_reads")).filter("weight > 0").orderBy(F.desc("weight"), "file_id").limit(k)


def template_reads(facts: DataFrame) -> DataFrame:
    """(file_id, binding, surface, offset): expressions that read a reactive binding of the file's scripts, each once."""
    x = facts.select("file_id", F.explode("expressions").alias("x"), F.expr("array_distinct(transform(flatten(transform(blocks, b -> b.g_bindings)), g -> g.name))").alias("names"))
    return x.select("file_id", F.explode(F.array_intersect("x.identifiers", "names")).alias("binding"), "x.surface", "x.offset").distinct()


def dependency_edges(facts: DataFrame) -> DataFrame:
    """(file_id, from, to, property, kind, offset): reads that certainly or perhaps count, of scopes that track, and reads
    of the template."""
    s = facts.select("file_id", F.explode("blocks").alias("b")).select("file_id", F.explode("b.g_scopes").alias("s")).filter("s.kind NOT IN ('watch_callback', 'on_scope_dispose')")
    r = s.select("file_id", F.explode("s.reads").alias("x"), F.coalesce("s.binding", F.concat(F.lit("<"), F.col("s.callee"), F.lit("@"), F.col("s.offset"), F.lit(">"))).alias("to"), F.when(F.col("s.kind") == "computed", F.lit("computed")).otherwise(F.lit("effect")).alias("kind"))
    r = r.filter("x.kind IN ('unconditional', 'conditional')").select("file_id", F.col("x.binding").alias("from"), "to", "x.property", "kind", "x.offset")
    t = template_reads(facts).select("file_id", F.col("binding").alias("from"), F.concat(F.lit("<template:"), F.col("surface"), F.lit(">")).alias("to"), F.lit(None).cast("string").alias("property"), F.lit("template").alias("kind"), "offset")
    return r.unionByName(t).dropDuplicates(["file_id", "from", "to", "property", "kind", "offset"])


def covering_scope(facts: DataFrame, places: DataFrame) -> DataFrame:
    """(file_id, at, kind, callee, offset): the tightest scope around each place. places: file_id, at."""
    s = facts.select("file_id", F.explode("blocks").alias("b")).select("file_id", F.explode("b.g_scopes").alias("s")).select("file_id", "s.kind", "s.callee", "s.offset", "s.length")
    hit = places.join(s, "file_id").filter("offset <= at AND at < offset + length")
    return hit.groupBy("file_id", "at").agg(F.min_by(F.struct("kind", "callee", "offset"), F.struct("length", "offset")).alias("s")).select("file_id", "at", "s.*")


def explain_scopes(facts: DataFrame) -> DataFrame:
    """(file_id, callee, offset, tracks, does_not_track, sentence) of every scope; read paths sorted, each once."""
    s = facts.select("file_id", F.explode("blocks").alias("b")).select("file_id", F.explode("b.g_scopes").alias("s"))
    path = "concat(x.binding, coalesce(concat('.', x.property), ''))"
    side = lambda test: F.expr(f"array_sort(array_distinct(transform(filter(s.reads, x -> {test}), x -> {path})))")
    rows = s.select("file_id", "s.callee", "s.offset", side("x.kind IN ('unconditional', 'conditional')").alias("tracks"), side("x.kind NOT IN ('unconditional', 'conditional')").alias("does_not_track"))
    return rows.withColumn("sentence", F.format_string("%s tracks %d path(s) and does not track %d", "callee", F.size("tracks"), F.size("does_not_track")))
