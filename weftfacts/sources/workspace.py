"""Where source files come from: folders, unsaved texts, configuration, package manifests and patches."""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("vue", "js", "jsx", "ts", "tsx")
INCLUDE = ("**/*.vue",)


def glob_regex(glob: str) -> str:
    """An anchored regular expression of a path glob: ** crosses folders, * and ? don't, {a,b} are alternatives."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : j].split(",")) + ")", j + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def path_filter(path: Column, include: Iterable[str] = INCLUDE, exclude: Iterable[str] = ()) -> Column:
    """Some included pattern and no excluded one matches; separators of either kind count as /."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    some = F.lit(False)
    for g in include:
        some = some | p.rlike(glob_regex(g))
    for g in exclude:
        some = some & ~p.rlike(glob_regex(g))
    return some


def language(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def source_kind(path: Column) -> Column:
    """component, script, or null for files that are no source."""
    ext = language(path)
    return F.when(ext == "vue", F.lit("component")).when(ext.isin(*EXTENSIONS[1:]), F.lit("script"))


def _ignored(root: str) -> str | None:
    """A regular expression of what the root's ignore file lists, without negations."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            lines = [x.strip() for x in f]
    except OSError:
        return None
    parts = []
    for x in lines:
        if x and not x.startswith(("#", "!")):
            body = fnmatch.translate(x.strip("/")).replace(".*", "[^/]*")
            body = re.sub(r"^\(\?s:|\)\\[zZ]$", "", body)
            parts.append(("^" if "/" in x.rstrip("/") else "(?:^|.*/)") + body + "(?:/.*)?$")
    return "|".join(f"(?:{p})" for p in parts) or None


def discover(spark: SparkSession, root: str, include: Iterable[str] = INCLUDE, exclude: Iterable[str] = ()) -> DataFrame:
    """(file_id, kind, language, source) of the sources below root, by path from there. Reading is Spark's; node_modules and
    ignored paths are left out; include and exclude choose among components only. Texts that are no UTF-8 are an error."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = "file:" + os.path.abspath(root).rstrip("/") + "/" if "://" not in root and not root.startswith("file:") else root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^(file:)/*", "file:/")
    rows = rows.select(F.substr(path, F.lit(len(re.sub("^file:/*", "file:/", base)) + 1)).alias("file_id"), F.decode("content", "UTF-8").alias("source"))
    rows = rows.filter(~F.col("file_id").rlike("(^|/)(node_modules|[.]git)/"))
    ignored = _ignored(root)
    if ignored:
        rows = rows.filter(~F.col("file_id").rlike(ignored))
    rows = rows.select("file_id", source_kind(F.col("file_id")).alias("kind"), language(F.col("file_id")).alias("language"), "source")
    return rows.filter((F.col("kind") != "component") | path_filter(F.col("file_id"), include, exclude))


def overlay(files: DataFrame, unsaved: DataFrame) -> DataFrame:
    """files with texts of unsaved buffers in place of those on disk, and files that exist in buffers only."""
    u = unsaved.select("file_id", F.col("source").alias("_new"))
    joined = files.join(u, "file_id", "full")
    return joined.select("file_id", F.coalesce("kind", source_kind(F.col("file_id"))).alias("kind"), F.coalesce("language", language(F.col("file_id"))).alias("language"), F.coalesce("_new", "source").alias("source"))


def version(requirement: Column) -> Column:
    """struct<major,minor,patch> of the first run of digits and dots in a version range; null without one."""
    found = F.regexp_extract(requirement, r"(\d+(?:\.\d+)*)", 1)
    part = lambda i: F.coalesce(F.get(F.split(found, r"\."), F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    return F.when(found != "", F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


_GROUPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def environment(files: DataFrame, manifests: DataFrame, package: str = "vue") -> DataFrame:
    """(file_id, vue_version, packages): of the nearest folder above each file that has a manifest. manifests: file_id (a path
    to a package.json), source. The version is the first of the four dependency groups that names one. Every folder above a
    file is a candidate; one join, and the deepest wins."""
    groups = F.from_json("source", "struct<" + ",".join(f"{g}:map<string,string>" for g in _GROUPS) + ">").alias("j")
    known = manifests.select(F.regexp_replace("file_id", "[^/]*$", "").alias("dir"), groups)
    versions = [version(F.try_element_at(F.col(f"j.{g}"), F.lit(package))) for g in _GROUPS]
    names = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*[F.map_keys(f"j.{g}") for g in _GROUPS])))))
    known = known.select("dir", F.coalesce(*versions).alias("vue_version"), names.alias("packages"))
    parts = F.split("file_id", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    tries = files.select("file_id", F.explode(above).alias("dir"))
    best = tries.join(known, "dir").groupBy("file_id").agg(F.max_by(F.struct("vue_version", "packages"), F.length("dir")).alias("e"))
    return best.select("file_id", "e.vue_version", "e.packages")


_LEVELS = ("off", "info", "warning", "error")
_KEYS = {"version": int, "preset": str, "practice": str, "include": list, "exclude": list, "rules": dict}


def parse_config(text: str) -> dict:
    """version, preset, practice, include, exclude, rules; anything not known is an error."""
    got = tomllib.loads(text)
    for k, v in got.items():
        if k not in _KEYS or not isinstance(v, _KEYS[k]):
            raise ValueError(f"unknown or ill-typed setting: {k}")
    if got.get("version", 1) != 1:
        raise ValueError(f"unsupported version {got['version']}")
    if got.get("preset", "recommended") not in ("recommended", "none") or got.get("practice", "suggest") not in ("suggest", "off"):
        raise ValueError("unknown preset or practice mode")
    for rule, level in got.get("rules", {}).items():
        if level not in _LEVELS:
            raise ValueError(f"unknown level of {rule}: {level}")
    return {"version": 1, "preset": "recommended", "practice": "suggest", "include": list(INCLUDE), "exclude": [], "rules": {}} | got


_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def parse_patch(text: str) -> list[tuple[str, int | None, int | None]]:
    """(path, first line, last line) of the added lines of a patch; files without any have null lines."""
    out: list[tuple[str, int | None, int | None]] = []
    path, seen = None, False
    for line in text.splitlines():
        if line.startswith("+++ "):
            if path and not seen:
                out.append((path, None, None))
            name = line[4:].split("\t")[0].strip('"')
            path, seen = (None if name == "/dev/null" else name[2:] if name.startswith(("b/", "w/")) else name), False
        elif path and (m := _HUNK.match(line)):
            first, n = int(m.group(1)), int(m.group(2) or 1)
            if n:
                out.append((path, first, first + n - 1))
                seen = True
    if path and not seen:
        out.append((path, None, None))
    return out


def content_key(*columns: str) -> Column:
    """SHA-256 over length-prefixed fields, null told from every text: tells whether a file's facts can be used again."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
