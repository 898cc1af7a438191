"""Modules and components of a project: which file an import means, which components a template uses, what nothing uses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probed in this order behind a specifier that names no file as it stands.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", ".d.ts")
_QUIET = r"^(node:|virtual:|~icons/|\\x00|https?:|data:)|\\.(css|scss|sass|less|styl|svg|png|jpe?g|gif|webp|json|woff2?|md|txt|wasm)(\\?.*)?$|\\?(raw|url|worker|inline)"


def normal(path: str) -> str:
    """SQL for a path without empty, . and .. segments."""
    return f"array_join(aggregate(split({path}, '/'), cast(array() AS array<string>), (p, x) -> CASE WHEN x IN ('', '.') THEN p WHEN x = '..' THEN slice(p, 1, greatest(size(p) - 1, 0)) ELSE concat(p, array(x)) END), '/')"


def folder(path: str) -> str:
    return f"regexp_replace({path}, '[^/]*$', '')"


def resolve(imports: DataFrame, files: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """imports with `target` (the file meant, or null) and `outcome`: file, external, quiet or unresolved.

    imports: file_id (a path), source; files: file_id. Relative specifiers are joined with their file's folder, those under an
    alias with the alias's folders in turn; then the path itself, the path with each extension, and an index file in it are
    looked up, first hit wins. A bare name is a package. Each file offers itself under the few paths that mean it, so an
    import looks up a path once and not with every ending. Neither side is broadcast, as both grow with the project. Imports
    that repeat are resolved once.
    """
    aliases = aliases if aliases is not None else {"@/": ("src/", ""), "~/": ("src/", ""), "@@/": ("",), "~~/": ("",)}
    spec = F.regexp_replace("source", r"[?#].*$", "")
    known = imports.select("file_id", "source").distinct()
    bases = F.when(spec.startswith("."), F.array(F.concat(F.expr(folder("file_id")), spec))).when(spec.startswith("/"), F.array(spec))
    for prefix, folders in aliases.items():
        bases = bases.when(spec.startswith(prefix), F.array(*[F.concat(F.lit(f), F.substr(spec, F.lit(len(prefix) + 1))) for f in folders]))
    local = spec.rlike("^(" + "|".join(re.escape(p) for p in (".", "/", *aliases)) + ")")
    ends = ["", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS]]
    own = F.array_compact(F.array(*[F.when(F.col("file_id").endswith(t), F.struct(F.lit(e).alias("e"), F.expr(f"left(file_id, length(file_id) - {len(t)})").alias("path"))) for e, t in enumerate(ends)]))
    offers = files.select("file_id").distinct().select(F.col("file_id").alias("target"), F.explode(own).alias("o")).select("target", "o.e", "o.path")
    base = known.filter(local).select("file_id", "source", F.posexplode(bases).alias("b", "base"))
    tries = base.select("file_id", "source", "b", F.expr(normal("base")).alias("path"))
    found = tries.join(offers.hint("merge"), "path", "left").groupBy("file_id", "source").agg(F.min_by("target", F.col("b") * len(ends) + F.col("e")).alias("target"))
    named = found.unionByName(known.filter(~local).withColumn("target", F.lit(None).cast("string")))
    outcome = F.when(F.col("target").isNotNull(), F.lit("file")).when(F.col("source").rlike(_QUIET.replace("\\\\", "\\")), F.lit("quiet")).when(local, F.lit("unresolved")).otherwise(F.lit("external"))
    return imports.join(named.withColumn("outcome", outcome).hint("merge"), ["file_id", "source"], "left")


def unresolved_imports(resolved: DataFrame) -> DataFrame:
    return resolved.filter("outcome = 'unresolved'").select("file_id", F.lit("project/unresolved-import").alias("rule_id"), F.lit("error").alias("severity"), "offset", "line")


def comparable(name: Column) -> Column:
    """Letters and digits only, in lower case: how tags and component names are compared."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def _inside(path: str) -> str:
    """SQL for the path below the `components` folder, empty elsewhere."""
    return f"regexp_extract({path}, '(?:^|/)components/(.+)$', 1)"


def component_name(path: str = "file_id") -> Column:
    """The name under which a file below a `components` folder is known: its folders and its own name in one, with a folder
    that the next part begins with left out."""
    bare = f"regexp_replace(regexp_replace({_inside(path)}, '[.](vue|tsx|jsx|ts|js)$', ''), '[.](client|server|global|island)$', '')"
    words = f"transform(filter(split(regexp_replace({bare}, '/index$', ''), '/'), x -> x <> ''), x -> array_join(transform(split(regexp_replace(x, '([a-z0-9])([A-Z])', '$1-$2'), '[-_. ]+'), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), ''))"
    # The words are a variable: named several times as an expression, they would be made anew for each of themselves.
    name = "array_join(filter(transform(ws, (x, i) -> CASE WHEN i + 1 < size(ws) AND startswith(ws[i + 1], x) THEN '' ELSE x END), x -> x <> ''), '')"
    return F.expr(f"CASE WHEN {_inside(path)} <> '' THEN transform(array({words}), ws -> {name})[0] END")


def node_kind(path: str = "file_id") -> Column:
    """What a file is by the folders above it, in fixed precedence."""
    parts = F.split(path, "/")
    kind = None
    for folder_name, k in (("pages", "page"), ("layouts", "layout"), ("middleware", "middleware"), ("plugins", "plugin"), ("composables", "composable"), ("stores", "store"), ("components", "component")):
        hit = F.array_contains(parts, folder_name)
        kind = F.when(hit, F.lit(k)) if kind is None else kind.when(hit, F.lit(k))
    return kind.when(F.col(path).endswith(".vue"), F.lit("vue_file")).otherwise(F.lit("module"))


def component_edges(elements: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind): usage of an imported component, or auto usage of one known by convention. A tag that an import of
    its file names is never looked up by convention. elements: file_id, tag; names with several files mean none."""
    tags = elements.filter(F.col("tag").rlike("[A-Z-]")).select("file_id", comparable(F.regexp_replace("tag", "^Lazy(?=[A-Z])", "")).alias("name")).distinct()
    imported = resolved.filter("outcome = 'file' AND local <> ''").select("file_id", comparable(F.col("local")).alias("name"), "target")
    used = tags.join(imported.hint("merge"), ["file_id", "name"]).select(F.col("file_id").alias("src"), F.col("target").alias("dst"), F.lit("component_usage").alias("kind"))
    named = files.filter(F.expr(_inside("file_id")) != "").select(comparable(component_name()).alias("name"), "file_id")
    one = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("dst")).filter("n = 1").drop("n")
    shadowed = resolved.filter("local <> ''").select("file_id", comparable(F.col("local")).alias("name"))
    auto = tags.join(shadowed.hint("merge"), ["file_id", "name"], "left_anti").join(one.hint("merge"), "name").select(F.col("file_id").alias("src"), "dst", F.lit("auto_component").alias("kind"))
    return used.unionByName(auto).distinct()


def import_edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter("outcome = 'file'").select(F.col("file_id").alias("src"), F.col("target").alias("dst"), F.lit("import").alias("kind")).distinct()


def unused_components(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that no import, usage or auto usage leads to; stories, tests and mocks are no components."""
    own = files.filter((node_kind() == "component") & F.col("file_id").endswith(".vue") & ~F.lower("file_id").rlike(r"(^|/)(__tests__|__mocks__|tests?|mocks?|stories)/|\.(test|spec|stories|story)\."))
    rest = own.select("file_id").join(edges.filter("src <> dst").select(F.col("dst").alias("file_id")).hint("merge"), "file_id", "left_anti")
    return rest.select("file_id", F.lit("project/unused-component").alias("rule_id"), F.lit("warning").alias("severity"), F.lit(0).cast("long").alias("offset"), F.lit(1).alias("line"))


def navigation(edges: DataFrame) -> DataFrame:
    """(file_id, uses, used_by): sorted component neighbours of each file that has any."""
    e = edges.filter("kind IN ('component_usage', 'auto_component')")
    uses = e.groupBy(F.col("src").alias("file_id")).agg(F.array_sort(F.collect_set("dst")).alias("uses"))
    by = e.groupBy(F.col("dst").alias("file_id")).agg(F.array_sort(F.collect_set("src")).alias("used_by"))
    none = F.array().cast("array<string>")
    return uses.join(by, "file_id", "full").select("file_id", F.coalesce("uses", none).alias("uses"), F.coalesce("used_by", none).alias("used_by"))
