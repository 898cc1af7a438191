"""What modules export, through any chain of re-exports, and what their importers can take from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release


def _known(exports: DataFrame) -> DataFrame:
    """(module, name, state): state as text, so that two states can be told equal."""
    return exports.select("module", F.col("exported").alias("name"), F.to_json(F.struct("state", "kind", "fields")).alias("payload"), "state")


def resolve_exports(exports: DataFrame, reexports: DataFrame, links: DataFrame) -> DataFrame:
    """(module, name, state, kind, fields): every export about which one thing is known, its own or taken over.

    exports: module, exported, state (known, factory, composable, local), kind, fields. reexports: module, source, imported,
    exported (* for all but the default). links: module, source, target. A module's own export hides what it re-exports as
    `*`. Of a name to which different states lead none is taken, and none by those who re-export it.

    Chains of named re-exports are shortened by doubling, so that a chain of n modules takes log n joins. Then states spread
    along the rest in rounds of the newly reached only. The reached set only grows, hence the loop ends, cycles included, and
    its result does not depend on the order of arrival. No table is broadcast: files of repeated values are small where their
    rows are many.
    """
    at = reexports.join(links.hint("merge"), ["module", "source"]).select("module", "imported", "exported", "target").distinct()
    own = materialize(_known(exports).distinct())
    # (module, name) -> (target, imported), over ever longer chains.
    hops = materialize(at.filter("exported <> '*'").select("module", F.col("exported").alias("name"), F.col("target").alias("to"), F.col("imported").alias("as_")).filter("as_ <> '*'").distinct())
    # No chain is longer than the number of hops; those that go round in a cycle lead to no export in any number of steps.
    for _ in range(hops.count().bit_length()):
        far = hops.select(F.col("module").alias("to"), F.col("name").alias("as_"), F.col("to").alias("to2"), F.col("as_").alias("as2"))
        longer = materialize(hops.join(far.hint("merge"), ["to", "as_"], "left").select("module", "name", F.coalesce("to2", "to").alias("to"), F.coalesce("as2", "as_").alias("as_")).distinct())
        moved = not longer.join(hops.hint("merge"), ["module", "name", "to", "as_"], "left_anti").isEmpty()
        release(hops)
        hops = longer
        if not moved:
            break
    named = at.filter("exported <> '*' AND imported <> '*'").select("module", F.col("exported").alias("name"), F.col("target").alias("to"), F.col("imported").alias("as_")).unionByName(hops).distinct()
    named, stars = materialize(named), materialize(at.filter("exported = '*'").select("module", F.col("target").alias("to")).distinct())
    # What hides a star: own names, whatever is known of them, and named re-exports.
    mine = materialize(own.select("module", "name").unionByName(at.filter("exported <> '*'").select("module", F.col("exported").alias("name"))).distinct())
    front = materialize(own.filter("state <> 'local'").drop("state"))
    reached = [front]
    while not front.isEmpty():
        f = front.select(F.col("module").alias("to"), F.col("name").alias("as_"), "payload")
        by_name = named.join(f.hint("merge"), ["to", "as_"]).select("module", "name", "payload")
        by_star = stars.join(f.filter("as_ <> 'default'").withColumnRenamed("as_", "name").hint("merge"), "to").select("module", "name", "payload").join(mine.hint("merge"), ["module", "name"], "left_anti")
        new = by_name.unionByName(by_star).distinct()
        for known in reached:
            new = new.join(known.hint("merge"), ["module", "name", "payload"], "left_anti")
        front = materialize(new)
        reached.append(front)
        if len(reached) > 8:
            together = materialize(_union(reached))
            release(*reached[:-1])
            reached = [together]
    every = _union(reached).groupBy("module", "name").agg(F.count(F.lit(1)).alias("n"), F.min("payload").alias("payload")).filter("n = 1")
    return every.select("module", "name", F.from_json("payload", "state string, kind string, fields array<struct<field:string,kind:string>>").alias("p")).select("module", "name", "p.*")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def seeds(imports: DataFrame, resolved: DataFrame, links: DataFrame) -> DataFrame:
    """(file_id, seeds map<name, kind>): imported reactive values and what imported functions return, for the second trace of
    the files that have any."""
    at = imports.filter("local <> '' AND imported <> '*'").select(F.col("file_id").alias("module"), "source", "imported", "local")
    taken = resolved.filter("state <> 'local'").select(F.col("module").alias("target"), F.col("name").alias("imported"), "state", "kind", "fields")
    hit = at.join(links, ["module", "source"]).join(taken, ["target", "imported"])
    # A value under its name, what a function returns under name(), and the fields of what it returns under name().field.
    parts = F.when(F.col("state") == "composable", F.transform("fields", lambda f: F.struct(F.concat("local", F.lit("()."), f["field"]).alias("name"), f["kind"].alias("kind"))))
    parts = parts.otherwise(F.array(F.struct(F.concat("local", F.when(F.col("state") == "factory", F.lit("()")).otherwise(F.lit(""))).alias("name"), F.col("kind").alias("kind"))))
    named = hit.select("module", F.explode(parts).alias("p")).select("module", "p.name", "p.kind").filter("kind IS NOT NULL")
    pairs = named.groupBy("module", "name").agg(F.count_distinct("kind").alias("n"), F.min("kind").alias("kind")).filter("n = 1")
    return pairs.groupBy(F.col("module").alias("file_id")).agg(F.map_from_entries(F.collect_list(F.struct("name", "kind"))).alias("seeds"))


def single_providers(offers: DataFrame, injects: DataFrame) -> DataFrame:
    """injects with the kind of the one known provider of their key; with several or none, their own default's kind.

    offers: key, kind (null: unknown, ignored); injects: key, default_kind, and more.
    """
    by = offers.filter("kind IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("providers"), F.min("kind").alias("provided"))
    joined = injects.join(by, "key", "left")
    return joined.withColumn("kind", F.when(F.col("providers") == 1, F.col("provided")).when(F.col("providers").isNull(), F.col("default_kind"))).drop("providers", "provided")
