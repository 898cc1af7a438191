"""Rules over call and scope facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Callees that must be registered before the first top-level await of a setup block.
REGISTRARS = (
    "onMounted onBeforeMount onUpdated onBeforeUpdate onUnmounted onBeforeUnmount onActivated onDeactivated onErrorCaptured onRenderTracked onRenderTriggered onServerPrefetch watch watchEffect watchPostEffect watchSyncEffect defineExpose provide inject nextTick effectScope "
    "getCurrentInstance useAttrs useSlots useCssModule useCssVars withDefaults defineProps defineEmits defineModel defineSlots defineOptions"
).split()
MACROS = ("defineProps", "defineEmits", "defineExpose", "defineSlots", "defineOptions")


def _kebab(name: str) -> str:
    return "".join("-" + c.lower() if c.isupper() else c for c in name)


def after_await(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id, rule_id, offset): registrars called at or after the first top-level await ends. The vocabulary is a literal
    map, so nothing is broadcast; the join is on file_id."""
    names = F.create_map(*[F.lit(x) for c in REGISTRARS for x in (c, f"correctness/no-{_kebab(c)}-after-await")])
    first = blocks.filter("block_kind = 'setup'").select("file_id", F.try_element_at("await_ends", F.lit(1)).alias("first_await"))
    hit = calls.filter(F.col("callee").isin(*REGISTRARS)).join(first, "file_id").filter(F.col("offset") >= F.col("first_await"))
    return hit.select("file_id", F.element_at(names, F.col("callee")).alias("rule_id"), "offset")


def duplicate_macros(calls: DataFrame) -> DataFrame:
    """(file_id, rule_id, offset): every macro call after the first of its kind in a file's setup block; defineModel calls
    repeat only under the same name."""
    own = F.when(F.col("callee") == "defineModel", F.coalesce("assigned_to", F.lit(""))).otherwise(F.lit(""))
    w = Window.partitionBy("file_id", "callee", "_own").orderBy("offset")
    names = F.create_map(*[F.lit(x) for c in (*MACROS, "defineModel") for x in (c, f"correctness/no-duplicate-{_kebab(c)}")])
    rows = calls.filter(F.col("callee").isin(*MACROS, "defineModel")).withColumn("_own", own).withColumn("_n", F.row_number().over(w))
    return rows.filter("_n > 1").select("file_id", F.element_at(names, F.col("callee")).alias("rule_id"), "offset")


def repeated_writes(writes: DataFrame) -> DataFrame:
    """(module_id, binding, property, n_writes, first_offset): targets that effects write at least twice."""
    return writes.groupBy("module_id", "binding", "property").agg(F.count(F.lit(1)).alias("n_writes"), F.min("offset").alias("first_offset")).filter("n_writes >= 2")


def tracking_state(events: DataFrame) -> DataFrame:
    """(module_id, offset, tracked): for each read, the state the last pause or resume before it left; tracked at first.
    Of events on one offset, pauses come first, then resumes, then reads."""
    rank = F.when(F.col("kind") == "pause", 0).when(F.col("kind") == "resume", 1).otherwise(2)
    w = Window.partitionBy("module_id").orderBy("offset", rank).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("kind") == "pause", F.lit(False)).when(F.col("kind") == "resume", F.lit(True)), ignorenulls=True).over(w)
    return events.withColumn("tracked", F.coalesce(state, F.lit(True))).filter("kind = 'read'").select("module_id", "offset", "tracked")
