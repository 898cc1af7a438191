"""Rules over script and reactivity facts. A file's facts are one row, so every rule is an expression over that row's arrays:
no join, no shuffle, and one explode for all of them. Each gives the facts it reports, with their offset and line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .script_rules import MACROS, REGISTRARS, _kebab

_COMPILER = (*MACROS, "defineModel", "withDefaults")
_EFFECT = "s.kind IN ('watch_effect', 'watch_post_effect', 'watch_sync_effect')"
_SCOPE = "named_struct('offset', s.offset, 'line', s.line)"
_TRACKS = "s.kind NOT IN ('watch_callback', 'on_scope_dispose')"


def _if(condition: str, items: str) -> str:
    """The items where the condition holds, narrowed to their places, and else none."""
    some = f"transform({items}, v -> named_struct('offset', v.offset, 'line', v.line))"
    return f"if({condition}, {some}, array())"


def _sql(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _reads(scope: str, read: str) -> str:
    """Reads of chosen scopes."""
    return f"flatten(transform(filter(g_scopes, s -> {scope}), s -> filter(s.reads, x -> {read})))"


def _scopes(which: str) -> str:
    return f"transform(filter(g_scopes, s -> {which}), s -> {_SCOPE})"


def _conditional(scope: str) -> str:
    """Conditional reads of a path that the scope has not read for certain before."""
    return _reads(scope, "x.kind = 'conditional' AND NOT exists(s.reads, y -> y.kind = 'unconditional' AND y.offset < x.offset AND y.binding = x.binding AND y.property <=> x.property)")


def _same(a: str, b: str) -> str:
    return f"{a}.binding = {b}.binding AND {a}.property <=> {b}.property"


def _operands(*kinds: str) -> str:
    first = "element_at(filter(g_bindings, g -> g.name = x.name), 1).kind"
    return f"filter(operands, x -> exists(g_bindings, g -> g.name = x.name) AND {first} IN ({_sql(kinds)}))"


def _boundaries() -> dict[str, str]:
    out = {}
    for label, kind in (("computed", "computed"), ("watch-sources", "watch_sources"), ("effect-scope", "effect_scope")):
        out[f"reactivity/no-after-await-dependency-in-{label}"] = _reads(f"s.kind = '{kind}'", "x.kind = 'after_await'")
        out[f"reactivity/no-outside-tracking-dependency-in-{label}"] = _reads(f"s.kind = '{kind}'", "x.kind = 'outside_tracking'")
        out[f"reactivity/no-conditional-dependency-in-{label}"] = _conditional(f"s.kind = '{kind}'")
    return out


def _self_triggers() -> dict[str, str]:
    names = {"no-self-trigger-in-watch-effect": "watch_effect", "no-self-trigger-in-watch-post-effect": "watch_post_effect", "no-self-trigger-in-watch-sync-effect": "watch_sync_effect", "no-computed-self-trigger": "computed"}
    return {f"reactivity/{r}": _reads(f"s.kind = '{k}'", f"x.kind = 'unconditional' AND exists(s.writes, w -> {_same('w', 'x')})") for r, k in names.items()}


_UNSEEN = (
    "NOT array_contains(template_names, g.name) AND NOT exists(all_scopes, s -> exists(s.reads, x -> x.binding = g.name) OR exists(s.writes, x -> x.binding = g.name)) AND exists(bindings, b -> b.name = g.name AND b.offset = g.offset AND b.reads = 0)"
)
_VALUES = ("ref", "shallow_ref", "computed", "custom_ref", "reactive", "shallow_reactive", "readonly", "shallow_readonly")
_ALL_WRITES = f"flatten(transform(filter(g_scopes, s -> {_EFFECT}), s -> s.writes))"

#: Rule -> (severity, the facts of a block that it reports).
RULES: dict[str, tuple[str, str]] = {
    "correctness/no-import-compiler-macros": ("error", f"filter(imports, x -> x.source = 'vue' AND x.imported IN ({_sql(_COMPILER)}))"),
    "correctness/no-mutating-props": ("error", "filter(setup(member_writes), x -> array_contains(props_names, x.object))"),
    "reactivity/no-reactive-destructure": ("warning", "filter(destructures, x -> x.source_call = 'reactive')"),
    "reactivity/no-shallow-reactive-destructure": ("warning", "filter(destructures, x -> x.source_call = 'shallowReactive')"),
    "reactivity/prefer-store-to-refs": ("warning", "filter(destructures, x -> x.source_call LIKE 'use%Store')"),
    "reactivity/no-route-destructure": ("warning", "filter(destructures, x -> x.source_call = 'useRoute')"),
    "reactivity/no-router-destructure": ("warning", "filter(destructures, x -> x.source_call = 'useRouter')"),
    "reactivity/no-ref-as-operand": ("warning", _operands("ref", "shallow_ref", "custom_ref", "to_ref", "template_ref")),
    "reactivity/no-model-ref-as-operand": ("warning", _operands("model_ref")),
    "reactivity/no-computed-as-operand": ("warning", _operands("computed")),
    "reactivity/no-readonly-mutation": ("warning", "filter(member_writes, x -> coalesce(try_element_at(filter(g_bindings, g -> g.name = x.object), 1).kind, '') IN ('readonly', 'shallow_readonly'))"),
    "reactivity/no-props-snapshot-in-ref": ("warning", "filter(calls, x -> x.callee IN ('ref', 'shallowRef') AND array_contains(x.argument_identifiers, 'props'))"),
    "reactivity/no-after-await-watch-effect-dependency": ("warning", _reads(_EFFECT, "x.kind = 'after_await'")),
    "reactivity/no-conditional-watch-effect-dependency": ("warning", _conditional(_EFFECT)),
    "reactivity/no-conditional-dependency-in-render": ("warning", _conditional("s.kind = 'render'")),
    "reactivity/no-deferred-callback-reactive-read-in-effect": ("warning", _if("NOT pauses", _reads(_EFFECT, "x.kind = 'outside_tracking'"))),
    "reactivity/no-side-effects-in-computed": ("warning", "flatten(transform(filter(g_scopes, s -> s.kind = 'computed'), s -> s.writes))"),
    "reactivity/no-effect-write-without-read": ("warning", _scopes(f"{_EFFECT} AND size(s.writes) > 0 AND size(s.reads) = 0")),
    "reactivity/no-computed-without-dependency": ("warning", _scopes("s.kind = 'computed' AND size(s.reads) = 0")),
    "reactivity/prefer-watch-over-effect-for-single-source": ("warning", _scopes(f"{_EFFECT} AND s.assignment_only AND size(s.reads) = 1 AND s.reads[0].kind = 'unconditional'")),
    "reactivity/no-assignment-only-effect-with-conditional-read": ("warning", _scopes(f"{_EFFECT} AND s.assignment_only AND exists(s.reads, x -> x.kind = 'conditional')")),
    "reactivity/no-on-scope-dispose-reactive-read": ("warning", _reads("s.kind = 'on_scope_dispose'", "true")),
    "reactivity/no-empty-watch-sources": ("warning", _scopes("s.kind = 'watch_sources' AND size(s.reads) = 0")),
    "reactivity/no-watch-callback-as-tracking-scope": (
        "warning", f"transform(filter(transform(g_scopes, (s, i) -> named_struct('s', s, 'up', if(i = 0, null, g_scopes[i - 1]))), p -> p.s.kind = 'watch_callback' AND size(p.s.reads) > 0 AND p.up.kind = 'watch_sources' AND size(p.up.reads) = 0), p -> {_SCOPE.replace('s.', 'p.s.')})",
    ),
    "reactivity/no-multiple-effects-same-target": ("warning", f"filter(transform({_ALL_WRITES}, (w, i) -> named_struct('offset', w.offset, 'line', w.line, 'n', size(filter({_ALL_WRITES}, v -> {_same('v', 'w')})), 'before', size(filter(slice({_ALL_WRITES}, 1, i), v -> {_same('v', 'w')})))), w -> w.n >= 2 AND w.before = 0)"),
    "reactivity/no-deep-watch-on-reactive-root": ("warning", _reads("s.kind = 'watch_sources'", "x.property = '*'")),
    "reactivity/no-reactive-read-during-pause-tracking": ("warning", _if("pauses", _reads(_TRACKS, "x.kind = 'outside_tracking'"))),
    "reactivity/prefer-computed": ("warning", _scopes(f"{_EFFECT} AND s.assignment_only AND size(s.writes) > 0 AND forall(s.writes, w -> w.property <=> 'value') AND size(s.reads) > 0 AND forall(s.reads, x -> x.kind = 'unconditional') AND exists(s.reads, x -> NOT exists(s.writes, w -> w.binding = x.binding))")),
    "reactivity/prefer-explicit-sources-for-conditional-deps": ("info", _scopes(f"{_EFFECT} AND exists(s.reads, x -> x.kind = 'conditional')")),
    "reactivity/no-unused-computed-binding": ("warning", f"filter(g_bindings, g -> g.kind = 'computed' AND {_UNSEEN})"),
    "reactivity/no-unused-reactive-binding": ("warning", f"filter(g_bindings, g -> g.kind IN ({_sql(_VALUES)}) AND NOT array_contains(static_refs, g.name) AND {_UNSEEN})"),
    "reactivity/no-v-model-nonreactive-source": (
        "warning", _if("block_ix = 0", "filter(models, m -> m.expression RLIKE '^[A-Za-z_$][A-Za-z0-9_$]*$' AND array_contains(all_names, m.expression) AND NOT array_contains(all_reactive, m.expression))"),
    ),
    "reactivity/no-nonreactive-props-destructure": ("error", _if("vue_version < named_struct('major', 3L, 'minor', 5L, 'patch', 0L)", "filter(setup(destructures), x -> x.source_call = 'defineProps')")),
}
RULES |= {r: ("warning", e) for r, e in (_boundaries() | _self_triggers()).items()}
RULES |= {f"correctness/no-{_kebab(c)}-after-await": ("warning", f"filter(setup(calls), x -> x.callee = '{c}' AND x.offset >= try_element_at(await_ends, 1))") for c in REGISTRARS}
RULES |= {f"correctness/no-duplicate-{_kebab(c)}": ("error", f"slice(filter(setup(calls), x -> x.callee = '{c}'), 2, greatest(size(filter(setup(calls), x -> x.callee = '{c}')) - 1, 0))") for c in MACROS}
_MODELS = "filter(setup(calls), x -> x.callee = 'defineModel')"
RULES["correctness/no-duplicate-define-model"] = ("error", f"filter({_MODELS}, (x, i) -> exists(slice({_MODELS}, 1, i), y -> coalesce(y.assigned_to, '') = coalesce(x.assigned_to, '')))")


# Practice: suggestions that a helper of a utility package would serve better.
_HOOKS = [c for c in REGISTRARS if c.startswith("on")] + ["onScopeDispose"]


def _calls(name: str) -> str:
    """Calls of a function, by itself or as a member."""
    return f"filter(calls, x -> x.callee = '{name}' OR x.callee LIKE '%.{name}')"


def _any(name: str) -> str:
    return f"size({_calls(name)}) > 0"


def _first_if(condition: str, items: str) -> str:
    """The first of the items of a block where the condition holds."""
    return _if(f"coalesce({condition}, false)", f"slice({items}, 1, 1)")


def _unused(target: str) -> str:
    return f"NOT exists(imports, x -> x.imported = '{target}') AND NOT exists(calls, x -> x.callee = '{target}')"


_HOOKED = f"exists(calls, x -> x.callee IN ({_sql(_HOOKS)}))"


def _cleanup(target: str, starts: str, stops: str) -> tuple[str, str]:
    return "info", _first_if(f"NOT is_test AND {_HOOKED} AND {_unused(target)} AND NOT {_any(stops)}", _calls(starts))


def _from_vue(name: str) -> str:
    """Calls of a function of the framework: imported from it, or bare and not declared here."""
    return f"filter(calls, x -> (x.import_name = '{name}' AND (x.import_source IN ('vue', 'vue-demi', '#imports') OR x.import_source LIKE '@vue/%')) OR (x.callee = '{name}' AND x.import_source IS NULL AND NOT exists(bindings, b -> b.name = '{name}')))"


def _least(minor: int) -> str:
    return f"vue_version >= named_struct('major', 3L, 'minor', {minor}L, 'patch', 0L)"


PRACTICE: dict[str, tuple[str, str]] = {
    "practice/vueuse-use-debounce-fn": ("info", _first_if(f"NOT is_test AND {_unused('useDebounceFn')}", f"filter({_calls('setTimeout')}, t -> t.assigned_to IS NOT NULL AND exists({_calls('clearTimeout')}, c -> array_contains(c.argument_identifiers, t.assigned_to)))")),
    "practice/vueuse-use-timeout-fn": _cleanup("useTimeoutFn", "setTimeout", "clearTimeout"),
    "practice/vueuse-use-interval-fn": _cleanup("useIntervalFn", "setInterval", "clearInterval"),
    "practice/vueuse-use-raf-fn": _cleanup("useRafFn", "requestAnimationFrame", "cancelAnimationFrame"),
    "practice/vueuse-use-event-listener": _cleanup("useEventListener", "addEventListener", "removeEventListener"),
    "practice/vueuse-use-intersection-observer": _cleanup("useIntersectionObserver", "IntersectionObserver", "disconnect"),
    "practice/vueuse-use-mutation-observer": _cleanup("useMutationObserver", "MutationObserver", "disconnect"),
    "practice/vueuse-use-resize-observer": _cleanup("useResizeObserver", "ResizeObserver", "disconnect"),
    "practice/vueuse-use-window-size": ("info", _first_if(
        f"NOT is_test AND {_HOOKED} AND {_unused('useWindowSize')} AND exists(g_bindings, g -> g.kind IN ('ref', 'shallow_ref') AND lower(g.name) LIKE '%width%') AND exists(g_bindings, g -> g.kind IN ('ref', 'shallow_ref') AND lower(g.name) LIKE '%height%')", _calls("addEventListener"))),
    "practice/prefer-to-value": ("info", _if(f"NOT is_test AND {_least(3)}", _from_vue("unref"))),
    "practice/prefer-define-model": ("info", _first_if(f"NOT is_test AND {_least(4)} AND {_any('defineEmits')} AND NOT {_any('defineModel')} AND exists(bindings, b -> b.name = 'modelValue')", "filter(setup(calls), x -> x.callee = 'defineProps')")),
    "practice/prefer-use-slots-attrs": ("info", _if("NOT is_test", _from_vue("getCurrentInstance"))),
    "reactivity/prefer-use-template-ref": ("info", _if(_least(5), "filter(setup(g_bindings), g -> g.kind = 'ref' AND g.initialized_with_null AND array_contains(static_refs, g.name))")),
}


def _setup(sql: str) -> str:
    """setup(facts): the facts in a setup block, none elsewhere."""
    for part in ("calls", "member_writes", "destructures", "g_bindings"):
        sql = sql.replace(f"setup({part})", f"filter({part}, q -> block_kind = 'setup')")
    return sql


def lint_blocks(facts: DataFrame, env: DataFrame | None = None, practice: bool = True) -> DataFrame:
    """(file_id, block_ix, rule_id, severity, offset, line). env: file_id, vue_version struct<major,minor,patch>; rules that
    ask for a version are quiet where it isn't known."""
    version = "cast(null AS struct<major:bigint,minor:bigint,patch:bigint>) AS vue_version"
    rows = facts.join(env.select("file_id", "vue_version").hint("merge"), "file_id", "left") if env is not None else facts.selectExpr("*", version)
    rows = rows.selectExpr(
        "file_id", "vue_version", "coalesce(cast(file_id AS string) RLIKE '(?i)(^|/)(__tests__|__mocks__|tests?)/|[.](test|spec|stories)[.]', false) AS is_test",
        "array_distinct(flatten(transform(expressions, x -> x.identifiers))) AS template_names",
        "transform(filter(flatten(transform(elements, e -> e.attributes)), a -> lower(a.name) = 'ref'), a -> a.value) AS static_refs",
        "filter(flatten(transform(elements, e -> e.directives)), d -> d.name = 'model') AS models",
        "transform(filter(flatten(transform(filter(blocks, b -> b.block_kind = 'setup'), b -> b.calls)), c -> c.callee = 'defineProps' AND c.assigned_to IS NOT NULL), c -> c.assigned_to) AS props_names",
        "flatten(transform(blocks, b -> b.g_scopes)) AS all_scopes", "transform(flatten(transform(blocks, b -> b.bindings)), x -> x.name) AS all_names", "transform(flatten(transform(blocks, b -> b.g_bindings)), x -> x.name) AS all_reactive",
        "exists(blocks, b -> exists(b.calls, c -> c.callee = 'pauseTracking' OR c.callee LIKE '%.pauseTracking')) AS pauses",
        "posexplode(blocks) AS (block_ix, b)",
    ).select("*", "b.*")
    places = "array<struct<offset:bigint,line:int>>"
    found = []
    for rule, (severity, items) in (RULES | (PRACTICE if practice else {})).items():
        # Each branch is narrowed to the place alone, so that an empty one has the same type.
        sql = _setup(items)
        if sql.startswith("if("):
            sql = sql.replace("array()", f"cast(array() AS {places})")
        found.append(F.expr(f"transform({sql}, y -> named_struct('rule_id', '{rule}', 'severity', '{severity}', 'offset', y.offset, 'line', y.line))"))
    return rows.select("file_id", "block_ix", F.explode(F.flatten(F.array(*found))).alias("r")).select("file_id", "block_ix", "r.*")


def prop_flow_findings(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """(module_id, rule_id, severity, offset): prop edges whose source is no reactive value of the parent and no label of
    the engine's own. edges: module_id, from, kind, offset; bindings: module_id, name."""
    rows = edges.filter("kind = 'prop' AND NOT startswith(`from`, '<')").withColumnRenamed("from", "name")
    return rows.join(bindings.select("module_id", "name"), ["module_id", "name"], "left_anti").select("module_id", F.lit("reactivity/no-stale-prop-flow").alias("rule_id"), F.lit("warning").alias("severity"), "offset")
