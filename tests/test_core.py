"""Facts, rules, policy and graph operators on small inputs."""

import os
import subprocess
import sys

import pytest

from weftfacts.operators import edits, exports, graph, policy, project, script_rules
from weftfacts.operators.block_rules import PRACTICE, RULES, lint_blocks
from weftfacts.operators.template_rules import lint_elements, rules, severities
from weftfacts.plans import catalog, reports
from weftfacts.plans.cases import MARKUP, SCRIPTS
from weftfacts.plans.catalog import tracking_state
from weftfacts.sources import components, workspace
from weftfacts.sources.script import Names, ScriptError, parse
from weftfacts.streaming import incremental


def grouped(rows):
    found = {}
    for r in rows:
        found.setdefault(r["file_id"], []).append((r["rule_id"], r["severity"]))
    return {k: sorted(v) for k, v in found.items()}


def test_every_markup_case_breaks_just_its_rules(spark):
    rows = [(f"{k}-{i}", s) for i, (_, bad, good) in enumerate(MARKUP) for k, s in (("bad", bad), ("good", good))] + [("none", None), ("empty", "")]
    facts = components.facts(spark.createDataFrame(rows, "file_id string, source string"), kind="markup")
    level = severities()
    assert grouped(lint_elements(components.elements(facts)).collect()) == {f"bad-{i}": sorted((r, level[r]) for r in named.split()) for i, (named, _, _) in enumerate(MARKUP)}
    assert {r: s for r, (s, _) in rules().items()} | {"correctness/no-deprecated-filter": "error"} == level
    assert set(level) == {r for named, *_ in MARKUP for r in named.split()}


def test_every_script_case_breaks_just_its_rules(spark):
    rows = [(f"{k}-{i}", s, (3, v, 0)) for i, (_, bad, good, v) in enumerate(SCRIPTS) for k, s in (("bad", bad), ("good", good))]
    files = spark.createDataFrame([*rows, ("none", None, None)], "file_id string, source string, vue_version struct<major:bigint,minor:bigint,patch:bigint>")
    facts = components.facts(files)
    level = {r: s for r, (s, _) in (RULES | PRACTICE).items()}
    assert components.issues(facts).collect() == []
    assert grouped(lint_blocks(facts, files).collect()) == {f"bad-{i}": sorted((r, level[r]) for r in named.split()) for i, (named, *_) in enumerate(SCRIPTS)}
    assert set(level) == {r for named, *_ in SCRIPTS for r in named.split()}


def test_odd_markup_is_read_without_end(spark):
    tag = "<p " + " ".join(f"a{i}" for i in range(100_000)) + ">x</p>"  # over half a megabyte in one tag
    rows = [("tag", tag), ("deep", "<div>" * 3000 + "x" + "</div>" * 3000), ("open", "<p title='"), ("text", "a < b <3 {{ never"), ("script", "<script>\"<marquee>\"</script>"), ("tick", "`${`${")]
    files = spark.createDataFrame(rows, "file_id string, source string")
    got = {r["file_id"]: r for r in components.facts(files, kind="markup").selectExpr("file_id", "size(elements) n", "size(get(elements, 0).attributes) a", "get(elements, 0).has_accessible_content c").collect()}
    assert (got["tag"]["n"], got["tag"]["a"], got["deep"]["n"], got["deep"]["c"], got["text"]["n"], got["script"]["n"]) == (1, 100_000, 3000, True, 0, 1)
    bad = [("a", "<script setup>const x = (</script>"), ("b", "<template><p>"), ("c", "<script>" + "(" * 20000 + ")" * 20000 + "</script>"), ("d", "<script>x</script><template><p/></template>")]
    assert {r["file_id"] for r in components.issues(components.facts(spark.createDataFrame(bad, "file_id string, source string"))).collect()} == {"a", "b", "c"}


def test_offsets_are_of_bytes(spark):
    source = "<p>é</p>\n<b title='ü' id=x>{{ é }}</b>"
    e = components.elements(components.facts(spark.createDataFrame([("f", source)], "file_id string, source string"), kind="markup")).filter("tag = 'b'").first()
    raw = source.encode()
    assert raw[e["offset"] : e["offset"] + e["length"]].decode() == "<b title='ü' id=x>" and (e["line"], e["column"]) == (2, 1)
    assert [raw[a["offset"] : a["offset"] + a["length"]].decode() for a in e["attributes"]] == ["title", "id"]


def test_names_are_counted_by_scope():
    names = Names(parse("import { a } from 'x'; let b = a; function f(b, { c = a }) { b++; return b + c } { let b = 1 } b = f(b); export { b as d }"))
    assert [(s.name, s.reads, s.writes) for s in names.symbols] == [("a", 2, 0), ("b", 2, 1), ("f", 1, 0), ("b", 2, 1), ("c", 1, 0), ("b", 0, 0)]
    with pytest.raises(ScriptError):
        parse("const x = {")


def test_jsx_is_read_as_a_template(spark):
    source = "export const A = () => <div onClick={() => go(n)} title=\"t\">it's {n} <img src={x}/><B.C {...p}>(</B.C></div>\nconst y = 1"
    facts = components.facts(spark.createDataFrame([("f.tsx", source)], "file_id string, source string"), kind="script", lang="tsx")
    assert [r["tag"] for r in components.elements(facts).collect()] == ["div", "img", "B.C"]
    assert {r["rule_id"] for r in lint_elements(components.elements(facts)).collect()} == {"accessibility/click-events-have-key-events", "accessibility/img-has-alt"}
    assert [r["name"] for r in components.part(facts, "bindings").collect()] == ["A", "y"]


def test_score_anchors(spark):
    def score(n, files):
        f = spark.range(files).select("id").withColumnRenamed("id", "file_id")
        found = spark.range(n).selectExpr("id * 0 as file_id", "'a/b' as rule_id", "'warning' as severity")
        return policy.project_score(f, found).first()["score"]

    assert (score(40, 1), score(100, 200), score(0, 3)) == (29, 97, 100)


def test_practice_findings_weigh_nothing(spark):
    f = spark.createDataFrame([(1, "practice/x", "error")], "file_id long, rule_id string, severity string")
    assert policy.file_scores(spark.createDataFrame([(1,), (2,)], "file_id long"), f).select("score").collect() == [(100,), (100,)]


def test_tracking_state(spark):
    rows = [("m", 1, "read"), ("m", 2, "pause"), ("m", 3, "read"), ("m", 4, "resume"), ("m", 5, "read")]
    got = script_rules.tracking_state(spark.createDataFrame(rows, "module_id string, offset long, kind string")).collect()
    assert sorted((r["offset"], r["tracked"]) for r in got) == [(1, True), (3, False), (5, True)]


def test_tracking_state_on_one_offset(spark):
    rows = [("m", 1, "read"), ("m", 1, "resume"), ("m", 1, "pause"), ("m", 1, "read"), ("n", 1, "read"), ("n", 1, "pause"), ("n", 2, "resume"), ("n", 2, "read"), ("n", 2, "pause")]
    for order in (rows, rows[::-1]):
        got = script_rules.tracking_state(spark.createDataFrame(order, "module_id string, offset long, kind string").coalesce(1)).collect()
        assert sorted(tuple(r) for r in got) == [("m", 1, True), ("m", 1, True), ("n", 1, False), ("n", 2, True)]


def test_tracking_state_takes_every_row(spark, tmp_path):
    lines = [(k % 7, k % 4, k * 5 % 23) for k in range(200)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want, state = [], {}
    for m, at, part in sorted(lines, key=lambda x: (x[0], x[1], {0: 0, 1: 1}.get(x[2] % 7, 2))):
        if part % 7 < 2:
            state[m] = part % 7 == 1
        else:
            want.append((m, at, state.get(m, True)))
    assert sorted(tuple(r) for r in tracking_state(spark, str(tmp_path)).collect()) == sorted(want)


def test_reverse_closure_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (9, 8)], "src long, dst long")
    got = graph.reverse_closure(e, spark.createDataFrame([(3,)], "id long")).collect()
    assert sorted((r["id"], r["depth"]) for r in got) == [(1, 2), (2, 1), (3, 0), (4, 1)]


@pytest.mark.parametrize("values,want", [(["x", "x"], "x"), (["x", "y"], None)])
def test_ambiguity_is_null(spark, values, want):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v string")
    assert graph.single_candidate(df, ["k"], "v").first()["v"] == want


def test_reverse_closure_of_a_long_chain(spark):
    n = 40
    e = spark.range(n).selectExpr("id AS src", "id - 1 AS dst")
    got = {r["id"]: r["depth"] for r in graph.reverse_closure(e, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {i: i for i in range(n)}


def brute_suppress(findings, directives):
    kept, used = [], set()
    for f, rule, line in findings:
        last, hidden = None, False
        for d in sorted((d for d in directives if d[0] == f), key=lambda d: d[4]):
            at, action, named = d[1], d[2], d[3]
            if at > line or (named and rule not in named):
                continue
            if action == "disable-next-line":
                if at + 1 == line:
                    hidden = True
                    used.add((f, d[4]))
            else:
                last = None if action == "enable" else d[4]
        if not hidden and last is not None:
            hidden = True
            used.add((f, last))
        if not hidden:
            kept.append((f, rule, line))
    return sorted(kept), sorted((d[0], d[4]) for d in directives if d[2] != "enable" and (d[0], d[4]) not in used)


def test_suppression_against_plain_loops(spark):
    import random

    rng = random.Random(2)
    found = [(f"f{rng.randrange(4)}", rng.choice(["a/x", "a/y", "b/z"]), rng.randrange(1, 12)) for _ in range(120)]
    marks = [(f"f{rng.randrange(5)}", line, rng.choice(["disable", "enable", "disable-next-line"]), rng.choice([[], ["a/x"], ["a/y", "b/z"], None]), line * 100 + k) for k, line in enumerate(rng.choices(range(1, 12), k=60))]
    marks = list({(m[0], m[1]): m for m in marks}.values())  # a line holds one directive
    stays, idle = policy.suppress(spark.createDataFrame(found, "file_id string, rule_id string, line int").withColumnRenamed("line", "line"), spark.createDataFrame(marks, "file_id string, line int, action string, rules array<string>, offset long"))
    kept, unused = brute_suppress(found, marks)
    assert sorted(tuple(r) for r in stays.collect()) == kept
    assert sorted((r["file_id"], r["offset"]) for r in idle.collect()) == unused


def test_suppressions_are_read_from_comments():
    text = "<!-- weft-disable a/b, c/d -->\nx // weft-enable\nweft-disable\n/* weft-disable-next-line */\n"
    got = components.parse_file(text, "markup")["directives"]
    assert [(d["line"], d["action"], d["rules"]) for d in got] == [(1, "disable", ["a/b", "c/d"]), (2, "enable", []), (4, "disable-next-line", [])]


def test_baseline_holds_findings_with_null_fields(spark, tmp_path):
    f = spark.createDataFrame([("r", "f", 1, None), ("r", "f", 1, "m"), ("r", None, 2, "m")], "rule_id string, file_id string, offset long, message string")
    policy.write_baseline(f.filter("message IS NULL OR file_id IS NULL"), f"{tmp_path}/b")
    assert [tuple(r) for r in policy.new_findings(f, policy.read_baseline(spark, f"{tmp_path}/b")).collect()] == [("r", "f", 1, "m")]
    spark.createDataFrame([("x", 9)], "fingerprint string, version int").write.parquet(f"{tmp_path}/c")
    with pytest.raises(ValueError):
        policy.read_baseline(spark, f"{tmp_path}/c")


def test_configuration(spark):
    f = spark.createDataFrame([("a/x", "error"), ("practice/y", "info"), ("analysis/parse-error", "error")], "rule_id string, severity string")
    run = lambda *a, **k: sorted(tuple(r) for r in policy.configure(f, *a, **k).collect())
    assert run({"a/x": "info", "analysis/parse-error": "off"}, practice=False) == [("a/x", "info"), ("analysis/parse-error", "error")]
    assert run({"practice/y": "warning"}, preset=False) == [("analysis/parse-error", "error"), ("practice/y", "warning")]
    assert policy.exit_code(f).first()[0] == 1 and policy.exit_code(f.filter("rule_id LIKE 'practice%'"), True).first()[0] == 0
    c = workspace.parse_config('version = 1\npractice = "off"\n[rules]\n"a/x" = "off"\n')
    assert (c["practice"], c["rules"], c["include"]) == ("off", {"a/x": "off"}, ["**/*.vue"])
    for bad in ("other = 1", "version = 2", '[rules]\n"a" = "loud"'):
        with pytest.raises(ValueError):
            workspace.parse_config(bad)


def test_patches_and_globs():
    patch = "+++ b/a.vue\n@@ -1,2 +3,2 @@\n@@ -9 +11 @@\n+++ b/new.vue\n+++ /dev/null\n+++ b/c d.vue\t\n@@ -1,2 +0,0 @@\n"
    assert workspace.parse_patch(patch) == [("a.vue", 3, 4), ("a.vue", 11, 11), ("new.vue", None, None), ("c d.vue", None, None)]
    import re

    hits = lambda g: [p for p in ("a.vue", "x/a.vue", "x/y/a.vue", "x/a.ts") if re.match(workspace.glob_regex(g), p)]
    assert (hits("**/*.vue"), hits("x/*.{vue,ts}"), hits("x/**")) == (["a.vue", "x/a.vue", "x/y/a.vue"], ["x/a.vue", "x/a.ts"], ["x/a.vue", "x/y/a.vue", "x/a.ts"])


def test_discovery_and_overlays(spark, tmp_path):
    for path, text in {"a.vue": "<p/>", "sub/b.ts": "1", "node_modules/x/c.vue": "no", "dist/d.vue": "no", "skip.vue": "s", "read.md": "no"}.items():
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".gitignore").write_text("dist/\n# note\n")
    found = workspace.discover(spark, str(tmp_path), exclude=["skip.*"])
    assert sorted(tuple(r) for r in found.collect()) == [("a.vue", "component", "vue", "<p/>"), ("sub/b.ts", "script", "ts", "1")]
    both = workspace.overlay(found, spark.createDataFrame([("a.vue", "new"), ("z.tsx", "t")], "file_id string, source string"))
    assert sorted((r["file_id"], r["kind"], r["source"]) for r in both.collect()) == [("a.vue", "component", "new"), ("sub/b.ts", "script", "1"), ("z.tsx", "script", "t")]


def test_edits(spark):
    files = spark.createDataFrame([("a", "héllo wörld"), ("b", "abc"), ("c", "é")], "file_id string, source string")
    rows = [("a", 0, 6, "bye", "safe", "r"), ("a", 7, 0, "<", "safe", "r"), ("a", 13, 0, "!", "safe", "r"), ("a", 1, 3, "no", "unsafe", "r"), ("b", 0, 2, "x", "safe", "r"), ("b", 1, 1, "y", "safe", "s"), ("c", 1, 0, "z", "safe", "r")]
    e = spark.createDataFrame(rows, "file_id string, offset long, length long, replacement string, applicability string, rule_id string")
    assert {r["file_id"]: (r["source"], r["applied"]) for r in edits.apply(files, e).collect()} == {"a": ("bye <wörld!", 3), "b": ("abc", 0), "c": ("é", 0)}


LINKS = "module string, source string, target string"


def resolved(spark, own, over, links):
    e = spark.createDataFrame([(m, n, s, k, []) for m, n, s, k in own], "module string, exported string, state string, kind string, fields array<struct<field:string,kind:string>>")
    r = exports.resolve_exports(e, spark.createDataFrame(over, "module string, source string, imported string, exported string"), spark.createDataFrame(links, LINKS))
    return {(x["module"], x["name"]): x["kind"] for x in r.collect()}


def test_exports_through_barrels_cycles_and_conflicts(spark):
    own = [("a", "x", "known", "ref"), ("b", "x", "known", "computed"), ("a", "default", "known", "ref"), ("h", "x", "local", None), ("c1", "y", "known", "ref")]
    over = [("s", "./a", "*", "*"), ("two", "./a", "*", "*"), ("two", "./b", "*", "*"), ("up", "./two", "x", "z"), ("h", "./a", "*", "*"), ("n", "./s", "x", "renamed"), ("c1", "./c2", "*", "*"), ("c2", "./c1", "*", "*"), ("l1", "./l2", "q", "q"), ("l2", "./l1", "q", "q"), ("lost", "./none", "x", "x"), ("d", "./a", "default", "made")]
    links = [(m, s, s[2:]) for m, s, *_ in over if s != "./none"]
    got = resolved(spark, own, over, links)
    assert got == {("a", "x"): "ref", ("a", "default"): "ref", ("b", "x"): "computed", ("s", "x"): "ref", ("n", "renamed"): "ref", ("c1", "y"): "ref", ("c2", "y"): "ref", ("d", "made"): "ref"}
    chain = [(f"m{i}", "./b", "x", "x") for i in range(1, 20)]
    assert len(resolved(spark, [("m0", "x", "known", "ref")], chain, [(f"m{i}", "./b", f"m{i - 1}") for i in range(1, 20)])) == 20


def test_seeds_reach_the_second_trace(spark):
    files = spark.createDataFrame([("a.ts", "export const n = ref(0); export { n as m }"), ("b.ts", "import { m as own } from './a'; watchEffect(() => own.value)")], "file_id string, source string")
    one = components.facts(files, kind="script")
    mod = lambda name: components.part(one, name).withColumnRenamed("file_id", "module")
    imports = components.part(one, "imports")
    links = project.resolve(imports, files).filter("outcome = 'file'").selectExpr("file_id AS module", "source", "target")
    known = exports.resolve_exports(mod("exports"), mod("reexports"), links)
    two = components.facts(files, kind="script", seeds=exports.seeds(imports, known, links))
    reads = lambda f: components.part(f, "g_scopes").selectExpr("explode(reads) AS x").collect()
    assert reads(one) == [] and [(r["x"]["binding"], r["x"]["kind"]) for r in reads(two)] == [("own", "unconditional")]


def test_composables_cross_files(spark):
    files = [("use.ts", "export function useX() { const a = ref(0); const b = 1; return { a, b, c: computed(() => 1) } }\nexport const make = () => shallowRef(0)"), ("all.ts", "export * from './use'")]
    files += [("c.ts", "import { useX, make } from './all'; const { a, b, c: d } = useX(); const m = make(); const { data } = useFetch('/x'); watchEffect(() => [a.value, b.value, d.value, m.value, data.value])")]
    files = spark.createDataFrame(files, "file_id string, source string")
    one = components.facts(files, kind="script")
    mod = lambda name: components.part(one, name).withColumnRenamed("file_id", "module")
    imports = components.part(one, "imports")
    links = project.resolve(imports, files).filter("outcome = 'file'").selectExpr("file_id AS module", "source", "target").distinct()
    known = exports.resolve_exports(mod("exports"), mod("reexports"), links)
    two = components.facts(files, kind="script", seeds=exports.seeds(imports, known, links))
    assert {(r["name"], r["kind"]) for r in components.part(two, "g_bindings").filter("file_id = 'c.ts'").collect()} == {("a", "ref"), ("d", "computed"), ("m", "shallow_ref"), ("data", "ref")}
    assert {r["x"]["binding"] for r in components.part(two, "g_scopes").filter("file_id = 'c.ts'").selectExpr("explode(reads) AS x").collect()} == {"a", "d", "m", "data"}


def test_project_graph(spark):
    files = spark.createDataFrame([(p,) for p in ("src/App.vue", "src/components/base/Btn.vue", "src/components/Card.vue", "src/components/Card.spec.vue", "src/components/Lone.vue", "src/lib/index.ts")], "file_id string")
    imports = spark.createDataFrame([("src/App.vue", s, n) for s, n in (("./components/Card.vue", "Card"), ("@/lib", "x"), ("./gone", "y"), ("vue", "z"), ("./a.css", ""))], "file_id string, source string, local string").selectExpr("*", "0L AS offset", "1 AS line")
    r = project.resolve(imports, files)
    assert {(x["source"], x["outcome"]) for x in r.collect()} == {("./components/Card.vue", "file"), ("@/lib", "file"), ("./gone", "unresolved"), ("vue", "external"), ("./a.css", "quiet")}
    assert [x["file_id"] for x in project.unresolved_imports(r).collect()] == ["src/App.vue"]
    tags = spark.createDataFrame([("src/App.vue", "base-btn"), ("src/App.vue", "Card"), ("src/App.vue", "div")], "file_id string, tag string")
    edges = project.component_edges(tags, r, files)
    assert {(x["dst"], x["kind"]) for x in edges.collect()} == {("src/components/base/Btn.vue", "auto_component"), ("src/components/Card.vue", "component_usage")}
    assert [x["file_id"] for x in project.unused_components(files, edges.unionByName(project.import_edges(r))).collect()] == ["src/components/Lone.vue"]
    assert {x["file_id"]: (x["uses"], x["used_by"]) for x in project.navigation(edges).collect()}["src/App.vue"] == (["src/components/Card.vue", "src/components/base/Btn.vue"], [])


def test_reports(spark):
    import json

    f = spark.createDataFrame([("a,b.vue", "c/r", "error", "100%\nx", 5, 2, 3, 4)], "file_id string, rule_id string, severity string, message string, offset long, length long, line int, column int")
    assert reports.annotations(f).first()["annotation"] == "::error file=a%2Cb.vue,line=3,col=4,title=c/r::100%25%0Ax"
    assert reports.text_lines(f).first()["line_text"] == "a,b.vue:3:4 error c/r 100%\nx"
    one, two = json.loads(reports.json_lines(f).first()["json"]), json.loads(reports.sarif_results(f).first()["json"])
    assert one["span"] == {"offset": 5, "length": 2, "line": 3, "column": 4} and two["partialFingerprints"]["id"] == one["id"]
    assert json.loads(reports.sarif_rules(f).first()["json"])["defaultConfiguration"]["level"] == "error"
    head = json.loads(reports.summary(f, policy.project_score(f, f)).first()["json"])
    assert head["ok"] is False and head["summary"]["finding_count"] == 1


def test_what_is_read_where(spark):
    src = "<script setup>\nconst n = ref(0), m = computed(() => n.value + 1)\nwatch(n, () => n.value)\n</script>\n<template><p :title='m'>{{ n }}</p></template>"
    facts = components.facts(spark.createDataFrame([("f", src)], "file_id string, source string"))
    assert {(r["from"], r["to"], r["kind"]) for r in reports.dependency_edges(facts).collect()} >= {("n", "m", "computed"), ("m", "<template:title>", "template"), ("n", "<template:interpolation>", "template")}
    assert reports.hotspots(facts).first()["weight"] == 2 + 3 + 2
    at = src.index("n.value + 1")
    assert reports.covering_scope(facts, spark.createDataFrame([("f", at)], "file_id string, at long")).first()["callee"] == "computed"
    assert {(r["callee"], tuple(r["tracks"]), tuple(r["does_not_track"])) for r in reports.explain_scopes(facts).collect()} == {("computed", ("n.value",), ()), ("watch", ("n.value",), ()), ("watch", (), ("n.value",))}


def test_a_stream_of_edits_leaves_what_a_clean_scan_finds(spark, tmp_path):
    import random

    rng = random.Random(3)
    scan = lambda some, every: lint_elements(components.elements(components.facts(some, kind="markup"))).select("file_id", "rule_id")
    store = incremental.Store(spark, str(tmp_path / "store"))
    state, source = {}, str(tmp_path / "in")
    for batch in range(3):
        rows = [(f"f{rng.randrange(6)}", rng.randrange(9), rng.choice(["<marquee>x</marquee>", "<img>", "<p>x</p>", None])) for _ in range(5)]
        rows = list({(f, v): (f, v, s) for f, v, s in rows if (f, v) not in {(k, w) for k, (w, _) in state.items()}}.values())
        for f, v, s in rows:
            if f not in state or v > state[f][0]:
                state[f] = (v, s)
        spark.createDataFrame(rows, incremental.CHANGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(incremental.CHANGES).parquet(source)
        incremental.run(stream, store, scan, str(tmp_path / "cp")).awaitTermination()
    live = spark.createDataFrame([(f, s) for f, (_, s) in state.items() if s is not None], "file_id string, source string")
    assert sorted(tuple(r) for r in store.findings().collect()) == sorted(tuple(r) for r in scan(live, live).collect())
    before = store._pointer()
    store.apply(spark.createDataFrame([("f0", 99, "<img>")], incremental.CHANGES), scan, before)
    assert store._pointer() == before


def test_without_the_corpus_operators(tmp_path):
    """The entry imports and the core queries are there when llm and the pipeline are gone, or can't be imported."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    shutil.copytree(os.path.join(root, "weftfacts"), tmp_path / "weftfacts", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lint' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "weftfacts" / "llm").mkdir()
    (tmp_path / "weftfacts" / "llm" / "__init__.py").write_text("import a_package_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("from weftfacts.llm.x import y\n")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.parametrize("name", ["configured_score", "file_scores", "lint", "project_score"])
def test_a_text_is_parsed_once_for_all_its_files(spark, monkeypatch, name):
    """The 200 derived files hold some dozens of texts."""
    parsed, whole = [], components.facts

    def facts(files, *args, **kw):
        parsed.append(files.count())
        return whole(files, *args, **kw)

    monkeypatch.setattr(components, "facts", facts)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert parsed and max(parsed) <= 60


def test_every_file_gets_the_rows_of_its_text(spark):
    texts = ["<p v-if>x</p>", "<marquee></marquee><a></a>", "<em>x</em>", "", None]
    rows = [(i, texts[i % 5], i % 2) for i in range(40)]
    files = spark.createDataFrame(rows, "file_id long, source string, kind int")
    found = lambda some: lint_elements(components.elements(components.facts(some, kind="markup"))).select("file_id", "rule_id", "offset")
    assert sorted(components.by_text(files, found).collect()) == sorted(found(files).collect())
    both = components.by_text(files, lambda some: some.select("file_id", "kind", "source"), "kind")
    assert sorted((r.file_id, r.source or "", r.kind) for r in both.collect()) == sorted((i, t or "", k) for i, t, k in rows)
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_import_resolution_broadcasts_nothing(spark):
    """However small the tables look: Spark knows their files' sizes, not those of the paths made from them."""
    files = spark.createDataFrame([("src/a.ts",), ("src/a/index.js",), ("src/b.d.ts",), ("index.vue",), ("lib/c.x",)], "file_id string")
    imports = [("./a", "src/a.ts"), ("./b", "src/b.d.ts"), ("./b.d", "src/b.d.ts"), ("@/a/index", "src/a/index.js"), ("../lib/c.x", "lib/c.x"), ("../index", "index.vue"), ("./none", None), ("pkg", None)]
    out = project.resolve(spark.createDataFrame([("src/z.ts", s) for s, _ in imports], "file_id string, source string"), files)
    assert "Broadcast" not in _plan(out) and "Broadcast" not in _plan(catalog.resolved_imports(spark, "/root/testdata/sf0.001"))
    assert {r.source: r.target for r in out.collect()} == dict(imports)


def test_export_rounds_broadcast_nothing(spark, monkeypatch):
    plans, write = [], exports.materialize

    def materialize(df):
        plans.append(_plan(df))
        return write(df)

    monkeypatch.setattr(exports, "materialize", materialize)
    assert catalog.export_chains(spark, "/root/testdata/sf0.001").count() > 0
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_a_component_name_is_made_once(spark):
    """Its words were an expression named three times, once for each of the words."""
    assert str(project.component_name()).count("upper(") == 1
    files = spark.createDataFrame([("components/base/baseItem/item-row.client.vue",), ("components/a/index.vue",), ("pages/x.vue",)], "file_id string")
    assert [r.c for r in files.select(project.component_name().alias("c")).collect()] == ["BaseItemItemRow", "A", None]
    assert "Broadcast" not in _plan(catalog.unused_components(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name, texts", [("lint_scripts", 2 * len(SCRIPTS)), ("tracked_reads", 6)])
def test_a_script_is_parsed_once_for_all_its_files(spark, monkeypatch, name, texts):
    """2,000 derived files."""
    parsed, whole = [], components.facts

    def facts(files, *args, **kw):
        parsed.append(files.count())
        return whole(files, *args, **kw)

    monkeypatch.setattr(components, "facts", facts)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert parsed and max(parsed) <= texts
