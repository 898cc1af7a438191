"""Which reactive values a module declares, and which of them each tracking scope reads and writes.

Works on one parsed module. It under-approximates: where a read's binding, callback or guard can't be told, nothing is said.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sources.script import FUNCTIONS, Names, Node, Symbol, kids, pattern_names, walk

REF_LIKE = frozenset(("ref", "shallow_ref", "computed", "custom_ref", "to_ref", "template_ref", "model_ref"))
OBJECTS = frozenset(("reactive", "shallow_reactive", "readonly", "shallow_readonly"))
KINDS = {
    "ref": "ref", "shallowRef": "shallow_ref", "computed": "computed", "reactive": "reactive", "defineProps": "reactive", "useRoute": "reactive", "useRouter": "reactive", "shallowReactive": "shallow_reactive",
    "readonly": "readonly", "shallowReadonly": "shallow_readonly", "customRef": "custom_ref", "toRef": "to_ref", "toRefs": "to_ref", "storeToRefs": "to_ref", "useTemplateRef": "template_ref", "defineModel": "model_ref", "defineModels": "model_ref",
}
SCOPES = {"watchEffect": "watch_effect", "watchPostEffect": "watch_post_effect", "watchSyncEffect": "watch_sync_effect", "computed": "computed", "watch": "watch_sources", "effectScope": "effect_scope", "onScopeDispose": "on_scope_dispose"}
_OTHERS = frozenset(("pauseTracking", "enableTracking", "resetTracking", "unref", "toValue", "withDefaults", "provide", "inject"))
_MACROS = frozenset(("defineModel", "defineModels", "defineProps", "withDefaults"))
_FROM = {"vue": frozenset((*KINDS, *SCOPES, *_OTHERS)) - _MACROS | {"defineProps"}, "pinia": frozenset(("storeToRefs",)), "vue-router": frozenset(("useRoute", "useRouter"))}
_FROM["#imports"] = _FROM["vue"]
_TYPES = {"Ref": "ref", "RemovableRef": "ref", "ShallowRef": "shallow_ref", "ComputedRef": "computed", "WritableComputedRef": "computed", "CustomRef": "custom_ref", "ToRef": "to_ref"}
_TYPE = re.compile(r"(?:Readonly<\s*)?(\w+)\s*<")
_SYNC_FIRST = frozenset("filter map forEach reduce reduceRight some every find findIndex findLast findLastIndex flatMap sort toSorted toSpliced".split())
_DEFERRED = frozenset(("nextTick", "queueMicrotask", "setTimeout"))

#: Functions of common packages that return an object of reactive values: where they come from, and its fields.
_DATA = dict.fromkeys(("data", "pending", "error", "status"), "ref")
BAGS = {c: (("#imports", "#app", "nuxt/app"), _DATA) for c in ("useAsyncData", "useLazyAsyncData", "useFetch", "useLazyFetch")}
BAGS["useI18n"] = (("vue-i18n", "#imports"), dict.fromkeys(("locale", "fallbackLocale", "locales", "messages", "availableLocales"), "computed"))

Span = Callable[[int, int], tuple[int, int, int, int]]


def peel(n: Node | None) -> Node | None:
    while n and n["t"] in ("Cast", "Await"):
        n = n["value"]
    return n


def _in(n: Node | None, x: Node) -> bool:
    return n is not None and n["a"] <= x["a"] and x["z"] <= n["z"]


class Tracer:
    def __init__(self, program: Node, names: Names, setup: bool, span: Span, seeds: dict[str, str] | None = None) -> None:
        self.program, self.names, self.setup, self.span = program, names, setup, span
        self.parent: dict[int, Node] = {}
        self.nodes: list[Node] = []
        for n in walk(program):
            self.nodes.append(n)
            for k in kids(n):
                self.parent[id(k)] = n
        self.imports: dict[str, tuple[str, str]] = {}
        for n in program["body"]:
            if n["t"] == "Import":
                for x in n["names"] or []:
                    self.imports[x["local"]["name"]] = (n["source"], x["imported"])
        self.kind: dict[int, str] = {}  # by symbol
        self.open: set[int] = set()
        self.symbol: dict[int, Symbol] = {}
        self.null: set[int] = set()
        self.effect_scopes: set[int] = set()
        # Seeds are names of imported values, `f()` for what a function returns and `f().field` for what it returns an object of.
        self.shapes: dict[str, dict[str, str]] = {}
        self.returns: dict[str, str] = {}
        for name, kind in (seeds or {}).items():
            head, call, field = name.partition("()")
            if call and field:
                self.shapes.setdefault(head, {})[field[1:]] = kind
            elif call:
                self.returns[head] = kind
            elif sym := names.top.find(name):
                self._bind(sym, kind)
        self._bindings()
        self.scopes = self._scopes()

    # Bindings.
    def callee(self, call: Node, setup: bool | None = None) -> str | None:
        """The reactivity function a call resolves to."""
        c = call["callee"]
        setup = self.setup if setup is None else setup
        if c["t"] == "Name":
            name = c["name"]
            if name in _MACROS and setup and name not in self.imports:
                return name
            if name in self.imports:
                source, imported = self.imports[name]
                return imported if imported in _FROM.get(source, ()) else None
            return name if name not in _MACROS and name in _FROM["vue"] and c.get("sym") is None else None
        if c["t"] == "Member" and c["object"]["t"] == "Name" and c["name"]:
            source, imported = self.imports.get(c["object"]["name"], ("", ""))
            if imported == "*" and source in ("vue", "#imports") and c["name"] in _FROM["vue"]:
                return c["name"]
        return None

    def _bind(self, sym: Symbol, kind: str) -> None:
        self.kind.setdefault(id(sym), kind)
        self.symbol[id(sym)] = sym

    def _declared(self, n: Node) -> Symbol | None:
        return next((s for s in self.names.symbols if s.a == n["a"] and s.name == n["name"]), None) if n["t"] == "Name" else None

    def _kind_of(self, e: Node | None) -> str | None:
        e = peel(e)
        if not e:
            return None
        if e["t"] == "Call":
            name = self.callee(e)
            if name == "withDefaults":
                return "reactive"
            if name is None and e["callee"]["t"] == "Name":
                return self._of_call(e["callee"])[0]
            return KINDS.get(name or "") if name not in ("toRefs", "storeToRefs", "defineModels") else None
        if e["t"] == "Name":
            return self.kind.get(id(e.get("sym"))) if e.get("sym") else None
        if e["t"] == "Ternary":
            a, b = self._kind_of(e["yes"]), self._kind_of(e["no"])
            return a if a == b else "ref" if a in REF_LIKE and b in REF_LIKE else None
        return None

    def _of_call(self, c: Node) -> tuple[str | None, dict[str, str]]:
        """(kind, fields) of what a function named here returns: one of this file, an imported one, or one of a package."""
        name, sym = c["name"], c.get("sym")
        if name in self.imports and sym is self.names.top.names.get(name):
            source, imported = self.imports[name]
            if imported in BAGS and source in BAGS[imported][0]:
                return None, BAGS[imported][1]
            return self.returns.get(name), self.shapes.get(name, {})
        if sym is None:
            return None, BAGS[name][1] if name in BAGS else {}
        fn = self._function(sym)
        if not fn or not fn["body"] or fn["async"] or id(fn) in self.open:
            return None, {}
        self.open.add(id(fn))  # a function that returns a call of itself says nothing
        got = self._returned(fn)
        self.open.discard(id(fn))
        return got.get("kind"), {f["field"]: f["kind"] for f in got.get("fields", [])}

    def _typed(self, ty: str | None) -> str | None:
        m = _TYPE.match(ty or "")
        return _TYPES.get(m.group(1)) if m else None

    def _bindings(self) -> None:
        by_start = {(s.a, s.name): s for s in self.names.symbols}
        declared = [n for n in self.nodes if n["t"] in ("Declarator", "Param")]
        changed = True
        while changed:  # aliases of aliases: until nothing new
            before = len(self.kind)
            for d in declared:
                target, init = d["target"], peel(d.get("init"))
                if target["t"] == "Name":
                    sym = by_start.get((target["a"], target["name"]))
                    kind = self._kind_of(init) or self._typed(d.get("ty"))
                    if sym and kind:
                        self._bind(sym, kind)
                        if init and init["t"] == "Call" and kind == "ref" and init["args"] and init["args"][0].get("value") == "null" and init["args"][0]["t"] == "Literal":
                            self.null.add(id(sym))
                    if sym and init and init["t"] == "Call" and self.callee(init) == "effectScope":
                        self.effect_scopes.add(id(sym))
                elif init and init["t"] == "Call":
                    name = self.callee(init)
                    kind = {"toRefs": "to_ref", "storeToRefs": "to_ref", "defineModels": "model_ref"}.get(name or "")
                    if kind and target["t"] == "ObjectPattern":
                        for x in pattern_names(target):
                            if sym := by_start.get((x["a"], x["name"])):
                                self._bind(sym, kind)
                    elif name is None and init["callee"]["t"] == "Name" and target["t"] == "ObjectPattern":
                        fields = self._of_call(init["callee"])[1]
                        for f in target["found"]:
                            x = f["value"]
                            if f["t"] == "Field" and x["t"] == "Name" and f["key"]["name"] in fields and (sym := by_start.get((x["a"], x["name"]))):
                                self._bind(sym, fields[f["key"]["name"]])
                    elif name == "defineModel" and target["t"] == "ArrayPattern" and target["found"] and target["found"][0]["value"]["t"] == "Name":
                        x = target["found"][0]["value"]
                        if sym := by_start.get((x["a"], x["name"])):
                            self._bind(sym, "model_ref")
            changed = len(self.kind) > before
        for n in self.nodes:  # setup(props) of an options object
            if n["t"] == "Property" and n["key"]["name"] == "setup" and n["value"]["t"] in FUNCTIONS and n["value"]["params"]:
                x = n["value"]["params"][0]["target"]
                if x["t"] == "Name" and (sym := by_start.get((x["a"], x["name"]))):
                    self._bind(sym, "reactive")

    def bindings(self) -> list[dict]:
        out = []
        for key, sym in self.symbol.items():
            offset, length, line, column = self.span(sym.a, sym.z)
            out.append({"name": sym.name, "kind": self.kind[key], "initialized_with_null": key in self.null, "offset": offset, "length": length, "line": line, "column": column})
        return sorted(out, key=lambda b: b["offset"])

    def known(self, n: Node) -> str | None:
        """The kind of the binding a name refers to."""
        return self.kind.get(id(n.get("sym"))) if n["t"] == "Name" and n.get("sym") else None

    # Reads.
    def _tracked(self, fn: Node) -> str:
        """How a function inside a scope runs: `sync`, `deferred`, or unknown."""
        call = self.parent.get(id(fn))
        if not call or call["t"] != "Call" or fn is call["callee"]:
            return "sync" if call and call["t"] == "Call" else "unknown"
        at, c = next(i for i, x in enumerate(call["args"]) if x is fn), call["callee"]
        if c["t"] == "Member":
            m, root = c["name"], c["object"].get("name") if c["object"]["t"] == "Name" else None
            if m in _SYNC_FIRST and at == 0 or m in ("replace", "replaceAll") and at == 1 or at == 1 and (root, m) in (("Array", "from"), ("JSON", "parse")):
                return "sync"
            if m in ("then", "catch", "finally", "nextTick"):
                return "deferred"
        if c["t"] == "Name" and c["name"] in _DEFERRED:
            return "deferred"
        return "sync" if at == 0 and self.callee(call, True) == "toValue" else "unknown"

    def _raw(self, fn: Node, body: Node, depth: int = 0, seen: frozenset[int] = frozenset()) -> list[dict]:
        """Reads in a body, in order: binding, property, the node that stands for them in the scope, whether outside."""
        out: list[dict] = []

        def add(n: Node, sym: Symbol, prop: str | None, outside: bool) -> None:
            out.append({"binding": sym.name, "property": prop, "node": n, "outside": outside})

        def visit(n: Node, outside: bool) -> None:
            t = n["t"]
            if t in FUNCTIONS:
                how = self._tracked(n)
                if how == "unknown":
                    return
                visit_all(n, outside or how == "deferred")
                return
            if t == "Member":
                o, kind = n["object"], self.known(n["object"])
                if kind:
                    if not (kind in REF_LIKE and n["name"] != "value"):
                        add(n, o["sym"], n["name"], outside)
                    if n["computed"] and n["computed"]["t"] != "String":
                        visit(n["computed"], outside)
                    return
            elif t == "Call":
                name = self.callee(n, True)
                if name in ("unref", "toValue") and n["args"] and self.known(n["args"][0]) in REF_LIKE:
                    add(n, n["args"][0]["sym"], "value", outside)
                    return
                c = n["callee"]
                if c["t"] == "Name" and c.get("sym") and not n["args"] and depth < 2 and id(c["sym"]) not in seen:
                    helper = self._function(c["sym"])
                    if helper and not helper["async"] and helper["body"]:
                        for r in self._raw(helper, helper["body"], depth + 1, seen | {id(c["sym"])}):
                            out.append(r | {"node": n, "outside": r["outside"] or outside})
                        return
            elif t == "Name":
                if self.known(n) in OBJECTS:
                    add(n, n["sym"], None, outside)
                return
            elif t == "Assign":
                left = n["left"]
                if n["op"] == "=" and left["t"] == "Member" and self.known(left["object"]):
                    if left["computed"] and left["computed"]["t"] != "String":
                        visit(left["computed"], outside)
                elif not (n["op"] == "=" and left["t"] == "Name"):
                    visit(left, outside)
                visit(n["right"], outside)
                return
            visit_all(n, outside)

        def visit_all(n: Node, outside: bool) -> None:
            for k in kids(n):
                if k["t"] not in ("Key",) or k["computed"]:
                    visit(k, outside)

        visit(body, False)
        return sorted(out, key=lambda r: r["node"]["a"])

    def _function(self, sym: Symbol) -> Node | None:
        d = sym.declared
        if d["t"] == "Function":
            return d
        init = peel(d.get("init")) if d["t"] == "Declarator" else None
        return init if init and init["t"] in FUNCTIONS else None

    def _up(self, n: Node, stop: Node) -> list[Node]:
        out = []
        p = self.parent.get(id(n))
        while p and p is not stop:
            out.append(p)
            p = self.parent.get(id(p))
        return out

    @staticmethod
    def _exits(n: Node) -> bool:
        if n["t"] == "Block":
            return bool(n["body"]) and Tracer._exits(n["body"][-1])
        return n["t"] in ("Return", "Throw")

    def _guards(self, fn: Node, raw: list[dict], r: dict) -> list[dict]:
        found: list[tuple[dict, str]] = []
        at, same = r["node"], lambda a, b: a["binding"] == b["binding"] and a["property"] == b["property"]

        def within(n: Node, role: str) -> None:
            found.extend((g, role) for g in raw if not g["outside"] and g is not r and _in(n, g["node"]))

        body = fn["body"]
        if body["t"] == "Block":
            for s in body["body"]:
                if s["z"] > at["a"]:
                    break
                if s["t"] == "If" and (self._exits(s["yes"]) or s["no"] and self._exits(s["no"])):
                    within(s["test"], "early_exit")
        for p in self._up(at, fn):
            if p["t"] in ("If", "Ternary") and (_in(p["yes"], at) or _in(p["no"], at)):
                arms = [any(not g["outside"] and same(g, r) and _in(arm, g["node"]) for g in raw) for arm in (p["yes"], p["no"])]
                if not all(arms):
                    within(p["test"], "branch_test")
            elif p["t"] == "Logical" and _in(p["right"], at):
                within(p["left"], "short_circuit")
            elif p["t"] == "Case":
                sw = self.parent.get(id(p))
                if sw and sw["t"] == "Switch" and not _in(p["test"], at):
                    within(sw["test"], "switch_discriminant")
        seen, out = set(), []
        for g, role in sorted(found, key=lambda x: x[0]["node"]["a"]):
            if id(g) not in seen:
                seen.add(id(g))
                offset, length, line, column = self.span(g["node"]["a"], g["node"]["z"])
                out.append({"binding": g["binding"], "property": g["property"], "role": role, "offset": offset})
        return out

    def _own(self, fn: Node) -> list[Node]:
        """Nodes of a function's body outside nested functions."""
        out, stack = [], [fn["body"]]
        while stack:
            n = stack.pop()
            out.append(n)
            if n["t"] not in FUNCTIONS:
                stack.extend(kids(n))
        return out

    def _reads(self, fn: Node, forced: bool = False) -> list[dict]:
        raw = self._raw(fn, fn["body"])
        own = self._own(fn)
        awaits = [n["z"] for n in own if n["t"] == "Await"]
        first_await = min(awaits, default=None)
        events = sorted((n["z"], self.callee(n, True)) for n in own if n["t"] == "Call" and self.callee(n, True) in ("pauseTracking", "enableTracking", "resetTracking"))
        out = []
        for r in raw:
            n = r["node"]
            paused = next((name == "pauseTracking" for z, name in reversed(events) if z <= n["a"]), False)
            outside = r["outside"] or paused or forced
            guards = [] if outside else self._guards(fn, raw, r)
            kind = "outside_tracking" if outside else "after_await" if first_await is not None and n["a"] >= first_await else "conditional" if guards else "unconditional"
            offset, length, line, column = self.span(n["a"], n["z"])
            out.append({"binding": r["binding"], "property": r["property"], "kind": kind, "guards": guards, "guarded_by": guards[0]["binding"] if guards else None, "offset": offset, "length": length, "line": line, "column": column})
        return out

    def _writes(self, fn: Node) -> list[dict]:
        out = []
        for n in self._own(fn):
            if n["t"] == "Assign" and n["op"] == "=" and n["left"]["t"] == "Member":
                m, kind = n["left"], self.known(n["left"]["object"])
                if kind and (kind not in REF_LIKE or m["name"] == "value"):
                    offset, length, line, column = self.span(m["a"], m["z"])
                    out.append({"binding": m["object"]["name"], "property": m["name"], "offset": offset, "length": length, "line": line, "column": column})
        return sorted(out, key=lambda w: w["offset"])

    def _uncertain(self, e: Node) -> list[str]:
        """Roots of .value accesses that are no known binding."""
        found = {n["object"]["name"]: 1 for n in walk(e) if n["t"] == "Member" and n["name"] == "value" and n["object"]["t"] == "Name" and not self.known(n["object"])}
        return sorted(found)

    @staticmethod
    def _assignment_only(fn: Node) -> bool:
        b = fn["body"]
        if b["t"] != "Block":
            return b["t"] == "Assign"
        return bool(b["body"]) and all(s["t"] == "Empty" or s["t"] == "Expression" and s["value"]["t"] == "Assign" for s in b["body"])

    def _scope(self, kind: str, callee: str, call: Node, fn: Node, binding: str | None = None, forced: bool = False) -> dict:
        offset, length, line, column = self.span(call["a"], call["z"])
        return {
            "kind": kind, "callee": callee, "reads": self._reads(fn, forced), "writes": self._writes(fn), "assignment_only": self._assignment_only(fn), "binding": binding,
            "uncertain_accesses": self._uncertain(fn["body"]), "offset": offset, "length": length, "line": line, "column": column,
        }

    def _assigned(self, call: Node) -> str | None:
        p = self.parent.get(id(call))
        return p["target"]["name"] if p and p["t"] == "Declarator" and p["target"]["t"] == "Name" else None

    def _scopes(self) -> list[dict]:
        out = []
        fn_of = lambda e: e if e and e["t"] in FUNCTIONS and e["body"] else None
        calls = sorted((n for n in self.nodes if n["t"] == "Call"), key=lambda n: (n["a"], -n["z"]))
        for n in calls:
            c, first = n["callee"], n["args"][0] if n["args"] else None
            if c["t"] == "Member" and c["name"] == "run" and c["object"]["t"] == "Name" and id(c["object"].get("sym")) in self.effect_scopes and fn_of(first):
                out.append(self._scope("effect_scope", "effectScope.run", n, first))
                continue
            name = self.callee(n, False)
            kind = SCOPES.get(name or "")
            if not kind or first is None:
                continue
            if kind == "watch_sources":
                offset, length, line, column = self.span(n["a"], n["z"])
                out.append({"kind": kind, "callee": name, "reads": self._sources(first), "writes": [], "assignment_only": False, "binding": None, "uncertain_accesses": self._uncertain(first), "offset": offset, "length": length, "line": line, "column": column})
                if len(n["args"]) > 1 and fn_of(n["args"][1]):
                    out.append(self._scope("watch_callback", name, n, n["args"][1], forced=True))
                continue
            fn = fn_of(first)
            if not fn and kind == "computed" and first["t"] == "Object":
                fn = next((fn_of(p["value"]) for p in first["found"] if p["t"] == "Property" and p["key"]["name"] == "get"), None)
            if fn:
                out.append(self._scope(kind, name, n, fn, self._assigned(n) if kind in ("computed", "effect_scope") else None, kind == "on_scope_dispose"))
        for n in self.nodes:  # bodies that render: an option of that name, or what setup returns
            if n["t"] == "Property" and n["value"]["t"] in FUNCTIONS and n["value"]["body"] and n["key"]["name"] in ("render", "setup"):
                found = [n["value"]] if n["key"]["name"] == "render" else [v for x in self._own(n["value"]) if x["t"] == "Return" and (v := fn_of(peel(x["value"])))]
                out += [self._scope("render", "render", fn, fn) for fn in found]
        return sorted(out, key=lambda s: s["offset"])

    def _sources(self, e: Node) -> list[dict]:
        e = peel(e)
        if e["t"] == "Array":
            return [r for x in e["found"] for r in self._sources(x)]
        if e["t"] in FUNCTIONS:
            return self._reads(e) if e["body"] else []
        kind = self.known(e)
        if kind:
            prop = "value" if kind in REF_LIKE else "*" if kind in ("reactive", "shallow_reactive") else None
            if prop is None:
                return []
            n, name = e, e["name"]
        elif e["t"] == "Member" and self.known(e["object"]) and not (self.known(e["object"]) in REF_LIKE and e["name"] != "value"):
            n, name, prop = e, e["object"]["name"], e["name"]
        else:
            return []
        offset, length, line, column = self.span(n["a"], n["z"])
        return [{"binding": name, "property": prop, "kind": "unconditional", "guards": [], "guarded_by": None, "offset": offset, "length": length, "line": line, "column": column}]

    # What other modules can take from this one.
    def exports(self) -> list[dict]:
        """(exported, state, kind, fields): `known` values of a kind, `factory` functions that return one, `composable`
        functions that return an object of them, and `local` names about which nothing is known."""
        out: dict[str, dict] = {}

        def put(name: str, sym: Symbol | None, value: Node | None = None) -> None:
            state = {"exported": name, "state": "local", "kind": None, "fields": []}
            kind = self.kind.get(id(sym)) if sym else self._kind_of(value)
            fn = self._function(sym) if sym else value if value and value["t"] in FUNCTIONS else None
            if kind:
                state |= {"state": "known", "kind": kind}
            elif fn and fn["body"]:
                state |= self._returned(fn)
            out[name] = state

        for n in self.program["body"]:
            if n["t"] == "Export":
                v = n["value"]
                found = [x for d in v["found"] for x in pattern_names(d["target"])] if v["t"] == "Declaration" else [v["name"]] if v.get("name") else []
                for x in found:
                    put(x["name"], self.names.top.names.get(x["name"]))
            elif n["t"] == "ExportNames" and n["source"] is None:
                for x in n["names"]:
                    put(x["exported"], self.names.top.names.get(x["local"]))
            elif n["t"] == "ExportDefault":
                v = n["value"]
                put("default", v.get("sym") if v["t"] == "Name" else None, v)
        return [out[k] for k in sorted(out)]

    def _returned(self, fn: Node) -> dict:
        values = [fn["body"]] if fn["body"]["t"] != "Block" else [n["value"] for n in self._own(fn) if n["t"] == "Return"]
        values = [peel(v) for v in values]
        if not values or any(v is None for v in values):
            kind = self._typed(fn.get("ty"))
            return {"state": "factory", "kind": kind} if kind else {}
        if all(v["t"] == "Object" for v in values):
            shapes: dict[str, set] = {}
            for v in values:
                for p in v["found"]:
                    if p["t"] == "Property" and p["key"]["name"] and (kind := self._kind_of(p["value"])):
                        shapes.setdefault(p["key"]["name"], set()).add(kind)
            fields = [{"field": f, "kind": next(iter(k))} for f, k in sorted(shapes.items()) if len(k) == 1]
            return {"state": "composable", "fields": fields} if fields else {}
        kinds = {self._kind_of(v) for v in values}
        return {"state": "factory", "kind": kinds.pop()} if len(kinds) == 1 and None not in kinds else {}
