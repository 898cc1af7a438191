"""Snippets of markup and scripts, each with the rules that its breaking form breaks; its other form breaks none of all.

A case is (rules it breaks, breaking text, clean text). The driver's tables hold no component source, so the registered
queries glue files from these by row numbers, and their SQL knows only which rows chose which form.
"""

from __future__ import annotations

from ..operators.script_rules import REGISTRARS, _kebab

MARKUP: list[tuple[str, str, str]] = [
    ("accessibility/anchor-has-content", '<a href="/x"></a>', '<a href="/x">to x</a>'),
    ("accessibility/anchor-has-content", "<a href><span></span></a>", '<a href="/x"><span>{{ n }}</span></a>'),
    ("accessibility/anchor-has-content", '<router-link to="/x"><i aria-hidden="true">x</i></router-link>', '<router-link to="/x"><img src="p" alt="x"></router-link>'),
    ("accessibility/button-has-content", "<button></button>", '<button aria-label="go"></button>'),
    ("accessibility/button-has-content", "<button><!-- go --><i></i></button>", "<button><i><b>go</b></i></button>"),
    ("accessibility/button-has-content", '<div title="t"><button /></div>', '<CommonTip title="t"><button /></CommonTip>'),
    ("accessibility/heading-has-content", "<h2> </h2>", "<h2>Title</h2>"),
    ("accessibility/heading-has-content", "<h3><em> </em></h3>", "<h3><Title /></h3>"),
    ("accessibility/click-events-have-key-events", '<div @click="go">x</div>', '<div @click="go" @keyup.enter="go">x</div>'),
    ("accessibility/click-events-have-key-events", '<span v-on:Click.once="go">x</span>', '<span v-on:Click.once="go" @KeyDown="go">x</span>'),
    ("accessibility/form-control-has-label", '<input id="a1" type="text">', '<label for="a2">n</label><input id="a2">'),
    ("accessibility/form-control-has-label", '<label for="s">n</label><input :id="s">', '<label :for="q">n</label><input :id="q">'),
    ("accessibility/form-control-has-label", "<p>n <select></select></p>", "<label>n <span><select></select></span></label>"),
    ("accessibility/iframe-has-title", '<iframe src="/f"></iframe>', '<iframe src="/f" :title="t"></iframe>'),
    ("accessibility/img-has-alt", '<img src="p.png">', '<img src="p.png" alt="">'),
    ("accessibility/label-has-for", "<label>n</label>", "<label>n <i><output></output></i></label>"),
    ("accessibility/no-aria-hidden-on-focusable", '<button aria-hidden="TRUE">x</button>', '<button aria-hidden="false">x</button>'),
    ("accessibility/no-aria-hidden-on-focusable", '<p tabindex="0" :aria-hidden="true">x</p>', '<p tabindex="0" :aria-hidden="off">x</p>'),
    ("accessibility/no-autofocus", "<p autofocus>x</p>", "<p>x</p>"),
    ("accessibility/no-distracting-elements", "<marquee>x</marquee>", "<!-- <marquee>x</marquee> --><em>x</em>"),
    ("accessibility/no-positive-tabindex", '<p tabindex=" 3 ">x</p>', '<p tabindex="0">x</p>'),
    ("accessibility/no-positive-tabindex", "<p tabindex=3>x</p>", "<p tabindex=-1>x</p>"),
    ("accessibility/valid-aria-role", '<p role="nonsense">x</p>', '<p role="nonsense Note">x</p>'),
    ("maintainability/no-redundant-role", '<nav role="navigation">x</nav>', '<nav role="search">x</nav>'),
    ("correctness/valid-v-if", "<p v-if>x</p>", '<p v-if="a">x</p>'),
    ("correctness/valid-v-else-if", '<p v-else-if=" ">x</p>', '<p v-else-if="a">x</p>'),
    ("correctness/valid-v-show", "<p v-show>x</p>", '<p v-show="a">x</p>'),
    ("correctness/valid-v-model", '<i v-model="">x</i>', '<i v-model="m">x</i>'),
    ("correctness/valid-v-for", '<p v-for :key="k">x</p>', '<p v-for="k in ks" :key="k">x</p>'),
    ("correctness/valid-v-memo", "<p v-memo>x</p>", '<p v-memo="[a]">x</p>'),
    ("correctness/valid-v-on", "<p v-on>x</p>", '<p v-on="all">x</p>'),
    ("correctness/valid-v-bind", "<p v-bind>x</p>", '<p v-bind="all">x</p>'),
    ("correctness/valid-v-else", '<p v-else="a">x</p>', "<p v-else>x</p>"),
    ("correctness/valid-v-slot", '<p #head v-for="k in ks" :key="k">x</p>', "<p #head>x</p>"),
    ("correctness/valid-v-html security/no-v-html", "<p v-html />", "<p />"),
    ("correctness/valid-v-html correctness/no-child-content security/no-v-html", '<p v-html="h">x</p>', '<p title="v-html">x</p>'),
    ("correctness/valid-v-text", "<p v-text:a.b=\"t\"></p>", '<p v-text="t" />'),
    ("correctness/no-child-content correctness/valid-v-text", '<p v-text="t"> <!-- --> </p>', '<p v-text="t"></p>'),
    ("correctness/no-v-text-v-html-on-component", '<My-Card v-text="t" />', '<div v-text="t" />'),
    ("correctness/no-textarea-mustache", '<textarea aria-label="t">{{ x }}</textarea>', '<textarea aria-label="t" v-model="x"></textarea>'),
    ("correctness/no-textarea-mustache", '<textarea aria-label="t"> </textarea>', '<textarea aria-label="t" />'),
    ("correctness/no-template-key", '<template :key="k">x</template>', '<template v-for="k in ks" :key="k">x</template>'),
    ("correctness/no-duplicate-attributes", '<p id="a" ID="b">x</p>', '<p id="a" :id="b">x</p>'),
    ("correctness/no-duplicate-attributes", '<p :id="a" v-bind:ID="b">x</p>', '<p :id="a" @id="b">x</p>'),
    ("correctness/no-deprecated-v-bind-sync", '<p :open.sync="o">x</p>', '<p :open="o">x</p>'),
    ("correctness/no-deprecated-slot-attribute", '<p slot="s">x</p>', "<p>x</p>"),
    ("correctness/no-deprecated-slot-scope", '<template scope="s">x</template>', "<template>x</template>"),
    ("correctness/no-deprecated-v-on-native-modifier", '<b @input.native="f">x</b>', '<b @input="f">x</b>'),
    ("correctness/no-deprecated-filter", "<p>{{ n | money }}</p>", "<p>{{ n || money }}</p>"),
    ("correctness/no-deprecated-filter", '<p :title="n | cap(1)">x</p>', '<p :title="n|cap">x</p>'),
    ("correctness/no-dupe-v-else-if", '<p v-else-if="dup">x</p><p v-else-if=" dup ">x</p>', '<p v-else-if="one">x</p><p v-else-if="two">x</p>'),
    ("correctness/require-toggle-inside-transition", "<transition><p>x</p></transition>", '<transition><p v-show="s">x</p></transition>'),
    ("correctness/require-toggle-inside-transition", "<Transition> <p>x</p> </Transition>", '<Transition><p :is="s">x</p></Transition><transition />'),
    ("correctness/no-v-if-with-v-for", '<p v-for="k in ks" :key="k" v-if="a">x</p>', '<p v-for="k in ks" key="k">x</p>'),
    ("correctness/require-component-is", "<component>x</component>", '<component :is="c">x</component>'),
    ("correctness/require-v-for-key", '<p v-for="k in ks">x</p>', '<p v-for="k in ks" :key="k">x</p>'),
    ("security/no-v-html", '<p v-html="h"></p>', '<script>"<p v-html>"</script>'),
]


def _setup(body: str, template: str = "<p>x</p>") -> str:
    return f'<script setup lang="ts">\n{body}\n</script>\n<template>{template}</template>\n'


_VUE = "import { ref, shallowRef, computed, reactive, shallowReactive, readonly, watch, watchEffect, watchPostEffect, watchSyncEffect, effectScope, onScopeDispose, unref } from 'vue'\n"


def _on(use: str, body: str, template: str = "<p>x</p>") -> str:
    return _setup(_VUE + use + "\n" + body, template)


_REFS = "const a = ref(0), b = ref(0), s = reactive({ k: 1 })\nuse(a, b, s)"
R, P, C = "reactivity/", "practice/", "correctness/"
_HINT = f" {R}prefer-explicit-sources-for-conditional-deps"


#: A case is (rules, breaking component, clean component, minor version of the framework).
SCRIPTS: list[tuple[str, str, str, int]] = [
    (f"{C}no-import-compiler-macros", _setup("import { defineProps } from 'vue'"), _setup("import { defineProps } from './own'"), 4),
    (f"{C}no-mutating-props", _setup("const props = defineProps<{ n: number }>()\nfunction f() { props.n = 1; props['n']++ }").replace("; props['n']++", ""), _setup("const props = defineProps<{ n: number }>()\nfunction f() { other.n = props.n }"), 4),
    (f"{R}no-nonreactive-props-destructure", _setup("const { n } = defineProps<{ n: number }>()\nuse(n)"), _setup("const props = defineProps<{ n: number }>()\nuse(props)"), 4),
    *[(f"{C}no-duplicate-{_kebab(m)}", _setup(f"const p = {m}(x)\nuse(p)\n{m}(y)"), _setup(f"const p = {m}(x)\nuse(p)"), 4) for m in ("defineProps", "defineEmits", "defineExpose", "defineSlots", "defineOptions")],
    (f"{C}no-duplicate-define-model", _setup("defineModel()\ndefineModel()"), _setup("const one = defineModel()\nconst two = defineModel('two')\nuse(one, two)"), 4),
    *[(f"{C}no-{_kebab(c)}-after-await" + {"watch": f" {R}no-empty-watch-sources", "getCurrentInstance": f" {P}prefer-use-slots-attrs"}.get(c, ""), _setup(f"await go()\n{c}(f)"), _setup(f"async function later() {{ await go() }}\n{'' if c in ('watch', 'getCurrentInstance') else c + '(f)'}\nawait go()"), 4) for c in REGISTRARS],
    (f"{R}no-after-await-dependency-in-computed", _on(_REFS, "const c = computed(async () => { await go(); return a.value })\nuse(c)"), _on(_REFS, "const c = computed(async () => { const n = a.value; await go(); return n })\nuse(c)"), 4),
    (f"{R}no-outside-tracking-dependency-in-computed", _on(_REFS, "const c = computed(() => go().then(() => a.value))\nuse(c)"), _on(_REFS, "const c = computed(() => list.map(() => a.value))\nuse(c)"), 4),
    (f"{R}no-conditional-dependency-in-computed", _on(_REFS, "const c = computed(() => { if (a.value) return b.value; return 0 })\nuse(c)"), _on(_REFS, "const c = computed(() => { const n = b.value; if (a.value) return b.value; return n })\nuse(c)"), 4),
    (f"{R}no-after-await-dependency-in-watch-sources", _on(_REFS, "watch(async () => { await go(); return a.value }, f)"), _on(_REFS, "watch(() => a.value, f)"), 4),
    (f"{R}no-outside-tracking-dependency-in-watch-sources", _on(_REFS, "watch(() => setTimeout(() => a.value), f)"), _on(_REFS, "watch([a, () => s.k], f)"), 4),
    (f"{R}no-conditional-dependency-in-watch-sources", _on(_REFS, "watch(() => a.value && b.value, f)"), _on(_REFS, "watch(() => (a.value ? b.value : b.value), f)"), 4),
    (f"{R}no-after-await-dependency-in-effect-scope", _on(_REFS, "effectScope(async () => { await go(); use(a.value) })"), _on(_REFS, "effectScope(() => { use(a.value) })"), 4),
    (f"{R}no-outside-tracking-dependency-in-effect-scope", _on(_REFS, "effectScope(() => { queueMicrotask(() => a.value) })"), _on(_REFS, "effectScope(() => { [1].forEach(() => a.value) })"), 4),
    (f"{R}no-conditional-dependency-in-effect-scope", _on(_REFS, "const e = effectScope()\ne.run(() => { if (!a.value) return; use(b.value) })"), _on(_REFS, "const e = effectScope()\nother.run(() => { if (!a.value) return; use(b.value) })\nuse(e)"), 4),
    (f"{R}no-after-await-watch-effect-dependency", _on(_REFS, "watchEffect(async () => { await go(); use(a.value) })"), _on(_REFS, "watchEffect(async () => { use(a.value); await go() })"), 4),
    (f"{R}no-conditional-watch-effect-dependency{_HINT}", _on(_REFS, "watchPostEffect(() => { switch (a.value) { case 1: use(s.k) } })"), _on(_REFS, "watchPostEffect(() => { switch (n) { case 1: use(s.k) } })"), 4),
    (f"{R}no-deferred-callback-reactive-read-in-effect", _on(_REFS, "watchSyncEffect(() => { go().finally(() => use(a.value)) })"), _on(_REFS, "watchSyncEffect(() => { unknown(() => use(a.value)) })"), 4),
    (f"{R}no-self-trigger-in-watch-effect", _on(_REFS, "watchEffect(() => { use(a.value); a.value = 1 })"), _on(_REFS, "watchEffect(() => { use(a.value); b.value = 1 })"), 4),
    (f"{R}no-self-trigger-in-watch-post-effect", _on(_REFS, "watchPostEffect(() => { use(s.k); s.k = 1 })"), _on(_REFS, "watchPostEffect(() => { use(s.k); s.j = 1 })"), 4),
    (f"{R}no-self-trigger-in-watch-sync-effect", _on(_REFS, "watchSyncEffect(() => { use(a.value); a.value = 1 })"), _on(_REFS, "watchSyncEffect(() => { use(a.value); go(() => { a.value = 1 }) })"), 4),
    (f"{R}no-computed-self-trigger {R}no-side-effects-in-computed", _on(_REFS, "const c = computed(() => { a.value = 2; return a.value })\nuse(c)"), _on(_REFS, "const c = computed(() => { const d = a.value; return d })\nuse(c)"), 4),
    (f"{R}no-side-effects-in-computed", _on(_REFS, "const c = computed(() => { b.value = 2; return a.value })\nuse(c)"), _on(_REFS, "const c = computed(() => { z.value = 2; return a.value })\nuse(c)"), 4),
    (f"{R}no-effect-write-without-read", _on(_REFS, "watchEffect(() => { a.value = 2; go() })"), _on(_REFS, "watchEffect(() => { go(); z.value = 2 })"), 4),
    (f"{R}no-computed-without-dependency", _on(_REFS, "const c = computed(() => 1)\nuse(c)"), _on(_REFS, "const c = computed({ get: () => a.value, set() {} })\nuse(c)"), 4),
    (f"{R}prefer-watch-over-effect-for-single-source {R}prefer-computed", _on(_REFS, "watchEffect(() => { b.value = a.value })"), _on(_REFS, "watchEffect(() => { b.value = a.value; go() })"), 4),
    (f"{R}no-assignment-only-effect-with-conditional-read {R}no-conditional-watch-effect-dependency{_HINT}", _on(_REFS, "watchEffect(() => { z = a.value ? b.value : 0 })"), _on(_REFS, "watchEffect(() => { go(a.value) })"), 4),
    (f"{R}no-on-scope-dispose-reactive-read", _on(_REFS, "onScopeDispose(() => use(a.value))"), _on(_REFS, "onScopeDispose(() => use(z.value))"), 4),
    (f"{R}no-empty-watch-sources", _on(_REFS, "watch(() => 1, f)"), _on(_REFS, "watch(() => s.k, f)"), 4),
    (f"{R}no-watch-callback-as-tracking-scope {R}no-empty-watch-sources", _on(_REFS, "watch(() => 1, () => use(a.value))"), _on(_REFS, "watch(b, () => use(a.value))"), 4),
    (f"{R}no-multiple-effects-same-target", _on(_REFS, "watchEffect(() => { use(a.value); b.value = 1 })\nwatchPostEffect(() => { use(s.k); b.value = 2 })"), _on(_REFS, "watchEffect(() => { use(a.value); b.value = 1 })\nwatchPostEffect(() => { use(s.k); s.j = 2 })"), 4),
    (f"{R}no-deep-watch-on-reactive-root", _on(_REFS, "watch(s, f)"), _on(_REFS, "watch(a, f)"), 4),
    (f"{R}no-reactive-read-during-pause-tracking", _on(_REFS, "watchEffect(() => { use(b.value); pauseTracking(); use(a.value) })"), _on(_REFS, "watchEffect(() => { use(b.value); pauseTracking(); resetTracking(); use(a.value) })"), 4),
    (f"{R}prefer-computed", _on(_REFS, "watchEffect(() => { b.value = a.value + s.k })"), _on(_REFS, "watchEffect(() => { s.j = a.value + b.value })"), 4),
    (f"{R}no-unused-computed-binding {R}no-unused-reactive-binding", _on(_REFS, "const c = computed(() => a.value)"), _on(_REFS, "const c = computed(() => a.value)", "<p>{{ c }}</p>"), 4),
    (f"{R}no-unused-reactive-binding", _on(_REFS, "const z = shallowRef(0)"), _on(_REFS, "const z = shallowRef(0)", '<p ref="z">x</p>'), 4),
    (f"{R}no-reactive-destructure", _on(_REFS, "const { k } = reactive({ k: 1 })\nuse(k)"), _on(_REFS, "const { k } = toRefs(s)\nuse(k)"), 4),
    (f"{R}no-shallow-reactive-destructure", _on(_REFS, "const { k } = shallowReactive({ k: 1 })\nuse(k)"), _on(_REFS, "const k = shallowReactive({ k: 1 })\nuse(k)"), 4),
    (f"{R}no-route-destructure", _setup("const { query } = useRoute()\nuse(query)"), _setup("const route = useRoute()\nuse(route.query)"), 4),
    (f"{R}prefer-store-to-refs", _setup("const { items } = useCartStore()\nuse(items)"), _setup("const { items } = storeToRefs(useCartStore())\nuse(items)"), 4),
    (f"{R}no-conditional-dependency-in-render", "<script>\nimport { ref, h } from 'vue'\nconst a = ref(0), b = ref(0)\nexport default { render() { return a.value ? h('p', b.value) : null } }\n</script>\n", "<script>\nimport { ref, h } from 'vue'\nconst a = ref(0), b = ref(0)\nexport default { setup() { return () => h('p', b.value, a.value ? b.value : 0) } }\n</script>\n", 4),
    (f"{R}no-router-destructure", _setup("const { push } = useRouter()\nuse(push)"), _setup("const router = useRouter()\nuse(router)"), 4),
    (f"{R}no-ref-as-operand", _on(_REFS, "use(a + 1)"), _on(_REFS, "use(a.value + 1)"), 4),
    (f"{R}no-model-ref-as-operand", _setup("const m = defineModel()\nuse(!m)"), _setup("const m = defineModel()\nuse(!m.value)"), 4),
    (f"{R}no-computed-as-operand", _on(_REFS, "const c = computed(() => a.value)\nuse(c || 1)"), _on(_REFS, "const c = computed(() => a.value)\nuse(c.value || 1)"), 4),
    (f"{R}no-readonly-mutation", _on(_REFS, "const r = readonly(s)\nr.k = 1"), _on(_REFS, "const r = readonly(s)\nuse(r.k)"), 4),
    (f"{R}no-props-snapshot-in-ref", _on("const props = defineProps<{ n: number }>()", "use(ref(props))"), _on("const props = defineProps<{ n: number }>()", "use(ref(props.n))"), 4),
    (f"{R}no-v-model-nonreactive-source", _on(_REFS, "let plain = 1", '<i v-model="plain">x</i>'), _on(_REFS, "let plain = 1", '<i v-model="a">x</i><i v-model="plain.x">x</i>'), 4),
    (f"{P}vueuse-use-debounce-fn", _setup("let t\nfunction f() { clearTimeout(t); t = setTimeout(go, 9) }"), _setup("let t\nfunction f() { clearTimeout(u); t = setTimeout(go, 9) }"), 4),
    *[(f"{P}vueuse-use-{label}", _setup(f"onMounted(() => {{ {start} }})"), _setup(f"onMounted(() => {{ {start} }})\nonUnmounted(() => {{ {stop} }})"), 4) for label, start, stop in (
        ("timeout-fn", "window.setTimeout(f, 1)", "clearTimeout(t)"), ("interval-fn", "setInterval(f, 1)", "window.clearInterval(t)"), ("raf-fn", "requestAnimationFrame(f)", "cancelAnimationFrame(t)"), ("event-listener", "el.addEventListener('x', f)", "el.removeEventListener('x', f)"),
        ("intersection-observer", "new IntersectionObserver(f)", "o.disconnect()"), ("mutation-observer", "new MutationObserver(f)", "o.disconnect()"), ("resize-observer", "new ResizeObserver(f)", "o.disconnect()"))],
    (f"{P}vueuse-use-window-size", _on("const width = ref(0), height = ref(0)\nuse(width, height)", "onMounted(() => addEventListener('resize', f))\nonUnmounted(() => removeEventListener('resize', f))"), _on("const width = ref(0)\nuse(width)", "onMounted(() => addEventListener('resize', f))\nonUnmounted(() => removeEventListener('resize', f))"), 4),
    (f"{P}prefer-to-value", _on(_REFS, "use(unref(a))"), _on(_REFS, "use(own.unref(a))"), 4),
    (f"{P}prefer-define-model", _setup("const props = defineProps<{ x: 1 }>()\ndefineEmits(['u'])\nconst modelValue = 1\nuse(props)"), _setup("const props = defineProps<{ x: 1 }>()\ndefineEmits(['u'])\nconst other = 1\nuse(props)"), 4),
    (f"{P}prefer-use-slots-attrs", _setup("use(getCurrentInstance())"), _setup("function getCurrentInstance() {}\nuse(getCurrentInstance())"), 4),
    (f"{R}prefer-use-template-ref", _on("const el = ref(null)", "", '<p ref="el">x</p>'), _on("const el = ref(0)", "", '<p ref="el">x</p>'), 5),
]
