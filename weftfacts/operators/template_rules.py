"""Rules over element facts. All are one expression: an array of findings per element, exploded once, so any number of rules
costs one scan and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.components import attribute, directive, has, listens

LINKS = ("a", "RouterLink", "router-link", "NuxtLink", "nuxt-link")


def _tag() -> Column:
    return F.lower(F.col("tag"))


def _named() -> Column:
    return has("aria-label") | has("aria-labelledby")


def _blank(name: str) -> Column:
    d = directive(name)
    return d.isNotNull() & (F.trim(F.coalesce(d["expression"], F.lit(""))) == "")


def _bare(name: str) -> Column:
    return F.array_contains("bare_names", name)


def _content_directive(name: str) -> Column:
    d = directive(name)
    return d.isNotNull() & ((F.trim(F.coalesce(d["expression"], F.lit(""))) == "") | d["argument"].isNotNull() | (F.size(d["modifiers"]) > 0) | F.col("has_children"))


def _unnamed() -> Column:
    """No content that a reader could tell, and no name from its attributes or from a component around it."""
    return ~F.col("has_accessible_content") & ~F.col("has_accessible_name_ancestor") & ~_named()


def _focusable() -> Column:
    tab = F.trim(attribute("tabindex")["value"]).try_cast("int")
    typed = F.lower(F.coalesce(attribute("type")["value"], F.lit("")))
    return (((_tag() == "a") & has("href")) | _tag().isin("button", "select", "textarea") | ((_tag() == "input") & (typed != "hidden")) | (tab >= 0)) & ~has("disabled")


_ROLES = {"button": "button", "img": "img", "li": "listitem", "main": "main", "nav": "navigation", "ol": "list", "ul": "list", "table": "table", "textarea": "textbox"}
_KNOWN_ROLES = "alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox complementary contentinfo definition deletion dialog directory document emphasis feed figure form generic grid gridcell group heading img insertion link list listbox listitem log main marquee math menu menubar menuitem menuitemcheckbox menuitemradio meter navigation none note option paragraph presentation progressbar radio radiogroup region row rowgroup rowheader scrollbar search searchbox separator slider spinbutton status strong subscript superscript switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree treegrid treeitem".split()


def _redundant_role() -> Column:
    native = F.when((_tag() == "a") & has("href"), F.lit("link"))
    for tag, role in _ROLES.items():
        native = native.when(_tag() == tag, F.lit(role))
    return F.lower(F.trim(attribute("role")["value"])) == native


def rules() -> dict[str, tuple[str, Column]]:
    """Rule id -> (severity, whether it fires on the element of this row)."""
    html, text, loop = directive("html"), directive("text"), directive("for")
    tab = F.trim(attribute("tabindex")["value"]).try_cast("int")
    component = F.col("tag").rlike("^[A-Z]") | F.col("tag").contains("-")
    repeated, bound = F.size("attribute_names") > F.size(F.array_distinct("attribute_names")), "bound_names"
    children, content = F.col("has_children"), html.isNotNull() | text.isNotNull()
    else_if = F.trim(directive("else-if")["expression"])
    typed = F.lower(F.coalesce(attribute("type")["value"], F.lit("text")))
    control = _tag().isin("textarea", "select", "meter", "output", "progress") | ((_tag() == "input") & ~typed.isin("hidden", "button", "submit", "reset", "image"))
    out: dict[str, tuple[str, Column]] = {
        "accessibility/anchor-has-content": ("warning", F.col("tag").isin(*LINKS) & _unnamed()),
        "accessibility/button-has-content": ("warning", (_tag() == "button") & _unnamed()),
        "accessibility/heading-has-content": ("warning", _tag().rlike("^h[1-6]$") & _unnamed()),
        "accessibility/click-events-have-key-events": ("warning", _tag().isin("div", "span", "p", "section", "article", "li") & listens("click") & ~listens("keydown", "keyup", "keypress")),
        "accessibility/iframe-has-title": ("warning", (_tag() == "iframe") & ~has("title")),
        "accessibility/img-has-alt": ("warning", (_tag() == "img") & ~has("alt")),
        "accessibility/no-aria-hidden-on-focusable": ("error", _focusable() & ((F.lower(attribute("aria-hidden")["value"]) == "true") | (F.array_contains("bound_names", "aria-hidden") & F.exists("directives", lambda d: (d["name"] == "bind") & (F.lower(d["argument"]) == "aria-hidden") & (F.trim(d["expression"]) == "true"))))),
        "accessibility/no-autofocus": ("warning", attribute("autofocus").isNotNull()),
        "accessibility/no-distracting-elements": ("warning", _tag().isin("blink", "marquee")),
        "accessibility/no-positive-tabindex": ("warning", tab > 0),
        "accessibility/valid-aria-role": ("warning", attribute("role")["value"].isNotNull() & ~F.arrays_overlap(F.split(F.lower(F.trim(attribute("role")["value"])), r"\s+"), F.array(*map(F.lit, _KNOWN_ROLES)))),
        "maintainability/no-redundant-role": ("warning", _redundant_role()),
        "correctness/valid-v-on": ("error", _bare("on")),
        "correctness/valid-v-bind": ("error", _bare("bind")),
        "correctness/valid-v-else": ("error", F.trim(directive("else")["expression"]) != ""),
        "correctness/valid-v-slot": ("error", directive("slot").isNotNull() & loop.isNotNull()),
        "correctness/valid-v-html": ("error", _content_directive("html")),
        "correctness/valid-v-text": ("error", _content_directive("text")),
        "correctness/no-child-content": ("warning", children & content),
        "correctness/no-textarea-mustache": ("error", (_tag() == "textarea") & directive("model").isNull() & (children | F.col("has_accessible_content"))),
        "correctness/no-template-key": ("warning", (_tag() == "template") & loop.isNull() & has("key")),
        "correctness/no-duplicate-attributes": ("error", repeated | (F.size(bound) > F.size(F.array_distinct(bound)))),
        "correctness/no-deprecated-v-bind-sync": ("error", F.array_contains("modifier_names", "sync")),
        "correctness/no-deprecated-slot-attribute": ("warning", attribute("slot").isNotNull()),
        "correctness/no-deprecated-slot-scope": ("error", attribute("slot-scope").isNotNull() | ((_tag() == "template") & attribute("scope").isNotNull())),
        "correctness/no-deprecated-v-on-native-modifier": ("error", F.array_contains("event_modifiers", "native")),
        "correctness/no-v-text-v-html-on-component": ("warning", component & content),
        "correctness/no-v-if-with-v-for": ("warning", loop.isNotNull() & directive("if").isNotNull()),
        "correctness/require-component-is": ("error", (_tag() == "component") & ~has("is")),
        "correctness/require-v-for-key": ("error", loop.isNotNull() & ~has("key")),
        "security/no-v-html": ("warning", html.isNotNull()),
        "accessibility/label-has-for": ("warning", (_tag() == "label") & ~has("for") & ~F.col("has_labelable_descendant")),
        "accessibility/form-control-has-label": ("warning", control & ~F.col("has_label_ancestor") & ~_named() & ~F.col("labelled")),
        "correctness/no-dupe-v-else-if": ("warning", (else_if != "") & (else_if == F.col("else_before"))),
        "correctness/require-toggle-inside-transition": ("warning", (_tag() == "transition") & children & (F.col("next_toggles") == F.lit(False))),
    }
    for name in ("if", "else-if", "show", "model", "for", "memo"):
        out[f"correctness/valid-v-{name}"] = ("error", _blank(name))
    return out


#: A pipe with blanks around it, a filter's name behind it, and then the end, another pipe or an argument list.
FILTER = r"(?<![|]) +[|] +[A-Za-z_$][A-Za-z0-9_$]* *($|[|(])"


def _repeats() -> dict[str, Column]:
    """Rules that report each of several places in an element: how many findings an element gives."""
    twice = F.size("attribute_names") - F.size(F.array_distinct("attribute_names")) + F.size("bound_names") - F.size(F.array_distinct("bound_names"))
    both = F.array_contains("directive_names", "html").cast("int") + F.array_contains("directive_names", "text").cast("int")
    filters = F.when(F.array_join("expression_texts", " ").contains(" | "), F.size(F.filter("expression_texts", lambda x: x.rlike(FILTER)))).otherwise(F.lit(0))
    return {"correctness/no-duplicate-attributes": twice, "correctness/no-child-content": both, "correctness/no-v-text-v-html-on-component": both, "correctness/no-deprecated-filter": filters}


def lint_elements(elements: DataFrame) -> DataFrame:
    """(file_id, el_ix, rule_id, severity, offset, line) of every rule, by one scan and one explode. The place is the element's."""
    many = _repeats()
    every = rules() | {"correctness/no-deprecated-filter": ("error", many["correctness/no-deprecated-filter"] > 0)}
    found = F.array_compact(F.array(*[F.when(fires, F.struct(F.lit(r).alias("rule_id"), F.lit(sev).alias("severity"), many.get(r, F.lit(1)).cast("int").alias("n"))) for r, (sev, fires) in every.items()]))
    hit = elements.select("file_id", "el_ix", "offset", "line", F.explode(found).alias("r"))
    return hit.select("file_id", "el_ix", "r.rule_id", "r.severity", "offset", "line", F.explode(F.sequence(F.lit(1), "r.n")).alias("k")).drop("k")


_ERRORS = (
    "accessibility/no-aria-hidden-on-focusable correctness/no-deprecated-filter correctness/no-deprecated-slot-scope correctness/no-deprecated-v-bind-sync correctness/no-deprecated-v-on-native-modifier "
    "correctness/no-duplicate-attributes correctness/no-textarea-mustache correctness/require-component-is correctness/require-v-for-key correctness/valid-v-bind correctness/valid-v-else correctness/valid- "
    "v-else-if correctness/valid-v-for correctness/valid-v-html correctness/valid-v-if correctness/valid-v-memo correctness/valid-v-model correctness/valid-v-on correctness/valid-v-show correctness/valid- "
    "v-slot correctness/valid-v-text "
).split()
_WARNINGS = (
    "accessibility/anchor-has-content accessibility/button-has-content accessibility/click-events-have-key-events accessibility/form-control-has-label accessibility/heading-has-content "
    "accessibility/iframe-has-title accessibility/img-has-alt accessibility/label-has-for accessibility/no-autofocus accessibility/no-distracting-elements accessibility/no-positive-tabindex "
    "accessibility/valid-aria-role correctness/no-child-content correctness/no-deprecated-slot-attribute correctness/no-dupe-v-else-if correctness/no-template-key correctness/no-v-if-with-v-for "
    "correctness/no-v-text-v-html-on-component correctness/require-toggle-inside-transition maintainability/no-redundant-role security/no-v-html "
).split()
_SEVERITY = dict.fromkeys(_ERRORS, "error") | dict.fromkeys(_WARNINGS, "warning")


_ERRORS = (
    "accessibility/no-aria-hidden-on-focusable correctness/no-deprecated-filter correctness/no-deprecated-slot-scope correctness/no-deprecated-v-bind-sync correctness/no-deprecated-v-on-native-modifier "
    "correctness/no-duplicate-attributes correctness/no-textarea-mustache correctness/require-component-is correctness/require-v-for-key correctness/valid-v-bind correctness/valid-v-else "
    "correctness/valid-v-else-if correctness/valid-v-for correctness/valid-v-html correctness/valid-v-if correctness/valid-v-memo correctness/valid-v-model correctness/valid-v-on correctness/valid-v-show "
    "correctness/valid-v-slot correctness/valid-v-text "
).split()
_WARNINGS = (
    "accessibility/anchor-has-content accessibility/button-has-content accessibility/click-events-have-key-events accessibility/form-control-has-label accessibility/heading-has-content "
    "accessibility/iframe-has-title accessibility/img-has-alt accessibility/label-has-for accessibility/no-autofocus accessibility/no-distracting-elements accessibility/no-positive-tabindex "
    "accessibility/valid-aria-role correctness/no-child-content correctness/no-deprecated-slot-attribute correctness/no-dupe-v-else-if correctness/no-template-key correctness/no-v-if-with-v-for "
    "correctness/no-v-text-v-html-on-component correctness/require-toggle-inside-transition maintainability/no-redundant-role security/no-v-html "
).split()
_SEVERITY = dict.fromkeys(_ERRORS, "error") | dict.fromkeys(_WARNINGS, "warning")


def severities() -> dict[str, str]:
    """Severity of every template rule; needs no session."""
    return _SEVERITY
