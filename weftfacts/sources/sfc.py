"""Component files to facts: the blocks of a file, and its template as a flat list of elements with what their trees say.

One pass over the text with a stack. Comments, raw text and closing tags are read as such, offsets are of UTF-8 bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np

from .script import Names, Parser, ScriptError, pattern_names

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:(\s*=\s*)("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?""")
_DIRECTIVE = re.compile(r"v-([A-Za-z0-9_-]+)(?::(\[[^\]]*\]|[^.]*))?((?:\.[^.]*)*)\Z")
_SHORT = re.compile(r"[:@#.](\[[^\]]*\]|[^.]*)((?:\.[^.]*)*)\Z")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*\Z")


class Positions:
    """Character index to byte offset, line and column (from 1, in bytes)."""

    def __init__(self, text: str) -> None:
        self.ascii = text.isascii()
        if not self.ascii:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            self.bytes = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
        self.lines = [0]
        at = text.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = text.find("\n", at + 1)

    def byte(self, i: int) -> int:
        return i if self.ascii else int(self.bytes[i])

    def span(self, a: int, z: int) -> tuple[int, int, int, int]:
        """(offset, length, line, column)."""
        line = bisect_right(self.lines, a)
        return self.byte(a), self.byte(z) - self.byte(a), line, self.byte(a) - self.byte(self.lines[line - 1]) + 1


def blocks(text: str) -> tuple[list[dict], list[tuple[str, int]]]:
    """(top-level blocks: tag, attributes, span of the content; problems)."""
    out, problems, at = [], [], 0
    while (at := text.find("<", at)) >= 0:
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            if end < 0:
                problems.append(("unclosed comment", at))
                break
            at = end + 3
            continue
        m = _NAME.match(text, at + 1)
        if not m:
            at += 1
            continue
        tag = m.group()
        attrs, after, closed = _attributes(text, m.end(), len(text))
        if after < 0:
            problems.append((f"unclosed tag {tag}", at))
            break
        names = {a[0]: a[1] for a in attrs}
        if closed:
            out.append({"tag": tag, "attrs": names, "a": after, "z": after, "open": at})
            at = after
            continue
        end = _template_end(text, after) if tag == "template" else text.find(f"</{tag}", after)
        if end < 0:
            problems.append((f"unclosed block {tag}", at))
            break
        out.append({"tag": tag, "attrs": names, "a": after, "z": end, "open": at})
        at = text.find(">", end) + 1 or len(text)
    return out, problems


_TEMPLATE = re.compile(r"<!--.*?-->|<template(?=[\s/>])|</template(?=[\s>])", re.S)


def _template_end(text: str, at: int) -> int:
    depth = 1
    for m in _TEMPLATE.finditer(text, at):
        if m.group() == "</template":
            depth -= 1
            if not depth:
                return m.start()
        elif m.group() == "<template":
            _, after, closed = _attributes(text, m.end(), len(text))
            depth += not closed and after >= 0
    return -1


def _attributes(text: str, at: int, end: int) -> tuple[list[tuple[str, str | None, int, int]], int, bool]:
    """(name, value, name's start, value's start) of each; where the tag ends (-1: it doesn't); whether it closes itself."""
    out: list[tuple[str, str | None, int, int]] = []
    while True:
        gap = _SPACE.match(text, at, end)
        at = gap.end()
        if at >= end:
            return out, -1, False
        if text[at] == ">":
            return out, at + 1, gap.group().endswith("/")
        m = _ATTR.match(text, at, end)
        if not m:
            at += 1
            continue
        value, start = m.group(3), m.start(3)
        if value is not None and value[0] in "\"'":
            value, start = value[1:-1], start + 1
        elif value is None and m.group(2) is not None:
            value = ""
        if m.group(3) and m.group(3)[0] not in "\"'" and value.endswith("/") and text[m.end() : m.end() + 1] == ">":
            value = value[:-1]
        out.append((m.group(1), value, m.start(1), start))
        at = m.end()


def directive(name: str) -> tuple[str, str | None, bool, list[str]] | None:
    """(directive, argument, whether the argument is dynamic, modifiers) that an attribute's name spells, or None."""
    if name[0] in ":@#." and len(name) > 1 or name in (":", "@", "#"):
        m = _SHORT.match(name)
        kind = {":": "bind", ".": "bind", "@": "on", "#": "slot"}[name[0]]
        argument, tail = (m.group(1), m.group(2)) if m else (name[1:], "")
    elif name.startswith("v-") and (m := _DIRECTIVE.match(name)):
        kind, argument, tail = m.groups()
    else:
        return None
    dynamic = bool(argument) and argument[0] == "["
    if dynamic:
        argument = argument[1:-1]
    return kind, argument or None, dynamic, [x for x in tail.split(".") if x]


def component_tag(tag: str) -> bool:
    return any("A" <= c <= "Z" for c in tag) or "-" in tag


# Names that an expression reads.
_FOR = re.compile(r"\s(?:in|of)\s")
_GLOBALS = frozenset("undefined NaN Infinity globalThis Math Date JSON Object Array String Number Boolean BigInt Map Set RegExp Error Symbol Intl parseInt parseFloat isNaN isFinite decodeURI decodeURIComponent encodeURI encodeURIComponent console require true false null this arguments".split())


def _parsed(text: str, statements: bool = False) -> list[str] | None:
    try:
        body = Parser(text, lang="ts").program()["body"] if statements else [{"t": "Expression", "a": 0, "z": len(text), "value": Parser(text, lang="ts").whole()}]
        free = Names({"t": "Program", "a": 0, "z": len(text), "body": body}).free
    except (ScriptError, KeyError, IndexError, RecursionError):
        return None
    return [n["name"] for n in sorted(free, key=lambda n: n["a"])]


def _alias_names(pattern: str) -> list[str]:
    """Names that the left side of v-for, or a slot's props, bind."""
    text = pattern.strip()
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1]
    try:
        params = Parser(f"({text})", lang="ts").params()
    except (ScriptError, KeyError, IndexError, RecursionError):
        return []
    return [x["name"] for p in params for x in pattern_names(p["target"])]


def for_parts(text: str) -> tuple[str, str]:
    """(alias side, iterable side) of a v-for; the alias side is empty if there is none."""
    m = _FOR.search(text)
    return (text[: m.start()], text[m.end() :]) if m else ("", text)


@lru_cache(maxsize=1 << 16)
def _read_names(text: str, surface: str) -> tuple[str, ...]:
    if surface in ("slot", "slot-scope", "scope"):
        return ()
    if surface == "for":
        text = for_parts(text)[1]
    found: list[str] | None = [text.strip()] if _IDENT.match(text.strip()) else _parsed(text)
    if found is None:
        found = _parsed(text, True) or []
    return tuple(n for n in dict.fromkeys(found) if n not in _GLOBALS and not n.startswith("$event"))


def identifiers(text: str, surface: str, shadowed: frozenset[str] = frozenset()) -> list[str]:
    """Free names that a template expression reads, each once, in order; none if it doesn't parse."""
    return [n for n in _read_names(text, surface if surface in ("slot", "slot-scope", "scope", "for") else "") if n not in shadowed]


class Template:
    """Elements and expressions of a stretch of markup."""

    def __init__(self, text: str, a: int, z: int, at: Positions) -> None:
        self.text, self.at = text, at
        self.elements: list[dict] = []
        self.expressions: list[dict] = []
        self.loose: list[str] = []
        self._read(a, z)
        if self.elements:
            self.elements[0]["expression_texts"] += self.loose
        self.expressions.sort(key=lambda e: e["offset"])

    def _expression(self, surface: str, text: str, start: int, shadowed: frozenset[str], owner: dict | None) -> None:
        if text.strip():
            (self.loose if owner is None else owner["expression_texts"]).append(text)
            offset, length, line, column = self.at.span(start, start + len(text))
            self.expressions.append({"surface": surface, "expression": text, "offset": offset, "length": length, "line": line, "column": column, "identifiers": identifiers(text, surface, shadowed)})

    def _content(self, i: int, z: int, held: list[dict]) -> None:
        """Text between tags."""
        text, frame = self.text, held[-1] if held else None
        if i >= z:
            return
        if frame:
            frame["e"]["has_children"] = True
        at = text.find("{{", i, z)
        if at < 0:
            if frame and text[i:z].strip():
                frame["content"] = True
            return
        shadowed = frame["shadowed"] if frame else frozenset()
        while at >= 0:
            end = text.find("}}", at + 2, z)
            if end < 0:
                break
            inner = text[at + 2 : end]
            lead = len(inner) - len(inner.lstrip())
            self._expression("interpolation", inner.strip(), at + 2 + lead, shadowed, frame["e"] if frame else None)
            at = text.find("{{", end + 2, z)
        if frame:
            frame["content"] = True

    def _close(self, held: list[dict]) -> None:
        frame = held.pop()
        e = frame["e"]
        e["has_accessible_content"] = frame["by_directive"] or frame["content"]
        e["has_labelable_descendant"] = frame["labelable"]
        if held:
            up = held[-1]
            up["content"] |= not frame["hidden"] and (frame["alt"] or e["has_accessible_content"] or component_tag(e["tag"]))
            up["labelable"] |= frame["labelable"] or e["tag"].lower() in ("input", "textarea", "select", "button", "meter", "output", "progress")

    def _read(self, i: int, z: int) -> None:
        text, held = self.text, []
        depth: dict[str, int] = {}
        while i < z:
            at = text.find("<", i, z)
            if at < 0:
                self._content(i, z, held)
                break
            if text.startswith("<!--", at):
                self._content(i, at, held)
                if held:
                    held[-1]["e"]["has_children"] = True
                end = text.find("-->", at + 4, z)
                i = end + 3 if end >= 0 else z
            elif text.startswith("</", at):
                self._content(i, at, held)
                m = _NAME.match(text, at + 2, z)
                end = text.find(">", at, z)
                i = end + 1 if end >= 0 else z
                if m and depth.get(m.group(), 0):
                    while True:
                        tag = held[-1]["e"]["tag"]
                        depth[tag] -= 1
                        self._close(held)
                        if tag == m.group():
                            break
            elif m := _NAME.match(text, at + 1, z):
                self._content(i, at, held)
                i = self._open(m.group(), at, m.end(), z, held, depth)
            elif text.startswith(("<!", "<?"), at):
                self._content(i, at, held)
                end = text.find(">", at, z)
                i = end + 1 if end >= 0 else z
            else:
                # A sign that opens nothing is text.
                j = text.find("<", at + 1, z)
                self._content(i, j if j >= 0 else z, held)
                i = j if j >= 0 else z
        while held:
            self._close(held)

    def _open(self, tag: str, at: int, i: int, z: int, held: list[dict], depth: dict[str, int]) -> int:
        text = self.text
        attrs, after, closed = _attributes(text, i, z)
        if after < 0:
            after = z
        up = held[-1] if held else None
        if up:
            up["e"]["has_children"] = True
        shadowed = up["shadowed"] if up else frozenset()
        attributes, directives, own = [], [], set()
        for k, (name, value, a, b) in enumerate(attrs):
            offset, length, line, column = self.at.span(a, a + len(name))
            d = directive(name)
            if d is None:
                attributes.append({"ix": k, "name": name, "value": value, "offset": offset, "length": length, "line": line, "column": column})
                continue
            kind, argument, dynamic, modifiers = d
            directives.append({"ix": k, "name": kind, "raw_name": name, "argument": argument, "dynamic": dynamic, "expression": value, "modifiers": modifiers, "offset": offset, "length": length, "line": line, "column": column, "_at": a, "_value": b})
            if value and kind == "for":
                own.update(_alias_names(for_parts(value)[0]))
            elif value and kind == "slot":
                own.update(_alias_names(value))
        inner = shadowed | own if own else shadowed
        low = tag.lower()
        offset, length, line, column = self.at.span(at, after)
        e = {
            "tag": tag, "offset": offset, "length": length, "line": line, "column": column, "attributes": attributes, "directives": directives, "has_children": False, "has_accessible_content": False,
            "has_labelable_descendant": False, "has_label_ancestor": bool(up and up["in_label"]), "has_accessible_name_ancestor": bool(up and up["in_name"]), "expression_texts": [],
        }
        for d in directives:
            a, b = d.pop("_at"), d.pop("_value")
            if d["expression"]:
                self._expression((d["argument"] or "bind") if d["name"] == "bind" else d["name"], d["expression"], b, inner, e)
            if d["dynamic"] and d["argument"]:
                self._expression("bind-arg", d["argument"], a + d["raw_name"].find("[") + 1, inner, e)
        self.elements.append(e)
        by_directive = any(d["name"] in ("text", "html") for d in directives)
        frame = {
            "e": e, "content": False, "labelable": False, "by_directive": by_directive, "shadowed": inner, "hidden": _aria_hidden(attributes, directives),
            "alt": low in ("img", "area") and _alt(attributes, directives), "in_label": bool(up and up["in_label"]) or low == "label", "in_name": bool(up and up["in_name"]) or _names_slot(tag, attributes, directives),
        }
        held.append(frame)
        depth[tag] = depth.get(tag, 0) + 1
        if closed or low in VOID:
            depth[tag] -= 1
            self._close(held)
        elif low in RAW:
            m = re.compile(f"</{re.escape(tag)}", re.I).search(text, after, z)
            end = m.start() if m else z
            if end > after:
                e["has_children"] = True
                frame["content"] = low != "style" and bool(text[after:end].strip())
            depth[tag] -= 1
            self._close(held)
            stop = text.find(">", end, z) if m else -1
            return stop + 1 if stop >= 0 else z
        return after


def _value(d: dict) -> str:
    return (d["expression"] or "").strip()


def _aria_hidden(attributes: list[dict], directives: list[dict]) -> bool:
    for x in sorted([*attributes, *directives], key=lambda x: x["ix"]):
        if "raw_name" not in x and x["name"].lower() == "aria-hidden":
            return x["value"] is None or x["value"].strip().lower() in ("", "true")
        if "raw_name" in x and x["name"] == "bind" and (x["argument"] or "").lower() == "aria-hidden":
            return True
    return False


def _alt(attributes: list[dict], directives: list[dict]) -> bool:
    for x in sorted([*attributes, *directives], key=lambda x: x["ix"]):
        if "raw_name" not in x and x["name"].lower() == "alt":
            return bool((x["value"] or "").strip())
        if "raw_name" in x and x["name"] == "bind" and (x["argument"] or "").lower() == "alt" and x["expression"] is not None:
            return True
    return False


_SLOT_NAMES = frozenset(("content", "title", "label", "text", "aria-label", "aria-labelledby"))


def _names_slot(tag: str, attributes: list[dict], directives: list[dict]) -> bool:
    """Whether a component is given a name for what stands in its slot."""
    if not component_tag(tag):
        return False
    return any(x["name"].lower() in _SLOT_NAMES and (x["value"] or "").strip() for x in attributes) or any(d["name"] == "bind" and (d["argument"] or "").lower() in _SLOT_NAMES and _value(d) for d in directives)


_STYLE_BIND = re.compile(r"v-bind\(\s*(?:(['\"])([A-Za-z_$][\w$]*)\1|([A-Za-z_$][\w$]*))\s*\)")


def style_expressions(text: str, a: int, z: int, at: Positions) -> list[dict]:
    """Simple names bound in a style block."""
    out = []
    for m in _STYLE_BIND.finditer(text, a, z):
        k = 2 if m.group(2) else 3
        offset, length, line, column = at.span(m.start(k), m.end(k))
        out.append({"surface": "style", "expression": m.group(k), "offset": offset, "length": length, "line": line, "column": column, "identifiers": [m.group(k)]})
    return out
