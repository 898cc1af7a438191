"""A tolerant parser of JavaScript and TypeScript, with JSX, and the scopes of its names.

Nodes are dicts: `t` the type, `a` and `z` the character span, and children under their role. Types are skipped, but a
declaration keeps the text of its annotation under `ty`. A text that doesn't parse raises ScriptError; no part of it counts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))

Node = dict


class ScriptError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/|<!--[^\n]*|#![^\n]*)", re.S)
_WORD = re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.|\\\n)*\"|'(?:[^'\\\n]|\\.|\\\n)*'", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_PUNCT = re.compile(r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_BEFORE_REGEX = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "await", "yield", "default"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_NOT_A_NAME = {"if", "else", "for", "while", "do", "return", "break", "continue", "switch", "case", "throw", "try", "catch", "finally", "var", "const", "function", "class", "new", "delete", "typeof", "void", "in", "instanceof", "this", "super", "null", "true", "false", "import", "export", "default", "extends", "enum", "with", "debugger"}


class Lexer:
    """All tokens of a text, and for each bracket the number of its partner."""

    def __init__(self, text: str, a: int = 0, z: int | None = None) -> None:
        self.text, self.kind, self.value, self.start, self.end, self.line = text, [], [], [], [], []
        self.parts: dict[int, list] = {}
        z = len(text) if z is None else z
        at, fresh = a, True
        while True:
            m = _SPACE.match(text, at, z)
            while m:
                fresh = fresh or "\n" in m.group()
                at = m.end()
                m = _SPACE.match(text, at, z)
            if at >= z:
                break
            c = text[at]
            if c == "`" and not (self.jsx_like and text.find("`", at + 1, z) < 0):
                end, holes = self._template(at, z)
                self._add("template", text[at:end], at, end, fresh)
                self.parts[len(self.kind) - 1] = holes
            elif m := _WORD.match(text, at, z):
                self._add("word", m.group(), at, m.end(), fresh)
            elif (c.isdigit() or c == ".") and (m := _NUMBER.match(text, at, z)) and m.end() > at:
                self._add("number", m.group(), at, m.end(), fresh)
            elif c in "\"'":
                m = _STRING.match(text, at, z)
                if not m and not self.jsx_like:
                    raise ScriptError("unterminated string", at)
                self._add("string" if m else "other", m.group() if m else c, at, m.end() if m else at + 1, fresh)
            elif c == "/" and self._regex_may_start() and (m := _REGEX.match(text, at, z)):
                self._add("regex", m.group(), at, m.end(), fresh)
            elif m := _PUNCT.match(text, at, z):
                self._add("punct", m.group(), at, m.end(), fresh)
            else:
                self._add("other", c, at, at + 1, fresh)
            at, fresh = self.end[-1], False
        self._add("end", "", z, z, True)
        self.match: dict[int, int] = {}
        held: list[int] = []
        for i, (k, v) in enumerate(zip(self.kind, self.value)):
            if k == "punct" and v in _PAIRS:
                held.append(i)
            elif k == "punct" and v in ")]}":
                if not held or _PAIRS[self.value[held[-1]]] != v:
                    if self.jsx_like:
                        continue
                    raise ScriptError(f"unexpected {v}", self.start[i])
                self.match[held.pop()] = i
        if held and not self.jsx_like:
            raise ScriptError(f"unclosed {self.value[held[-1]]}", self.start[held[-1]])

    jsx_like = False

    def _add(self, kind: str, value: str, a: int, z: int, fresh: bool) -> None:
        self.kind.append(kind)
        self.value.append(value)
        self.start.append(a)
        self.end.append(z)
        self.line.append(fresh)

    def _regex_may_start(self) -> bool:
        if not self.kind:
            return True
        k, v = self.kind[-1], self.value[-1]
        return v in _BEFORE_REGEX if k == "word" else k == "punct" and v not in (")", "]", "++", "--") if k == "punct" else False

    def _template(self, at: int, z: int) -> tuple[int, list[tuple[int, int]]]:
        """(end, spans of the expressions) of a template literal."""
        text, i, holes = self.text, at + 1, []
        while i < z:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1, holes
            elif c == "$" and text.startswith("${", i):
                depth, j = 1, i + 2
                while j < z and depth:
                    d = text[j]
                    if d == "`":
                        j = self._template(j, z)[0]
                        continue
                    if d in "\"'" and (m := _STRING.match(text, j, z)):
                        j = m.end()
                        continue
                    depth += (d == "{") - (d == "}")
                    j += 1
                holes.append((i + 2, j - 1))
                i = j
            else:
                i += 1
        raise ScriptError("unterminated template", at)


class Parser:
    def __init__(self, text: str, a: int = 0, z: int | None = None, lang: str = "ts") -> None:
        self.lang, self.jsx = lang, lang in ("jsx", "tsx", "js")
        self.x = Lexer(text, a, z)
        self.text, self.i, self.bare = text, 0, 0

    # Tokens.
    def v(self, k: int = 0) -> str:
        i = self.i + k
        return self.x.value[i] if i < len(self.x.value) and self.x.kind[i] in ("punct", "word") else ""

    def kind(self, k: int = 0) -> str:
        i = self.i + k
        return self.x.kind[i] if i < len(self.x.kind) else "end"

    def at(self) -> int:
        return self.x.start[self.i]

    def last(self) -> int:
        return self.x.end[self.i - 1] if self.i else self.x.start[0]

    def take(self, v: str) -> bool:
        if self.v() == v:
            self.i += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.take(v):
            raise ScriptError(f"expected {v}", self.at())

    def glued(self) -> str:
        """The operator here; those that begin with > are single tokens, put together where they touch."""
        v = self.v()
        if v != ">":
            return v
        k = 1
        while k < 4 and self.v(k) in (">", "=", "==", "=>") and self.x.start[self.i + k] == self.x.end[self.i + k - 1]:
            v += self.v(k)
            k += 1
            if v[-1] == "=":
                break
        return v if v in (">", ">=", ">>", ">>>", ">>=", ">>>=") else ">"

    def node(self, t: str, a: int, **f) -> Node:
        return {"t": t, "a": a, "z": self.last(), **f}

    def semi(self) -> None:
        self.take(";")

    # Types.
    def skip_angle(self, i: int) -> int:
        """The token after a type argument list that begins at token i, or -1."""
        depth = 0
        x = self.x
        while i < len(x.kind):
            v = x.value[i] if x.kind[i] == "punct" else ""
            if v in _PAIRS:
                i = x.match.get(i, len(x.kind))
            elif v == "<":
                depth += 1
            elif v == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif v in (";", ")", "]", "}", "&&", "||", "=="):
                return -1
            elif x.kind[i] == "end":
                return -1
            i += 1
        return -1

    def skip_type(self) -> str:
        a = self.at()
        self._type()
        return self.text[a : self.last()].strip()

    def _type(self) -> None:
        self.take("|") or self.take("&")
        while self.v() in ("keyof", "typeof", "unique", "infer", "readonly", "asserts", "abstract", "new") and self.kind(1) != "end" and self.v(1) not in (",", ")", ">", "=", ";", "]", "|", "&", "=>"):
            self.i += 1
        v = self.v()
        if v == "<":
            self.i = self._after(self.skip_angle(self.i))
            v = self.v()
        if v in _PAIRS:
            self.i = self.x.match[self.i] + 1
            if v == "(" and self.take("=>"):
                return self._type()
        elif self.kind() in ("word", "string", "number", "template") or v == "-":
            self.i += 1 + (v == "-")
            while True:
                if self.v() == ".":
                    self.i += 2
                elif self.v() == "<" and not self.x.line[self.i]:
                    self.i = self._after(self.skip_angle(self.i))
                elif self.v() == "(" and self.x.value[self.i - 1] == "import":
                    self.i = self.x.match[self.i] + 1
                else:
                    break
        else:
            raise ScriptError("expected a type", self.at())
        while self.v() == "[" and not self.x.line[self.i]:
            self.i = self.x.match[self.i] + 1
        if self.v() in ("|", "&"):
            self.i += 1
            self._type()
        elif self.v() == "is" and not self.x.line[self.i]:
            self.i += 1
            self._type()
        elif self.v() == "extends":
            self.i += 1
            self._type()
            if self.take("?"):
                self._type()
                self.need(":")
                self._type()

    def _after(self, i: int) -> int:
        if i < 0:
            raise ScriptError("unclosed type arguments", self.at())
        return i

    def annotation(self) -> str | None:
        self.take("?") or self.take("!")
        return self.skip_type() if self.take(":") else None

    # Statements.
    def program(self) -> Node:
        a = self.at()
        body = []
        while self.kind() != "end":
            body.append(self.statement())
        return {"t": "Program", "a": a, "z": self.x.end[-1], "body": body}

    def block(self) -> Node:
        a = self.at()
        self.need("{")
        body = []
        while self.v() != "}":
            if self.kind() == "end":
                raise ScriptError("unclosed block", a)
            body.append(self.statement())
        self.need("}")
        return self.node("Block", a, body=body)

    def statement(self) -> Node:
        a, v, nxt = self.at(), self.v(), self.v(1)
        if v == "{":
            return self.block()
        if v == ";":
            self.i += 1
            return self.node("Empty", a)
        if v == "@":
            self.i += 1
            self.postfix()
            return self.statement()
        if self.kind() == "word":
            if v in ("var", "const") or (v == "let" and (self.kind(1) == "word" or nxt in ("{", "["))):
                if v == "const" and nxt == "enum":
                    self.i += 1
                    return self.statement()
                d = self.declaration()
                self.semi()
                return d
            if v == "function" or (v == "async" and nxt == "function" and not self.x.line[self.i + 1]):
                return self.function(True)
            if v == "class" or (v == "abstract" and nxt == "class"):
                self.take("abstract")
                return self.klass()
            if v == "import" and nxt not in ("(", "."):
                return self.import_()
            if v == "export":
                return self.export()
            if v == "if":
                self.i += 1
                test = self.paren()
                yes = self.statement()
                no = self.statement() if self.take("else") else None
                return self.node("If", a, test=test, yes=yes, no=no)
            if v == "for":
                return self.for_()
            if v == "while":
                self.i += 1
                test = self.paren()
                return self.node("While", a, test=test, body=self.statement())
            if v == "do":
                self.i += 1
                body = self.statement()
                self.need("while")
                test = self.paren()
                self.semi()
                return self.node("While", a, test=test, body=body)
            if v in ("return", "throw"):
                self.i += 1
                value = None if self.v() in (";", "}") or self.kind() == "end" or self.x.line[self.i] else self.expression()
                self.semi()
                return self.node("Return" if v == "return" else "Throw", a, value=value)
            if v in ("break", "continue", "debugger"):
                self.i += 1
                if self.kind() == "word" and not self.x.line[self.i]:
                    self.i += 1
                self.semi()
                return self.node("Jump", a)
            if v == "try":
                self.i += 1
                body, param, handler, final = self.block(), None, None, None
                if self.take("catch"):
                    if self.take("("):
                        param = self.pattern()
                        self.annotation()
                        self.need(")")
                    handler = self.block()
                if self.take("finally"):
                    final = self.block()
                return self.node("Try", a, body=body, param=param, handler=handler, final=final)
            if v == "switch":
                self.i += 1
                test, cases = self.paren(), []
                self.need("{")
                while not self.take("}"):
                    b = self.at()
                    value = None
                    if self.take("case"):
                        value = self.expression()
                    else:
                        self.need("default")
                    self.need(":")
                    body = []
                    while self.v() not in ("case", "default", "}"):
                        body.append(self.statement())
                    cases.append(self.node("Case", b, test=value, body=body))
                return self.node("Switch", a, test=test, cases=cases)
            if v in ("interface", "type", "declare", "namespace", "module", "enum") and self.kind(1) == "word" and not self.x.line[self.i + 1]:
                return self.typed(v)
            if nxt == ":" and v not in _NOT_A_NAME:
                self.i += 2
                return self.statement()
        e = self.expression()
        self.semi()
        return self.node("Expression", a, value=e)

    def typed(self, v: str) -> Node:
        """Declarations that leave nothing, or a name only, at run time."""
        a = self.at()
        self.i += 1
        if v == "type":
            self.i += 1
            if self.v() == "<":
                self.i = self._after(self.skip_angle(self.i))
            if self.take("="):
                self.skip_type()
            self.semi()
        elif v == "declare":
            if self.v() == "global":
                self.i = self.x.match[self.i + 1] + 1
            else:
                self.statement()
        else:
            while self.v() != "{":
                if self.kind() == "end":
                    raise ScriptError("expected {", a)
                self.i = self._after(self.skip_angle(self.i)) if self.v() == "<" else self.i + 1
            self.i = self.x.match[self.i] + 1
        return self.node("Typed", a)

    def paren(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def declaration(self, in_for: bool = False) -> Node:
        a, kind, found = self.at(), self.v(), []
        self.i += 1
        while True:
            b = self.at()
            target = self.pattern()
            ty = self.annotation()
            init = self.assign(no_in=in_for) if self.take("=") else None
            found.append(self.node("Declarator", b, target=target, init=init, ty=ty))
            if not self.take(","):
                return self.node("Declaration", a, kind=kind, found=found)

    def for_(self) -> Node:
        a = self.at()
        self.i += 1
        self.take("await")
        self.need("(")
        first = None
        if self.v() in ("var", "const") or (self.v() == "let" and (self.kind(1) == "word" or self.v(1) in ("{", "["))):
            first = self.declaration(True)
        elif self.v() != ";":
            first = self.expression(no_in=True)
        if self.v() in ("of", "in"):
            self.i += 1
            over = self.expression()
            self.need(")")
            return self.node("ForEach", a, first=first, over=over, body=self.statement())
        self.need(";")
        test = None if self.v() == ";" else self.expression()
        self.need(";")
        step = None if self.v() == ")" else self.expression()
        self.need(")")
        return self.node("For", a, first=first, test=test, step=step, body=self.statement())

    def import_(self) -> Node:
        a, names = self.at(), []
        self.i += 1
        if self.v() == "type" and (self.kind(1) == "word" and self.v(1) != "from" or self.v(1) in ("{", "*")):
            self.i += 1
        if self.kind() == "string":
            source = self.string()
            self._attributes()
            return self.node("Import", a, source=source, names=None)
        while self.v() != "from":
            b = self.at()
            if self.take("*"):
                self.need("as")
                local = self.name()
                names.append(self.node("ImportName", b, imported="*", local=local))
            elif self.take("{"):
                while not self.take("}"):
                    b = self.at()
                    if self.v() == "type" and self.v(1) not in (",", "}", "as"):
                        self.i += 1
                    imported = self.string() if self.kind() == "string" else self.name()["name"]
                    local = self.name() if self.take("as") else {"t": "Name", "a": b, "z": self.last(), "name": imported}
                    names.append(self.node("ImportName", b, imported=imported, local=local))
                    self.take(",")
            else:
                local = self.name()
                if self.take("="):
                    self.assign()
                    self.semi()
                    return self.node("Typed", a)
                names.append(self.node("ImportName", b, imported="default", local=local))
            self.take(",")
        self.need("from")
        source = self.string()
        self._attributes()
        return self.node("Import", a, source=source, names=names)

    def _attributes(self) -> None:
        if self.v() in ("with", "assert") and self.v(1) == "{" and not self.x.line[self.i]:
            self.i = self.x.match[self.i + 1] + 1
        self.semi()

    def export(self) -> Node:
        a = self.at()
        self.i += 1
        if self.take("default"):
            if self.v() in ("function", "class", "async", "abstract") and (self.v() != "async" or self.v(1) == "function"):
                value = self.klass() if self.v() in ("class", "abstract") else self.function(True)
            elif self.v() == "interface":
                return self.typed("interface")
            else:
                value = self.assign()
                self.semi()
            return self.node("ExportDefault", a, value=value)
        if self.v() == "type" and self.v(1) in ("{", "*"):
            self.i += 1
        if self.take("="):
            value = self.expression()
            self.semi()
            return self.node("Expression", a, value=value)
        if self.take("*"):
            name = (self.string() if self.kind() == "string" else self.name()["name"]) if self.take("as") else None
            self.need("from")
            source = self.string()
            self._attributes()
            return self.node("ExportAll", a, source=source, name=name)
        if self.take("{"):
            names = []
            while not self.take("}"):
                b = self.at()
                if self.v() == "type" and self.v(1) not in (",", "}", "as"):
                    self.i += 1
                local = self.string() if self.kind() == "string" else self.name()["name"]
                c = self.last()
                exported = (self.string() if self.kind() == "string" else self.name()["name"]) if self.take("as") else local
                names.append(self.node("ExportName", b, local=local, exported=exported, end=c))
                self.take(",")
            source = None
            if self.take("from"):
                source = self.string()
                self._attributes()
            self.semi()
            return self.node("ExportNames", a, names=names, source=source)
        return self.node("Export", a, value=self.statement())

    def string(self) -> str:
        if self.kind() != "string":
            raise ScriptError("expected a string", self.at())
        self.i += 1
        return unquote(self.x.value[self.i - 1])

    def name(self) -> Node:
        if self.kind() != "word":
            raise ScriptError("expected a name", self.at())
        self.i += 1
        return self.node("Name", self.x.start[self.i - 1], name=self.x.value[self.i - 1])

    # Patterns, functions, classes.
    def pattern(self) -> Node:
        a = self.at()
        if self.take("{"):
            found = []
            while not self.take("}"):
                b = self.at()
                if self.take("..."):
                    found.append(self.node("Rest", b, value=self.pattern()))
                else:
                    computed = self.v() == "["
                    key = self.key()
                    if self.take(":"):
                        value = self.pattern()
                    elif computed:
                        raise ScriptError("expected :", self.at())
                    else:
                        value = {"t": "Name", "a": b, "z": self.last(), "name": key["name"]}
                    default = self.assign() if self.take("=") else None
                    found.append(self.node("Field", b, key=key, value=value, default=default))
                if self.v() != "}":
                    self.need(",")
            return self.node("ObjectPattern", a, found=found)
        if self.take("["):
            found = []
            while not self.take("]"):
                b = self.at()
                if self.take(","):
                    continue
                rest = self.take("...")
                value = self.pattern()
                default = self.assign() if self.take("=") else None
                found.append(self.node("Rest" if rest else "Item", b, value=value, default=default))
                if self.v() != "]":
                    self.need(",")
            return self.node("ArrayPattern", a, found=found)
        if self.kind() == "word" and self.v() not in _NOT_A_NAME or self.v() == "this":
            return self.name()
        raise ScriptError("expected a pattern", a)

    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            a = self.at()
            while self.v() == "@":
                self.i += 1
                self.postfix()
            while self.v() in ("public", "private", "protected", "readonly", "override") and (self.kind(1) == "word" or self.v(1) in ("{", "[")):
                self.i += 1
            rest = self.take("...")
            target = self.pattern()
            ty = self.annotation()
            default = self.assign() if self.take("=") else None
            out.append(self.node("Param", a, target=target, default=default, rest=rest, ty=ty))
            if self.v() != ")":
                self.need(",")
        return out

    def function(self, statement: bool = False) -> Node:
        a = self.at()
        is_async = self.take("async")
        self.need("function")
        self.take("*")
        name = self.name() if self.kind() == "word" else None
        return self.rest_of_function(a, name, is_async, "Function", statement)

    def rest_of_function(self, a: int, name: Node | None, is_async: bool, t: str = "Function", statement: bool = False) -> Node:
        if self.v() == "<":
            self.i = self._after(self.skip_angle(self.i))
        bare, self.bare = self.bare, 0
        params = self.params()
        ty = self.skip_type() if self.take(":") else None
        body = self.block() if self.v() == "{" else None
        self.bare = bare
        if body is None:
            self.semi()
        return self.node(t, a, name=name, params=params, body=body, ty=ty, **{"async": is_async, "statement": statement})

    def klass(self) -> Node:
        a = self.at()
        self.need("class")
        name = self.name() if self.kind() == "word" and self.v() not in ("extends", "implements") else None
        if self.v() == "<":
            self.i = self._after(self.skip_angle(self.i))
        base = None
        if self.take("extends"):
            base = self.postfix()
            if self.v() == "<":
                self.i = self._after(self.skip_angle(self.i))
        if self.take("implements"):
            self._type()
            while self.take(","):
                self._type()
        self.need("{")
        body = []
        while not self.take("}"):
            if self.take(";"):
                continue
            b = self.at()
            while self.v() == "@":
                self.i += 1
                self.postfix()
            while self.v() in ("static", "public", "private", "protected", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor") and self.v(1) not in ("(", "=", ";", ":", "?", "!", "}", "<") and not (self.v() == "static" and self.v(1) == "{"):
                self.i += 1
            if self.v() == "static":
                self.i += 1
                body.append(self.block())
                continue
            self.take("*")
            if self.v() == "[" and self.x.value[self.x.match[self.i] + 1] == ":" and self.kind(1) == "word" and self.v(2) == ":":
                self.i = self.x.match[self.i] + 1
                self.annotation()
                self.semi()
                continue
            key = self.key()
            self.take("?") or self.take("!")
            if self.v() in ("(", "<"):
                body.append(self.node("Method", b, key=key, value=self.rest_of_function(b, None, False)))
            else:
                self.annotation()
                value = self.assign() if self.take("=") else None
                self.semi()
                body.append(self.node("Method", b, key=key, value=value))
        return self.node("Class", a, name=name, base=base, body=body)

    def key(self) -> Node:
        """A property's key; `name` is its text unless it is computed."""
        a = self.at()
        if self.take("["):
            e = self.assign()
            self.need("]")
            return self.node("Key", a, name=e["value"] if e["t"] == "String" else None, computed=e)
        if self.kind() == "string":
            return self.node("Key", a, name=self.string(), computed=None)
        if self.kind() in ("word", "number"):
            self.i += 1
            return self.node("Key", a, name=self.x.value[self.i - 1], computed=None)
        raise ScriptError("expected a property", a)

    # Expressions.
    def expression(self, no_in: bool = False) -> Node:
        a = self.at()
        e = self.assign(no_in)
        if self.v() == ",":
            found = [e]
            while self.take(","):
                found.append(self.assign(no_in))
            return self.node("Sequence", a, found=found)
        return e

    def _arrow_ahead(self) -> bool:
        i = self.i
        v = self.x.value
        if self.v() == "async" and not self.x.line[i + 1] and (self.kind(1) == "word" and self.v(2) == "=>" or self.v(1) in ("(", "<")):
            i += 1
        if self.x.kind[i] == "word":
            return v[i] not in _NOT_A_NAME and self.x.kind[i + 1] == "punct" and v[i + 1] == "=>"
        if v[i] == "<" and self.x.kind[i] == "punct":
            i = self.skip_angle(i)
            if i < 0 or v[i] != "(":
                return False
        if v[i] != "(" or self.x.kind[i] != "punct":
            return False
        j = self.x.match[i] + 1
        if v[j] == "=>" and self.x.kind[j] == "punct":
            return True
        if v[j] == ":" and self.x.kind[j] == "punct" and not self.bare and self.lang in ("ts", "tsx"):
            kept = self.i
            try:
                self.i = j + 1
                self._type()
                return self.v() == "=>"
            except (ScriptError, KeyError, IndexError):
                return False
            finally:
                self.i = kept
        return False

    def arrow(self) -> Node:
        a = self.at()
        is_async = self.v() == "async" and self.v(1) != "=>"
        if is_async:
            self.i += 1
        ty = None
        if self.kind() == "word":
            p = self.name()
            params = [{"t": "Param", "a": p["a"], "z": p["z"], "target": p, "default": None, "rest": False, "ty": None}]
        else:
            if self.v() == "<":
                self.i = self._after(self.skip_angle(self.i))
            params = self.params()
            ty = self.skip_type() if self.take(":") else None
        self.need("=>")
        bare = self.bare
        if self.v() == "{":
            self.bare = 0
            body = self.block()
        else:
            body = self.assign()
        self.bare = bare
        return self.node("Arrow", a, name=None, params=params, body=body, ty=ty, **{"async": is_async, "statement": False})

    def assign(self, no_in: bool = False) -> Node:
        a = self.at()
        if self._arrow_ahead():
            return self.arrow()
        if self.v() == "yield":
            self.i += 1
            self.take("*")
            value = None if self.v() in (")", "]", "}", ",", ";", ":") or self.kind() == "end" or self.x.line[self.i] else self.assign(no_in)
            return self.node("Yield", a, value=value)
        left = self.binary(0, no_in)
        if self.v() == "?":
            self.i += 1
            self.bare += 1
            yes = self.assign()
            self.bare -= 1
            self.need(":")
            no = self.assign(no_in)
            return self.node("Ternary", a, test=left, yes=yes, no=no)
        op = self.glued()
        if op in _ASSIGN:
            self.i += 1 if op[0] != ">" else len(op)
            return self.node("Assign", a, op=op, left=left, right=self.assign(no_in))
        return left

    def binary(self, least: int, no_in: bool) -> Node:
        a = self.at()
        left = self.unary()
        while True:
            op = self.glued()
            if op in ("as", "satisfies") and not self.x.line[self.i] and self.kind() == "word":
                self.i += 1
                left = self.node("Cast", a, value=left, ty=self.skip_type())
                continue
            level = _BINARY.get(op)
            if level is None or level <= least or (op == "in" and no_in):
                return left
            self.i += len(op) if op[0] == ">" and op != ">" and op != ">=" else 2 if op == ">=" and self.x.value[self.i] == ">" else 1
            right = self.binary(level - (op == "**"), no_in)
            left = self.node("Logical" if op in ("&&", "||", "??") else "Binary", a, op=op, left=left, right=right)

    def unary(self) -> Node:
        a, v = self.at(), self.v()
        if v in ("!", "~", "+", "-") or (v in ("typeof", "void", "delete") and self.kind() == "word"):
            self.i += 1
            return self.node("Unary", a, op=v, value=self.unary())
        if v in ("++", "--"):
            self.i += 1
            return self.node("Update", a, value=self.unary())
        if v == "await" and self.kind() == "word" and self.v(1) not in (")", "]", ",", ";", "=", "=>", "."):
            self.i += 1
            return self.node("Await", a, value=self.unary())
        if v == "<" and self.lang == "ts":
            j = self.skip_angle(self.i)
            if j > 0:
                self.i = j
                return self.unary()
        e = self.postfix()
        if self.v() in ("++", "--") and not self.x.line[self.i]:
            self.i += 1
            return self.node("Update", a, value=e)
        return e

    def args(self) -> list[Node]:
        self.need("(")
        out = []
        bare, self.bare = self.bare, 0
        while not self.take(")"):
            a = self.at()
            if self.take("..."):
                out.append(self.node("Spread", a, value=self.assign()))
            else:
                out.append(self.assign())
            if self.v() != ")":
                self.need(",")
        self.bare = bare
        return out

    def postfix(self, calls: bool = True) -> Node:
        a = self.at()
        e = self.primary()
        while True:
            v = self.v()
            if v in (".", "?."):
                self.i += 1
                opt = v == "?."
                if opt and self.v() == "(":
                    e = self.node("Call", a, callee=e, args=self.args())
                elif opt and self.v() == "[":
                    self.i += 1
                    p = self.expression()
                    self.need("]")
                    e = self.node("Member", a, object=e, name=p["value"] if p["t"] == "String" else None, computed=p)
                else:
                    p = self.name()
                    e = self.node("Member", a, object=e, name=p["name"], computed=None)
            elif v == "[":
                self.i += 1
                bare, self.bare = self.bare, 0
                p = self.expression()
                self.bare = bare
                self.need("]")
                e = self.node("Member", a, object=e, name=p["value"] if p["t"] == "String" else None, computed=p)
            elif v == "(" and calls:
                e = self.node("Call", a, callee=e, args=self.args())
            elif v == "!" and not self.x.line[self.i] and self.lang in ("ts", "tsx") and self.kind() == "punct":
                self.i += 1
            elif self.kind() == "template":
                e = self.node("Tagged", a, tag=e, value=self.primary())
            elif v == "<" and self.lang in ("ts", "tsx") and not self.x.line[self.i]:
                j = self.skip_angle(self.i)
                if j < 0 or not (self.x.kind[j] == "template" or self.x.kind[j] == "punct" and self.x.value[j] == "("):
                    return e
                self.i = j
                if not calls and self.v() == "(":
                    return e
            else:
                return e

    def primary(self) -> Node:
        a, k, v = self.at(), self.kind(), self.x.value[self.i]
        if k == "word":
            if v == "function" or (v == "async" and self.v(1) == "function" and not self.x.line[self.i + 1]):
                return self.function()
            if v == "class":
                return self.klass()
            if v == "new":
                self.i += 1
                if self.take("."):
                    self.i += 1
                    return self.node("Meta", a)
                callee = self.postfix(calls=False)
                if self.v() == "<":
                    self.i = self._after(self.skip_angle(self.i))
                return self.node("New", a, callee=callee, args=self.args() if self.v() == "(" else [])
            if v == "import":
                self.i += 1
                if self.take("."):
                    self.i += 1
                    return self.node("Meta", a)
                return self.node("DynamicImport", a, args=self.args())
            if v in ("this", "super", "null", "true", "false"):
                self.i += 1
                return self.node("Literal", a, value=v)
            if v in _NOT_A_NAME:
                raise ScriptError(f"unexpected {v}", a)
            return self.name()
        if k == "number":
            self.i += 1
            return self.node("Number", a, value=v)
        if k == "string":
            return self.node("String", a, value=self.string())
        if k == "regex":
            self.i += 1
            return self.node("Regex", a)
        if k == "template":
            holes = [sub(self.text, b, c, self.lang).whole() for b, c in self.x.parts[self.i]]
            self.i += 1
            return self.node("Template", a, found=holes)
        if v == "(":
            self.i += 1
            bare, self.bare = self.bare, 0
            e = self.expression()
            self.bare = bare
            self.need(")")
            return e
        if v == "[":
            self.i += 1
            found = []
            bare, self.bare = self.bare, 0
            while not self.take("]"):
                if self.take(","):
                    continue
                b = self.at()
                found.append(self.node("Spread", b, value=self.assign()) if self.take("...") else self.assign())
                if self.v() != "]":
                    self.need(",")
            self.bare = bare
            return self.node("Array", a, found=found)
        if v == "{":
            return self.object()
        if v == "<" and self.jsx:
            return self.jsx_element()
        if v == "@":
            self.i += 1
            self.postfix()
            return self.primary()
        raise ScriptError(f"unexpected {v or 'end'}", a)

    def object(self) -> Node:
        a = self.at()
        self.need("{")
        bare, self.bare = self.bare, 0
        found = []
        while not self.take("}"):
            b = self.at()
            if self.take("..."):
                found.append(self.node("Spread", b, value=self.assign()))
            else:
                is_async = False
                if self.v() in ("async", "get", "set") and self.v(1) not in (",", "}", ":", "(", "=", "<"):
                    is_async = self.v() == "async"
                    self.i += 1
                self.take("*")
                word = self.kind() == "word"
                key = self.key()
                if self.v() in ("(", "<"):
                    value = self.rest_of_function(b, None, is_async)
                    found.append(self.node("Property", b, key=key, value=value, short=False))
                elif self.take(":"):
                    found.append(self.node("Property", b, key=key, value=self.assign(), short=False))
                elif word:
                    value = {"t": "Name", "a": key["a"], "z": key["z"], "name": key["name"]}
                    if self.take("="):
                        value = self.node("Assign", b, op="=", left=value, right=self.assign())
                    found.append(self.node("Property", b, key=key, value=value, short=True))
                else:
                    raise ScriptError("expected :", self.at())
            if self.v() != "}":
                self.need(",")
        self.bare = bare
        return self.node("Object", a, found=found)

    # JSX is read from the text, and the tokens are made anew behind it.
    def jsx_element(self) -> Node:
        node, end = Jsx(self.text, self.lang, self.x.end[-1]).element(self.at())
        while self.x.start[self.i] < end and self.kind() != "end":
            self.i += 1
        self.jsx_end = end
        node["z"] = end
        return node

    def whole(self) -> Node:
        """The text as one expression."""
        e = self.expression()
        if self.kind() != "end":
            raise ScriptError("unexpected text behind the expression", self.at())
        return e


_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")


class Jsx:
    """Elements, their attributes and children; expressions in braces are parsed as such."""

    def __init__(self, text: str, lang: str, end: int) -> None:
        self.text, self.lang, self.end = text, lang, end

    def _space(self, i: int) -> int:
        while i < self.end:
            m = _SPACE.match(self.text, i, self.end)
            if not m:
                break
            i = m.end()
        return i

    def _braced(self, i: int) -> tuple[Node | None, int]:
        """The expression in the braces that begin at i."""
        depth, j, text = 0, i, self.text
        while j < self.end:
            c = text[j]
            if c in "\"'" and (m := _STRING.match(text, j, self.end)):
                j = m.end()
                continue
            if c == "`":
                j = Lexer._template(_Text(text), j, self.end)[0]
                continue
            depth += (c == "{") - (c == "}")
            j += 1
            if not depth:
                inner = text[i + 1 : j - 1].strip()
                if not inner or inner.startswith(("/*", "//")):
                    return None, j
                k = i + 1
                spread = inner.startswith("...")
                if spread:
                    k = text.index("...", i) + 3
                return sub(text, k, j - 1, self.lang).whole(), j
        raise ScriptError("unclosed brace", i)

    def element(self, i: int) -> tuple[Node, int]:
        a, text = i, self.text
        i = self._space(i + 1)
        m = _JSX_NAME.match(text, i, self.end)
        tag = m.group() if m else ""
        i = m.end() if m else i
        props: list[Node] = []
        while True:
            i = self._space(i)
            if text.startswith("/>", i):
                return {"t": "Jsx", "a": a, "z": i + 2, "tag": tag, "props": props, "children": [], "head": i + 2}, i + 2
            if i < self.end and text[i] == ">":
                i += 1
                break
            if i < self.end and text[i] == "{":
                e, i = self._braced(i)
                if e:
                    props.append({"t": "JsxSpread", "a": e["a"], "z": i, "value": e})
                continue
            m = _JSX_NAME.match(text, i, self.end)
            if not m:
                raise ScriptError("expected an attribute", min(i, self.end))
            p = {"t": "JsxProp", "a": i, "z": m.end(), "name": m.group(), "value": None, "text": None}
            i = self._space(m.end())
            if i < self.end and text[i] == "=":
                i = self._space(i + 1)
                if text[i : i + 1] == "{":
                    p["value"], i = self._braced(i)
                elif text[i : i + 1] in ('"', "'"):
                    j = text.index(text[i], i + 1)
                    p["text"] = text[i + 1 : j]
                    i = j + 1
                else:
                    p["value"], i = self.element(i)
            props.append(p)
        head, children = i, []
        while True:
            j = min((k for k in (text.find("<", i, self.end), text.find("{", i, self.end)) if k >= 0), default=-1)
            if j < 0:
                raise ScriptError("unclosed element", a)
            if text[i:j].strip():
                children.append({"t": "JsxText", "a": i, "z": j})
            if text[j] == "{":
                e, i = self._braced(j)
                if e:
                    children.append({"t": "JsxHole", "a": j, "z": i, "value": e})
            elif text.startswith("</", j):
                k = text.index(">", j)
                return {"t": "Jsx", "a": a, "z": k + 1, "tag": tag, "props": props, "children": children, "head": head}, k + 1
            else:
                e, i = self.element(j)
                children.append(e)


class _Text:
    def __init__(self, text: str) -> None:
        self.text = text

    def _template(self, at: int, z: int):
        return Lexer._template(self, at, z)


def sub(text: str, a: int, z: int, lang: str) -> Parser:
    return Parser(text, a, z, lang)


def unquote(s: str) -> str:
    body = s[1:-1]
    return re.sub(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\n)|(.))", _escape, body, flags=re.S) if "\\" in body else body


def _escape(m: re.Match) -> str:
    code = m.group(1) or m.group(2) or m.group(3)
    if code:
        return chr(int(code, 16)) if int(code, 16) < 0x110000 else ""
    return "" if m.group(4) else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}.get(m.group(5), m.group(5))


def parse(text: str, a: int = 0, z: int | None = None, lang: str = "ts") -> Node:
    """The program in text[a:z]; spans count from the start of the whole text."""
    try:
        if lang in ("jsx", "tsx", "js"):
            return _JsxParser(text, a, z, lang).program()
        return Parser(text, a, z, lang).program()
    except (KeyError, IndexError, RecursionError) as e:
        raise ScriptError(f"not understood: {type(e).__name__}", a) from e


class _LooseLexer(Lexer):
    """Brackets in the text of elements need no partner."""

    jsx_like = True


class _JsxParser(Parser):
    def __init__(self, text: str, a: int = 0, z: int | None = None, lang: str = "tsx") -> None:
        self.lang, self.jsx = lang, True
        self.text, self.i, self.bare = text, 0, 0
        try:
            self.x = Lexer(text, a, z)
        except ScriptError:
            self.x = _LooseLexer(text, a, z)

    def jsx_element(self) -> Node:
        node, end = Jsx(self.text, self.lang, self.x.end[-1]).element(self.at())
        # Text between tags may have been read as any tokens; what follows the element is read anew.
        z = self.x.end[-1]
        kept = {c: getattr(self.x, c)[: self.i] for c in ("kind", "value", "start", "end", "line")}
        match, parts = {k: v for k, v in self.x.match.items() if v < self.i}, {k: v for k, v in self.x.parts.items() if k < self.i}
        held = [k for k in range(self.i) if kept["kind"][k] == "punct" and kept["value"][k] in _PAIRS and k not in match]
        rest = _LooseLexer.__new__(_LooseLexer)
        _LooseLexer.__init__(rest, self.text, end, z)
        for c, head in kept.items():
            setattr(rest, c, head + ["element" if c == "kind" else "" if c == "value" else self.at() if c == "start" else end if c == "end" else False] + getattr(rest, c))
        shift = self.i + 1
        rest.match = match | {k + shift: v + shift for k, v in rest.match.items()}
        rest.parts = parts | {k + shift: v for k, v in rest.parts.items()}
        inner = set(rest.match.values())
        closers = [k for k in range(shift, len(rest.kind)) if rest.kind[k] == "punct" and rest.value[k] in ")]}" and k not in inner]
        for open_, close in zip(reversed(held), closers):
            rest.match[open_] = close
        self.x = rest
        self.i += 1
        return node


def kids(n: Node) -> Iterator[Node]:
    for v in n.values():
        if isinstance(v, dict):
            yield v
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, dict):
                    yield x


def walk(n: Node) -> Iterator[Node]:
    """The node and all below it, in source order of their roles."""
    stack = [n]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(list(kids(n))))


FUNCTIONS = ("Function", "Arrow")


def pattern_names(p: Node) -> Iterator[Node]:
    """The names a pattern binds."""
    if p["t"] == "Name":
        yield p
    elif p["t"] in ("ObjectPattern", "ArrayPattern"):
        for f in p["found"]:
            yield from pattern_names(f["value"])


class Symbol:
    __slots__ = ("name", "a", "z", "reads", "writes", "declared")

    def __init__(self, name: str, a: int, z: int, declared: Node) -> None:
        self.name, self.a, self.z, self.declared = name, a, z, declared
        self.reads = self.writes = 0


class Scope:
    __slots__ = ("names", "up", "function")

    def __init__(self, up: Scope | None, function: bool) -> None:
        self.names: dict[str, Symbol] = {}
        self.up, self.function = up, function

    def find(self, name: str) -> Symbol | None:
        s: Scope | None = self
        while s:
            if name in s.names:
                return s.names[name]
            s = s.up
        return None

    def declare(self, n: Node, node: Node, hoist: bool = False) -> None:
        s = self
        while hoist and not s.function and s.up:
            s = s.up
        s.names.setdefault(n["name"], Symbol(n["name"], n["a"], n["z"], node))


class Names:
    """Resolves every name of a program: Name nodes that are references get `sym` (None: global), symbols their counts."""

    def __init__(self, program: Node) -> None:
        self.symbols: list[Symbol] = []
        self.free: list[Node] = []
        self.scopes: list[Scope] = []
        self.pending: list[tuple[Node, Scope, bool, bool]] = []
        top = self._open(None, True)
        self.top = top
        self._hoist(program["body"], top)
        for s in program["body"]:
            self._visit(s, top)
        for n, scope, read, write in self.pending:
            sym = n["sym"] = scope.find(n["name"])
            if sym:
                sym.reads += read
                sym.writes += write
            else:
                self.free.append(n)
        self.symbols = sorted((x for s in self.scopes for x in s.names.values()), key=lambda x: x.a)

    def _open(self, up: Scope | None, function: bool) -> Scope:
        s = Scope(up, function)
        self.scopes.append(s)
        return s

    def _hoist(self, body: list[Node], scope: Scope) -> None:
        for n in body:
            if n["t"] in ("Export", "ExportDefault"):
                n = n["value"]
            t = n["t"]
            if t == "Declaration":
                for d in n["found"]:
                    for x in pattern_names(d["target"]):
                        scope.declare(x, d, n["kind"] == "var")
            elif t in ("Function", "Class") and n.get("name"):
                scope.declare(n["name"], n)
            elif t == "Import":
                for x in n["names"] or []:
                    scope.declare(x["local"], x)

    def _ref(self, n: Node, scope: Scope, read: bool = True, write: bool = False) -> None:
        self.pending.append((n, scope, read, write))

    def _pattern(self, p: Node, scope: Scope) -> None:
        """Defaults and computed keys of a declaring pattern."""
        if p["t"] in ("ObjectPattern", "ArrayPattern"):
            for f in p["found"]:
                if f.get("key") and f["key"]["computed"]:
                    self._visit(f["key"]["computed"], scope)
                if f.get("default"):
                    self._visit(f["default"], scope)
                self._pattern(f["value"], scope)

    def _target(self, n: Node, scope: Scope, read: bool) -> None:
        """What an assignment writes."""
        if n["t"] == "Name":
            self._ref(n, scope, read, True)
        elif n["t"] == "Object":
            for f in n["found"]:
                self._target(f["value"], scope, False)
        elif n["t"] == "Array":
            for f in n["found"]:
                self._target(f["value"] if f["t"] == "Spread" else f, scope, False)
        elif n["t"] == "Assign":
            self._target(n["left"], scope, False)
            self._visit(n["right"], scope)
        else:
            self._visit(n, scope)

    def _visit(self, n: Node, scope: Scope) -> None:
        t = n["t"]
        if t == "Name":
            self._ref(n, scope)
        elif t in FUNCTIONS:
            inner = self._open(scope, True)
            if t == "Function" and n["name"] and not n["statement"]:
                inner.declare(n["name"], n)
            for p in n["params"]:
                for x in pattern_names(p["target"]):
                    inner.declare(x, p)
                self._pattern(p["target"], inner)
                if p["default"]:
                    self._visit(p["default"], inner)
            if n["body"] is not None:
                if n["body"]["t"] == "Block":
                    self._hoist(n["body"]["body"], inner)
                    for s in n["body"]["body"]:
                        self._visit(s, inner)
                else:
                    self._visit(n["body"], inner)
        elif t == "Block":
            inner = self._open(scope, False)
            self._hoist(n["body"], inner)
            for s in n["body"]:
                self._visit(s, inner)
        elif t in ("For", "ForEach"):
            inner = self._open(scope, False)
            if n["first"]:
                if n["first"]["t"] == "Declaration":
                    self._hoist([n["first"]], inner)
                    self._visit(n["first"], inner)
                elif t == "ForEach":
                    self._target(n["first"], inner, False)
                else:
                    self._visit(n["first"], inner)
            for k in ("over", "test", "step", "body"):
                if n.get(k):
                    self._visit(n[k], inner)
        elif t == "Switch":
            self._visit(n["test"], scope)
            inner = self._open(scope, False)
            for c in n["cases"]:
                self._hoist(c["body"], inner)
            for c in n["cases"]:
                for x in ([c["test"]] if c["test"] else []) + c["body"]:
                    self._visit(x, inner)
        elif t == "Try":
            self._visit(n["body"], scope)
            if n["handler"]:
                inner = self._open(scope, False)
                if n["param"]:
                    for x in pattern_names(n["param"]):
                        inner.declare(x, n)
                self._visit(n["handler"], inner)
            if n["final"]:
                self._visit(n["final"], scope)
        elif t == "Class":
            if n["base"]:
                self._visit(n["base"], scope)
            inner = self._open(scope, False)
            for m in n["body"]:
                if m["t"] == "Block":
                    self._visit(m, inner)
                else:
                    if m["key"]["computed"]:
                        self._visit(m["key"]["computed"], inner)
                    if m["value"]:
                        self._visit(m["value"], inner)
        elif t == "Declarator":
            self._pattern(n["target"], scope)
            if n["init"]:
                self._visit(n["init"], scope)
        elif t == "Assign":
            self._target(n["left"], scope, n["op"] != "=")
            self._visit(n["right"], scope)
        elif t == "Update":
            self._target(n["value"], scope, True)
        elif t == "Property":
            if n["key"]["computed"]:
                self._visit(n["key"]["computed"], scope)
            self._visit(n["value"], scope)
        elif t == "Member":
            self._visit(n["object"], scope)
            if n["computed"] and n["computed"]["t"] != "String":
                self._visit(n["computed"], scope)
        elif t == "ExportNames":
            if n["source"] is None:
                for x in n["names"]:
                    self._ref({"t": "Name", "a": x["a"], "z": x["end"], "name": x["local"]}, scope)
        elif t == "Import":
            pass
        elif t == "Jsx":
            root = n["tag"].split(".")[0]
            if root[:1].isupper() or "." in n["tag"]:
                self._ref({"t": "Name", "a": n["a"] + 1, "z": n["a"] + 1 + len(root), "name": root}, scope)
            for x in n["props"] + n["children"]:
                self._visit(x, scope)
        else:
            for x in kids(n):
                self._visit(x, scope)
