"""JavaScript and TypeScript sources, by a tokenizer that knows strings, templates, comments and regular
expressions, and matches brackets."""

from __future__ import annotations

import re
from bisect import bisect_left

from treeline.extract.bodies import Body, Finder, placeholder
from treeline.extract.python import first_paragraph

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<name>[A-Za-z_$#][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<mark>.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ return typeof case in of =>".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, line) without spaces; a template is one token, and so is an element of markup."""
    out: list[tuple[str, str, int, int]] = []
    at, line, before = 0, 1, "("
    while at < len(text):
        if text[at] == "`":
            end = _template_end(text, at)
            kind = "string"
        elif text[at] == "/" and before in _BEFORE_REGEX and (m := _REGEX.match(text, at)):
            kind, end = "regex", m.end()
        elif text[at] == "<" and before in _BEFORE_ELEMENT and (stop := _element_end(text, at)):
            kind, end = "element", stop
        else:
            m = _TOKEN.match(text, at)
            kind, end = m.lastgroup, m.end()
        if kind != "space":
            out.append((kind, text[at:end], at, line))
            if kind != "comment":
                before = text[at:end] if kind in ("mark", "name", "arrow") else "x"
        line += text.count("\n", at, end)
        at = end
    return out


_BEFORE_ELEMENT = frozenset("( , = : [ ! & | ? { } ; => return yield default".split())
_TAG = re.compile(r"<([A-Za-z_$][\w$.:-]*)?")


def _code_end(text: str, at: int) -> int | None:
    """Behind the brace that closes the one at ``at``."""
    deep, before = 0, "("
    while at < len(text):
        if text[at] == "`":
            end, last = _template_end(text, at), "x"
        elif text[at] == "/" and before in _BEFORE_REGEX and (m := _REGEX.match(text, at)):
            end, last = m.end(), "x"
        elif text[at] == "<" and before in _BEFORE_ELEMENT and (stop := _element_end(text, at)):
            end, last = stop, "x"
        else:
            m = _TOKEN.match(text, at)
            end = m.end()
            last = before if m.lastgroup in ("space", "comment") else m[0] if m.lastgroup in ("mark", "name", "arrow") else "x"
            deep += (m[0] == "{") - (m[0] == "}")
            if not deep:
                return end
        at, before = end, last
    return None


def _element_end(text: str, at: int) -> int | None:
    """Behind an element of markup: its children are text, other elements and braces with code; none if it never closes."""
    open_tags: list[str] = []
    while True:
        m = _TAG.match(text, at)
        name, at = m[1] or "", m.end()
        while at < len(text) and text[at] != ">" and not text.startswith("/>", at):  # attributes
            if text[at] in "\"'":
                at = text.find(text[at], at + 1) + 1
            elif text.startswith("//", at):
                at = text.find("\n", at)
            elif text.startswith("/*", at):
                at = text.find("*/", at) + 2
            elif text[at] == "{":
                at = _code_end(text, at) or 0
            elif re.match(r"[\w\s.:$=-]", text[at]):
                at += 1
                continue
            else:
                return None
            if at <= 1:
                return None
        if at >= len(text):
            return None
        if text[at] == ">":
            open_tags.append(name)
            at += 1
        else:
            at += 2
        while True:  # children, up to the next tag that opens
            if not open_tags:
                return at
            while at < len(text) and text[at] not in "<{":
                at += 1
            if at >= len(text):
                return None
            if text[at] == "{":
                at = _code_end(text, at)
                if at is None:
                    return None
            elif text.startswith("</", at):
                stop = text.find(">", at)
                if stop < 0 or text[at + 2 : stop].strip() != open_tags.pop():
                    return None
                at = stop + 1
            elif re.match(r"<[A-Za-z_$>]", text[at : at + 2]):
                break
            else:
                return None


def _template_end(text: str, at: int) -> int:
    depth: list[str] = ["`"]
    at += 1
    while at < len(text) and depth:
        c = text[at]
        if c == "\\":
            at += 1
        elif depth[-1] == "`":
            if c == "`":
                depth.pop()
            elif text.startswith("${", at):
                depth.append("{")
                at += 1
        elif c == "`":
            depth.append("`")
        elif c == "{":
            depth.append("{")
        elif c == "}":
            depth.pop()
        at += 1
    return at


class _Reader:
    def __init__(self, text: str) -> None:
        every = tokens(text)
        self.t = [x for x in every if x[0] != "comment"]
        self.comments = {x[3] + x[1].count("\n"): x for x in every if x[0] == "comment"}
        self.close: dict[int, int] = {}
        stack: list[int] = []
        self.errors = 0
        for i, (kind, s, _, _) in enumerate(self.t):
            if kind == "mark" and s in _PAIRS:
                stack.append(i)
            elif kind == "mark" and s in ")]}":
                if stack and _PAIRS[self.t[stack[-1]][1]] == s:
                    self.close[stack.pop()] = i
                else:
                    self.errors = 1
        self.errors = self.errors or int(bool(stack))
        self.symbols: list[tuple] = []

    def s(self, i: int) -> str:
        return self.t[i][1] if i < len(self.t) else ""

    def line(self, i: int) -> int:
        i = min(i, len(self.t) - 1)
        return self.t[i][3] + self.t[i][1].count("\n")

    def doc(self, i: int) -> str | None:
        """The run of comments that ends on the line above token i."""
        line, parts = self.t[i][3] - 1, []
        while line in self.comments:
            parts.append(self.comments[line][1])
            line = self.comments[line][3] - 1
        return first_paragraph("\n".join(reversed(parts)))

    def add(self, name: str, kind: str, first: int, last: int, exported: bool) -> None:
        self.symbols.append((name, kind, self.t[first][3], self.line(last), exported, self.doc(first)))

    def body(self, i: int, end: int) -> int:
        """The token that closes the first block after token i."""
        while i < end:
            if self.s(i) == "{":
                return self.close.get(i, end - 1)
            if self.s(i) == ";":
                return i
            i = self.close.get(i, i) + 1
        return end - 1

    def statement(self, i: int, end: int) -> int:
        """The last token of the statement at i: a semicolon, or where a line ends and no operator goes on."""
        while i < end:
            i = self.close.get(i, i)
            if self.s(i) == ";":
                return i
            nxt = i + 1
            if nxt >= end:
                return i
            goes_on = self.s(i) in "=+-*/%&|^?:,.<(!~" or self.t[i][0] == "arrow" or self.s(nxt) in "=+-*/%&|^?:,.<([)`" or self.t[nxt][0] == "arrow"
            if self.t[nxt][3] > self.line(i) and not goes_on:
                return i
            i = nxt
        return end - 1

    def scan(self, i: int, end: int, top: bool) -> None:
        """Declarations between two tokens; at the top also one level inside a function that is called at once."""
        while i < end:
            first, exported = i, False
            while self.s(i) in ("export", "default", "async", "declare", "abstract"):
                exported = exported or self.s(i) == "export"
                i += 1
            word, name = self.s(i), i + 1
            if word == "function":
                name += self.s(name) == "*"
                last = self.body(name, end)
                if self.t[min(name, len(self.t) - 1)][0] == "name":
                    self.add(self.s(name), "function", first, last, exported)
                i = last + 1
            elif word == "class":
                last = self.body(name, end)
                if self.t[min(name, len(self.t) - 1)][0] == "name":
                    self.add(self.s(name), "class", first, last, exported)
                    self.methods(name, last, exported)
                i = last + 1
            elif word in ("interface", "enum", "namespace") and i + 1 < end and self.t[name][0] == "name":
                last = self.body(name, end)
                if word != "namespace":
                    self.add(self.s(name), word, first, last, exported)
                i = last + 1
            elif word == "type" and i + 2 < end and self.t[name][0] == "name" and self.s(name + 1) in "=<":
                last = self.statement(name, end)
                self.add(self.s(name), "type", first, last, exported)
                i = last + 1
            elif word in ("const", "let", "var"):
                if word == "const" and self.s(name) == "enum":
                    last = self.body(name + 1, end)
                    self.add(self.s(name + 1), "enum", first, last, exported)
                else:
                    last = self.statement(name, end)
                    if self.t[min(name, len(self.t) - 1)][0] == "name":
                        self.variable(name, first, last, exported, top)
                i = last + 1
            else:
                if top and word in ("(", "!", "void"):
                    self.called_at_once(i, end)
                i = self.statement(i, end) + 1

    def variable(self, name: int, first: int, last: int, exported: bool, top: bool) -> None:
        i = name + 1
        while i < last and self.s(i) != "=":
            i = self.close.get(i, i) + 1
        value = self.s(i + 1)
        arrow = any(self.t[k][0] == "arrow" for k in range(i, min(i + 4, last))) or (value == "(" and i + 1 in self.close and self._arrow_after(self.close[i + 1], last))
        function = value == "function" or arrow or (value == "async" and self.s(i + 2) in ("function", "(")) or value == "async"
        self.add(self.s(name), "function" if function else "variable", first, last, exported)
        if top and value == "(":
            self.called_at_once(i + 1, last)

    def _arrow_after(self, i: int, last: int) -> bool:
        i += 1
        if self.s(i) == ":":
            while i < last and self.t[i][0] != "arrow" and self.s(i) not in ("{", ";"):
                i = self.close.get(i, i) + 1
        return i <= last and self.t[min(i, len(self.t) - 1)][0] == "arrow"

    def called_at_once(self, i: int, end: int) -> None:
        i += self.s(i) in ("!", "void")
        inner = i + 1 if self.s(i) == "(" else i
        k = inner
        while k < end and self.s(k) in ("async", "function", "*"):
            k += 1
        k += self.t[min(k, len(self.t) - 1)][0] == "name"
        if self.s(k) != "(" or k not in self.close:
            return
        k = self.close[k] + 1
        k += self.t[min(k, len(self.t) - 1)][0] == "arrow"
        if self.s(k) == "{" and k in self.close:
            self.scan(k + 1, self.close[k], False)

    def methods(self, i: int, last: int, exported: bool) -> None:
        while i < last and self.s(i) != "{":
            i = self.close.get(i, i) + 1
        i += 1
        while i < last:
            first = i
            while self.s(i) in ("public", "private", "protected", "static", "async", "readonly", "override", "abstract", "get", "set", "*") and self.s(i + 1) not in "(=;:":
                i += 1
            name = self.s(i)
            k = i + 1
            if self.s(k) == "<":
                while k < last and self.s(k) != "(":
                    k += 1
            if self.t[i][0] == "name" and self.s(k) == "(" and k in self.close:
                end = self.body(self.close[k] + 1, last)
                if self.s(end) == "}":
                    hidden = name.startswith(("_", "#")) or "private" in [self.s(x) for x in range(first, i)]
                    self.add(name, "method", first, end, exported and not hidden)
                i = end + 1
            else:
                i = self.statement(i, last) + 1

    def imports(self) -> list[tuple[str, int]]:
        out = []
        for i, (kind, s, _, line) in enumerate(self.t):
            if kind != "string" or s[0] == "`":
                continue
            before, two = self.s(i - 1) if i else "", self.s(i - 2) if i > 1 else ""
            if before in ("from", "import") or (before == "(" and two in ("require", "import")):
                out.append((s[1:-1], line))
        return out


def extract(text: str) -> dict:
    """Symbols, imports and parse errors (0 or 1: brackets that don't match)."""
    reader = _Reader(text)
    if reader.t:
        reader.scan(0, len(reader.t), True)
    symbols = sorted(set(reader.symbols), key=lambda x: (x[2], -x[3]))
    return {"symbols": symbols, "imports": reader.imports(), "errors": reader.errors}


def scaffold(text: str, ranges: list[tuple[int, int, int]]) -> str:
    """``text`` with the bodies of what each range (start, end, step) declares replaced by placeholders.

    A range is whole lines; of ranges inside each other the outer one counts, of equal ones the first.  A range that cuts
    through a bracket, a comment or a template stays, and so does a text whose brackets don't match, before or after;
    no character outside the bodies changes.
    """
    reader = _Reader(text)
    if reader.errors:
        return text
    finder = Finder(reader)
    opener = {c: o for o, c in reader.close.items()}
    spread = [(x[3], x[3] + x[1].count("\n")) for x in (*reader.t, *reader.comments.values()) if "\n" in x[1]]
    lines = [x[3] for x in reader.t]
    edits: list[tuple[Body, int]] = []
    for start, end, step in ranges:
        a, b = bisect_left(lines, start), bisect_left(lines, end + 1)
        if any(lo < start <= hi or lo <= end < hi for lo, hi in spread) or any(not a <= reader.close.get(k, opener.get(k, a)) < b for k in range(a, b)):
            continue
        edits += [(body, step) for body in finder.statements(a, b)]
    out, at = [], 0
    for body, step in sorted(edits, key=lambda e: (e[0].first, -e[0].last)):
        if body.first >= at:
            out += [text[at : body.first], placeholder(body, step)]
            at = body.last
    done = "".join([*out, text[at:]])
    return text if _Reader(done).errors else done
