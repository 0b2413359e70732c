"""Which part of a JavaScript or TypeScript declaration is its body.

Works on a file's tokens and their matched brackets.  A body is a block, the members of a class or object, an arrow's
expression, a list of records, a template's text or the shape of a type.  Only what is inside nothing but parentheses can
be one: never a type argument, an annotation, a default parameter or a member of something bigger.
"""

from __future__ import annotations

from typing import NamedTuple

MODIFIERS = frozenset("export default declare async abstract public private protected static readonly override accessor".split())
#: Declarations whose body is their block, and what may stand before a brace that opens a type.
BLOCKS = frozenset("function class interface enum namespace module".split())
TYPE_BEFORE = frozenset(": | & is as extends implements satisfies keyof infer".split())
#: Marks that no type argument holds outside brackets, so that a ``<`` before them compares.
NOT_TYPES = frozenset("; + - * / % ! ^ ~ @".split())


class Body(NamedTuple):
    """Characters ``first`` to ``last`` go.  ``kind``: block, members, expression, template, union."""

    first: int
    last: int
    kind: str


class Finder:
    """Finds the bodies of the declarations between two tokens of a reader (``t``, ``s``, ``close``)."""

    def __init__(self, reader) -> None:  # noqa: ANN001
        self.r = reader
        self.t, self.s, self.close = reader.t, reader.s, reader.close

    def begin(self, i: int) -> int:
        return self.t[i][2]

    def end(self, i: int) -> int:
        return self.t[i][2] + len(self.t[i][1])

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "name"

    def angle(self, i: int) -> int | None:
        """The ``>`` that closes type arguments opened at i; none if i compares."""
        deep, k = 0, i
        while k < len(self.t):
            s = self.s(k)
            if self.t[k][0] == "mark":
                if s == "<":
                    deep += 1
                elif s == ">":
                    deep -= 1
                    if not deep:
                        return k
                elif s in ")]}" or s in NOT_TYPES or (s in "&|" and self.s(k + 1) == s):
                    return None
            k = self.close.get(k, k) + 1
        return None

    def after(self, i: int) -> int:
        """The token after i and whatever bracket or type argument opens there."""
        if i in self.close:
            return self.close[i] + 1
        if self.s(i) == "<" and self.t[i][0] == "mark" and (i == 0 or self.is_name(i - 1) or self.s(i - 1) in ("=", "(", ",")):
            stop = self.angle(i)
            if stop is not None:
                return stop + 1
        return i + 1

    def level(self, i: int, end: int):  # noqa: ANN201
        """Tokens from i on that no bracket or type argument holds, openers included."""
        while i < end:
            yield i
            i = self.after(i)

    def pair(self, i: int, kind: str) -> Body | None:
        """The inside of a pair, unless it is empty."""
        return Body(self.end(i), self.begin(self.close[i]), kind) if i in self.close and self.close[i] > i + 1 else None

    def assigned(self, i: int, end: int) -> int | None:
        """The first ``=`` that assigns."""
        for k in self.level(i, end):
            if self.s(k) == "=" and self.t[k][0] == "mark" and self.s(k + 1) != "=" and (k == 0 or self.s(k - 1) not in ("=", "!", "<", ">") or self.begin(k) > self.end(k - 1)):
                return k
        return None

    def head(self, i: int) -> int:
        """The token after decorators and modifiers."""
        while True:
            if self.s(i) == "@":
                i += 2
                while self.s(i) in (".", "("):
                    i = self.after(i) + (self.s(i) == ".")
            elif self.s(i) in MODIFIERS and self.is_name(i) and self.s(i + 1) not in ("(", "=", ":", ";"):
                i += 1
            else:
                return i

    def function(self, i: int, end: int) -> tuple[Body | None, int]:
        """The block of a function from its parameters or type parameters on, and the token after it."""
        while i < end and self.s(i) != "(":
            i = self.after(i)
        i = self.after(i)
        for k in self.level(i, end):
            if self.s(k) == "{" and self.s(k - 1) not in TYPE_BEFORE and self.t[k - 1][0] != "arrow":
                return self.pair(k, "block"), self.close.get(k, k) + 1
            if self.s(k) == ";":
                return None, k + 1
        return None, end

    def members(self, i: int, end: int) -> tuple[Body | None, int]:
        """The members of a class, an interface or the like, and the token after them."""
        for k in self.level(i, end):
            if self.s(k) == "{":
                return self.pair(k, "members"), self.close.get(k, k) + 1
            if self.s(k) == ";":
                return None, k + 1
        return None, end

    def value(self, i: int, end: int) -> Body | None:
        """What of an expression is its body: the shallowest, the biggest of these, the first."""
        found: list[tuple[int, Body]] = []
        spare: list[tuple[int, Body]] = []
        self._value(i, end, 0, found, spare)
        best = min(found or spare, key=lambda x: (x[0], x[1].first - x[1].last, x[1].first), default=None)
        return best[1] if best else None

    def _value(self, i: int, end: int, depth: int, found: list, spare: list) -> None:
        asked = 0  # conditionals whose colon is to come
        while i < end:
            kind, s = self.t[i][0], self.s(i)
            if kind == "arrow":
                if self.s(i + 1) == "{":
                    i += 1
                    found += [(depth, b)] if (b := self.pair(i, "block")) else []
                    i = self.close.get(i, i) + 1
                    continue
                stop = next((k for k in self.level(i + 1, end) if self.s(k) in (",", ";") and self.t[k][0] == "mark"), end)
                if not asked and stop > i + 1:
                    found.append((depth, Body(self.end(i), self.end(stop - 1), "expression")))
                elif asked:
                    i += 1
                    continue
                i = stop
            elif kind == "name" and s == "function" and self.s(i - 1) != ".":
                body, i = self.function(i + 1, end)
                found += [(depth, body)] if body else []
            elif kind == "name" and s == "class" and self.s(i - 1) != ".":
                body, i = self.members(i + 1, end)
                found += [(depth, body)] if body else []
            elif s == "(" and i in self.close:
                arrow = self._arrow(self.close[i] + 1, end, asked)
                if arrow is None:
                    self._value(i + 1, self.close[i], depth + 1, found, spare)
                i = self.close[i] + 1 if arrow is None else arrow
            elif s == "{" and i in self.close:
                if self.s(i - 1) not in ("as", "satisfies") and (b := self.pair(i, "members")):
                    found.append((depth, b))
                i = self.close[i] + 1
            elif s == "[" and i in self.close:
                if any(self.s(k) == "{" for k in self.level(i + 1, self.close[i])):
                    spare.append((depth, self.pair(i, "members")))
                i = self.close[i] + 1
            elif kind == "string" and s[0] == "`":
                spare += [(depth, Body(self.begin(i) + 1, self.end(i) - 1, "template"))] if len(s) > 2 else []
                i += 1
            else:
                if kind == "mark" and s == "?" and self.s(i + 1) not in (".", "?") and self.s(i - 1) != "?":
                    asked += 1
                elif kind == "mark" and s == ":":
                    asked = max(asked - 1, 0)
                i = self.after(i)

    def _arrow(self, i: int, end: int, asked: int) -> int | None:
        """The arrow that makes the parentheses before i parameters, a return type between or not."""
        if i < end and self.t[i][0] == "arrow":
            return i
        if i < end and self.s(i) == ":" and not asked:
            for k in self.level(i + 1, end):
                if self.t[k][0] == "arrow":
                    return k
                if self.s(k) in (",", ";", "=", "?"):
                    return None
        return None

    def variable(self, i: int, end: int) -> list[Body]:
        """The body of each declarator's value; failing all, the shape that annotates the first."""
        commas = [k for k in self.level(i, end) if self.s(k) == "," and self.t[k][0] == "mark"]
        out = []
        for a, b in zip([i, *[k + 1 for k in commas]], [*commas, end]):
            at = self.assigned(a, b)
            body = self.value(at + 1, b) if at is not None else None
            if body is None and a == i and at is not None:
                body = next((p for k in self.level(a, at) if self.s(k) == "{" and k > a and (p := self.pair(k, "members"))), None)
            out += [body] if body else []
        return out

    def alias(self, i: int, end: int) -> Body | None:
        """The shape of a type: the braces and all that is joined to them, the result of a function, a pair in a generic."""
        at = self.assigned(i, end)
        if at is None:
            return None
        stop = end - (self.s(end - 1) == ";")
        tops = list(self.level(at + 1, stop))
        asks = any(self.s(k) == "?" for k in tops)
        arrow = next((k for k in tops if self.t[k][0] == "arrow"), None)
        brace = next((k for k in tops if self.s(k) == "{" and (arrow is None or k < arrow)), None)
        if brace is not None:
            return self.pair(brace, "members") if asks else Body(self.begin(brace), self.end(stop - 1), "union")
        if arrow is not None and not asks and stop > arrow + 1:
            return Body(self.begin(arrow + 1), self.end(stop - 1), "union")
        if asks:
            return None
        for k in range(at + 1, stop):  # in parentheses or a generic: that pair alone
            if self.s(k) == "{" and (p := self.pair(k, "members")):
                return p
        return None

    def statements(self, i: int, end: int) -> list[Body]:
        """The bodies of all declarations from i on; a first statement that declares nothing has one as well."""
        out: list[Body] = []
        first = True
        while i < end:
            start = i
            k = self.head(i)
            word = self.s(k)
            if word in BLOCKS and self.t[k][0] == "name" and (self.is_name(k + 1) or self.s(k + 1) in ("{", "(", "*", "<")) and not (word in ("module", "namespace") and self.s(k + 1) in ("(", ".", "=")):
                body, i = (self.function if word == "function" else self.members)(k + 1, end)
                out += [body] if body else []
            elif word in ("const", "let", "var") and not (word == "const" and self.s(k + 1) == "enum"):
                i = self.r.statement(k + 1, end) + 1
                out += self.variable(k + 1, i - (self.s(i - 1) == ";"))
            elif word == "const":
                body, i = self.members(k + 2, end)
                out += [body] if body else []
            elif word == "type" and self.is_name(k + 1) and self.s(k + 2) in ("=", "<"):
                i = self.r.statement(k + 1, end) + 1
                out += [b for b in [self.alias(k + 2, i)] if b]
            elif (method := self._method(k, end)) is not None:
                body, i = method
                out += [body] if body else []
            else:
                i = self.r.statement(k, end) + 1
                stop = i - (self.s(i - 1) == ";")
                at = self.assigned(k, stop)
                if first or (at is not None and at <= k + 1 and self.is_name(k)):
                    out += [b for b in [self.value(k if at is None else at + 1, stop)] if b]
            i = max(i, start + 1)
            first = False
        return out

    def _method(self, k: int, end: int) -> tuple[Body | None, int] | None:
        """A method's block, if a method begins at k."""
        while self.s(k) in ("get", "set", "*") and self.s(k + 1) not in ("(", "=", ":", ";"):
            k += 1
        if not (self.is_name(k) or self.s(k) == "[") or self.s(k) in ("if", "for", "while", "switch", "with", "catch", "return", "await", "super"):
            return None
        i = self.after(k)
        i = self.after(i) if self.s(i) == "<" else i
        if self.s(i) != "(" or i not in self.close:
            return None
        after = self.close[i] + 1
        if self.s(after) not in ("{", ":"):
            return None
        return self.function(i, end)


def placeholder(body: Body, step: int) -> str:
    """What takes a body's place: it parses where the body did, and names the step."""
    return {
        "block": f' throw new Error("step {step}"); ', "members": f" /* step {step} */ ", "expression": f' {{ throw new Error("step {step}"); }}',
        "template": f"step {step}", "union": f"{{ /* step {step} */ }}",
    }[body.kind]
