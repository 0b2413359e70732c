"""Scaffolds: which part of a declaration goes, and that nothing else changes."""

import ast
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline import source_queries
from treeline.extract import api, javascript, python
from treeline.queries import QUERIES

THROW = ' throw new Error("step 1"); '
#: A declaration with what is its body between « and », and what stands there afterwards.
FORMS = [
    ("function f(a = {}, { b }) {« return a + b; »}", THROW), ("export default async function* f() {« yield 1; »}", THROW), ("function f(): { a: number } {« return x; »}", THROW),
    ("function f(x): x is { a: number } {« return x; »}", THROW), ("class A extends B<{ x: 1 }> {« y = 2; »}", " /* step 1 */ "), ("@Register({ tag: 'a' })\nclass A {« y = 2; »}", " /* step 1 */ "),
    ("export interface I<T extends { a: 1 }> {« b: T »}", " /* step 1 */ "), ("declare enum E {« A, B »}", " /* step 1 */ "), ("const enum E {« A = 1 »}", " /* step 1 */ "), ("namespace N {« export const x = 1; »}", " /* step 1 */ "),
    ("const f = (a) => {« return a; »};", THROW), ("const f = async (a) =>« a * 2»;", ' { throw new Error("step 1"); }'), ("const f = (raw: string): { ok: boolean } =>« JSON.parse(raw)»;", ' { throw new Error("step 1"); }'),
    ("const f: (n: number) => number = (n) =>« n * 2»;", ' { throw new Error("step 1"); }'), ("const n = (function () {« return 25; »})();", THROW), ("var N = B.Model.extend({« a: 1, b: { c: 2 } »});", " /* step 1 */ "),
    ("const s = create<{ n: number; inc: () => void }>()((set) =>« ({ n: 0 })»);", ' { throw new Error("step 1"); }'), ("const c = useCallback<(e: Event) => void>((e) => {« e.stop(); »}, []);", THROW),
    ("var h = route({ auth: true }, function (req) {« const { user } = req; return user.name; »});", THROW), ("const l = strict ? {« max: 10, min: 1 »} : { max: 2 };", " /* step 1 */ "),
    ("const rows: { id: string }[] = [« { id: 'a' }, { id: 'b' } »];", " /* step 1 */ "), ("const d = [1, 2].map((n) =>« n * 2»);", ' { throw new Error("step 1"); }'), ("const q = `«select ${a} from b»`;", "step 1"),
    ("let memo: {« a: number »} | null = null;", " /* step 1 */ "), ("type T = Readonly<{« a: string »}>;", " /* step 1 */ "), ("type S =\n  | «{ a: 1 }\n  | { b: 2 }»;", "{ /* step 1 */ }"),
    ("type G = «{ open: false } | ({ open: true } & R)»;", "{ /* step 1 */ }"), ("type R = <T extends { [k: string]: unknown }>(v: T) => «Promise<T>»;", "{ /* step 1 */ }"), ("type U<T> = T extends P<infer U> ? {« value: U »} : { value: T };", " /* step 1 */ "),
    ("const B = forwardRef<El, Props>(({ a, ...rest }, ref) =>« <button className={cn(a)} ref={ref} {...rest}>It's 1) {a && <b>'</b>}</button>»);", ' { throw new Error("step 1"); }'),
    ("export function Help({ url }) {« return <p title=\"a\n b\">{url && <a href={url}>https://x.y/</a>} or it's</p>; »}", THROW), ("(function () {« var a = 1; »}).call(this);", THROW), ("module.exports = {« a, b »};", " /* step 1 */ "),
    ("const r = /[/'`{]/.test(a) ? 1 : ((b) =>« b / 2 / 3»)(4);", ' { throw new Error("step 1"); }'), ("const f = function* named(a = `}`) {« yield '}'; »};", THROW), ("const K = class extends B {« m() { return 1; } »};", " /* step 1 */ "),
]
ALONE = ["const x = {};", "const x = [1, 2];", "const x = a < b;", "const t = c ? () => a : b;", "type I<T> = T extends (x: infer I) => R ? A : B;", "function over(a): void;", "let y;", "const n = 1, m = n << 2;"]


@pytest.mark.parametrize("form, new", FORMS)
def test_forms(form, new):
    head, rest = form.split("«")
    body, tail = rest.split("»")
    text = head + body + tail
    before, after = "const keep = { a: 1 };\n", "\nfunction kept() { return `${1}`; }\n"
    want = before + head + new + tail + after
    last = 2 + text.count("\n")
    assert javascript.scaffold(before + text + after, [(2, last, 1)]) == want
    assert javascript.extract(want)["errors"] == 0


@pytest.mark.parametrize("text", ALONE)
def test_left_alone(text):
    assert javascript.scaffold(text, [(1, 1, 1)]) == text


def test_members_of_a_class():
    text = "class A {\n  get x(): number { return 1; }\n  static async *go<T>(a = {}) {\n    yield a;\n  }\n  on = (e) => e.x;\n  if (a) { }\n}\n"
    got = javascript.scaffold(text, [(2, 2, 1), (3, 5, 2), (6, 6, 3)])
    assert got == 'class A {\n  get x(): number { throw new Error("step 1"); }\n  static async *go<T>(a = {}) { throw new Error("step 2"); }\n  on = (e) => { throw new Error("step 3"); };\n  if (a) { }\n}\n'


def test_declarations_of_one_line_and_nested_ranges():
    line = "var a = 1, f = () => 2, g = function () { return 3; }; function h() { return 4; } use(h); k = { b: 5 };\n"
    got = javascript.scaffold(line, [(1, 1, 1), (1, 1, 2)])
    assert got.count("step 1") == 4 and "step 2" not in got and "use(h);" in got
    nested = "function f() {\n  function g() { return 1; }\n}\n"
    assert javascript.scaffold(nested, [(2, 2, 2), (1, 3, 1)]) == 'function f() { throw new Error("step 1"); }\n'


@pytest.mark.parametrize("text, spans", [("f({\n  a: 1\n});\n", [(1, 2, 1)]), ("const t = `a\n{ b`; function g() { return 1 }\n", [(2, 2, 1)]), ("/* a\n */ function g() { return 1 }\n", [(2, 2, 1)]), ("function broken( {\n", [(1, 1, 1)]), ("", [(1, 1, 1)])])
def test_what_isnt_understood_stays(text, spans):
    assert javascript.scaffold(text, spans) == text


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 2**32), st.text("{}()[]<>=`'\"/;:,?|& \nab", max_size=40))
def test_any_mix_parses_and_keeps_what_is_outside(seed, noise):
    rng = random.Random(seed)
    parts = [rng.choice(FORMS)[0].replace("«", "").replace("»", "") for _ in range(5)]
    text, ranges, line = "", [], 1
    for i, p in enumerate(parts):
        ranges.append((line, line + p.count("\n"), i))
        text += p + "\n"
        line += p.count("\n") + 1
    some = [r for r in ranges if rng.random() < 0.6]
    got = javascript.scaffold(text, some)
    assert javascript.extract(got)["errors"] == 0 and javascript.scaffold(text, []) == text
    kept = [p for r, p in zip(ranges, parts) if r not in some]
    assert all(p in got for p in kept) and got.count("step ") >= len(some)
    javascript.scaffold(noise + text, [(1, 3, 1)])  # never fails


@pytest.mark.parametrize(
    "text, spans, want",
    [
        ("def f(a: dict = {}): return a  # note\n", [(1, 1, 7)], 'def f(a: dict = {}): raise NotImplementedError("step 7")  # note\n'),
        ("@d\ndef f():\n    'doc'\n    @e\n    def g(): pass\n    return g\n# end\n", [(1, 6, 7)], "@d\ndef f():\n    'doc'\n    raise NotImplementedError(\"step 7\")\n# end\n"),
        ("class A:\r\n\tx = 'é'; y = 2\r\n\r\nz = 1\r\n", [(1, 2, 3)], 'class A:\r\n\traise NotImplementedError("step 3")\r\n\r\nz = 1\r\n'),
        ("def f():\n    x = '''a\x0cb\u2028'''\n    return x\ny = 1", [(1, 3, 3)], 'def f():\n    raise NotImplementedError("step 3")\ny = 1'),
        ("async def f():\n    def g():\n        return 1\n    return g", [(2, 3, 2), (1, 4, 1)], 'async def f():\n    raise NotImplementedError("step 1")'),
        ("def f():\n    'only a docstring'\n", [(1, 2, 1)], "def f():\n    'only a docstring'\n"), ("x = 1\n", [(1, 1, 1)], "x = 1\n"), ("def (:\n", [(1, 1, 1)], "def (:\n"),
    ],
)
def test_python(text, spans, want):
    got = python.scaffold(text, spans)
    assert got == want
    if text != "def (:\n":
        ast.parse(got)


def test_files(spark):
    rows = [("a.ts", "typescript", "function f() { return 1; }\n", [(1, 1, 3)]), ("b.py", "python", "def f(): pass\n", [(1, 1, 4)]), ("c.py", "python", None, [(1, 1, 1)]), ("d.js", "javascript", "x", None)]
    df = spark.createDataFrame(rows, "path string, language string, text string, ranges array<struct<start:int,end:int,step:int>>")
    got = {r["path"]: r["text"] for r in api.scaffolds(df).collect()}
    assert got == {"a.ts": 'function f() { throw new Error("step 3"); }\n', "b.py": 'def f(): raise NotImplementedError("step 4")\n', "c.py": "", "d.js": "x"}


def test_query_covers_every_form(spark, sf):
    got = source_queries.scaffold_forms(spark, sf)
    assert QUERIES["scaffold_forms"] is source_queries.scaffold_forms
    assert got.filter("changed = 0").count() == 0 and got.select("form").distinct().count() == 12
