import ast
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeprism.llm.syntax import files, hosted

GOOD = {
    "typescript": [
        "", "\ufeff#!/usr/bin/env node\nconst a = 1;", "import { a } from 'x'\nfoo(a, ...b)\n", "export async function f(a: string, b?: T[]): Promise<Map<string, A[]>> { return a ?? b }",
        "class A extends B { static x = 1; async foo(a, b) { return a } get y() { return 1 } constructor(private a: T) { super() } }", "if (a) b(); else c();", "try { a() } catch (e) { b() } finally {}",
        "switch (a) { case 1: b(); break; default: c() }", '!function(a){b(a,"x")}(c);var a=b&&c.d(1)||{};if(a>1){b=c}else{b=!1}for(var i=0;i<5;i++)a[i]=b^i;', 'let x = /[)}\\[]5/.test("x") ? a : b',
        "export type A = B | C | null;\nexport interface D { a: B; b?: C }", "`a ${b} } c`", "label: for (;;) { break label }", "enum A { B, C = 1 }", "// <<<<<<< old\nf(1) // }", "type X<T> = T extends U ? V : W", "const f = <T>(x: T) => x",
    ],
    "go": ["package a\n", 'package a\nimport "x"\n\nvar A = []int{1, 2,\n 3}\nfunc (s *T) F(a int, b []string) (any, error) {\n\tif x, err := g(a); err != nil {\n\t\treturn x, err\n\t}\n\tfor _, i := range b {\n\t\ti.f("}")\n\t}\n\tswitch g(a) {\n\tcase 1:\n\t\ta.b()\n\tdefault:\n\t}\n\tdefer f()\n\tm := map[string]int{"a": 1}\n\t_ = m\n\treturn T{a: 1}, nil\n}\n', "package a\ntype S struct {\n\tA int `json:\"a\"`\n}\ntype I interface {\n\tM(a int) string\n}\n", "// only\n"],
    "rust": ["", "use a::{b, c};\n", "pub fn f(a: &str, b: Vec<Option<T>>) -> R {\n    let c = '{'; g(a);\n    for i in x(a) { i.y(); }\n    match g(a) {\n        1 => a.b(\"x\"),\n        _ => {}\n    }\n    if a.is_none() { return h(\"s\"); }\n    c\n}\n", "impl<'a, T: X> A for B<T> where T: Y { fn f(&self) -> u8 { 1 } }", "#[derive(Debug)]\npub struct S { a: u8, pub b: Vec<String> }\nenum E { A, B(u8), C { x: i32 } }\nconst X: &[i32] = &[1, 2];\npub static Y: [i32; 2] = [1, 2];"],
    "java": ["package a.record;\nimport b.*;\npublic class A<T> extends B implements C, D {\n    static final int[] X = {1, 2};\n    @Override public Object f(int a, List<String> b) throws E {\n        char c = '{'; g(a);\n        for (var i : h(b)) { i.x(); }\n        while (g(a) < 3) { a++; }\n        if (a == null) { return k(\"}\"); } else { m(x -> x + 1); }\n        try { f(); } catch (E e) { } finally { }\n        return new A<>(a) { };\n    }\n}\n", "enum E { A, B(1) { }; int x; }", "interface I { int f(); default void g() { } }", "// c\npackage a;\n"],
    "python": ["", "\ufeffdef f(a, *b, c=1):\n    return [x for x in a]\n", "async def f():\n    await g()\n"],
    "json": ["", "{}", '{"a": [1, 2.5e3, null, true, "\\u00e9"]}\n', "\ufeff[]"],
}
BAD = {
    "typescript": ["const a =", "package corp.x;\nimport corp.*;", "import { a } fro", "<<<<<<< HEAD\nconst a = 1;\n=======\n", "The indexer writes the rows", "function f(a) {", "return x;\n}", "def f(a):\n  return 1", "<!doctype html>\n<html>", '{"a": [1]}', "+++ b/x\n@@ -1,2 +3,4 @@\n-const a", "use crate::a;\n", "func a(b int) any {\n}", "pub fn a(b: C) -> D {}", "public class A {}", "const x = 'abc", "/* abc", "f(a]"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nclass A {}\n", 'package a\nvar x = "abc\n', "package corp.x;\n", "use a::b;\n", "package a\n<<<<<<< HEAD\nvar a = 1\n"],
    "rust": ["fn f( {}", "package a\n", "const a = 1;\nlet b = 2;", "fn f() { /* }", "class A {}", "import a\n", "fn f() { g(1)) }", "The walker reads."],
    "java": ["class A {", "package a\n", "class A { void f( { } }", "pub fn f() {}", "def f():\n  pass", 'class A { String s = "x; }', "class A { int f() { return 1 } }"],
    "python": ["def f(:\n  pass", "const a = 1;", "<<<<<<< HEAD\n", "'''open", "  x = 1"],
    "json": ["{", "[1,]", "{'a': 1}", "NaN", "[1] 2", "<html>"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_valid(lang):
    for t in GOOD[lang]:
        assert files.valid(lang, t), t
        assert files.valid(lang, t.replace("\n", "\r\n")), t


@pytest.mark.parametrize("lang", BAD)
def test_invalid(lang):
    for t in BAD[lang]:
        assert not files.valid(lang, t), t


def test_cut_files_are_invalid():
    rnd = random.Random(3)
    for lang in ("go", "rust", "java"):
        text = max(GOOD[lang], key=len)
        opened = [i for i in range(len(text)) if text[:i].count("{") > text[:i].count("}") + 1]
        for i in rnd.sample(opened, 10):
            assert not files.valid(lang, text[:i])


def test_pieces_reduce_to_the_whole():
    rnd = random.Random(1)
    for lang in ("typescript", "go", "rust", "java"):
        g = files.grammar(lang)
        for t in GOOD[lang] + BAD[lang]:
            t = files.LEAD.sub("", t, count=1)
            lines = t.splitlines(True) or [""]
            maps = [g.piece(x) for x in lines]
            while len(maps) > 1:
                i = rnd.randrange(len(maps) - 1)  # in any grouping
                maps[i : i + 2] = [g.joined(maps[i], maps[i + 1])]
            assert g.whole(*maps[0][""]) == g.valid(t), t


AWKWARD = [
    "const s = 'abc\\\ndef';\nf(1);\n",
    "const t = `a ${\n b +\n c\n} d\n e`;\nlet x = `p ${ q ? `r ${\n s('}')\n}` : '`' } t`;\n",
    "/* a\n { b */ f(/[}]/,\n 'c');\nconst r = a /\n b / c;\n",
    "const s = `x ${\n const ) } y`;\n",
]
RAW = ['fn f() {\n    let a = r#"x\n { " y\n"#;\n    g(a);\n}\n', 'const A: &str = "b\n c";\n/* d /* e */\n } */\nfn f() {}\n', 'fn f() {\n    let a = r#"x\n";\n']


def test_files_cut_at_every_line_have_the_verdict_of_the_whole():
    rnd = random.Random(2)
    cases = [("typescript", t) for t in GOOD["typescript"] + BAD["typescript"] + AWKWARD] + [("rust", t) for t in GOOD["rust"] + BAD["rust"] + RAW] + [(x, t) for x in ("go", "java", "json") for t in GOOD[x] + BAD[x]]
    for lang, text in cases:
        g = files.grammar(lang)
        parts = files.cut(lang, files.plain(lang, text), 1)
        assert "".join(parts) == files.plain(lang, text)
        maps = [g.piece(x) for x in parts]
        while len(maps) > 1:
            i = rnd.randrange(len(maps) - 1)
            maps[i : i + 2] = [g.joined(maps[i], maps[i + 1])]
        assert g.whole(*maps[0][""]) == files.valid(lang, text), text
    assert len(files.cut("typescript", AWKWARD[1], 1)) == 3 and len(files.cut("rust", RAW[0], 1)) > 2


@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.integers() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12), st.data())
@settings(max_examples=150, deadline=None)
def test_json_agrees_with_the_host(value, data):
    text = json.dumps(value, ensure_ascii=data.draw(st.booleans()), indent=data.draw(st.sampled_from([None, 1])))
    assert files.valid("json", text)
    at = data.draw(st.integers(0, len(text)))
    text = text[:at] + data.draw(st.sampled_from(["", ",", "]", "{", '"', "1", "x"])) + text[at + data.draw(st.integers(0, 1)) :]
    if text.strip():
        try:
            json.loads(text, parse_constant=lambda _: 1 / 0)
            want = True
        except (ValueError, ZeroDivisionError):
            want = False
        assert files.valid("json", text) == want, text


def test_deep_json():
    assert files.valid("json", "[" * 100_000 + "]" * 100_000) and not files.valid("json", "[" * 100_000)


ELEMENTS = [
    'const a = <div className="x">hello world</div>;',
    "export default function A(p: P) {\n  return (\n    <ul {...p} onClick={() => go(1)}>\n      {xs.map((x) => <li key={x}>it's {x} &amp; more</li>)}\n      <B.C />\n      {/* none */}\n    </ul>\n  );\n}\n",
    "const b = <></>;\nconst c = x ? <A/> : <B y=\"1\" z='2'/>;",
    'const f = (a: number) => a < 3 && b > 4;\nlet s = "</div>";',
    "const g = <T,>(x: T) => x;",
]
NO_ELEMENTS = ["const a = <div>hello</span>;", "const a = <div a={}>x</div>;", "const a = <div>{x y}</div>;", "const a = <div>;", "<!doctype html>\n<html></html>"]


def test_elements_in_scripts():
    for t in ELEMENTS:
        assert files.valid("tsx", t), t
    for t in NO_ELEMENTS:
        assert not files.valid("tsx", t), t


def test_what_stands_in_a_template_is_parsed():
    assert files.valid("typescript", "const s = `a ${b ? `c ${d.e(\"}\")} f` : `${g}`} h`;") and files.valid("typescript", "type A = `${B}-${C}`;")
    assert not files.valid("typescript", "const s = `x ${ const ) } y`;") and not files.valid("typescript", "const s = `x ${ } y`;")


def test_python_agrees_with_the_host():
    for t in GOOD["python"] + ["nonlocal x", "def f(a, a): pass", "return 1", "x = yield"]:
        try:
            ast.parse(t.lstrip("\ufeff"))
            want = True
        except SyntaxError:
            want = False
        assert hosted.python_valid(t.lstrip("\ufeff")) == want, t


def test_operator(spark):
    langs = spark.createDataFrame([("typescript", [".ts"]), ("python", [".py"]), ("json", [".json"])], "lang_id string, extensions array<string>")
    long = "const a = [1, 2];\n" * 400
    rows = [(1, "/p", "/p/a.ts", "const a = ;", 1), (1, "/p", "/p/a.ts", "const a = ;", 1), (2, "/p", "/p/b.PY", "x = 1", 1), (3, "/p", "/p/c.txt", "(((", 1), (4, None, "/p/d.json", None, 1), (5, None, None, "x", 1), (6, None, "/p/e.ts", "", 1), (7, "/p", "/p/f.ts", long, 1), (8, "/p", "/p/g.ts", long + "f(", 1), (9, "/p", "/p/h.ts", "/*\n" + long + "*/ f()", 1)]
    df = spark.createDataFrame(rows, "file_id long, project_root string, path string, content string, language int")
    got = {r["file_id"]: r["valid"] for r in files.verdicts(df, langs, long=2000).collect()}
    assert got == {1: False, 2: True, 6: True, 7: True, 8: False, 9: True}
    assert {r[0] for r in files.invalid_files(df, langs).collect()} == {1, 8}
    assert [(r["language"], r["files"], r["invalid"]) for r in files.rates(df, langs).where("project_root = '/p'").orderBy("language").collect()] == [("python", 1, 0), ("typescript", 4, 2)]
    assert files.invalid_files(df.limit(0), langs).count() == 0
