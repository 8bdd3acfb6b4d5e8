import pytest

from codeprism.llm import clusters, documented, generated, prose, residue

LANGS = [("typescript", [".ts"]), ("javascript", [".js"]), ("python", [".py"]), ("go", [".go"]), ("rust", [".rs"]), ("java", [".java"]), ("json", [".json"])]


@pytest.fixture(scope="module")
def languages(spark):
    return spark.createDataFrame(LANGS, "lang_id string, extensions array<string>")


SAMPLES = {
    "de": ["Die Prüfung sortiert die Treffer nach Güte, falls der Kopf nicht gelesen werden konnte."],
    "en": ["The walker trims the text at the first blank line even if the project has moved."],
    "fr": ["Le registre compte les appels de chaque nom lorsque le disque est presque plein."],
    "ja": ["索引サービスは、ディスクがほとんど一杯のときに読めないフォルダを知らせます。"],
    "zh": ["文件读取器按照得分排列命中的条目,而且不影响其他项目。"],
    "ko": ["이 모듈은 다른 사용자를 막지 않고 낡은 벡터를 새 것으로 바꿉니다."],
    "ru": ["Служба индекса пропускает файлы без изменений, если заголовок не удалось прочитать."],
}


def test_languages_of_files(spark, languages):
    en, de, fr, ru = (SAMPLES[x][0] for x in ("en", "de", "fr", "ru"))
    escaped = "".join(f"\\u{ord(c):04x}" for c in ru)
    half = len(en) // 2
    rows = [
        (1, "/a.ts", f"// {en[:40]}\n// {en[40:]}\nf();\n"),
        (2, "/b.py", f'def f():\n    """{de}"""\n    return "{fr}"\n'),
        (3, "/c.js", f'f("{escaped}");'),
        (4, "/d.js", f'f("{en[:half]}" + "{en[half:]}");'),
        (5, "/e.json", '{"the walker and the text of it": 1, "a": "' + fr + '"}'),
        (6, "/f.ts", "// too few words here\nconst aLongName = otherName(thirdName);\nq(\"SELECT id FROM spans WHERE a IS NOT NULL\"); // see https://docs.example/the/and/of/to/is.html\n"),
        (7, "/g.ts", f"// {en}\nconst a = ;"),
        (8, "/h.ts", None),
        (9, "/i.go", f"package a\n\n/*\n * {SAMPLES['ja'][0]}\n */\nvar A = `{SAMPLES['zh'][0]}`\n"),
        (10, "/j.ts", ""),
    ]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "file_id long, path string, content string, lang string, n_chars int")
    samples = spark.createDataFrame([(k, t) for k, ts in SAMPLES.items() for t in ts] + [(None, "x")], "lang string, text string")
    out = prose.file_languages(df, languages, samples).collect()
    assert {(r["file_id"], r["lang"]) for r in out} == {(1, "en"), (2, "de"), (2, "fr"), (3, "ru"), (4, "en"), (5, "fr"), (9, "ja"), (9, "zh")}
    assert len(out) == 8 and all(0 < r["share"] <= 1 for r in out)
    assert prose.file_languages(df.limit(0), languages, samples).count() == 0


def test_generated_vendored_minified_and_data(spark, languages):
    own = "\n".join(f"export function f{'abcdefghij'[i]}Name(rows) {{\n  const part{i} = other(rows, {i * 37 + 5});\n  for (const x of rows) {{\n    x.call(part{i}, \"{i}key\");\n  }}\n  return make(part{i});\n}}" for i in range(8))
    lib = "\n".join(f"export function lib{'klmnopqrst'[i]}(data) {{\n  const v{i} = data.get({i * 91 + 3});\n  while (v{i} < {i}) {{\n    data.step(v{i}, \"{i}s\");\n  }}\n  return data.end({i * 7});\n}}" for i in range(8))
    mini = "".join(f"function a{i}(b,c){{return b?c({i}):b.d({i})}}if(e{i}>3){{f=g}}else{{f=!1}}" for i in range(40))
    dump = "export const D = [" + ", ".join(str(i * 7919 % 65536) for i in range(300)) + "];\n"
    rows = [
        (1, "/r1", "/r1/src/a.ts", own),
        (2, "/r1", "/r1/src/b.ts", "// @generated by tool\n" + own.replace("Name", "Other")),
        (3, "/r1", "/r1/src/c.ts", "/*\n * The client next door is auto-generated, which its header says.\n */\nexport const c = 1;"),
        (4, "/r1", "/r1/src/d.ts", lib),
        (5, "/r2", "/r2/src/e.ts", "// Part of the Core. Released under the Any Licence.\n" + own.replace("rows", "q").replace("other", "p")),
        (6, "/r2", "/r2/src/f.ts", "// Copyright Lantern Works. All rights reserved.\nexport const f = 2;"),
        (7, "/r2", "/r2/src/min.js", mini),
        (8, "/r2", "/r2/src/dump.ts", dump),
        (9, "/r2", "/r2/src/table.ts", "export const T = [1, 2, 3, 4];\n" + own.replace("part", "other").replace("make", "give").replace("37", "38").replace("other(", "third(")[:200] + "\n}\n"),
        (10, "/r2", "/r2/src/bad.ts", "// @generated by tool\nconst a = ;"),
        (11, "/r2", "/r2/lock.json", '{"lock": 1, "resolved": {"a": 1}}'),
        (12, "/r2", "/r2/settings.json", '{"lock": true, "b": [1, 2, 3]}'),
        (13, None, None, own),
        (14, "/r2", "/r2/g.ts", None),
        (15, "/r2", "/r2/h.ts", ""),
        (16, "/r3", "/r3/vendor/x/i.ts", "export const i = 1;"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows + rows[:3]], "file_id long, project_root string, path string, content string, reason string")
    catalog = spark.createDataFrame([(1, "lib.ts", "// lib v1.0\n" + lib, "x")], "item_id long, file_name string, content string, hash string")
    got = {r["file_id"]: r["reason"] for r in generated.classified(df, languages, catalog).collect()}
    assert {k: got.get(k) for k in (2, 4, 5, 7, 8, 11, 16)} == {2: "generated", 4: "vendored", 5: "vendored", 7: "minified", 8: "data", 11: "data", 16: "vendored"}
    assert not {3, 6, 9, 10, 12, 13, 14, 15} & set(got)
    assert generated.classified(df.limit(0), languages, catalog.limit(0)).count() == 0


def test_functions_with_documentation(spark, languages):
    rows = [
        ("py", "/a.py", 'def drop_edge(rows):\n    """Removes what the second pass cannot reach.\n\n    :param rows:\n    """\n    return rows\n\n# Waits for the slowest shard.\ndef second(a):\n    # not documentation of it\n    return a\n\n# far away\n\ndef third(a):\n    return a\n', None),
        ("ts", "/b.ts", "@dec()\nexport class A {\n  /** Keeps the order of the input. */\n  async keep(a: string): Promise<T> {\n    return `}` + a;\n  }\n\n  // TODO\n  other(a) {\n    return a;\n  }\n}\n", "/** The class documents itself at length here. */"),
        ("fn", "/c.ts", "export const scanRecord = (a: string) => {\n  return a;\n};\n", "/** Scans the record. */"),
        ("doc", "/d.ts", "const read = async (a) => {\n  return a;\n};\n", "// Null means that no limit applies."),
        ("go", "/e.go", "// Compares both hashes byte by byte.\nfunc (s *T) Same(a int) any {\n\treturn \"}\"\n}\n", None),
        ("rs", "/f.rs", "impl A {\n    /// Der Lauf beginnt erst, wenn die Platte frei ist.\n    #[inline]\n    pub fn start(&self) -> u8 {\n        let c = '{';\n        1\n    }\n}\n", "/// About the type only, nothing else."),
        ("java", "/g.java", "    /**\n     * 该模块会跳过没有改动的文件。\n     * @param a\n     */\n    public Object skip(int a) {\n        return \"{\";\n    }\n", None),
        ("legal", "/h.ts", "/*\n * Lantern Works, all rights reserved. Ask the platform group before you\n * share this code.\n */\nfunction legal(a) { return a }\n", None),
        ("code", "/i.ts", "// const a = other(b, 3);\n// return other(a);\nfunction disabled(a) { return a }\n", "// See above."),
        ("none", "/j.ts", None, "x"),
        ("json", "/k.json", "{}", "Words that say what it is about."),
        ("empty", "/l.ts", "", None),
        (None, "/m.ts", "/** Sorts the matches by score. */\nfunction f(a) {}\n", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:2]], "id string, path string, content string, docstring string, language string")
    got = {(r["chunk_id"], r["function_name"]) for r in documented.documented(df, languages).collect()}
    assert got == {("py", "drop_edge"), ("py", "second"), ("ts", "keep"), ("doc", "read"), ("go", "Same"), ("rs", "start"), ("java", "skip")}
    assert documented.documented(df.limit(0), languages).count() == 0


CASES = {
    "You need to enable JavaScript to run this app.": "script",
    "≡ Menu\n\nBitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.": "script",
    "404\n\nThe page /a/b does not exist or was moved. Go back to the start page.": "error",
    '{"error":{"code":403,"message":"forbidden"}}': "error",
    "# Title here\n\nblah blah blah blah blah blah blah": "filler",
    "Lorem ipsum donec velor besit aresta quonda. mollit ipsum conset viverim.": "filler",
    "TODO: write the introduction.\n\nTODO: list the limits.": "stub",
    "Titel: (hier eintragen)\nVersion: (hier eintragen)": "stub",
    "## What?\n\n<!-- describe it here -->\n\n1.\n2.\n": "stub",
    "Welcome to {{ name }}! The walker skips every file that has not changed.": "slot",
    "The walker is fast.\n\nLast changed on ${DATE} by «team».": "slot",
}
REAL = [
    None, "", "  \n\u200b", 'The viewer shows the notice "You need to enable JavaScript to run this app." only in the shell, so we test it.',
    "Use `{{name}}` in the text.\n\n```yaml\nrun: echo ${{ secrets.X }}\n```\nThe renderer replaces the rest with its stored value.", "# Error codes\n\n| code | meaning |\n|---|---|\n| 403 | access denied |\n\nThe filter drops the entries of other teams after the last page.",
    "Designers asked to drop the lorem ipsum from the mock-up, and the page now has real copy.", "who calls dropEdge", "The queue waits for the slowest shard.\n\nTODO: rename `x` once the migration is done. The walker trims the text at the blank line.",
    "```\nconst a = {b};\n```",
]


def test_texts_without_content(spark):
    rows = [(i, t, f"h{i % 3}") for i, t in enumerate([*CASES, *REAL])]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(0, rows[0][1], None, 1)], "doc_id long, text string, source string, lines int")
    got = {r["doc_id"]: r["reason"] for r in residue.without_content(df).collect()}
    assert got == {i: k for i, k in enumerate(CASES.values())}
    assert residue.without_content(df.limit(0)).count() == 0


def test_boilerplate_is_what_recurs(spark):
    df = spark.createDataFrame([(i, f"Our site menu\n\n{'word ' * (i + 3)}", "h") for i in range(20)], "doc_id long, text string, source string")
    lines = {r["line"] for r in residue.recurrent(df, "doc_id", "text", "source", 0.05, 0.002).collect()}
    assert lines == {residue.line_hash("our site menu")}


LONG = {
    "HTTP 500\n" + "".join(f"  at handle{w} (server/of{w}.js:7)\n" for w in (f"{a}{b}{a}" for a in "bcdfgh" for b in "aeiouklmnpqr")): "error",
    "\n".join(f"Feld {w}: (hier eintragen)" for w in (f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiouklmnpqr" for c in "xyz")): "stub",
    "\n".join(f"Step {w} needs cookies. Please enable cookies in the settings of {w} and load {w} again." for w in (f"{a}{b}{a}" for a in "bcdfgh" for b in "aeiou")): "script",
    "blah boo bam " * 2000: "filler",
    "Lorem ipsum donec velor besit aresta quonda mollit viverim sona. " * 400: "filler",
}


def test_long_texts_are_judged_too():
    for text, kind in LONG.items():
        assert len(text) > 1500 and residue.missing(text) == kind
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    assert residue.missing(" ".join(words * 30)) is None  # few kinds for its length, but no repeats nearby
    assert residue.missing(" | ".join(words) * 50 + " | a much longer entry than a menu has, and a plain sentence") is None


def test_long_footers_are_boilerplate(spark):
    footer = "The Lantern footer tells at length who runs this site and how it is paid for, " * 3 + "year 2024."
    df = spark.createDataFrame([(i, f"404 page not found\n\n{footer}" if i == 7 else f"Words of text {'on this ' * i}\n\n{footer}", "h") for i in range(20)], "doc_id long, text string, source string")
    assert [tuple(r) for r in residue.without_content(df).collect()] == [(7, "error")]


def test_a_star_hides_no_copies_behind_it(spark, languages):
    import re

    copied = "\n".join(f"export function lib{'klmnopqrst'[i]}(data) {{\n  const v{i} = data.get({i * 91 + 3});\n  while (v{i} < {i}) {{\n    data.step(v{i}, \"{i}s\");\n  }}\n  return data.end({i * 7});\n}}" for i in range(8))
    shape = re.sub(r"\b(lib\w|data|get|v\d|step|end)\b", r"\1Else", copied)  # of the same masked shape, with other names
    df = spark.createDataFrame([(i, f"/r{i}", f"/r{i}/src/a.ts", copied) for i in (1, 2)], "file_id long, project_root string, path string, content string")
    catalog = spark.createDataFrame([(1, "lib.ts", shape, "x")], "item_id long, file_name string, content string, hash string")
    assert {r["file_id"]: r["reason"] for r in generated.classified(df, languages, catalog).collect()} == {1: "vendored", 2: "vendored"}


def test_an_altered_copy_in_the_same_repository_is_vendored_too(spark, languages):
    lib = "\n".join(f"export function lib{'klmnopqrst'[i]}(data) {{\n  const v{i} = data.get({i * 91 + 3});\n  while (v{i} < {i}) {{\n    data.step(v{i}, \"{i}s\");\n  }}\n  return data.end({i * 7});\n}}" for i in range(10))
    texts = [(1, "/r1", lib), (2, "/r1", lib.replace("libk", "libOther")), (3, "/r2", lib)]
    df = spark.createDataFrame([(i, r, f"{r}/src/a{i}.ts", t) for i, r, t in texts], "file_id long, project_root string, path string, content string")
    catalog = spark.createDataFrame([], "item_id long, file_name string, content string, hash string")
    got = generated.classified(df, languages, catalog).collect()
    assert {r["file_id"]: r["reason"] for r in got} == {1: "vendored", 2: "vendored", 3: "vendored"}
    assert len({r["cluster"] for r in got}) == 1 and {r["cluster_files"] for r in got} == {3}


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(900 + i, 901 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(60)]
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r["u"]: r["c"] for r in clusters.components(spark.createDataFrame(edges, "u long, star long")).collect()}
    loose = {a for a, b in edges if a == b}
    assert got == {x: top(x) for x in up if x not in loose or x in got}
    assert clusters.components(spark.createDataFrame([], "u long, star long")).count() == 0


def test_links_join_what_brute_force_joins(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 60000, (12, 64)).astype(np.uint16)
    rows = []
    for i in range(240):  # families around twelve signatures, some rows far from all
        x = base[i % 12].copy()
        x[rng.choice(64, rng.integers(0, 10 if i % 5 else 40), replace=False)] = rng.integers(0, 60000)
        rows.append(x)
    x = np.unique(np.array(rows), axis=0)
    keys = clusters.bands(x, 4)
    df = spark.createDataFrame([(i * 7919 - 1000, k.tolist(), s.tobytes()) for i, (k, s) in enumerate(zip(keys, x))], "u long, keys array<long>, sig binary")
    got = {(r["u"], r["star"]) for r in clusters.links(df, 0.8).collect()}
    near = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and (x[i] == x[j]).mean() >= 0.8}
    place = {i * 7919 - 1000: i for i in range(len(x))}
    assert got and {(place[a], place[b]) for a, b in got} <= near

    def groups(pairs):
        up = list(range(len(x)))
        for a, b in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        out = []
        for i in range(len(x)):
            while up[i] != i:
                i = up[i]
            out.append(i)
        return out

    own = groups((place[a], place[b]) for a, b in got)
    assert np.mean([own[a] == own[b] for a, b in near]) >= 0.97  # two members of different stars may stay apart


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Dear <customer name>, your order of [PRODUCT] is on the way.", "slot"),
        ("We could not reach the database. Please try again later.", "error"),
        ("Votre session a expiré. Veuillez vous reconnecter.", "error"),
        ("Home | Docs | Search\n\n[object Object]\n\n[object Object], NaN refs", "stub"),
        ("502 Bad Gateway\n\nproxy at some.host.example", "error"),
        ("Pulvin telluris sitam adipar sitam pulvin donec orcanum noctem mollit quonda.", "filler"),
        ("The reader could not reach the cache, so it takes the slow way. It is tried again each hour, and the log tells how long that took.", None),
        ("Set `ORDER_ID` for the run and see the table [here](x) for the names.", None),
    ],
)
def test_more_texts_without_content(text, kind):
    assert residue.missing(text) == kind


def test_functions_inside_arrows_and_methods():
    text = "const outer = (a) => {\n  // Gives the area of a circle that the caller draws.\n  function inner(r) {\n    return r;\n  }\n  return inner(a);\n}\nclass A {\n  run(b) {\n    // Drops every entry older than the last page.\n    const drop = (x) => {\n      return x;\n    };\n  }\n}\n"
    assert [name for name, _, _ in documented.pairs("typescript", text, None)] == ["inner", "drop"]


def test_a_docstring_on_the_line_of_its_def(spark, languages):
    df = spark.createDataFrame([("a", "/a.py", 'def f(x): "Gives the area of a circle."\n', None)], "id string, path string, content string, docstring string")
    assert [tuple(r)[:2] for r in documented.documented(df, languages).collect()] == [("a", "f")]


def test_short_sentences_of_one_span_count_together():
    detector = prose.Detector(SAMPLES)
    assert set(prose.languages_of("typescript", "// Reads the file. Returns the hash of it.\nf();\n", detector)) == {"en"}
    assert set(prose.languages_of("typescript", 'f("文件读取器按照得分排");', detector)) == {"zh"}
    assert not prose.languages_of("typescript", "// Reads the file.\nf();\n// Code made by a tool; DO NOT EDIT.\n", detector)


def test_overloads_are_all_kept(spark, languages):
    text = "class A {\n  /** Opens the file that the caller names. */\n  void open(String a) { x(); }\n  /** Opens the stream and keeps its place. */\n  void open(Stream b) { y(); }\n}\n"
    df = spark.createDataFrame([("a", "/a.java", text, None)] * 2, "id string, path string, content string, docstring string")
    assert [r["function_name"] for r in documented.documented(df, languages).collect()] == ["open", "open"]


def test_every_two_members_of_a_bucket_are_compared(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    places = rng.integers(0, 1 << 16, (60, generated.NAMED_PLACES), dtype=np.uint16)
    places[:, :3] = 7  # one bucket of all, of which few agree
    places[40:50, :20] = places[20:30, :20]
    rows = [(1, i, f"/r{0 if i == 0 else 9 if i == 59 else 5 if i < 40 else 6}", "generated" if i in (22, 23, 59) else None, places[i].tobytes(), 100) for i in range(60)]
    rows += [(1, None, None, None, places[30].tobytes(), 100), (1, 60, "/r5", None, places[30].tobytes(), 3), (1, 61, "/r5", None, places[31].tobytes(), 3)]
    member = spark.createDataFrame(rows, "c long, _k long, root string, own string, named binary, shingles int")
    for cell_rows in (2000, 10):
        got = {r["_k"]: (r["foreign"], r["tool"]) for r in generated.copies(member, cell_rows).collect()}
        assert {k for k, (f, _) in got.items() if f} == {*range(20, 30), *range(40, 50), 30, 60}
        assert {k for k, (_, t) in got.items() if t} == {22, 23, 42, 43, 59}


def test_functions_come_with_their_whole_signature_and_code():
    text = 'class A:\n    def area(self, r):\n        """Gives the area of a circle that the caller draws."""\n        s = """\nnot indented"""\n        # kept\n        return [\n    r,\n]\n\n    def b(self): pass\nx = 1\n'
    first, second = [code for _, _, _, code in documented.functions("python", text, None)]
    assert first.endswith("r,\n]") and "return [" in first and second == "def b(self): pass"
    text = "const half = (n) =>\n  n\n    .map((x) => { return x / 2; })\n    .join();\nconst one = () => 1\nconst many = (\n  radius,\n  colour,\n) => ({ a: radius });\n"
    got = {name: (signature, code) for name, signature, _, code in documented.functions("script", text, None)}
    assert got["half"][1].endswith(".join()") and got["one"][1] == "const one = () => 1" and got["many"][1].endswith("=> ({ a: radius })")
    assert "colour" in got["many"][0]
    got = [code for _, _, _, code in documented.functions("script", "const a = () => 'x' + `y\n;z`\nconst b = (s) => /[;,]/.test(s)\n", None)]
    assert got == ["const a = () => 'x' + `y\n;z`", "const b = (s) => /[;,]/.test(s)"]
    text = 'def f():\n    """Opens the drawer.\n\nIt holds maps."""\n# outside\n'
    assert [code for *_, code in documented.functions("python", text, None)] == [text[: text.index("\n# out")]]


def test_definitions_that_differ_in_their_bodies_are_all_kept(spark, languages):
    text = "# Opens the drawer that holds the maps.\ndef f(x):\n    return 1\n\n\n# Opens the drawer that holds the maps.\ndef f(x):\n    return 2\n"
    df = spark.createDataFrame([("a", "/a.py", text, None)], "id string, path string, content string, docstring string")
    assert sorted(r["code"] for r in documented.documented(df, languages).collect()) == ["def f(x):\n    return 1", "def f(x):\n    return 2"]
