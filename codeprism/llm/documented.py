"""Functions and methods paired with their documentation.

Comments and strings are found first and blanked out, place by place, so that nothing inside them can
look like code. Over the blanked text one recursive pattern per language (regex library) captures the
signature with its balanced parameters and the balanced body together. The documentation is the
comment that stands directly in front - in the content, or in ``docstring`` for the outermost
definition of the chunk - or the string that opens a Python body. Captures whose documentation says
nothing beyond name, signature, tags and types are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .generated import LEGAL, SIGNED
from .prose import ESCAPE, MARK, NOISE, UNSPACED, WORD, decoded
from .syntax.script import REGEX, TEMPLATE

DOUBLE, SINGLE = r"\"(?:[^\"\\\n]|\\[\s\S])*\"", r"'(?:[^'\\\n]|\\[\s\S])*'"
TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|\Z)"
#: What is blanked out; comments are group c, strings group s.
HIDDEN = {
    "script": re.compile(rf"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>{DOUBLE}|{SINGLE}|{TEMPLATE}`)|(?:[=(,;:!&|?{{\[+~^>]|\breturn|\btypeof)[ \t]*(?P<r>{REGEX})"),
    "python": re.compile(rf"(?P<c>\#[^\n]*)|(?P<s>{TRIPLE}|{DOUBLE}|{SINGLE})"),
    "go": re.compile(rf"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>{DOUBLE}|`[^`]*`|'(?:[^'\\\n]|\\.[^'\n]*)')"),
    "rust": re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^'\n]{1,9}|\\')')"),
    "java": re.compile(rf"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"\"\"[\s\S]*?\"\"\"|{DOUBLE}|'(?:[^'\\\n]|\\.[^'\n]*)')"),
}

ROUND = r"(?P<round>\((?:[^()]|(?&round))*+\))"
BODY = r"(?P<body>\{(?:[^{}]|(?&body))*+(?:\}|\Z))"
ANGLE = r"(?:<[^;{}()]*>)?"
NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|function|else|do|try|new|throw|typeof|with|await|super|match|synchronized|assert|case|default|in|of|as|let|const|var|import|export|class)\b)"
FUNCTIONS = {
    "script": rf"(?m:^|(?<=[;{{}}]))[ \t]*(?P<at>(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*{ANGLE}{ROUND}(?:\s*:[^{{;]*)?\s*{BODY}"
    rf"|(?:const|let|var)[ \t]+(?P<name>[\w$]+)[ \t]*(?::[^=;\n]+)?=[ \t]*(?:async[ \t]*)?(?:function[ \t]*\*?[ \t]*[\w$]*[ \t]*(?P<list>(?&round))\s*(?::[^{{;]*)?(?&body)|{ANGLE}(?:(?P<list>(?&round))(?:\s*:[^={{;]*)?|[\w$]+)\s*(?P<arrow>=>)\s*(?:(?&body)|[^\s]))"
    rf"|(?:(?:public|private|protected|static|async|override|abstract|get|set)[ \t]+)*\*?{NOT_NAMES}(?P<name>\#?[\w$]+)[ \t]*{ANGLE}(?P<list>(?&round))(?:\s*:[^{{;=]*)?\s*(?&body)))",
    "python": rf"(?m)^[ \t]*(?P<at>(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*{ROUND}[^:\n]*:)",
    "go": rf"(?m)^[ \t]*(?P<at>func[ \t]*(?:\([^()]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?{ROUND}[^{{\n]*{BODY})",
    "rust": rf"(?m)^[ \t]*(?P<at>(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:const|async|unsafe|default|extern(?:[ \t]+\S+)?)[ \t]+)*fn[ \t]+(?P<name>\w+)[ \t]*{ANGLE}{ROUND}[^{{;]*(?:{BODY}|;))",
    "java": rf"(?m)^[ \t]*(?P<at>(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^;{{}}()]*>[ \t]*)?(?:{NOT_NAMES}[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*[ \t]+)?{NOT_NAMES}(?P<name>\w+)[ \t]*{ROUND}(?:\s*throws[^{{;]*)?\s*{BODY})",
}
MODULES = {"typescript": "script", "tsx": "script", "javascript": "script", "python": "python", "go": "go", "rust": "rust", "java": "java"}
#: What may stand between a comment and its definition: decorators, annotations, attributes.
BETWEEN = re.compile(r"(?:[ \t]*(?:@[\w.]+(?:\([^\n]*\))?|\#\[[^\n]*\])[ \t]*\r?\n)+\Z")
LAST = {True: re.compile(r"(?:^|\n)(?P<c>(?:[ \t]*\#[^\n]*\n)+)\Z"), False: re.compile(r"(?:^|\n)(?P<c>(?:[ \t]*//[^\n]*\n)+|[ \t]*/\*(?:[^*]|\*(?!/))*\*/[ \t]*\n?)[ \t]*\Z")}

#: A line that the next one continues, and a line that continues the one before.
STOPS, OPEN_END, OPEN_START = re.compile(r"[()\[\]{};,\n]"), re.compile(r"(?:^\s*|=>|[-+*/%&|^=<>?:.!~]|\b(?:await|typeof|new|void|in|of|instanceof|as))\s*\Z"), re.compile(r"\s*(?:[.?:&|*/%^=<>\[(]|[-+](?![-+])|(?:instanceof|in|as)\b)")

# fixed values: documentation that says nothing
DIRECTIVE = re.compile(r"^\W*(?:eslint|tslint|jshint|prettier|istanbul|c8|nolint|noqa|noinspection|pylint|flake8|mypy|ruff|black|isort|type:|pragma|@ts-|ts-|clippy|rustfmt|cargo|fmt:|go:|line |\+build|region|endregion|#?(?:end)?region|suppress|nosonar|checkstyle|coverage|biome|sonar|codegen|skip-)\b.*$|^\W*(?:@(?:inheritdoc|override|internal|private|public|deprecated|ts-[\w-]+|type\b.*|suppress\w*))\W*$", re.I | re.M)
REFERENCE = re.compile(r"^\W*(?:see|cf\.?|refer to|compare|siehe|voir|véase|ver|zie|vedi|zob\.?|patrz|см\.?|見よ|参照|参见|참조)\b[^.\n]{0,80}\.?\W*$|^\W*(?:ditto|same as (?:above|below|before)|as above|dito|idem|(?:same|likewise)\.?)\W*$|^\W*@see\b.*$|\b(?:see|as) (?:above|below)\b\.?", re.I | re.M)
LEGAL_TAIL = re.compile(r"\b(?:for use inside|before you share|notice in|see the notice|company only|terms|licence|license|governed|contributors)\b", re.I)
MARKER = re.compile(r"^\W*(?:no docs?(?:umentation)?(?: yet)?\W*$|(?:un|not )documented\W*$|docs? (?:missing|needed|to come)\b|(?:add|write|needs) docs?\b|todo|fixme|xxx|hack|note to self|wip|tbd|nb)\b.*$", re.I | re.M)
CODE = re.compile(r"^[ \t]*(?:[\w.\[\]\"']+[ \t]*(?:[-+*/|&]?=|:=)(?![=>])[ \t]*\S.*|(?:return|if|for|while|else|elif|const|let|var|try|with|import|from|raise|throw)\b.*[(){}=;:].*|return[ \t]+[\w.]+;?|[\w.]+\(.*\)[;:]?|[<>=|]{7}.*|[{}()\[\];,]+)[ \t]*$", re.M)
TAG = re.compile(r"^[ \t]*(?:[@\\](?:param|arg|argument|return|returns|throws|exception|type|typedef|template|property|prop|since|author|version|yield|yields|raises?)\b.*|:(?:param|type|returns?|rtype|raises?|arg)\b.*|(?:args|arguments|parameters|params|returns?|raises|yields|throws)[ \t]*:[ \t]*$|[-=~]{3,})[ \t]*$", re.I | re.M)
EMPTY_WORDS = frozenset(
    "a an the this that it its is are was be been of to for in on by with and or as at from into which has have had does do did can will called named name function functions method methods helper helpers class classes module procedure routine operation internal private public protected static async utility util utils wrapper main default"
    " simple basic generic here there these those value values argument arguments parameter parameters param params return returns returned result results given takes take none null void self cls object type types string number int list array bool boolean"
    " constructor getter setter implementation impl body stub pass use usage used only also just some any all stuff thing things code def fn func".split()
)


@lru_cache(maxsize=8)
def pattern(language: str):
    return regex.compile(FUNCTIONS[language])


def blanked(language: str, text: str) -> str:
    """``text`` with comments and strings blanked out, every character in its place."""

    def hide(m: re.Match) -> str:
        t = m.group()
        if m.lastgroup == "r":
            return t[: m.start("r") - m.start()] + " " * (m.end() - m.start("r"))
        if "\n" in t:
            return re.sub(r"[^\n]", " ", t)
        return " " * len(t)

    return HIDDEN[language].sub(hide, text)


def stems(text: str) -> set[str]:
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+", text)
    return {stem(w.lower()) for w in words}


def stem(w: str) -> str:
    for end in ("ing", "ied", "ies", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)].rstrip("e") + ("y" if end in ("ied", "ies") else "")
    return w.rstrip("e") if len(w) > 3 else w


def says(doc: str, name: str, signature: str) -> bool:
    """Whether the documentation tells in words what the function does."""
    text = MARK.sub("", doc).replace("\r", "")
    if "\\" in text:
        text = ESCAPE.sub(decoded, text)
    if SIGNED.search(text):
        return False
    text = TAG.sub("\n", text)
    text = MARKER.sub("\n\n", text)
    text = REFERENCE.sub("\n", DIRECTIVE.sub("\n", text))
    text = CODE.sub("\n", text)
    if LEGAL.search(text):
        text = " ".join(s for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if not LEGAL.search(s) and not LEGAL_TAIL.search(s))
    text = NOISE.sub(" ", text)
    if len(UNSPACED.findall(text)) >= 4:
        return True
    own = stems(name) | stems(signature)
    kept = [w for w in WORD.findall(text) if len(w) > 1 and w.lower() not in EMPTY_WORDS and stem(w.lower()) not in own]
    return len({w.lower() for w in kept}) >= 2


def docstring_of(text: str, at: int) -> str | None:
    """The string that opens the Python body whose signature ends at ``at``."""
    m = re.compile(rf"(?:[ \t]*\#[^\n]*)?\s*(?:[rRuU]?(?P<s>{TRIPLE}|{DOUBLE}|{SINGLE}))[ \t]*(?:\r?\n|\Z|;|\#)").match(text, at)
    if not m:
        return None
    s = m.group("s")
    n = 3 if s[:3] in ('"""', "'''") else 1
    return s[n:-n] if len(s) >= 2 * n else s[n:]


def functions(language: str, text: str, docstring: str | None) -> Iterator[tuple[str, str, str, str]]:
    """``(name, signature, documentation, code)`` of every function that the text defines, trivial ones included."""
    code = blanked(language, text)
    python = language == "python"
    at, first = 0, True
    while m := pattern(language).search(code, at):
        start = m.start("at")
        name = m.group("name")
        listed = next((m.end(g) for g in ("round", "list", "arrow") if m.groupdict().get(g)), m.end())
        signature = code[start:listed] if m.group("round") else code[start:listed] + code[listed : m.end()].split("\n", 1)[0]
        line = code.rfind("\n", 0, start) + 1
        before = text[:line] if not code[line:start].strip() else ""
        if before and (between := BETWEEN.search(before)):
            before = before[: between.start()]
        docs = []
        if before.endswith("\n") and (c := LAST[python].search(before)) and not _after_code(code, c.start("c")):
            docs.append(c.group("c"))
        if first and docstring and not code[:start].strip(" \t\r\n;") .replace("export", ""):
            docs.append(docstring)
        elif first and docstring and BETWEEN.search(code[:line]) and not code[: line - len(BETWEEN.search(code[:line]).group())].strip():
            docs.append(docstring)
        if python and (inner := docstring_of(text, m.end())):
            docs.append(inner)
        first = False
        yield name, signature, "\n\n".join(docs), text[start : end_of(language, text, start, m)]
        at = listed  # functions inside the body are found as well


@lru_cache(maxsize=2)
def bracketed(language: str, text: str) -> str:
    """``text`` with comments blanked out and each string as a pair of brackets, every character in its place."""

    def show(m: re.Match) -> str:
        kind = m.lastgroup
        inner = " " if kind == "c" else "s"
        at = m.start(kind) - m.start()
        t = re.sub(r"[^\n]", inner, m.group()[at:])
        return m.group()[:at] + (t if kind == "c" else f"({t[1:-1]})")

    return HIDDEN[language].sub(show, text)


def end_of(language: str, text: str, start: int, m: regex.Match) -> int:
    """Where the function ends whose signature ``m`` has found: past its indented block, or its arrow's expression."""
    if language == "python":
        return _block_end(bracketed(language, text), start, m.end())
    if m.groupdict().get("arrow") and not (code := bracketed(language, text))[m.end("arrow") :].lstrip().startswith("{"):
        return max(m.end(), _expression_end(code, m.end("arrow")))
    return m.end()


def _block_end(code: str, start: int, at: int) -> int:
    """The end of the last line that stands deeper than the line of ``start``; blank ones and those inside brackets go on."""
    line = code.rfind("\n", 0, start) + 1
    width = len(code[line:start].expandtabs())
    stop = code.find("\n", at)
    stop = len(code) if stop < 0 else stop
    end, depth = len(code[at:stop].rstrip()) + at, max(0, _depth(code[at:stop]))
    while stop < len(code):
        begin = stop + 1
        stop = code.find("\n", begin)
        stop = len(code) if stop < 0 else stop
        row = code[begin:stop]
        if row.strip():
            if not depth and len(row.expandtabs()) - len(row.expandtabs().lstrip()) <= width:
                break
            end = begin + len(row.rstrip())
            depth = max(0, depth + _depth(row))
    return end


def _depth(code: str) -> int:
    return sum(map(code.count, "([{")) - sum(map(code.count, ")]}"))


def _expression_end(code: str, at: int) -> int:
    """The end of an expression: before a semicolon, a comma or a closing bracket, or at the end of a line that nothing continues."""
    depth, end = 0, len(code)
    for m in STOPS.finditer(code, at):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif not depth and (c != "\n" or not OPEN_END.search(code[max(at, m.start() - 40) : m.start()]) and not OPEN_START.match(code, m.start())):
            end = m.start()
            break
    return len(code[:end].rstrip())


def _after_code(code: str, start: int) -> bool:
    """Whether code stands on the line of a comment, in front of it."""
    line = code.rfind("\n", 0, start) + 1
    return bool(code[line:start].strip())


def pairs(language: str, text: str, docstring: str | None) -> Iterator[tuple[str, str, str]]:
    """``(name, documentation, code)`` of the functions whose documentation says something."""
    own = MODULES.get(language)
    if own is None:
        return
    found = list(functions(own, text, docstring))
    if not found:  # a piece of another language under a wrong name
        for lang in ("python", "go", "rust", "script", "java"):
            if lang != own and (found := list(functions(lang, text, docstring))):
                break
    for name, signature, doc, code in found:
        if doc and says(doc, name, signature):
            yield name, doc, code


def documented(chunks: DataFrame, languages: DataFrame, key: str = "id") -> DataFrame:
    """``chunk_id, function_name, documentation, code``: one row per documented function of a chunk.

    A repeated chunk counts once; a name that a chunk defines several times has a row for each
    definition, unless they read the same. Null contents, null ids, JSON and unknown extensions give no row, whatever
    chunk_type says.
    """
    from .syntax.files import with_language

    rows = with_language(chunks.select(F.col(key).alias("_k"), "path", "content", "docstring").where("content is not null"), languages)
    # without a comment or a string that opens a body there is no documentation
    rows = rows.where(F.col("_k").isNotNull() & (F.col("docstring").isNotNull() | F.col("content").rlike(r"//|/\*|#|\"\"\"|'''|:\s*[rRuU]?[\"']")))
    kind = chunks.schema[key].dataType.simpleString()
    names = ["chunk_id", "function_name", "documentation", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], ([], [], [])
            for i, (lang, text, doc) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                seen = set()
                for name, said, code in pairs(lang, text, doc):
                    if (name, code) not in seen:
                        seen.add((name, code))
                        at.append(i)
                        for c, v in zip(cols, (name, said, code)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names)

    found = rows.select("_k", "language", "content", "docstring").mapInArrow(run, f"chunk_id {kind}, function_name string, documentation string, code string")
    return found.dropDuplicates(["chunk_id", "function_name", "code"])
