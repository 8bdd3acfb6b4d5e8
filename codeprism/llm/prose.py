"""Natural language inside source files: comments, docstrings and string literals.

Spans are cut out of the code, freed of their marks, escapes, tags, names, paths and code, and split
into sentences. One Aho-Corasick pass over a sentence finds the function words of all languages;
a hit counts only where its neighbours are no word characters, and votes for each language that has
the word with one over the number of those languages. Writing systems without blanks, and those of a
single language, are settled by the ranges of their scripts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax.files import valid, with_language
from .syntax.script import REGEX, TEMPLATE

# fixed values: common function words of the languages in Latin script; more come from the samples
FUNCTION_WORDS = {
    "de": "der die das und nicht mit wenn ist wird nach für dem den ein eine aus von oder auch bitte werden sind",
    "en": "the and not with when is are of to if for that this from it by which both in or as be was has have their its before after without only",
    "es": "el la los las y no con cuando es una por para del que sin",
    "fr": "le la les et ne pas avec lorsque est une pour des du que sans",
    "it": "il la gli e non con quando è una per della che di senza anche",
    "nl": "de het een en niet met wanneer is voor dat van wordt zijn zodat zonder",
    "pl": "i nie z gdy jest się że do na po przez dla oraz żeby bez",
    "pt": "o a os as e não com quando é uma para do da que sem",
}
LEAST_WORDS, LEAST_CHARS = 6, 10
SCRIPTS = {"ko": re.compile(r"[가-힣ᄀ-ᇿ]"), "ja": re.compile(r"[぀-ヿ]"), "zh": re.compile(r"[㐀-䶿一-鿿]"), "ru": re.compile(r"[Ѐ-ӿ]")}
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
UNSPACED = re.compile(r"[぀-ヿ㐀-䶿一-鿿々ー]")

DOUBLE, SINGLE = r"\"(?:[^\"\\\n]|\\[\s\S])*\"", r"'(?:[^'\\\n]|\\[\s\S])*'"


def _spans(strings: str, comments: str, skip: str = "") -> re.Pattern:
    joined = rf"(?P<s>(?:{strings})(?:\s*\+?\s*(?:{strings}))*)"
    return re.compile(rf"(?P<c>{comments})|{joined}" + (f"|{skip}" if skip else ""))


SLASHED = r"//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*[\s\S]*?(?:\*/|\Z)"
HASHED = r"\#[^\n]*(?:\n[ \t]*\#[^\n]*)*"
TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
SPANS = {
    "script": _spans(rf"{DOUBLE}|{SINGLE}|{TEMPLATE}`", SLASHED, rf"(?:[=(,;:!&|?{{\[+~^>]|\breturn|\btypeof)[ \t]*{REGEX}"),
    "python": _spans(rf"[rRbBuUfF]{{0,2}}(?:{TRIPLE}|{DOUBLE}|{SINGLE})", HASHED),
    "go": _spans(rf"{DOUBLE}|`[^`]*`", SLASHED, r"'(?:[^'\\\n]|\\.)+'"),
    "rust": _spans(r"\"(?:[^\"\\]|\\[\s\S])*\"", SLASHED, r"b?'(?:[^'\\\n]|\\[^'\n]{1,9}|\\')'"),
    "java": _spans(rf"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|{DOUBLE}", SLASHED, r"'(?:[^'\\\n]|\\.[0-9a-fA-F]{0,4})'"),
    "json": re.compile(r"\"(?:[^\"\\\n]|\\.)*\"\s*:|(?P<s>\"(?:[^\"\\\n]|\\.)*\")|(?P<c>(?!))"),
}
SPANS |= {"typescript": SPANS["script"], "tsx": SPANS["script"], "javascript": SPANS["script"]}

LITERAL = re.compile(rf"[rRbBuUfF]{{0,2}}(?:{TRIPLE}|{DOUBLE}|{SINGLE}|`(?:[^`\\]|\\[\s\S])*`)")
ESCAPE = re.compile(r"\\(?:u\{([\da-fA-F]{1,6})\}|u([dD][89abAB][\da-fA-F]{2})\\u([dD][c-fC-F][\da-fA-F]{2})|u([\da-fA-F]{4})|U([\da-fA-F]{8})|x([\da-fA-F]{2})|([\s\S]))")
MARK = re.compile(r"^[ \t]*(?:/{2,}!?|/\*+!?|\*+/|\*(?=\s|$)|\#+|;+|--)[ \t]?|\*+/[ \t]*$", re.M)
PLAIN_ESCAPES = {"n": "\n", "t": " ", "r": " ", "b": " ", "f": " ", "v": " ", "0": " ", "\n": ""}

SQL = re.compile(r"^\s*(?:SELECT\b.*\bFROM\b|INSERT\s+INTO\b|UPDATE\b.*\bSET\b|DELETE\s+FROM\b|CREATE\s+(?:TABLE|INDEX|VIEW)\b|ALTER\s+TABLE\b|DROP\s+TABLE\b|WITH\b.*\bAS\s*\().*", re.S | re.I)
SQL_STRICT = re.compile(r"\b(?:SELECT\b[^.]{1,200}?\bFROM\s+\w+|INSERT\s+INTO\s+\w+|DELETE\s+FROM\s+\w+|(?:CREATE|ALTER|DROP)\s+TABLE\s+\w+)[^\n]*")
CODE_LINE = re.compile(r"^[ \t]*(?:[\w.\[\]]+\s*(?:[-+*/|&]?=|:=)[^=>]|(?:return|if|for|while|const|let|var|def|fn|func|import|from|use|package)\b[^.\n]*[;(){}=]|[\w.]+\([^)\n]*\)[ \t]*[;{]?[ \t]*$|[<>=]{7}|[{}\[\]();]+[ \t]*$).*$", re.M)
NOISE = re.compile(
    r"```[\s\S]*?```|`[^`\n]*`|<!--|-->|</?[A-Za-z][^<>\n]*>|\b(?:https?|ftp|file|ssh)://\S+|\bwww\.\S+|[\w.+-]+@[\w-]+\.\w+"
    r"|[@:\\](?:param|arg|type|throws?|raises?|property|see|link|template|typedef|var)\b[ \t]*(?:\{[^}\n]*\}[ \t]*)?[\w$.]*:?|@[\w-]+:?|:[a-z]+:"
    r"|\{[^{}\n]*\}|\$[\w{]+\}?|%\w|[\w$.-]*(?:/[\w$.*-]+)+/?|[\w$-]+(?:\.[\w$-]+)*\([^)\n]*\)|\b[\w-]+\.(?:[a-z]\w{0,5}|idl|proto\d?)\b(?![.\w]* [A-Z])(?:\(\))?|\b\w*_\w*\b|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*|\b\w*\d\w*\b|--?[\w-]+(?==)"
)
END = re.compile(r"(?<=[.!?。！？…])(?=\s|$|[\"'»”])|(?<=[。！？])|\n[ \t]*\n|[;•|]\s")


TODO = re.compile(r"^[ \t]*(?:TODO|FIXME|XXX|HACK)\b.*$", re.M)


def decoded(m: re.Match) -> str:
    brace, high, low, four, eight, two, one = m.groups()
    if high:
        return chr(0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00)
    if code := brace or four or eight or two:
        n = int(code, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
    return PLAIN_ESCAPES.get(one, one)


def spans(language: str, text: str) -> Iterator[str]:
    """The text of every comment, and of every literal or chain of adjoining literals."""
    for m in SPANS[language].finditer(text):
        if (c := m.group("c")) is not None:
            if len(c) > 8:
                yield MARK.sub("", c)
        elif (s := m.group("s")) is not None and len(s) >= LEAST_CHARS + 2:
            parts = []
            for lit in LITERAL.findall(s):
                q = lit.lstrip("rRbBuUfF")
                n = 3 if q[:3] in ('"""', "'''") else 1
                body = q[n:-n]
                parts.append(ESCAPE.sub(decoded, body) if "\\" in body and not lit[:1] in "rR" else body)
            yield "".join(parts)


def sentences(span: str) -> Iterator[str]:
    """Sentences of a span without tags, names, paths, code and SQL; a line that begins with a mark stands alone."""
    if len(span.split()) < LEAST_WORDS and len(UNSPACED.findall(span)) < LEAST_CHARS:
        return
    if "TODO" in span or "FIXME" in span:
        span = TODO.sub(r"\g<0>\n\n", span)
    span = CODE_LINE.sub("\n\n", SQL_STRICT.sub(" ", span)) if "\n" in span or "=" in span or "SELECT" in span or "(" in span else span
    if SQL.match(span) and not re.search(r"[.!?]\s", span):
        return
    for part in END.split(NOISE.sub(" ", span)):
        if len(part) >= 4:
            yield " ".join(part.split())


class Detector:
    """Which language a sentence is in, if it is running text."""

    def __init__(self, samples: dict[str, list[str]]):
        import ahocorasick

        langs = defaultdict(set)
        for lang, words in FUNCTION_WORDS.items():
            for w in words.split():
                langs[w].add(lang)
        for lang, texts in samples.items():
            if lang in SCRIPTS:
                continue
            seen = Counter(w for t in texts for w in {x.lower() for x in WORD.findall(t)})
            for w in seen:
                langs[w].add(lang)
        self.automaton = ahocorasick.Automaton()
        for w, ls in langs.items():
            self.automaton.add_word(w, (len(w), tuple((x, 1 / len(ls)) for x in sorted(ls))))
        self.automaton.make_automaton()
        self.known: dict[str, str | None] = {}

    def language(self, sentence: str) -> str | None:
        got = self.known.get(sentence, 0)
        if got == 0:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[sentence] = self._language(sentence)
        return got

    @staticmethod
    def short(s: str) -> bool:
        """Whether a sentence ends as one and has too few words for a verdict."""
        return s[-1:] in tuple(".!?。！？…") and not s.isupper() and len(UNSPACED.findall(s)) < LEAST_CHARS and len(WORD.findall(s)) < LEAST_WORDS

    def _language(self, s: str) -> str | None:
        unspaced = len(UNSPACED.findall(s))
        letters = sum(c.isalpha() for c in s)
        if unspaced > 0.5 * max(1, letters):
            if unspaced < LEAST_CHARS:
                return None
            kana = len(SCRIPTS["ja"].findall(s))
            return "ja" if kana >= 0.1 * unspaced else "zh"
        words = WORD.findall(s)
        if len(words) < LEAST_WORDS:
            return None
        for lang in ("ko", "ru"):
            if sum(bool(SCRIPTS[lang].search(w)) for w in words) > 0.6 * len(words):
                return lang
        low = s.lower()
        votes: Counter = Counter()
        hits: Counter = Counter()
        for end, (n, langs) in self.automaton.iter(low):
            a, b = end - n, end + 1
            if (a < 0 or not (low[a].isalnum() or low[a] == "_")) and (b >= len(low) or not (low[b].isalnum() or low[b] == "_")):
                for lang, weight in langs:
                    votes[lang] += weight
                    hits[lang] += 1
        if not votes:
            return None
        (lang, v), *rest = votes.most_common(2)
        if hits[lang] < 2 or v < 0.1 * len(words) or rest and rest[0][1] >= v:
            return None
        return lang


def languages_of(language: str, text: str, detector: Detector) -> Counter:
    """Characters of running text by language; text of one span counts from six words of a language on."""
    out: Counter = Counter()
    for span in spans(language, text):
        short: list[str] = []
        for s in sentences(span):
            if lang := detector.language(s):
                out[lang] += len(s)
            elif detector.short(s):
                short.append(s)
        # neighbouring sentences too short to tell count as one text
        if len(short) > 1 and (lang := detector.language(" ".join(short))):
            out[lang] += sum(map(len, short))
    return out


def file_languages(files: DataFrame, languages: DataFrame, samples: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, lang, n_chars, share``: each language with running text in a file that parses.

    ``share`` is the text's part of all characters of the file. Null contents and unknown extensions
    give no row, a repeated delivery counts once. ``samples`` (lang, text) is a small fixed table.
    """
    texts = defaultdict(list)
    for r in samples.where("lang is not null and text is not null").select("lang", "text").distinct().collect():
        texts[r["lang"]].append(r["text"])
    rows = with_language(files.select(F.col(key).alias("_k"), "path", "content").where("content is not null"), languages).select("_k", "language", "content")
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(texts)
        for b in batches:
            at, langs, sizes, shares = [], [], [], []
            for i, (lang, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = languages_of(lang, text, detector)
                if found and valid(lang, text):
                    for x, n in sorted(found.items()):
                        at.append(i), langs.append(x), sizes.append(n), shares.append(round(n / len(text), 6))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(shares, pa.float64())], [key, "lang", "n_chars", "share"])

    return rows.mapInArrow(run, f"{key} {kind}, lang string, n_chars bigint, share double").dropDuplicates([key, "lang"])
