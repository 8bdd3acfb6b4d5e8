"""Local grammars of Rust."""

from __future__ import annotations

import re

from .engine import BAD, Language, group

# fixed values: keywords of the language, by their kind
WORDS = {"p": "pub", "u": "use", "n": "mod", "F": "fn", "S": "struct union", "Q": "enum", "J": "impl", "t": "trait", "V": "let", "C": "const static", "Z": "type", "m": "mut ref", "M": "move", "A": "async unsafe", "x": "extern", "I": "if", "E": "else", "H": "match", "O": "for", "i": "in", "W": "while", "L": "loop", "R": "return", "b": "break continue", "w": "where", "z": "as", "d": "dyn"}
KIND = {w: k for k, ws in WORDS.items() for w in ws.split()} | {"union": "a"}
BINARY = {"/", "%", "^", "&&", "==", "!=", "<=", ">=", "<<"}
ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
SINGLE = {"::": "∷", "->": "→", "=>": "⇒", "..=": "‥", "...": "‥", "..": "‥", "+": "+", "-": "-", "*": "*", "&": "&", "|": "|", "||": "‖", "!": "!", "?": "?", "<": "<", ">": ">", "=": "=", ":": ":", ";": ";", ",": ",", ".": ".", "#": "#", "@": "@", "$": "$", "~": "~"} | {c: c for c in "()[]{}"}
OPENED_COMMENT, OPENED_STRING = "\x01", "\x02"

TOKEN = re.compile(
    r"b?r(\#+)\"[\s\S]*?\"\1|b?r\"[^\"]*\"|b?\"(?:[^\"\\]|\\[\s\S])*+\"?|b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x..|u\{[^}]*\}))'|'[A-Za-z_]\w*"
    r"|(?:r\#)?[A-Za-z_ª-\U0010ffff]\w*|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+(?:\*/)?|[()\[\]{},;]|<<=|>>=|\.\.=|\.\.\.|\.\.|::|->|=>|&&|\|\||<<|[-+*/%&|^=!<>]="
    r"|0[xbo][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.A-Za-z_]))?(?:[eE][+-]?[\d_]+)?(?:[iuf]\d+|[iu]size)?(?![A-Za-z_])|[^\s﻿]"
)


class _Findall:
    """findall of whole matches for a pattern that has a group."""

    def __init__(self, pattern: re.Pattern):
        self.pattern = pattern

    def findall(self, text: str) -> list[str]:
        if 'r#"' not in text:
            return PLAIN.findall(text)
        return [m.group() for m in self.pattern.finditer(text)]


PLAIN = re.compile(TOKEN.pattern.replace(r'b?r(\#+)\"[\s\S]*?\"\1|', ""))


def classify(t: str) -> str:
    c = t[0]
    if t[-1] == '"' and len(t) > 1 and ('"' in t[:-1]):
        return "0"
    if '"' in t[:2]:
        return OPENED_STRING if t[0] != "'" else "0"
    if c == "'" or t.startswith("b'"):
        return ("0" if t[-1] == "'" else "'") if len(t) > 1 else BAD
    if c.isalpha() or c == "_":
        return KIND.get(t, "a")
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return "" if len(t) > 3 and t.endswith("*/") else OPENED_COMMENT
    if c.isdigit():
        return "0"
    return SINGLE.get(t) or ("%" if t in BINARY else "≔" if t in ASSIGN else BAD)


EXPRS, PARAMS, TYPES, PATTERNS, VIS, FIELDS0, ANYP = 1, 2, 4, 8, 16, 32, 64
ARRAY, TYPE_ARRAY, ATTR, PATARRAY = 1, 2, 4, 8
BLOCK, FIELDS, VALUES, VARIANTS, ITEMS, ARMS, USES = 1, 2, 4, 8, 16, 32, 64
P = {p: group("(", p) for p in (EXPRS, PARAMS, TYPES, PATTERNS, VIS, FIELDS0, ANYP)}
B = {p: group("[", p) for p in (ARRAY, TYPE_ARRAY, ATTR, PATARRAY)}
G = {p: group("{", p) for p in (BLOCK, FIELDS, VALUES, VARIANTS, ITEMS, ARMS, USES)}
ANYG = "|".join(map(group, "{([")) 

# "g" stands for a list of generic arguments, found before the grammars are tried
ATTRS = rf"(?:#!?{B[ATTR]})*"
PATH = r"(?:∷?a(?:∷?g)?(?:∷a(?:∷?g)?)*|g(?:∷a(?:∷?g)?)+)"
LIFE = r"(?:'(?:\+)?)"
# types and patterns are told by what they are made of: no two names side by side
T = rf"(?:(?:[&*'mCdJ?O!+∷→AxF%g0]|a(?!a)|{P[TYPES]}|{B[TYPE_ARRAY]})++)"
PAT1 = rf"(?:(?:[&m0‥@∷!g-]|a(?!a)|{P[PATTERNS]}|{G[VALUES]}|{G[FIELDS]}|{B[PATARRAY]})+)"
PAT = PAT1.replace("[&m0", "[|&m0")
GENERIC = r"g?"
WHERE = rf"(?:w(?:{T}|[:,])*)?"
VISI = rf"(?:p{P[VIS]}?)?"
MACRO = rf"{PATH}!a?(?:{ANYG})"
CLOSURE = rf"A?M?(?:‖|\|(?:{PAT1}(?::{T})?,?)*\|)(?:→{T}(?={G[BLOCK]}))?"
BLOCKISH = rf"(?:(?:':)?(?:(?:(?:E?I|W|O{PAT}i|H)#C#|E|L|A|M|C)*+(?:{G[BLOCK]}|{G[ARMS]}))+)"
SATOM = rf"(?:0|{MACRO}|{PATH}|{P[EXPRS]}|{B[ARRAY]})"
POST = rf"(?:\.(?:a(?:∷g)?|0|A)|{P[EXPRS]}|{B[ARRAY]}|\?|z{T})"
SUNARY = rf"(?:[-!*&m]|%|{CLOSURE}|‥)"
SEXPR1 = rf"(?:{SUNARY}*{SATOM}{POST}*+)"
BIN = r"(?:[-+*%&|=≔‖<]|>{1,2}|‥)"
# a condition ends where its block or its arms begin
C_END = f"{G[BLOCK]}|{G[ARMS]}|⇒"
CONDX = rf"(?:(?:V{PAT}=)?{SEXPR1}(?:{BIN}|(?={C_END})))+"
BLOCKX = BLOCKISH.replace("#C#", CONDX)
ATOM = rf"(?:{BLOCKX}|{PATH}{G[VALUES]}|{SATOM})"
EXPR1 = rf"(?:(?:{SUNARY})*(?:{ATOM}{POST}*+|(?:R|b'?)|‥))"
EXPR = rf"(?:(?:R|b'?)?(?:{EXPR1}(?:{BIN}{EXPR1})*‥?)|R|b'?|‥)"
USE = r"u∷?(?:a(?:∷a)*(?:za)?|(?:a∷)*(?:\*|@G@));"
USEX = USE.replace("@G@", G[USES])
PARAM = rf"(?:{ATTRS}(?:&?'?m?a(?::{T})?|{PAT}:(?:‥|{T})))"
FN = rf"(?:C?A*(?:x0?)?A*)F a{GENERIC}{P[PARAMS]}(?:→{T})?{WHERE}(?:{G[BLOCK]}|;)".replace("F a", "Fa")
ITEM = (
    rf"(?:{ATTRS}{VISI}(?:{FN}|{USEX}|n a(?:{G[ITEMS]}|;)|S a{GENERIC}(?:{WHERE}{G[FIELDS]}|{P[FIELDS0]}{WHERE};|;)|Q a{GENERIC}{WHERE}{G[VARIANTS]}"
    rf"|A?Jg?(?:!?{T}O)?{T}{WHERE}{G[ITEMS]}|A?ta{GENERIC}(?::{T})?{WHERE}{G[ITEMS]}|Cm?a:{T}(?:={EXPR})?;|Z a{GENERIC}(?::{T})?{WHERE}(?:={T})?;"
    rf"|A?x(?:0?{G[ITEMS]}|a(?:za)?;)|{PATH}!a?(?:{group('{')}|(?:{group('(')}|{group('[')});)))"
).replace("n a", "na").replace("S a", "Sa").replace("Q a", "Qa").replace("Z a", "Za")
STATEMENT = rf"(?:;|{ATTRS}(?:V{PAT}(?::{T})?(?:={EXPR}(?:E{G[BLOCK]})?)?;|{ITEM}|{BLOCKX}(?![.?])|{EXPR};))"
FIELD = rf"{ATTRS}{VISI}a:{T}"
ARM = rf"{ATTRS}{PAT}(?:I{CONDX})?⇒"

GENERICS = re.compile(r"(?:(?<=[aFJO∷])|(?<=[(,:&→=<\[{])|\A)<((?:[a0'gdJCmFZ=,:+?&*∷‥→!-]|" + P[TYPES] + "|" + B[TYPE_ARRAY] + "|" + group("{", BLOCK) + ")*)>")


def before(k: str) -> str:
    if "<" in k:
        n = 1
        while n:
            k, n = GENERICS.subn("g", k)
    return k


def full(x: str) -> re.Pattern:
    return re.compile(x)


LANGUAGE = Language(
    "rust",
    _Findall(TOKEN),
    classify,
    before,
    {
        "(": [
            (EXPRS, full(rf"(?:{EXPR}(?:,|\Z))*")),
            (PARAMS, full(rf"(?:{PARAM}(?:,{PARAM})*,?)?")),
            (TYPES, full(rf"(?:(?:a:)?{T}(?:,(?:a:)?{T})*,?)?")),
            (PATTERNS, full(rf"(?:{PAT}(?:,{PAT})*,?)?")),
            (VIS, full(r"i?a(?:∷a)*")),
            (FIELDS0, full(rf"(?:{ATTRS}{VISI}{T}(?:,{ATTRS}{VISI}{T})*,?)?")),
            (ANYP, full(r"[\s\S]*")),
        ],
        "[": [
            (ARRAY, full(rf"(?:{EXPR}(?:[,;]|\Z))*")),
            (TYPE_ARRAY, full(rf"{T}(?:;(?:[-+*∷0]|a(?!a)|{P[EXPRS]}|{G[BLOCK]})+)?")),
            (ATTR, full(r"[\s\S]+")),
            (PATARRAY, full(rf"(?:{PAT}(?:,{PAT})*,?)?")),
        ],
        "{": [
            (BLOCK, full(rf"(?:{STATEMENT})*+(?:{ATTRS}{EXPR})?")),
            (FIELDS, full(rf"(?:{FIELD}(?:,{FIELD})*,?)?")),
            (VALUES, full(rf"(?:(?:m*(?:a|0)(?::{EXPR})?|‥{EXPR}?)(?:,|\Z))*")),
            (VARIANTS, full(rf"(?:{ATTRS}a(?:{P[FIELDS0]}|{G[FIELDS]})?(?:={EXPR})?(?:,|\Z))*")),
            (ITEMS, full(rf"(?:{ITEM})*+")),
            (ARMS, full(rf"(?:{ARM}(?:{G[BLOCK]},?|{EXPR}(?:,|\Z)))*")),
            (USES, full(rf"(?:(?:a∷)*(?:a(?:za)?|\*|@G@)(?:,(?:a∷)*(?:a(?:za)?|\*|@G@))*,?)?".replace("@G@", "[-]"))),
            (128, full(r"[\s\S]*[$#⇒~][\s\S]*")),
        ],
    },
    full(rf"(?:#!{B[ATTR]})*(?:{ITEM})*+"),
    spans={"comment": (re.compile(r"\*/"), ""), "string": (re.compile(r"(?:[^\"\\]|\\[\s\S])*?\""), "0")},
    opened={OPENED_COMMENT: "comment", OPENED_STRING: "string"},
)
