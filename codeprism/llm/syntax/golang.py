"""Local grammars of Go."""

from __future__ import annotations

import re

from .engine import BAD, Language, group

# fixed values: keywords of the language, by their kind
WORDS = {"k": "package", "M": "import", "F": "func", "V": "var const", "Z": "type", "S": "struct", "J": "interface", "m": "map", "c": "chan", "I": "if", "E": "else", "O": "for", "r": "range", "W": "switch", "X": "select", "K": "case", "d": "default", "R": "return", "b": "break continue", "f": "fallthrough", "g": "goto", "G": "go defer"}
KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
BINARY = {"/", "%", "||", "&&", "==", "!=", "<=", ">=", "<<", ">>", "&^", "<", ">"}
ASSIGN = {":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}
SINGLE = {"+": "+", "-": "+", "^": "+", "!": "!", "~": "!", "*": "*", "&": "&", "|": "%", "<-": "←", "++": "±", "--": "±", "...": "…", "=": "=", ":": ":", ";": ";", ",": ",", ".": "."} | {c: c for c in "()[]{}"}
OPENED_COMMENT, OPENED_RAW = "\x01", "\x02"

TOKEN = re.compile(
    r"[A-Za-z_ª-\U0010ffff]\w*|\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|[()\[\]{},;]|\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|&&|\|\||<<|>>|&\^|[-+*/%&|^=!<>]="
    r"|0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?i?(?![A-Za-z_])|\.\d[\d_]*(?:[eE][+-]?\d+)?"
    r"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x..|u.{4}|U.{8}|[0-7]{3}))'|`[^`]*`?|[^\s﻿]"
)


def classify(t: str) -> str:
    c = t[0]
    if t == "\n":
        return "\n"
    if c.isalpha() or c == "_":
        return KIND.get(t, "a")
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return ("\n" if "\n" in t else "") if len(t) > 3 and t.endswith("*/") else OPENED_COMMENT
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        return "0"
    if c in "\"'":
        return "0" if len(t) > 1 and t[-1] == c else BAD
    if c == "`":
        return "0" if len(t) > 1 and t[-1] == "`" else OPENED_RAW
    return SINGLE.get(t) or ("%" if t in BINARY else "≔" if t in ASSIGN else BAD)


EXPRS, PARAMS, TYPED, IMPORTS, DECLS, TYPES, FIELDLESS = 1, 2, 4, 8, 16, 32, 64
INDEX, LEN = 1, 2
BLOCK, VALUES, FIELDS, METHODS, CASES = 1, 2, 4, 8, 16
P = {p: group("(", p) for p in (EXPRS, PARAMS, TYPED, IMPORTS, DECLS, TYPES)}
B = {p: group("[", p) for p in (INDEX, LEN)}
G = {p: group("{", p) for p in (BLOCK, VALUES, FIELDS, METHODS, CASES)}

# types are told by what they are made of: no two names side by side
_T = rf"(?:[*←cmSJF.]|a(?!a)|{B[INDEX]}|{B[LEN]}|{P[PARAMS]}|{P[EXPRS]}|{G[FIELDS]}|{G[METHODS]})+"
T = rf"(?:{_T})"
SIG = rf"{P[PARAMS]}(?:{P[PARAMS]}|{T})?"
LITTYPE = rf"(?:(?:{B[INDEX]}|{B[LEN]}|m{B[INDEX]})+{T}|a(?:\.a)?(?:{B[INDEX]})?|S{G[FIELDS]})"
ATOM = rf"(?:F{SIG}{G[BLOCK]}|{LITTYPE}{G[VALUES]}|(?:{B[INDEX]}|{B[LEN]}|m{B[INDEX]}|c|S|J){T}?(?={P[EXPRS]}|[,;]|\Z)|J{G[METHODS]}|S{G[FIELDS]}|a|0|{P[EXPRS]}|{G[VALUES]})"
POST = rf"(?:\.a|\.{P[TYPED]}|{P[EXPRS]}|{B[INDEX]})"
EXPR1 = rf"(?:[+!*&←]*{ATOM}{POST}*+)"
EXPR = rf"(?:{EXPR1}(?:[%+*&]{EXPR1})*)"
LIST = rf"(?:{EXPR}(?:,(?=[^;])|(?![+!*&←a0cFmSJ\ue000-\ue002])))+"
SIMPLE = rf"(?:(?:{EXPR}(?:[,≔=←]r?|±|(?=[;:]|\Z|\ue002)))+)"
VSPEC = rf"a(?:,a)*(?:{T}(?:={LIST})?|={LIST})?"
TSPEC = rf"a(?:{B[INDEX]}|{B[LEN]})?=?{T}"
DECL = rf"(?:V(?:{VSPEC}|{P[DECLS]})|Z(?:{TSPEC}|{P[DECLS]}))"
HEADER = rf"(?:{SIMPLE}|;)*"
IF = rf"I(?:{SIMPLE};?|;)+{G[BLOCK]}"
STATEMENT = (
    rf"(?:(?:a:;*)*(?:{DECL}|(?:{IF}E?)+{G[BLOCK]}?|O(?:{SIMPLE}|;|r)*{G[BLOCK]}"
    rf"|W{HEADER}{G[CASES]}|X{G[CASES]}|R{LIST}?|ba?|f|ga|G{EXPR}|{G[BLOCK]}|{SIMPLE}))"
)
STATEMENTS = rf";*(?:{STATEMENT}(?:;+|\Z|(?=[Kd])))*+"
PARAM = rf"(?:a(?:,a)*…?{T}|…?{T})"
IMPORT = r"(?:[a.]?0)"
TOP = rf"(?:{DECL}|F(?:{P[PARAMS]})?a(?:{B[INDEX]}|{B[LEN]})?{SIG}(?:{G[BLOCK]})?)"
ENDERS = re.compile(r"([a0bfR±\ue00f])\n+")


def before(k: str) -> str:
    return ENDERS.sub(r"\1;", k).replace("\n", "")


def full(x: str) -> re.Pattern:
    return re.compile(x)


LANGUAGE = Language(
    "go",
    TOKEN,
    classify,
    before,
    {
        "(": [
            (EXPRS, full(rf"(?:(?:{EXPR}|{T})…?(?:,|\Z))*")),
            (PARAMS, full(rf"(?:{PARAM}(?:,{PARAM})*,?)?")),
            (TYPED, full(rf"Z|{T}")),
            (IMPORTS, full(rf";*(?:{IMPORT}(?:;+|\Z))*")),
            (DECLS, full(rf";*(?:(?:{VSPEC}|{TSPEC})(?:;+|\Z))*")),
        ],
        "[": [(INDEX, full(rf"(?:(?:{EXPR}|{T})?(?:[,:]|\Z))*")), (LEN, full(rf"…|a(?:,a)*!?{T}(?:%{T})*(?:,a(?:,a)*!?{T}(?:%!?{T})*)*"))],
        "{": [
            (BLOCK, full(STATEMENTS)),
            (VALUES, full(rf"(?:{EXPR}(?::{EXPR})?(?:,|\Z))*")),
            (FIELDS, full(rf";*(?:(?:a(?:,a)*{T}|\*?a(?:\.a)?)0?(?:;+|\Z))*")),
            (METHODS, full(rf";*(?:(?:a{SIG}|!?{T}(?:%!?{T})*)(?:;+|\Z))*")),
            (CASES, full(rf";*(?:(?:K(?:{SIMPLE}|{T}(?:,{T})*)|d):{STATEMENTS})*")),
        ],
    },
    full(rf";*(?:ka;+(?:M(?:{IMPORT}|{P[IMPORTS]});+)*(?:{TOP}(?:;+|\Z))*+)?"),
    spans={"comment": (re.compile(r"\*/"), ""), "raw": (re.compile("`"), "0")},
    opened={OPENED_COMMENT: "comment", OPENED_RAW: "raw"},
)
