"""Local grammars of JSON."""

from __future__ import annotations

import re

from .engine import BAD, Language, group

TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w)|[^ \t\r\n]', re.A)
MARKS = set("()[]{},:")
VALUE, OBJECT, ARRAY = "[sv]", 1, 1


def classify(t: str) -> str:
    if t[0] == '"':
        return "s" if len(t) > 1 else BAD
    if len(t) > 1 or t.isascii() and t.isdigit():
        return "v"
    return t if t in MARKS else BAD


def before(kinds: str) -> str:
    return kinds


ANY = rf"(?:{VALUE}|{group('{', OBJECT)}|{group('[', ARRAY)})"
LANGUAGE = Language(
    "json",
    TOKEN,
    classify,
    before,
    {"(": [], "[": [(ARRAY, re.compile(rf"(?:{ANY}(?:,{ANY})*+)?"))], "{": [(OBJECT, re.compile(rf"(?:s:{ANY}(?:,s:{ANY})*+)?"))]},
    re.compile(rf"{ANY}?"),
)
