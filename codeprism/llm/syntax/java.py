"""Local grammars of Java."""

from __future__ import annotations

import re

from .engine import BAD, Language, group

# fixed values: keywords of the language, by their kind
WORDS = {"k": "package", "M": "import", "m": "public private protected static final abstract native synchronized transient volatile strictfp sealed", "C": "class", "J": "interface", "Q": "enum", "c": "record", "x": "extends", "v": "implements permits", "t": "throws", "p": "boolean byte char short int long float double void", "V": "var", "N": "new", "I": "if", "E": "else", "O": "for", "W": "while", "D": "do", "S": "switch", "K": "case", "d": "default", "T": "try", "H": "catch", "Y": "finally", "R": "return", "b": "break continue", "X": "throw", "A": "assert", "i": "instanceof", "L": "true false null this super", "y": "yield"}
KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
BINARY = {"/", "%", "^", "||", "&&", "==", "!=", "<=", ">=", "<<", "|", "*"}
ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
SINGLE = {"+": "+", "-": "+", "!": "!", "~": "!", "&": "&", "++": "±", "--": "±", "...": "…", "->": "→", "::": "∷", "<": "<", ">": ">", "=": "=", "?": "?", ":": ":", ";": ";", ",": ",", ".": ".", "@": "@"} | {c: c for c in "()[]{}"}
OPENED_COMMENT, OPENED_TEXT = "\x01", "\x02"

TOKEN = re.compile(
    r"[A-Za-z_$ª-\U0010ffff][\w$]*|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|[()\[\]{},;]|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||<<|[-+*/%&|^=!<>]="
    r"|0[xXbB][\da-fA-F_]+[lL]?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[lLfFdD]?(?![A-Za-z_])|\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?"
    r"|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\")?|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\(?:[btnfrs\\'\"]|[0-7]{1,3}|u+[\da-fA-F]{4}))'|[^\s﻿]"
)


def classify(t: str) -> str:
    c = t[0]
    if c.isalpha() or c in "_$":
        return KIND.get(t, "a")
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return "" if len(t) > 3 and t.endswith("*/") else OPENED_COMMENT
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        return "0"
    if t.startswith('"""'):
        return "0" if len(t) > 5 and t.endswith('"""') else OPENED_TEXT
    if c in "\"'":
        return "0" if len(t) > 1 and t[-1] == c else BAD
    return SINGLE.get(t) or ("%" if t in BINARY else "≔" if t in ASSIGN else BAD)


ARGS, PARAMS, HEAD, CAST, ANNOT, LAMBDA, RESOURCES = 1, 2, 4, 8, 16, 32, 64
INDEX, DIMS = 1, 2
BLOCK, CLASS, VALUES, ENUM, CASES, ARROWS = 1, 2, 4, 8, 16, 32
P = {p: group("(", p) for p in (ARGS, PARAMS, HEAD, CAST, ANNOT, LAMBDA, RESOURCES)}
B = {p: group("[", p) for p in (INDEX, DIMS)}
G = {p: group("{", p) for p in (BLOCK, CLASS, VALUES, ENUM, CASES, ARROWS)}

ID = "[aVcy]"
AT = rf"(?:@a(?:\.a)*{P[ANNOT]}?)*"
TYPE = rf"(?:{AT}(?:p|V|{ID}g?(?:\.{AT}{ID}g?)*)(?:{B[DIMS]})*)"
MODS = rf"(?:@a(?:\.a)*{P[ANNOT]}?|m|d)*"
LAMB = rf"(?:{ID}|{P[LAMBDA]})→"
NEW = rf"N(?:{AT}(?:p|{ID}g?(?:\.{ID}g?)*))(?:{P[ARGS]}{G[CLASS]}?|(?:{B[INDEX]}|{B[DIMS]})+{G[VALUES]}?)"
SWITCH = rf"S{P[ARGS]}(?:{G[CASES]}|{G[ARROWS]})"
ATOM = rf"(?:{NEW}|{SWITCH}|{TYPE}∷(?:a|N)|(?:p(?:{B[DIMS]})*|{ID}(?:{B[DIMS]})+)\.C|{ID}|[L0]|{P[ARGS]}|(?<=→){G[BLOCK]})"
POST = rf"(?:\.g?{ID}|\.[LC]|\.{NEW}|{P[ARGS]}|{B[INDEX]}|±|∷g?(?:a|N)|im?{TYPE}{ID}?)"
EXPR1 = rf"(?:(?:[!+±]|{LAMB}|{P[CAST]}(?=[aVcyL0N!-S]))*{ATOM}{POST}*+)"
EXPR = rf"(?:{EXPR1}(?:(?:[%+&<=≔?:]|>{{1,3}}){EXPR1})*)"
LIST = rf"(?:{EXPR}(?:,{EXPR})*)"
INIT = rf"(?:{EXPR}|{G[VALUES]})"
DECLS = rf"{ID}(?:{B[DIMS]})*(?:={INIT})?(?:,{ID}(?:{B[DIMS]})*(?:={INIT})?)*"
LOCAL = rf"(?:@a(?:\.a)*{P[ANNOT]}?|m)*{TYPE}{DECLS}"
TYPES = rf"{TYPE}(?:[,&]{TYPE})*"
KINDX = (
    rf"(?:C{ID}g?(?:x{TYPE})?(?:v{TYPES})*{G[CLASS]}|J{ID}g?(?:[xv]{TYPES})*{G[CLASS]}|Q{ID}(?:v{TYPES})?{G[ENUM]}|c{ID}g?{P[PARAMS]}(?:v{TYPES})?{G[CLASS]}|@J{ID}{G[CLASS]})"
)
PARAM = rf"(?:(?:@a(?:\.a)*{P[ANNOT]}?|m)*{TYPE}(?:…)?(?:{ID}|L)(?:{B[DIMS]})*)"
STATEMENT = (
    rf"(?:(?:I{P[ARGS]}|E|W{P[ARGS]}|O{P[HEAD]}|D|{ID}:)*(?:;|{G[BLOCK]}|{LOCAL};|m*{KINDX}|{SWITCH}(?![.])|T{P[RESOURCES]}?{G[BLOCK]}(?:H{P[PARAMS]}{G[BLOCK]})*(?:Y{G[BLOCK]})?"
    rf"|m{P[ARGS]}{G[BLOCK]}|R{EXPR}?;|b{ID}?;|[Xy]{EXPR};|A{EXPR};|{EXPR};))"
)
STATEMENTS = rf"(?:{STATEMENT})*+"
MEMBER = (
    rf"(?:;|m?{G[BLOCK]}|{MODS}(?:{KINDX}|g?{TYPE}{ID}{P[PARAMS]}(?:{B[DIMS]})*(?:t{TYPES})?(?:{G[BLOCK]}|(?:d{INIT})?;)|g?{ID}{P[PARAMS]}(?:t{TYPES})?{G[BLOCK]}|{ID}{G[BLOCK]}|{TYPE}{DECLS};))"
)
CONSTANT = rf"{AT}{ID}{P[ARGS]}?{G[CLASS]}?"
LABEL = rf"(?:K(?:{LIST}|(?:{TYPE}{ID}|{ID}{P[ARGS]})(?:,{LIST})?)|K?d)"
GENERICS = re.compile(rf"(?:(?<=[aVcymd.N])|(?<=[;,∷])|\A)<((?:[aVcypg.,?x&@L]|{B[DIMS]}|v)*)>")


AFTER_DOT = re.compile(r"\.[cvmyV]")


def before(k: str) -> str:
    if "." in k:
        k = AFTER_DOT.sub(".a", k)  # contextual words are names after a dot
    if "<" in k:
        n = 1
        while n:
            k, n = GENERICS.subn("g", k)
    return k


def full(x: str) -> re.Pattern:
    return re.compile(x)


LANGUAGE = Language(
    "java",
    TOKEN,
    classify,
    before,
    {
        "(": [
            (ARGS, full(rf"{LIST}?")),
            (PARAMS, full(rf"(?:{PARAM}(?:,{PARAM})*)?|m*{TYPE}(?:%{TYPE})*{ID}")),
            (HEAD, full(rf"m*{TYPE}{ID}:{EXPR}|(?:{LOCAL}|{LIST})?;{EXPR}?;{LIST}?")),
            (CAST, full(rf"{TYPE}(?:&{TYPE})*")),
            (ANNOT, full(rf"(?:(?:{ID}=)?(?:{INIT}|@a(?:\.a)*{P[ARGS]}?)(?:,(?:{ID}=)?(?:{INIT}|@a(?:\.a)*{P[ARGS]}?))*)?")),
            (LAMBDA, full(rf"(?:{ID}(?:,{ID})*|{PARAM}(?:,{PARAM})*)?")),
            (RESOURCES, full(rf"(?:{LOCAL}|{EXPR})(?:;(?:{LOCAL}|{EXPR}))*;?")),
        ],
        "[": [(INDEX, full(EXPR)), (DIMS, full(""))],
        "{": [
            (BLOCK, full(STATEMENTS)),
            (CLASS, full(rf"(?:{MEMBER})*+")),
            (VALUES, full(rf"(?:(?:{INIT}|@a{P[ARGS]}?)(?:,(?:{INIT}|@a{P[ARGS]}?))*,?)?")),
            (ENUM, full(rf"(?:{CONSTANT}(?:,{CONSTANT})*,?)?(?:;(?:{MEMBER})*)?")),
            (CASES, full(rf"(?:(?:{LABEL}:)+{STATEMENTS})*")),
            (ARROWS, full(rf"(?:{LABEL}→(?:{G[BLOCK]}|X?{EXPR};))*")),
        ],
    },
    full(rf"(?:{AT}ka(?:\.a)*;)?(?:;|Mm?a(?:\.a)*(?:\.%)?;)*(?:;|{MODS}{KINDX})*"),
    spans={"comment": (re.compile(r"\*/"), ""), "text": (re.compile(r'(?:[^\\]|\\[\s\S])*?"""'), "0")},
    opened={OPENED_COMMENT: "comment", OPENED_TEXT: "text"},
)
