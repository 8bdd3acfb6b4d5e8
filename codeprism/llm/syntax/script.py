"""Local grammars of JavaScript and TypeScript (annotations are allowed in both)."""

from __future__ import annotations

import re

from .engine import BAD, Language, group

# fixed values: reserved and contextual words of the language, by the kind they have in the grammar
WORDS = {
    "V": "var let const",
    "F": "function",
    "C": "class",
    "I": "if",
    "W": "while",
    "O": "for",
    "D": "do",
    "E": "else",
    "S": "switch",
    "K": "case",
    "d": "default",
    "T": "try",
    "H": "catch",
    "Y": "finally",
    "R": "return",
    "b": "break continue debugger",
    "X": "throw",
    "N": "new",
    "U": "typeof delete await",
    "w": "void",
    "y": "yield",
    "i": "in instanceof",
    "M": "import",
    "P": "export",
    "A": "async",
    "o": "of",
    "f": "from",
    "z": "as satisfies",
    "Z": "type",
    "J": "interface",
    "Q": "enum",
    "n": "namespace module global",
    "m": "public private protected static readonly override accessor get set",
    "l": "abstract declare",
    "x": "extends",
    "v": "implements",
    "k": "keyof infer is unique asserts",
    "L": "true false null this super",
}
KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
MARKS = {"=>": "⇒", "...": "…", "?.": ".", "++": "±", "--": "±", "!": "!", "~": "!", "+": "+", "-": "+", "=": "=", "*": "*", "<": "<", ">": ">", "|": "|", "&": "&", "?": "?", ":": ":", ";": ";", ",": ",", ".": ".", "@": "@"}
MARKS |= {c: c for c in "()[]{}"}
BINARY = {"/", "%", "^", "**", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", "<<"}
ASSIGN = {"+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
OPENED_COMMENT, OPENED_TEMPLATE = "\x01", "\x02"

REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"
STRINGS = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'"


def template(depth: int) -> str:
    """A template without its closing mark, whose braces may hold templates of one depth less."""
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\${braces(depth)})*+"


def braces(depth: int) -> str:
    inner = rf"|{template(depth - 1)}`|{braces(depth - 1)}" if depth else ""
    return rf"\{{(?:[^{{}}`\"'/]|{STRINGS}|//[^\n]*|/\*[\s\S]*?\*/|[\"'/]{inner})*+\}}"


TEMPLATE = template(3)
HOLES = re.compile(rf"\\[\s\S]|\$({braces(3)})")
TOKEN = re.compile(
    r"[A-Za-z_$ª-\U0010ffff][\w$‌‍]*"
    r"|\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
    r"|(?:=>|&&|\|\||\?\?|[-+*%=<>!&|^~?:,;(\[{])[ \t]*" + REGEX + r"|(?<![^\n])[ \t]*" + REGEX
    + r"|(?:return|typeof|case|in|of)(?![\w$])[ \t]+" + REGEX
    + r"|[()\[\]{},;]|\?\.(?!\d)|\.\.\.|=>|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*/%&|^]=|[<>]=|[=!]=|<<(?!<)"
    r"|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?n?(?![\w$])|0[xXbBoO][\da-fA-F_]+n?(?![\w$])|\.\d[\d_]*(?:[eE][+-]?\d+)?(?![\w$])"
    r"|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|" + TEMPLATE + r"`?"
    r"|\#[A-Za-z_$][\w$]*|[^\s﻿]"
)
LEAD = re.compile(r"(.*?)[ \t]*" + REGEX + r"\Z", re.S)


def classify(t: str) -> str:
    c = t[0]
    if t == "\n":
        return "\n"
    if c.isalpha() or c in "_$":
        if (c.isalnum() or c in "_$") and not t.endswith("/") and "/" not in t:
            return KIND.get(t, "a")
        return KIND.get(t.split()[0], "a") + "r"
    if t.startswith("//"):
        return ""
    if t.startswith("/*"):
        return ("\n" if "\n" in t else "") if len(t) > 3 and t.endswith("*/") else OPENED_COMMENT
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        return "0"
    if c in "\"'":
        return "s" if len(t) > 1 and t[-1] == c else BAD
    if c == "`":
        if len(t) < 2 or t[-1] != "`":
            return OPENED_TEMPLATE
        return "t" if "${" not in t or all(expression(m.group(1)[1:-1]) for m in HOLES.finditer(t, 1, len(t) - 1) if m.group(1)) else BAD
    if c == "#":
        return "a" if len(t) > 1 else BAD
    if t in MARKS:
        return MARKS[t]
    if t in BINARY:
        return "%"
    if t in ASSIGN:
        return "≔"
    if c.isspace() or c == "/":
        return "r"
    if m := LEAD.match(t):
        return classify(m.group(1)) + "r"
    return BAD


def expression(text: str) -> bool:
    """Whether what stands in the braces of a template is an expression, or a type."""
    kinds = LANGUAGE.reduced(LANGUAGE.lexed(text))
    return BAD not in kinds and FILLING.fullmatch(before(kinds)) is not None


# parts of brackets
ARGS, PAREN, PARAMS, HEAD, TPAREN = 1, 2, 4, 8, 16
LIST, TLIST = 1, 2
BLOCK, OBJECT, CLASS, TYPE, SPECIFIERS, ENUM, CASES = 1, 2, 4, 8, 16, 32, 64
P = {p: group("(", p) for p in (ARGS, PAREN, PARAMS, HEAD, TPAREN)}
B = {p: group("[", p) for p in (LIST, TLIST)}
G = {p: group("{", p) for p in (BLOCK, OBJECT, CLASS, TYPE, SPECIFIERS, ENUM, CASES)}

ID = "[aAofzZJQnmlkv]"
NAME = "[A-Za-z0st]|" + B[LIST]
# types are told by what they are made of: no two names side by side
TUNIT = rf"(?:[kUNmlA+!.|&x?:¿⇒Lw0stMGi-]|…|{ID}(?!{ID})|{P[TPAREN]}|{P[PARAMS]}|{B[TLIST]}|{G[TYPE]})"
TYPEX = rf"(?:{TUNIT}+)"
NOTE = rf"(?:[?!]?[:¿]{TYPEX})?"
ARROW = rf"A?(?:{ID}|G?{P[PARAMS]}{NOTE})⇒"
FUNC = rf"A?F\*?{ID}?G?{P[PARAMS]}{NOTE}{G[BLOCK]}"
DECO = rf"(?:@{ID}(?:\.[A-Za-z])*(?:{P[ARGS]})?)*"
ATOM = rf"(?:{FUNC}|{DECO}C{ID}?G?(?:x(?:{ID}|L)(?:\.[A-Za-z]|{P[ARGS]})*G?)?(?:v{TYPEX}(?:,{TYPEX})*)?{G[CLASS]}|{ID}|[L0str]|{P[PAREN]}|{B[LIST]}|{G[OBJECT]}|(?<=⇒){G[BLOCK]}|M(?={P[ARGS]}|\.)|N\.a)"
POST = rf"(?:\.[A-Za-z]|\.(?={P[ARGS]}|{B[LIST]})|G?{P[ARGS]}|G(?=t)|{B[LIST]}|t|±|!(?![=≔])|z{TYPEX}|G(?=[;,]|\Z))"
UNARY = rf"(?:{ARROW}|[!+Uwy*N]|±)"
EXPR1 = rf"(?:{UNARY}*{ATOM}{POST}*+|y)"
EXPR = rf"(?:{EXPR1}(?:(?:[%*|&+<i=≔¿]|>{{1,3}}(?![>])){EXPR1})*)"
SEQ = rf"(?:{EXPR}(?:,{EXPR})*)"
ITEM = rf"(?:…?{EXPR})?"
ITEMS = rf"(?:{ITEM}(?:,{ITEM})*)"
BIND = rf"(?:{ID}|{B[LIST]}|{G[OBJECT]})!?{NOTE}(?:={EXPR})?"
DECL = rf"V(?:{BIND})(?:,{BIND})*"
PARAM = rf"(?:{DECO}[ml]*…?(?:{ID}|L|{B[LIST]}|{G[OBJECT]})\??{NOTE}(?:={EXPR})?)"
TPARAM = rf"(?:…?(?:{ID}|L|{B[LIST]}|{G[OBJECT]})\??:)?…?{TYPEX}\??"
END = r"(?:;|\Z)"
METHOD = rf"[mlA]*\*?(?:{NAME})[?¿]?!?G?{P[PARAMS]}{NOTE}"
DECLARATION = (
    rf"(?:A?F\*?{ID}G?{P[PARAMS]}{NOTE}(?:{G[BLOCK]}|{END})"
    rf"|{DECO}l*C{ID}?G?(?:x{EXPR1}G?)?(?:v{TYPEX}(?:,{TYPEX})*)?{G[CLASS]}"
    rf"|J{ID}G?(?:x{TYPEX}(?:,{TYPEX})*)?{G[TYPE]}|Z{ID}G?={TYPEX}{END}|V?Q{ID}{G[ENUM]}|n(?:{ID}(?:\.{ID})*|s)?{G[BLOCK]}|{DECL}{END})"
)
STATEMENT = (
    rf"(?:I{P[PAREN]}|E|W{P[PAREN]}|OU?{P[HEAD]}|D|{ID}:)*"
    rf"(?:;|{G[BLOCK]}|l*{DECLARATION}|S{P[PAREN]}{G[CASES]}|T{G[BLOCK]}(?:H{P[PARAMS]}?{G[BLOCK]}(?:Y{G[BLOCK]})?|Y{G[BLOCK]})"
    rf"|R{SEQ}?{END}|b{ID}?{END}|X{SEQ}{END}|W{P[PAREN]}{END}"
    rf"|M(?:s|Z?(?:{ID}(?:,(?:{G[SPECIFIERS]}|\*z{ID}))?|{G[SPECIFIERS]}|\*z{ID})fs)(?:(?:{ID}|W){G[OBJECT]})?{END}|MZ?{ID}={SEQ}{END}"
    rf"|{DECO}P(?:d(?:l*C{ID}?G?(?:x{EXPR1}G?)?{G[CLASS]}|A?F\*?{ID}?G?{P[PARAMS]}{NOTE}{G[BLOCK]}|{EXPR}{END}|J{ID}G?{G[TYPE]})|Z?{G[SPECIFIERS]}(?:fs)?{END}|Z?\*(?:z{ID})?fs{END}|l*{DECLARATION}|={EXPR}{END}|z n{ID}{END})"
    rf"|(?!V|F|C[^A-Za-z]|{G[OBJECT]}){SEQ}{END}|V{ID}(?=[.]){SEQ}{END})"
)
STATEMENTS = rf"(?:{STATEMENT})*+"
PROPERTY = rf"(?:(?:{NAME}):{EXPR}|{ID}(?:={EXPR})?|…{EXPR}|{METHOD}{G[BLOCK]})"
MEMBER = rf"(?:;|m?{G[BLOCK]}|{DECO}(?:{METHOD}(?:{G[BLOCK]}|{END})|[ml]*{B[LIST]}:{TYPEX}{END}|[ml]*(?:{NAME})[?!]?{NOTE}(?:={EXPR})?{END}))"
TMEMBER = rf"(?:(?:m|\+)*(?:{NAME})(?:\+?[?¿])?(?:G?{P[PARAMS]})?{NOTE}|N?G?{P[PARAMS]}{NOTE}|m?(?:{B[LIST]}|{B[TLIST]})(?:\+?\?)?:{TYPEX})"

SOFT = re.compile(r"(?<=[A-Za-z0-9±>G\ue00f])(?<![IWODESTYMPNUwiVFCKxvkz])\n+(?=[A-Za-z0-9!@±…])(?![iEHYzxvof])")
TERNARY = re.compile(r"\?([^?:;,]+):")
AFTER_DOT = re.compile(r"\.([A-Za-z])")
TYPEISH = re.compile(rf"(?:(?<=[A-Za-z])|(?<=[=(,:⇒?{{\ue000-\ue002])|\A)<((?:[A-Za-z0,.|&?:=\n⇒…]|{B[TLIST]}|{G[TYPE]}|{P[PARAMS]}|{P[TPAREN]})*)>(?=[-,;=>)\n|&?.A-Za-z\ue000-\ue002]|\Z)")


def before(k: str) -> str:
    if "." in k:
        k = AFTER_DOT.sub(".a", k)
    if "<" in k:
        n = 1
        while n:
            k, n = TYPEISH.subn("G", k)
    if "\n" in k:
        k = SOFT.sub(";", k).replace("\n", "")
    if "?" in k:
        n = 1
        while n:
            k, n = TERNARY.subn("¿\\1¿", k)
    return k


def full(x: str) -> re.Pattern:
    return re.compile(x)


FILLING = full(rf"{SEQ}|{TYPEX}")


LANGUAGE = Language(
    "script",
    TOKEN,
    classify,
    before,
    {
        "(": [
            (ARGS, full(ITEMS)),
            (PAREN, full(SEQ)),
            (PARAMS, full(rf"(?:{PARAM}(?:,{PARAM})*,?)?")),
            (HEAD, full(rf"V?(?:{BIND}|{EXPR1})[oi]{SEQ}|(?:{DECL}|{SEQ})?;{SEQ}?;{SEQ}?")),
            (TPAREN, full(rf"(?:{TPARAM}(?:,{TPARAM})*,?)?")),
        ],
        "[": [(LIST, full(ITEMS)), (TLIST, full(rf"(?:{TPARAM}(?:,{TPARAM})*,?)?"))],
        "{": [
            (BLOCK, full(STATEMENTS)),
            (OBJECT, full(rf"(?:{PROPERTY}(?:,{PROPERTY})*,?)?")),
            (CLASS, full(rf"(?:{MEMBER})*+")),
            (TYPE, full(rf"(?:[;,]*{TMEMBER}(?:[;,]+{TMEMBER})*)?[;,]*")),
            (SPECIFIERS, full(r"(?:Z?[A-Za-z](?:z[A-Za-z]|:[A-Za-z])?(?:,Z?[A-Za-z](?:z[A-Za-z])?)*,?)?")),
            (ENUM, full(rf"(?:[as](?:={EXPR})?(?:,[as](?:={EXPR})?)*,?)?")),
            (CASES, full(rf"(?:(?:K{SEQ}|d):(?:{STATEMENT})*;*)*")),
        ],
    },
    full(STATEMENTS),
    spans={"comment": (re.compile(r"\*/"), ""), "template": (re.compile(r"(?:[^`\\]|\\[\s\S])*?`"), "t")},
    opened={OPENED_COMMENT: "comment", OPENED_TEMPLATE: "template"},
)
