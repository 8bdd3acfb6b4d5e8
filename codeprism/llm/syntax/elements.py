"""Elements of JSX: each becomes a list of the expressions that stand in its braces, which the script grammars know."""

from __future__ import annotations

import re

from .script import STRINGS, TEMPLATE

NAME = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?\s*")
TYPED = re.compile(r"<[\w$.,\s\[\]]*>(?=\s*[\"'{/>\w])")  # type arguments of an element
ATTRIBUTE = re.compile(r"([A-Za-z_$][\w$:.-]*)\s*(=\s*)?")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
CLOSE = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>")
SPACE = re.compile(r"\s*")
HIDDEN = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|{STRINGS}|{TEMPLATE}`")
#: What an element may follow, so that it is no comparison and no type.
PLACE = re.compile(r"(?:[=(,:?\[{&|;>}]|\breturn|\bdefault|\byield|\bcase)[ \t\r\n]*\Z")
STOP = re.compile(r"[{}<\"'`/]")


class _Broken(Exception):
    pass


def element(text: str, at: int) -> tuple[int, list[str]]:
    """(end, expressions in braces) of the element that begins at ``at``."""
    m = NAME.match(text, at)
    name, holes, at = m.group(1), [], m.end()
    if name and (t := TYPED.match(text, at)):
        at = t.end()
    while True:
        at = SPACE.match(text, at).end()
        c = text[at : at + 1]
        if c == ">":
            at += 1
            break
        if text.startswith("/>", at) and name:
            return at + 2, holes
        if c == "{" and name:
            at, inner = hole(text, at)
            holes.append(inner)
        elif name and (m := ATTRIBUTE.match(text, at)):
            at = m.end()
            if m.group(2):
                if q := QUOTED.match(text, at):
                    at = q.end()
                elif text.startswith("{", at):
                    at, inner = hole(text, at)
                    holes.append(inner or ")")  # an attribute without a value is an error
                elif text.startswith("<", at):
                    at, more = element(text, at)
                    holes += more
                else:
                    raise _Broken
        else:
            raise _Broken
    while True:
        here = min((i for i in (text.find("<", at), text.find("{", at)) if i >= 0), default=-1)
        if here < 0 or any(c in text[at:here] for c in ">}"):
            raise _Broken
        if text[here] == "{":
            at, inner = hole(text, here)
            holes.append(inner)
        elif m := CLOSE.match(text, here):
            if m.group(1) != name:
                raise _Broken
            return m.end(), holes
        else:
            at, more = element(text, here)
            holes += more


def hole(text: str, at: int) -> tuple[int, str]:
    """(end, expression) of the braces that open at ``at``, elements in it replaced."""
    out, depth, at = [], 0, at + 1
    while m := STOP.search(text, at):
        i, c = m.start(), m.group()
        out.append(text[at:i])
        at = i + 1
        if c == "}" and not depth:
            inner = "".join(out)
            return at, inner if HIDDEN.sub("", inner).strip() else ""
        depth += (c == "{") - (c == "}")
        if c == "<" and (not "".join(out).strip() or PLACE.search("".join(out)[-80:])) and NAME.match(text, i).end() > i + 1 - (text[i + 1 : i + 2] == ">"):
            at, holes = element(text, i)
            out.append("[" + ",".join(holes) + "]")
        elif h := HIDDEN.match(text, i) if c not in "{}<" else None:
            at = h.end()
            out.append(h.group())
        else:
            out.append(c)
    raise _Broken


def without_elements(text: str) -> str:
    """``text`` with the elements in it replaced; what cannot be read as an element stays as it is."""
    if "</" not in text and "/>" not in text:
        return text
    out, at = [], 0
    while m := re.compile(r"<(?=[A-Za-z_$>])|[\"'`/]").search(text, at):
        i = m.start()
        out.append(text[at:i])
        at = i + 1
        if m.group() != "<":
            h = HIDDEN.match(text, i)
            out.append(h.group() if h else m.group())
            at = h.end() if h else at
            continue
        end = None
        if PLACE.search(HIDDEN.sub("", "".join(out[-4:]))[-80:]):
            try:
                end, holes = element(text, i)
            except (_Broken, RecursionError):
                end = None
        if end is None:
            out.append("<")
        else:
            out.append("[" + ",".join(holes) + "]")
            at = end
    return "".join(out) + text[at:]
