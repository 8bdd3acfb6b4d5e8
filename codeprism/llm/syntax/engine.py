"""Token kinds, lexer-state maps and the bottom-up reduction of brackets.

A text is lexed into a string of kinds, one character per token. In that string every balanced
bracket whose inside holds no bracket any more is parsed by the local grammars of its language and
replaced by a few characters of the private-use area that say which parts it can play (statement block,
object, argument list, ...). Local grammars are therefore regular and are written as expressions over
kinds. What is left of a piece of a text after this reduction is short: its unmatched brackets and
what stands between them. Two neighbouring pieces are put together by concatenation and reduced again,
which is associative, so the pieces of a long file may be reduced anywhere and in any grouping.

A piece does not know whether it begins inside a comment, template or other token that runs over
lines. Its map therefore has an entry for each state it could begin in: (state at its end, residue).
Texts that are at hand as a whole are cut between tokens (``lines``), so that strings continued over a
line, templates in templates and raw strings stay whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Kinds common to all languages.
BAD, NEWLINE, SPACE = "\x00", "\n", ""
#: A group is written as the mark of its bracket, the parts that it can play in ascending order, and an end.
MARK, END_MARK, PART_BASE, MOST_PARTS = {"(": "\ue000", "[": "\ue001", "{": "\ue002"}, "\ue00f", 0xE010, 8
OPEN, CLOSE = "([{", {")": "(", "]": "[", "}": "{"}
BRACKET = re.compile(r"[()\[\]{}]")
KEPT, KEPT_LENGTH = 300_000, 96


def part(mask: int) -> str:
    return chr(PART_BASE + mask.bit_length() - 1)


def group(kind: str, mask: int | None = None) -> str:
    """Matches a group of a bracket kind that can play the part ``mask``, or any group of that kind."""
    low, high = chr(PART_BASE), chr(PART_BASE + MOST_PARTS - 1)
    if mask is None:
        return f"(?:{MARK[kind]}[{low}-{high}]*+{END_MARK})"
    before = f"[{low}-{part(mask >> 1)}]*+" if mask > 1 else ""
    after = f"[{part(mask << 1)}-{high}]*+" if part(mask) < high else ""
    return f"(?:{MARK[kind]}{before}{part(mask)}{after}{END_MARK})"


@dataclass
class Language:
    name: str
    token: re.Pattern  # finds every token; what it skips is blank
    classify: object  # token text -> kinds
    before: object  # kinds at one bracket level -> kinds without newlines
    parts: dict[str, list[tuple[int, re.Pattern]]]  # bracket -> (part, local grammar of the inside)
    program: re.Pattern
    spans: dict[str, tuple[re.Pattern, str]] = field(default_factory=dict)  # state -> (its end, kind of the token)
    opened: dict[str, str] = field(default_factory=dict)  # kind of an unended token -> state

    def __post_init__(self):
        outer = self

        class Kinds(dict):
            def __missing__(self, token):
                k = outer.classify(token)
                if len(token) <= 40:
                    if len(self) >= KEPT:
                        self.clear()
                    self[token] = k
                return k

        self.kinds = Kinds()
        self.groups: dict[str, str] = {}

    def lexed(self, text: str) -> str:
        return "".join(map(self.kinds.__getitem__, self.token.findall(text)))

    def lines(self, text: str) -> Iterator[int]:
        """Where lines begin between two tokens: a piece that begins there begins in no comment, string or template."""
        token, at = self.token if isinstance(self.token, re.Pattern) else self.token.pattern, 0
        for m in token.finditer(text):
            gap = text.rfind("\n", at, m.end() if m.group() == "\n" else m.start()) + 1
            if gap > at or gap and gap == m.end():
                yield gap
            at = m.end()

    def close(self, kind: str, inside: str) -> str:
        """The group of a bracket, BAD if its inside can play no part."""
        key = kind + inside
        got = self.groups.get(key)
        if got is None:
            flat = self.before(inside)
            can = "".join(part(p) for p, grammar in self.parts[kind] if grammar.fullmatch(flat))
            got = f"{MARK[kind]}{can}{END_MARK}" if can else BAD
            if len(key) <= KEPT_LENGTH:
                if len(self.groups) >= KEPT:
                    self.groups.clear()
                self.groups[key] = got
        return got

    def reduced(self, kinds: str) -> str:
        """``kinds`` with every balanced bracket replaced; BAD alone where that cannot end well."""
        if BAD in kinds:
            return BAD
        stack: list[tuple[str, list[str]]] = []
        level: list[str] = []
        at = 0
        for m in BRACKET.finditer(kinds):
            i, c = m.start(), m.group()
            if i > at:
                level.append(kinds[at:i])
            at = i + 1
            if c in OPEN:
                stack.append((c, level))
                level = []
            elif not stack:
                level.append(c)
            else:
                kind, outer = stack.pop()
                if kind != CLOSE[c]:
                    return BAD
                g = self.close(kind, "".join(level))
                if g == BAD:
                    return BAD
                level = outer
                level.append(g)
        level.append(kinds[at:])
        while stack:
            kind, outer = stack.pop()
            outer.append(kind)
            outer.extend(level)
            level = outer
        out = "".join(level)
        # a closing bracket left of an opening one of another piece may still meet its partner; not the reverse
        return out

    def piece(self, text: str) -> dict[str, tuple[str, str]]:
        """The map of a piece: state at its start -> (state at its end, residue)."""
        return {state: self._from(state, text) for state in ("", *self.spans)}

    def _from(self, state: str, text: str) -> tuple[str, str]:
        head = ""
        if state:
            end, head = self.spans[state]
            m = end.search(text)
            if not m:
                return state, ""
            text = text[m.end() :]
        kinds = self.lexed(text)
        after = ""
        if kinds and kinds[-1] in self.opened:
            after, kinds = self.opened[kinds[-1]], kinds[:-1]
        return after, self.reduced(head + kinds)

    def joined(self, a: dict[str, tuple[str, str]], b: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
        """The map of two neighbouring pieces; associative."""
        out = {}
        for state, (middle, left) in a.items():
            end, right = b[middle]
            out[state] = (end, BAD if BAD in (left, right) else self.reduced(left + right))
        return out

    def whole(self, state: str, residue: str) -> bool:
        """Whether a text that ends in this state with this residue is a program."""
        if state or BAD in residue or BRACKET.search(residue):
            return False
        return self.program.fullmatch(self.before(residue)) is not None

    def valid(self, text: str) -> bool:
        return self.whole(*self._from("", text))
