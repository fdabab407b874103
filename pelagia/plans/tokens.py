"""A small SQL tokenizer for the dialect rewrites."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)"""
    r"""|(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?:[DdLl](?![A-Za-z_0-9]))?)|(?P<param>\$\d+)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)"""
    r"""|(?P<op>::|<>|!=|<=|>=|\|\||->|=>|[-+*/%(),.;<>=\[\]{}:?@&|^~!])""",
    re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Token]:
    """Tokens without spaces and comments; double-quoted names become backquoted ones."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ValueError(f"SQL: unexpected {sql[at]!r} at {at}")
        at = m.end()
        kind = m.lastgroup
        if kind == "space":
            continue
        text = m[0]
        if kind == "quoted" and text[0] == '"':
            text = "`" + text[1:-1].replace('""', '"').replace("`", "``") + "`"
        out.append(Token(kind, text))
    return out


def render(tokens: list[Token]) -> str:
    out: list[str] = []
    for i, t in enumerate(tokens):
        tight = t.text in (".", ",", ")", "]", "::") or i and tokens[i - 1].text in (".", "(", "[", "::")
        call = t.text == "(" and i and tokens[i - 1].kind in ("word", "quoted") and tokens[i - 1].up not in _BEFORE_PAREN
        if out and not tight and not call:
            out.append(" ")
        out.append(t.text)
    return "".join(out)


_BEFORE_PAREN = {"IN", "AS", "AND", "OR", "NOT", "FROM", "JOIN", "SELECT", "WHERE", "BY", "ON", "VALUES", "OVER", "UNION", "ALL", "EXCEPT", "INTERSECT", "EXISTS", "WHEN", "THEN", "ELSE", "HAVING", "USING"}


def name_of(t: Token) -> str:
    return t.text[1:-1].replace("``", "`") if t.kind == "quoted" else t.text


def string_of(t: Token) -> str:
    return t.text[1:-1].replace("''", "'")


def closing(tokens: list[Token], i: int) -> int:
    """Index of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].text in ("(", "["):
            depth += 1
        elif tokens[j].text in (")", "]"):
            depth -= 1
            if not depth:
                return j
    raise ValueError("SQL: a bracket is not closed")


def split_top(tokens: list[Token], at: str = ",") -> list[list[Token]]:
    """Parts between separators outside brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        depth += t.text in ("(", "[")
        depth -= t.text in (")", "]")
        if t.text == at and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def find_top(tokens: list[Token], *words: str, start: int = 0) -> int:
    """Index of the first of these words outside brackets, or -1."""
    depth = 0
    for i in range(start, len(tokens)):
        t = tokens[i]
        if not depth and t.kind == "word" and t.up in words:
            return i
        depth += t.text in ("(", "[")
        depth -= t.text in (")", "]")
    return -1
