"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from strata.errors import StrataError


@dataclass(frozen=True)
class Token:
    kind: str  # word, number, text, sign, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


# A minus directly before a digit or a dot belongs to the number.
_SCAN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      | (?P<number>-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<text>'(?:[^']|'')*')
      | (?P<sign>->>|<>|!=|<=|>=|\|\||[-+*/(),.;=<>?])""",
    re.VERBOSE,
)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _SCAN.match(sql, at)
        if not m:
            what = "an open string" if sql[at] == "'" else f"{sql[at]!r}"
            raise StrataError("PARSE_ERROR", f"unexpected {what} at position {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "text":
            out.append(Token(kind, text[1:-1].replace("''", "'"), at))
        elif kind != "space":
            out.append(Token(kind, "!=" if text == "<>" else text, at))
        at = m.end()
    out.append(Token("end", "", len(sql)))
    return out
