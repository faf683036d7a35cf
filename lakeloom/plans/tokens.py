"""Tokens of the SQL dialect, and their nesting."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_LEX = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
      | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      | (?P<param>\$\d+)
      | (?P<word>[^\W\d][\w$@]*)
      | (?P<op>::|\|\||<>|!=|<=|>=|=>|->|!~\*|!~|~\*|[-+*/%<>=~(){}\[\],.;:?&|^!@\#])""",
    re.X | re.S,
)
#: Deeper nesting than this is refused.
MAX_DEPTH = 400


@dataclass
class Node:
    """A token, or a bracketed group of nodes (kind '(' or '[')."""

    kind: str
    text: str = ""
    items: list[Node] = field(default_factory=list)

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind == "word" else ""

    def name(self) -> str:
        return self.text[1:-1].replace(self.text[0] * 2, self.text[0]) if self.kind == "quoted" else self.text


class DialectError(ValueError):
    """SQL text that the dialect does not allow."""


def lex(sql: str) -> list[Node]:
    out, at = [], 0
    while at < len(sql):
        m = _LEX.match(sql, at)
        if m is None:
            raise DialectError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Node(m.lastgroup, m[0]))
        at = m.end()
    return out


def nest(tokens: list[Node]) -> list[Node]:
    top: list[Node] = []
    stack, opened = [top], []
    for t in tokens:
        if t.kind == "op" and t.text in "([":
            group = Node(t.text)
            stack[-1].append(group)
            stack.append(group.items)
            opened.append(t.text)
            if len(stack) > MAX_DEPTH:
                raise DialectError("expression is nested too deeply")
        elif t.kind == "op" and t.text in ")]":
            if not opened or {"(": ")", "[": "]"}[opened.pop()] != t.text:
                raise DialectError(f"unbalanced {t.text}")
            stack.pop()
        else:
            stack[-1].append(t)
    if opened:
        raise DialectError(f"unbalanced {opened[-1]}")
    return top


def parse(sql: str) -> list[Node]:
    return nest(lex(sql))


def split(items: list[Node], by: str = ",") -> list[list[Node]]:
    """Items between top-level operators ``by``; no items give no parts."""
    if not items:
        return []
    out: list[list[Node]] = [[]]
    for x in items:
        if x.kind == "op" and x.text == by:
            out.append([])
        else:
            out[-1].append(x)
    return out


def literal(text: str) -> str:
    """A string literal for Spark, which reads backslashes as escapes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def unquoted(node: Node) -> str:
    """The value of a string token."""
    return node.text[1:-1].replace("''", "'")


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
