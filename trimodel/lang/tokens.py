"""Text to tokens. Lines are split first, so that indentation is a matter of whole lines rather than of characters."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Alternatives in order; a character that none takes is skipped.
_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*)
      | (?P<string>"[^"]*"|'[^']*')
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<param>\$[A-Za-z0-9_]+|:[A-Za-z_][A-Za-z0-9_]*)
      | (?P<op>!=|<=|>=|\+=|-=|[=<>+\-*/%.,()\[\]{}])
      | (?P<open>["'])
      | (?P<skip>\s+|.)""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    """kind: word, string, number, param, op, newline, indent, dedent or end."""

    kind: str
    text: str
    line: int
    column: int


def _depth(line: str) -> int:
    """Columns of indentation; a tab counts four."""
    blank = line[: len(line) - len(line.lstrip(" \t\r"))]
    return blank.count(" ") + 4 * blank.count("\t")


def tokenize(text: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens, and errors as (line, column, message). Line ends inside brackets don't count."""
    out: list[Token] = []
    errors: list[tuple[int, int, str]] = []
    levels, brackets = [0], 0
    lines = text.split("\n")
    open_line = ""
    for number, line in enumerate(lines, 1):
        line = open_line + line
        found = [m for m in _TOKEN.finditer(line) if m.lastgroup not in ("skip", "comment")]
        if any(m.lastgroup == "open" for m in found) and number < len(lines):  # a string goes on in the next line
            open_line = line + "\n"
            continue
        open_line = ""
        if not found:
            continue
        if not brackets:
            depth = _depth(line)
            if out:
                out.append(Token("newline", "\n", number, 1))
            if depth > levels[-1] and out:
                levels.append(depth)
                out.append(Token("indent", "", number, 1))
            while depth < levels[-1]:
                levels.pop()
                out.append(Token("dedent", "", number, 1))
        for m in found:
            if m.lastgroup == "open":
                errors.append((number, m.start() + 1, "unterminated string"))
                break
            if m.group() in "([{":
                brackets += 1
            elif m.group() in ")]}":
                brackets = max(0, brackets - 1)
            body = m.group()[1:-1] if m.lastgroup == "string" else m.group()
            out.append(Token(m.lastgroup, body, number, m.start() + 1))
    last = text.count("\n") + 1
    out.append(Token("newline", "\n", last, 1))
    out += [Token("dedent", "", last, 1) for _ in levels[1:]]
    out.append(Token("end", "", last, 1))
    return out, errors
