"""Splitting and rewriting the SQL expressions that users type."""

from __future__ import annotations

import re
from collections.abc import Callable

from gridsmith.errors import InvalidArgument

_OPEN, _CLOSE = "([{", ")]}"


def _top_level(text: str):
    """(position, character) outside quotes and brackets."""
    depth, quote = 0, ""
    for i, ch in enumerate(text):
        if quote:
            if ch == quote:
                quote = ""
        elif ch in "'\"`":
            quote = ch
        elif ch in _OPEN:
            depth += 1
        elif ch in _CLOSE:
            depth -= 1
        elif depth == 0:
            yield i, ch


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts of ``text`` between separators that stand outside quotes and brackets."""
    cuts = [i for i, ch in _top_level(text) if ch == sep]
    out, at = [], 0
    for i in [*cuts, len(text)]:
        out.append(text[at:i].strip())
        at = i + 1
    return out


def assignments(text: str) -> list[tuple[str, str]]:
    """``a=x, b=y`` as pairs; the first single ``=`` of a part divides it."""
    out = []
    for part in filter(None, split_top(text)):
        for i, ch in _top_level(part):
            if ch == "=" and part[i - 1 : i] not in ("<", ">", "!", "=") and part[i + 1 : i + 2] != "=":
                name, expr = part[:i].strip(), part[i + 1 :].strip()
                break
        else:
            name = expr = ""
        if not name or not expr:
            raise InvalidArgument(f"Expected name=expression, got {part!r}")
        out.append((name.strip('"'), expr))
    return out


def spark_sql(expr: str) -> str:
    """The expression with ``"column"`` written as Spark's `column`; string literals stay."""
    out, quote = [], ""
    for ch in expr:
        if quote == "'":
            quote = "" if ch == "'" else quote
        elif ch == "'" and not quote:
            quote = "'"
        elif ch == '"':
            ch = "`"
        out.append(ch)
    return "".join(out)


_TOKEN = re.compile(r"\s+|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|[^\W\d][\w.]*|<=>|<=|>=|<>|!=|\|\||::|.", re.S)
#: Words that part operands.
_WORDS = frozenset("and or not when then else end in is like ilike rlike between distinct from as asc desc nulls over partition order by rows range preceding following".split())


class _Divisions:
    """An expression written again, with each ``x / y`` given to ``divide``, the inner ones first."""

    def __init__(self, expr: str, divide: Callable[[str, str], str]):
        self.tokens, self.at, self.divide = [t for t in _TOKEN.findall(expr) if not t.isspace()], 0, divide

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def until(self, end: str) -> str:
        """Everything up to ``end`` (a bracket or a word), which is taken too unless it is empty."""
        out = []
        while (tok := self.peek()) and tok.lower() != end:
            if tok[0] in "'\"`(" or tok[0].isalnum() or tok[0] == "_":
                out.append(self.take() if tok.lower() in _WORDS else self.chain())
            else:
                out.append(self.take())
        if end and self.peek():
            self.take()
        return " ".join(out)

    def chain(self) -> str:
        """Operands joined by operators of the rank of division, from the left."""
        left = self.operand()
        while self.peek().lower() in ("*", "/", "%", "div"):
            op, right = self.take(), self.operand()
            left = self.divide(left, right) if op == "/" else f"{left} {op} {right}"
        return left

    def operand(self) -> str:
        tok = self.take() if self.peek() else ""
        if tok in ("-", "+", "~"):
            return tok + self.operand()
        if tok == "(":
            out = f"({self.until(')')})"
        elif tok.lower() == "case":
            out = f"CASE {self.until('end')} END"
        elif self.peek() == "(" and (tok[:1].isalpha() or tok[:1] == "_"):
            self.take()
            out = f"{tok}({self.until(')')})"
        else:
            out = tok
        while self.peek() in ("[", "::"):
            out += f"[{self.until(']')}]" if self.take() == "[" else f"::{self.operand()}"
        return out


def with_divisions(expr: str, divide: Callable[[str, str], str]) -> str:
    """``expr`` with each division written by ``divide(left, right)``."""
    return _Divisions(expr, divide).until("")
