r"""The chat template: ``<turn ROLE>``, a line break, the text, ``</turn>``, a line break.

Inside roles and texts a backslash is doubled and a control string gets a backslash before its ``<``, so no
text can end a turn or begin one, and reading undoes exactly that. A role's ``>`` gets a backslash too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

END = "</turn>\n"

_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(?=/?turn)", r"\\<")


def head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escape(role), F.lit(">"), F.lit("\\>")), F.lit(">\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, start and end of the escaped text of each turn; an error if the string is anything else."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns
