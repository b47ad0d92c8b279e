"""Explanation texts, as SQL. Numbers are rounded from the exact value of the double, ties to the even digit.

``format_number`` with a pattern does that in the JVM; ``format_string`` would round the shortest
decimal form half up (0.125 to 0.13, 1.005 to 1.01). Numbers of 16 digits and more before the rounding
are beyond what a double tells apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"%(?:(\+?)\.(\d)f|(s)|(%))")


def number(value: str, decimals: int, signed: bool = False) -> str:
    """A number of so many decimals, without separators; signed ones show their plus."""
    digits = "0" if decimals == 0 else "0." + "0" * decimals
    return f"format_number({value}, '{f'+{digits};-{digits}' if signed else digits}')"


def worded(template: str, *values: str) -> str:
    """A text with fields as in C (``%.2f``, ``%+.1f``, ``%s``, ``%%``), one SQL expression each; null if one is."""
    parts, at, left = [], 0, list(values)
    for field in _FIELD.finditer(template):
        parts.append(repr(template[at : field.start()]))
        at = field.end()
        plus, decimals, word, percent = field.groups()
        if percent:
            parts.append("'%'")
        elif word:
            parts.append(left.pop(0))
        else:
            parts.append(number(left.pop(0), int(decimals), bool(plus)))
    parts.append(repr(template[at:]))
    if left:
        raise ValueError(f"more values than fields in {template!r}")
    return f"concat({', '.join(p for p in parts if p != repr(''))})"


def joined(parts: list[Column], separator: str = " · ") -> Column:
    """Join the parts that are present; missing ones leave no trace."""
    return F.concat_ws(separator, *parts)


def summary_line(stage_label: Column, phase_label: Column, caution: Column) -> Column:
    return F.format_string(
        "Short term %s, long term %s, caution %s.",
        F.lower(stage_label), F.lower(phase_label), caution,
    )
