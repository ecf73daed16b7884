"""Numbers as C's strtod reads them."""

from __future__ import annotations

import math
import re

DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
HEX = r"[+-]?0[xX](?:[0-9A-Fa-f]+\.?[0-9A-Fa-f]*|\.[0-9A-Fa-f]+)(?:[pP][+-]?[0-9]+)?"
#: White space in C, and the names of what isn't finite.
C_SPACE, INF, NAN = r"[ \t-\r]*", r"[+-]?(?i:inf(?:inity)?)", r"[+-]?(?i:nan(?:\([0-9A-Za-z_]*\))?)"


def strtod(text: str) -> float:
    """The number that is the whole of text; ValueError for anything else."""
    body = re.sub(rf"\A{C_SPACE}", "", text)
    if re.fullmatch(DECIMAL, body) or re.fullmatch(INF, body):
        return float(body)
    if re.fullmatch(HEX, body):
        try:
            return float.fromhex(body)
        except OverflowError:
            return -math.inf if body.startswith("-") else math.inf
    if re.fullmatch(NAN, body):
        return math.nan
    raise ValueError(f"not a number: {text!r}")


def u32(text: str) -> int:
    """An unsigned 32-bit integer of decimal digits alone; ValueError for anything else."""
    if not re.fullmatch(r"[0-9]+", text) or int(text) >= 2**32:
        raise ValueError(f"not an unsigned 32-bit integer: {text!r}")
    return int(text)
