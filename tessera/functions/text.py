"""Text expressions shared by several operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str, str, list[tuple[str, str]]]:
    """From the compatibility decompositions of the alphabetic blocks: letters that become one letter, what they become,
    combining marks, and letters that become several."""
    one, to, many = [], [], []
    for point in [*range(0xA0, 0x0300), *range(0x0370, 0x0590), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x0300 <= ord(x) <= 0x036F).lower()
        if plain != c.lower() and plain and c == c.lower():
            (many.append((c, plain)) if len(plain) > 1 else (one.append(c), to.append(plain)))
    return "".join(one), "".join(to), "".join(map(chr, range(0x0300, 0x0370))), many


_ONE, _TO, _MARKS, _MANY = _folds()
_SEVERAL = "[" + "".join(c for c, _ in _MANY) + "]"


def fold(c: Column) -> Column:
    """Lower case, without accents and compatibility forms, with a plain apostrophe."""
    out = F.translate(F.lower(c), _ONE + "\u2019\u2018" + _MARKS, _TO + "''")
    several = out
    for what, plain in _MANY:
        several = F.replace(several, F.lit(what), F.lit(plain))
    return F.when(out.rlike(_SEVERAL), several).otherwise(out)
