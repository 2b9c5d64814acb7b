"""Token streams: the text form of a game, ``[Nf3] [x] [ed5]`` or ``Nf3 x ed5``.

A stream with a ``[`` has as tokens the texts between each ``[`` and the next ``]``; any other stream has the items between
white space. Null and empty streams have no tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the token language.
LABELS = ("?!", "?", "??")
MODIFIERS = ("+", "#", "x", "=Q", "=R", "=B", "=N")

_BRACKETED = re.compile(r"\[([^\]]*)\]")


def split_tokens(text: str | None) -> list[str]:
    """Tokens of one stream, in Python."""
    if not text:
        return []
    return _BRACKETED.findall(text) if "[" in text else text.split()


def tokens_of(text: Column) -> Column:
    """Tokens of one stream as ``array<string>``; an empty array for null."""
    bare = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    return F.coalesce(F.when(F.contains(text, F.lit("[")), F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1))).otherwise(bare), F.array().cast("array<string>"))


def without_labels(tokens: Column) -> Column:
    """The stream without accuracy labels."""
    return F.filter(tokens, lambda t: ~t.isin(*LABELS))
