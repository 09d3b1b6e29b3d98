"""What fits a line of so many columns: widths of characters, windows over marked texts, times told from now."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, MORE = "«", "»", "…"
#: A session is active whose last activity is less than so many seconds ago; units of times told from now, in seconds.
ACTIVE_SECONDS = 600
UNITS = ((60, "min"), (3600, "h"), (86400, "d"), (7 * 86400, "w"), (30 * 86400, "mo"), (365 * 86400, "y"))


def width(c: str) -> int:
    """Columns of a character: two of a wide one, none of a mark on the one before it."""
    if unicodedata.category(c) in ("Mn", "Me"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def plain(text: str) -> str:
    """Runs of white space as one space, and nothing that isn't shown."""
    return "".join(c for c in " ".join(text.split()) if c == " " or unicodedata.category(c)[0] not in "CZ")


def window(text: str, columns: int) -> str:
    """As much of a text with marked parts as fits so many columns, its first marked part among it; marks take no column and stay in pairs.

    Where the first mark is in the last third or beyond, the window begins a third of its width before it. What is left out at an end is told by `…`.
    """
    text = plain(text)
    if columns <= 0:
        return ""
    is_open, is_close = (np.array([c == m for c in text], bool) for m in (OPEN, CLOSE))
    inside = np.cumsum(is_open) > np.cumsum(is_close)
    shown = np.flatnonzero(~(is_open | is_close))
    w = np.array([width(text[i]) for i in shown], np.int64)
    if w.sum() <= columns:
        return text
    marked, ends = inside[shown], np.cumsum(w)
    first = int(marked.argmax())
    before = int(ends[first] - w[first])
    start = 0
    if before > columns * 2 // 3:
        start = min(first, int(np.searchsorted(ends, before - columns // 3)) + 1)
    left = columns - (start > 0)
    own = ends[start:] - (ends[start - 1] if start else 0)
    end = len(w) if own[-1] <= left else start + int(np.searchsorted(own, left - 1, side="right"))
    if end == start and start:
        return MORE  # no room for more
    out, on = [MORE] if start else [], False
    for i, m in zip(shown[start:end].tolist(), marked[start:end].tolist(), strict=True):
        if m != on:
            out.append(OPEN if m else CLOSE)
            on = m
        out.append(text[i])
    return "".join(out) + (CLOSE if on else "") + (MORE if end < len(w) else "")


def fitted(c: Column, columns: int) -> Column:
    """`window` of each text; null for null. For the few rows that are shown."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: window(t, columns), na_action="ignore")

    return run(c)


def unmarked(c: Column) -> Column:
    return F.translate(c, OPEN + CLOSE, "")


def is_active(last_activity: Column, now: Column) -> Column:
    return F.coalesce(_seconds(last_activity, now) < ACTIVE_SECONDS, F.lit(False))


def _seconds(at: Column, now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return micros / F.lit(1e6)


def ago(at: Column, now: Column) -> Column:
    """'just now', '5min ago', '3h ago', '1w ago': whole units, of times to come as of those gone by; '' for null."""
    s = F.abs(_seconds(at, now))
    text = F.lit("just now")
    for size, unit in UNITS:  # the largest that fits is the last to be set
        text = F.when(s >= size, F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(text)
    return F.when(at.isNull(), "").otherwise(text)
