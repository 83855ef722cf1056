"""Pieces shared by the operators: word patterns, repeatable draws, size-checked broadcasts."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space; a benchmark word a run of ASCII letters, digits
# and everything beyond ASCII.
WORD = r"[^\x20\x09-\x0D]+"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BROADCAST_BYTES = 64 << 20


def bench_words(text: Column) -> Column:
    """Words of ``BENCH_WORD`` in lower case: one translation lowers A-Z and blanks the rest of ASCII, then blanks part the words."""
    gaps = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
    blanked = F.translate(text, UPPER + gaps, UPPER.lower() + " " * len(gaps))
    return F.array_remove(F.split(blanked, " "), "")


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unit_draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same on every run and in SQL."""
    digest = F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def small_side(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """Ask for a broadcast only if the counted rows prove it small; otherwise the join shuffles."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front while the table already has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ship(module: str) -> None:
    """Send a module's functions to the Python workers with their code, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
