"""Column functions with the missing-value rules of survey scripts (a missing condition is neither true nor false)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRANCS_TO_EUROS = 0.152449


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else(condition: Column, yes, no, missing=None) -> Column:
    """Vector if/else: a NULL condition gives ``missing`` instead of falling into the else branch."""
    return F.when(condition.isNull(), missing).when(condition, yes).otherwise(no)


def first_match(cases: list[tuple[Column, object]], default=None) -> Column:
    """First case whose condition holds; NULL conditions fall through."""
    condition, value = cases[0]
    chain = F.when(condition, value)
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def recode(x: str | Column, groups: dict[object, list], keep_others: bool = False, default=None) -> Column:
    """Value recode: ``{new value: [old values]}``; other values stay (``keep_others``) or become ``default``."""
    x = col(x)
    chain = None
    for new, olds in groups.items():
        test = x.isin(*olds)
        chain = F.when(test, F.lit(new)) if chain is None else chain.when(test, F.lit(new))
    return chain.otherwise(x if keep_others else F.lit(default))


def known_in(x: str | Column, values: list) -> Column:
    """Membership where NULL is simply not a member."""
    return F.coalesce(col(x).isin(*values), F.lit(False))


def is_finite(x: str | Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)


def clamp(x: str | Column, low: float, high: float) -> Column:
    """Limit to ``[low, high]``, NULL stays NULL (``least``/``greatest`` alone would drop it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def row_max(*columns: str | Column) -> Column:
    """Row-wise maximum that skips NULLs."""
    return F.greatest(*[col(c) for c in columns])


def row_min(*columns: str | Column) -> Column:
    return F.least(*[col(c) for c in columns])


def safe_log(x: str | Column) -> Column:
    """Natural log of positive values, NULL otherwise."""
    x = col(x)
    return F.when(x > 0, F.log(x))


def to_int(x: str | Column) -> Column:
    """Integer from text; blank or malformed text is NULL."""
    return F.trim(col(x).cast("string")).try_cast("int")


def to_double(x: str | Column, decimal: str = ",") -> Column:
    """Double from text with the given decimal mark; blank or malformed text is NULL."""
    text = F.trim(col(x).cast("string"))
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    return text.try_cast("double")


def slice_text(x: str | Column, start: int, end: int = -1) -> Column:
    """Substring by inclusive positions from 1; negative positions count from the end."""
    x = col(x)
    size = F.length(x)
    first = F.lit(start) if start > 0 else F.greatest(size + start + 1, F.lit(1))
    last = F.lit(end) if end > 0 else size + end + 1
    return F.substring(x, first, F.greatest(last - first + 1, F.lit(0)))


def sentence_case(x: str | Column) -> Column:
    """First letter upper, the rest lower (not every word)."""
    x = col(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))


def capture(x: str | Column, pattern: str, group: int = 1) -> Column:
    """Captured group, NULL where the pattern does not match."""
    x = col(x)
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def remove(x: str | Column, pattern: str) -> Column:
    return F.regexp_replace(col(x), pattern, "")


def swap_when(df: DataFrame, condition: Column, first: str, second: str) -> DataFrame:
    """Exchange two columns where the condition holds; a missing condition leaves both as they are."""
    swap = F.coalesce(condition, F.lit(False))
    return df.withColumns(
        {
            first: F.when(swap, F.col(second)).otherwise(F.col(first)),
            second: F.when(swap, F.col(first)).otherwise(F.col(second)),
        }
    )


def digit_class(code: str | Column) -> Column:
    """One-digit class of a two-digit code: tens digit, the unit digit for the 7x codes, 0 is NULL."""
    text = col(code).cast("string")
    digit = F.substring(text, 1, 1)
    digit = F.when(digit == "7", F.substring(text, 2, 1)).otherwise(digit)
    return F.when(digit != "0", digit.try_cast("int"))


def detailed_code(code: str | Column) -> Column:
    """Two-digit code, NULL for the round codes that name no detailed class."""
    code = col(code)
    return F.when(F.right(code.cast("string"), F.lit(1)) != "0", code)


def across(columns: list[str], function, names: str = "{col}") -> dict[str, Column]:
    """One expression over many columns, for ``withColumns``."""
    return {names.format(col=c): function(F.col(c)) for c in columns}


def indicators(x: str | Column, levels: list, names: str = "is_{level}") -> dict[str, Column]:
    """0/1 column per level; NULL stays NULL."""
    return {names.format(level=level): (col(x) == F.lit(level)).cast("int") for level in levels}


def real_value(nominal: str | Column, index: str | Column) -> Column:
    """Nominal amount in constant prices of the index base year."""
    return col(nominal) * col(index) / 100


def francs_to_euros(x: str | Column, rate: float = FRANCS_TO_EUROS) -> Column:
    return col(x) * F.lit(rate)


def odds_ratio(p1: Column, p2: Column) -> Column:
    """Odds of the first share over odds of the second, NULL where undefined."""
    return F.try_divide(p1 * (1 - p2), p2 * (1 - p1))
