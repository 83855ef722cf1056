"""Quality rules: a table of thresholds compiled into projections of built-in functions.

Every measure is taken on the whole text inside its row, so nothing is shuffled and a row of any size meets the same
rules.  Null texts count as empty; repeated rows get equal verdicts; other columns pass through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgap.llm.common import WORD, fresh_name, words

# Frequent short words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are with as by this be at or from "
    "der die und das den mit von zu ist nicht ein eine auf für im sich des "
    "le la les de des et en un une du que pour dans par est au sur avec qui pas "
    "el los las y del se por con para al lo como más no"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``measure`` lies outside ``[low, high]``; an open end is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("too_few_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)
BASE_RULES = ("too_few_words", "repeated_windows")
POSITION_BITS = 26  # words of one text that a packed window can number: 67 million


def measure(df: DataFrame, text: str = "text", hash_mask: int = -1) -> DataFrame:
    """Add the counts and ratios that the rules speak of (see ``RULES``), beside all columns of ``df``.

    Counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ratios are doubles, 0 where a text has no words.
    ``hash_mask`` weakens the window hash and serves tests of collisions only.  A column of the table that has the name
    of a measure is replaced.
    """
    token, packed, twin, exact, lines = (fresh_name(df, n) for n in ("_tokens", "_packed", "_twin", "_exact", "_lines"))
    content = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumns(
        {
            token: words(content),
            lines: F.filter(F.split(content, "\n"), lambda line: line.rlike(WORD)),
        }
    )
    mask = (1 << POSITION_BITS) - 1
    # The upper bits hold a hash of three words, the lower ones the place: sorting the numbers brings equal windows together.
    step = step.withColumn(
        packed,
        F.expr(
            f"CASE WHEN size({token}) >= 3 THEN sort_array(transform(sequence(0, size({token}) - 3), i -> "
            f"(xxhash64({token}[i], {token}[i + 1], {token}[i + 2]) & {~mask & hash_mask}L) | i)) ELSE array() END"
        ),
    )
    step = step.withColumn(
        twin,
        F.expr(
            f"CASE WHEN size({packed}) > 1 THEN filter(sequence(1, size({packed}) - 1), k -> "
            f"shiftrightunsigned({packed}[k] ^ {packed}[k - 1], {POSITION_BITS}) = 0) ELSE array() END"
        ),
    )
    # Windows of one hash but other words (a collision) could hide equal ones behind them: such texts compare the words.
    at = lambda k: f"cast({packed}[{k}] & {mask}L AS int)"
    mixed = F.expr(f"size({token}) > {mask} OR exists({twin}, k -> slice({token}, {at('k')} + 1, 3) <> slice({token}, {at('k - 1')} + 1, 3))")
    step = step.withColumn(
        exact,
        F.when(mixed, F.expr(f"sort_array(transform(sequence(0, size({token}) - 3), i -> struct(slice({token}, i + 1, 3) AS w, i AS i)))")),
    )
    by_hash = F.expr(f"flatten(transform({twin}, k -> array({at('k - 1')}, {at('k')})))")
    by_words = F.expr(
        f"flatten(transform(filter(sequence(1, size({exact}) - 1), k -> {exact}[k].w = {exact}[k - 1].w), k -> array({exact}[k - 1].i, {exact}[k].i)))"
    )
    starts = fresh_name(df, "_starts")
    step = step.withColumn(starts, F.when(F.col(exact).isNotNull(), by_words).otherwise(by_hash))
    counts = {
        "n_symbols": F.length(F.regexp_replace(content, r"[^#*$%&|<>]+", "")),
        "n_words": F.size(token),
        "word_chars": F.length(F.array_join(token, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))),
        "n_stop_words": F.size(F.filter(token, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": F.size(lines),
    }
    # Rows of one struct each, unfolded: a filter on a count cannot move below and repeat the expressions that make it.
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in counts]
    step = step.select(*others, F.inline(F.array(F.struct(*[value.cast("long").alias(name) for name, value in counts.items()]))))
    ratio = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return step.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "stop_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
        }
    )


def broken(rule: Rule) -> Column:
    value = F.col(rule.measure)
    below = F.lit(False) if rule.low is None else value < rule.low
    return below if rule.high is None else below | (value > rule.high)


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Compile the rule table into one projection: ``failed_rules`` (names, in table order) and ``kept``."""
    failed = F.filter(F.array(*[F.when(broken(rule), F.lit(rule.name)) for rule in rules]), lambda name: name.isNotNull())
    base = F.lit(False)
    for rule in rules:
        if rule.name in BASE_RULES:
            base = base | broken(rule)
    return measured.withColumns({"failed_rules": failed, "base_failed": base}).withColumn("kept", F.size("failed_rules") == 0)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their columns as they are."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return judge(measure(whole), rules).where("kept").select("row.*")
