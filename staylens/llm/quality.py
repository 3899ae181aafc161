"""Quality rules as a short-circuit cascade, in Spark expressions only.

Rules are fail conditions over counts of a text.  On a bounded sample each
rule's cost (time over a plain scan of the same rows) and selectivity (share
rejected) are measured; rules then run in order of rejection per cost inside
one ``CASE WHEN``, which evaluates a rule only for rows that all earlier rules
passed.  The order decides speed only, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import SPACES, words
from staylens.plans.materialize import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of the sample that costs and selectivities are measured on (about).
SAMPLE_ROWS = 2000


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def symbol_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")


def dup_lines(text: Column) -> Column:
    lines = lines_with_words(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def stutter(ws: Column) -> Column:
    """Words equal to the word before them."""
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(ws, 1, n), F.slice(ws, F.lit(2), n), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda same: same)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """The words covered by windows of ``window`` words that are found twice or more.

    A window is hashed by doubling (pairs, fours, eights); repeated windows
    are neighbours after a sort, and the covered words are summed from the
    sorted start positions.  Texts without a repeated window stop at a
    distinct count.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def doubled(g: Column, step: int) -> Column:
        n = F.greatest(F.size(g) - step, F.lit(0))
        return F.zip_with(F.slice(g, 1, n), F.slice(g, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    def covered(p: Column) -> Column:
        n = F.size(p) - 1
        gaps = F.zip_with(F.slice(p, 1, n), F.slice(p, F.lit(2), n), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(gaps, F.lit(window).cast("long"), lambda s, g: s + g)

    def again(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def found(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _let(placed, lambda s: _let(again(s), covered))).otherwise(F.lit(0).cast("long"))

    def level(g: Column, step: int) -> Column:
        return found(g) if step == window else _let(doubled(g, step), lambda h: level(h, step * 2))

    return _let(F.transform(ws, lambda w: F.xxhash64(w)), lambda g: level(g, 1))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the text (``__t``), its words (``__ws``) and the counts that cost one look at the text, prefixed ``__``.

    ``__row`` numbers the rows.  It keeps filters on the verdict above this
    projection: pushed below, they would count the words once per rule.
    """
    t = F.col("__t")
    df = docs.withColumn("__t", _text(F.col(text_col))).withColumn("__ws", words(t))
    return df.select(
        *docs.columns, "__t", "__ws",
        F.size("__ws").cast("long").alias("__n_words"),
        word_chars(t).alias("__word_chars"),
        symbol_count(t).alias("__n_symbols"),
        F.monotonically_increasing_id().alias("__row"),
    )


def heavy_counts() -> dict[str, Column]:
    """The counts that cost more, by name; rules compute them only for rows that reach them."""
    return {"__n_repeat_words": repeat_words(F.col("__ws")), "__n_dup_lines": dup_lines(F.col("__t"))}


def default_rules(counts: Mapping[str, Column]) -> dict[str, Column]:
    """Fail conditions by name, over the columns of ``with_counts`` and the given heavier counts."""
    n, chars, t = F.col("__n_words"), F.col("__word_chars"), F.col("__t")
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    repeats, dups = counts["__n_repeat_words"], counts["__n_dup_lines"]
    return {
        "too_few_words": n < 20,
        "repeated_windows": repeats * 100 > n * 30,
        "symbols": F.col("__n_symbols") * 100 > n * 30,
        "word_length": (chars < n * 2) | (chars > n * 15),
        "duplicate_lines": (dups > 2) & (dups * 100 > F.size(lines_with_words(t)) * 30),
        "stutter": stutter(F.col("__ws")) * 100 > n * 30,
        "exclamations": count("!?") * 100 > n * 50,
        "digits": count("0123456789") * 100 > chars * 30,
        "few_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")) * 100 < chars * 50,
    }


def estimate(sample: DataFrame, rules: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """rule -> (seconds over a plain scan of the sample, share of rows rejected)."""

    def run(c: Column) -> tuple[float, float]:
        began = time.perf_counter()
        got = sample.agg(F.avg(F.coalesce(c, F.lit(False)).cast("double"))).first()[0]
        return time.perf_counter() - began, got or 0.0

    run(F.length("__t") < 0)  # first read and compilation
    floor = min(run(F.length("__t") < 0)[0] for _ in range(2))
    return {name: (max(run(c)[0] - floor, 1e-4), share) for name, c in rules.items() for share in [run(c)[1]]}


def cascade_order(costs: Mapping[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, highest first; ties by cost, then name."""
    return sorted(costs, key=lambda k: (-costs[k][1] / costs[k][0], costs[k][0], k))


def verdict(rules: Mapping[str, Column], order: list[str]) -> Column:
    """The first failing rule in cascade order, null if none fails."""
    out = None
    for name in order:
        out = F.when(rules[name], F.lit(name)) if out is None else out.when(rules[name], F.lit(name))
    return out


def quality_cascade(
    docs: DataFrame,
    *,
    text_col: str = "text",
    rules=default_rules,
    sample_rows: int = SAMPLE_ROWS,
    all_counts: bool = False,
) -> DataFrame:
    """``docs`` with the counts, ``__failed`` (first failing rule or null) and ``__kept``.

    ``rules`` makes the fail conditions from the heavier counts, which are
    columns for all rows with ``all_counts`` and otherwise evaluated where a
    rule needs them.  Null and empty texts have no words and fail.  All rows
    are judged on their whole text; repeated rows get equal verdicts.  An
    empty table gives no rows.  Added columns start with two underscores, so
    that columns of any plain name pass through.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    some = docs.select(F.col(text_col)).sample(share, seed=1).repartition(8)
    sample, _ = materialize(with_counts(some, text_col), "quality-sample")
    order = cascade_order(estimate(sample, rules(heavy_counts())))
    counted, heavy = with_counts(docs, text_col), heavy_counts()
    if all_counts:
        counted = counted.withColumns(heavy)
        heavy = {name: F.col(name) for name in heavy}
    judged = counted.withColumn("__failed", verdict(rules(heavy), order))
    return judged.withColumn("__kept", F.col("__failed").isNull() & (F.col("__row") >= 0))
