"""Quality rules: a table of thresholds compiled into one Spark projection.

Measures are column expressions over the whole text; a rule is (measure, least, most), either bound may be None. The
compiled projection adds one boolean per rule and the verdict; no user function takes part.

Words are runs of anything but \\x20 and \\x09-\\x0D. A null text has no words. Ratios over nothing are null, and a
null measure passes its rule; an empty table gives an empty result; only the id and text columns are read, so further
columns do not matter. Texts of any length are measured whole. Repeated rows are judged alike and stay; a measure that
equals a threshold passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from at or an a not have has which but they you "
    "le la les de des du et un une que qui dans pour par sur au aux avec est ce se ne pas en il elle "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an er so "
    "el los las y que un una por con para su del se lo como al más no"
).split()

#: (measure, least, most) of the production table.
DEFAULT_RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 15.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside further lambdas."""
    return F.transform(F.array(value), body)[0]


def _covered(h: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more; h: the windows' hashes in order of position."""

    def count(sorted_pairs: Column) -> Column:
        twice = F.filter(
            sorted_pairs,
            lambda e, k: (F.get(sorted_pairs, k - 1)["h"] == e["h"]) | (F.get(sorted_pairs, k + 1)["h"] == e["h"]),
        )
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        )["n"]

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, count))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, measures...). Counts are long, ratios double."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = lambda c: c.cast("long")

    def per_text(words: Column) -> Column:
        n = F.size(words)
        windows = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        )
        repeated = F.when(n < 3, F.lit(0).cast("long")).otherwise(_let(windows, _covered))
        return F.struct(
            long(n).alias("n_words"),
            long(F.char_length(F.array_join(words, ""))).alias("word_chars"),
            long(repeated).alias("n_repeat_words"),
            long(F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
        )

    def per_lines(lines: Column) -> Column:
        return F.struct(
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            long(F.size(F.filter(lines, lambda x: x.rlike(rf"(\.\.\.|…){WS}*\z")))).alias("n_ellipsis_lines"),
            long(F.size(F.filter(lines, lambda x: x.rlike(rf"\A{WS}*[-*•]")))).alias("n_bullet_lines"),
        )

    words = F.filter(F.split(text, WS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rtrim(F.translate(x, "\t\r\f\v", "    ")) != "")
    got = docs.select(
        F.col(id_col).alias("doc_id"),
        _let(words, per_text).alias("w"),
        _let(lines, per_lines).alias("l"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
    )
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    flat = got.select("doc_id", "w.*", "l.*", "n_symbols")
    return flat.withColumns(
        {
            "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_word_ratio": ratio(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_word_ratio": ratio(F.col("n_repeat_words"), F.col("n_words")),
            "ellipsis_line_ratio": ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
            "bullet_line_ratio": ratio(F.col("n_bullet_lines"), F.col("n_lines")),
        }
    )


def compile_rules(rules=DEFAULT_RULES) -> tuple[list[Column], Column]:
    """A boolean column for each rule (true: it rejects), and the verdict (true: no rule rejects)."""
    columns, kept = [], F.lit(True)
    for name, least, most in rules:
        fails = F.lit(False)
        if least is not None:
            fails = fails | (F.col(name) < F.lit(least))
        if most is not None:
            fails = fails | (F.col(name) > F.lit(most))
        fails = F.coalesce(fails, F.lit(False))
        columns.append(fails.alias(f"fails_{name}"))
        kept = kept & ~fails
    return columns, kept


def apply_rules(docs: DataFrame, rules=DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, measures..., fails_<measure>..., passed)."""
    columns, kept = compile_rules(rules)
    return measures(docs, id_col, text_col).select("*", *columns, kept.alias("passed"))
