"""Quotation linking of conversations, with DataFrame functions only.

A line's quote level is the number of ">" it begins with, blanks between them aside. Lines of level 0 are a
message's own text. Runs of lines of one level are quoted passages; a passage, and each line of it, is normalised
(lower case, letters and digits only, single blanks), hashed with SHA-256 and joined to the own texts, paragraphs and
lines of the earlier messages of its conversation. A message replies to the message that its quotes of the lowest
level match by most characters, of several the latest; without a match, to the message before it.

Result: one row per message, in order of position: conv_id, turn, role, position (from 0 in the conversation's order
of turns, in which every message follows the one it replies to), reply_to (position; null for a first message),
linked (a quote was found), quote_level (deepest), n_passages, n_linked, text (without quotes).

Conversations are numbered in stretches of 4096 turn values, so a hot one splits as far as its turns differ; rows of one
conversation with equal or null turns are ordered by one task, and turns that lie far apart (time stamps) make a stretch
each, whose sizes one task adds up. Edge cases: very long texts are taken whole, as one row each; null texts are empty; null turns come first and null conversations form one conversation; repeated rows stay, in any
order among equals; quotes of nothing known stay unlinked; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_QUOTE = r"^((?:[ \t]*>)+)[ \t]?"


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def numbered(messages: DataFrame, stretch: int = 4096) -> DataFrame:
    """Adds position: the place in the conversation by turn. Counts in stretches of turns first, so conversations of many turns split."""
    cut = messages.withColumn("_cut", F.coalesce(F.floor(F.col("turn") / F.lit(stretch)), F.lit(-1 << 62)))
    sizes = cut.groupBy("conv_id", "_cut").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("_conv"), F.col("_cut").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("conv_id", "_cut").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"))
    placed = cut.withColumn("_n", F.row_number().over(order) - 1)
    return placed.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_cut") == F.col("_at"))).select(*messages.columns, (F.col("_before") + F.col("_n")).alias("position"))


def parse(messages: DataFrame) -> DataFrame:
    """Adds lines: array of (level, text) of every line."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), "[^>]", ""))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("line")))
    return messages.withColumn("lines", lines)


def _units(text: Column) -> Column:
    """Hashes of the whole text, its paragraphs and its lines, each with its length; blank ones left out."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n"))
    clean = F.array_distinct(F.filter(F.transform(parts, normalised), lambda x: x != ""))
    return F.transform(clean, lambda x: F.struct(F.sha2(x, 256).alias("hash"), F.length(x).alias("chars")))


def passages(parsed: DataFrame) -> DataFrame:
    """Rows (conv_id, position, passage, level, units) for each run of quoted lines of one level."""
    lines = parsed.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id", "position", F.posexplode("lines").alias("n", "x")).select("conv_id", "position", "n", "x.level", "x.line")
    run = Window.partitionBy("conv_id", "position", "level").orderBy("n")
    lines = lines.where("level > 0").withColumn("passage", F.col("n") - F.row_number().over(run))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("conv_id", "position", "level", "passage").agg(joined.alias("body")).select("conv_id", "position", "level", "passage", _units(F.col("body")).alias("units"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """The result described above for a table (conv_id, turn, role, text)."""
    rows = numbered(messages.select("conv_id", "turn", "role", "text"))
    parsed = parse(rows)
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    parsed = common.staged(
        parsed.select("conv_id", "turn", "role", "position", own.alias("own"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("quote_level"), F.when(F.exists("lines", lambda x: x["level"] > 0), F.col("lines")).alias("lines")),
        "quote-messages",
    )
    quoted = passages(parsed.where("lines is not null"))
    asked = quoted.select("conv_id", "position", "level", "passage", F.explode_outer("units").alias("u")).select("conv_id", "position", "level", "passage", "u.*")
    threads = quoted.select(F.col("conv_id").alias("_c")).distinct()
    known = parsed.join(threads, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    known = known.select(F.col("conv_id").alias("_c"), F.col("position").alias("_p"), F.explode(_units(F.col("own"))).alias("u")).select("_c", "_p", F.col("u.hash").alias("_h"))
    found = asked.join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")) & (F.col("_p") < F.col("position")))
    found = found.groupBy("conv_id", "position", "level", "_p").agg(F.sum("chars").alias("chars"), F.collect_set("passage").alias("hit"))
    best = found.groupBy("conv_id", "position").agg(
        F.max_by("_p", F.struct(-F.col("level"), "chars", "_p")).alias("linked_to"), F.size(F.array_distinct(F.flatten(F.collect_set(F.transform("hit", lambda p: F.struct(F.col("level"), p)))))).alias("n_linked")
    )
    counts = quoted.groupBy("conv_id", "position").agg(F.count("*").alias("n_passages"))
    links = counts.join(best, counts["conv_id"].eqNullSafe(best["conv_id"]) & (counts["position"] == best["position"]), "left")
    links = links.select(counts["conv_id"].alias("_c"), counts["position"].alias("_p"), "n_passages", "linked_to", "n_linked")
    out = parsed.join(links, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("position") == F.col("_p")), "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "position",
        F.coalesce("linked_to", F.when(F.col("position") > 0, F.col("position") - 1)).alias("reply_to"),
        F.col("linked_to").isNotNull().alias("linked"),
        "quote_level",
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("own").alias("text"),
    )
