"""Scan of texts for identifiers and credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.sources.staging import staged

#: What is looked for, in the common part of Java's and RE2's syntax.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "credential": r"(TOKEN|SECRET|PASSWORD|API_KEY|token|secret|password|api_key) ?[:=] ?.?[A-Za-z0-9+/_-]{8,}",
    "phone": r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}",
}


def findings(df: DataFrame, text: str) -> DataFrame:
    """Adds a boolean column for each pattern; null texts have null."""
    return df.withColumns({n: F.col(text).rlike(p) for n, p in PATTERNS.items()})


def archive_findings(texts: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(path, member, n_bytes, status, a boolean for each pattern) of the members of archives, from archive_texts' rows."""
    found = [F.coalesce(F.bool_or(F.col("text").rlike(p)), F.lit(False)).alias(n) for n, p in (patterns or PATTERNS).items()]
    return texts.groupBy("path", "member").agg(F.max("n_bytes").alias("n_bytes"), F.max("status").alias("status"), *found)


def redacted_path(path) -> Column:
    """A path without the user's folder."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(c, r"^(/home/|/Users/)[^/]+", "$1***")


def strings_of_json(text) -> Column:
    """All string values of a JSON object's top level, those of media types aside; null where it isn't an object."""
    c = F.col(text) if isinstance(text, str) else text
    entries = F.from_json(c, "map<string,string>")
    kept = F.map_filter(entries, lambda k, v: ~k.rlike("^(image|audio|video)/|^application/pdf$"))
    return F.map_values(kept)


#: Keys of media, whose contents are no text.
MEDIA = "^(image|audio|video)/|^application/pdf$"


def json_strings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): every string in JSON texts at any depth, but for those under media types' keys.

    A level of nesting is opened at a time by Spark's variants, for all rows at once, until no container is left; each
    level is written, as variants that are not parsed again, so a deep text costs rounds and not memory; texts are dealt
    out over tasks, as a level grows. path has keys and positions, as $.a[0].b; names with
    other signs than letters, digits and _ stand in quotes. Texts that are null or no JSON have no rows; a text that
    is a string is one; null values, numbers and truth values are none; repeated rows have rows of their own.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = df.select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.col(text).alias("_text")).repartition(parts, "_key", "_text").select("_key", "path", F.try_parse_json("_text").alias("v"))
    levels = []
    while True:
        here = level.withColumn("kind", F.schema_of_variant("v"))
        strings = F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string"))
        containers = F.when(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"), F.col("v"))
        named = F.col("kind").startswith("OBJECT")
        rows = here.select("_key", "path", strings.alias("value"), containers.alias("inside"), named.alias("named"))
        # a filter on the first level would be pushed before its dealing out, and parse all texts there
        rows = staged(rows.where("value is not null or inside is not null") if levels else rows, "json-level")
        levels.append(rows)
        deeper = rows.where("inside is not null")
        if deeper.isEmpty():
            break
        opened = spark.sql("SELECT t._key, t.path, x.key AS name, x.pos AS pos, x.value AS v, t.named FROM {t} t, LATERAL variant_explode(t.inside) x", t=deeper)
        opened = opened.where(~F.col("named") | ~F.col("name").rlike(MEDIA))
        quoted = F.when(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("name")).otherwise(F.concat(F.lit('"'), "name", F.lit('"')))
        step = F.when(F.col("named"), F.concat(F.lit("."), quoted)).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = opened.select("_key", F.concat("path", step).alias("path"), "v")
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    return out.where("value is not null").select(F.col("_key").alias(key), "path", "value")
