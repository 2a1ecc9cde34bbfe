"""Building a score bundle: coverage, single values, scales with a fallback, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groups


def manifest(df: DataFrame, part: str, order: str, content: str, counts: dict[str, Column], stretch: int = 4096) -> DataFrame:
    """A row for each part: SHA-256 over the digests of its stretches in order, and counts.

    A stretch holds the rows of `stretch` values of the whole number `order`; its digest is SHA-256 over its rows'
    digests in order. So no task gathers all rows of a part.
    """
    rows = df.select(part, order, F.sha2(F.col(content).cast("binary"), 256).alias("_digest"), F.floor(F.col(order) / stretch).alias("_cut"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "_digest"))), lambda x: x["_digest"]), ""), 256)
    digests = rows.groupBy(part, "_cut").agg(joined(order).alias("_digest")).groupBy(part).agg(joined("_cut").alias("sha256"))
    numbers = df.groupBy(part).agg(*(c.alias(n) for n, c in counts.items())).withColumnRenamed(part, "_part")
    return digests.join(numbers, F.col(part).eqNullSafe(F.col("_part"))).drop("_part")


def scales(ism: DataFrame, table: DataFrame) -> DataFrame:
    """(event, logit_scaling_factor, logit_scaling_factor_all_vars): the table's, else the ISM rows' greatest change."""
    own = ism.groupBy("event").agg(groups.max_abs("delta_logit_score").alias("_own"))
    known = table.groupBy("event").agg(*(groups.single_value(c, 1e-12).alias(c) for c in ("logit_scaling_factor", "logit_scaling_factor_all_vars")))
    joined = own.join(known, "event", "left")
    return joined.select("event", *(F.coalesce(F.col(c).cast("double"), "_own").alias(c) for c in ("logit_scaling_factor", "logit_scaling_factor_all_vars")))


def build(ism: DataFrame, wild_type: DataFrame, metadata: DataFrame, variants: DataFrame) -> dict[str, DataFrame]:
    """The bundle's tables, all reduced to the events that the ISM rows cover.

    Raises ValueError if a covered event has no wild type or no metadata.
    """
    covered = ism.select("event").distinct()
    for name, t in (("wild type", wild_type), ("metadata", metadata)):
        missing = [r["event"] for r in covered.join(t, "event", "left_anti").orderBy("event").limit(5).collect()]
        if missing:
            raise ValueError(f"events without {name}: {', '.join(missing)}")
    keep = lambda t: t.join(covered, "event", "left_semi")
    numbers = variants.withColumns({c: F.col(c).cast("double") for c in ("logit_scaling_factor", "logit_scaling_factor_all_vars")})
    indels = keep(variants.where("var_type = 'Indel'") if "var_type" in variants.columns else variants)
    return {"ism": ism, "wild_type": keep(wild_type), "events": keep(metadata), "indels": indels, "scaling": scales(ism, numbers)}
