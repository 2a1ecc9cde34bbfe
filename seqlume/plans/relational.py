"""Joins, aggregates, windows and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlume.functions import scores
from seqlume.operators import groups
from seqlume.operators.cohort import discordant, lifted
from seqlume.operators.intervals import overlap_join

from .base import query, read, seconds


def _times(spark, sf_dir):
    return read(spark, sf_dir, "events").select("*", seconds().alias("t"))


_E = "WITH e AS (SELECT *, date_diff('second', TIMESTAMP '2024-01-01', ts) AS t FROM events) "


@query(
    _E + "SELECT p.event_id AS window_id, count(*) AS n_hits, round(max(e.value), 6) AS max_value FROM e p JOIN e ON e.t BETWEEN p.t - 300 AND p.t + 299 WHERE p.event_type = 'purchase' GROUP BY 1"
)
def overlap_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _times(spark, sf_dir)
    windows = e.where("event_type = 'purchase'").select(F.lit(1).alias("chrom"), F.col("event_id").alias("window_id"), (F.col("t") - 300).alias("start0"), (F.col("t") + 299).alias("end0"))
    points = e.select(F.lit(1).alias("chrom"), "value", F.col("t").alias("qstart"), F.col("t").alias("qend"))
    return overlap_join(points, windows).groupBy("window_id").agg(F.count("*").alias("n_hits"), F.round(F.max("value"), 6).alias("max_value"))


@query(
    _E + "SELECT p.event_id AS window_id, coalesce(q.event_id, -1) AS hit_id FROM e p LEFT JOIN e q ON q.event_type = 'signup' AND q.t BETWEEN p.t - 60 AND p.t + 60 WHERE p.event_type = 'purchase'"
)
def overlap_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _times(spark, sf_dir)
    windows = e.where("event_type = 'purchase'").select(F.lit(1).alias("chrom"), F.col("event_id").alias("window_id"), (F.col("t") - 60).alias("qstart"), (F.col("t") + 60).alias("qend"))
    points = e.where("event_type = 'signup'").select(F.lit(1).alias("chrom"), F.col("event_id").alias("hit_id"), F.col("t").alias("start0"), F.col("t").alias("end0"))
    return overlap_join(windows, points, how="left").select("window_id", F.coalesce("hit_id", F.lit(-1)).alias("hit_id"))


@query(
    """WITH exact AS (SELECT p_partkey AS partkey, l_orderkey AS orderkey, l_linenumber AS line, 'exact' AS via FROM part JOIN lineitem ON p_partkey = l_partkey),
r AS (SELECT p_partkey AS partkey, l_orderkey AS orderkey, l_linenumber AS line, 'range' AS via FROM part JOIN lineitem ON l_partkey BETWEEN p_partkey - 1 AND p_partkey + 1)
SELECT * FROM r UNION ALL SELECT * FROM exact WHERE (partkey, orderkey, line) NOT IN (SELECT partkey, orderkey, line FROM r)"""
)
def exact_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range hits, and exact hits that the ranges missed."""
    parts = read(spark, sf_dir, "part").select(F.lit(1).alias("chrom"), F.col("p_partkey").alias("partkey"), (F.col("p_partkey") - 1).alias("start0"), (F.col("p_partkey") + 1).alias("end0"))
    lines = read(spark, sf_dir, "lineitem").select(F.lit(1).alias("chrom"), "l_partkey", F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("qstart"), F.col("l_partkey").alias("qend"))
    names = ["partkey", "orderkey", "line"]
    near = overlap_join(lines, parts, width=16).select(*names, F.lit("range").alias("via"))
    exact = parts.join(lines, F.col("partkey") == F.col("l_partkey")).select(*names, F.lit("exact").alias("via"))
    return near.unionByName(exact.join(near, names, "left_anti"))


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = l.l_linestatus)"
)
def wanted_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the fact table whose keys are wanted, by all key columns."""
    wanted = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    return lines.join(wanted, ["l_orderkey", "l_linestatus"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'validation' ELSE 'train' END AS split FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW') AND c_nationkey NOT IN (1, 3, 5, 7, 9)"
)
def holdout_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation rows without held-out ids and groups."""
    held = read(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    rest = read(spark, sf_dir, "customer").where(~F.col("c_nationkey").isin(1, 3, 5, 7, 9)).join(held, "c_custkey", "left_anti")
    return rest.select("c_custkey", F.when(F.col("c_custkey") % 10 == 3, "validation").otherwise("train").alias("split"))


@query(
    """SELECT c_custkey, CAST(n_orders AS DOUBLE) AS n_orders, round(total, 4) AS total, CAST(late AS DOUBLE) AS late, CAST(NULL AS DOUBLE) AS absent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1) b ON b.o_custkey = c_custkey"""
)
def feature_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    a = orders.groupBy("c_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    b = orders.join(returned, "o_orderkey").groupBy("c_custkey").agg(F.count("*").alias("late"))
    joined = groups.left_joined(read(spark, sf_dir, "customer").select("c_custkey"), [a, b], "c_custkey")
    return groups.aligned(joined, ["n_orders", "total", "late", "absent"], "c_custkey")


@query(
    """SELECT n_nationkey, coalesce(s.k, c.k) AS found, CASE WHEN s.k IS NOT NULL THEN 'known' ELSE 'novel' END AS via FROM nation
LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) c ON c.c_nationkey = n_nationkey WHERE coalesce(s.k, c.k) IS NOT NULL"""
)
def dim_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks up one dimension, then another; rows found in neither are left out."""
    known = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("a"))
    novel = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("b"))
    both = read(spark, sf_dir, "nation").select("n_nationkey").join(known, "n_nationkey", "left").join(novel, "n_nationkey", "left")
    via = F.when(F.col("a").isNotNull(), "known").otherwise("novel")
    return both.select("n_nationkey", F.coalesce("a", "b").alias("found"), via.alias("via")).where("found is not null")


@query(
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS fg_count, coalesce(b.n, 0) AS bg_count FROM
(SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k"""
)
def outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    side = lambda flag, name: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias(name))
    return side("R", "fg_count").join(side("A", "bg_count"), "k", "full_outer").na.fill(0, ["fg_count", "bg_count"])


@query(
    "SELECT a.n_nationkey AS first, b.n_nationkey AS second, r_regionkey AS at, row_number() OVER (PARTITION BY a.n_nationkey, b.n_nationkey ORDER BY r_regionkey) - 1 AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey, region"
)
def pair_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs within a group, each at every position of a fixed list, numbered afresh per pair."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    pairs = n.withColumnRenamed("n_nationkey", "first").join(n.withColumnRenamed("n_nationkey", "second"), "n_regionkey").where("first < second")
    places = [r[0] for r in read(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # five regions
    return pairs.select("first", "second", F.posexplode(F.array(*map(F.lit, places))).alias("j", "at")).select("first", "second", "at", F.col("j").cast("long").alias("j"))


@query(
    "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (event_type = 'purchase') > 0) GROUP BY 1"
)
def family_discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with members of both kinds, joined back."""
    e = read(spark, sf_dir, "events")
    both = discordant(e, "user_id", "event_type", ("error", "purchase"))
    return e.where(F.col("event_type").isin("error", "purchase")).join(both, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, round(max(abs(l_extendedprice - 50000)), 4) AS scale FROM lineitem GROUP BY 1")
def group_max_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") - 50000).alias("d"))
    return lines.groupBy("l_suppkey").agg(F.round(groups.max_abs("d"), 4).alias("scale"))


@query("SELECT o_custkey, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus)")
def conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.conflicts(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "SELECT o_orderkey AS k, 'left' AS side FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, 'right' FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)"
)
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return groups.coverage_difference(o, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return groups.first_max(e, ["user_id", "event_type"], "value", "event_id").withColumn("value", F.round("value", 6))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"round(max(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def motif_pivot_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return e.groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.round(F.max("value"), 6))


@query(
    """WITH f AS (SELECT user_id, event_id, event_type, ts, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_id FROM f)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY 1, 2"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    runs = groups.run_ids(e, ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", F.col("run_id").cast("long").alias("run_id")).agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("SELECT l_returnflag, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("m"))
    return inner.groupBy("l_returnflag").agg(F.round(F.avg("m"), 6).alias("mean"))


@query(
    "SELECT l_returnflag, " + ", ".join(f"round(avg(l_discount) FILTER (ceil(l_quantity / 10) = {b}), 6) AS bin_{b}" for b in range(1, 6)) + " FROM lineitem GROUP BY 1"
)
def binned_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by right-closed bins, one column for each bin."""
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", F.concat(F.lit("bin_"), scores.right_closed_bin("l_quantity", 10).cast("string")).alias("bin"))
    return lines.groupBy("l_returnflag").pivot("bin", [f"bin_{b}" for b in range(1, 6)]).agg(F.round(F.avg("l_discount"), 6))


@query(
    "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, count(*) FILTER (l_quantity > 25) AS high, count(*) FILTER (l_discount = 0) AS plain FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"
)
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    sets = lines.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    out = sets.agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("high"), F.count_if(F.col("l_discount") == 0).alias("plain"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "high", "plain")


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS path FROM events GROUP BY 1")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(groups.ordered_concat("event_type", "ts", "event_id").alias("path"))


@query(
    "SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY 1"
)
def unique_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(groups.ordered_concat("event_type", "ts", "event_id", unique=True).alias("path"))


@query(
    "SELECT vec_id, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(x AS DOUBLE)), 6) AS sd FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1"
)
def ensemble_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation over the values of an array, without exploding it."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    n = F.size("embedding").cast("double")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    mean = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", (add(x) / n).alias("m"))
    spread = F.transform("embedding", lambda v: (v.cast("double") - F.col("m")) * (v.cast("double") - F.col("m")))
    return mean.select("vec_id", F.round("m", 6).alias("mean"), F.round(F.sqrt(add(spread) / n), 6).alias("sd"))


@query("SELECT event_type, event_id, round(value, 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = groups.top_k(read(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), "event_id"], 3)
    return top.select("event_type", "event_id", F.round("value", 6).alias("value"), F.col("rank").cast("long").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 51")
def global_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(51)


@query(
    "SELECT event_id, CAST(coalesce(sum(CAST(floor(value) AS BIGINT) % 7 - 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM events"
)
def cumulative_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length change of all variants before each one."""
    change = F.floor("value") % 7 - 3
    return groups.prefix_sums(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], change, "shift").select("event_id", "shift")


@query(
    _E + "SELECT p.event_id, p.t + CAST(coalesce(sum(CAST(floor(q.value) AS BIGINT) % 7 - 3), 0) AS BIGINT) AS lifted FROM e p LEFT JOIN e q ON q.user_id = p.user_id AND q.event_type = 'error' AND q.t + 1 <= p.t WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.t"
)
def coord_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates moved by the length changes of all variants before them."""
    e = _times(spark, sf_dir)
    points = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("coord"))
    changes = e.where("event_type = 'error'").select("user_id", F.col("t").alias("pos"), (F.floor("value") % 7 - 3).alias("change"))
    return lifted(points, changes, "user_id").select("event_id", "lifted")


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS file_no FROM orders")
def file_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups.numbered(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select("o_orderkey", F.floor(F.col("row_id") / 1000).alias("file_no"))


@query("SELECT c_custkey AS id, c_acctbal AS bal, 1 AS label FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 0 FROM supplier")
def union_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.lit(1).alias("label"))
    return fg.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.lit(0).alias("label")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select("o_custkey"))


@query(
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus IN ('F') AND l_quantity >= 10 AND ((l_returnflag = 'R' AND l_discount >= 0.03 AND l_discount < 0.08) OR (l_returnflag = 'A' AND l_tax >= 0.02) OR (l_returnflag = 'N' AND l_tax >= 0.05 AND l_discount >= 0.05))"
)
def quality_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compound predicate by genotype class."""
    q = (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 10)
    het = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.03) & (F.col("l_discount") < 0.08)
    indel = (F.col("l_returnflag") == "A") & (F.col("l_tax") >= 0.02)
    hom = (F.col("l_returnflag") == "N") & (F.col("l_tax") >= 0.05) & (F.col("l_discount") >= 0.05)
    return read(spark, sf_dir, "lineitem").where(q & (het | indel | hom)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, round((log2(a / (1 - a)) - log2(b / (1 - b))) / 2.5, 6) AS delta, round(greatest(least((log2(a / (1 - a)) - log2(b / (1 - b))) / 2.5, 1), -1), 6) AS clamped FROM (SELECT *, greatest(least(l_quantity / 51, 1 - 1e-12), 1e-12) AS a, greatest(least(l_discount + 0.01, 1 - 1e-12), 1e-12) AS b FROM lineitem)")
def logit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores.scaled_delta(F.col("l_quantity") / 51, F.col("l_discount") + 0.01, F.lit(2.5), clamp=1e-12)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(d, 6).alias("delta"), F.round(scores.clamped(d), 6).alias("clamped"))


@query("SELECT l_orderkey, l_linenumber, round((log10(l_extendedprice) - 4.5) / 0.4, 6) AS z FROM lineitem")
def zscore_log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scores.zscore_log10("l_extendedprice", 4.5, 0.4), 6).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN (l_tax - l_discount) / l_discount ELSE 0 END, 6) AS norm_delta FROM lineitem")
def norm_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scores.norm_delta("l_tax", "l_discount"), 6).alias("norm_delta"))


@query("SELECT c_custkey, coalesce(try_cast(nullif(substr(c_name, 16), '') AS INTEGER), 99) AS rank, row_number() OVER (ORDER BY coalesce(try_cast(nullif(substr(c_name, 16), '') AS INTEGER), 99), CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END NULLS LAST, c_custkey) AS place FROM customer")
def natural_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers first by value, names without a number as 99, missing values last."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.expr("substr(c_name, 16)").try_cast("int"), F.lit(99)).alias("rank"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    placed = groups.numbered(c, ["rank", F.asc_nulls_last("bal"), "c_custkey"], "place")
    return placed.select("c_custkey", "rank", (F.col("place") + 1).cast("long").alias("place"))
