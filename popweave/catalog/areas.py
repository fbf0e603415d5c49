"""Apportionment, crosswalk weights and class breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query, table
from popweave.functions.text import zero_pad
from popweave.operators import apportion as A, classify as K
from popweave.operators.overlay import crosswalk_weights
from popweave.plans import maps as Z

STATS_SQL = """stats AS (SELECT l_partkey, lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS geoid, sum(l_quantity) AS estimate,
    max(p_retailprice) / 100 AS moe FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
  xwalk AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip, l_partkey, sum(l_quantity) AS q,
    sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_partkey) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def _stats(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("estimate"))
    rows = lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        zero_pad("l_partkey", 11).alias("geoid"), "estimate", (F.col("p_retailprice") / 100).alias("moe")
    )


def _published_crosswalk(spark, d):
    """A crosswalk as published: other names, unpadded targets, prefixed source ids, ratios as text."""
    lines = table(spark, d, "lineitem")
    pairs = lines.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    wholes = lines.groupBy("l_partkey").agg(F.sum("l_quantity").alias("whole"))
    rows = pairs.join(wholes, "l_partkey")
    raw = rows.select(
        F.col("l_suppkey").cast("string").alias("ZIP"),
        F.concat(F.lit("1400000US"), F.lit("-"), zero_pad("l_partkey", 11)).alias("ignored"),
        zero_pad("l_partkey", 11).alias("TRACT"),
        (F.col("q") / F.col("whole")).cast("string").alias("RES_RATIO"),
    )
    return A.load_crosswalk(raw)


@query("""SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip, lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS tract,
  round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_partkey), 9) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey""")
def load_crosswalk(spark, d):
    return _published_crosswalk(spark, d).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {STATS_SQL} SELECT zip, CAST(round_even(sum(estimate * weight), 0) AS BIGINT) AS estimate,
  CAST(round_even(sqrt(sum((moe * weight) ** 2)), 0) AS BIGINT) AS moe
FROM stats s JOIN xwalk x ON s.l_partkey = x.l_partkey GROUP BY zip""")
def apportion_moe(spark, d):
    return Z.estimates_by_zip(_stats(spark, d), _published_crosswalk(spark, d), key_digits=11)


@query(f"""WITH {STATS_SQL} SELECT zip, round(sum(estimate * weight), 4) AS estimate, round(sqrt(sum((moe * weight) ** 2)), 6) AS moe
FROM (SELECT l_partkey % 1000 AS k, estimate, moe FROM stats) s
JOIN (SELECT zip, l_partkey % 1000 AS k, weight FROM xwalk) x ON s.k = x.k GROUP BY zip""")
def key_width_join(spark, d):
    """Six-digit keys: areas whose ids end alike all match, and the width is found from the crosswalk."""
    parts = _stats(spark, d)
    stats = parts.withColumn(
        "geoid", F.concat(F.lit("36"), F.substring("geoid", 6, 3), F.lit("000"), F.substring("geoid", 9, 3))
    )
    short = _published_crosswalk(spark, d)
    short = short.withColumn("tract", F.concat(F.lit("000"), F.right("tract", F.lit(3))))
    out = A.apportion(stats, short, rounded=False)
    return out.withColumns({"estimate": F.round("estimate", 4), "moe": F.round("moe", 6)})


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS nta, r_name AS ntaname, CAST(round_even(sum(est), 0) AS BIGINT) AS estimate,
  CAST(round_even(sqrt(sum(moe * moe)), 0) AS BIGINT) AS moe
FROM (SELECT c_nationkey, sum(c_acctbal) AS est, sqrt(count(*)) * 3.7 AS moe FROM customer GROUP BY 1)
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def rollup_nested_moe(spark, d):
    stats = table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.sum("c_acctbal").alias("estimate"), (F.sqrt(F.count("*")) * 3.7).alias("moe")
    )
    stats = stats.select(zero_pad("c_nationkey", 11).alias("geoid"), "estimate", "moe")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = rows.select(
        F.concat(F.lit("tract "), zero_pad("n_nationkey", 11)).alias("BCTCB2020"),
        F.col("n_regionkey").cast("string").alias("NTA2020"), F.col("r_name").alias("NTAName"),
    )
    return Z.estimates_by_neighbourhood(stats, A.load_nested_crosswalk(raw))


@query("""SELECT l_partkey, l_suppkey, round(l_quantity / l_extendedprice, 9) AS weight FROM lineitem
WHERE l_quantity / l_extendedprice > 0.0005""")
def crosswalk_weights_by_area(spark, d):
    pieces = table(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", F.col("l_quantity").alias("inter_area"), F.col("l_extendedprice").alias("source_area")
    )
    weighted = crosswalk_weights(pieces, "l_partkey", eps=0.0005)
    return weighted.select("l_partkey", "l_suppkey", F.round("weight", 9).alias("weight"))


@query("""SELECT l_partkey, l_suppkey, round(CASE WHEN whole > 0 THEN part / whole ELSE fraction END, 9) AS weight FROM (
  SELECT l_partkey, l_suppkey, l_quantity / l_extendedprice AS fraction, l_quantity / l_extendedprice * pop AS part,
    sum(l_quantity / l_extendedprice * pop) OVER (PARTITION BY l_partkey) AS whole
  FROM (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 5 = 1 THEN 0 ELSE l_partkey END AS pop FROM lineitem))""")
def crosswalk_pop_weights(spark, d):
    pop = F.when(F.col("l_partkey") % 5 == 0, F.lit(0)).when(F.col("l_partkey") % 5 != 1, F.col("l_partkey"))
    pieces = table(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", F.col("l_quantity").alias("inter_area"), F.col("l_extendedprice").alias("source_area"),
        pop.alias("tract_pop"),
    )
    weighted = crosswalk_weights(pieces, "l_partkey", population="tract_pop")
    return weighted.select("l_partkey", "l_suppkey", F.round("weight", 9).alias("weight"))


@query("""SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 7 AS VARCHAR), 3, '0')
    || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS geoid,
  CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal ELSE 0 END AS estimate, CAST(c_nationkey AS DOUBLE) AS moe
FROM customer WHERE (c_nationkey = 3 AND c_custkey % 7 IN (1, 5)) OR (c_nationkey = 4 AND c_custkey % 7 = 2)""")
def area_estimates(spark, d):
    raw = table(spark, d, "customer").select(
        zero_pad("c_nationkey", 2).alias("state"),
        zero_pad(F.col("c_custkey") % 7, 3).alias("county"),
        zero_pad("c_custkey", 6).alias("tract"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal").cast("string")).otherwise("null").alias("E"),
        F.col("c_nationkey").cast("string").alias("M"),
    )
    kept = A.area_estimates(raw, "E", "M", {"03": ["001", "005"], "04": ["002"]})
    return A.read_area_stats(kept.drop("geoid"))


def _classes(rows):
    return rows.groupBy("class").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("v").alias("different")
    ).select(F.col("class").cast("bigint").alias("class"), "n", "low", "high", "different")


CLASS_SUMMARY = """SELECT class, count(*) AS n, min(v) AS low, max(v) AS high, count(DISTINCT v) AS different
FROM (SELECT v, CAST(len(list_filter(b, lambda x: x < v)) AS BIGINT) AS class FROM vals, breaks) GROUP BY class"""


def _values(spark, d):
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice")).alias("v"),
    )


VALUES_SQL = "vals AS (SELECT CASE WHEN l_linenumber < 7 THEN l_extendedprice ELSE 0 END AS v FROM lineitem)"


@query(f"""WITH {VALUES_SQL}, breaks AS (SELECT list_distinct(quantile_cont(v, [1/6, 2/6, 3/6, 4/6, 5/6, 1])) AS b FROM vals)
{CLASS_SUMMARY}""")
def quantile_classes(spark, d):
    rows = K.classify(_values(spark, d), "v", "quantiles", 6)
    return _classes(rows.withColumn("v", F.coalesce("v", F.lit(0.0))))


@query(f"""WITH {VALUES_SQL} SELECT unnest(range(1, 11)) AS i, round(unnest(b), 4) AS bound FROM (
  SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS b FROM vals)""")
def quantile_bounds(spark, d):
    breaks = K.quantile_breaks(_values(spark, d), "v", 10)
    return breaks.select(F.posexplode("breaks").alias("i", "bound")).select(
        (F.col("i") + 1).cast("bigint").alias("i"), F.round("bound", 4).alias("bound")
    )


@query(f"""WITH {VALUES_SQL}, ends AS (SELECT min(v) AS lo, max(v) AS hi FROM vals),
breaks AS (SELECT list_append([lo + (hi - lo) / 5 * i FOR i IN [1, 2, 3, 4]], hi) AS b FROM ends) {CLASS_SUMMARY}""")
def equal_interval_classes(spark, d):
    rows = K.classify(_values(spark, d), "v", "equal", 5)
    return _classes(rows.withColumn("v", F.coalesce("v", F.lit(0.0))))


# means and assignments in turns, until the bounds stay; the values have two decimals, so sums of hundredths are exact
@query(f"""WITH RECURSIVE {VALUES_SQL},
merged AS (SELECT v, count(*) AS n, CAST(round(v * 100) AS HUGEINT) AS cents FROM vals GROUP BY v),
start AS (SELECT list_distinct(quantile_cont(v, [1/5, 2/5, 3/5, 4/5])) AS b FROM vals),
rounds AS (
  SELECT 0 AS round, list_sort(b) AS b, CAST([] AS DOUBLE[]) AS before FROM start
  UNION ALL
  SELECT round + 1, [(means[i] + means[i + 1]) / 2 FOR i IN range(1, len(means))], b FROM (
    SELECT round, b, list(m ORDER BY c) AS means FROM (
      SELECT round, b, c, CAST(sum(cents * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) / 100 AS m FROM (
        SELECT round, b, cents, n, CASE WHEN v <= b[1] THEN 0 WHEN v <= b[2] THEN 1 WHEN v <= b[3] THEN 2 WHEN v <= b[4] THEN 3 ELSE 4 END AS c
        FROM rounds, merged WHERE b <> before)
      GROUP BY round, b, c)
    GROUP BY round, b)),
breaks AS (SELECT b FROM rounds ORDER BY round DESC LIMIT 1) {CLASS_SUMMARY}""")
def natural_classes(spark, d):
    rows = K.classify(_values(spark, d), "v", "naturalbreaks", 5)
    return _classes(rows.withColumn("v", F.coalesce("v", F.lit(0.0))))


@query()
def approximate_quantile_bounds(spark, d):
    breaks = K.approximate_quantile_breaks(_values(spark, d), "v", 10)
    return breaks.select(F.posexplode("breaks").alias("i", "bound"))


@query(f"""WITH {VALUES_SQL} SELECT CAST(i AS INTEGER) AS i, count(*) AS n, TRUE AS close FROM vals, range(1, 11) t(i) GROUP BY i""")
def approximate_quantile_ranks(spark, d):
    """Whether each approximate tenth stands at its place among all values, by 1 in 10,000 of them at most."""
    values = _values(spark, d).select(F.coalesce("v", F.lit(0.0)).alias("v"))
    breaks = K.approximate_quantile_breaks(values, "v", 10).scalar()
    tenths = [F.get(breaks, F.lit(i)) for i in range(10)]
    below = [F.count_if(F.col("v") < b).alias(f"below{i}") for i, b in enumerate(tenths)]
    upto = [F.count_if(F.col("v") <= b).alias(f"upto{i}") for i, b in enumerate(tenths)]
    ranks = values.agg(F.count("*").alias("n"), *below, *upto)
    slack = F.col("n") / 10_000 + 1
    rows = [
        F.struct(F.lit(i + 1).alias("i"), "n", F.coalesce(
            (F.col(f"below{i}") <= F.col("n") * (i + 1) / 10 + slack) & (F.col(f"upto{i}") >= F.col("n") * (i + 1) / 10 - slack), F.lit(False)
        ).alias("close"))
        for i in range(10)
    ]
    return ranks.select(F.inline(F.array(*rows)))


@query(f"WITH {VALUES_SQL} SELECT count(DISTINCT v) AS n_distinct FROM vals")
def distinct_values(spark, d):
    return K.distinct_values(_values(spark, d), "v")
