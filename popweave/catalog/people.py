"""Person-record queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from popweave.catalog.registry import CODE, IN_GROUP, PERSONS, SLOT_HITS, persons, query, sql_values, table
from popweave.functions import codes as C, text as T
from popweave.functions.predicates import any_slot, parse_filters
from popweave.functions.numbers import half_even, percent
from popweave.operators import ranking as R, weighted as W
from popweave.operators.order_statistics import running_weight
from popweave.plans import education as E, microdata as M

SLOTS = ["ANC1P", "ANC2P"]


@query(f"""WITH {PERSONS}
SELECT "STATE", CAST(coalesce(sum("PWGTP"), 0) AS BIGINT) AS weighted_count,
  coalesce(label, "STATE") AS state_name
FROM persons LEFT JOIN {sql_values(C.STATE_NAMES)} ON "STATE" = code
WHERE {IN_GROUP} GROUP BY "STATE", label""")
def weighted_count_null_kept(spark, d):
    rows = persons(spark, d, ("customer",)).where(any_slot(SLOTS, CODE))
    return M.counts_by_state(rows)


@query(f"""WITH {PERSONS}
SELECT "RAC1P", CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM persons WHERE {IN_GROUP} GROUP BY "RAC1P" """)
def counts_by_race(spark, d):
    return M.counts_by(persons(spark, d, ()).where(any_slot(SLOTS, CODE)), "RAC1P")


@query(f"""WITH {PERSONS}
SELECT "NATIVITY", CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM persons WHERE {IN_GROUP} GROUP BY "NATIVITY" """)
def counts_by_nativity(spark, d):
    return M.counts_by(persons(spark, d, ("orders",)).where(any_slot(SLOTS, CODE)), "NATIVITY")


@query(f"""WITH {PERSONS}
SELECT "STATE", "PUMA", "PWGTP", CAST("AGEP" AS BIGINT) AS "AGEP", CAST("RAC1P" AS BIGINT) AS "RAC1P",
  CAST("NATIVITY" AS BIGINT) AS "NATIVITY", "ANC1P", "ANC2P", CAST("SCHL" AS BIGINT) AS "SCHL", CAST("ESR" AS BIGINT) AS "ESR", "PINCP" FROM persons WHERE {IN_GROUP}""")
def population_extract(spark, d):
    people = persons(spark, d)
    as_text = people.select(*[F.col(c).cast("string").alias(c) for c in people.columns])
    return M.extract_population(as_text, CODE)


@query(f"""WITH {PERSONS}
SELECT "RAC1P", CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM persons WHERE "RAC1P" IS NOT NULL GROUP BY "RAC1P" """)
def group_sum_null_dropped(spark, d):
    return W.group_sum(persons(spark, d, ()), ["RAC1P"], "PWGTP", "weighted_count")


@query(f"""WITH {PERSONS} SELECT CAST(coalesce(sum("PWGTP"), 0) AS BIGINT) AS total FROM persons""")
def global_total(spark, d):
    return W.sum_or_total(persons(spark, d, ()), [None], "PWGTP")


@query(f"""WITH {PERSONS}
SELECT "ANC1P", "ANC2P", count(*) AS n, CAST(sum("PWGTP") AS BIGINT) AS weight
FROM persons WHERE {IN_GROUP} GROUP BY ALL""")
def any_slot_filter(spark, d):
    rows = persons(spark, d, ()).where(any_slot(SLOTS, CODE))
    return rows.groupBy(*SLOTS).agg(F.count("*").alias("n"), F.sum("PWGTP").alias("weight"))


@query(f"""WITH {PERSONS}
SELECT count(*) AS n FROM persons WHERE "ANC1P" = '7' OR "ANC2P" = '7'""")
def any_slot_as_text(spark, d):
    return persons(spark, d, ()).where(any_slot(SLOTS, CODE, as_string=True)).agg(F.count("*").alias("n"))


@query(f"""WITH {PERSONS}, both_slots AS (
  SELECT "SOCP" AS code, "PWGTP" FROM persons WHERE "AGEP" BETWEEN 16 AND 99 AND TRY_CAST("ANC1P" AS DOUBLE) = 7
  UNION ALL
  SELECT "SOCP" AS code, "PWGTP" FROM persons WHERE "AGEP" BETWEEN 16 AND 99 AND TRY_CAST("ANC2P" AS DOUBLE) = 7)
SELECT code, CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM both_slots GROUP BY code""")
def slot_sum_tabulate(spark, d):
    return W.tabulate_slots(persons(spark, d, ("part",)), "SOCP", {"AGEP": "16:99"}, "PWGTP", SLOTS, CODE)


@query(f"""WITH {PERSONS}
SELECT "SOCP" AS code, CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM persons
WHERE "AGEP" BETWEEN 16 AND 40 AND "ESR" IN (1, 2) AND TRY_CAST("ANC1P" AS DOUBLE) = 7 GROUP BY 1""")
def filter_grammar(spark, d):
    filters = {"AGEP": "16:40", "ESR": "1,2", "ANC1P": "7"}
    return W.tabulate(persons(spark, d, ("part",)), "SOCP", filters, "PWGTP")


@query(f"""WITH {PERSONS}
SELECT variable, CAST(sum(CASE WHEN trim(answer) = '1' THEN "PWGTP" ELSE 0 END) AS BIGINT) AS weighted_count FROM (
  SELECT 'HICOV' AS variable, "HICOV" AS answer, "PWGTP" FROM persons
  UNION ALL SELECT 'HINS1', "HINS1", "PWGTP" FROM persons
  UNION ALL SELECT 'HINS2', "HINS2", "PWGTP" FROM persons
  UNION ALL SELECT 'HINS4', "HINS4", "PWGTP" FROM persons
  UNION ALL SELECT 'PRIVCOV', "PRIVCOV", "PWGTP" FROM persons) GROUP BY variable""")
def indicator_mix(spark, d):
    return W.indicator_mix(persons(spark, d, ()), ["HICOV", "HINS1", "HINS2", "HINS4", "PRIVCOV"], "PWGTP")


@query(f"""WITH {PERSONS}, counts AS (
  SELECT "SOCP" AS code, CAST(sum("PWGTP" * {SLOT_HITS}) AS BIGINT) AS weighted_count FROM persons
  WHERE "AGEP" BETWEEN 16 AND 99 AND "ESR" IN (1, 2) AND {IN_GROUP} GROUP BY 1)
SELECT code, weighted_count, CASE code WHEN 'Brand#3' THEN 'Third brand' WHEN 'Brand#11' THEN 'Eleventh brand'
    WHEN 'Brand#7' THEN 'Seventh' ELSE code END AS label,
  round(weighted_count / (SELECT sum(weighted_count) FROM counts), 9) AS share
FROM counts ORDER BY weighted_count DESC, code LIMIT 15""")
def share_of_total_topn(spark, d):
    titles = {"Brand#3": "Third brand", "Brand#11": "Eleventh brand"}
    brands = table(spark, d, "part").select(F.col("p_brand").alias("code")).distinct()
    # a published list that names some codes, repeats others and lacks the rest
    labels = brands.where("code <> 'Brand#11'").withColumn(
        "label", F.when(F.col("code") == "Brand#7", "Seventh").otherwise(F.col("code"))
    )
    top = M.top_occupations(persons(spark, d, ("part",)), CODE, labels, titles)
    return top.withColumn("share", F.round("share", 9))


@query(f"""WITH {PERSONS}
SELECT "STATE", CAST(sum(CASE WHEN "NATIVITY" = 1 THEN "PWGTP" ELSE 0 END) AS BIGINT) AS native,
  CAST(sum(CASE WHEN "NATIVITY" = 2 THEN "PWGTP" ELSE 0 END) AS BIGINT) AS born_abroad,
  CAST(sum(CASE WHEN "AGEP" >= 16 AND "ESR" = 3 THEN "PWGTP" ELSE 0 END) AS BIGINT) AS unemployed
FROM persons WHERE "STATE" IS NOT NULL GROUP BY 1""")
def conditional_weighted_sums(spark, d):
    flags = C.person_flags(F.col("AGEP"), F.col("NATIVITY"), F.col("ESR"))
    return W.conditional_sums(
        persons(spark, d),
        ["STATE"],
        "PWGTP",
        {"native": flags["native"], "born_abroad": flags["foreign"], "unemployed": flags["adult"] & flags["unemployed"]},
    )


@query(f"""WITH {PERSONS}
SELECT "RAC1P", round(sum(coalesce("PINCP", 0) * "PWGTP") / sum("PWGTP"), 4) AS mean FROM persons
WHERE "RAC1P" IS NOT NULL GROUP BY 1""")
def weighted_mean(spark, d):
    means = W.weighted_mean(persons(spark, d, ()), ["RAC1P"], "PINCP", "PWGTP")
    return means.withColumn("mean", F.round("mean", 4))


MEDIAN_SQL = """SELECT {by}, min(x) AS median FROM (
  SELECT {by}, x, sum(w) OVER (PARTITION BY {by} ORDER BY x) AS upto, sum(w) OVER (PARTITION BY {by}) AS whole
  FROM (SELECT {by}, {x} AS x, sum("PWGTP") AS w FROM persons WHERE {cond} GROUP BY ALL))
WHERE 2 * upto >= whole GROUP BY ALL"""


@query(f"WITH {PERSONS} " + MEDIAN_SQL.format(by='"RAC1P"', x='"PINCP"', cond='"RAC1P" IS NOT NULL AND "PINCP" IS NOT NULL'))
def weighted_median(spark, d):
    return W.weighted_median(persons(spark, d, ()), ["RAC1P"], "PINCP", "PWGTP")


@query(f"WITH {PERSONS} " + MEDIAN_SQL.format(by='"STATE"', x='coalesce("PINCP", 0)', cond="TRUE"))
def weighted_median_null_kept(spark, d):
    return W.weighted_median(
        persons(spark, d, ("customer",)), ["STATE"], "PINCP", "PWGTP", null_as_zero=True, null_keys="keep"
    )


@query(f"""WITH {PERSONS}
SELECT "RAC1P", x, w, CAST(sum(w) OVER (PARTITION BY "RAC1P" ORDER BY x) AS BIGINT) AS upto,
  CAST(sum(w) OVER (PARTITION BY "RAC1P") AS BIGINT) AS total
FROM (SELECT "RAC1P", "FOD1P" AS x, CAST(sum("PWGTP") AS BIGINT) AS w FROM persons WHERE "RAC1P" IS NOT NULL GROUP BY ALL)""")
def cumulative_weight(spark, d):
    rows = persons(spark, d, ()).select("RAC1P", F.col("FOD1P").alias("x"), F.col("PWGTP").alias("w"))
    return running_weight(rows, ["RAC1P"], "x", "w", rows_per_bucket=1 << 12)


@query(f"""WITH {PERSONS}
SELECT "STATE", round(sum(CASE WHEN "AGEP" >= 16 AND "ESR" IN (1, 2) THEN "PWGTP" END)
  / NULLIF(sum(CASE WHEN "AGEP" >= 16 AND "ESR" IN (1, 2, 3) THEN "PWGTP" END), 0), 9) AS rate
FROM persons WHERE "STATE" IS NOT NULL GROUP BY 1""")
def rate_in_subuniverse(spark, d):
    people = persons(spark, d).where("STATE is not null")
    f = C.person_flags(F.col("AGEP"), F.col("NATIVITY"), F.col("ESR"))
    rate = W.rate_of(f["employed"], f["adult"] & f["in_labour_force"], F.col("PWGTP"))
    return people.groupBy("STATE").agg(F.round(rate, 9).alias("rate"))


def _profile_sql(where: str) -> str:
    def counted(cond: str, name: str) -> str:
        return f'CAST(sum(CASE WHEN {cond} THEN "PWGTP" ELSE 0 END) AS BIGINT) AS {name}'

    parts = [
        ("native", '"NATIVITY" = 1'),
        ("foreign", '"NATIVITY" = 2'),
        ("edu_lt_hs", '"SCHL" BETWEEN 1 AND 15'),
        ("edu_hs", '"SCHL" = 16'),
        ("edu_some_aa", '"SCHL" BETWEEN 17 AND 21'),
        ("edu_ba", '"SCHL" = 22'),
        ("edu_grad_plus", '"SCHL" BETWEEN 23 AND 25'),
    ]
    counts = ", ".join(counted(cond, f'"{n}"') for n, cond in parts)
    shares = ", ".join(f'round("{n}" / pop, 9) AS "pct_{n}"' for n, _ in parts)
    names = ", ".join(f'"{n}"' for n, _ in parts)
    return f"""people AS (SELECT * FROM persons WHERE {where}),
counted AS (SELECT "STATE", "PUMA", CAST(sum("PWGTP") AS BIGINT) AS pop, {counts},
    round(sum(coalesce("PINCP", 0) * "PWGTP") / sum("PWGTP"), 4) AS income_mean,
    round(sum(CASE WHEN "AGEP" >= 16 AND "ESR" IN (1, 2) THEN "PWGTP" END)
      / sum(CASE WHEN "AGEP" >= 16 AND "ESR" IN (1, 2, 3) THEN "PWGTP" END), 9) AS employment_rate
  FROM people WHERE "STATE" IS NOT NULL AND "PUMA" IS NOT NULL GROUP BY 1, 2),
running AS (SELECT "STATE", "PUMA", x, sum(w) OVER (PARTITION BY "STATE", "PUMA" ORDER BY x) AS upto,
    sum(w) OVER (PARTITION BY "STATE", "PUMA") AS whole
  FROM (SELECT "STATE", "PUMA", coalesce("PINCP", 0) AS x, sum("PWGTP") AS w FROM people GROUP BY ALL)),
medians AS (SELECT "STATE", "PUMA", min(x) AS income_median FROM running WHERE 2 * upto >= whole GROUP BY 1, 2)
SELECT c."STATE", c."PUMA", pop, {names}, income_mean, income_median, employment_rate, {shares}
FROM counted c JOIN medians m ON c."STATE" = m."STATE" AND c."PUMA" = m."PUMA" """


def _rounded_profile(wide):
    ratios = {c: F.round(c, 9) for c in wide.columns if c.startswith("pct_") or c == "employment_rate"}
    return wide.withColumns({**ratios, "income_mean": F.round("income_mean", 4)})


@query(f"WITH {PERSONS}, " + _profile_sql("TRUE"))
def group_profile(spark, d):
    return _rounded_profile(W.group_profile(persons(spark, d), ["STATE", "PUMA"]))


@query(
    f"""WITH {PERSONS}, top_states AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS s
  FROM supplier GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), """
    + _profile_sql(f'{IN_GROUP} AND "STATE" IN (SELECT s FROM top_states)')
)
def area_dashboard(spark, d):
    totals = (
        table(spark, d, "supplier")
        .groupBy(F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("state"))
        .agg(F.count("*").alias("n"))
    )
    states = M.largest_states(totals, "n", 5)
    return _rounded_profile(M.area_dashboard(persons(spark, d), CODE, states))


RACE_AREAS = PERSONS.replace('c_mktsegment AS "PUMA"', 'CAST(NULLIF(l_suppkey % 9 + 1, 5) AS VARCHAR) AS "PUMA"')


@query(f"""WITH {RACE_AREAS}, profile AS (WITH """ + _profile_sql("\"ANC1P\" = '7' OR \"ANC2P\" = '7'") + """),
names AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS "PUMA_CODE", n_name AS puma_name FROM nation WHERE n_nationkey <> 3)
SELECT profile.*, lpad("PUMA", 5, '0') AS "PUMA_CODE", puma_name FROM profile LEFT JOIN names ON lpad("PUMA", 5, '0') = names."PUMA_CODE" """)
def area_dashboard_named(spark, d):
    """Codes as text, so that only "7" counts and not "0007"; one area has no name."""
    people = persons(spark, d).withColumn("PUMA", F.col("RAC1P").cast("string"))
    nation = table(spark, d, "nation").where("n_nationkey <> 3")
    names = nation.select(T.zero_pad("n_nationkey", 5).alias("PUMA_CODE"), F.col("n_name").alias("puma_name"))
    return _rounded_profile(M.area_dashboard(people, CODE, names=names, as_string=True))


@query(f"""WITH {PERSONS}
SELECT CASE WHEN "EDUCD" < 62 THEN '< HS' WHEN "EDUCD" IN (62, 63) THEN 'HS or GED' WHEN "EDUCD" IN (64, 65) THEN 'Some college'
    WHEN "EDUCD" >= 100 AND "EDUCD" < 112 THEN 'Associate' WHEN "EDUCD" = 113 THEN 'Bachelor''s'
    WHEN "EDUCD" >= 114 THEN 'Graduate' END AS detailed,
  CASE WHEN "SCHL" < 15 THEN '< HS' WHEN "SCHL" = 15 THEN 'HS or GED' WHEN "SCHL" IN (16, 17, 18) THEN 'Some college'
    WHEN "SCHL" = 19 THEN 'Associate' WHEN "SCHL" = 20 THEN 'Bachelor''s' WHEN "SCHL" >= 21 THEN 'Graduate' END AS short,
  CASE WHEN "SCHL" BETWEEN 1 AND 15 THEN '<HS' WHEN "SCHL" = 16 THEN 'HS' WHEN "SCHL" BETWEEN 17 AND 21 THEN 'Some/AA'
    WHEN "SCHL" = 22 THEN 'BA' WHEN "SCHL" BETWEEN 23 AND 25 THEN 'Grad+' END AS profile,
  CAST(sum("PWGTP") AS BIGINT) AS weighted_count
FROM persons GROUP BY ALL""")
def bin_codes_three_tables(spark, d):
    people = persons(spark, d, ("part",)).select(
        "PWGTP",
        C.bin_codes(F.col("EDUCD"), C.ATTAINMENT_DETAILED).alias("detailed"),
        C.bin_codes(F.col("SCHL"), C.ATTAINMENT_SHORT).alias("short"),
        C.bin_codes(F.col("SCHL"), C.ATTAINMENT_PROFILE).alias("profile"),
    )
    return W.weighted_count(people, ["detailed", "short", "profile"], "PWGTP")


ATTAINED = """attained AS (SELECT *, CASE WHEN "EDUCD" < 62 THEN '< HS' WHEN "EDUCD" IN (62, 63) THEN 'HS or GED'
  WHEN "EDUCD" IN (64, 65) THEN 'Some college' WHEN "EDUCD" >= 100 AND "EDUCD" < 112 THEN 'Associate'
  WHEN "EDUCD" = 113 THEN 'Bachelor''s' WHEN "EDUCD" >= 114 THEN 'Graduate' END AS attain_bin FROM persons)"""
ATTAINED_SHORT = """attained AS (SELECT *, CASE WHEN "SCHL" < 15 THEN '< HS' WHEN "SCHL" = 15 THEN 'HS or GED'
  WHEN "SCHL" IN (16, 17, 18) THEN 'Some college' WHEN "SCHL" = 19 THEN 'Associate'
  WHEN "SCHL" = 20 THEN 'Bachelor''s' WHEN "SCHL" >= 21 THEN 'Graduate' END AS attain_bin FROM persons)"""


@query(f"""WITH {PERSONS}, {ATTAINED}
SELECT attain_bin, CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM attained
WHERE attain_bin IS NOT NULL GROUP BY 1""")
def attainment_national(spark, d):
    return E.attainment(E.with_attainment(persons(spark, d, ("part",))))


@query(f"""WITH {PERSONS}, {ATTAINED}
SELECT "STATE", attain_bin, CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM attained
WHERE attain_bin IS NOT NULL AND "STATE" IS NOT NULL GROUP BY 1, 2""")
def attainment_by_state(spark, d):
    return E.attainment_by_state(E.with_attainment(persons(spark, d)), "STATE")


@query(f"""WITH {PERSONS}, {ATTAINED_SHORT}
SELECT "NATIVITY", CAST(coalesce(sum("PWGTP") FILTER (attain_bin = 'Bachelor''s'), 0) AS BIGINT) AS "Bachelor's",
  CAST(coalesce(sum("PWGTP") FILTER (attain_bin = 'Graduate'), 0) AS BIGINT) AS "Graduate",
  CAST(sum("PWGTP") AS BIGINT) AS "BA+"
FROM attained WHERE attain_bin IN ('Bachelor''s', 'Graduate') AND "NATIVITY" IS NOT NULL GROUP BY 1""")
def bachelor_by_nativity(spark, d):
    people = persons(spark, d, ("part", "orders")).drop("EDUCD")
    return E.bachelor_by_nativity(E.with_attainment(people))


@query(f"""WITH {PERSONS}, {ATTAINED_SHORT}
SELECT "STATE", CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM attained
WHERE attain_bin IN ('Bachelor''s', 'Graduate') AND "STATE" IS NOT NULL
GROUP BY 1 ORDER BY weighted_count DESC, 1 LIMIT 12""")
def top_bachelor_states(spark, d):
    return E.top_bachelor_states(E.with_attainment(persons(spark, d).drop("EDUCD")))


@query(f"""WITH {PERSONS}, {ATTAINED_SHORT}
SELECT CAST(f AS DOUBLE) AS "FODP", CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM (
  SELECT "FOD1P" AS f, "PWGTP", attain_bin FROM attained UNION ALL SELECT "FOD2P", "PWGTP", attain_bin FROM attained)
WHERE attain_bin IN ('Bachelor''s', 'Graduate') AND f BETWEEN 1100 AND 6199
GROUP BY 1 ORDER BY weighted_count DESC, 1 LIMIT 15""")
def unpivot_slots_range(spark, d):
    return E.top_fields_of_degree(E.with_attainment(persons(spark, d, ("part",)).drop("EDUCD")))


@query(f"""WITH {PERSONS}
SELECT "PUMA", {", ".join(f'CAST(coalesce(sum("PWGTP") FILTER ("ESR" = {i}), 0) AS BIGINT) AS esr_{i}' for i in range(1, 8))},
  CAST(sum("PWGTP") AS BIGINT) AS all_of_them
FROM persons GROUP BY 1""")
def pivot_sum(spark, d):
    return W.pivot_sum(persons(spark, d, ("customer",)), ["PUMA"], "ESR", "PWGTP", row_total="all_of_them", prefix="esr_")


COVERED = f"""covered AS (SELECT trim("HICOV") AS code, CAST(sum("PWGTP" * {SLOT_HITS}) AS BIGINT) AS weighted_count
  FROM persons WHERE "HICOV" IS NOT NULL AND "AGEP" BETWEEN 0 AND 99 AND {IN_GROUP} GROUP BY 1)"""


@query(f"""WITH {PERSONS}, {COVERED}
SELECT code, weighted_count, CASE code WHEN '1' THEN 'With coverage' WHEN '2' THEN 'No coverage' ELSE code END AS label,
  round(weighted_count / (SELECT sum(weighted_count) FROM covered), 9) AS rate FROM covered""")
def insurance_coverage(spark, d):
    return M.insurance_coverage(persons(spark, d, ("part",)), CODE).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {PERSONS}, {COVERED}, answers AS (
  SELECT 'HINS1' AS variable, 'Employer/Union' AS label, "HINS1" AS a, * FROM persons
  UNION ALL SELECT 'HINS2', 'Direct-Purchase', "HINS2", * FROM persons
  UNION ALL SELECT 'HINS4', 'Medicaid', "HINS4", * FROM persons
  UNION ALL SELECT 'PRIVCOV', 'Any Private', "PRIVCOV", * FROM persons)
SELECT variable, label,
  CAST(sum(CASE WHEN trim(a) = '1' THEN "PWGTP" * {SLOT_HITS} ELSE 0 END) AS BIGINT) AS weighted_count,
  round(sum(CASE WHEN trim(a) = '1' THEN "PWGTP" * {SLOT_HITS} ELSE 0 END)
    / (SELECT sum(weighted_count) FROM covered), 9) AS percent
FROM answers WHERE "AGEP" BETWEEN 0 AND 99 GROUP BY 1, 2""")
def insurance_mix(spark, d):
    return M.insurance_mix(persons(spark, d, ("part",)), CODE).withColumn("percent", F.round("percent", 9))


@query(f"""WITH {PERSONS}, counts AS (SELECT "ESR" AS code, CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM persons GROUP BY 1)
SELECT code, weighted_count, round_even(weighted_count / (SELECT sum(weighted_count) FROM counts) * 100, 1) AS percent,
  CAST(round_even(weighted_count / 1000, 0) AS BIGINT) AS thousands FROM counts""")
def percent_one_decimal(spark, d):
    counts = W.tabulate(persons(spark, d, ()), "ESR", {}, "PWGTP")
    shares = W.share_of_total(counts, "weighted_count")
    return shares.select(
        "code", "weighted_count", percent("share").alias("percent"),
        half_even(F.col("weighted_count") / 1000).alias("thousands"),
    )


@query(f"""WITH {PERSONS}
SELECT "AGEP" >= 16 AS adult, coalesce("NATIVITY" = 1, FALSE) AS native, coalesce("NATIVITY" = 2, FALSE) AS born_abroad,
  "ESR" IN (1, 2) AS employed, "ESR" = 3 AS unemployed, "ESR" IN (1, 2, 3) AS in_labour_force, count(*) AS n
FROM persons GROUP BY ALL""")
def person_flags(spark, d):
    flags = C.person_flags(F.col("AGEP"), F.col("NATIVITY"), F.col("ESR"))
    flags["born_abroad"] = flags.pop("foreign")
    people = persons(spark, d, ("part", "orders"))
    return people.groupBy(*[c.alias(n) for n, c in flags.items()]).agg(F.count("*").alias("n"))


@query(f"""WITH {PERSONS}
SELECT "SOCP", "STATE", "RAC1P", "PINCP" FROM (
  SELECT *, row_number() OVER (PARTITION BY "STATE" ORDER BY "PINCP" DESC NULLS LAST, "SOCP", "RAC1P" NULLS LAST) AS r
  FROM persons WHERE "STATE" IS NOT NULL) WHERE r <= 10""")
def topn_per_group(spark, d):
    people = persons(spark, d).select("SOCP", "STATE", "RAC1P", "PINCP")
    return R.top_n_per_group(people, ["STATE"], [("PINCP", "desc"), "SOCP", "RAC1P"], 10)


@query(f"""WITH {PERSONS}, parts AS (SELECT code, CAST(sum("PWGTP") AS BIGINT) AS weighted_count FROM (
  SELECT "SOCP" AS code, "PWGTP" FROM persons WHERE "ESR" = 1 UNION ALL SELECT "SOCP", "PWGTP" FROM persons WHERE "ESR" <= 2)
  GROUP BY 1) SELECT * FROM parts""")
def sum_of_partials(spark, d):
    people = persons(spark, d, ("part",))
    parts = [W.tabulate(people, "SOCP", {"ESR": s}, "PWGTP") for s in ("1", "1,2")]
    return W.group_sum(parts[0].unionByName(parts[1]), ["code"], "weighted_count")


@query(f"""WITH {PERSONS} SELECT count(*) > 0 AS any_rows, count(*) AS n FROM persons
WHERE "AGEP" BETWEEN 20 AND 30 AND "SOCP" IN ('Brand#1', 'Brand#2')""")
def filters_on_text_and_ranges(spark, d):
    rows = persons(spark, d, ("part",)).where(parse_filters({"AGEP": "20:30", "SOCP": "Brand#1,Brand#2"}))
    return rows.agg((F.count("*") > 0).alias("any_rows"), F.count("*").alias("n"))


def _placed(rows):
    """With the place of each row in the order in which it comes out; for a handful of rows."""
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    return numbered.select(*rows.columns, F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("place"))


@query("""SELECT state, n, row_number() OVER (ORDER BY n DESC NULLS LAST, state NULLS LAST) AS place FROM (
  SELECT CASE WHEN c_nationkey <> 5 THEN c_nationkey END AS state, CASE WHEN c_nationkey % 6 <> 0 THEN count(*) END AS n
  FROM customer GROUP BY c_nationkey)""")
def sorted_places(spark, d):
    """Descending by a measure, missing last, ties by key."""
    nation = F.col("c_nationkey")
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("all"))
    rows = counts.select(F.when(nation != 5, nation).alias("state"), F.when(nation % 6 != 0, F.col("all")).alias("n"))
    return _placed(R.sort_rows(rows, [("n", "desc"), "state"]))


@query("""SELECT year, segment, n, row_number() OVER (ORDER BY year, segment DESC) AS place FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS segment, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""")
def mixed_direction_places(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy(F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return _placed(R.sort_rows(counts, ["year", ("segment", "desc")]))


@query("""SELECT p_brand AS brand, n, row_number() OVER (ORDER BY n, p_brand) AS place FROM (
  SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 9)""")
def resorted_places(spark, d):
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return _placed(R.top_n_resorted(counts, [("n", "desc"), "brand"], 9, ["n", "brand"]))


@query("""SELECT status, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = status) AS present
FROM (VALUES ('F'), ('O'), ('P'), ('Z')) AS t(status)""")
def rows_present(spark, d):
    orders = table(spark, d, "orders")
    found = [(s, W.has_rows(orders.where(F.col("o_orderstatus") == s))) for s in "FOPZ"]
    return spark.createDataFrame(found, "status string, present boolean")
