"""Physical plans: no nested-loop pairs, limits before shuffles, Python only where it has to be."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from popweave.catalog import QUERIES, areas, shapes
from popweave.operators import apportion as A, overlay as V
from popweave.plans import snapshots as N
from popweave.session import shared_root

SF_DIR = "/root/testdata/sf0.001"
PYTHON = {"html_tables", "source_priority", "repeat_header_drop", "snapshot_by_month", "snapshot_schools_by_month",
          "rows_by_name", "ring_overlay", "build_crosswalk", "estimates_from_shapes"}


def plan(spark, name):
    return driver.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_of_everything_and_no_stray_python(spark, name):
    text = plan(spark, name)
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", text)
    assert bool(re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow", text)) == (name in PYTHON)


def test_pages_are_parsed_once(spark):
    assert len(re.findall("ArrowEvalPython", plan(spark, "snapshot_by_month"))) == 1


def test_unlinked_pages_go_before_the_shuffle(spark):
    pages = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    links = spark.createDataFrame([("u7", 2024, 3, False)], "url string, year int, month int, flag boolean")
    text = N.snapshot_tables(links, pages)._jdf.queryExecution().optimizedPlan().toString()
    # nothing but the filter stands between the pages and the one aggregate that shuffles them
    assert "getbit" in text[text.index("max(html") :].split("Join")[0]


def test_overlay_runs_its_kernel_once_and_cuts_edges_before_they_travel(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = driver.queries()["ring_overlay"](spark, SF_DIR)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall("MapInPandas", final)) == 1
    kernel = final[final.index("MapInPandas") :]
    assert kernel.index("Exchange hashpartitioning(a_id") < kernel.index("SortMergeJoin")
    # below the second join the first side's edges are already cut
    assert re.search(r"flatten\(transform\(filter\(", kernel[kernel.index("SortMergeJoin") + 1 :])


def test_top_n_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "topn_per_group")
    assert "TakeOrderedAndProject" in plan(spark, "topn_global")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "partitioned_snapshots")
    assert re.search(r"PartitionFilters: \[isnotnull\(year", text)
    scan = plan(spark, "counts_by_race")
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>", scan)


def test_median_reads_its_input_once(spark):
    df = driver.queries()["weighted_median"](spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "ReusedSubquery" in final


def test_whole_groups_are_not_windowed_for_totals(spark):
    assert "Window" not in plan(spark, "group_total_on_rows")


def test_shared_root_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_root(spark) == configured.rstrip("/")


def jobs_of(spark, name, build):
    """What ``build`` gives, and the jobs it started; tables are read beforehand, as finding their columns is a job."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        made = build()
        return made, spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_crosswalk_runs_its_kernel_once_without_a_job_beforehand(spark):
    a, b = shapes._ring_sides(spark, SF_DIR)
    people = a.select("a_id", F.col("a_id").alias("tract_pop"))
    df, jobs = jobs_of(spark, "weights", lambda: V.build_crosswalk(a, b, people, "a_id", "b_id", project=False))
    assert not jobs
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("MapInPandas", final)) == 1


def test_apportion_starts_no_job_of_its_own(spark):
    stats, xwalk = areas._stats(spark, SF_DIR), areas._published_crosswalk(spark, SF_DIR)
    df, jobs = jobs_of(spark, "keys", lambda: A.apportion(stats, xwalk))
    assert not jobs
    assert "Subquery" in df._jdf.queryExecution().executedPlan().toString()
