"""Pages are costly rows: the tasks that parse them follow the number of pages, and expressions look at each page once."""

import re

import pytest
from pyspark.sql import functions as F

from popweave import session
from popweave.catalog import QUERIES
from popweave.sources import pages as P

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["source_priority", "repeat_header_drop", "snapshot_by_month", "snapshot_schools_by_month"])
def test_tasks_follow_the_pages(spark, monkeypatch, name):
    """15,000 pages at 500 a task, whatever number other shuffles have."""
    monkeypatch.setattr(session.even_parts, "__defaults__", (500,))
    df = QUERIES[name](spark, SF_DIR)
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())]
    assert dealt and max(dealt) == 30


def test_widest_table_is_the_first_of_equals(spark):
    tables = [[["a"], ["b"]], [["c", "d"]], [["e", "f"], ["g", None]], [["h", "i"], ["j", "k"]]]
    df = spark.createDataFrame([(1, tables), (2, []), (3, None)], "id int, tables array<array<array<string>>>")
    found = {r.id: (r.two, r.one) for r in df.select("id", P.widest_table("tables", 2).alias("two"), P.widest_table("tables", 1).alias("one")).collect()}
    assert found == {1: (tables[2], tables[1]), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<a HREF = 'x/A.CSV?a=\"1\"&amp;b'>", 'https://e.org/d/x/A.CSV?a="1"&b'),
        ('<b data-csv-url="/it\'s">', "https://e.org/it's"),
        ('<a href="no.txt"><a href="y.csv"> data-csv-url="z"', "https://e.org/d/y.csv"),
        ("a .csv in text only", None),
        (None, None),
    ],
)
def test_csv_link(spark, html, expected):
    df = spark.createDataFrame([(html, "https://e.org/d/p")], "html string, url string")
    assert df.select(P.first_csv_link("html", F.col("url"))).first()[0] == expected
