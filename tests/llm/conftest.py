import pytest
from pyspark.sql import functions as F

CLASHING = {"id": "string", "text_": "string", "n": "long", "node": "long", "component": "string", "key": "int"}


@pytest.fixture
def documents(spark):
    """Documents as given, beside columns whose names an operator might use for itself."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({name: F.lit(None).cast(kind) for name, kind in CLASHING.items()})

    return make
