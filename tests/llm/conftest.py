import pytest
from odd_texts import DOCUMENTS
from pyspark.sql import SparkSession



@pytest.fixture(scope="session")
def documents(spark: SparkSession):
    """Make a documents table of texts or of whole rows, over several partitions."""

    def make(rows, schema=DOCUMENTS, partitions=3):
        rows = [
            row if isinstance(row, tuple) else (i, row, "en", "src0", len(row or ""))
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make
