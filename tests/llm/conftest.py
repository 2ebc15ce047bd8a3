import pytest
from pyspark.sql import types as T

FILES = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("repo_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def make_files(spark):
    """Rows (file_id, repo_id, path, content) with an extra column whose name clashes with internal ones."""
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], FILES)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, doc string")
