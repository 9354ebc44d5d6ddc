import pytest
from edge_texts import SCHEMA, edge_rows


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def edge_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (None, 1, 1), (2, None, 1), (3, 0, 7), (5, 0, 1), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
