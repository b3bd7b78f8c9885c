import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The awkward documents as a Parquet table."""
    from cases import frame

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    from cases import empty

    return empty(spark)
