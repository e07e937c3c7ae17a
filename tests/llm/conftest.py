from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pytest


@pytest.fixture
def noisy(spark):
    """Adds columns whose names operators are likely to use themselves."""

    def add(d: DataFrame) -> DataFrame:
        return d.withColumns({c: F.lit(f"own {c}") for c in ("doc", "id", "row", "n", "key", "node", "start", "lines", "score", "value", "k1", "bytes") if c not in d.columns})

    return add
