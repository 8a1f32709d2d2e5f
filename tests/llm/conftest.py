from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents as given, with columns that clash with names the operators use inside."""

    def make(rows, **more):
        table = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        from pyspark.sql import functions as F

        return table.withColumns({"_id": F.lit(1), "_norm": F.lit("x"), "fp": F.lit(2), "length": F.lit(3), "_text": F.lit("y"), "kept": F.lit(False), **{k: F.lit(v) for k, v in more.items()}})

    return make
