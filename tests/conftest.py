import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("termloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def keywords(spark):
    """Build a keyword table from columns, with row_ord in list order."""

    def build(**columns):
        names = list(columns)
        rows = list(zip(*columns.values(), strict=True))
        types = {n: "string" for n in names}
        for n in names:
            kinds = {type(v) for v in columns[n] if v is not None}
            if kinds and kinds <= {int, float}:
                types[n] = "double" if float in kinds else "long"
        schema = ", ".join(["row_ord long", *(f"`{n}` {t}" for n, t in types.items())])
        data = [
            (i, *(float(v) if types[n] == "double" and v is not None else v
                  for n, v in zip(names, r, strict=True)))
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(data, schema)

    return build
