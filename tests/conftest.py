import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("sparktab-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def flowers(spark):
    """150 rows of three well separated kinds, the last row a copy of the first."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for kind, (a, b, c, d) in enumerate([(5.0, 3.4, 1.5, 0.2), (5.9, 2.8, 4.3, 1.3), (6.6, 3.0, 5.6, 2.0)]):
        for _ in range(50):
            rows.append(
                (*[round(float(rng.normal(m, s)), 4) for m, s in ((a, 0.35), (b, 0.3), (c, 0.25), (d, 0.15))],
                 ["setosa", "versicolor", "virginica"][kind])
            )
    rows[1] = rows[0]
    return spark.createDataFrame(
        rows, "sepal_length double, sepal_width double, petal_length double, petal_width double, species string"
    ).cache()


FLOWER_FEATURES = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
