import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """Small tables with nulls and repeats."""
    from gridsmith.frame import Table

    made = {
        "sample": ("id long, name string, value double, category string", [(1, "Lio", 110.0, "p"), (2, "Nat", 275.5, "q"), (3, "Mali", 310.0, "p"), (4, "Oto", 475.5, "q"), (5, "Pia", 750.0, "r")]),
        "sample2": ("user_id long, score double", [(4, 61.0), (5, 73.5), (6, None), (7, 44.0)]),
        "nulls": ("id long, name string, value double", [(1, "k", 10.0), (2, None, 30.0), (3, "m", None), (4, None, 80.0), (5, "w", None)]),
        "repeats": ("id long, name string, val long", [(1, "ab", 7), (2, "cd", 9), (2, "cd", 9), (3, "ef", 5), (4, "gh", 6), (4, "gh", 8), (4, "gh", 6)]),
        "strata": ("id long, strat_key string", [(i, k) for i, k in enumerate("w" * 10 + "x" * 5 + "y" * 3 + "z" * 2)]),
        "mixed": ("int_col long, float_col double, string_col string, bool_col boolean", [(7, 2.5, "u", True), (0, 0.0, "v", False), (None, 6.5, None, None), (9, None, "w", True)]),
        "bins": ("id long, score double, age long, grade string", list(zip(range(10), [12.0, 22.5, 31.0, 43.5, 52.0, 64.5, 71.0, 83.5, 94.0, 102.5], [17, 21, 24, 29, 33, 36, 41, 44, 52, 58], "XYXZYXZYXZ", strict=True))),
        "empty": ("id long, data string", []),
    }
    return {k: Table.of(spark.createDataFrame(rows, schema).coalesce(1)) for k, (schema, rows) in made.items()}
