import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voc.session import local_session

    session = local_session(4, "3g", "tests")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluates one expression on one row of named values."""
    from pyspark.sql import functions as F

    def run(make, **columns):
        row = spark.range(1).select(*[
            (F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>")).alias(k)
            for k, v in columns.items()
        ])
        return row.select(make(*[F.col(k) for k in columns]).alias("x")).first()["x"]

    return run
