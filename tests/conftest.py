import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from dqloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folders = {
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared-checkpoints")),
    }
    session = local_session("tests", "*", 8, **{"spark.driver.memory": "8g", **folders})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    from dqloom.plans.testbed import Tables

    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def generated(spark):
    """Envelopes of the small generated data set, kept in memory."""
    from dqloom.sources import generated as G

    envelopes = G.as_envelopes(G.payloads(spark, G.PRESETS["small"]), "gen").cache()
    envelopes.count()
    return envelopes


def failed(rows) -> dict:
    """check name -> violations, for the checks that found any."""
    return {r["check_name"]: r["rows_failed"] for r in rows if r["rows_failed"]}
