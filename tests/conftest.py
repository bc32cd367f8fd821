import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parcela.session import get_session
    s = get_session("parcela-tests", master="local[4]",
                    conf={"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
                          "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
                          "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
                          "spark.sql.execution.arrow.pyspark.enabled": "true"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE


@pytest.fixture(scope="module")
def clean_small(spark, sf_dir):
    from parcela.operators.clean import clean
    from parcela.session import held
    from parcela.sources.fixtures import raw_listings
    with held(clean(raw_listings(spark, sf_dir))) as rows:
        yield rows


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
