import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from epochwise.plans.hubs import ship_package
    from epochwise.session import local_session

    session = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def hub(spark):
    from epochwise.plans.hubs import Hub

    return Hub(spark, SF_DIR)


@pytest.fixture(scope="session")
def con():
    import compare

    return compare.duck(SF_DIR)
