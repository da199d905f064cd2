import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    """A small table with one of everything: gaps, a copy, spellings, text numbers and dates, sentinels."""
    data = [
        # id, city, price, joined_on, code, is_member, comment, source, score
        (1, "Oslo", 10.0, "2024-01-05", "7", 1, None, "web", 5.0),
        (2, "oslo ", 12.0, "01/17/2024", "8", 0, None, "web", None),
        (3, "Bergen", None, "20240211", "9", 1, None, "web", 6.0),
        (4, "BERGEN", 11.0, "2024-03-01", "10", 0, "late", "web", 7.0),
        (5, None, 13.0, "2024-03-09", "11", 0, None, "web", 5.0),
        (6, "Oslo", -999.0, "2024-04-02", "12", 1, None, "web", 6.0),
        (7, "Voss", 12.0, "2024-04-03", "13", 1, None, "web", 7.0),
        (7, "Voss", 12.0, "2024-04-03", "13", 1, None, "web", 7.0),
        (8, None, None, "2024-05-06", "14", 1, None, "web", None),
        (9, "Voss", 14.0, "2024-05-07", "15", 0, None, "web", 5.0),
        (10, "Oslo", 60000.0, "2024-06-01", "16", 0, None, "web", 6.0),
    ]
    return spark.createDataFrame(
        data, "id long, city string, price double, joined_on string, code string, is_member int, comment string, source string, score double")
