import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from postmill.session import local_session  # noqa: E402

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)  # a Wednesday


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def emails(spark):
    """Factory of an emails table from (subject, body, sender, slug) rows."""

    def make(*rows):
        full = [(str(i), "u1", None, sender, subject, body, slug) for i, (subject, body, sender, slug) in enumerate(rows)]
        return spark.createDataFrame(
            full, "email_id string, user_id string, sender_name string, sender_email string, subject string, body string, slug string"
        )

    return make
