import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wardlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "wardlog-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def as_lines(spark):
    """Text lines as a numbered line table of one job and file."""

    def make(text, job="job", file="file"):
        rows = [
            (job, file, n, line.strip())
            for n, line in enumerate(text.splitlines(), 1)
            if line.strip()
        ]
        return spark.createDataFrame(
            rows, "job_id string, source_file string, line_number long, raw_line string"
        )

    return make
