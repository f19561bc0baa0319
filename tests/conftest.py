import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from terrapanel.session import session

    made = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(), "spark.sql.warehouse.dir": tmp_path_factory.mktemp("warehouse").as_uri(),
    })
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
