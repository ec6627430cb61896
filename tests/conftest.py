from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    s = SparkSession.builder.master("local[4]").config(map=settings).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
