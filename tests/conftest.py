from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from aneroid.schema import SENSOR_SCHEMA  # noqa: E402
from aneroid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.maxMetadataStringLength": "10000"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Readings from a few named values per row; the rest gets defaults."""
    defaults = {
        "id": 1, "device_id": "d", "temp": 1.0, "humidity": 2.0, "pressure": 1000.0, "lat": 45.41, "lon": -122.73,
        "alt": 0.0, "sats": 0, "wind_speed": 1.0, "wind_direction": 0, "country": "US", "state": "Oregon",
        "city": "Portland", "postal_code": "97062", "timestamp": None, "processed_at": None,
    }

    def build(*rows: dict):
        full = []
        for i, row in enumerate(rows):
            row = {**defaults, "id": i + 1, **row}
            for c in ("timestamp", "processed_at"):
                if isinstance(row[c], str):
                    row[c] = dt.datetime.fromisoformat(row[c])
            full.append(tuple(row[f.name] for f in SENSOR_SCHEMA.fields))
        return spark.createDataFrame(full, SENSOR_SCHEMA)

    return build


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def base(spark, sf_dir):
    from aneroid.plans.readings import readings

    return readings(spark, sf_dir)


@pytest.fixture(scope="session")
def stored(spark, base, tmp_path_factory):
    """The same readings stored by date."""
    from aneroid.operators.sinks import write_readings

    path = str(tmp_path_factory.mktemp("readings") / "by-date")
    write_readings(base, path)
    return spark.read.parquet(path)
