import csv
import io
import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recordloom.plans.catalog import Catalog  # noqa: E402
from recordloom.session import fresh_folder, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    yield session
    session.stop()


@pytest.fixture
def catalog(spark):
    return Catalog(spark, fresh_folder(spark, "test-catalog"))


@pytest.fixture
def write_file(tmp_path):
    def write(data: bytes | str, name: str | None = None) -> str:
        path = tmp_path / (name or f"{uuid.uuid4().hex}.csv")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data.encode() if isinstance(data, str) else data)
        return str(path)

    return write


# One row per rule of loading; the comma form has no line end after its last row.
STATIONS = [
    ["Code", "Place", "Open since"],
    ["007", "Harbour", "1931"],  # leading zeros stay
    ["12", "Mill; lower, upper", "1950"],  # both separators in a cell
    ["13", "Troms\u00f8", "1907"],  # beyond ASCII, within Windows-1252
    ["14", 'The "Old" Gate', "1888"],  # quotes in a cell
    ["15", "", "2001"],  # an empty cell
    ["16"],  # absent cells
    ["17", "Malm\u00f8", "1907"],  # a second match of a pattern and of a value
]


def as_csv(rows, sep=","):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows(rows)
    return out.getvalue()


def read_back(text, sep=","):
    """Rows behind the header by Python's own reader, absent cells as None."""
    header, *rows = csv.reader(io.StringIO(text), delimiter=sep)
    return [tuple(row + [None] * (len(header) - len(row))) for row in rows]


STATION_FILE = as_csv(STATIONS).rstrip("\n")
STATION_FILE_SEMICOLON = as_csv(STATIONS, ";")
STATION_ROWS = read_back(STATION_FILE)


def stored(catalog, dataset_id):
    return [tuple(r)[1:] for r in catalog.records(dataset_id).orderBy("__rownr").collect()]
