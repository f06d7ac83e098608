import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from slopefield.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_session(
        "slopefield-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def csv_file(tmp_path):
    """Write text to a new file and return its path."""

    def write(text: str, name: str = "table.csv", encoding: str = "utf-8") -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))
        return str(path)

    return write
