import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401  (registers the package for the workers)
from songloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "songloom-tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def blocks(spark):
    """Block table from ``{signal: [[samples of channel 0], ...]}``."""
    def make(signals, block=4, sr=20, kind="double"):
        rows, cast = [], float if kind == "double" else int
        for signal_id, channels in signals.items():
            for ch, samples in enumerate(channels):
                for no, start in enumerate(range(0, max(len(samples), 1), block)):
                    rows.append((signal_id, ch, no, start, sr, [cast(x) for x in samples[start:start + block]]))
        return spark.createDataFrame(rows, f"signal_id {'string' if rows and isinstance(rows[0][0], str) else 'long'}, ch int, block_no long, start_idx long, sr int, samples array<{kind}>")

    return make


@pytest.fixture
def samples():
    """``{(signal, ch): [values]}`` of a block table, in order of position."""
    def read(df, col="samples"):
        out = {}
        rows = df.select("signal_id", "ch", "start_idx", col).collect()
        for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            out.setdefault((r[0], r[1]), []).extend(r[3])
        return out

    return read
