import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build

    folder = tempfile.mkdtemp(prefix="tidemark-test-")
    s = build("local[4]", 4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(pdf, columns):
    """Rows as a sorted list of texts, whatever the engine's number types."""

    def one(v):
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v == int(v) else v

    df = pdf[columns].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).map(one).itertuples(index=False, name=None)))
