"""Every query that has SQL gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from quaystone.plans.catalogue import ORACLES, QUERIES
from quaystone.sources import testdata

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    """The trade and member tables, joined once for all queries; `test_trades` holds them against the joins."""
    path = tmp_path_factory.mktemp("trades")
    patch, made = pytest.MonkeyPatch(), {"trades": testdata.trades, "members": testdata.members}
    for name, make in made.items():
        make(spark, SF).coalesce(1).write.parquet(f"{path}/{name}")
        patch.setattr(testdata, name, lambda spark, d, name=name: spark.read.parquet(f"{path}/{name}"))
    yield made
    patch.undo()


def test_trades(spark, shared, duck):
    for name, make in shared.items():
        cols = [c for c in make(spark, SF).columns if c != "committees"]
        made = sorted(repr(tuple(r[c] for c in cols)) for r in make(spark, SF).collect())
        assert made == sorted(repr(tuple(r[c] for c in cols)) for r in getattr(testdata, name)(spark, SF).collect())
        view = {"trades": "feed", "members": "member"}[name]
        assert made == sorted(repr(r) for r in duck.execute(f"WITH {testdata.CTE.strip()} SELECT {', '.join(cols)} FROM {view}").fetchall())


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr(tuple(_plain(x[i]) for i in at)) for x in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ticker", "member_count", "trade_count"]
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
