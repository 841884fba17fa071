"""States that runs leave behind: versions, refreshes with a backlog, seen rows, digests; and landed files."""

import datetime as dt
import inspect
import os
import threading
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quaystone.functions import names
from quaystone.plans import digest, sinks, versions
from quaystone.sources import indexes
from quaystone.streaming import backlog, seen

TRADE = "id string, filing_id string, member_id string, ticker string, asset string, asset_type string, tx_type string, tx_date date, disclosed_date date, low_cents bigint, high_cents bigint, owner string"
DAY = dt.date(2025, 3, 1)


def trade(i, filing, member="m", ticker="AB", low=1):
    return (i, filing, member, ticker, ticker, "ST", "buy", DAY, DAY + dt.timedelta(days=int(filing[1:])), low, low, "self")


# Versions -----------------------------------------------------------------------------------------


def test_readers_during_publishes(spark, tmp_path):
    path = str(tmp_path / "feed")
    publish = lambda n: sinks.write_tables({"trades": spark.createDataFrame([(i,) for i in range(n)], "id int")}, path, "b1")
    publish(1)
    found, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                found.append(sinks.read_tables(spark, path, "trades").count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 22):
        publish(n)
    stop.set()
    reader.join()
    assert not failed and found == sorted(found) and len(found) > 3
    assert sinks.read_tables(spark, path, "trades", "b1").count() == 21
    with pytest.raises(sinks.EmptyFeed):
        sinks.read_tables(spark, path, "trades", "b2")
    with open(f"{path}/_versions/{21:012}.json", "w") as f:
        f.write('{"tables": {"tra')  # a writer that was cut off
    assert sinks.read_tables(spark, path, "trades").count() == 21
    assert publish(3) == 22


def test_two_writers(spark, tmp_path):
    path, numbers = str(tmp_path / "v"), []
    write = lambda who: [numbers.append(versions.commit(spark, path, {}, {"who": who, "i": i}).number) for i in range(10)]
    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(numbers) == list(range(20))
    with pytest.raises(versions.Overtaken):
        versions.commit(spark, path, {}, {}, after=3)


# Refreshes ----------------------------------------------------------------------------------------


def reader(spark, rows, failing=()):
    def read(filings):
        ids = {r.filing_id for r in filings.collect()}
        told = [(i, "failed" if i in failing else "parsed" if any(r[1] == i for r in rows) else "without_text") for i in sorted(ids)]
        return spark.createDataFrame([r for r in rows if r[1] in ids], TRADE), spark.createDataFrame(told, "filing_id string, status string")

    return read


def index(spark, *filings):
    return spark.createDataFrame([(f, DAY + dt.timedelta(days=int(f[1:]))) for f in filings], "filing_id string, filed_on date")


def test_capped_runs_end_in_the_same_feed(spark, tmp_path):
    old = [trade("a", "f1"), trade("b", "f1", low=2)]
    new = [trade(f"n{i}", f"f{i}", low=i) for i in range(2, 6)] + [trade("dup", "f6", low=2)]
    filings, read = index(spark, *[f"f{i}" for i in range(1, 7)]), reader(spark, new)
    kept = {}
    for cap in (2, 60):
        path = str(tmp_path / f"cap{cap}")
        backlog.seed(spark, path, spark.createDataFrame(old, TRADE))
        runs = [backlog.take(filings, 0, path, read, cap)]
        while runs[-1].facts["more_remaining"]:
            runs.append(backlog.drain(spark, path, filings.schema, read, cap))
        told = {r.filing_id: r.run for r in backlog.done(spark, path).collect()}
        kept[cap] = {r.id for r in backlog.trades(spark, path, spark.createDataFrame([], TRADE).schema).collect()}
        if cap == 2:
            assert [r.facts["downloaded"] for r in runs] == [2, 2, 1] and told == {"f1": 0, "f6": 1, "f5": 1, "f4": 2, "f3": 2, "f2": 3}
            assert [r.facts["new_filings"] for r in runs] == [5, 3, 1]
        else:
            assert len(runs) == 1 and runs[0].facts["added"] == 3
    assert kept[2] == kept[60] == {"a", "b", "n3", "n4", "n5"}


def test_failures_wait_and_batches_run_once(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(sinks.EmptyFeed):
        backlog.seed(spark, path, spark.createDataFrame([], TRADE))
    with pytest.raises(sinks.EmptyFeed):
        backlog.take(index(spark, "f2"), 0, path, None)
    backlog.seed(spark, path, spark.createDataFrame([trade("a", "f1")], TRADE), now=0)
    rows = [trade("x", "f9", low=9), trade("y", "f8", low=8)]
    first = backlog.take(index(spark, "f9", "f8", "f7"), 0, path, reader(spark, rows, failing={"f9"}), cap=2, now=10)
    assert (first.facts["failed"], first.facts["added"], first.facts["downloaded"]) == (1, 1, 1)
    assert backlog.take(index(spark, "f9"), 0, path, None) == first  # Spark runs a batch again
    # The one that failed comes after what has not been tried, and after new filings too.
    second = backlog.take(index(spark, "f9", "f10"), 1, path, reader(spark, rows), cap=2, now=20)
    assert {r.filing_id: (r.status, r.run) for r in backlog.done(spark, path).filter("run = 2").collect()} == {"f7": ("without_text", 2), "f10": ("without_text", 2)}
    assert second.facts["scanned"] == 2 and not second.facts["added"]
    third = backlog.drain(spark, path, index(spark, "f1").schema, reader(spark, rows), now=30)
    assert third.facts["added"] == 1 and backlog.drain(spark, path, index(spark, "f1").schema, reader(spark, rows), now=40).facts["new_filings"] == 0


def test_stream_and_intervals(spark, tmp_path):
    path, landing = str(tmp_path / "s"), str(tmp_path / "landing")
    rows = [trade("x", "f2", low=5), trade("y", "f3", low=6)]
    backlog.seed(spark, path, spark.createDataFrame([trade("a", "f1")], TRADE), now=1000)
    go = lambda now, who: backlog.refresh(spark, landing, index(spark, "f1").schema, path, reader(spark, rows), str(tmp_path / "checkpoint"), asked_by=who, now=now)
    index(spark, "f1", "f2").write.parquet(landing)
    assert go(1059, "foreground") is None and go(2799, "refresh") is None and go(1000 + 21599, "widget") is None
    go(1060, "foreground").awaitTermination()
    index(spark, "f1", "f2", "f3").write.mode("append").parquet(landing)
    assert go(2859, "refresh") is None
    go(1061, "asked").awaitTermination()
    assert {r.id for r in backlog.trades(spark, path, spark.createDataFrame([], TRADE).schema).collect()} == {"a", "x", "y"}


def test_no_reader_alters_a_refresh():
    """Nothing of what is watched can reach a refresh: no function takes it, and the module knows none of it."""
    told = {p for f in vars(backlog).values() if inspect.isfunction(f) and f.__module__ == backlog.__name__ for p in inspect.signature(f).parameters}
    assert not {p for p in told if "watch" in p or "follow" in p or "ticker" in p or "seen" in p}
    assert "quaystone.operators.watch" not in inspect.getsource(backlog) and "streaming import seen" not in inspect.getsource(backlog)


# Seen rows ----------------------------------------------------------------------------------------


def test_seen_steps(spark, tmp_path):
    path = str(tmp_path / "seen")
    rows = spark.createDataFrame([(f"i{b}-{i}", "AB" if i % 2 else None, "m", DAY + dt.timedelta(days=i), b) for b in range(5) for i in range(70)], "id string, ticker string, member_id string, disclosed_date date, arrived long")
    none = spark.createDataFrame([], "reader string, ticker string")
    ab, m = spark.createDataFrame([("r", " ab")], "reader string, ticker string"), spark.createDataFrame([("q", "m")], "reader string, member_id string")
    state = lambda: {r.reader: (r.upto, r.n_seen) for r in seen.states(spark, path).collect()}
    shown = lambda step: {x: sorted(r.row_id for r in seen.sections(spark, path).filter(F.col("step") == step).collect() if r.reader == x) for x in "qr"}
    seen.step(rows, 0, path, ab, m.limit(0), "1")
    assert state() == {"r": (0, 0)} and shown(0) == {"q": [], "r": []}  # all there is counts as seen
    seen.step(rows, 1, path, ab, m, "1")
    assert state() == {"r": (0, 35), "q": (1, 0)} and len(shown(1)["r"]) == 35
    seen.step(rows, 2, path, ab, m, "1")
    seen.step(rows, 2, path, ab, m, "1")  # again, after a failure
    assert len(shown(2)["q"]) == 50 and shown(2)["q"][0] == "i2-20"
    seen.step(rows, 3, path, none, m, "1")  # the other 20 of batch 2 wait, newer ones first
    assert state() == {"q": (1, 100)} and len([x for x in shown(3)["q"] if x.startswith("i3")]) == 50
    seen.step(rows, 4, path, ab, m, "2")  # another scheme: the ids of before mean nothing
    assert state() == {"q": (4, 0), "r": (4, 0)} and shown(4) == {"q": [], "r": []}


def test_weekly_digest(spark, tmp_path):
    path = str(tmp_path / "d")
    told = lambda *row: spark.createDataFrame([row] if row else [], "lead string, lead_n long, lead_label string")
    assert digest.publish(told(), path, "w1") == "none"
    assert digest.publish(told("late", 3, None), path, "w1") == "published"
    assert digest.publish(told("late", 3, None), path, "w1") == "unchanged"
    assert digest.publish(told("late", 4, None), path, "w1") == "replaced"
    assert digest.publish(told(None, None, None), path, "w1") == "withdrawn"
    assert digest.publish(told(), path, "w1") == "none"
    assert digest.publish(told("late", 4, None), path, "w2") == "published"


# Landed files -------------------------------------------------------------------------------------


def test_search_pages(spark):
    page = lambda o, n: (o, '{"data":[' + ",".join(['["a","b","c","d","e"]'] * n) + "]}")
    pages = lambda *p: indexes.search_pages(spark.createDataFrame(list(p), "offset long, value string"))
    assert sorted(r.offset for r in pages(page(0, 100), page(100, 3), page(300, 5)).collect()) == [0, 100]
    assert [r.offset for r in pages(page(0, 0)).collect()] == [0]
    for bad in ([page(0, 100), page(200, 3)], [page(0, 100), page(100, 100)], [page(100, 2)]):
        with pytest.raises(PySparkException, match="gap"):
            pages(*bad).collect()


def test_tiers(spark, tmp_path):
    now = dt.datetime.now()
    file = {t: str(tmp_path / t) for t in ("cache", "primary", "mirror", "bundled")}

    def put(tier, text="{}", days=0):
        with open(file[tier], "w") as f:
            f.write(text)
        at = (now - dt.timedelta(days=days)).timestamp()
        os.utime(file[tier], (at, at))

    pick = lambda: indexes.tiered(spark, file["cache"], file["primary"], file["mirror"], now, bundled=file["bundled"])
    assert pick() is None
    put("bundled")
    assert pick()[0] == "bundled"
    put("cache", days=8)
    assert pick()[0] == "stale"
    put("mirror")
    assert pick() == ("mirror", file["mirror"])
    put("primary", text="")
    assert pick()[0] == "mirror"  # an empty file is none
    put("primary", days=30)
    assert pick()[0] == "primary"
    put("cache", days=6)
    assert pick()[0] == "fresh"


def test_many_fragments_on_a_page(spark):
    rows = [("f", p, float(i % 3), 1 - (i // 3) * 0.02, f"t{i}") for p in range(2) for i in range(20_000)] + [("g", 0, 0.0, 0.5, "one"), ("g", 0, 0.1, None, "nowhere")]
    got = indexes.ocr_lines(spark.createDataFrame(rows, "filing_id string, page int, min_x double, mid_y double, text string")).collect()
    assert len(got) == 2 * 6667 + 1
    assert {r.line for r in got if r.line_no == 1} == {"t3  t4  t5"}


def test_names_beyond_latin1(spark):
    df = spark.createDataFrame([("Nguyễn Ștefan", "nguyen stefan"), ("Łukasz", "lukasz"), ("Ḱẽñ", "ken"), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(names.folded(F.col("a"))).collect()] == ["nguyen stefan", "lukasz", "ken", ""]
    other = df.select(F.upper("b").alias("c"))
    assert df.join(other, names.same(F.col("a"), F.col("c"))).count() == 3


def test_states_are_packed(spark, tmp_path):
    folder = versions.write(spark.range(10), str(tmp_path), "trades")
    files = [f.name for f in Path(folder).glob("part-*")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
