"""Operators on small tables with known results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone import queries, queries_venues  # noqa: F401
from marlstone.functions import labels, prices
from marlstone.operators import asof, bars, diff, latest, sequences
from marlstone.plans import catalog, history, merging, tape, validation
from marlstone.sources import sinks, views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)


def matches_sql(spark, tmp_path, name, events):
    """A query's rows over these events (event_id, ts, user_id, event_type, value) are its SQL's."""
    from datetime import datetime

    events = [(i, datetime.fromisoformat(at), *rest, "{}") for i, at, *rest in events]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", events)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLES[name])
    assert rows(found.select(*want.columns)) == sorted(want.fetchall(), key=repr)


def test_history_rounding(spark, tmp_path):
    """A price that is just below a half isn't rounded up; a day's last half second counts as the next day's."""
    same = [(1, "2024-01-02 01:00:00", 1, "view", 226.0), (2, "2024-01-02 02:00:00", 1, "view", 224.0), (3, "2024-01-03 02:00:00", 1, "view", 114.0), (4, "2024-01-03 03:00:00", 1, "view", 112.0)]
    late = [(k, f"2024-01-0{d} {at}", u, "view", 100.0) for k, (u, d, at) in enumerate([(2, 2, "23:59:59.600000"), (2, 3, "00:00:01"), (3, 2, "23:59:59.500000"), (3, 3, "00:00:00.500000"), (4, 2, "23:59:59.400000"), (4, 3, "05:00:00")], 5)]
    matches_sql(spark, tmp_path, "history_reconcile", same + late)


def test_merge_ties(spark, tmp_path):
    """Of events of one millisecond those before the delayed one aren't late; equal events are numbered in the table's order."""
    same = [(i, "2024-01-02 01:00:00.005000", i % 3, "view", 1.0) for i in range(76, 85)]
    equal = [(i, f"2024-01-02 0{h}:00:00", 5, "click", 1.0) for h, ids in ((2, (119, 120, 121)), (3, (160, 161, 163)), (4, (199, 200))) for i in ids]
    matches_sql(spark, tmp_path, "merge_copies", same + equal)


def test_fills_exact(spark, tmp_path):
    """Amounts just below a multiple of 2^48, and large ones, are exact."""
    M = 1_000_000_007**2
    ids = [i for i in range(6_000_000) if i * M % 2**48 >= 2**48 - 2**26]
    assert any(all(i % k for k in (5, 7, 9, 11, 13)) for i in ids)
    matches_sql(spark, tmp_path, "order_fills", [(i, "2024-01-02", 1, "view", 1.0) for i in [*ids, 1, 17, 10**9 + 7, 10**12 + 1]])


def test_topbook_zero(spark, tmp_path):
    """A book of price 0 or of no price is crossed and unflagged as any other."""
    kinds = ("view", "view", "click", "error", "view", "view")
    matches_sql(spark, tmp_path, "validate_topbook", [(50 + k, "2024-01-02", 1, kind, value) for k, (kind, value) in enumerate(zip(kinds, (0.0, 1.0, 0.0, 500.0, 0.01, None)))])


def test_bars(spark):
    quotes = spark.createDataFrame([(t, k, m, s) for k, ms, s in (("t1", (0.4, 0.6, 0.5), 100.0), ("t2", (0.5, 0.5, 0.5), 50.0)) for t, m in zip((0, 20, 40), ms)], "ts long, token_id string, mid double, spread_bps double")
    got = {r.token_id: r for r in bars.bar_features(quotes, 60, 60).collect()}
    assert got["t1"].spread_bps_mean == 100 and got["t2"].spread_bps_mean == 50 and got["t1"].rv > 0 and got["t2"].rv == 0 and got["t1"].n_obs == 3
    later = spark.createDataFrame([(t, "t1", m, 1.0) for t, m in zip((0, 20, 60, 600), (0.4, 0.6, 0.5, 0.7))], "ts long, token_id string, mid double, spread_bps double")
    got = sorted(bars.bar_features(later, 60, 600).collect(), key=lambda r: r.bar_start)
    assert [r.n_obs for r in got] == [2, 1, 1] and abs(got[-1].rv - 0.5821755410922375) < 1e-9
    got = sorted(bars.bar_features(later, 120, 30).collect(), key=lambda r: r.bar_start)
    assert [r.n_obs for r in got] == [3, 1] and got[0].rv == 0


def test_asof_nulls_and_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), (None, 5), ("b", None)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), (None, 1, "z"), ("b", 1, "w")], "k string, at int, v string")
    got = {(r.k, r["at"]): r.r_v for r in asof.asof_join(left, right, ["k"], "at", "at").collect()}
    assert got == {("a", 5): "y", ("a", 1): None, (None, 5): None, ("b", None): None}
    got = {(r.k, r["at"]): r.r_v for r in asof.asof_join(left, right, ["k"], "at", "at", forward=True).collect()}
    assert got[("a", 1)] == "x"


def test_reconcile_nulls(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", 1.0), ("y", None)], "k string, v double")
    b = spark.createDataFrame([(None, 1.0), ("x", 1.0 + 1e-13), ("y", 2.0), ("z", 1.0)], "k string, v double")
    got = {r.k: r.status for r in diff.reconcile(a, b, ["k"], ["v"]).collect()}
    assert got == {None: "match", "x": "match", "y": "mismatch", "z": "extra"}


def test_quotes(spark):
    one = spark.range(1)
    for in_yes, want in ((True, (0.40, 0.43, 0.57, 0.60)), (False, (0.40, 0.62, 0.38, 0.60))):
        made = prices.quotes(F.lit(0.40), F.lit(0.43 if in_yes else 0.38), F.lit(10.0), F.lit(2.0), no_in_yes_prices=in_yes)
        r = one.select(*[c.alias(k) for k, c in made.items()]).first()
        assert (r.yes_bid, r.yes_ask, r.no_bid, r.no_ask) == want and r.no_ask_source == "complement_derived" and r.no_bid_size == 2.0


def test_payout_labels(spark):
    pairs = [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5), (0.25, 0.75), (0.0, 0.0), (2.0, -1.0), (None, 1.0)]
    got = [r.l for r in spark.createDataFrame(pairs, "y double, n double").select(labels.binary_payout_label(F.col("y"), F.col("n")).alias("l")).collect()]
    assert got == ["yes", "no", "refund", "payout:yes=1/2,no=1/2", "payout:yes=1/4,no=3/4", None, None, None]
    got = [r.l for r in spark.createDataFrame([("1",), ("0.0",), ("0.65",), ("x",), ("2",), (None,)], "v string").select(labels.settlement_label(F.col("v")).alias("l")).collect()]
    assert got == ["yes", "no", "scalar:13/20", None, None, None]


def test_tape(spark):
    levels = spark.createDataFrame([("m", 1, 1, "bid", 0.40, 10.0), ("m", 1, 1, "ask", 0.60, 5.0), ("m", 1, 2, "ask", 0.55, 7.0), ("m", 1, 2, "ask", 0.60, 0.0)], "book string, epoch int, seq int, side string, price double, size double")
    got = {r.seq: (r.best_bid, r.bid_size, r.best_ask, r.ask_size, r.n_levels) for r in tape.tops(levels, ["book"]).collect()}
    assert got == {1: (0.40, 10.0, 0.60, 5.0, 2), 2: (0.40, 10.0, 0.55, 7.0, 2)}
    events = spark.createDataFrame([("m", 1, 1, 10, "delta"), ("m", 1, 2, 20, "checkpoint"), ("m", 1, 2, 30, "delta")], "book string, epoch int, seq int, received int, kind string")
    assert {r.problem for r in tape.violations(events, ["book"]).collect()} == {"duplicate coordinate", "delta before checkpoint"}
    deltas = spark.createDataFrame([("m", 1, "bid", 0.4, 10.0, True), ("m", 2, "bid", 0.4, -4.0, False), ("m", 3, "bid", 0.4, 5.0, True)], "book string, seq int, side string, price double, delta double, snapshot boolean")
    assert [r["size"] for r in tape.relative_fold(deltas, ["book"]).orderBy("seq").collect()] == [10.0, 6.0, 5.0]


def test_merge(spark):
    cols = "copy string, seq long, received_ms long, scope string, venue_ms long, digest string"
    feed = spark.createDataFrame([("a", 1, 1000, "s", 900, "x"), ("a", 2, 1100, "s", 900, "x"), ("b", 1, 1050, "s", 900, "x"), ("b", 2, 999_999, "s", 950, "y")], cols)
    got = {(r.digest, r.k): (r.copies, r.late) for r in merging.merge(feed).collect()}
    assert got == {("x", 1): (["a", "b"], False), ("x", 2): (["a"], False), ("y", 1): (["b"], True)}


def test_validation(spark):
    good = spark.createDataFrame([("trade.v1", "kalshi", "t1", 0.5, 2.0, None, None)], "schema_version string, exchange string, trade_id string, price_dollars double, size_contracts double, capture_run string, capture_sequence long")
    assert validation.validate(good, validation.TRADE, strict=True).ok
    bad = good.union(good).withColumn("price_dollars", F.lit(1.5)).withColumn("capture_run", F.lit("r")).withColumn("more", F.lit(1))
    report = validation.validate(bad, validation.TRADE, strict=True)
    assert not report.ok and report.extra == ("more",) and set(report.problems) == {"price_dollars: outside 0 and 1", "capture coordinate is whole", "primary key (exchange, trade_id): duplicate values"}
    with pytest.raises(ValueError):
        validation.convert(bad, validation.TRADE)
    assert validation.coerce(good.drop("capture_run"), validation.TRADE).columns == [f.name for f in validation.TRADE.fields]


def test_sequences_empty(spark):
    none = spark.createDataFrame([], "k string, at long")
    assert sequences.sequence_gaps(none, ["k"], "at").count() == 0 and sequences.islands(none, ["k"], "at", F.lit(False)).count() == 0
    assert latest.profile(none, ["k"], "at").first().n_rows == 0 and history.sample_interval(none, "k", "at").count() == 0


def test_views_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("a", 0.4), ("b", 0.6)], "token_id string, mid double")
    sinks.write_atomic(a, f"{tmp_path}/m")
    with pytest.raises(FileExistsError):
        sinks.write_atomic(a, f"{tmp_path}/m")
    r = views.query(spark, "SELECT count(*) AS n, avg(mid) AS m FROM markets", {"markets": f"{tmp_path}/m"}).first()
    assert (r.n, r.m) == (2, 0.5)
    for broken in ({"markets": f"{tmp_path}/none*"}, {}, {"bad-name": f"{tmp_path}/m"}):
        with pytest.raises((ValueError, FileNotFoundError)):
            views.register_all(spark, broken)
    assert sinks.export_verified(a, f"{tmp_path}/e")["rows"] == 2
    snapshot = catalog.Snapshot(spark, {"markets": f"{tmp_path}/m"}, max_rows=1)
    assert snapshot.query("SELECT token_id FROM markets WHERE mid > ?", [0.5]).num_rows == 1
    for sql in ("DROP VIEW markets", "SELECT * FROM markets", "SET a=b"):
        with pytest.raises(ValueError):
            snapshot.query(sql)
    with pytest.raises(Exception):
        snapshot.query(f"SELECT * FROM parquet.`{tmp_path}/m`")


def test_live_books(spark, tmp_path):
    from marlstone.streaming import books

    sent = [("m", 1, "snapshot", "bid", 0.4, 10.0), ("m", 1, "snapshot", "ask", 0.6, 5.0), ("m", 2, "change", "ask", 0.55, 7.0), ("m", 4, "change", "bid", 0.41, 1.0)]
    spark.createDataFrame(sent, books.MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(books.MESSAGE).parquet(f"{tmp_path}/in")
    query = books.live_tops(stream).writeStream.format("memory").queryName("tops").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("tops").select("seq", "best_bid", "best_ask", "valid")) == [(1, 0.4, 0.6, True), (2, 0.4, 0.55, True), (4, 0.41, 0.55, False)]
