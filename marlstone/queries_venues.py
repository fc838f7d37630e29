"""Registered queries of venue payloads, books, chains, captures, participants and table packs, with their DuckDB SQL.

Payloads are JSON texts made from the driver's rows so that every branch is taken; the SQL states from the same rows what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import markets as m
from marlstone.functions import prices, texts
from marlstone.operators import asof
from marlstone.plans import books, capture, catalog, chain, health, markets, merging, participants, resolution, specs, validation
from marlstone.queries import read, registered


def _json(text: str) -> Column:
    """A struct, given as SQL, as JSON text without nulls."""
    return F.to_json(F.expr(text))


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id",
        _json(
            "named_struct('id', if(event_id % 23 = 0, null, cast(event_id as string)), 'market_id', if(event_id % 46 = 0, concat('m', event_id), null),"
            " 'question', if(event_id % 3 = 0, '', concat('Q', event_id)), 'title', concat('T', event_id), 'slug', if(event_id % 5 = 0, concat(' x-updown-15m-', 1700000000 + event_id, ' '), concat('s-', event_id)),"
            " 'closed', if(event_id % 4 = 3, null, event_id % 4 = 0), 'volume', if(event_id % 2 = 0, 'none', '12.5'), 'volume24hr', event_id % 100, 'bestBid', (event_id % 50) / 100,"
            " 'best_ask', if(event_id % 7 = 0, null, cast((event_id % 50 + 2) / 100 as string)), 'outcomes', if(event_id % 6 = 0, '[]', '[\"No\", \" YES \"]'), 'outcomePrices', '[\"0.25\", \"0.75\"]',"
            " 'clobTokenIds', concat('[\"t', event_id, '\", \"t', event_id % 9, '\"]'), 'token_id', concat('t', event_id % 9), 'event', if(event_id % 8 = 0, named_struct('id', event_id % 10, 'slug', 'own'), null),"
            " 'events', if(event_id % 2 = 0, array(named_struct('id', concat('e', event_id % 10), 'slug', '', 'startTime', '2024-05-01', 'endDate', '2024-06-01')), null),"
            " 'endDate', if(event_id % 10 = 0, '', '2024-07-01'), 'startDate', '2024-01-01')"
        ).alias("payload"),
    )


MARKETS = """
WITH e AS (SELECT event_id AS i FROM events), b AS (SELECT *, (i % 50) / 100 AS bid, CASE WHEN i % 7 <> 0 THEN (i % 50 + 2) / 100 END AS ask FROM e)
SELECT CASE WHEN i % 23 <> 0 THEN i::VARCHAR ELSE 'm' || i END AS market_id,
       CASE WHEN i % 8 = 0 THEN (i % 10)::VARCHAR WHEN i % 2 = 0 THEN 'e' || (i % 10) END AS event_id, CASE WHEN i % 8 = 0 THEN 'own' END AS event_slug,
       CASE WHEN i % 3 = 0 THEN 'T' ELSE 'Q' END || i AS question, '2024-01-01' AS open_time, CASE WHEN i % 2 = 0 THEN '2024-05-01' ELSE '2024-01-01' END AS start_time,
       CASE WHEN i % 10 = 0 THEN '2024-06-01' ELSE '2024-07-01' END AS close_time, CASE WHEN i % 4 < 3 THEN i % 4 = 0 END AS closed,
       CASE WHEN i % 2 = 0 THEN (i % 100)::DOUBLE ELSE 12.5 END AS volume, bid AS yes_bid, ask AS yes_ask,
       round(coalesce((bid + ask) / 2, CASE WHEN i % 6 = 0 THEN 0.25 ELSE 0.75 END), 9) AS mid, round(ask - bid, 9) AS spread,
       't' || i || CASE WHEN i = i % 9 THEN '' ELSE ',t' || (i % 9) END AS tokens, CASE WHEN i % 6 = 0 THEN '[]' ELSE '["no","yes"]' END AS outcome_labels_json
FROM b WHERE i % 23 <> 0 OR i % 46 = 0"""


@registered(MARKETS)
def polymarket_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markets.polymarket_rows(_markets(spark, sf_dir))
    names = "market_id event_id event_slug question open_time start_time close_time closed volume yes_bid yes_ask".split()
    return rows.select(*names, F.round("mid", 9).alias("mid"), F.round("spread", 9).alias("spread"), F.array_join("token_ids", ",").alias("tokens"), "outcome_labels_json")


def _kalshi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        _json(
            "named_struct('ticker', concat(if(event_id % 11 = 0, 'KXMVE', 'KX'), event_id), 'title', if(event_id % 4 = 0, '::', concat('Will  it ', event_id)), 'yes_sub_title', if(event_id % 3 = 0, 'Above 5', ':'),"
            " 'custom_strike', if(event_id % 5 = 0, named_struct('a', ' ', 'b', 'Team  X'), null), 'status', case event_id % 6 when 0 then ' OPEN ' when 1 then 'settled' when 2 then 'determined' when 3 then '' when 4 then 'new' end,"
            " 'yes_bid_dollars', if(event_id % 7 = 0, null, cast((event_id % 40) / 100 as string)), 'no_bid_dollars', if(event_id % 9 = 0, 'NaN', cast((event_id % 30) / 100 as string)), 'yes_ask_dollars', if(event_id % 2 = 0, 0.9, null),"
            " 'isProvisional', case when event_id % 13 = 0 then 'yes' when event_id % 13 = 1 then 'no' end, 'settlementValue', if(event_id % 2 = 0, '1', ''), 'series_category', 'Sports', 'category', '')"
        ).alias("payload")
    )


@registered("""
WITH e AS (SELECT event_id AS i FROM events),
t AS (SELECT *, CASE WHEN i % 11 = 0 THEN 'KXMVE' ELSE 'KX' END || i AS ticker FROM e),
q AS (SELECT *, CASE WHEN i % 4 = 0 THEN ticker ELSE 'Will it ' || i END AS base, CASE WHEN i % 3 = 0 THEN 'Above 5' WHEN i % 5 = 0 THEN 'Team X' END AS strike,
             CASE i % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'finalized' WHEN 2 THEN 'determined' WHEN 4 THEN 'new' END AS status,
             CASE WHEN i % 7 <> 0 THEN (i % 40) / 100 END AS yes_bid, CASE WHEN i % 9 <> 0 THEN (i % 30) / 100 END AS no_bid FROM t),
p AS (SELECT *, CASE WHEN i % 2 = 0 THEN 0.9 ELSE round(1 - no_bid, 10) END AS yes_ask, round(1 - yes_bid, 10) AS no_ask FROM q)
SELECT ticker AS market_key, base || coalesce(' - ' || strike, '') AS question, status, coalesce(status IN ('finalized', 'determined'), false) AS closed, yes_bid, yes_ask, no_bid, no_ask,
       round((yes_bid + yes_ask) / 2, 9) AS mid, CASE WHEN i % 2 = 0 THEN '1' END AS settlement_value_dollars, 'Sports' AS category,
       CASE WHEN i % 13 = 0 THEN true WHEN i % 13 = 1 THEN false ELSE coalesce(status = 'determined', false) END AS is_provisional FROM p""")
def kalshi_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markets.kalshi_rows(_kalshi(spark, sf_dir))
    return rows.select("market_key", "question", "status", "closed", "yes_bid", "yes_ask", "no_bid", "no_ask", F.round("mid", 9).alias("mid"), "settlement_value_dollars", "category", "is_provisional")


@registered("""
WITH e AS (SELECT event_id AS i FROM events)
SELECT 'polymarket' AS venue, CASE WHEN i % 5 = 0 THEN 'polymarket_updown_15m' ELSE 'polymarket_conventional' END AS family, 'venue_identity' AS provenance, count(*) AS n FROM e WHERE i % 23 <> 0 OR i % 46 = 0 GROUP BY ALL
UNION ALL SELECT 'kalshi', CASE WHEN i % 11 = 0 THEN 'kalshi_mve' ELSE 'kalshi_conventional' END, 'legacy_ticker_compat', count(*) FROM e GROUP BY ALL""")
def catalog_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = markets.catalog_views(markets.polymarket_rows(_markets(spark, sf_dir)), markets.kalshi_rows(_kalshi(spark, sf_dir)))
    grouped = views["market_catalog"].groupBy("venue", F.col("operational_family").alias("family"), F.col("family_provenance").alias("provenance"))
    return grouped.agg(F.count(F.lit(1)).alias("n"))


@registered("""
WITH e AS (SELECT event_id AS i FROM events WHERE event_id % 23 <> 0 OR event_id % 46 = 0)
SELECT count(*) FILTER (WHERE i % 4 < 3 AND i % 4 <> 0 AND i % 6 <> 0 AND contains(lower(CASE WHEN i % 3 = 0 THEN 'T' ELSE 'Q' END || i), 'q1')) AS n_match, count(*) FILTER (WHERE i % 4 = 3) AS unknown_closed,
       count(*) FILTER (WHERE i % 6 = 0) AS unknown_outcome_count, 0 AS unknown_question FROM e""")
def market_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, unknown = markets.filtered(markets.polymarket_rows(_markets(spark, sf_dir)), markets.polymarket_filter(closed=False, question_contains="Q1", outcome_count=2))
    n = kept.agg(F.count(F.lit(1)).alias("n_match"))
    named = unknown.select(F.col("closed").alias("unknown_closed"), F.col("outcome_count").alias("unknown_outcome_count"), F.col("question_contains").cast("int").alias("unknown_question"))
    return n.join(named, F.lit(True))


@registered("SELECT i // 10 AS g, count(DISTINCT CASE WHEN i % 10 < 5 THEN i % 3 ELSE i % 10 END) AS n_prints FROM (SELECT event_id AS i FROM events) GROUP BY ALL")
def contract_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading doesn't change a contract's fingerprint; its terms and its events do, in whatever order of keys."""
    terms = "if(event_id % 10 < 5, event_id % 3, event_id % 10)"
    one = f"named_struct('question', 'q', 'volume', value, 'bestBid', value / 500, 'events', array(named_struct('id', {terms}, 'volume', value)), 'negRisk', true)"
    two = f"named_struct('negRisk', true, 'events', array(named_struct('volume', value, 'id', {terms})), 'liquidity', value, 'question', 'q')"
    payload = F.when(F.col("event_id") % 2 == 0, _json(one)).otherwise(_json(two))
    rows = read(spark, sf_dir, "events").select(F.expr("event_id div 10").alias("g"), markets.contract_fingerprint(payload).alias("f"))
    return rows.groupBy("g").agg(F.countDistinct("f").alias("n_prints"))


@registered("""
WITH e AS (SELECT event_id AS i FROM events),
c AS (SELECT i, CASE WHEN i % 10 = 0 THEN 1.5 WHEN i % 10 < 7 THEN (i % 100) / 100 END AS dollars, CASE WHEN i % 10 = 5 THEN 101.0 WHEN i % 10 IN (3, 7, 8) THEN (i % 100)::DOUBLE WHEN i % 10 = 4 THEN (i % 100) + 0.5 END AS cents, i % 10 = 9 AS bare FROM e),
p AS (SELECT *, CASE WHEN dollars > 1 THEN 'dollar price is no probability' WHEN cents > 100 THEN 'cents outside 0 and 100' WHEN abs(dollars - cents / 100) > 1e-12 THEN 'dollars and cents disagree' WHEN bare THEN 'price is ambiguous'
             WHEN i % 12 = 0 THEN 'size is not positive' WHEN i % 17 = 0 THEN 'no market or trade id' END AS problem FROM c)
SELECT 'T' || i AS venue_trade_id, problem, CASE WHEN problem IS NULL THEN round(coalesce(dollars, cents / 100), 9) END AS price, CASE WHEN problem IS NULL THEN (i % 12)::DOUBLE END AS quantity, TIMESTAMP '2024-01-01' + to_seconds(i) AS venue_time FROM p""")
def kalshi_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(
        _json(
            "named_struct('type', 'trade', 'msg', named_struct('market_ticker', if(event_id % 17 = 0, ' ', 'KX'), 'trade_id', concat('T', event_id),"
            " 'yes_price_dollars', case when event_id % 10 = 0 then '1.5' when event_id % 10 < 7 then cast((event_id % 100) / 100 as string) end,"
            " 'yes_price', case when event_id % 10 = 5 then 101D when event_id % 10 in (3, 7, 8) then cast(event_id % 100 as double) when event_id % 10 = 4 then event_id % 100 + 0.5D end,"
            " 'price', if(event_id % 10 = 9, 40, null), 'count', event_id % 12, 'taker_side', 'yes', 'ts', 1704067200 + event_id))"
        ).alias("message")
    )
    found = markets.trades(rows, "kalshi")
    return found.select("venue_trade_id", "problem", F.round("price", 9).alias("price"), "quantity", F.col("venue_time_utc").cast("timestamp_ntz").alias("venue_time"))


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book per supplier: a snapshot for each tenth line of it, changes between, a reconnection for every other hundredth."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rows.select(F.col("l_suppkey").alias("s"), key.alias("seq"), "d", "q", (F.col("l_linenumber") % 2 == 0).alias("buy"), (F.col("l_orderkey") % 10 == 0).alias("snap"), F.expr("cast(l_orderkey div 5000 as int)").alias("generation"))


WIRE = """
WITH r AS (SELECT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS seq, max(l_discount) AS d, max(l_quantity) AS q, l_linenumber % 2 = 0 AS buy, l_orderkey % 10 = 0 AS snap, (l_orderkey // 5000)::INTEGER AS generation
           FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber),
m AS (SELECT *, sum(snap::INT) OVER (PARTITION BY s, generation ORDER BY seq)::BIGINT AS epoch FROM r),
l AS (SELECT s, generation, epoch, seq, 'bid' AS side, 0.3 AS price, q AS size FROM m WHERE snap UNION ALL SELECT s, generation, epoch, seq, 'ask', 0.7, q FROM m WHERE snap
      UNION ALL SELECT s, generation, epoch, seq, CASE WHEN buy THEN 'bid' ELSE 'ask' END, d + CASE WHEN buy THEN 0.2 ELSE 0.5 END, CASE WHEN q < 10 THEN 0 ELSE q END FROM m WHERE NOT snap),
i AS (SELECT *, lead(seq) OVER (PARTITION BY s, generation, epoch, side, price ORDER BY seq) AS upto FROM l),
t AS (SELECT m.s, m.generation, m.epoch, m.seq, max(i.price) FILTER (WHERE i.side = 'bid') AS bid, min(i.price) FILTER (WHERE i.side = 'ask') AS ask
      FROM m LEFT JOIN i ON i.s = m.s AND i.generation = m.generation AND i.epoch = m.epoch AND i.size > 0 AND i.seq <= m.seq AND (i.upto IS NULL OR m.seq < i.upto) GROUP BY ALL)
SELECT s::VARCHAR AS book, generation, epoch, seq, round(bid, 9) AS best_bid, round(ask, 9) AS best_ask, epoch > 0 AND coalesce(ask > bid, true) AS whole FROM t"""


@registered(WIRE)
def wire_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polymarket messages to books: snapshots and absolute changes, epochs by connection."""
    r = _wire(spark, sf_dir)
    snapshot = _json("named_struct('event_type', 'book', 'asset_id', cast(s as string), 'bids', array(named_struct('price', '0.3', 'size', q), named_struct('price', '-1', 'size', q)), 'asks', array(named_struct('price', 0.7D, 'size', cast(q as string))))")
    change = _json(
        "named_struct('event_type', 'price_change', 'price_changes', array(named_struct('asset_id', cast(s as string), 'side', if(buy, 'BUY', 'sell'), 'price', d + if(buy, 0.2D, 0.5D), 'size', if(q < 10, 0, q))))"
    )
    sent = r.select("seq", "generation", F.when(F.col("snap"), snapshot).otherwise(change).alias("message"))
    found = books.states(books.polymarket_levels(sent))
    return found.select("book", "generation", "epoch", "seq", F.round("best_bid", 9).alias("best_bid"), F.round("best_ask", 9).alias("best_ask"), F.col("book_integrity_valid").alias("whole"))


@registered("""
WITH r AS (SELECT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS seq, max(l_quantity) AS q, l_linenumber % 2 = 0 AS no, l_orderkey % 10 = 0 AS snap FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber),
m AS (SELECT *, sum(snap::INT) OVER (PARTITION BY s ORDER BY seq)::BIGINT AS epoch FROM r),
d AS (SELECT s, epoch, seq, true AS yes, 40.0 AS size FROM m WHERE snap UNION ALL SELECT s, epoch, seq, false, 30.0 FROM m WHERE snap UNION ALL SELECT s, epoch, seq, NOT no, CASE WHEN q > 25 THEN -q ELSE q END FROM m WHERE NOT snap),
f AS (SELECT *, sum(size) OVER (PARTITION BY s, epoch, yes ORDER BY seq) AS total FROM d)
SELECT s::VARCHAR AS book, epoch, seq, (CASE WHEN yes THEN 0.4 ELSE 0.45 END)::DOUBLE AS price, greatest(total, 0) AS size FROM f""")
def kalshi_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kalshi messages to levels: snapshots, and signed deltas that add up within an epoch."""
    r = _wire(spark, sf_dir)
    snapshot = _json("named_struct('type', 'orderbook_snapshot', 'msg', named_struct('market_ticker', cast(s as string), 'yes_dollars', array(array('0.40', '40')), 'no_dollars', array(array('0.55', '30'))))")
    delta = _json("named_struct('type', 'orderbook_delta', 'msg', named_struct('market_ticker', cast(s as string), 'side', if(buy, 'no', 'yes'), 'price_dollars', if(buy, '0.55', '0.40'), 'delta', if(q > 25, -q, q)))")
    sent = r.select("seq", F.lit(0).alias("generation"), F.when(F.col("snap"), snapshot).otherwise(delta).alias("message"))
    found = books.kalshi_levels(sent).where("side is not null")
    return found.select("book", "epoch", "seq", F.round("price", 9).alias("price"), "size")


@registered("""
WITH e AS (SELECT user_id, event_id AS i, event_type = 'error' AS s FROM events),
c AS (SELECT *, lag(s) OVER w AS b, row_number() OVER w AS r, max(i) OVER (PARTITION BY user_id) AS final FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
h AS (SELECT *, lead(i) OVER (PARTITION BY user_id ORDER BY i) - 1 AS till FROM c WHERE r = 1 OR s <> b)
SELECT user_id, i, s, CASE WHEN r = 1 THEN 'initial' ELSE 'change' END AS reason FROM h
UNION ALL SELECT user_id, unnest(range(i + 500, coalesce(till, final) + 1, 500)), s, 'restatement' FROM h""")
def state_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("i"), (F.col("event_type") == "error").alias("s"))
    return books.emissions(e, ["user_id"], "i", ["s"], 500)


@registered("""
WITH e AS (SELECT event_id AS i, user_id AS k FROM events WHERE user_id % 3 = 0)
SELECT k, count(DISTINCT i % 4) AS n_prints FROM e GROUP BY k""")
def message_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a message have one digest whatever their keys' order, spacing and connection fields."""
    one = "named_struct('type', 'trade', 'sid', event_id, 'seq', event_id + 1, 'msg', named_struct('market_ticker', cast(user_id as string), 'ts_ms', 5, 'n', event_id % 4))"
    two = "named_struct('msg', named_struct('n', event_id % 4, 'ts_ms', 5, 'market_ticker', cast(user_id as string)), 'type', 'trade', 'sending_ts_ms', event_id)"
    text = F.when(F.col("event_id") % 2 == 0, F.regexp_replace(_json(one), ":", " : ")).otherwise(_json(two))
    rows = merging.message_keys(read(spark, sf_dir, "events").where("user_id % 3 = 0").select(text.alias("message")), "kalshi")
    return rows.groupBy(F.col("scope").cast("long").alias("k")).agg(F.countDistinct("digest").alias("n_prints"))


@registered("""
WITH e AS (SELECT user_id, event_id AS i, event_id % 5 AS c, (event_id * 7) % 11 AS clock FROM events),
t AS (SELECT *, CASE WHEN clock > 0 THEN clock END AS v FROM e),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY c, user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t)
SELECT i AS seq, coalesce(v < p, false) AS reset, sum(coalesce(v < p, false)::INT) OVER (PARTITION BY c, user_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch,
       CASE WHEN clock = 0 THEN 'zero' WHEN v < p THEN 'decreased' ELSE 'clock' END AS placed_by FROM b""")
def clock_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("copy"), F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 11).alias("clock"))
    return merging.snapshot_placement(merging.clock_epochs(e)).select("seq", "reset", "epoch", "placed_by")


@registered("""
WITH e AS (SELECT event_id AS i FROM events)
SELECT i AS block_number, CASE WHEN i % 13 = 0 THEN 'unknown contract' WHEN i % 11 = 0 THEN 'not four topics' WHEN i % 7 = 0 THEN 'another event' WHEN i % 5 = 0 THEN 'side is neither 0 nor 1' WHEN i % 9 = 0 THEN 'address with padding' END AS problem,
       CASE WHEN i % 13 <> 0 AND i % 11 <> 0 AND i % 7 <> 0 AND i % 5 <> 0 AND i % 9 <> 0 THEN (i::HUGEINT * 1000000007 * 1000000007)::VARCHAR END AS maker_amount,
       CASE WHEN i % 13 <> 0 AND i % 11 <> 0 AND i % 7 <> 0 AND i % 5 <> 0 AND i % 9 <> 0 THEN '0x' || lpad(lower(to_hex(i)), 40, '0') END AS maker FROM e""")
def order_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id")
    word = lambda x: F.lpad(F.lower(F.hex(x)), 64, "0")
    big = F.expr("cast(event_id as decimal(38,0)) * cast(1000000007 as decimal(10,0)) * cast(1000000007 as decimal(10,0))").cast("decimal(38,0)")
    span = F.lit(2**48).cast("decimal(20,0)")
    # the rest is taken off first: a quotient keeps six decimals and rounds, so that just below a whole number it would be that number
    high, low = ((big - big % span) / span).cast("long"), (big % span).cast("long")
    amount = F.concat(F.lpad(F.lower(F.hex(high)), 52, "0"), F.lpad(F.lower(F.hex(low)), 12, "0"))
    side = F.when(F.col("event_id") % 5 == 0, 2).otherwise(F.col("event_id") % 2)
    maker = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("1"), F.substring(word(F.col("event_id")), 2, 63))).otherwise(word(F.col("event_id")))
    topics = F.array(F.when(F.col("event_id") % 7 == 0, F.lit("0xbb")).otherwise(F.lit("0xAA")), F.concat(F.lit("0x"), word(F.lit(1))), F.concat(F.lit("0x"), maker), F.concat(F.lit("0x"), word(F.lit(2))))
    logs = e.select(
        F.when(F.col("event_id") % 13 == 0, "0xdef").otherwise("0xABC").alias("address"),
        F.when(F.col("event_id") % 11 == 0, F.slice(topics, 1, 3)).otherwise(topics).alias("topics"),
        F.concat(F.lit("0x"), word(side), word(F.lit(7)), amount, *[word(F.lit(k)) for k in range(4)]).alias("data"),
        F.concat(F.lit("0x"), F.lower(F.hex("event_id"))).alias("blockNumber"),
        F.lit("0x1").alias("logIndex"),
        F.concat(F.lit("0x"), word(F.col("event_id"))).alias("transactionHash"),
    )
    return chain.order_fills(logs, ["0xabc"], "0xaa").select("block_number", "problem", "maker_amount", "maker")


@registered("""
WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT o_custkey AS k, count(*) AS n, min(CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_totalprice END) AS v FROM orders GROUP BY o_custkey)
SELECT CASE WHEN a.k IS NULL THEN 'unexpected' WHEN r.k IS NULL THEN 'omitted' WHEN n > 1 THEN 'duplicate' WHEN v < 0 THEN 'invalid' ELSE 'served' END AS status, count(*) AS n FROM a FULL OUTER JOIN r ON a.k = r.k GROUP BY ALL""")
def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("k"))
    came = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 50 == 0, -1).otherwise(F.col("o_totalprice")).alias("v"))
    return participants.answers(asked, came, "k", "v").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@registered("""
SELECT o_custkey AS k, o_orderstatus AS wallet, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n_open, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS n_closed, o_custkey % 4 = 0 AS complete FROM orders GROUP BY ALL""")
def market_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    p = o.select(F.col("o_custkey").alias("condition_id"), F.col("o_orderstatus").alias("wallet"), F.when(F.col("o_orderkey") % 2 == 0, "OPEN").otherwise("CLOSED").alias("status"), F.lit("yes").alias("outcome"), F.col("o_totalprice").alias("size"))
    c = o.select(F.col("o_custkey").alias("condition_id")).distinct().select("condition_id", F.explode(F.array(F.lit("OPEN"), F.lit("CLOSED"))).alias("feed")).withColumn("exhausted", (F.col("feed") == "OPEN") | (F.col("condition_id") % 4 == 0))
    found = participants.participants(p, c)
    return found.select(F.col("condition_id").alias("k"), "wallet", F.size("open_positions").cast("long").alias("n_open"), F.size("closed_positions").cast("long").alias("n_closed"), "complete")


@registered("""
WITH e AS (SELECT event_id % 40 AS shard, event_id AS i FROM events), s AS (SELECT shard, i, CASE WHEN i % 9 = 0 THEN 'missing' WHEN i % 100 > 60 THEN 'stale_message' WHEN i % 4 = 0 THEN 'invalid' WHEN i % 30 > 20 THEN 'stale_book' ELSE 'live' END AS state FROM e)
SELECT shard, count(*) AS n, count(*) FILTER (WHERE state = 'live') AS n_live, count(*) FILTER (WHERE state = 'stale_message') AS n_stale_message, count(*) FILTER (WHERE state = 'stale_book') AS n_stale_book,
       count(*) FILTER (WHERE state = 'invalid') AS n_invalid, count(*) FILTER (WHERE state = 'missing') AS n_missing, CASE WHEN count(*) FILTER (WHERE state = 'live') > 0 THEN 'degraded' ELSE 'down' END AS connection,
       CASE WHEN count(*) FILTER (WHERE state = 'stale_message') = count(*) THEN 'reconnect' ELSE 'resubscribe' END AS action FROM s GROUP BY shard""")
def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").select((i % 40).alias("shard"), i.cast("string").alias("book"), F.when(i % 9 != 0, 1000 - i % 100).alias("last_message"), (1000 - i % 30).alias("last_valid"), (i % 4 != 0).alias("valid"))
    states = capture.feed_states(rows, F.lit(1000), 60, 20)
    return capture.shard_summary(states).join(capture.recovery_actions(states).select("shard", "action"), "shard")


@registered("""
WITH r AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 3 = 0 THEN 'smoke' ELSE 'operational' END AS intent,
                  CASE c_custkey % 5 WHEN 0 THEN 'stream_error' WHEN 1 THEN 'persistence_error' ELSE 'deadline_reached' END AS terminal, c_custkey % 60 AS seconds, c_custkey % 4 AS reconnects, c_custkey % 7 AS seen, c_custkey % 6 AS missing FROM customer),
x AS (SELECT *, intent = 'operational' AS judged FROM r),
s AS (SELECT *, (CASE WHEN terminal IN ('stream_error', 'persistence_error') THEN 1 ELSE 0 END) + (CASE WHEN judged AND terminal <> 'deadline_reached' THEN 1 ELSE 0 END) + (CASE WHEN judged AND terminal = 'deadline_reached' AND seconds + 0.05 < 30 THEN 1 ELSE 0 END)
             + (CASE WHEN judged AND seconds > 0 AND reconnects * 60.0 / seconds > 2 THEN 1 ELSE 0 END) AS n_execution,
             CASE WHEN terminal = 'persistence_error' THEN 'failed' WHEN judged AND seen = 0 THEN 'failed' WHEN missing > 0 THEN 'partial' ELSE 'complete' END AS capture_status FROM x)
SELECT i, n_execution, capture_status, CASE WHEN n_execution = 0 AND capture_status = 'complete' THEN 'success' WHEN terminal = 'persistence_error' OR (capture_status = 'failed' AND seen = 0) THEN 'failed' ELSE 'partial' END AS status FROM s""")
def capture_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    runs = read(spark, sf_dir, "customer").select(
        c.alias("i"),
        F.when(c % 3 == 0, "smoke").otherwise("operational").alias("intent"),
        F.when(c % 5 == 0, "stream_error").when(c % 5 == 1, "persistence_error").otherwise("deadline_reached").alias("terminal_reason"),
        (c % 60).alias("seconds_actual"),
        F.lit(30).alias("seconds_requested"),
        (c % 4).alias("n_reconnects"),
        (c % 7).alias("n_initial_snapshot"),
        (c % 7).alias("n_eligible_snapshot"),
        (c % 6).alias("n_missing"),
        *[F.lit(v).alias(n) for n, v in {"n_denominator": 7, "n_eligible": 7, "n_eligible_established": 7, "n_unknown": 0, "n_late": 0}.items()],
    )
    return capture.completeness(runs).select("i", F.size("execution_reasons").alias("n_execution"), "capture_status", "status")


@registered("""
WITH f AS (SELECT user_id, event_id AS i, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 19 = 0 THEN 'pause' ELSE 'data' END AS kind FROM events),
w AS (SELECT *, kind = 'data' AND coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY i) <> 'data', true) AS new FROM f),
n AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY i) AS g, lead(kind) OVER (PARTITION BY user_id ORDER BY i) AS nx FROM w)
SELECT user_id, min(i) AS start, max(i) AS "end", count(*) AS n, coalesce(nullif(arg_max(coalesce(nx, 'open'), i), 'data'), 'open') AS ended_by FROM n WHERE kind = 'data' GROUP BY user_id, g""")
def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "error").when(i % 19 == 0, "pause").otherwise("data")
    frames = read(spark, sf_dir, "events").select("user_id", i.alias("at"), i.alias("seq"), F.lit(0).alias("generation"), kind.alias("kind"), F.lit(None).cast("long").alias("venue_seq"))
    return capture.coverage_windows(frames, ["user_id"]).select("user_id", "start", "end", "n", "ended_by")


CACHE = "platform string, market_key string, resolution_state string, confidence string, result_type string, winner string, result string, payouts_json string, settlement_value_dollars string, terminal_label string, error_type string, resolver_version string"


@registered("""
WITH l AS (SELECT doc_id AS i, quality, toxic FROM labels),
r AS (SELECT i, CASE WHEN i % 5 = 0 THEN 'open' WHEN i % 7 = 0 THEN 'inconsistent' ELSE 'final' END AS state, CASE WHEN i % 7 = 0 THEN 'inconsistent' ELSE 'canonical' END AS conf, quality AS w, CASE WHEN i % 7 = 0 AND i % 5 <> 0 THEN 'MarketResolutionCacheConflict' END AS err, i % 11 = 0 AS legacy FROM l WHERE i % 3 <> 0),
f AS (SELECT i, CASE WHEN i % 13 = 0 THEN 'disputed' WHEN i % 6 = 1 THEN 'open' ELSE 'final' END AS state, CASE WHEN i % 17 = 0 THEN 'weak' ELSE 'canonical' END AS conf, CASE WHEN i % 4 = 0 THEN 1 - quality ELSE quality END AS w FROM l WHERE i % 4 <> 1),
j AS (SELECT coalesce(r.i, f.i) AS i, r.state AS rs, f.state AS fs, r.i IS NULL AS nor, f.i IS NULL AS nof, r.state = 'final' AND r.conf = 'canonical' AS rc, f.state = 'final' AND f.conf = 'canonical' AS fc, r.w AS rw, f.w AS fw, r.err IS NOT NULL AND r.state = 'inconsistent' AS held, legacy FROM r FULL OUTER JOIN f ON r.i = f.i)
SELECT i::VARCHAR AS market_key, CASE WHEN nof THEN 'retained' WHEN nor THEN 'added' WHEN rc AND fc AND rw <> fw AND NOT held THEN 'inconsistent' WHEN NOT legacy AND (held OR (NOT fc AND fs <> 'disputed')) THEN 'carried' ELSE 'refreshed' END AS action FROM j""")
def resolution_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained and fresh settlements of every kind: conflicts, weaker ones, disputes, recorded conflicts, an old resolver's rows."""
    rows, i = read(spark, sf_dir, "labels"), F.col("doc_id")

    def side(state: Column, confidence: Column, won: Column, error: Column, version: Column) -> list[Column]:
        made = {"platform": F.lit("p"), "market_key": i.cast("string"), "resolution_state": state, "confidence": confidence, "result_type": F.lit("binary"), "winner": F.when(won == 1, "Yes").otherwise(" no "), "error_type": error, "resolver_version": version}
        return [made.get(c.split()[0], F.lit(None).cast("string")).alias(c.split()[0]) for c in CACHE.split(", ")]

    retained = rows.where("doc_id % 3 != 0").select(
        *side(
            F.when(i % 5 == 0, "open").when(i % 7 == 0, "inconsistent").otherwise("final"),
            F.when(i % 7 == 0, "inconsistent").otherwise("canonical"),
            F.col("quality"),
            F.when((i % 7 == 0) & (i % 5 != 0), resolution.CONFLICT),
            F.when(i % 11 == 0, "v1").otherwise("v2"),
        )
    )
    fresh = rows.where("doc_id % 4 != 1").select(
        *side(F.when(i % 13 == 0, "disputed").when(i % 6 == 1, "open").otherwise("final"), F.when(i % 17 == 0, "weak").otherwise("canonical"), F.when(i % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")), F.lit(None).cast("string"), F.lit("v2"))
    )
    return resolution.merge_cache(retained, fresh, legacy=["v1"]).select("market_key", "action")


@registered("""
WITH e AS (SELECT event_id AS i, user_id FROM events)
SELECT 'trade.v1' AS pack, count(*) AS n_rows, count(*) FILTER (WHERE i % 4 <> 0 AND (i % 4 = 1 OR i % 4 = 2)) AS broken FROM e
UNION ALL SELECT 'signal.v1', count(*), count(*) FILTER (WHERE i % 5 = 0) FROM e
UNION ALL SELECT 'book_tape_event.v1', count(*), count(*) FILTER (WHERE i % 3 = 0 AND i % 6 = 0) FROM e
UNION ALL SELECT 'backtest_report.v1', count(*), count(*) FILTER (WHERE i % 8 = 0) FROM e
UNION ALL SELECT 'match_relation.v1', count(*), count(*) FILTER (WHERE i % 9 = 0) FROM e""")
def validation_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break one invariant of each of five packs."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    made: list[tuple[str, str, dict[str, Column]]] = [
        ("trade.v1", "capture coordinate: incomplete", {"collector_run_id": F.when(i % 4 != 1, F.when(i % 4 == 0, " ").otherwise("r")), "received_at_monotonic_ns": F.when(i % 4 != 0, i), "local_sequence": F.when((i % 4 != 0) & (i % 4 != 2), i), "subsequence": F.when(i % 4 != 0, i)}),
        ("signal.v1", "net_edge: not (gross_edge - coalesce(fee_estimate, 0) - coalesce(slippage_estimate, 0))", {"gross_edge": F.lit(0.5), "fee_estimate": F.lit(0.1), "slippage_estimate": F.lit(None).cast("double"), "net_edge": F.when(i % 5 == 0, 0.5).otherwise(0.4)}),
        ("book_tape_event.v1", "side_counts_json: sides", {"event_kind": F.when(i % 3 == 0, "checkpoint").otherwise("delta"), "venue": F.lit("polymarket"), "side_counts_json": F.when(i % 6 == 0, '{"yes":1,"no":2}').otherwise('{"ask":1,"bid":2}')}),
        ("backtest_report.v1", "fill_rate: not fill_count / attempted_count", {"fill_rate": F.when(i % 8 == 0, 0.4).otherwise(F.when(i % 2 == 0, 0.0).otherwise(0.5)), "fill_count": F.when(i % 2 == 0, 0).otherwise(1), "attempted_count": F.when(i % 2 == 0, 0).otherwise(2)}),
        (
            "match_relation.v1",
            "match_id: not of its instruments",
            {"match_id": F.concat(F.lit("pm:a_b:t|kalshi:k:"), F.when(i % 9 == 0, "no").otherwise("YES")), "polymarket_market_key": F.lit(" a b "), "polymarket_instrument_key": F.lit("t"), "kalshi_market_key": F.lit("k"), "kalshi_instrument_key": F.lit("YES")},
        ),
    ]
    found = None
    for version, name, columns in made:
        spec = specs.with_pack(validation.Spec(version, tuple(validation.Field(c, "string") for c in columns)))
        condition = F.expr(spec.invariants[name][1])
        one = e.select(*[c.alias(n) for n, c in columns.items()]).agg(F.lit(version).alias("pack"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(condition, F.lit(False))).alias("broken"))
        found = one if found is None else found.union(one)
    return found


@registered("""
WITH e AS (SELECT event_id AS i FROM events), p AS (SELECT i, (i % 50) / 100 AS yb, CASE WHEN i % 4 = 0 THEN 0.6 ELSE round(1 - (i % 30) / 100, 4) END AS ya, (i % 30) / 100 AS nb, CASE WHEN i % 5 = 0 THEN 0.9 ELSE round(1 - (i % 50) / 100, 4) END AS na FROM e)
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE abs(ya - (1 - nb)) > 1e-6) AS yes_ask_mismatches, count(*) FILTER (WHERE abs(na - (1 - yb)) > 1e-6) AS no_ask_mismatches, 0 AS crossed_unflagged FROM p""")
def kalshi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    side = lambda name, bid, ask: F.struct(F.lit(name).alias("outcome"), bid.alias("best_bid_dollars"), ask.alias("best_ask_dollars"))
    yb, nb = (i % 50) / 100, (i % 30) / 100
    both = F.array(side("YES", yb, F.when(i % 4 == 0, 0.6).otherwise(F.round(1 - nb, 4))), side("no", nb, F.when(i % 5 == 0, 0.9).otherwise(F.round(1 - yb, 4))))
    rows = read(spark, sf_dir, "events").select(F.lit("Kalshi").alias("exchange"), i.alias("local_sequence"), F.array().cast("array<string>").alias("quality_flags"), F.explode(both).alias("s")).select("exchange", "local_sequence", "quality_flags", "s.*")
    found = specs.kalshi_pairs(rows)
    return found.withColumn("crossed_unflagged", F.col("crossed_unflagged").cast("int"))


@registered("""
WITH l AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS s, count(*) AS n FROM lineitem GROUP BY ALL),
o AS (SELECT o_orderkey AS k, s, CASE WHEN s = 'bid' THEN o_orderkey % 4 ELSE o_orderkey % 5 END AS want FROM orders, (VALUES ('bid'), ('ask')) v(s) WHERE o_orderkey % 3 = 0)
SELECT o.k, o.s AS source_side, want AS expected, coalesce(n, 0) AS actual FROM o LEFT JOIN l ON o.k = l.k AND o.s = l.s WHERE want <> coalesce(n, 0)""")
def checkpoint_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "checkpoint").otherwise("delta").alias("event_kind"), _json("named_struct('bid', o_orderkey % 4, 'ask', o_orderkey % 5)").alias("side_counts_json"))
    lv = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("source_side"))
    return specs.side_count_mismatches(o, lv, ["k"])


@registered("""
WITH e AS (SELECT user_id, event_id AS i, event_id // 3 AS owner FROM events WHERE event_id % 2 = 0)
SELECT user_id, i, owner FROM (SELECT *, lead(owner) OVER (PARTITION BY user_id ORDER BY i) AS nx FROM e) WHERE nx IS DISTINCT FROM owner""")
def last_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("i"), F.expr("event_id div 3").alias("owner"))
    return books.last_of_runs(e, ["user_id"], ["i"], "owner")


@registered("""
SELECT event_type AS code, (user_id % 2)::VARCHAR AS severity, count(*) AS n, array_to_string(list_sort(list(DISTINCT user_id))[1:20], ',') AS examples FROM events GROUP BY ALL""")
def issue_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("code"), (F.col("user_id") % 2).cast("string").alias("severity"), F.col("user_id").alias("example"))
    found = participants.issues(e)
    return found.select("code", "severity", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@registered("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 10")
def top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participants.key_problems(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@registered("""
WITH e AS (SELECT user_id, event_id AS i, floor(value / 50)::BIGINT AS v, event_type AS h FROM events), t AS (SELECT user_id, max(v) AS m FROM e GROUP BY user_id)
SELECT user_id, max(h) AS payload_hash, count(DISTINCT h) > 1 AS tied FROM e JOIN t USING (user_id) WHERE v = m GROUP BY user_id""")
def newest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") / 50).alias("v"), F.col("event_type").alias("h"))
    return participants.conflicts_to_read(e, "user_id", "v", "h")


@registered("""
WITH e AS (SELECT user_id, event_id AS i, value, event_id % 4 AS g FROM events), s AS (SELECT user_id, g, value AS mid, i FROM e WHERE i % 3 = 0), r AS (SELECT user_id, i % 4 AS g, i, value FROM e WHERE i % 3 <> 0),
b AS (SELECT user_id, g, max(struct_pack(i := i, value := value)) AS m FROM r GROUP BY user_id, g)
SELECT s.i, s.g, b.m.value AS r_value FROM s LEFT JOIN LATERAL (SELECT m FROM b WHERE b.user_id = s.user_id AND b.g <= s.g ORDER BY b.g DESC LIMIT 1) b ON true""")
def asof_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many right rows at each place: the one that is last by the tie column."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("i"), "value", (F.col("event_id") % 4).alias("g"))
    left = e.where("i % 3 = 0").select("user_id", "g", F.col("value").alias("mid"), "i")
    found = asof.asof_join(left, e.where("i % 3 != 0").select("user_id", "g", "i", "value"), ["user_id"], "g", "g", tie=["i"])
    return found.select("i", "g", "r_value")


@registered("""
WITH q AS (SELECT event_id AS i, round(value / 500, 4) AS y, CASE WHEN event_id % 3 <> 0 THEN round((event_id % 90) / 100, 4) END AS n, event_id % 2 = 0 AS in_yes, event_id % 4 < 2 AS legacy FROM events)
SELECT i, CASE WHEN in_yes THEN n ELSE round(1 - n, 10) END AS yes_ask, CASE WHEN in_yes THEN round(1 - n, 10) ELSE n END AS no_bid, round(1 - y, 10) AS no_ask,
       CASE WHEN n IS NULL THEN 'missing' WHEN in_yes OR legacy THEN 'direct' ELSE 'complement_derived' END AS yes_ask_source, CASE WHEN n IS NULL THEN 'missing' WHEN NOT in_yes OR legacy THEN 'direct' ELSE 'complement_derived' END AS no_bid_source,
       CASE WHEN legacy THEN 'direct' ELSE 'complement_derived' END AS no_ask_source FROM q""")
def quote_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies, and both ways in which a NO ladder is given."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.round(F.col("value") / 500, 4).alias("y"), F.when(F.col("event_id") % 3 != 0, F.round((F.col("event_id") % 90) / 100, 4)).alias("n"))
    found = None
    for in_yes in (True, False):
        for legacy in (True, False):
            made = prices.quotes(F.col("y"), F.col("n"), F.lit(1.0), F.lit(1.0), no_in_yes_prices=in_yes, legacy=legacy)
            part = e.where((F.col("i") % 2 == (0 if in_yes else 1)) & ((F.col("i") % 4 < 2) == legacy)).select("i", *[made[c].alias(c) for c in ("yes_ask", "no_bid", "no_ask", "yes_ask_source", "no_bid_source", "no_ask_source")])
            found = part if found is None else found.union(part)
    return found


@registered("""
SELECT event_id AS i, CASE event_id % 5 WHEN 0 THEN 'polymarket_updown_5m' WHEN 1 THEN 'polymarket_updown_4h' ELSE 'polymarket_conventional' END AS slug_family,
       CASE WHEN event_id % 7 = 0 THEN 'kalshi_mve' WHEN event_id % 7 = 1 THEN 'kalshi_conventional' WHEN event_id % 3 = 0 THEN 'family_unknown' WHEN event_id % 3 = 1 THEN 'kalshi_mve' ELSE 'kalshi_conventional' END AS family,
       CASE WHEN event_id % 7 < 2 THEN 'partition_provenance' WHEN event_id % 3 = 0 THEN 'ambiguous_legacy_evidence' ELSE 'legacy_ticker_compat' END AS provenance FROM events""")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and tickers of every family, with and without an explicit partition."""
    i = F.col("event_id")
    slug = F.when(i % 5 == 0, F.concat(F.lit("btc-UPDOWN-5m-"), (1700000000 + i).cast("string"))).when(i % 5 == 1, F.concat(F.lit(" eth-up-or-down-4h-"), (1700000000 + i).cast("string"), F.lit(" "))).when(i % 5 == 2, F.lit("updown-1h-1700000000")).otherwise(F.lit("x-updown-5m-17"))
    key = F.when(i % 3 == 0, F.lit(" ")).when(i % 3 == 1, F.lit(" kxmve-1 ")).otherwise(F.lit("KXBTC"))
    partition = F.when(i % 7 == 0, F.lit(" KALSHI_MVE ")).when(i % 7 == 1, F.lit("kalshi_conventional")).otherwise(F.lit("else"))
    family, provenance = texts.market_family(key, partition)
    return read(spark, sf_dir, "events").select(i.alias("i"), texts.recurring_family(slug).alias("slug_family"), family.alias("family"), provenance.alias("provenance"))


@registered("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 3 <> 0)")
def vanished_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return catalog.absent_keys(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1 and k % 3 != 0"), ["k"])


@registered("SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 90 ELSE event_id % 120 END)::DOUBLE AS age_s FROM events WHERE CASE WHEN event_id % 3 = 0 THEN 90 ELSE event_id % 120 END > 60")
def stale_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages by the event's time, or by the receipt where it has none; most books are young enough."""
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_id", F.timestamp_seconds(F.lit(1_700_000_000)).alias("seen"), F.when(i % 3 != 0, F.timestamp_seconds(1_700_000_000 - i % 120)).alias("event"), F.timestamp_seconds(F.lit(1_700_000_000 - 90)).alias("received"))
    return health.stale(e, "seen", "event", "received", 60).select("event_id", "age_s")


@registered("""
SELECT event_id AS i, CASE event_id % 6 WHEN 0 THEN TIMESTAMP '2024-03-01 10:00:00' WHEN 1 THEN TIMESTAMP '2024-03-01 08:30:00.5' WHEN 2 THEN TIMESTAMP '2024-03-01 15:00:00' END AS at,
       CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE 'a' END AS tokens FROM events""")
def times_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of texts with an explicit offset and no others; ids in the ways in which cells hold them."""
    i = F.col("event_id")
    text = F.element_at(F.array(*[F.lit(t) for t in ("2024-03-01T10:00:00Z", "2024-03-01 10:30:00.5+02", "2024-03-01T10:00:00-0500", "2024-03-01T10:00:00", "1709287200", "no")]), (i % 6 + 1).cast("int"))
    cell = F.element_at(F.array(*[F.lit(t) for t in ('["a", "b", "a"]', " ", "x", "('a',)")]), (i % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(i.alias("i"), m.utc_instant(text).cast("timestamp_ntz").alias("at"), F.array_join(m.flattened_tokens(cell), ",").alias("tokens"))
