"""Tables of markets from venue payloads, filters that count what they can't know, contract fingerprints and the catalog's views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import markets as m
from marlstone.functions.texts import market_family, recurring_family, sorted_digest


def _canonical(payload: Column) -> Column:
    return F.to_json(F.try_parse_json(payload))


def polymarket_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per market with an id: 27 columns of its state and contract, and the payload with its hash."""
    raw, p = F.col(payload), m.Fields("_fields")
    market_id = F.coalesce(*[F.nullif(m.field(p, n), F.lit("")) for n in ("id", "market_id")])
    bid, ask = m.first_number(p, m.BIDS), m.first_number(p, m.ASKS)
    made = {
        "market_id": market_id,
        "event_id": m.event_id(p),
        "event_slug": m.event_slug(p),
        "slug": m.field(p, "slug"),
        "question": m.first_text(p, ["question", "title"]),
        "open_time": m.open_time(p),
        "start_time": m.start_time(p),
        "close_time": m.close_time(p),
        "closed": m.truth(m.field(p, "closed")),
        "volume": m.first_number(p, m.VOLUMES),
        "liquidity": m.first_number(p, m.LIQUIDITIES),
        "enable_orderbook": m.enabled_orderbook(p),
        "token_ids": F.array_remove(m.token_ids(p), market_id),
        "yes_bid": bid,
        "yes_ask": ask,
        "mid": m.mid_price(p),
        "spread": ask - bid,
        "last_trade_price": m.first_number(p, m.LASTS),
        "condition_id": m.first_text(p, ["condition_id", "conditionId", "conditionID"]),
        "question_id": m.first_text(p, ["question_id", "questionId", "questionID"]),
        "outcome_labels_json": F.to_json(m.outcome_labels(p)),
        "outcome_prices_json": F.to_json(m.outcome_prices(p)),
        "uma_resolution_status": m.first_text(p, ["uma_resolution_status", "umaResolutionStatus", "resolutionStatus"]),
        "resolved_by": m.first_text(p, ["resolved_by", "resolvedBy"]),
        "resolution_source": m.first_text(p, ["resolution_source", "resolutionSource"]),
        "raw_json": _canonical(raw),
        "raw_json_sha256": sorted_digest(raw),
    }
    return payloads.withColumn("_fields", m.Fields.parsed(raw)).select(*[c.alias(n) for n, c in made.items()]).where("market_id is not null")


def kalshi_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per Kalshi market: 37 columns of its state and contract, and the payload with its hash."""
    raw, p = F.col(payload), m.Fields("_fields")
    ticker, status = m.field(p, "ticker"), m.kalshi_status(m.field(p, "status"))
    both = lambda names: m.first_text(p, [s for n in names.split() for s in dict.fromkeys((n, m.camel(n)))])
    made = {
        "exchange": F.lit("kalshi"),
        "market_key": ticker,
        "instrument_key": F.concat(ticker, F.lit(":YES")),
        "ticker": ticker,
        "event_ticker": m.field(p, "event_ticker"),
        "question": m.kalshi_question(p),
        "title": m.field(p, "title"),
        "subtitle": m.field(p, "subtitle"),
        "category": m.first_text(p, ["category", "series_category", "event_category"]),
        "series_ticker": m.field(p, "series_ticker"),
        "close_time": m.first_text(p, ["close_time", "expiration_time"]),
        "status": status,
        "closed": F.coalesce(status.isin(m.CLOSED), F.lit(False)),
        "fee_type": m.field(p, "fee_type"),
        "fee_multiplier": m.number(m.field(p, "fee_multiplier")),
        **m.kalshi_prices(p),
        "volume": m.number(m.field(p, "volume_fp")),
        "volume_24h": m.number(m.field(p, "volume_24h_fp")),
        "liquidity": m.number(m.field(p, "liquidity_dollars")),
        "open_interest": m.number(m.field(p, "open_interest_fp")),
        "last_price": m.number(m.field(p, "last_price_dollars")),
        "open_time": m.field(p, "open_time"),
        "updated_time": m.field(p, "updated_time"),
        "result": both("result settlement_result"),
        "settlement_value_dollars": both("settlement_value_dollars settlement_value"),
        "settlement_ts": m.first_text(p, ["settlement_ts", "settlementTime", "settlement_time", "settledTime", "settled_time"]),
        "expiration_value": both("expiration_value"),
        "is_provisional": F.coalesce(m.truth(both("is_provisional"), loose=True), status.isin(m.PROVISIONAL), F.lit(False)),
        "rules_primary": m.first_text(p, ["rules_primary", "rulesPrimary", "rules", "market_rules", "marketRules"]),
        "rules_secondary": both("rules_secondary"),
        "raw_json": _canonical(raw),
        "raw_json_sha256": sorted_digest(raw),
    }
    return payloads.withColumn("_fields", m.Fields.parsed(raw)).select(*[c.alias(n) for n, c in made.items()])


def trades(messages: DataFrame, venue: str, payload: str = "message") -> DataFrame:
    """instrument_id, venue_market_id, venue_trade_id, price, quantity, reported_side, venue_time_utc, problem of a venue's public trades.

    A trade that can't be read has a problem and no price: nothing is dropped and nothing guessed."""
    p = F.col(payload)
    if venue == "polymarket":
        rows = messages.where(m.first_text(p, ["event_type", "type"]) == "last_trade_price")
        price, size = m.number(m.field(p, "price")), m.number(m.field(p, "size"))
        instrument, stated = F.nullif(F.trim(m.field(p, "asset_id")), F.lit("")), m.field(p, "size")
        problem = (
            F.when(instrument.isNull(), "no instrument").when(price.isNull() | ~price.between(0, 1), "price is no probability").when(stated.isNotNull() & (size.isNull() | (size <= 0)), "size is not positive")
        )
        made = {"instrument_id": instrument, "venue_market_id": m.field(p, "market"), "venue_trade_id": F.lit(None).cast("string"), "price": price, "quantity": size, "reported_side": m.field(p, "side")}
        at = F.timestamp_millis(m.field(p, "timestamp").try_cast("long"))
    elif venue == "kalshi":
        rows = messages.where(m.first_text(p, ["event_type", "type"]) == "trade")
        inner = F.coalesce(F.get_json_object(p, "$.msg"), p)
        (price, why), (size, small) = m.kalshi_trade_price(inner), m.kalshi_trade_size(inner)
        market, trade = [F.nullif(F.trim(m.field(inner, n)), F.lit("")) for n in ("market_ticker", "trade_id")]
        problem = F.coalesce(why, small, F.when(market.isNull() | trade.isNull(), "no market or trade id"), F.when(price.isNull() | size.isNull(), "no price or count"))
        made = {"instrument_id": F.concat(market, F.lit(":YES")), "venue_market_id": market, "venue_trade_id": trade, "price": price, "quantity": size, "reported_side": m.field(inner, "taker_side")}
        seconds = F.coalesce(m.field(inner, "created_time"), m.field(inner, "ts"))
        at = F.coalesce(m.utc_instant(seconds), F.timestamp_micros((m.number(seconds) * 1_000_000).cast("long")), F.timestamp_millis(m.field(inner, "ts_ms").try_cast("long")))
    else:
        raise ValueError(f"unknown venue {venue}")
    named = [(F.when(problem.isNull(), c) if n in ("price", "quantity") else c).alias(n) for n, c in made.items()]
    return rows.select(*named, at.alias("venue_time_utc"), problem.alias("problem"))


def distinct_trades(rows: DataFrame, order: str) -> DataFrame:
    """One row, the first in order, of each (venue, venue_trade_id); rows without an id are all kept."""
    named = rows.where("venue_trade_id is not null")
    first = named.groupBy("venue", "venue_trade_id").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return first.unionByName(rows.where("venue_trade_id is null"))


def trade_overlap(sources: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that several sources hold: n_sources, and whether they agree in all values (receipt is none of them)."""
    same = F.xxhash64(*values)
    found = sources.groupBy(*key).agg(F.countDistinct("source").alias("n_sources"), F.min(same).alias("a"), F.max(same).alias("b"))
    return found.where("n_sources > 1").select(*key, "n_sources", (F.col("a") == F.col("b")).alias("agree"))


def filtered(rows: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all conditions, one row of how many rows each condition can't judge). An unknown condition doesn't match."""
    every = F.lit(True)
    for c in conditions.values():
        every &= F.coalesce(c, F.lit(False))
    return rows.where(every), rows.agg(*[F.count_if(c.isNull()).alias(name) for name, c in conditions.items()])


def polymarket_filter(
    *, condition_ids: Sequence[str] | None = None, closed: bool | None = None, question_contains: str | None = None, outcome_count: int | None = None, has_instruments: bool | None = None
) -> dict[str, Column]:
    """Conditions over polymarket_rows, for those that are asked."""
    labels = F.size(F.from_json("outcome_labels_json", "array<string>"))
    asked = {
        "condition_ids": None if condition_ids is None else F.col("condition_id").isin(list(condition_ids)),
        "closed": None if closed is None else F.col("closed") == closed,
        "question_contains": None if question_contains is None else F.contains(F.lower("question"), F.lower(F.lit(question_contains))),
        "outcome_count": None if outcome_count is None else F.when(labels > 0, labels == outcome_count),
        "has_instruments": None if has_instruments is None else (F.size("token_ids") > 0) == has_instruments,
    }
    return {k: c for k, c in asked.items() if c is not None}


def kalshi_filter(
    *,
    tickers: Sequence[str] | None = None,
    event_ticker: str | None = None,
    series_ticker: str | None = None,
    status: str | None = None,
    mve: str | None = None,
    question_contains: str | None = None,
) -> dict[str, Column]:
    """Conditions over kalshi_rows. A market that doesn't say its series is counted as unknown and still matches."""
    bundle = F.upper("ticker").startswith("KXMVE")
    asked = {
        "tickers": None if tickers is None else F.col("ticker").isin(list(tickers)),
        "event_ticker": None if event_ticker is None else F.col("event_ticker") == event_ticker,
        "series_ticker": None if series_ticker is None else F.coalesce(F.col("series_ticker") == series_ticker, F.lit(True)),
        "status": None if status is None else m.matches_query_status(F.col("status"), status),
        "mve": None if mve is None else (bundle if mve == "only" else ~bundle),
        "question_contains": None if question_contains is None else F.contains(F.lower("question"), F.lower(F.lit(question_contains))),
    }
    return {k: c for k, c in asked.items() if c is not None}


def select_tokens(rows: DataFrame, *, least_volume: float = 0, least_liquidity: float = 0, most: int | None = None) -> DataFrame:
    """market_id, token_id of open markets with an order book that reach the minima, each token once; the most traded ones if bounded."""
    fit = rows.where(~F.coalesce("closed", F.lit(False)) & F.coalesce("enable_orderbook", F.lit(True)) & (F.coalesce("volume", F.lit(0.0)) >= least_volume) & (F.coalesce("liquidity", F.lit(0.0)) >= least_liquidity))
    tokens = fit.select("market_id", "volume", F.explode("token_ids").alias("token_id")).groupBy("token_id").agg(F.max(F.struct(F.coalesce("volume", F.lit(0.0)).alias("volume"), "market_id")).alias("b"))
    found = tokens.select("b.market_id", "token_id", "b.volume")
    return (found if most is None else found.orderBy(F.desc("volume"), "token_id").limit(most)).drop("volume")


#: Fields of a market's contract beside the ones that the normalisation reads.
TERMS = (
    "question title slug closed outcomes description line groupItemTitle groupItemThreshold negRisk negRiskMarketID negRiskRequestID active archived acceptingOrders umaResolutionStatuses feesEnabled feeType"
    " makerBaseFee takerBaseFee orderMinSize orderPriceMinTickSize enableOrderBook enable_orderbook enable_order_book condition_id conditionId conditionID question_id questionId questionID uma_resolution_status"
    " umaResolutionStatus resolutionStatus resolved_by resolvedBy resolution_source resolutionSource"
).split()


def contract_fields() -> tuple[list[str], list[str]]:
    """(fields of a market, fields of its events) that make its contract: no prices, volumes or liquidity."""
    own = [*TERMS, *m.EVENT_IDS, *m.EVENT_SLUGS, *m.OPEN_TIMES, *m.EVENT_STARTS, *m.START_FALLBACKS, *m.CLOSE_TIMES, *m.TOKEN_LISTS, *m.TOKEN_VALUES]
    nested = [*m.NESTED_EVENT_IDS, "slug", *m.NESTED_STARTS, *m.START_FALLBACKS, *m.OPEN_TIMES, *m.CLOSE_TIMES]
    return list(dict.fromkeys(own)), list(dict.fromkeys(nested))


def contract_fingerprint(payload: Column) -> Column:
    """MD5 of what a payload says of a market's contract, the nested events' part included; trading doesn't change it. Null for null."""
    own, nested = contract_fields()
    values = lambda p, names: F.array(*[m.field(p, n) for n in names])
    events = F.coalesce(F.from_json(m.field(payload, "events"), "array<string>"), F.array().cast("array<string>"))
    whole = F.struct(values(payload, own).alias("market"), values(m.field(payload, "event"), nested).alias("event"), F.transform(events, lambda e: values(e, nested)).alias("events"))
    return F.when(payload.isNotNull(), F.md5(F.to_json(whole)))


def catalog_views(polymarket: DataFrame, kalshi: DataFrame, partition: Column | None = None) -> dict[str, DataFrame]:
    """The catalog's three views by name: each venue's rows with their families, and all markets in the columns that both have."""
    version = F.lit("operational_family.v1").alias("family_classifier_version")
    pm = polymarket.select(
        *polymarket.columns, F.lit("polymarket").alias("native_family"), F.lit("venue_identity").alias("family_provenance"), recurring_family(F.col("slug")).alias("operational_family"), version
    )
    family, provenance = market_family(F.col("market_key"), partition)
    kx = kalshi.select(*kalshi.columns, family.alias("native_family"), provenance.alias("family_provenance"), family.alias("operational_family"), version)
    shared = ["question", "close_time", "closed", "raw_json", "raw_json_sha256", "native_family", "family_provenance", "operational_family", "family_classifier_version"]
    both = pm.select(F.lit("polymarket").alias("venue"), F.col("market_id").cast("string").alias("market_key"), F.lit(None).cast("string").alias("status"), *shared).unionByName(
        kx.select(F.lit("kalshi").alias("venue"), F.col("market_key").cast("string").alias("market_key"), "status", *shared)
    )
    return {"market_catalog_polymarket": pm, "market_catalog_kalshi": kx, "market_catalog": both}


def derived_from_raw(rows: DataFrame, raw: str = "raw_json", sha: str = "raw_json_sha256") -> DataFrame:
    """One row of what forbids deriving a table from its raw payloads: rows without one beside rows with one, and hashes that don't fit."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(raw).isNull()).alias("n_without"), F.count_if(F.sha2(raw, 256) != F.col(sha)).alias("n_bad_hash")
    ).withColumn("mixed", (F.col("n_without") > 0) & (F.col("n_without") < F.col("n_rows")))
