"""Specifications of any number of table versions, read from their written form, and the invariants of families of versions.

A written specification is a line `* **`version`** ... pk(a, b)` followed by a line of columns `name:kind`, with `!` behind columns
that are never null. Kinds: s, S, j (text), l (list of texts), b (boolean), d (double), i (long), n (int). Lines of other
shapes say nothing. What a name implies needs no writing: venues, outcomes, sides, probabilities, flags, times, hashes.

An invariant is a condition over columns that a row breaks. `PACKS` has them by family, that is a version's name without its
number; a version gets those whose columns it has, so all are counted in one pass by `validation.problem_counts`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.validation import REGISTRY, Field, Spec

Invariants = dict[str, tuple[tuple[str, ...], str]]

KINDS = {"s": "string", "S": "string", "j": "string", "l": "array<string>", "b": "boolean", "d": "double", "i": "long", "n": "int"}
#: Vocabularies that a column's name implies, flags, sides and events.
VENUES = ("kalshi", "polymarket")
SEVERE = "crossed_book negative_spread seq_gap reconnect no_initial_snapshot".split()
UNRESOLVED = "crossed_book negative_spread seq_gap reconnect no_initial_snapshot malformed_book missing_sequence sid_changed delta_before_snapshot hash_mismatch".split()
RELATIONS = (
    "exact_equivalent inverse_equivalent same_event_different_outcome same_event_different_cutoff same_event_different_settlement_scope"
    " same_event_different_resolution_source same_context_only parlay_or_composite ambiguous_requires_review unrelated".split()
)
POLYMARKET_EVENTS = "new_market market_resolved tick_size_change".split()
KALSHI_EVENTS = "created activated deactivated close_date_updated determined settled metadata_updated".split()
PRICE_NAMES = frozenset("price bid ask mid price_gap yes_bid yes_ask no_bid no_ask best_bid best_ask".split())
TOLERANCE = 1e-6

_HEAD, _KEY, _COLUMN = re.compile(r"^\* \*\*`([a-z0-9_.]+)`\*\*"), re.compile(r"pk\(([^)]*)\)"), re.compile(r"^([a-z0-9_]+):([sSjlbdin])(!?)$")


def is_price(name: str) -> bool:
    """Whether a column's name says that it holds a price between 0 and 1."""
    return name in PRICE_NAMES or name.endswith(("_bid", "_ask", "_mid", "_price")) or any(f"{w}_dollars" in name for w in ("price", "bid", "ask", "mid"))


def read(text: str) -> dict[str, Spec]:
    """The specifications that a text writes, with their packs."""
    found: dict[str, Spec] = {}
    version, key = None, ()
    for line in text.splitlines():
        if head := _HEAD.match(line):
            version, named = head[1], _KEY.search(line)
            key = tuple(c.strip() for c in named[1].split(",")) if named else ()
            continue
        columns = [_COLUMN.match(c) for c in line.split()]
        if version and columns and all(columns):
            fields = tuple(
                Field(m[1], KINDS[m[2]], bool(m[3]) or m[1] in key, VENUES if m[1] in ("venue", "exchange", "platform") and m[3] else (), is_price(m[1]) and m[2] == "d") for m in columns
            )
            found[version] = with_pack(Spec(version, fields, key))
            version = None
    return found


def second_version(spec: Spec) -> Spec:
    """The next version of a spec of books: the same columns and whether the book was whole."""
    family, number = spec.version.rsplit(".v", 1)
    name = "book_integrity_after" if family == "book_tape_control" else "book_integrity_valid"
    return with_pack(replace(spec, version=f"{family}.v{int(number) + 1}", fields=(*spec.fields, Field(name, "boolean", True)), invariants={}))


def with_second_versions(specs: dict[str, Spec]) -> dict[str, Spec]:
    """The specs and the second versions of those that tell of books."""
    families = "topbook depth feed_health book_tape_event book_tape_control capture_instrument_evidence".split()
    return specs | {s.version: s for s in (second_version(specs[f"{f}.v1"]) for f in families if f"{f}.v1" in specs)}


def register(specs: dict[str, Spec]) -> None:
    """Makes versions known to `validation.infer` and the command line."""
    REGISTRY.update(specs)


def present(*names: str) -> Invariants:
    return {f"{c}: blank": ((c,), f"{c} is not null and trim(cast({c} as string)) = ''") for c in names}


def not_negative(*names: str) -> Invariants:
    return {f"{c}: negative": ((c,), f"{c} < 0") for c in names}


def share(*names: str) -> Invariants:
    return {f"{c}: outside 0 and 1": ((c,), f"{c} is not null and not {c} between 0 and 1") for c in names}


def among(name: str, values: Iterable[str], *, fold: bool = True, nulls: bool = True) -> Invariants:
    text = f"trim({name})" if not fold else f"lower(trim({name}))"
    listed = ", ".join(f"'{v}'" for v in values)
    return {f"{name}: vocabulary": ((name,), f"coalesce({text}, '') not in ({listed})" if nulls else f"{text} not in ({listed})")}


def sums(result: str, expression: str, *names: str) -> Invariants:
    return {f"{result}: not {expression}": ((result, *names), f"abs({expression} - {result}) > {TOLERANCE}")}


def utc(*names: str) -> Invariants:
    pattern = r"^\\s*[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([Zz]|[+-]00:?00)\\s*$"
    return {f"{c}: not UTC": ((c,), f"trim({c}) != '' and (not {c} rlike '{pattern}' or try_cast({c} as timestamp) is null)") for c in names}


def sha256(*names: str) -> Invariants:
    return {f"{c}: not SHA-256": ((c,), f"trim({c}) != '' and not trim({c}) rlike '^[0-9a-f]{{64}}$'") for c in names}


def json_shape(name: str, shape: str, *, required: bool = True) -> Invariants:
    """Text that is a JSON array or object."""
    opening = {"array": r"\\[", "object": r"\\{"}[shape]
    bad = f"trim({name}) != '' and (try_parse_json({name}) is null or not {name} rlike '^\\\\s*{opening}')"
    if not required:
        return {f"{name}: not a JSON {shape}": ((name,), f"({bad}) and trim({name}) != 'null'")}
    return {f"{name}: not a JSON {shape}": ((name,), f"coalesce(trim({name}), '') = '' or ({bad})")}


def canonical_json(name: str, shape: str = "array") -> Invariants:
    """A JSON array or object in its one written form: sorted keys, no blanks."""
    return json_shape(name, shape) | {f"{name}: not canonical": ((name,), f"try_parse_json({name}) is not null and to_json(try_parse_json({name})) != {name}")}


def flagged(*names: str) -> Invariants:
    return {f"{c}: flag tokens": ((c,), f"exists({c}, f -> f is null or length(f) not between 2 and 64 or f rlike '[\\\\s;,]')") for c in names}


def ordered(low: str, value: str, high: str) -> Invariants:
    return {f"{low}, {value}, {high}: misordered": ((low, value, high), f"{low} > {value} or {value} > {high}")}


def bands(low: str, high: str) -> Invariants:
    return {f"{low}, {high}: one-sided": ((low, high), f"({low} is null) != ({high} is null)"), f"{low}, {high}: inverted": ((low, high), f"{low} > {high}")}


def ratio(result: str, top: str, bottom: str, *, zero: bool = False, only: str = "") -> Invariants:
    """result = top / bottom within 1e-9, relative or absolute; for a bottom of zero nothing fits, or zero of zero if `zero`."""
    close = f"abs({result} - {top} / {bottom}) <= greatest(1e-9D, 1e-9D * greatest(abs({result}), abs({top} / {bottom})))"
    none = f"not ({top} = 0 and abs({result}) <= 1e-9D)" if zero else "true"
    known = f"{result} is not null and {top} is not null and {bottom} is not null"
    names = (result, top, bottom, *(["strategy_family"] if only else []))
    return {f"{result}: not {top} / {bottom}": (names, f"{only or 'true'} and {known} and if({bottom} = 0, {none}, not ({close}))")}


def together(*parts: Invariants) -> Invariants:
    return reduce(lambda a, b: a | b, parts, {})


def _any(flags: Iterable[str]) -> str:
    return "arrays_overlap(quality_flags, array(" + ", ".join(f"'{f}'" for f in flags) + "))"


_SIDES = "if(venue = 'polymarket', array('ask', 'bid'), array('no', 'yes'))"
_COUNTS = "from_json(side_counts_json, 'map<string,string>')"
_BLANK = lambda c: f"coalesce(trim({c}), '') = ''"
_COMPLEMENTS = together(
    {"yes_ask: not 1 - no_bid": (("yes_ask", "no_bid"), f"abs(yes_ask - (1 - no_bid)) > {TOLERANCE}")},
    {"no_ask: not 1 - yes_bid": (("no_ask", "yes_bid"), f"abs(no_ask - (1 - yes_bid)) > {TOLERANCE}")},
    {"yes_bid, no_bid: crossed": (("yes_bid", "no_bid"), f"yes_bid + no_bid > 1 + {TOLERANCE}")},
)
_PROBABILITIES = "independent_same_probability independent_inverse_probability".split()

#: Family of versions -> its invariants.
PACKS: dict[str, Invariants] = {
    "topbook": together(
        {"spread: not ask - bid": (("best_bid_dollars", "best_ask_dollars", "spread_dollars"), f"abs(spread_dollars - (best_ask_dollars - best_bid_dollars)) > {TOLERANCE}")},
        {"negative spread without a flag": (("best_bid_dollars", "best_ask_dollars", "quality_flags"), f"best_ask_dollars < best_bid_dollars and not coalesce({_any(SEVERE)}, false)")},
        not_negative("bid_size_contracts", "ask_size_contracts"),
        {"valid_state: severe flags": (("valid_state", "quality_flags"), f"valid_state and {_any(SEVERE)}")},
        {"book_integrity_valid: unresolved failures": (("book_integrity_valid", "quality_flags"), f"book_integrity_valid and {_any(UNRESOLVED)}")},
    ),
    "depth": together(
        not_negative("size_contracts", "cumulative_size_contracts", "level_index"),
        {"book_integrity_valid: unresolved failures": (("book_integrity_valid", "quality_flags"), f"book_integrity_valid and {_any(UNRESOLVED)}")},
    ),
    "trade": together(
        not_negative("received_at_monotonic_ns", "local_sequence", "subsequence"),
        utc("trade_ts_utc", "received_at_utc"),
        {
            "capture coordinate: incomplete": (
                ("collector_run_id", "received_at_monotonic_ns", "local_sequence", "subsequence"),
                f"size(array_distinct(array({_BLANK('collector_run_id')}, received_at_monotonic_ns is null, local_sequence is null, subsequence is null))) > 1",
            )
        },
    ),
    "kalshi_market_snapshot": _COMPLEMENTS,
    "book_tape_event": together(
        not_negative("received_at_monotonic_ns", "local_sequence", "subsequence", "expected_level_row_count"),
        utc("received_at_utc", "exchange_at_utc"),
        sha256("event_id", "epoch_id", "post_book_hash", "raw_event_hash", "event_payload_hash"),
        canonical_json("quality_flags_json"),
        {"epoch_id: checkpoint without": (("event_kind", "epoch_id"), f"event_kind = 'checkpoint' and {_BLANK('epoch_id')}")},
        {"epoch_id: reconstructible without": (("reconstructible", "epoch_id"), f"reconstructible and {_BLANK('epoch_id')}")},
        {"checkpoint_reason: checkpoint without": (("event_kind", "checkpoint_reason"), f"event_kind = 'checkpoint' and {_BLANK('checkpoint_reason')}")},
        {"checkpoint_reason: delta with": (("event_kind", "checkpoint_reason"), f"event_kind = 'delta' and not {_BLANK('checkpoint_reason')}")},
        {"side_counts_json: checkpoint without": (("event_kind", "side_counts_json"), f"event_kind = 'checkpoint' and {_BLANK('side_counts_json')}")},
        {"side_counts_json: delta with": (("event_kind", "side_counts_json"), f"event_kind = 'delta' and not {_BLANK('side_counts_json')}")},
        {
            "side_counts_json: sides": (
                ("event_kind", "side_counts_json", "venue"),
                f"event_kind = 'checkpoint' and not {_BLANK('side_counts_json')} and not coalesce(array_sort(map_keys({_COUNTS})) = {_SIDES}, false)",
            )
        },
        {
            "side_counts_json: counts": (
                ("event_kind", "side_counts_json"),
                f"event_kind = 'checkpoint' and exists(map_values({_COUNTS}), n -> coalesce(try_cast(n as double), -1) < 0 or try_cast(n as double) != floor(try_cast(n as double)))",
            )
        },
        {
            "side_counts_json: not the expected level rows": (
                ("event_kind", "side_counts_json", "expected_level_row_count"),
                f"event_kind = 'checkpoint' and aggregate(map_values({_COUNTS}), 0D, (a, n) -> a + try_cast(n as double)) != expected_level_row_count",
            )
        },
        {"book_integrity_valid: not reconstructible": (("book_integrity_valid", "reconstructible"), "coalesce(book_integrity_valid, false) != coalesce(reconstructible, false)")},
    ),
    "book_tape_level": together(
        not_negative("price_dollars", "size_after_contracts", "level_ordinal"),
        sha256("event_id", "epoch_id"),
        {"source_side: not the venue's": (("venue", "source_side"), f"not array_contains({_SIDES}, coalesce(source_side, ''))")},
        {"price_key: not a fixed decimal": (("price_key",), r"not coalesce(price_key, '') rlike '^[01](\\.[0-9]+)?$'")},
        {"price_key: not the price": (("price_key", "price_dollars"), "try_cast(price_key as double) != price_dollars or price_key rlike '[.][0-9]*0$'")},
    ),
    "book_tape_control": together(
        not_negative("received_at_monotonic_ns", "local_sequence", "subsequence"),
        utc("received_at_utc", "exchange_at_utc"),
        sha256("control_id", "epoch_id", "evidence_id"),
        canonical_json("quality_flags_json"),
        {"valid_after: recovered is not open": (("control_type", "valid_after"), "control_type = 'book_recovered' and not coalesce(valid_after, false)")},
        {"evidence: recovered without": (("control_type", "evidence_role", "evidence_id"), f"control_type = 'book_recovered' and ({_BLANK('evidence_role')} or {_BLANK('evidence_id')})")},
        {
            "evidence_role: vocabulary": (
                ("control_type", "evidence_role"),
                f"control_type = 'book_recovered' and not {_BLANK('evidence_role')} and evidence_role not in ('tape_event', 'topbook_main', 'topbook_checkpoint')",
            )
        },
        {"valid_after: not closed": (("control_type", "valid_after"), "control_type in ('book_invalidated', 'stream_ended') and valid_after")},
    ),
    "stream_lifecycle": together(
        not_negative("received_at_monotonic_ns", "local_sequence", "subsequence", "previous_tick_size_dollars", "new_tick_size_dollars"),
        utc("received_at_utc", "exchange_at_utc", "market_close_at_utc"),
        sha256("lifecycle_event_id", "raw_event_hash"),
        canonical_json("quality_flags_json"),
        {
            "event_type: not the venue's": (
                ("venue", "event_type"),
                f"not array_contains(if(venue = 'polymarket', array({', '.join(repr(e) for e in POLYMARKET_EVENTS)}), array({', '.join(repr(e) for e in KALSHI_EVENTS)})), coalesce(event_type, ''))",
            )
        },
    ),
    "contract_evidence": together(
        sha256("evidence_id", "source_row_hash", "raw_payload_hash", "evidence_projection_hash"),
        utc("observed_at_utc", "derived_at_utc", "close_time"),
        {
            "identity_complete: not so": (
                ("identity_complete", "venue", "market_key", "venue_event_key"),
                f"coalesce(identity_complete, false) != (not ({_BLANK('venue')} or {_BLANK('market_key')} or {_BLANK('venue_event_key')}))",
            )
        },
        {"rules_complete: not so": (("rules_complete", "rules_text"), f"coalesce(rules_complete, false) != (not {_BLANK('rules_text')})")},
        {
            "instrument_mapping_complete: not so": (
                ("instrument_mapping_complete", "instrument_mapping_json"),
                "coalesce(instrument_mapping_complete, false) != coalesce(aggregate(array(from_json(instrument_mapping_json, 'array<struct<instrument_key:string,outcome:string>>')), false,"
                " (a, m) -> size(m) > 0 and not exists(m, x -> coalesce(trim(x.instrument_key), '') = '' or coalesce(trim(x.outcome), '') = '')"
                " and size(array_distinct(transform(m, x -> trim(x.instrument_key)))) = size(m) and size(array_distinct(transform(m, x -> lower(trim(x.outcome))))) = size(m)), false)",
            )
        },
        {
            "completeness_reasons_json: not so": (
                ("completeness_reasons_json", "identity_complete", "rules_complete", "instrument_mapping_complete", "venue_event_key"),
                "array_sort(filter(transform(from_json(coalesce(completeness_reasons_json, '[]'), 'array<string>'), r -> trim(r)), r -> r in ('identity_incomplete', 'rules_incomplete',"
                " 'instrument_mapping_incomplete', 'venue_event_identity_incomplete'))) != array_sort(array_compact(array(if(coalesce(identity_complete, false), null, 'identity_incomplete'),"
                " if(coalesce(rules_complete, false), null, 'rules_incomplete'), if(coalesce(instrument_mapping_complete, false), null, 'instrument_mapping_incomplete'),"
                f" if({_BLANK('venue_event_key')}, 'venue_event_identity_incomplete', null))))",
            )
        },
    ),
    "market_resolution": present("platform", "market_key"),
    "co_resolution_observation": together(
        present("observation_run_id", "polymarket_market_key", "kalshi_market_key"),
        among("binary_label_grain", ("instrument", "market_fallback"), fold=False),
        {f"{c}: not instrument grain": ((c, "binary_label_grain"), f"{c} and coalesce(trim(binary_label_grain), '') != 'instrument'") for c in ("included_in_fit", "known_binary_pair")},
        {"included_in_fit: not a known pair": (("included_in_fit", "known_binary_pair"), "included_in_fit and not coalesce(known_binary_pair, false)")},
        *[
            {
                f"{c}: null in a known pair": ((c, "known_binary_pair"), f"known_binary_pair and {c} is null"),
                f"{c}: null but included": ((c, "included_in_fit"), f"included_in_fit and {c} is null"),
                f"{c}: neither 0 nor 1": ((c,), f"{c} not in (0, 1)"),
            }
            for c in ("polymarket_binary_yes", "kalshi_binary_yes")
        ],
        {"exclusion_reason: of an included row": (("included_in_fit", "exclusion_reason"), f"included_in_fit and not {_BLANK('exclusion_reason')}")},
        {"exclusion_reason: lacking": (("included_in_fit", "exclusion_reason"), f"not coalesce(included_in_fit, false) and {_BLANK('exclusion_reason')}")},
        {f"{c}: of no known pair": ((c, "known_binary_pair"), f"not coalesce(known_binary_pair, false) and {c} is not null") for c in ("same_binary_outcome", "inverse_binary_outcome")},
        {f"{c}: null in a known pair": ((c, "known_binary_pair"), f"known_binary_pair and {c} is null") for c in ("same_binary_outcome", "inverse_binary_outcome")},
        {"binary outcomes: not complementary": (("same_binary_outcome", "inverse_binary_outcome", "known_binary_pair"), "known_binary_pair and same_binary_outcome = inverse_binary_outcome")},
        {"same_terminal_outcome: of unknown ends": (("both_terminal_known", "same_terminal_outcome"), "not coalesce(both_terminal_known, false) and same_terminal_outcome is not null")},
        share("polymarket_marginal_probability", "kalshi_marginal_probability", *_PROBABILITIES),
    ),
    "co_resolution_score": together(
        present(
            *"experiment_id manifest_hash model_family model_spec_id feature_set_id label_policy_id scorer_run_id polymarket_market_key polymarket_instrument_key kalshi_market_key kalshi_instrument_key".split()
        ),
        share(*[f"{k}_resolution_{w}" for k in ("co", "inverse") for w in ("probability", "lower", "upper")], *_PROBABILITIES),
        *[ordered(f"{k}_resolution_lower", f"{k}_resolution_probability", f"{k}_resolution_upper") for k in ("co", "inverse")],
        {
            "complement_residual: incoherent without a flag": (
                ("score_semantics", "complement_residual", "data_quality_flags", "risk_flags"),
                f"trim(score_semantics) = 'binary_same_inverse_complement' and abs(complement_residual) > {TOLERANCE} and not (coalesce(cast(data_quality_flags as string) like"
                " '%binary_complement_incoherent%', false) and coalesce(cast(risk_flags as string) like '%binary_complement_incoherent%', false))",
            )
        },
    ),
    "match_relation": together(
        present("match_id", "polymarket_market_key", "polymarket_instrument_key", "polymarket_token_id", "kalshi_market_key", "kalshi_instrument_key", "relation_label"),
        {
            "match_id: not of its instruments": (
                ("match_id", "polymarket_market_key", "polymarket_instrument_key", "kalshi_market_key", "kalshi_instrument_key"),
                "not exists(array(polymarket_market_key, polymarket_instrument_key, kalshi_market_key, kalshi_instrument_key), k -> coalesce(trim(k), '') = '') and coalesce(trim(match_id), '') !="
                " concat('pm:', replace(replace(trim(polymarket_market_key), '|', '%7C'), ' ', '_'), ':', replace(replace(trim(polymarket_instrument_key), '|', '%7C'), ' ', '_'),"
                " '|kalshi:', replace(replace(trim(kalshi_market_key), '|', '%7C'), ' ', '_'), ':', replace(replace(trim(kalshi_instrument_key), '|', '%7C'), ' ', '_'))",
            )
        },
        among("relation_label", RELATIONS),
        share("confidence_score"),
        {"polymarket_token_id: a list": (("polymarket_token_id",), r"polymarket_token_id rlike '^\\s*[\\[(]|,'")},
        {"polymarket_token_id: too long": (("polymarket_token_id",), "polymarket_token_id rlike '^[0-9]{91,}$'")},
        json_shape("evidence_json", "object"),
    ),
    "tracking_match": together(
        present("tracking_pair_id", "match_tier", "relation_type", "polymarket_market_key", "kalshi_market_key", "polymarket_question", "kalshi_question"),
        {
            "tracking_pair_id: not of its markets": (
                ("tracking_pair_id", "polymarket_market_key", "kalshi_market_key"),
                f"not {_BLANK('polymarket_market_key')} and not {_BLANK('kalshi_market_key')} and coalesce(trim(tracking_pair_id), '') != concat('pm:', trim(polymarket_market_key), '|kalshi:', trim(kalshi_market_key))",
            )
        },
        share("confidence_score", "title_similarity"),
    ),
    "tracking_health": together(
        present("match_id", "observed_at_utc", "relation_label", "health_status"),
        not_negative("polymarket_quote_age_ms", "kalshi_quote_age_ms", "max_quote_age_ms"),
        among("health_status", "ready missing invalid stale skipped blocked".split()),
    ),
    "signal": together(
        present("signal_id", "match_id", "strategy_version", "observed_at_utc", "relation_label", "decision"),
        not_negative("fee_estimate", "slippage_estimate", "executable_size", "quote_age_ms"),
        sums("net_edge", "(gross_edge - coalesce(fee_estimate, 0) - coalesce(slippage_estimate, 0))", "gross_edge", "fee_estimate", "slippage_estimate"),
    ),
    "order_intent": together(
        present("order_intent_id", "signal_id", "client_order_id"), not_negative("limit_price", "size_contracts"), among("action", ("buy", "sell")), among("book_side", ("bid", "ask"))
    ),
    "maker_quote_plan": together(
        present("plan_id", "plan_fingerprint", "match_id"),
        not_negative(
            *"quote_size_contracts hedge_size_contracts maker_fee_dollars hedge_taker_fee_dollars slippage_allowance depth_levels_consumed quote_ttl_ms min_quote_size_contracts requote_threshold".split()
        ),
        among("quote_action", ("buy", "sell")),
        among("hedge_action", ("buy", "sell")),
        among("quote_book_side", ("bid", "ask")),
        among("hedge_book_side", ("bid", "ask")),
        sums(
            "net_edge",
            "(gross_edge - try_divide(coalesce(maker_fee_dollars, 0) + coalesce(hedge_taker_fee_dollars, 0), quote_size_contracts) - coalesce(slippage_allowance, 0))",
            "gross_edge",
            "maker_fee_dollars",
            "hedge_taker_fee_dollars",
            "quote_size_contracts",
            "slippage_allowance",
        ),
    ),
    "order_state": together(
        not_negative("filled_size_contracts", "remaining_size_contracts", "average_fill_price", "fees_dollars"),
        among("status", "filled partially_filled cancelled rejected open".split()),
        {"average_fill_price: filled without": (("filled_size_contracts", "average_fill_price"), "filled_size_contracts > 0 and average_fill_price is null")},
    ),
    "paper_fill": together(
        present("paper_fill_id"),
        not_negative("fill_price_dollars", "size_contracts", "notional_dollars", "fees_dollars", "latency_ms"),
        sums("notional_dollars", "(fill_price_dollars * size_contracts)", "fill_price_dollars", "size_contracts"),
        among("action", ("buy", "sell")),
        among("book_side", ("bid", "ask")),
    ),
    "paper_position": together(
        not_negative("filled_size_contracts", "unmatched_leg_size_contracts", "buy_notional_dollars", "sell_notional_dollars", "fees_dollars"),
        sums("gross_pnl_dollars", "(coalesce(sell_notional_dollars, 0) - coalesce(buy_notional_dollars, 0))", "sell_notional_dollars", "buy_notional_dollars"),
        sums("net_pnl_dollars", "(gross_pnl_dollars - coalesce(fees_dollars, 0))", "gross_pnl_dollars", "fees_dollars"),
        sums("net_pnl_dollars", "(coalesce(realized_pnl_dollars, 0) + coalesce(unrealized_pnl_dollars, 0))", "realized_pnl_dollars", "unrealized_pnl_dollars"),
    ),
    "historical_price": together(
        share(*[f"{w}_dollars" for w in "open high low close mean min max previous".split()]), not_negative("interval_seconds", "volume_contracts", "open_interest_contracts")
    ),
    "convergence_observation": together(
        not_negative("horizon_seconds", "elapsed_seconds", "time_to_convergence_seconds"), sums("edge_change", "(evaluation_net_edge - initial_net_edge)", "evaluation_net_edge", "initial_net_edge")
    ),
    "convergence_summary": together(
        not_negative(*[f"{w}_count" for w in "observation decision converged persisted widened gap".split()], "median_time_to_convergence_seconds"), share("convergence_rate", "survivorship_rate")
    ),
    "backtest_report": together(
        {
            f"{c}: missing": ((c,), f"{c} is null")
            for c in (
                "decision_count attempted_count fill_count position_count filled_size_contracts capital_at_risk_dollars max_concurrent_notional_dollars theoretical_edge_dollars fee_drag_dollars fill_rate"
                " markout_window_count fill_model_params_json markout_decay_json source_artifacts_json data_quality_caveats assumption_caveats"
            ).split()
        },
        among("strategy_family", ("taker", "maker"), nulls=False),
        among("source_kind", ("taker_batch", "taker_two_leg", "maker_passive"), nulls=False),
        among("fill_model", ("optimistic", "topbook_cross", "pessimistic_queue"), nulls=False),
        not_negative(
            *"attempted_count capital_at_risk_dollars decision_count fee_drag_dollars fill_count filled_size_contracts markout_window_count max_concurrent_notional_dollars position_count".split()
        ),
        share("fill_rate", "hit_rate"),
        {"fill_count: beyond attempted_count": (("fill_count", "attempted_count"), "fill_count > attempted_count")},
        ratio("fill_rate", "fill_count", "attempted_count", zero=True),
        {"filled_size_contracts: without fills": (("fill_count", "filled_size_contracts"), "fill_count = 0 and filled_size_contracts != 0")},
        {"max_concurrent_notional_dollars: beyond capital": (("capital_at_risk_dollars", "max_concurrent_notional_dollars"), "max_concurrent_notional_dollars > capital_at_risk_dollars")},
        *[
            {f"{r}: missing": ((r, top, "capital_at_risk_dollars"), f"capital_at_risk_dollars > 0 and {top} is not null and {r} is null")} | ratio(r, top, "capital_at_risk_dollars")
            for r, top in (("return_on_capital_lower", "estimated_pnl_lower_dollars"), ("return_on_capital_upper", "estimated_pnl_upper_dollars"), ("fee_drag_ratio", "fee_drag_dollars"))
        ],
        {
            "edge_capture_ratio: missing": (
                ("theoretical_edge_dollars", "estimated_pnl_upper_dollars", "edge_capture_ratio"),
                "theoretical_edge_dollars != 0 and estimated_pnl_upper_dollars is not null and edge_capture_ratio is null",
            )
        },
        ratio("edge_capture_ratio", "estimated_pnl_upper_dollars", "theoretical_edge_dollars", only="lower(trim(strategy_family)) = 'maker'"),
        bands("estimated_pnl_lower_dollars", "estimated_pnl_upper_dollars"),
        bands("markout_pnl_lower_dollars", "markout_pnl_upper_dollars"),
    ),
}
#: Family -> sets of columns whose values, where none is null, stand in one row only.
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "match_relation": (("match_id",),),
    "tracking_match": (("tracking_pair_id",),),
    "signal": (("signal_id",),),
    "order_intent": (("order_intent_id",), ("client_order_id",)),
    "paper_fill": (("paper_fill_id",),),
    "market_resolution": (("platform", "market_key"),),
}


def family(version: str) -> str:
    return re.sub(r"\.v[0-9]+$", "", version)


def with_pack(spec: Spec) -> Spec:
    """The spec with the invariants that its columns allow."""
    names = {f.name for f in spec.fields}
    known = PACKS.get(family(spec.version), {}) | flagged(*sorted(names & {"quality_flags", "data_quality_flags"}))
    return replace(spec, invariants={k: v for k, v in known.items() if set(v[0]) <= names} | spec.invariants)


def shared_keys(rows: DataFrame, version: str) -> dict[str, DataFrame]:
    """For each unique set of columns of a family: the values that several rows share, trimmed, with n."""
    found = {}
    for columns in UNIQUE.get(family(version), ()):
        if set(columns) <= set(rows.columns):
            trimmed = rows.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in columns]).dropna()
            found[", ".join(columns)] = trimmed.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found


def conflicting_payloads(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Values of a key whose rows differ in their payload."""
    same = F.struct(*[F.col(c).cast("string") for c in payload])
    return rows.groupBy(key).agg(F.min(same).alias("a"), F.max(same).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1 and not (a <=> b)").select(key, "n")


def kalshi_pairs(rows: DataFrame) -> DataFrame:
    """One row of counts over the YES and NO rows of one observation of a Kalshi market's top: asks that aren't the other side's complement, and crossed bids without a flag."""
    keys = [c for c in ("collector_run_id", "venue_market_id", "received_at_utc", "local_sequence", "venue_sequence") if c in rows.columns]
    if not keys:
        raise ValueError("nothing says which rows are of one observation")
    severe = F.coalesce(F.arrays_overlap("quality_flags", F.array(*[F.lit(f) for f in SEVERE])), F.lit(False))
    side = lambda s: F.min(F.when(F.upper("outcome") == s, F.struct("best_bid_dollars", "best_ask_dollars", severe.alias("severe"))))
    pairs = rows.where("lower(exchange) = 'kalshi'").groupBy(*keys).agg(side("YES").alias("y"), side("NO").alias("n")).where("y is not null and n is not null")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.expr(f"abs(y.best_ask_dollars - (1 - n.best_bid_dollars)) > {TOLERANCE}")).alias("yes_ask_mismatches"),
        F.count_if(F.expr(f"abs(n.best_ask_dollars - (1 - y.best_bid_dollars)) > {TOLERANCE}")).alias("no_ask_mismatches"),
        F.count_if(F.expr(f"y.best_bid_dollars + n.best_bid_dollars > 1 + {TOLERANCE} and not y.severe and not n.severe")).alias("crossed_unflagged"),
    )


def parent_mismatches(children: DataFrame, parents: DataFrame, keys: list[str], equal: list[str]) -> DataFrame:
    """Children whose parent has other values in `equal`: keys and the columns that differ."""
    p = parents.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in equal])
    differing = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_p_{c}")), F.lit(c)) for c in equal]))
    return children.join(p, keys).withColumn("differing", differing).where("size(differing) > 0").select(*keys, "differing")


def side_count_mismatches(events: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Checkpoints whose level rows aren't as many on each side as they say: keys, side, expected, actual."""
    said = events.where("event_kind = 'checkpoint'").select(*keys, F.explode(F.from_json("side_counts_json", "map<string,long>")).alias("source_side", "expected"))
    counted = levels.groupBy(*keys, "source_side").agg(F.count(F.lit(1)).alias("actual"))
    foreign = counted.join(said.select(*keys, "source_side"), [*keys, "source_side"], "left_anti").join(events.where("event_kind = 'checkpoint'").select(*keys), keys, "left_semi")
    both = said.join(counted, [*keys, "source_side"], "left").select(*keys, "source_side", "expected", F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("expected != actual").unionByName(foreign.select(*keys, "source_side", F.lit(0).cast("long").alias("expected"), "actual"))


#: Of a control -> of its evidence, by what kind the evidence is.
_TAPE_FIELDS = {c: c for c in "venue venue_market_id venue_book_id epoch_id received_at_utc received_at_monotonic_ns exchange_at_utc local_sequence venue_sequence".split()}
_TOP_FIELDS = {c: c for c in "venue_market_id received_at_utc received_at_monotonic_ns local_sequence venue_sequence".split()} | {"venue": "exchange", "venue_book_id": "instrument_id", "exchange_at_utc": "exchange_ts_utc"}


def control_evidence(controls: DataFrame, evidence: dict[str, DataFrame], run: str = "collector_run_id") -> DataFrame:
    """Problems of controls that name evidence: run, control_id, problem. `evidence` has frames by role, with evidence_id each.

    Evidence must be there, agree in its fields (times by their instant) and, for a recovery, be of a valid state; of the tape
    a reconstructible checkpoint just before the control."""
    found: list[DataFrame] = []
    named = controls.where(~F.coalesce(F.trim("evidence_role"), F.lit("")).isin(""))
    for role, frame in evidence.items():
        tape = role == "tape_event"
        fields = _TAPE_FIELDS if tape else _TOP_FIELDS
        own = [c for c in ("subsequence", "event_kind", "reconstructible", "valid_state", "book_integrity_valid") if c in frame.columns]
        parent = frame.select(F.col(run), F.col("evidence_id"), F.struct(*[F.col(c) for c in dict.fromkeys([*fields.values(), *own])]).alias("e"))
        joined = named.where(F.col("evidence_role") == role).join(parent, [run, "evidence_id"], "left")

        def same(a: Column, b: Column, name: str) -> Column:
            return F.coalesce(a.try_cast("timestamp").eqNullSafe(b.try_cast("timestamp")) if name.endswith("_utc") else a.cast("string").eqNullSafe(b.cast("string")), F.lit(False))

        problems = [F.when(F.col("e").isNull(), "unresolved evidence")]
        problems += [F.when(F.col("e").isNotNull() & ~same(F.col(c), F.col(f"e.{of}"), c), f"{c} disagrees") for c, of in fields.items() if c in controls.columns]
        recovered = F.col("e").isNotNull() & (F.col("control_type") == "book_recovered")
        if tape:
            problems.append(F.when(F.col("e").isNotNull() & (F.coalesce("subsequence", F.lit(0)) != F.coalesce("e.subsequence", F.lit(0)) + 1), "subsequence disagrees"))
            problems.append(F.when(recovered & (F.coalesce("e.event_kind", F.lit("")) != "checkpoint"), "recovery evidence is no checkpoint"))
            problems.append(F.when(recovered & ~F.coalesce("e.reconstructible", F.lit(False)), "recovery evidence is not reconstructible"))
        else:
            problems.append(F.when(F.col("e").isNotNull() & F.col("epoch_id").isNotNull(), "epoch_id beside topbook evidence"))
        valid = next((c for c in ("book_integrity_valid", "valid_state") if c in own), None)
        if valid:
            problems.append(F.when(recovered & ~F.coalesce(F.col(f"e.{valid}"), F.lit(False)), "recovery evidence is not valid"))
        found.append(joined.select(run, "control_id", F.explode(F.array_compact(F.array(*problems))).alias("problem")))
    other = named.where(~F.col("evidence_role").isin(list(evidence))).select(run, "control_id", F.lit("unresolved evidence").alias("problem"))
    return reduce(DataFrame.unionByName, found, other)


