"""Table specifications, coercion and validation.

A specification is a versioned list of typed columns with a primary key and named invariants. Validation is one
aggregate pass of conditional counts, and one pre-aggregated count of keys when strict; coercion is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    allowed: tuple[str, ...] = ()
    probability: bool = False


@dataclass(frozen=True)
class Spec:
    version: str
    fields: tuple[Field, ...]
    key: tuple[str, ...] = ()
    #: name -> SQL condition of a row that breaks it; it is skipped where a column that it names is absent
    invariants: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Report:
    version: str
    rows: int
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    problems: dict[str, int]
    strict: bool

    @property
    def ok(self) -> bool:
        return not self.missing and not self.problems and not (self.strict and self.extra)


TOPBOOK = Spec(
    "topbook.v1",
    (
        Field("schema_version", "string", True),
        Field("exchange", "string", True, ("kalshi", "polymarket")),
        Field("instrument_id", "string", True),
        Field("local_sequence", "long", True),
        Field("best_bid_dollars", "double", probability=True),
        Field("best_ask_dollars", "double", probability=True),
        Field("spread_dollars", "double"),
        Field("bid_size_contracts", "double"),
        Field("ask_size_contracts", "double"),
        Field("valid_state", "boolean"),
        Field("quality_flags", "array<string>"),
    ),
    ("exchange", "instrument_id", "local_sequence"),
    {
        "spread is ask minus bid": (("best_bid_dollars", "best_ask_dollars", "spread_dollars"), "abs(spread_dollars - (best_ask_dollars - best_bid_dollars)) > 1e-6"),
        "negative spread is flagged": (("spread_dollars", "quality_flags"), "spread_dollars < 0 and not coalesce(array_contains(quality_flags, 'negative_spread'), false)"),
        "sizes are not negative": (("bid_size_contracts", "ask_size_contracts"), "bid_size_contracts < 0 or ask_size_contracts < 0"),
        "severe flags are not valid": (("valid_state", "quality_flags"), "valid_state and arrays_overlap(quality_flags, array('crossed_book', 'negative_spread', 'seq_gap', 'malformed_book'))"),
        "flag tokens": (("quality_flags",), "exists(quality_flags, f -> f is null or length(f) not between 2 and 64 or f rlike '[ ;,]')"),
    },
)
DEPTH = Spec(
    "depth.v1",
    (
        Field("schema_version", "string", True),
        Field("instrument_id", "string", True),
        Field("local_sequence", "long", True),
        Field("side", "string", True, ("bid", "ask")),
        Field("level_index", "int", True),
        Field("price_dollars", "double", True, probability=True),
        Field("size_contracts", "double", True),
        Field("cumulative_size_contracts", "double"),
    ),
    ("instrument_id", "local_sequence", "side", "level_index"),
    {"depth is not negative": (("size_contracts", "cumulative_size_contracts", "level_index"), "size_contracts < 0 or cumulative_size_contracts < 0 or level_index < 0")},
)
TRADE = Spec(
    "trade.v1",
    (
        Field("schema_version", "string", True),
        Field("exchange", "string", True, ("kalshi", "polymarket")),
        Field("trade_id", "string", True),
        Field("price_dollars", "double", True, probability=True),
        Field("size_contracts", "double", True),
        Field("capture_run", "string"),
        Field("capture_sequence", "long"),
    ),
    ("exchange", "trade_id"),
    {"capture coordinate is whole": (("capture_run", "capture_sequence"), "(capture_run is null) != (capture_sequence is null)"), "size is positive": (("size_contracts",), "size_contracts <= 0")},
)
HISTORICAL_PRICE = Spec(
    "historical_price.v1",
    (
        Field("schema_version", "string", True),
        Field("instrument_id", "string", True),
        Field("ts", "timestamp", True),
        Field("price", "double", True, probability=True),
        Field("price_type", "string", True, ("trade", "mid", "yes_bid", "yes_ask")),
    ),
    ("instrument_id", "ts", "price_type"),
)
RESOLUTION = Spec(
    "market_resolution.v1",
    (
        Field("schema_version", "string", True),
        Field("platform", "string", True, ("kalshi", "polymarket")),
        Field("market_key", "string", True),
        Field("resolution_state", "string"),
        Field("confidence", "string"),
        Field("result_type", "string"),
        Field("terminal_label", "string"),
        Field("updated_time", "timestamp"),
    ),
    ("platform", "market_key"),
)
REGISTRY = {spec.version: spec for spec in (TOPBOOK, DEPTH, TRADE, HISTORICAL_PRICE, RESOLUTION)}


def checks(rows: DataFrame, spec: Spec) -> dict[str, Column]:
    """Name -> condition of a row that fails: nulls, types, vocabularies, versions, probabilities and invariants."""
    kinds = dict(rows.dtypes)
    found: dict[str, Column] = {}
    for f in spec.fields:
        if f.name not in kinds:
            continue
        column = F.col(f.name)
        if f.required:
            found[f"{f.name}: null"] = column.isNull()
        if kinds[f.name] != f.kind and not {kinds[f.name], f.kind} <= {"int", "bigint", "long"}:
            found[f"{f.name}: not {f.kind}"] = column.isNotNull() & column.cast("string").try_cast(f.kind).isNull() if not f.kind.startswith("array") else column.isNotNull()
        if f.allowed:
            found[f"{f.name}: value"] = ~column.isin(list(f.allowed))
        if f.probability:
            found[f"{f.name}: outside 0 and 1"] = ~column.between(0, 1)
        if f.name == "schema_version":
            found["schema_version: value"] = column != spec.version
    for name, (columns, condition) in spec.invariants.items():
        if set(columns) <= kinds.keys():
            found[name] = F.expr(condition)
    return found


def problem_counts(rows: DataFrame, spec: Spec) -> DataFrame:
    """One row: n_rows and, for each check, how many rows fail it, as c0, c1 ... in the order of checks()."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, c in enumerate(checks(rows, spec).values())])


def validate(rows: DataFrame, spec: Spec, strict: bool = False) -> Report:
    names = [f.name for f in spec.fields]
    counts = problem_counts(rows, spec).first()
    problems = {name: counts[f"c{k}"] for k, name in enumerate(checks(rows, spec)) if counts[f"c{k}"]}
    if strict and spec.key and set(spec.key) <= set(rows.columns):
        shared = rows.groupBy(*spec.key).count().where("count > 1").count()
        if shared:
            problems[f"primary key ({', '.join(spec.key)}): duplicate values"] = shared
    return Report(spec.version, counts["n_rows"], tuple(n for n in names if n not in rows.columns), tuple(sorted(set(rows.columns) - set(names))), problems, strict)


def coerce(rows: DataFrame, spec: Spec) -> DataFrame:
    """The specification's columns in order, each cast; nullable ones that lack are null, required ones an error, others dropped."""
    lacking = [f.name for f in spec.fields if f.required and f.name != "schema_version" and f.name not in rows.columns]
    if lacking:
        raise ValueError(f"{spec.version} lacks {', '.join(lacking)}")
    return rows.select(
        *[
            F.lit(spec.version).alias(f.name) if f.name == "schema_version" else (F.col(f.name).try_cast(f.kind) if f.name in rows.columns else F.lit(None).cast(f.kind)).alias(f.name)
            for f in spec.fields
        ]
    )


def convert(rows: DataFrame, spec: Spec) -> DataFrame:
    """Coercion that loses nothing: extra columns, problems before and problems after are errors."""
    before = validate(rows, spec, strict=True)
    if not before.ok:
        raise ValueError(f"{spec.version}: {before.missing or before.extra or before.problems}")
    made = coerce(rows, spec)
    after = validate(made, spec, strict=True)
    if not after.ok:
        raise ValueError(f"{spec.version}: {after.problems}")
    return made


def infer(rows: DataFrame) -> Spec:
    """The one specification whose columns the frame has."""
    fits = [s for s in REGISTRY.values() if {f.name for f in s.fields} <= set(rows.columns)]
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} specifications fit")
    return fits[0]


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def count_mismatches(parents: DataFrame, children: DataFrame, keys: list[str], expected: str) -> DataFrame:
    """Parents whose number of children isn't the expected one: keys, expected, actual."""
    counts = children.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    joined = parents.select(*keys, F.col(expected).alias("expected")).join(counts, keys, "left")
    return joined.select(*keys, "expected", F.coalesce("actual", F.lit(0)).alias("actual")).where("not (expected <=> actual)")


def flag_histogram(rows: DataFrame, flags: Column) -> DataFrame:
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
