"""Market catalog: union by name, promotion of new keys, compaction, known keys, discovery and pinned SQL snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.latest import conflicts_at_latest, latest_per_key
from marlstone.sources.views import check_name


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def promote(parent: DataFrame, delta: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The parent's rows and the latest delta row of each key that the parent lacks."""
    fresh = delta.join(parent.select(*keys).distinct(), list(keys), "left_anti")
    return parent.unionByName(latest_per_key(fresh, keys, [F.col(at).desc_nulls_last(), F.col(tie).desc()]), allowMissingColumns=True)


def absent_keys(previous: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    return previous.select(*keys).distinct().join(fresh.select(*keys), list(keys), "left_anti")


def compact(layers: Sequence[DataFrame], keys: Sequence[str], at: str, payload: str) -> DataFrame:
    """The latest row of each key over all layers; differing payloads at a key's latest time are an error."""
    rows = union_by_name(layers)
    if not conflicts_at_latest(rows, keys, at, payload).isEmpty():
        raise ValueError("layers conflict at a key's latest time")
    return latest_per_key(rows, keys, [F.col(at).desc_nulls_last(), F.col(payload).desc()])


def needs_compaction(layers: int, rows: int, delta_rows: int, files: int, delta_files: int) -> bool:
    return layers >= 4 or 10 * delta_rows > rows or 4 * delta_files > files


def classify_discovery(observed: DataFrame, known: DataFrame, keys: Sequence[str], at: str, fingerprint: str) -> DataFrame:
    """Observed rows with `kind`: invalid (a null key), new, upsert (newer, other contract), payload_only (newer, same contract) or unchanged."""
    k = known.select(*keys, F.col(at).alias("_known_at"), F.col(fingerprint).alias("_known_print"), F.lit(True).alias("_known"))
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    kind = (
        F.when(null_key, "invalid")
        .when(F.col("_known").isNull(), "new")
        .when(F.col(at) <= F.col("_known_at"), "unchanged")
        .when(F.col(fingerprint).eqNullSafe(F.col("_known_print")), "payload_only")
        .otherwise("upsert")
    )
    return observed.join(k, list(keys), "left").withColumn("kind", kind).drop("_known_at", "_known_print", "_known")


def upsert_known(known: DataFrame, observed: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Known keys with the newest of their rows."""
    return latest_per_key(known.unionByName(observed.select(*known.columns)), keys, [F.col(at).desc_nulls_last()])


#: Root plans of statements that only read.
READS = frozenset(["Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "UnresolvedWith", "SubqueryAlias", "UnresolvedRelation", "LocalRelation", "Join", "UnresolvedHaving", "WithCTE", "Except", "Intersect", "UnresolvedInlineTable", "OneRowRelation"])
#: Nodes that read something else than a named relation.
FOREIGN = frozenset(["UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedTableValuedFunctionWithArgs", "ScriptTransformation", "RelationTimeTravel", "UnresolvedCatalogRelation", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"])
#: Functions that call into the virtual machine, or tell of files and the session.
REFUSED = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length current_catalog current_database current_schema current_user session_user user version".split())


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _walk(gateway, node, names: set[str], functions: list[tuple[str, ...]], relations: list[tuple[str, ...]]) -> None:
    """Names of the functions, relations and common table expressions of a parsed plan, or of an expression in it."""
    kind = node.getClass().getSimpleName()
    if kind in FOREIGN:
        raise ValueError("only named views are read")
    if kind == "UnresolvedRelation":
        relations.append(tuple(_items(node.multipartIdentifier())))
    elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        found = node.nameParts() if kind == "UnresolvedFunction" else None
        functions.append(tuple(x.lower() for x in _items(found)) if found is not None else (node.name().funcName().lower(),))
    elif kind == "UnresolvedWith":
        for pair in _items(node.cteRelations()):
            names.add(pair._1().lower())
            _walk(gateway, pair._2(), names, functions, relations)
    children = _items(node.children())
    if is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.plans.QueryPlan"):
        children += _items(node.expressions())
    if is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        children.append(node.plan())
    for child in children:
        _walk(gateway, child, names, functions, relations)


class Snapshot:
    """A private session with pinned views that answers single SELECTs within bounds; beyond a bound it fails, never cuts.

    A statement may read the views and its own common table expressions, by name, and use functions that Spark itself has but for
    `REFUSED`. Paths, table functions, other catalogs and calls into the virtual machine are errors before anything runs.
    """

    def __init__(self, spark: SparkSession, views: dict[str, str], max_rows: int = 1_000_000, max_bytes: int = 268_435_456):
        self.spark, self.max_rows, self.max_bytes = spark.newSession(), max_rows, max_bytes
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        for name, path in views.items():
            if not isinstance(path, str):
                raise ValueError("views are paths of Parquet data")
            self.spark.read.option("mergeSchema", "true").parquet(path).createOrReplaceTempView(check_name(name))
        self.views = {name.lower() for name in views}
        self.functions = {r.function.lower() for r in self.spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - REFUSED

    def check(self, sql: str) -> None:
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        if plan.getClass().getSimpleName() not in READS:
            raise ValueError("only a single SELECT is answered")
        names: set[str] = set()
        functions: list[tuple[str, ...]] = []
        relations: list[tuple[str, ...]] = []
        _walk(self.spark._sc._gateway, plan, names, functions, relations)
        for name in relations:
            if len(name) != 1 or name[0].lower() not in self.views | names:
                raise ValueError(f"no view {'.'.join(name)}")
        for name in functions:
            if len(name) != 1 or name[0] not in self.functions:
                raise ValueError(f"no function {'.'.join(name)} here")

    def frame(self, sql: str, args: Sequence | None = None) -> DataFrame:
        self.check(sql)
        return self.spark.sql(sql, args=list(args)) if args else self.spark.sql(sql)

    def query(self, sql: str, args: Sequence | None = None):
        """An Arrow table."""
        found = self.frame(sql, args).limit(self.max_rows + 1).toArrow()
        if found.num_rows > self.max_rows or found.nbytes > self.max_bytes:
            raise ValueError("the result is beyond the bounds")
        return found

    def close(self) -> None:
        for name in self.views:
            self.spark.catalog.dropTempView(name)
