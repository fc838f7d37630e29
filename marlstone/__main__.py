"""Command line: ad-hoc SQL over Parquet, table versions, validation and statistics of datasets, features, book reconstruction."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marlstone.operators import bars
from marlstone.plans import manifests, specs, tape, validation
from marlstone.sources import sinks, views


def _datasets(given: list[str]) -> dict[str, str]:
    pairs = [d.partition("=") for d in given]
    if any(not name or not path for name, _, path in pairs):
        raise SystemExit("datasets are given as name=path")
    return {name: path for name, _, path in pairs}


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    views.query(spark, args.sql, _datasets(args.dataset), args.limit).show(args.limit or 1_000_000, truncate=False)
    return 0


def schema(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.version is None:
        print("\n".join(sorted(validation.REGISTRY)))
        return 0
    spec = validation.REGISTRY[args.version]
    print(json.dumps({"version": spec.version, "key": spec.key, "columns": {f.name: f.kind + "!" * f.required for f in spec.fields}, "invariants": sorted(spec.invariants)}, indent=1))
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = views.read_table(spark, args.path)
    spec = validation.REGISTRY[args.version] if args.version else validation.infer(rows)
    report = validation.validate(rows, spec, args.strict)
    print(json.dumps({"version": report.version, "rows": report.rows, "ok": report.ok, "missing": report.missing, "extra": report.extra, "problems": report.problems}, indent=1))
    return 0 if report.ok else 1


def stats(spark: SparkSession, args: argparse.Namespace) -> int:
    print(json.dumps(manifests.dataset_stats(views.read_table(spark, args.path)), indent=1))
    return 0


def validate_manifest(spark: SparkSession, args: argparse.Namespace) -> int:
    said = manifests.read_json(spark, args.path)
    if said is None:
        raise SystemExit(f"no manifest {args.path}")
    found = manifests.problems(spark, said, content=not args.metadata)
    print("\n".join(found) or "ok")
    return 1 if found else 0


def features(spark: SparkSession, args: argparse.Namespace) -> int:
    made = bars.bar_features(views.read_table(spark, args.path), args.bar, args.window)
    sinks.write_atomic(bars.with_metadata(made, views.read_table(spark, args.markets)) if args.markets else made, args.out, overwrite=args.overwrite)
    return 0


def reconstruct(spark: SparkSession, args: argparse.Namespace) -> int:
    """Folds a tape, compares it with the recorded tops and publishes it only if they agree."""
    rebuilt = tape.tops(views.read_table(spark, args.levels), ["book"])
    source = views.read_table(spark, args.tops)
    report = tape.parity(source, rebuilt, ["book"], ["best_bid", "best_ask"]).first().asDict()
    print(json.dumps(report))
    if report["n_mismatch"] or report["n_missing"]:
        return 1
    sinks.write_atomic(rebuilt, args.out)
    manifests.write_json(spark, f"{args.out.rstrip('/')}.report.json", report)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    top.add_argument("--schemas", help="a text that writes further table versions")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        one = commands.add_parser(name)
        one.set_defaults(run=run)
        for names, options in arguments:
            one.add_argument(*names, **options)

    flag = {"action": "store_true"}
    command("query", query, (["sql"], {}), (["-d", "--dataset"], {"action": "append", "default": []}), (["--limit"], {"type": int, "default": 100}))
    command("schema", schema, (["version"], {"nargs": "?"}))
    command("validate", validate, (["path"], {}), (["--version"], {}), (["--strict"], flag))
    command("stats", stats, (["path"], {}))
    command("validate-manifest", validate_manifest, (["path"], {}), (["--metadata"], flag))
    command("compute-features", features, (["path"], {}), (["out"], {}), (["--bar"], {"type": int, "default": 60}), (["--window"], {"type": int, "default": 600}), (["--markets"], {}), (["--overwrite"], flag))
    command("reconstruct", reconstruct, (["levels"], {}), (["tops"], {}), (["out"], {}))
    return top


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(given)
    spark = spark or SparkSession.builder.appName("marlstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.schemas:
        text = "\n".join(r.value for r in spark.read.text(args.schemas).select(F.col("value")).collect())
        specs.register(specs.with_second_versions(specs.read(text)))
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
