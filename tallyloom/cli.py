"""spark-submit entry: parse, validate, export, compare, charts, schema, sources."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import chartdata, editions, panel, quality
from .sources import adapters, registers


def _show(df: DataFrame) -> list:
    """Summaries only: one row, or one for each rule or field."""
    return [r.asDict(recursive=True) for r in df.collect()]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "validate", "export", "compare", "charts", "schema", "sources"):
        p = sub.add_parser(name)
        if name in ("parse", "validate", "export", "compare", "charts"):
            p.add_argument("inputs", nargs="+")
        p.add_argument("--out")
        p.add_argument("--source")
        p.add_argument("--only-schema", action="store_true")
        p.add_argument("--keep-entity", action="store_true")
        p.add_argument("--node-key", action="store_true")
        p.add_argument("--transitions")
        p.add_argument("--min-n", type=int, default=30)
        p.add_argument("--min-coverage", type=float, default=0.8)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    said: object = None
    if args.command == "schema":
        said = _show(panel.schema_table(spark))
    elif args.command == "sources":
        said = _show(adapters.declarations(spark))
    elif args.command == "parse":
        try:
            df, report = adapters.read_sources(spark, args.inputs, args.source)
        except (KeyError, ValueError) as e:
            print(e, file=sys.stderr)
            return 2
        if args.out:
            registers.write_table(df, args.out)
        said = _show(report)
    elif args.command == "validate":
        df = panel.union_panels([registers.read_table(spark, p) for p in args.inputs])
        said = {"panel": _show(panel.validate(df)), "report": _show(panel.validation_report(df)), "summary": _show(panel.summary(df)), "outside": _show(panel.outside_vocabulary(df)), "rules": _show(quality.run_quality(df)), "shift": _show(quality.column_shift(df))}
    elif args.command == "export":
        df = panel.union_panels([registers.read_table(spark, p) for p in args.inputs])
        registers.write_table(panel.only_schema(df, args.keep_entity) if args.only_schema else df, args.out)
    elif args.command == "charts":
        if not args.out:
            parser.error("charts needs --out")
        tables = [registers.read_table(spark, p) for p in args.inputs]
        saved, skipped = chartdata.save_all(tables[0], args.out, args.min_n, args.min_coverage, tables[1] if len(tables) > 1 else None)
        said = {"saved": saved, "skipped": dict(skipped)}
    elif args.command == "compare":
        a, b = (registers.read_table(spark, p) for p in args.inputs)
        key = editions.NODE_KEY if args.node_key else editions.KEY
        said = {"flows": _show(editions.compare(a, b, key)), "audit": _show(editions.linkage_audit(a, b, key)), "recall": _show(editions.linkage_recall(a, b, key))}
        if args.transitions:
            registers.write_table(editions.transitions(a, b, key), args.transitions)
    if said is not None:
        print(json.dumps(said, default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
