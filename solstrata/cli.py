"""Command line: scan, explain, rules, baseline, bench."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from solstrata.operators import detectors, findings as fin, rules, statistics, structure
from solstrata.session import materialize, ship_package
from solstrata.sources import files as src, reports


def session(workers: int | str = "*") -> SparkSession:
    spark = SparkSession.builder.appName("solstrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    return spark


def scan(spark: SparkSession, root: str, config: src.Config, names: list[str] | None = None, today: str = ""):
    """Findings of a folder after filter, overrides, exclusion and suppression, and the corpus they are from."""
    files = src.read_sources(spark, root, exclude=config.exclude)
    corpus = structure.Corpus(materialize(files, "files"), materialize)
    chosen = [n for n in (names or config.detectors or list(detectors.DETECTORS)) if n not in config.disabled]
    found = fin.with_rules(detectors.scan(corpus, chosen), rules.catalogue(spark))
    found = fin.at_least(found, config.severity)
    if config.overrides:
        rows = [(k, v.get("severity"), v.get("confidence")) for k, v in config.overrides.items()]
        found = fin.apply_overrides(found, spark.createDataFrame(rows, "name string, severity string, confidence string"))
    found = fin.exclude_paths(found, config.exclude)
    found = fin.suppress_inline(found, fin.suppress_intervals(corpus.files))
    ignores = [fin.Ignore(i.get("rule", "*"), i.get("path", "**"), i.get("function"), i.get("expires")) for i in config.ignore]
    found = fin.suppress_configured(found, ignores, today or time.strftime("%Y-%m-%d"))
    return materialize(fin.fingerprints(found, root), "findings"), corpus


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="solstrata")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--format", choices=sorted(reports.REPORTS), default=None)
    s.add_argument("--output")
    s.add_argument("--detectors", default="")
    s.add_argument("--severity", choices=rules.SEVERITIES)
    s.add_argument("--fail-on", choices=rules.SEVERITIES)
    s.add_argument("--exclude", action="append", default=[])
    s.add_argument("--config")
    s.add_argument("--baseline")
    s.add_argument("--inter-contract", action="store_true")
    e = sub.add_parser("explain")
    e.add_argument("detector")
    r = sub.add_parser("rules")
    r.add_argument("action", choices=("list", "show", "export"))
    r.add_argument("rule", nargs="?")
    r.add_argument("--severity", action="append", default=[])
    r.add_argument("--category")
    b = sub.add_parser("baseline")
    b.add_argument("action", choices=("create", "show", "update", "remove"))
    b.add_argument("path")
    b.add_argument("--file", required=True)
    b.add_argument("--fingerprint", action="append", default=[])
    m = sub.add_parser("bench")
    m.add_argument("path")
    m.add_argument("--runs", type=int, default=3)
    m.add_argument("--save")
    m.add_argument("--compare")
    m.add_argument("--threshold", type=float, default=0.1)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "explain":
        known = [r for r in rules.RULES if r[4] == args.detector]
        for rule in known:
            print(f"{rule[0]}  {rule[2]}/{rule[3]}  {rule[1]}")
        return 0 if known else 2
    spark = session()
    if args.command == "scan":
        found_config = args.config or src.find_config(args.path)
        config = src.load_config(open(found_config).read()) if found_config else src.Config()
        config.severity, config.fail_on = args.severity or config.severity, args.fail_on or config.fail_on
        config.exclude += args.exclude
        names = [n for n in args.detectors.split(",") if n]
        found, corpus = scan(spark, args.path, config, names or None)
        if args.inter_contract:
            from solstrata.operators.intercontract import findings as between

            found = materialize(fin.fingerprints(between(corpus), args.path), "findings")
        if args.baseline:
            found = fin.baseline_diff(found, src.read_baseline(spark, args.baseline))[0]
        with open(args.output, "w") if args.output else contextlib.nullcontext(sys.stdout) as out:
            reports.report(args.format or config.output.get("format", "text"), found, out, corpus.files.count())
        errors = corpus.files.where("source is null").select("path")
        return fin.exit_code(found, errors, config.fail_on).first().exit_code
    if args.command == "rules":
        table = rules.catalogue(spark)
        if args.action == "show":
            table = table.where(F.col("rule_id") == (args.rule or "").upper())
        for row in rules.search(table, args.category, args.severity).toLocalIterator():
            print(json.dumps(row.asDict()) if args.action == "export" else f"{row.rule_id:20} {row.severity:9} {row.name}")
        return 0
    if args.command == "baseline":
        if args.action == "create":
            found, _ = scan(spark, args.path, src.Config())
            src.write_baseline(fin.create_baseline(found, F.current_timestamp()), args.file, args.path, "1")
            return 0
        old = materialize(src.read_baseline(spark, args.file), "baseline")
        if args.action == "show":
            for row in old.groupBy("severity").agg(F.count("*").alias("n")).toLocalIterator():
                print(row.severity, row.n)
        elif args.action == "update":
            found, _ = scan(spark, args.path, src.Config())
            src.write_baseline(fin.merge_baseline(old, fin.create_baseline(found, F.current_timestamp())), args.file, args.path, "1")
        else:
            src.write_baseline(fin.remove_from_baseline(old, args.fingerprint), args.file, args.path, "1")
        return 0
    rows = []
    corpus = structure.Corpus(materialize(src.read_sources(spark, args.path), "files"), materialize)
    for run in range(args.runs + 1):
        for name in detectors.DETECTORS:
            began = time.perf_counter()
            detectors.scan(corpus, [name]).write.format("noop").mode("overwrite").save()
            if run:  # the first run warms up
                rows.append((name, time.perf_counter() - began))
    table = statistics.timing(spark.createDataFrame(rows, "detector string, seconds double"))
    for row in table.orderBy(F.desc("mean")).toLocalIterator():
        print(f"{row.detector:30} {row.mean:8.3f} s  +- {row.stddev:.3f}  {row.share:6.1%}")
    if args.save:
        table.write.mode("overwrite").parquet(args.save)
    if args.compare:
        slower = statistics.slowdowns(table, spark.read.parquet(args.compare), threshold=args.threshold).collect()
        for row in slower:
            print(f"slower: {row.detector} {row.change:+.0%}")
        return 1 if slower else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
