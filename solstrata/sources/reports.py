"""Reports of findings: text, JSON, SARIF and Markdown.

Reports are for people and tools that read one document. The counts come from an aggregate; findings stream to the
writer in order, partition by partition, so a report is as long as it must be without the driver holding it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.operators.findings import finding_id
from solstrata.operators.rules import RULES, SEVERITIES, severity_rank
from solstrata.operators.statistics import finding_counts

_LEVEL = {"info": "note", "low": "note", "medium": "warning", "high": "error", "critical": "error"}


def _ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "path", "line", "rule_id", "title")


def _rows(findings: DataFrame) -> Iterator:
    return findings.toLocalIterator(prefetchPartitions=True)


def _counts(findings: DataFrame) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for r in finding_counts(findings).collect():  # a row per severity, detector and confidence
        out.setdefault(r.dimension, {})[r.value] = r.findings
    return out


def text_report(findings: DataFrame, out: TextIO, files: int, errors: list[tuple[str, str]] = ()) -> None:
    counts = _counts(findings)
    total = counts.get("total", {}).get("", 0)
    out.write(f"Files: {files}   Findings: {total}\n")
    for path, error in errors:
        out.write(f"! {path}: {error}\n")
    for s in reversed(SEVERITIES):
        if n := counts.get("severity", {}).get(s, 0):
            out.write(f"{s.upper():9} {n:5} {'#' * max(1, 20 * n // total)}\n")
    if len(counts.get("detector", {})) > 1:
        out.write("\nBy detector\n" + "".join(f"  {d:30} {n}\n" for d, n in sorted(counts["detector"].items())))
    last = None
    for r in _rows(_ordered(findings)):
        if r.severity != last:
            out.write(f"\n== {r.severity.upper()} ==\n")
            last = r.severity
        out.write(f"[{r.rule_id}] {r.title}\n  {r.path}:{r.line}\n" + (f"    {r.snippet}\n" if r.snippet else ""))


def json_report(findings: DataFrame, out: TextIO, files: int, errors: list[tuple[str, str]] = ()) -> None:
    counts = _counts(findings)
    summary = {"files": files, "findings": counts.get("total", {}).get("", 0), "by_severity": counts.get("severity", {}), "by_detector": counts.get("detector", {})}
    out.write('{"summary": ' + json.dumps(summary, sort_keys=True) + ', "errors": ' + json.dumps([{"path": p, "error": e} for p, e in errors]) + ', "findings": [')
    rows = _ordered(findings).select(F.to_json(F.struct(finding_id().alias("id"), *findings.columns)).alias("j"))
    for i, r in enumerate(_rows(rows)):
        out.write(("," if i else "") + r.j)
    out.write("]}\n")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(result) JSON of one SARIF result per finding; messages are cut to 500 bytes, lines are at least 1."""
    text = F.when(F.octet_length("title") > 500, F.decode(F.substring(F.encode("title", "UTF-8"), 1, 497), "UTF-8")).otherwise(F.col("title"))
    level = F.create_map(*[x for k, v in _LEVEL.items() for x in (F.lit(k), F.lit(v))])
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.when(F.col("snippet") != "", F.struct(F.col("snippet").alias("text"))).alias("snippet"))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level[F.col("severity")].alias("level"), F.struct(text.alias("text")).alias("message"), F.array(location).alias("locations"),
                      F.struct(finding_id().alias("findingId")).alias("partialFingerprints"))
    return findings.select(F.to_json(result).alias("result"))


def sarif_report(findings: DataFrame, out: TextIO, files: int = 0, errors: list[tuple[str, str]] = ()) -> None:
    used = {r.rule_id for r in findings.select("rule_id").distinct().collect()}  # at most a row per rule
    rules = [{"id": r, "name": n, "defaultConfiguration": {"level": _LEVEL[s]}} for r, n, s, *_ in RULES if r in used]
    rules += [{"id": r} for r in sorted(used - {x[0] for x in RULES})]
    out.write('{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "solstrata", "rules": ' + json.dumps(rules) + '}}, "results": [')
    for i, r in enumerate(_rows(sarif_results(_ordered(findings)))):
        out.write(("," if i else "") + r.result)
    out.write("]}]}\n")


def markdown_report(findings: DataFrame, out: TextIO, files: int, errors: list[tuple[str, str]] = ()) -> None:
    counts = _counts(findings)
    out.write(f"# Findings\n\n{files} files, {counts.get('total', {}).get('', 0)} findings.\n\n| severity | findings |\n| --- | --- |\n")
    out.write("".join(f"| {s} | {counts.get('severity', {}).get(s, 0)} |\n" for s in reversed(SEVERITIES)))
    last = None
    for r in _rows(_ordered(findings)):
        if r.severity != last:
            out.write(f"\n## {r.severity.capitalize()}\n")
            last = r.severity
        out.write(f"\n### {r.rule_id}: {r.title}\n\n`{r.path}:{r.line}`\n" + (f"\n```solidity\n{r.snippet}\n```\n" if r.snippet else ""))
    out.write("\n## Detectors\n\n" + "".join(f"- {d}: {n}\n" for d, n in sorted(counts.get("detector", {}).items())))
    if errors:
        out.write("\n## Errors\n\n" + "".join(f"- {p}: {e}\n" for p, e in errors))


REPORTS: dict[str, Callable] = {"text": text_report, "json": json_report, "sarif": sarif_report, "markdown": markdown_report}


def report(kind: str, findings: DataFrame, out: TextIO, files: int, errors: list[tuple[str, str]] = ()) -> None:
    if kind not in REPORTS:
        raise ValueError(f"unknown report {kind}")
    REPORTS[kind](findings, out, files, errors)


def traces(ops: DataFrame, violations: DataFrame) -> DataFrame:
    """(path, contract, function, summary, steps): evidence of a write after a call: the call, the write, what the write may be."""
    step = lambda kind, line, text, issue: F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), text.alias("detail"), F.lit(issue).alias("is_issue"))
    rows = violations.select("path", "contract", "function", F.array(step("call", F.col("call_line"), F.col("call_text"), False), step("write", F.col("write_line"), F.col("variable"), True)).alias("steps"), "variable", "call_line", "write_line")
    summary = F.concat(F.lit("call on line "), "call_line", F.lit(", then "), "variable", F.lit(" written on line "), "write_line")
    return rows.select("path", "contract", "function", summary.alias("summary"), "steps")
