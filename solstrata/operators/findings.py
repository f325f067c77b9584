"""What happens to findings after detection: rules, filters, overrides, exclusion, suppression, fingerprints, baselines, cache.

The order of a scan: severity filter, then overrides (so an override never brings back what was filtered, nor removes what it
lowers), then excluded paths, then suppressions, then the baseline.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstrata.functions.globs import glob_regex, matches_any
from solstrata.operators.rules import severity_rank

NUL = "\u0000"


def with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Fill missing rule ids with the first rule of the detector, and missing severities and confidences with the rule's."""
    first = rules.groupBy("detector").agg(F.min("rule_id").alias("default_rule"))
    out = findings.join(F.broadcast(first), "detector", "left").withColumn("rule_id", F.coalesce(F.nullif("rule_id", F.lit("")), "default_rule")).drop("default_rule")
    known = rules.select("rule_id", F.col("severity").alias("rule_severity"), F.col("confidence").alias("rule_confidence"))
    out = out.join(F.broadcast(known), "rule_id", "left")
    return out.withColumn("severity", F.coalesce("severity", "rule_severity")).withColumn("confidence", F.coalesce("confidence", "rule_confidence")).drop("rule_severity", "rule_confidence").select(*findings.columns)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))


def apply_overrides(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides (name, severity, confidence): by rule id, else by detector. Nulls leave a value as it is."""
    o = overrides.groupBy("name").agg(F.max("severity").alias("s"), F.max("confidence").alias("c"))
    by_rule = o.select(F.col("name").alias("rule_id"), F.col("s").alias("s1"), F.col("c").alias("c1"))
    by_detector = o.select(F.col("name").alias("detector"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    out = findings.join(by_rule, "rule_id", "left").join(by_detector, "detector", "left")
    named = F.col("s1").isNotNull() | F.col("c1").isNotNull()
    severity = F.when(named, F.coalesce("s1", "severity")).otherwise(F.coalesce("s2", "severity"))
    confidence = F.when(named, F.coalesce("c1", "confidence")).otherwise(F.coalesce("c2", "confidence"))
    return out.withColumn("severity", severity).withColumn("confidence", confidence).select(*findings.columns)


def exclude_paths(findings: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Drop findings in excluded paths; paths that begin with < are no files and stay."""
    return findings.where(F.col("path").startswith("<") | ~matches_any(F.col("path"), patterns))


def suppress_intervals(files: DataFrame, directive: str = "audit") -> DataFrame:
    """(path, rule_id, start, end): lines for which a comment switches a rule off; rule_id '*' is any rule.

    `<directive>-disable-next-line A, B` covers the next line, `<directive>-disable A` all lines until `<directive>-enable A` or the
    end of the file. Without rules, and with `all`, any rule is meant.
    """
    lines = files.where(F.contains("source", F.lit(directive + "-"))).select("path", F.posexplode(F.split("source", "\n", -1)).alias("k", "line"))
    head = rf"(?://|#|/\*)\s*{directive}-(disable-next-line|disable|enable)\b\s*(.*?)\s*(?:\*/)?\s*$"
    said = lines.select("path", (F.col("k") + 1).alias("at"), F.regexp_extract("line", head, 1).alias("what"), F.regexp_extract("line", head, 2).alias("ids")).where("what <> ''")
    ids = F.filter(F.split(F.regexp_replace("ids", r"[^A-Za-z0-9_,\s-]", ""), r"[,\s]+"), lambda x: x != "")
    rule = F.explode(F.when(F.size(ids) == 0, F.array(F.lit("*"))).otherwise(F.transform(ids, lambda x: F.when(F.lower(x) == "all", "*").otherwise(F.upper(x)))))
    said = said.select("path", "at", "what", rule.alias("rule_id"))
    following = said.where("what = 'disable-next-line'").select("path", "rule_id", (F.col("at") + 1).alias("start"), (F.col("at") + 1).alias("end"))
    w = Window.partitionBy("path", "rule_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    blocks = said.where("what <> 'disable-next-line'").withColumn("end", F.min(F.when(F.col("what") == "enable", F.col("at"))).over(w))
    blocks = blocks.where("what = 'disable'").select("path", "rule_id", F.col("at").alias("start"), F.coalesce("end", F.lit(2147483647)).alias("end"))
    return following.unionByName(blocks)


def suppress_inline(findings: DataFrame, intervals: DataFrame) -> DataFrame:
    """Interval anti join with the lines on which a rule is off."""
    i = intervals.select(F.col("path").alias("ip"), F.col("rule_id").alias("ir"), "start", "end")
    cond = (findings["path"] == i["ip"]) & findings["line"].between(i["start"], i["end"]) & ((i["ir"] == "*") | (i["ir"] == findings["rule_id"]))
    return findings.join(i, cond, "left_anti")


@dataclass(frozen=True)
class Ignore:
    """An entry of the configuration: a rule id or *, a glob, an optional function, and an optional last day (YYYY-MM-DD)."""

    rule: str = "*"
    path: str = "**"
    function: str | None = None
    expires: str | None = None


def suppress_configured(findings: DataFrame, ignores: Sequence[Ignore], today: str) -> DataFrame:
    """Theta anti join with the configured ignores, compiled to one predicate; expired and unreadable dates don't apply."""
    hidden = F.lit(False)
    for i in ignores:
        live = F.lit(True) if i.expires is None else F.coalesce(F.try_to_date(F.lit(i.expires)) >= F.to_date(F.lit(today)), F.lit(False))
        rule = F.lit(True) if i.rule == "*" else F.col("rule_id") == i.rule
        function = F.lit(True) if not i.function else (F.col("function") == i.function) | (F.coalesce("function", F.lit("")) == "")
        hidden = hidden | (live & rule & F.col("path").rlike(glob_regex(i.path)) & function)
    return findings.where(~F.coalesce(hidden, F.lit(False)))


def relative_path(path: Column, root: str = "") -> Column:
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        cut = root.rstrip("/") + "/"
        out = F.when(F.startswith(out, F.lit(cut)), F.substring(out, F.lit(len(cut) + 1), F.length(out))).otherwise(out)
    return F.lower(F.regexp_replace(out, r"^(\./)+", ""))


def fingerprints(findings: DataFrame, root: str = "") -> DataFrame:
    """findings with fingerprint_id: rule id and 12 hex digits of sha256 over rule, path, contract, function and snippet.

    Line numbers don't count, so a finding keeps its fingerprint when the file moves on around it. Nulls count as empty.
    """
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(e(c), r"[\t\n\f\r ]+", " ")))
    rule = F.when(e("rule_id") != "", e("rule_id")).when(e("detector") != "", e("detector")).otherwise("unknown")
    snippet = F.when(squeeze("snippet") != "", squeeze("snippet")).otherwise(squeeze("title"))
    digest = F.sha2(F.concat_ws(NUL, rule, relative_path(e("path"), root), F.lower(F.trim(e("contract"))), F.lower(F.trim(e("function"))), snippet), 256)
    return findings.withColumn("fingerprint_id", F.concat(rule, F.lit("-"), F.substring(digest, 1, 12)))


def finding_id(rule: str = "rule_id", path: str = "path", line: str = "line", title: str = "title") -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (rule, path, line, title)]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12)


BASELINE_COLUMNS = ("fingerprint_id", "rule_id", "severity", "file_path", "title", "suppressed_at", "note")


def create_baseline(findings: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per fingerprint (the greatest title of several, for a stable result)."""
    f = findings.where("fingerprint_id is not null")
    out = f.groupBy("fingerprint_id").agg(F.max(F.struct("title", "rule_id", "severity", "path")).alias("m"))
    return out.select("fingerprint_id", "m.rule_id", "m.severity", F.col("m.path").alias("file_path"), "m.title", (F.lit(None).cast("timestamp") if at is None else at).alias("suppressed_at"), F.lit(None).cast("string").alias("note"))


def merge_baseline(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: new rows replace those with their fingerprint."""
    return baseline.join(new.select("fingerprint_id"), "fingerprint_id", "left_anti").select(*BASELINE_COLUMNS).unionByName(new.select(*BASELINE_COLUMNS))


def remove_from_baseline(baseline: DataFrame, fingerprint_ids: Sequence[str]) -> DataFrame:
    return baseline.where(~F.col("fingerprint_id").isin(list(fingerprint_ids)))


def baseline_diff(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New findings, existing findings, and resolved baseline entries: anti, semi and reverse anti join on the fingerprint."""
    keys = baseline.select("fingerprint_id")
    resolved = baseline.join(findings.select("fingerprint_id"), "fingerprint_id", "left_anti")
    return findings.join(keys, "fingerprint_id", "left_anti"), findings.join(keys, "fingerprint_id", "left_semi"), resolved


def exit_code(findings: DataFrame, errors: DataFrame, fail_on: str) -> DataFrame:
    """One row (exit_code): 2 if any file failed, 1 if a finding reaches fail_on, else 0."""
    worst = findings.agg(F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(-1)).alias("worst"))
    failed = errors.agg(F.count("*").alias("failed"))
    both = worst.select("worst", F.lit(1).alias("k")).join(failed.select("failed", F.lit(1).alias("k")), "k")
    return both.select(F.when(F.col("failed") > 0, 2).when(F.col("worst") >= severity_rank(F.lit(fail_on)), 1).otherwise(0).alias("exit_code"))


def select_for_analysis(files: DataFrame, cache: DataFrame, changed: DataFrame | None, tool_version: str, now: Column, max_age_days: int = 7, force: bool = False) -> DataFrame:
    """(path, file_hash, decision) with decision forced, cached, changed or skipped.

    cache has (filepath, file_hash, tool_version, analyzed_at); a hit has the content's hash, this version and at most max_age_days.
    """
    hashed = files.select("path", F.sha2("source", 256).alias("file_hash"))
    valid = cache.where((F.col("tool_version") == tool_version) & (F.col("analyzed_at") >= now - F.make_dt_interval(F.lit(max_age_days))))
    valid = valid.select(F.col("filepath").alias("path"), "file_hash").distinct().withColumn("hit", F.lit(True))
    out = hashed.join(valid, ["path", "file_hash"], "left")
    if changed is None:
        decision = F.when(F.col("hit"), "cached").otherwise("changed")
    else:
        out = out.join(changed.select("path").distinct().withColumn("moved", F.lit(True)), "path", "left")
        decision = F.when(F.col("hit"), "cached").when(F.col("moved"), "changed").otherwise("skipped")
    return out.select("path", "file_hash", (F.lit("forced") if force else decision).alias("decision"))
