"""Source files, explorer responses, changed files, configuration, baselines and cache entries as tables."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solstrata.functions.globs import matches_any

# Folders and files a scan skips.
SKIPPED_FOLDERS = ("node_modules", "lib", "vendor", "out", "artifacts", "cache", "mock", "mocks", "test", "tests")
SKIPPED_SUFFIXES = ("_test.sol", ".t.sol")


def skipped(path: Column) -> Column:
    """Whether a path, relative to the root, is skipped: hidden parts, folders of others' or generated code, tests and mocks."""
    parts = F.split(F.lower(path), "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & (p != ".") & (p != ".."))
    folders = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    suffix = F.lit(False)
    for s in SKIPPED_SUFFIXES:
        suffix = suffix | F.lower(path).endswith(s)
    return hidden | folders | suffix


def read_sources(spark: SparkSession, root: str, suffixes: Sequence[str] = (".sol",), exclude: Sequence[str] = (), defaults: bool = True) -> DataFrame:
    """(path, source) below root, paths relative to it; `defaults` applies the usual skips, `exclude` further globs."""
    far = "://" in root  # any file system Spark reads; a path without scheme is a local one
    root = (root if far else os.path.abspath(root)).rstrip("/")
    pattern = "*{" + ",".join(suffixes) + "}"
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    if not far or root.startswith("file:"):
        root = re.sub("^file:(//)?", "", root)
        full = F.regexp_replace(full, "^file:(//)?", "")
    df = df.select(F.substring(full, F.lit(len(root) + 2), F.length(full)).alias("path"), F.col("value").alias("source"))
    if defaults:
        df = df.where(~skipped(F.col("path")))
    return df.where(~matches_any(F.col("path"), exclude)) if exclude else df


def table_sources(files: DataFrame, suffixes: Sequence[str] = (".sol", ".vy")) -> DataFrame:
    """(path, source) of a table (file_id, repo, file_path, content); the path begins with the repository, or -/file_id without one."""
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("file_path").endswith(s)
    path = F.concat_ws("/", F.coalesce("repo", F.concat(F.lit("-/"), F.col("file_id").cast("string"))), F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", ""))
    return files.where(wanted).select(path.alias("path"), F.col("content").alias("source"))


def language(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".sol"), "solidity").when(F.lower(path).endswith(".vy"), "vyper")


def verified_files(sources: DataFrame, key: str = "address", text: str = "sourcecode", name: str = "contractname") -> DataFrame:
    """(key, path, source): the files of verified sources; compiler input, plain or in doubled braces, gives one row per file."""
    t = F.trim(F.col(text))
    inner = F.when(t.startswith("{{"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    doc = F.when(F.startswith("_inner", F.lit("{")), F.expr("try_parse_json(_inner)"))
    rows = sources.where(F.col(text).isNotNull()).select(key, F.col(name).alias("_name"), F.col(text).alias("_text"), inner.alias("_inner")).withColumn("_doc", doc)
    files = F.coalesce(F.expr("try_variant_get(_doc, '$.sources', 'map<string,struct<content:string>>')"), F.expr("try_variant_get(_doc, '$', 'map<string,struct<content:string>>')"))
    single = F.create_map(F.concat(F.coalesce("_name", F.lit("main")), F.lit(".sol")), F.struct(F.col("_text").alias("content")))
    return rows.select(key, F.explode(F.coalesce(files, single)).alias("path", "f")).select(key, "path", F.col("f.content").alias("source")).where("source is not null")


RESPONSE = "status string, message string, result array<struct<SourceCode:string,ABI:string,ContractName:string,CompilerVersion:string,OptimizationUsed:string,Runs:string,ConstructorArguments:string,EVMVersion:string,LicenseType:string>>"


def saved_responses(spark: SparkSession, path: str) -> DataFrame:
    """Verified sources from saved explorer responses (JSON files); an empty source means not verified and gives nulls."""
    df = spark.read.schema(RESPONSE).option("multiLine", True).json(path)
    out = df.select("status", F.explode_outer("result").alias("r")).select("status", "r.*")
    return out.withColumn("SourceCode", F.nullif("SourceCode", F.lit(""))).withColumn("is_verified", F.col("SourceCode").isNotNull())


def changed_files(spark: SparkSession, root: str, mode: str = "uncommitted", since: str | None = None) -> DataFrame:
    """(path) of added, copied, modified or renamed files: staged, unstaged, uncommitted (both), last-commit or since a reference."""
    base = ["git", "-C", root, "diff", "--name-only", "--diff-filter=ACMR"]
    asked = {"staged": [["--cached"]], "unstaged": [[]], "uncommitted": [["--cached"], []], "last-commit": [["HEAD~1", "HEAD"]], "since": [[since or "HEAD"]]}[mode]
    found: set[str] = set()
    for more in asked:
        found |= {p for p in subprocess.run(base + more, capture_output=True, text=True, check=True).stdout.splitlines() if p.endswith((".sol", ".vy"))}
    return spark.createDataFrame([(p,) for p in sorted(found)], "path string")


@dataclass
class Config:
    """What a configuration file says."""

    version: str = "1"
    workers: int = 4
    severity: str = "info"
    fail_on: str = "high"
    detectors: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)
    ignore: list[dict[str, str]] = field(default_factory=list)
    output: dict[str, str] = field(default_factory=dict)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    text = re.sub(r"\s+#.*$", "", text)
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(p) for p in text[1:-1].split(",") if p.strip()]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text, text)


def parse_yaml_subset(text: str):
    """Nested maps and lists of scalars by indentation; no anchors, no multi-line strings. Tabs and duplicate keys are errors."""
    rows = []
    for number, line in enumerate(text.splitlines(), 1):
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError(f"line {number}: tab in indentation")
        if line.strip() and not line.strip().startswith("#"):
            rows.append((len(line) - len(line.lstrip()), line.strip(), number))

    def block(i: int, indent: int):
        if i < len(rows) and rows[i][1].startswith("- "):
            out = []
            while i < len(rows) and rows[i][0] == indent and rows[i][1].startswith("- "):
                inner = rows[i][1][2:].strip()
                if re.match(r"[\w.*-]+:(\s|$)", inner):
                    rows[i] = (indent + 2, inner, rows[i][2])
                    value, i = block(i, indent + 2)
                else:
                    value, i = _scalar(inner), i + 1
                out.append(value)
            return out, i
        made: dict = {}
        while i < len(rows) and rows[i][0] == indent:
            m = re.match(r"(['\"]?)([^:'\"]+)\1:\s*(.*)$", rows[i][1])
            if not m or rows[i][1].startswith("- "):
                raise ValueError(f"line {rows[i][2]}: expected key: value")
            key, rest = m[2].strip(), m[3]
            if key in made:
                raise ValueError(f"line {rows[i][2]}: {key} twice")
            i += 1
            if rest and not rest.startswith("#"):
                made[key] = _scalar(rest)
            elif i < len(rows) and (rows[i][0] > indent or rows[i][0] == indent and rows[i][1].startswith("- ")):
                made[key], i = block(i, rows[i][0])
            else:
                made[key] = None
        return made, i

    if not rows:
        return {}
    value, end = block(0, rows[0][0])
    if end < len(rows):
        raise ValueError(f"line {rows[end][2]}: bad indentation")
    return value


_SECTIONS = {"version", "scan", "detectors", "rules", "exclude", "ignore", "output"}


def load_config(text: str) -> Config:
    """A checked configuration; unknown sections, severities and formats are errors."""
    from solstrata.operators.rules import CONFIDENCES, SEVERITIES

    doc = parse_yaml_subset(text) or {}
    if extra := set(doc) - _SECTIONS:
        raise ValueError(f"unknown sections: {', '.join(sorted(extra))}")
    scan, detectors, output = doc.get("scan") or {}, doc.get("detectors") or {}, doc.get("output") or {}
    out = Config(str(doc.get("version") or "1"), int(scan.get("workers", 4)), str(scan.get("severity", "info")), str(scan.get("fail_on", "high")), list(detectors.get("enable") or []),
                 list(detectors.get("disable") or []), list(doc.get("exclude") or []), dict(doc.get("rules") or {}), list(doc.get("ignore") or []), dict(output))
    for s in (out.severity, out.fail_on, *[o.get("severity") for o in out.overrides.values() if o.get("severity")]):
        if s not in SEVERITIES:
            raise ValueError(f"unknown severity {s}")
    for o in out.overrides.values():
        if o.get("confidence") and o["confidence"] not in CONFIDENCES:
            raise ValueError(f"unknown confidence {o['confidence']}")
    if out.output.get("format", "text") not in ("text", "json", "sarif", "markdown"):
        raise ValueError(f"unknown format {out.output['format']}")
    if out.workers < 1:
        raise ValueError("workers must be positive")
    return out


def find_config(start: str, name: str = "audit.yaml") -> str | None:
    """The nearest configuration file in start or a folder above."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(at, name)):
            return os.path.join(at, name)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


BASELINE = "version string, created_at timestamp, project_root string, tool_version string, total_findings int, findings map<string,struct<fingerprint_id:string,rule_id:string,severity:string,file_path:string,title:string,suppressed_at:timestamp,note:string>>"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a baseline file, one row each; a file without version is an error."""
    df = spark.read.schema(BASELINE).option("multiLine", True).json(path)
    if df.where("version is null").limit(1).count():
        raise ValueError("baseline without version")
    return df.select(F.explode("findings").alias("k", "f")).select("f.*")


def write_baseline(baseline: DataFrame, path: str, project_root: str, tool_version: str) -> None:
    """One JSON document; distinct fingerprints are counted."""
    entry = F.map_from_entries(F.collect_list(F.struct("fingerprint_id", F.struct("fingerprint_id", "rule_id", "severity", "file_path", "title", "suppressed_at", "note"))))
    one = baseline.agg(entry.alias("findings"), F.count_distinct("fingerprint_id").cast("int").alias("total_findings"))
    head = one.select(F.lit("1").alias("version"), F.current_timestamp().alias("created_at"), F.lit(project_root).alias("project_root"), F.lit(tool_version).alias("tool_version"), "total_findings", "findings")
    head.coalesce(1).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str, tool_version: str, now: Column, max_age_days: int = 7) -> DataFrame:
    """Cache entries that are still good: of this version and not too old."""
    return spark.read.parquet(path).where((F.col("tool_version") == tool_version) & (F.col("analyzed_at") >= now - F.make_dt_interval(F.lit(max_age_days))))


def write_cache(entries: DataFrame, path: str, partitions: int = 16) -> None:
    """Entries as Parquet, partitioned by the first hash digit; partitions that get rows are replaced as a whole."""
    keyed = entries.withColumn("part", F.substring("file_hash", 1, 1))
    keyed.repartition(partitions, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
