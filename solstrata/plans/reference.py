"""Queries of the analyzer's own operators: over the given source files and a small corpus, and in general form over the other tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solstrata.functions.globs import glob_regex
from solstrata.operators import astgraph, bytecode, closure, detectors, drift, findings, formal, guards, inheritance, intercontract, nested, rules, snapshots, state_ops, statistics, structure, taint
from solstrata.plans.samples import SAMPLES, expected_findings, sample_codes, sample_files, sample_units
from solstrata.session import materialize, table
from solstrata.sources import files as src, reports

Query = Callable[[SparkSession, str], DataFrame]
EXCLUDED = ("test/**", "**/*V2.sol", "*Token.sol")
OVERRIDES = (("AUTH", "critical", None), ("INIT", "low", None))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Solidity files of the table and the small corpus."""
    return src.table_sources(table(spark, d, "source_files"), (".sol",)).unionByName(sample_files(spark))


def _corpus(spark: SparkSession, d: str) -> structure.Corpus:
    return structure.Corpus(_files(spark, d), materialize)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    units = nested.latest_readable(table(spark, d, "ast_units"), "unit_id", "ast_json", ["compiled_at", "delivery_id"])
    return materialize(astgraph.ast_nodes(units.unionByName(sample_units(spark))), "ast-nodes")


def _baseline_rows(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the snapshots in the form of detector results."""
    b = table(spark, d, "baseline_findings")
    return b.select(F.col("file_path").alias("path"), F.col("snapshot_no").alias("line"), "rule_id", F.split_part("rule_id", F.lit("-"), F.lit(2)).alias("detector"), F.lower(F.trim("severity")).alias("severity"),
                    F.lit("high").alias("confidence"), "title", F.lit("").alias("snippet"), F.lit("").alias("contract"), F.lit("").alias("function"), "fingerprint_id", "project_root", "suppressed_at", "note")


def text_lines(spark, d):
    return structure.lines(src.table_sources(table(spark, d, "source_files")))


def skipped_files(spark, d):
    """Files a scan skips by default, or by the configured globs."""
    files = table(spark, d, "source_files").where("file_path is not null").select("file_id", F.replace("file_path", F.lit("\\"), F.lit("/")).alias("path"))
    return files.select("file_id", src.skipped(F.col("path")).alias("skipped"), detectors.rx("path", *[glob_regex(p) for p in EXCLUDED]).alias("excluded"))


def file_languages(spark, d):
    return table(spark, d, "source_files").groupBy(F.coalesce(src.language(F.col("file_path")), F.lit("other")).alias("language")).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))


def pragma_versions(spark, d):
    return structure.versions(_files(spark, d))


def file_imports(spark, d):
    return structure.imports(_files(spark, d))


def verified_files(spark, d):
    return src.verified_files(table(spark, d, "verified_sources"), "source_id").groupBy("source_id").agg(F.count("*").alias("files"), F.sum(F.length("source")).alias("chars"))


def brace_depth(spark, d):
    """Greatest depth of braces of each file, by a running sum over its lines."""
    lines = structure.lines(src.table_sources(table(spark, d, "source_files")))
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("depth", F.sum(count("{") - count("}")).over(w)).groupBy("path").agg(F.max("depth").alias("max_depth"))


def line_windows(spark, d):
    """Per order line: the largest quantity of three lines before to itself, and the lines among the next ten that are larger."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = rows.withColumn("before_max", F.max("l_quantity").over(w.rowsBetween(-3, 0))).withColumn("after_max", F.max("l_quantity").over(w.rowsBetween(1, 10)))
    return out.select("l_orderkey", "l_linenumber", "before_max", "after_max")


def event_pairs(spark, d):
    """Per user: purchases after the first error, by an ordered self join on aggregates."""
    events = table(spark, d, "events").where("user_id is not null")
    kinds = F.min("event_type")
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    after = events.join(first, "user_id").where(F.struct("ts", "event_id") > F.col("f"))
    return after.groupBy("user_id").agg(F.count("*").alias("later"), kinds.alias("least_type"))


def last_event_before(spark, d):
    """As-of: for each event the id of the user's last event of another kind before it."""
    events = table(spark, d, "events").where("user_id is not null")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    every = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.select("event_id", "user_id", F.row_number().over(w).cast("bigint").alias("nth_of_kind"), F.last("event_id").over(every).alias("previous_id"))


def _hierarchy(spark, d):
    nation, region, supplier = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    up = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat(F.lit("n:"), "n_name").alias("child"), F.concat(F.lit("r:"), "r_name").alias("parent"))
    low = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("n:"), "n_name").alias("parent"))
    return up.unionByName(low).unionByName(region.select(F.concat(F.lit("r:"), "r_name").alias("child"), F.lit("world").alias("parent")))


def hierarchy_closure(spark, d):
    return closure.closure(_hierarchy(spark, d), "child", "parent")


def event_cycles(spark, d):
    """Kinds of events that follow each other in a cycle, per user."""
    events = table(spark, d, "events").where("user_id is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("next_type", F.lead("event_type").over(w)).where("next_type is not null").select("user_id", "event_type", "next_type").distinct()
    return closure.cycles(materialize(closure.closure(steps, "event_type", "next_type", ["user_id"]), "event-closure"), "event_type", "next_type", ["user_id"])


def finding_counts(spark, d):
    return statistics.finding_counts(_baseline_rows(spark, d))


def findings_per_file(spark, d):
    return statistics.per_file(_baseline_rows(spark, d).where("path is not null"))


def severe_findings(spark, d):
    return findings.at_least(_baseline_rows(spark, d), "high").select("project_root", "line", "fingerprint_id", "severity")


def overridden_findings(spark, d):
    o = spark.createDataFrame(list(OVERRIDES), "name string, severity string, confidence string")
    out = findings.apply_overrides(_baseline_rows(spark, d).where("rule_id is not null"), o)
    return out.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))


def kept_findings(spark, d):
    return findings.exclude_paths(_baseline_rows(spark, d).where("path is not null"), EXCLUDED).groupBy("path").agg(F.count("*").alias("findings"))


def finding_fingerprints(spark, d):
    return findings.fingerprints(_baseline_rows(spark, d)).groupBy("fingerprint_id").agg(F.count("*").alias("findings"))


def finding_ids(spark, d):
    return _baseline_rows(spark, d).select(findings.finding_id().alias("finding_id"), "rule_id", "line").distinct()


def _steps(spark, d, rows):
    """Each project's rows of a snapshot and of the one before it, both with that snapshot's number as `step`."""
    order = snapshots.small_side(materialize(snapshots.snapshot_order(table(spark, d, "baseline_findings"), "project_root", "snapshot_no"), "snapshot-order"))
    rows = rows.where("project_root is not null and line is not null").join(order.select(F.col("grp").alias("project_root"), F.col("no").alias("line"), "prev_no", "next_no"), ["project_root", "line"])
    return rows.where("prev_no is not null").withColumn("step", F.col("line")), rows.where("next_no is not null").withColumn("step", F.col("next_no"))


def _scans(spark, d):
    """All scans and the baselines they meet: fingerprints are per project and snapshot."""
    one = lambda rows: rows.withColumn("fingerprint_id", F.concat_ws("|", "project_root", F.col("step").cast("string"), "fingerprint_id"))
    new, old = _steps(spark, d, _baseline_rows(spark, d).where("fingerprint_id is not null"))
    return one(new), findings.create_baseline(one(old))


def baseline_new(spark, d):
    new, base = _scans(spark, d)
    return findings.baseline_diff(new, base)[0].select("fingerprint_id").distinct()


def baseline_existing(spark, d):
    new, base = _scans(spark, d)
    return findings.baseline_diff(new, base)[1].select("fingerprint_id").distinct()


def baseline_resolved(spark, d):
    new, base = _scans(spark, d)
    return findings.baseline_diff(new, base)[2].select("fingerprint_id")


def merged_baseline(spark, d):
    new, base = _scans(spark, d)
    return findings.merge_baseline(base, findings.create_baseline(new)).groupBy("rule_id").agg(F.count("*").alias("entries"))


def rule_catalogue(spark, d):
    return rules.catalogue(spark)


def slowest_orders(spark, d):
    """A top-k report."""
    return statistics.slowest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, "o_orderkey", "o_totalprice")


def timing_statistics(spark, d):
    out = statistics.timing(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return out.select("l_returnflag", "runs", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "stddev", "share")])


def detector_accuracy(spark, d):
    new, old = _steps(spark, d, _baseline_rows(spark, d).where("rule_id is not null and path is not null"))
    out = statistics.accuracy(new, old, ["project_root", "step", "path", "rule_id"])
    return out.select("detector", "true_positives", "false_positives", "false_negatives", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def code_patterns(spark, d):
    return bytecode.byte_patterns(table(spark, d, "verified_sources"), "source_id", "constructorarguments")


def code_comparison(spark, d):
    v = table(spark, d, "verified_sources").select("source_id", F.upper("constructorarguments").alias("deployed"), F.when(F.col("source_id") % 3 > 0, F.concat(F.lit("0x"), "constructorarguments")).alias("local"))
    return bytecode.compare(v).select("source_id", "match", "deployed_hash")


def code_instructions(spark, d):
    """Instructions of the constructor arguments, which are hex as code is, and of the planted code."""
    codes = table(spark, d, "verified_sources").where("constructorarguments <> ''").select("source_id", "constructorarguments")
    return bytecode.disassemble(codes.unionByName(sample_codes(spark)), "source_id", "constructorarguments")


def code_selectors(spark, d):
    return bytecode.function_selectors(code_instructions(spark, d), "source_id")


def noted_opcodes(spark, d):
    return bytecode.noted_opcodes(code_instructions(spark, d), "source_id")


def proxy_kinds(spark, d):
    return bytecode.proxies(table(spark, d, "verified_sources"), "sourcecode", "constructorarguments").select("source_id", "proxy_kind", "implementation")


def exploited_contracts(spark, d):
    """Known addresses among the sources and a planted one."""
    planted = spark.createDataFrame([(bytecode.KNOWN_EXPLOITS[0][0].upper().replace("0X", "0x"),)], "address string")
    return bytecode.known_exploits(table(spark, d, "verified_sources").select("address").unionByName(planted))


def cache_decisions(spark, d):
    """Which files a cache of analyses saves from being analysed again."""
    cache = drift.consistent_entries(table(spark, d, "cache_entries")).select("filepath", "file_hash", "tool_version", "analyzed_at")
    now = F.lit("2025-06-30 00:00:00").cast("timestamp")
    return findings.select_for_analysis(src.table_sources(table(spark, d, "source_files")), cache, None, "0.4.1", now, 7)


def _scan(name: str) -> Query:
    return lambda spark, d: detectors.scan(_corpus(spark, d), [name])


def scan_all(spark, d):
    """The default scan: all default detectors, the rule's defaults, fingerprints."""
    found = findings.with_rules(detectors.scan(_corpus(spark, d)), rules.catalogue(spark))
    return findings.fingerprints(found)


def scan_intercontract(spark, d):
    return intercontract.findings(_corpus(spark, d))


def source_blocks(spark, d):
    return structure.blocks(_files(spark, d)).drop("body", "code")


def state_variables(spark, d):
    return structure.state_variables(_files(spark, d))


def lines_in_scope(spark, d):
    c = _corpus(spark, d)
    return structure.scope_at_line(c.lines, structure.scopes(c.blocks)).groupBy("path", "scope_kind", "scope_name").agg(F.count("*").alias("lines"))


def lines_of_functions(spark, d):
    c = _corpus(spark, d)
    return structure.enclosing_function(c.lines.select("path", "line_no"), c.blocks).groupBy("path", "function_name").agg(F.count("*").alias("lines"))


def node_lines(spark, d):
    """Line and column of the first brace of each file, from its byte offset."""
    files = _files(spark, d).where(F.contains("source", F.lit("{")))
    points = files.select("path", (F.octet_length(F.split_part("source", F.lit("{"), F.lit(1)))).alias("offset")).distinct()
    return structure.offset_lines(points, files)


def suppressed_lines(spark, d):
    said = spark.createDataFrame([("a.sol", "x\n// audit-disable-next-line AUTH-001\ny\n// audit-disable\nz\n// audit-enable\nw")], "path string, source string")
    return findings.suppress_intervals(_files(spark, d).unionByName(said))


def _on_blocks(make: Callable[[structure.Corpus], DataFrame]) -> Query:
    return lambda spark, d: make(_corpus(spark, d))


def _on_nodes(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: make(_nodes(spark, d))


def fuzz_targets(spark, d):
    return formal.fuzz_targets(detectors.scan(_corpus(spark, d), ["reentrancy", "unchecked-call"]))


def sarif_rows(spark, d):
    return reports.sarif_results(_baseline_rows(spark, d))


def finding_traces(spark, d):
    c = _corpus(spark, d)
    ops = materialize(state_ops.state_ops(c.functions, c.blocks, c.variables, c.lineage), "state-ops")
    return reports.traces(ops, state_ops.cei_violations(ops)).select("path", "contract", "function", "summary", F.to_json("steps").alias("steps"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (text_lines, skipped_files, file_languages, pragma_versions, file_imports, verified_files, brace_depth, line_windows, event_pairs, last_event_before, hierarchy_closure, event_cycles, finding_counts,
              findings_per_file, severe_findings, overridden_findings, kept_findings, finding_fingerprints, finding_ids, baseline_new, baseline_existing, baseline_resolved, merged_baseline, rule_catalogue, slowest_orders,
              timing_statistics, detector_accuracy, code_patterns, code_comparison, code_instructions, code_selectors, noted_opcodes, proxy_kinds, exploited_contracts, cache_decisions, scan_all, scan_intercontract,
              source_blocks, state_variables, lines_in_scope, lines_of_functions, node_lines, suppressed_lines, fuzz_targets, sarif_rows, finding_traces)
}
def detect_vyper_reentrancy(spark, d):
    return detectors.scan(structure.Corpus(src.table_sources(table(spark, d, "source_files"), (".vy",)).unionByName(sample_files(spark).where("path like '%.vy'")), materialize), ["vyper-reentrancy"])


@functools.lru_cache(maxsize=4)
def _sample_corpus(spark: SparkSession) -> structure.Corpus:
    return structure.Corpus(sample_files(spark), materialize)


def _sample(name: str) -> Query:
    """Findings of one detector in the planted contracts alone."""

    def query(spark, d):
        c = _sample_corpus(spark)
        found = intercontract.findings(c) if name == "intercontract" else detectors.scan(c, [name])
        return found.select("path", "line", "rule_id", "severity").distinct()

    return query


QUERIES |= {"sample_" + n.replace("-", "_"): _sample(n) for n in [*detectors.DETECTORS, *detectors.EXPERIMENTAL, "intercontract"]}
QUERIES |= {"detect_" + n.replace("-", "_"): _scan(n) for n in [*detectors.DETECTORS, *detectors.EXPERIMENTAL]}
QUERIES["detect_vyper_reentrancy"] = detect_vyper_reentrancy
QUERIES |= {
    "inheritance_edges": _on_blocks(lambda c: inheritance.inherits(c.blocks)),
    "inheritance_ancestors": _on_blocks(lambda c: c.lineage),
    "inheritance_parents": _on_blocks(lambda c: inheritance.resolve_parents(c.blocks, structure.resolve_imports(c.files))),
    "effective_functions": _on_blocks(lambda c: inheritance.effective_functions(c.blocks, c.lineage)),
    "function_selectors": _on_blocks(lambda c: inheritance.signatures(c.blocks)),
    "selector_collisions": _on_blocks(lambda c: inheritance.selector_collisions(inheritance.signatures(c.blocks))),
    "modifier_kinds": _on_blocks(lambda c: inheritance.modifier_kinds(c.blocks)),
    "function_guards": _on_blocks(lambda c: inheritance.function_guards(c.blocks, c.lineage)),
    "override_links": _on_blocks(lambda c: inheritance.override_links(c.blocks, c.lineage)),
    "override_regressions": _on_blocks(lambda c: inheritance.regressions(inheritance.override_links(c.blocks, c.lineage))),
    "state_operations": _on_blocks(lambda c: state_ops.state_ops(c.functions, c.blocks, c.variables, c.lineage)),
    "operation_summary": _on_blocks(lambda c: state_ops.operation_summary(state_ops.state_ops(c.functions, c.blocks, c.variables, c.lineage))),
    "early_guards": _on_blocks(lambda c: guards.early_guards(c.functions)),
    "custom_mutexes": _on_blocks(lambda c: guards.custom_mutexes(c.functions, c.variables)),
    "branch_context": _on_blocks(lambda c: guards.branch_context(c.functions)),
    "conditional_writes": _on_blocks(lambda c: guards.conditional_writes(c.functions)),
    "call_edges_between": _on_blocks(lambda c: intercontract.call_edges(c)[0]),
    "ast_nodes": _on_nodes(lambda n: n),
    "ast_functions": _on_nodes(astgraph.functions),
    "ast_calls": _on_nodes(astgraph.calls),
    "symbol_uses": _on_nodes(astgraph.uses),
    "symbol_summary": _on_nodes(astgraph.symbol_summary),
    "writes_after_call": _on_nodes(lambda n: astgraph.after_call(astgraph.uses(n), astgraph.calls(n))),
    "call_edges": _on_nodes(astgraph.call_edges),
    "reach_summary": _on_nodes(astgraph.reach_summary),
    "call_cycles": _on_nodes(astgraph.risky_cycles),
    "taint_symbols": _on_nodes(taint.tainted_symbols),
    "taint_labels": _on_nodes(lambda n: taint.strongest_label(taint.tainted_symbols(n))),
    "taint_flows": _on_nodes(taint.bounded_flows),
    "taint_summaries": _on_nodes(taint.function_summaries),
    "taint_storage": _on_nodes(taint.tainted_storage),
}

_SAMPLE_ROWS = ", ".join("('" + p.replace("'", "''") + "', '" + s.replace("'", "''") + "')" for p, s in sorted(SAMPLES.items()))
_TABLE = r"""select concat_ws('/', coalesce(repo, '-/' || file_id), regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '')) as path, content as source, file_path from source_files"""
_SOL = f"(select path, source from ({_TABLE}) where lower(file_path) like '%.sol' union all select * from (values {_SAMPLE_ROWS}) as s(path, source))"
_BOTH = f"(select path, source from ({_TABLE}) where lower(file_path) like '%.sol' or lower(file_path) like '%.vy')"
_LINES = "select path, i as line_no, parts[i] as line from (select path, string_split(source, chr(10)) as parts from {0} where source is not null), unnest(range(1, len(parts) + 1)) as t(i)"
_B = r"""(select file_path as path, snapshot_no as line, rule_id, split_part(rule_id, '-', 2) as detector, lower(trim(severity)) as severity, title, fingerprint_id, project_root from baseline_findings)"""
_RANK = "case {0} when 'info' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end"
_ORDER = """(select project_root, line, lag(line) over w as prev_no, lead(line) over w as next_no from (select distinct project_root, snapshot_no as line from baseline_findings
  where project_root is not null and snapshot_no is not null) window w as (partition by project_root order by line))"""
_NEW = f"(select b.*, b.line as step, concat_ws('|', project_root, b.line, fingerprint_id) as fp from {_B} b join {_ORDER} o using (project_root, line) where prev_no is not null)"
_OLD = f"(select b.*, o.next_no as step, concat_ws('|', project_root, o.next_no, fingerprint_id) as fp from {_B} b join {_ORDER} o using (project_root, line) where next_no is not null)"
_NEW_FP, _OLD_FP = (f"(select distinct fp from {x} where fingerprint_id is not null)" for x in (_NEW, _OLD))
_AUTH, _SAFE = "|".join(detectors.TX_ORIGIN_AUTH), "|".join(detectors.TX_ORIGIN_SAFE)
_GLOBS = " or ".join(f"regexp_matches(path, '{glob_regex(p)}')" for p in EXCLUDED)
_BASE_GLOBS = " or ".join(f"regexp_matches(split_part(path, '/', -1), '{glob_regex(p)}')" for p in EXCLUDED if "/" not in p)

ORACLES: dict[str, str] = {
    "node_lines": rf"""with f as (select path, split_part(source, '{{', 1) as before from {_SOL} where contains(source, '{{'))
select path, strlen(before)::int as "offset", (length(before) - length(replace(before, chr(10), '')) + 1)::int as line, (strlen(split_part(before, chr(10), -1)) + 1)::int as "column" from f""",
    "text_lines": _LINES.format(_BOTH),
    "skipped_files": rf"""with f as (select file_id, replace(file_path, '\', '/') as path from source_files where file_path is not null)
select file_id, list_bool_or(list_transform(string_split(lower(path), '/'), lambda p: starts_with(p, '.') and p not in ('.', '..')))
  or len(list_intersect(string_split(lower(path), '/')[:-2], ['{"', '".join(src.SKIPPED_FOLDERS)}'])) > 0 or lower(path) like '%\_test.sol' escape '\' or lower(path) like '%.t.sol' as skipped,
  {_GLOBS} as excluded from f""",
    "file_languages": "select case when lower(file_path) like '%.sol' then 'solidity' when lower(file_path) like '%.vy' then 'vyper' else 'other' end as language, count(*) as files, sum(n_bytes)::bigint as bytes from source_files group by 1",
    "pragma_versions": rf"""with f as (select path, regexp_extract(source, 'pragma\s+solidity\s+([^;]+);', 1) as pragma from {_SOL} where source is not null),
g as (select path, pragma, try_cast(regexp_extract(pragma, '(\d+)\.(\d+)\.(\d+)', 1) as int) as major, try_cast(regexp_extract(pragma, '(\d+)\.(\d+)\.(\d+)', 2) as int) as minor, try_cast(regexp_extract(pragma, '(\d+)\.(\d+)\.(\d+)', 3) as int) as patch from f)
select *, case when pragma = '' then false when major is null then true else major = 0 and minor < 8 end as below_08 from g""",
    "file_imports": rf"""select path, unnest(regexp_extract_all(source, '(?m)^\s*import\s+(?:[^;"'']*\s)?["'']([^"'']+)["'']', 1)) as target from {_SOL} where source is not null""",
    "brace_depth": f"""with l as ({_LINES.format(_BOTH)}), s as (select path, sum(length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', ''))) over (partition by path order by line_no rows unbounded preceding) as depth from l)
select path, max(depth)::bigint as max_depth from s group by path""",
    "line_windows": "select l_orderkey, l_linenumber, max(l_quantity) over (w rows between 3 preceding and current row) as before_max, max(l_quantity) over (w rows between 1 following and 10 following) as after_max from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)",
    "event_pairs": "with f as (select user_id, min(row(ts, event_id)) as f from events where user_id is not null group by user_id) select user_id, count(*) as later, min(event_type) as least_type from events join f using (user_id) where row(ts, event_id) > f group by user_id",
    "last_event_before": "select event_id, user_id, row_number() over (partition by user_id, event_type order by ts, event_id) as nth_of_kind, lag(event_id) over (partition by user_id order by ts, event_id) as previous_id from events where user_id is not null",
    "hierarchy_closure": """with recursive e as (select 'n:' || n_name as child, 'r:' || r_name as parent from nation join region on n_regionkey = r_regionkey union all select 's:' || s_suppkey, 'n:' || n_name from supplier join nation on s_nationkey = n_nationkey
  union all select 'r:' || r_name, 'world' from region), c as (select child, parent, 1 as depth from e union select c.child, e.parent, depth + 1 from c join e on c.parent = e.child) select child, parent, min(depth) as depth from c group by all""",
    "event_cycles": """with recursive s as (select distinct user_id, event_type as a, n as b from (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as n from events where user_id is not null) where n is not null),
c as (select user_id, a, b from s union select c.user_id, c.a, s.b from c join s on c.user_id = s.user_id and c.b = s.a),
m as (select x.user_id, x.a, x.b from c x join c y on x.user_id = y.user_id and x.a = y.b and x.b = y.a where x.a <> x.b)
select user_id, a as node, least(a, min(b)) as component, count(distinct b) + 1 as size from m group by user_id, a""",
    "finding_counts": f"""with r as (select coalesce(severity, '') as severity, coalesce(detector, '') as detector, 'high' as confidence from {_B})
select 'severity' as dimension, severity as value, count(*) as findings from r group by severity union all select 'detector', detector, count(*) from r group by detector
union all select 'confidence', confidence, count(*) from r group by confidence union all select 'total', '', count(*) from r""",
    "findings_per_file": f"select path, count(*) as findings, max({_RANK.format('severity')}) as worst from {_B} where path is not null group by path",
    "severe_findings": f"select project_root, line, fingerprint_id, severity from {_B} where severity in ('high', 'critical')",
    "overridden_findings": f"select rule_id, case detector when 'AUTH' then 'critical' when 'INIT' then 'low' else severity end as severity, count(*) as findings from {_B} where rule_id is not null group by all",
    "kept_findings": f"select path, count(*) as findings from {_B} where path is not null and (starts_with(path, '<') or not ({_GLOBS} or {_BASE_GLOBS})) group by path",
    "finding_fingerprints": rf"""with n as (select coalesce(nullif(rule_id, ''), nullif(detector, ''), 'unknown') as rule, lower(regexp_replace(replace(coalesce(path, ''), '\', '/'), '^(\./)+', '')) as p,
  lower(trim(regexp_replace(coalesce(title, ''), '[\t\n\f\r ]+', ' ', 'g'))) as t from {_B})
select rule || '-' || left(sha256(concat_ws(chr(0), rule, p, '', '', t)), 12) as fingerprint_id, count(*) as findings from n group by 1""",
    "finding_ids": f"select distinct left(sha256(concat_ws(':', coalesce(rule_id, ''), coalesce(path, ''), coalesce(line::varchar, ''), coalesce(title, ''))), 12) as finding_id, rule_id, line from {_B}",
    "baseline_new": f"select fp as fingerprint_id from {_NEW_FP} except select fp from {_OLD_FP}",
    "baseline_existing": f"select fp as fingerprint_id from {_NEW_FP} intersect select fp from {_OLD_FP}",
    "baseline_resolved": f"select fp as fingerprint_id from {_OLD_FP} except select fp from {_NEW_FP}",
    "merged_baseline": f"""with held as (select fp, rule_id, 0 as k, title, severity, path from {_OLD} where fingerprint_id is not null union all select fp, rule_id, 1, title, severity, path from {_NEW} where fingerprint_id is not null),
one as (select fp, arg_max(rule_id, row(k, coalesce(title, ''), title is not null, coalesce(rule_id, ''))) as rule_id from held group by fp) select rule_id, count(*) as entries from one group by rule_id""",
    "slowest_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "timing_statistics": "select l_returnflag, count(*) as runs, round(avg(l_quantity), 6) as mean, min(l_quantity) as min, max(l_quantity) as max, round(stddev_pop(l_quantity), 6) as stddev, round(sum(l_quantity) / sum(sum(l_quantity)) over (), 6) as share from lineitem group by l_returnflag",
    "detector_accuracy": f"""with f as (select *, row_number() over (partition by step, detector, project_root, path, rule_id) as k from {_NEW} where rule_id is not null and path is not null),
e as (select *, row_number() over (partition by step, detector, project_root, path, rule_id) as k from {_OLD} where rule_id is not null and path is not null),
j as (select coalesce(f.detector, e.detector) as detector, f.k as f, e.k as e from f full join e on f.step = e.step and f.detector = e.detector and f.project_root = e.project_root and f.path = e.path and f.rule_id = e.rule_id and f.k = e.k),
c as (select detector, count(*) filter (f is not null and e is not null) as true_positives, count(*) filter (e is null) as false_positives, count(*) filter (f is null) as false_negatives from j group by detector)
select *, round(true_positives / nullif(true_positives + false_positives, 0), 6) as precision, round(true_positives / nullif(true_positives + false_negatives, 0), 6) as recall, round(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 6) as f1 from c""",
    "code_patterns": "with c as (select source_id, regexp_replace(lower(trim(constructorarguments)), '^0x', '') as code from verified_sources) select source_id, name, ((pos - 1) // 2)::int as pc from (select source_id, unnest(['SELFDESTRUCT', 'DELEGATECALL', 'ORIGIN']) as name, unnest([instr(code, 'ff'), instr(code, 'f4'), instr(code, '32')]) as pos from c) where pos > 0",
    "detect_tx_origin": rf"""with l as ({_LINES.format(_SOL)}), c as (select path, line_no, split_part(line, '//', 1) as text from l)
select path, line_no::int as line, 'AUTH-001' as rule_id, 'tx-origin' as detector, 'high' as severity, 'high' as confidence, 'tx.origin used to authorise' as title, trim(regexp_replace(text, '\s+', ' ', 'g')) as snippet, '' as contract, '' as function
from c where contains(text, 'tx.origin') and regexp_matches(text, '{_AUTH}') and not regexp_matches(text, '{_SAFE}')""",
}
_RULE_ROWS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in r[:5]) + f"', {str(r[5]).lower()})" for r in rules.RULES)
ORACLES["rule_catalogue"] = f"""select *, split_part(rule_id, '-', 1) as category, {_RANK.format('severity')} as severity_rank, case severity when 'info' then 0.0 when 'low' then 3.0 when 'medium' then 5.5 when 'high' then 7.5 else 9.5 end::double as score,
  case severity when 'info' then 'note' when 'low' then 'note' when 'medium' then 'warning' else 'error' end as report_level from (values {_RULE_ROWS}) as r(rule_id, name, severity, confidence, detector, enabled)"""
ORACLES["code_comparison"] = """with v as (select source_id, regexp_replace(lower(trim(constructorarguments)), '^0x', '') as a, case when source_id % 3 > 0 then constructorarguments end as b from verified_sources)
select source_id, case when coalesce(a, '') = '' then 'unverified' when coalesce(b, '') = '' then 'no_source' when a = regexp_replace(lower(trim(b)), '^0x', '') then 'exact' else 'mismatch' end as match, sha256(a) as deployed_hash from v"""


def _rows(columns: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) as t({columns})"


# What is planted; the delivered trees, code and addresses hold nothing that these queries look for.
ORACLES |= {
    "sample_" + name.replace("-", "_"): _rows("path, line, rule_id, severity", *[f"('{p}', {n}, '{r}', '{s}')" for p, n, r, s in rows]) for name, rows in expected_findings().items()
}
ORACLES |= {
    "code_selectors": _rows("source_id, selector", "(-1, '70a08231')", "(-1, 'a9059cbb')"),
    "exploited_contracts": _rows("address, day, loss_usd, exploit_kind", "('0xbf05279f9bf1ce69bbfed670813b7e431142afa4', date '2022-11-02', 2100000.0::double, 'reentrancy')"),
    "detect_vyper_reentrancy": _rows("path, line, rule_id, detector, severity, confidence, title, snippet, contract, function", """('bad/vyper-reentrancy/Safe.vy', 7, 'REENTRANCY-001', 'vyper-reentrancy', 'critical', 'high',
  'Call before the write of a state variable in ''leave''', 'raw_call(msg.sender, b"", value=share)', '', 'leave')"""),
    "selector_collisions": _rows("selector, forms", "('42966c68', ['burn(uint256)', 'collate_propagate_storage(bytes16)'])"),
    "custom_mutexes": _rows("path, contract, function, variable", "('lib/shapes/Shapes.sol', 'Shapes', 'turn', 'busy')"),
    "conditional_writes": _rows("path, contract, function, line", "('lib/shapes/Shapes.sol', 'Shapes', 'pick', 21)"),
    "symbol_uses": _rows("record_id, contract, symbol, function, function_node, node, statement, access", "(-1, 'Pump', 'spent', '_next', 31, 42, 0, 'read')", "(-1, 'Pump', 'spent', 'pull', 5, 24, 2, 'write')"),
    "writes_after_call": _rows("record_id, contract, function, symbol, node, first_call", "(-1, 'Pump', 'pull', 'spent', 24, 17)"),
    "call_edges": _rows("record_id, caller, callee, resolved", "(-1, 'Pump._next', 'Pump.pull', true)", "(-1, 'Pump.pull', 'Pump._next', true)"),
    "call_cycles": _rows("record_id, component, size, calls_out, risk", "(-1, 'Pump._next', 2, true, 'high')"),
    "taint_summaries": _rows("record_id, function, sinks, recursive", "(-1, 'Pump._next', ['call'], true)", "(-1, 'Pump.pull', ['call'], true)"),
    "taint_storage": _rows("record_id, contract, symbol, reads", "(-1, 'Pump', 'spent', 1)"),
}
