"""Queries over the delivered tables: nested records, drifting schemas, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstrata.operators import drift, nested, snapshots
from solstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.record_edges(table(spark, d, "sarif_logs"), table(spark, d, "ast_units"))


def _log_table(*path: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        logs = nested.latest_readable(table(spark, d, "sarif_logs"), "log_id", "payload", ["received_at", "delivery_id"])
        return nested.related_table(logs, path)

    return query


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    units = nested.latest_readable(table(spark, d, "ast_units"), "unit_id", "ast_json", ["compiled_at", "delivery_id"])
    return nested.node_table(units)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    changes = drift.field_changes(table(spark, d, "cache_entries"), "cache_dir", "dump_id", "written_at", "payload")
    return changes.select(F.col("dump").alias("dump_id"), "change", "field", "new_field")


def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.consistent_entries(table(spark, d, "cache_entries"))
    versions = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("detector_versions"))))
    return rows.withColumn("findings", F.to_json("findings")).withColumn("detector_versions", versions)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.finding_changes(table(spark, d, "baseline_findings"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshots.finding_changes(table(spark, d, "baseline_findings"))
    return changes.groupBy("project_root", "snapshot_no", "change").agg(F.count("*").alias("findings"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_runs": _log_table("runs"),
    "p1_results": _log_table("runs", "results"),
    "p1_locations": _log_table("runs", "results", "locations"),
    "p1_nodes": p1_nodes,
    "p1_code_flows": _log_table("runs", "results", "codeFlows"),
    "p1_thread_flows": _log_table("runs", "results", "codeFlows", "threadFlows"),
    "p1_flow_steps": _log_table("runs", "results", "codeFlows", "threadFlows", "locations"),
    "p3_found": p3_found,
    "p3_entries": p3_entries,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
}

_P1 = r"""
with recursive logs as (select log_id, payload from (select *, row_number() over (partition by log_id order by received_at desc, delivery_id desc) as k
    from sarif_logs where json_valid(payload)) where k = 1),
units as (select unit_id, ast_json from (select *, row_number() over (partition by unit_id order by compiled_at desc, delivery_id desc) as k
    from ast_units where json_valid(ast_json)) where k = 1),
runs as (select log_id, 'runs[' || i || ']' as child, '' as parent, json_extract(payload, '$.runs[' || i || ']') as e
    from logs, unnest(range(coalesce(json_array_length(payload, '$.runs'), 0)::bigint)) as t(i)),
results as (select log_id, child || '.results[' || i || ']' as child, child as parent, json_extract(e, '$.results[' || i || ']') as e
    from runs, unnest(range(coalesce(json_array_length(e, '$.results'), 0)::bigint)) as t(i)),
locations as (select log_id, child || '.locations[' || i || ']' as child, child as parent
    from results, unnest(range(coalesce(json_array_length(e, '$.locations'), 0)::bigint)) as t(i)),
flows as (select log_id, child || '.codeFlows[' || i || ']' as child, child as parent, json_extract(e, '$.codeFlows[' || i || ']') as e
    from results, unnest(range(coalesce(json_array_length(e, '$.codeFlows'), 0)::bigint)) as t(i)),
threads as (select log_id, child || '.threadFlows[' || i || ']' as child, child as parent, json_extract(e, '$.threadFlows[' || i || ']') as e
    from flows, unnest(range(coalesce(json_array_length(e, '$.threadFlows'), 0)::bigint)) as t(i)),
steps as (select log_id, child || '.locations[' || i || ']' as child, child as parent
    from threads, unnest(range(coalesce(json_array_length(e, '$.locations'), 0)::bigint)) as t(i)),
tree as (select unit_id, t.id as nid, t.parent as up, json_extract_string(t.value, '$.id') as node, json_extract_string(t.value, '$.nodeType') as kind
    from units, json_tree(units.ast_json::json) as t where t.type in ('OBJECT', 'ARRAY')),
marked as (select unit_id, nid, up, kind, case when kind is not null then node end as node from tree),
climb as (select unit_id, nid as start, node as child, up as nid from marked where node is not null and kind <> 'SourceUnit'
    union all select c.unit_id, c.start, c.child, m.up from climb c join marked m on m.unit_id = c.unit_id and m.nid = c.nid where m.node is null)
select 'sarif' as record_kind, log_id as record_id, child, parent from (select log_id, child, parent from runs union all select log_id, child, parent from results union all from locations
    union all select log_id, child, parent from flows union all select log_id, child, parent from threads union all from steps)
union all select 'ast', c.unit_id, c.child, coalesce(m.node, '') from climb c left join marked m on m.unit_id = c.unit_id and m.nid = c.nid where c.nid is null or m.node is not null
"""

ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p5_found": r"""
with seen as (select project_root, snapshot_no, lag(snapshot_no) over w as prev_no, lead(snapshot_no) over w as next_no
    from (select distinct project_root, snapshot_no from baseline_findings where project_root is not null and snapshot_no is not null)
    window w as (partition by project_root order by snapshot_no)),
held as (select project_root, snapshot_no, fingerprint_id, rule_id, lower(trim(severity)) as severity,
    regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') as file_path from (select *, row_number() over (
    partition by project_root, snapshot_no, fingerprint_id order by suppressed_at desc nulls last, delivered_at desc nulls last) as k
    from baseline_findings where fingerprint_id is not null and project_root is not null) where k = 1),
new as (select h.*, s.snapshot_no as at from held h join seen s using (project_root, snapshot_no) where prev_no is not null),
old as (select h.*, s.next_no as at from held h join seen s using (project_root, snapshot_no) where next_no is not null)
select coalesce(n.project_root, o.project_root) as project_root, coalesce(n.at, o.at) as snapshot_no,
  coalesce(n.fingerprint_id, o.fingerprint_id) as fingerprint_id,
  case when o.at is null then 'added' when n.at is null then 'removed' else 'changed' end as change
from new n full join old o on n.project_root = o.project_root and n.at = o.at and n.fingerprint_id = o.fingerprint_id
where o.at is null or n.at is null or n.rule_id is distinct from o.rule_id or n.file_path is distinct from o.file_path or n.severity is distinct from o.severity""",
}
ORACLES["p5_counts"] = f"select project_root, snapshot_no, change, count(*) as findings from ({ORACLES['p5_found']}) group by all"

_LOGS = """with logs as (select log_id, payload from (select *, row_number() over (partition by log_id order by received_at desc nulls last, delivery_id desc) as k
    from sarif_logs where json_valid(payload)) where k = 1),
runs as (select log_id, 'runs[' || i || ']' as child, '' as parent, json_extract(payload, '$.runs[' || i || ']') as e
    from logs, unnest(range(coalesce(json_array_length(payload, '$.runs'), 0)::bigint)) as t(i))"""


def _level(name: str, above: str, field: str) -> str:
    return f""", {name} as (select log_id, child || '.{field}[' || i || ']' as child, child as parent, json_extract(e, '$.{field}[' || i || ']') as e
    from {above}, unnest(range(coalesce(json_array_length(e, '$.{field}'), 0)::bigint)) as t(i))"""


_RESULTS = _LOGS + _level("results", "runs", "results")
_FLOWS = _RESULTS + _level("flows", "results", "codeFlows")
_THREADS = _FLOWS + _level("threads", "flows", "threadFlows")


def _columns(select: str, source: str, /, **paths: str) -> str:
    values = ", ".join(f"json_extract_string(e, '$.{p}') as {c}" for c, p in paths.items())
    return f"{select} select log_id as record_id, child as row_key, parent as parent_key, {values} from {source}"


ORACLES |= {
    "p1_runs": _columns(_LOGS, "runs", tool_name="tool.driver.name", tool_version="tool.driver.version"),
    "p1_results": _columns(_RESULTS, "results", rule_id="ruleId", level="level", message="message.text"),
    "p1_locations": _columns(_RESULTS + _level("places", "results", "locations"), "places", uri="physicalLocation.artifactLocation.uri", start_line="physicalLocation.region.startLine"),
    "p1_code_flows": _columns(_FLOWS, "flows", message="message.text"),
    "p1_thread_flows": _columns(_THREADS, "threads", flow_id="id", message="message.text"),
    "p1_flow_steps": _columns(_THREADS + _level("steps", "threads", "locations"), "steps", uri="location.physicalLocation.artifactLocation.uri", start_line="location.physicalLocation.region.startLine",
                              importance="importance", message="location.message.text"),
    "p1_nodes": """with recursive units as (select unit_id, ast_json from (select *, row_number() over (partition by unit_id order by compiled_at desc nulls last, delivery_id desc) as k
    from ast_units where json_valid(ast_json)) where k = 1),
marked as (select unit_id, t.id as nid, t.parent as up, json_extract_string(t.value, '$.id') as id, json_extract_string(t.value, '$.nodeType') as "nodeType", json_extract_string(t.value, '$.name') as name,
    json_extract_string(t.value, '$.src') as src, t.type = 'OBJECT' and json_extract_string(t.value, '$.id') is not null and json_extract_string(t.value, '$.nodeType') is not null as is_node
    from units, json_tree(units.ast_json::json) as t where t.type in ('OBJECT', 'ARRAY')),
climb as (select unit_id, nid as start, up as nid from marked where is_node and "nodeType" <> 'SourceUnit'
    union all select c.unit_id, c.start, m.up from climb c join marked m on m.unit_id = c.unit_id and m.nid = c.nid where not m.is_node)
select n.unit_id as record_id, n.id as row_key, coalesce(m.id, '') as parent_key, n."nodeType", n.name, n.src from climb c join marked n on n.unit_id = c.unit_id and n.nid = c.start
  left join marked m on m.unit_id = c.unit_id and m.nid = c.nid where c.nid is null or m.is_node""",
}
