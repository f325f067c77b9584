import __spark_entry__ as entry


def test_every_query_runs_and_names_match(spark, data):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    for name in ("p1_found", "p3_found", "p5_found", "scan_all", "hierarchy_closure", "brace_depth"):
        assert queries[name](spark, data).columns
    assert entry.entry(spark).count() > 0


def test_found_columns(spark, data):
    want = {
        "p1_found": [("record_kind", "string"), ("record_id", "bigint"), ("child", "string"), ("parent", "string")],
        "p3_found": [("dump_id", "bigint"), ("change", "string"), ("field", "string"), ("new_field", "string")],
        "p5_found": [("project_root", "string"), ("snapshot_no", "int"), ("fingerprint_id", "string"), ("change", "string")],
    }
    for name, columns in want.items():
        got = entry.queries()[name](spark, data).dtypes
        assert [c for c, _ in got] == [c for c, _ in columns], name
        if name != "p3_found":
            assert got == columns
