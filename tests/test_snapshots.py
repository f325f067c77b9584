import random

from pyspark.sql import functions as F

from solstrata.operators import snapshots

SCHEMA = "project_root string, snapshot_no int, fingerprint_id string, rule_id string, file_path string, severity string, suppressed_at timestamp, delivered_at timestamp, grp string, key string"


def brute(rows):
    best, present = {}, {}
    for p, n, f, rule, path, sev, at, got, *_ in rows:
        if p is None or n is None:
            continue
        present.setdefault(p, set()).add(n)
        if f is None:
            continue
        path = None if path is None else path.replace("\\", "/").removeprefix("./")
        value = (rule, path, None if sev is None else sev.strip().lower())
        if (p, n, f) not in best or (str(at or ""), str(got or "")) >= best[p, n, f][0]:
            best[p, n, f] = ((str(at or ""), str(got or "")), value)
    out = set()
    for p, ns in present.items():
        ns = sorted(ns)
        for a, b in zip(ns, ns[1:]):
            old = {f: v for (q, n, f), (_, v) in best.items() if (q, n) == (p, a)}
            new = {f: v for (q, n, f), (_, v) in best.items() if (q, n) == (p, b)}
            out |= {(p, b, f, "added") for f in new.keys() - old.keys()} | {(p, b, f, "removed") for f in old.keys() - new.keys()}
            out |= {(p, b, f, "changed") for f in new.keys() & old.keys() if new[f] != old[f]}
    return out


def test_changes_match_brute_force(spark):
    from datetime import datetime, timedelta

    rnd = random.Random(5)
    rows = []
    for k in range(900):
        at = datetime(2024, 1, 1) + timedelta(seconds=k) if rnd.random() < 0.8 else None
        rows.append((rnd.choice(["hot"] * 4 + ["a", "b", None]), rnd.choice([1, 2, 4, 7, None]), rnd.choice([None, *"fghij"]), rnd.choice(["R1", "R2", None]), rnd.choice(["./x/y", "x/y", "x\\y", None]),
                     rnd.choice(["High ", "high", "LOW", None]), at, datetime(2024, 2, 1) + timedelta(seconds=k), "clash", "clash"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in snapshots.finding_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert snapshots.finding_changes(df.limit(0)).count() == 0


def test_index_between_deliveries(spark, tmp_path):
    index = snapshots.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["k"], ["v", "w"], buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "k string, v string, w int")
    first = index.advance(make([("a", "1", 1), ("b", "1", None), (None, "x", 0), ("a", "1", 1)]))
    assert sorted((r.k, r.change) for r in first.collect()) == [("a", "added"), ("b", "added")]
    second = {r.k: r for r in index.advance(make([("b", "2", None), ("c", "1", 1)])).collect()}
    assert {k: r.change for k, r in second.items()} == {"a": "removed", "b": "changed", "c": "added"}
    assert second["b"].old.v == "1" and second["b"].new.v == "2" and second["a"].old is None
    assert index.version() == 1 and index.advance(make([("b", "2", None), ("c", "1", 1)])).count() == 0


def test_a_run_that_dies_before_the_swap_changes_nothing(spark, tmp_path):
    index = snapshots.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["k"], ["v"], buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    index.advance(make([("a", "1"), ("b", "1")]))

    class Dead(Exception):
        pass

    def die(version):
        raise Dead

    index._commit = die
    try:
        index.advance(make([("a", "2")]))
    except Dead:
        pass
    again = snapshots.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["k"], ["v"], buckets=4)
    assert again.version() == 0
    assert {(r.k, r.change) for r in again.advance(make([("a", "2")])).collect()} == {("a", "changed"), ("b", "removed")}
    assert again.version() == 1
    again.advance(make([("a", "2")]))
    assert sorted(p.name for p in (tmp_path / "ix").iterdir() if p.name.startswith("v")) == ["v2"]


def test_probing_the_index_shuffles_nothing(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("g").alias("grp"), F.col("id").cast("string").alias("key"), snapshots.value_hash(F.col("id")).alias("hash"))
    one, two = (snapshots.bucketed(rows.repartition(8, "grp", "key"), f"file://{tmp_path}/{x}", ["grp", "key"], 8) for x in "ab")
    present = F.broadcast(spark.createDataFrame([("g", False)], "grp string, is_first boolean"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = snapshots.advance_index(one, two, present)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_hash_tells_nulls_from_neighbours(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), ("a", "")], "x string, y string")
    assert df.select(snapshots.value_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == 4
