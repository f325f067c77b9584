import json

from solstrata.operators import drift

SCHEMA = "entry_id bigint, dump_id bigint, cache_dir string, written_at timestamp, payload string, filepath string"


def entries(spark, dumps):
    from datetime import datetime, timedelta

    rows, n = [], 0
    for k, (folder, docs) in enumerate(dumps):
        for d in docs:
            n += 1
            rows.append((n, k, folder, datetime(2024, 1, 1) + timedelta(days=k), d if isinstance(d, str) else json.dumps(d), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, dumps):
    df = drift.field_changes(entries(spark, dumps), "cache_dir", "dump_id", "written_at", "payload")
    return {tuple(r) for r in df.collect()}


def test_added_removed_renamed_retyped(spark):
    one = [{"filepath": f"contracts/A{i}.sol", "n": i, "hash": "ab" * 16, "findings": [{"line": i * 7 + 3, "tags": ["x", f"y{i}"], "severity": "high"}]} for i in range(8)]
    two = [{"path": f"contracts/A{i}.sol", "n": str(i), "extra": True, "findings": [{"line_no": str(i * 5 + 2), "labels": ["x", f"y{i}"], "sev": 3}]} for i in range(8)]
    got = changes(spark, [("d", one), ("d", two)])
    assert got == {
        (1, "renamed", "filepath", "path"), (1, "retyped", "n", "n"), (1, "removed", "hash", "hash"), (1, "added", "extra", "extra"), (1, "renamed", "findings[].line", "findings[].line_no"),
        (1, "retyped", "findings[].line_no", "findings[].line_no"), (1, "renamed", "findings[].tags", "findings[].labels"), (1, "renamed", "findings[].severity", "findings[].sev"),
        (1, "retyped", "findings[].sev", "findings[].sev"),
    }


def test_no_rename_of_unlike_fields_or_flags(spark):
    one = [{"keep": 1, "description": f"words about thing {i}", "is_test": True} for i in range(5)]
    two = [{"keep": 1, "recommendation": f"move part {i} away", "cached": True} for i in range(5)]
    kinds = {(c, f) for _, c, f, _ in changes(spark, [("d", one), ("d", two)])}
    assert kinds == {("removed", "description"), ("added", "recommendation"), ("removed", "is_test"), ("added", "cached")}


def test_renamed_and_retyped_whatever_the_number_of_entries(spark):
    for n in (10, 400):
        one = [{"keep": 1, "duration": f"{i}ms"} for i in range(n)]
        two = [{"keep": 1, "duration_ms": i} for i in range(n)]
        assert changes(spark, [("d", one), ("d", two)]) == {(1, "renamed", "duration", "duration_ms"), (1, "retyped", "duration_ms", "duration_ms")}


def test_shared_values_are_counted_whatever_their_number(spark):
    one = [{"findings": [{"keep": 1, "origin": f"w{k}x"} for k in range(i * 500, i * 500 + 500)]} for i in range(200)]
    for step in (1, 1000, 2000):
        two = [{"findings": [{"keep": 1, "commit": f"w{i * step}x"}]} for i in range(50)]
        assert changes(spark, [("d", one), ("d", two)]) == {(1, "renamed", "findings[].origin", "findings[].commit")}


def test_nulls_unreadable_and_repeated_entries(spark):
    assert changes(spark, [("d", [{"a": 1, "b": None}, "{", "", "[1]"]), ("d", [{"a": 2, "b": None}, {"a": 2, "b": None}]), ("e", [{"z": 1}])]) == set()
    assert changes(spark, [("d", [{"a": 1}]), ("d", ["{"]), ("d", [{"b": "x y"}])]) == {(2, "removed", "a", "a"), (2, "added", "b", "b")}
    empty = entries(spark, [("d", [{"a": 1}])]).limit(0)
    assert drift.field_changes(empty, "cache_dir", "dump_id", "written_at", "payload").count() == 0


def test_one_shared_sentence_or_hash_or_a_common_vocabulary_is_a_rename(spark):
    titles = ["the slow lane wins if both are present", "returns the bond after nine steps", "never trust a lender from the other side", "left over from the first rewrite"]
    one = [{"keep": i, "title": t, "hash": f"ab{i:030x}"} for i, t in enumerate(titles)]
    two = [{"keep": i + 50, "headline": t, "digest": f"ab{i + 900:030x}"} for i, t in enumerate(titles[3:] + ["unlike", "other", "words"])]
    two[1]["digest"] = f"ab{2:030x}"
    assert changes(spark, [("d", one), ("d", two)]) == {(1, "renamed", "title", "headline"), (1, "renamed", "hash", "digest")}
    three = [{"keep": i, "headline": f"the {w} pier wins if both are missing after ten steps from the left"} for i, w in enumerate(["cold", "warm", "wide"])]
    assert changes(spark, [("d", [{"keep": i, "title": t} for i, t in enumerate(titles)]), ("d", three)]) == {(1, "renamed", "title", "headline")}


def test_many_renamed_fields_pair_one_to_one(spark):
    one = [{f"field{k}": f"contracts/F{k}/A{i}.sol" for k in range(120)} for i in range(3)]
    two = [{f"column{k}": f"contracts/F{k}/A{i}.sol" for k in range(120)} for i in range(3)]
    assert changes(spark, [("d", one), ("d", two)]) == {(1, "renamed", f"field{k}", f"column{k}") for k in range(120)}


def test_changes_do_not_depend_on_the_target(spark):
    one = [{"filepath": f"a/{i}.sol", "n": i, "findings": [{"line": i}, None, 3]} for i in range(4)]
    two = [{"path": f"a/{i}.sol", "n": str(i), "findings": [{"line": str(i)}]} for i in range(4)]
    df = entries(spark, [("d", one), ("d", two)])
    run = lambda target: {tuple(r) for r in drift.field_changes(df, "cache_dir", "dump_id", "written_at", "payload", target).collect()}
    want = {(1, "renamed", "filepath", "path"), (1, "retyped", "n", "n"), (1, "retyped", "findings[].line", "findings[].line")}
    assert run(None) == want == run({"findings": "array<variant>"}) == run({"findings": "array<variant>", "n": "string", "path": "string", "filepath": "bigint", "findings[].line": "string"})


def test_rescue_promote_and_replay(spark):
    early = [{"filepath": f"contracts/{x}.sol", "file_hash": "ab" * 15 + f"{i:02d}", "finding_count": "3", "new": [1]} for i, x in enumerate("abc")]
    late = [{"file_path": f"contracts/{x}.sol", "content_hash": "ab" * 15 + f"{i:02d}", "finding_count": "many", "language": "solidity"} for i, x in enumerate("abc")]
    odd = ["{broken", {"filepath": None, "detector_versions": "x=1;y=2", "analyzed_at": 1700000000}]
    df = entries(spark, [("d", early), ("d", late), ("e", odd)])
    raw = drift.rescue_ingest(df, "payload", drift.ENTRY_TARGET)
    assert "source_filepath" in raw.columns and raw.count() == 8
    got = {r.entry_id: r for r in drift.consistent_entries(df).collect()}
    assert got[1].filepath == "contracts/a.sol" and got[1].finding_count == 3 and json.loads(got[1]._rescued) == {"new": [1]}
    assert got[4].filepath == "contracts/a.sol" and got[4].file_hash == got[1].file_hash and got[4].language == "solidity"
    assert got[4].finding_count is None and json.loads(got[4]._rescued) == {"finding_count": "many"}
    assert json.loads(got[7]._rescued) == {"_unreadable": "{broken"}
    assert got[8].detector_versions == {"x": "1", "y": "2"} and got[8].analyzed_at.year == 2023 and got[8]._rescued is None
    promoted = {r.entry_id: r for r in drift.promote(raw, "new", "array<int>").collect()}
    assert promoted[1].new == [1] and promoted[1]._rescued is None and promoted[4].new is None
