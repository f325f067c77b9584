import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from solstrata.functions.json_tape import JsonTape, sound_rows, sound_tape
from solstrata.operators import nested

LOG = "delivery_id bigint, log_id bigint, received_at timestamp, payload string, record_id string, text string"
UNIT = "delivery_id bigint, unit_id bigint, compiled_at timestamp, ast_json string, child string"

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-9999, 9999) | st.text(max_size=6),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["runs", "results", "locations", "a\"b", "id", "nodeType", "x"]), x, max_size=4),
    max_leaves=25,
)


def expected_edges(record_id, doc):
    out = set()

    def level(holder, parent, names):
        if not names or not isinstance(holder, dict) or not isinstance(holder.get(names[0]), list):
            return
        for i, x in enumerate(holder[names[0]]):
            child = (parent + "." if parent else "") + f"{names[0]}[{i}]"
            out.add((record_id, child, parent))
            yield x, child

    for run, a in level(doc, "", ["runs"]):
        for result, b in level(run, a, ["results"]):
            list(level(result, b, ["locations"]))
            for flow, c in level(result, b, ["codeFlows"]):
                for thread, d in level(flow, c, ["threadFlows"]):
                    list(level(thread, d, ["locations"]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["runs", "x"]), JSON, max_size=2), min_size=1, max_size=4), st.sampled_from([None, 1]))
def test_tape_finds_the_lists_that_a_parser_finds(docs, indent):
    texts = pa.array([json.dumps(d, indent=indent) for d in docs])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), texts], ["record_id", "text"])
    batch, tape = sound_tape(batch, "text")
    assert tape is not None and batch.num_rows == len(docs)
    got = set()
    for b in nested._flatten_paths(batch, tape, nested.LOG_PATHS):
        got |= {tuple(r.values()) for r in b.to_pylist()}
    want = set().union(*(expected_edges(i, d) for i, d in enumerate(docs)))
    assert got == want


def test_unsound_texts_leave_the_others_alone():
    texts = pa.array(['{"runs": [1', '{"runs": []}', '{"a": "x\ny"}', "{'a': 1}", '{"runs": [{}]} x', '{"a": "]"}'])
    assert sound_rows(texts).tolist() == [False, True, False, False, True, True]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), texts], ["record_id", "text"])
    left, tape = sound_tape(batch, "text")
    assert left.column("record_id").to_pylist() == [1, 5]
    assert isinstance(tape, JsonTape)


def test_edges_of_logs_and_units(spark):
    good = '{"runs": [{"results": [{"locations": [null, {}], "codeFlows": null}, {"codeFlows": [{"threadFlows": [{"locations": null}]}]}]}, {"results": null}], "extra": {"runs": [1]}}'
    rows = [
        (1, 7, None, good, "x", "y"), (2, 7, None, good, "x", "y"), (3, 8, None, None, None, None), (4, 9, None, "", None, None), (5, 10, None, good[:40], None, None),
        (6, 11, None, "[]", None, None), (7, None, None, '{"runs": [{}]}', None, None), (8, None, None, '{"runs": [{}]}', None, None),
    ]
    logs = spark.createDataFrame(rows, LOG)
    ast = '{"nodeType": "SourceUnit", "id": 1, "nodes": [{"nodeType": "A", "id": 2, "body": {"list": [null, {"nodeType": "B", "id": "3"}, {"nodeType": "C"}]}}, {"id": 9}, {"nodeType": "D", "id": null}]}'
    units = spark.createDataFrame([(1, 5, None, ast, "c"), (2, 5, None, ast, "c"), (3, 6, None, "{", None)], UNIT)
    got = sorted(tuple(r) for r in nested.record_edges(logs, units).where("record_id is not null").collect())
    r = "runs[0].results"
    assert got == sorted(
        [("sarif", 7, "runs[0]", ""), ("sarif", 7, "runs[1]", ""), ("sarif", 7, r + "[0]", "runs[0]"), ("sarif", 7, r + "[1]", "runs[0]"), ("sarif", 7, r + "[0].locations[0]", r + "[0]"),
         ("sarif", 7, r + "[0].locations[1]", r + "[0]"), ("sarif", 7, r + "[1].codeFlows[0]", r + "[1]"), ("sarif", 7, r + "[1].codeFlows[0].threadFlows[0]", r + "[1].codeFlows[0]"),
         ("ast", 5, "2", "1"), ("ast", 5, "3", "2")]
    )
    assert nested.record_edges(logs, units).where("record_id is null").count() == 2
    assert nested.record_edges(logs.limit(0), units.limit(0)).count() == 0


def test_related_tables_keep_parents(spark):
    logs = spark.createDataFrame([(1, '{"runs": [{"results": [{"ruleId": "R", "message": {"text": "é\\"q"}}, null]}]}')], "record_id bigint, text string")
    rows = nested.related_table(logs, ("runs", "results")).orderBy("row_key").collect()
    assert [(r.row_key, r.parent_key, r.rule_id, r.message) for r in rows] == [("runs[0].results[0]", "runs[0]", "R", 'é"q'), ("runs[0].results[1]", "runs[0]", None, None)]
