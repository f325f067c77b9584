import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from solstrata.functions import globs, keccak, scanner
from solstrata.operators import astgraph, bytecode, closure, detectors, findings, formal, guards, inheritance, intercontract, rules, state_ops, statistics, structure, taint
from solstrata.plans.samples import SAMPLES, sample_files
from solstrata.session import materialize
from solstrata.sources import files as src, reports


@pytest.fixture(scope="module")
def corpus(spark):
    return structure.Corpus(sample_files(spark), materialize)


@pytest.fixture(scope="module")
def found(corpus):
    return materialize(detectors.scan(corpus, [*detectors.DETECTORS, *detectors.EXPERIMENTAL]), "found")


def test_each_detector_tells_the_bad_and_not_the_good(corpus, found):
    seen = {(r.detector, r.path) for r in found.collect()} | {(r.detector, r.path) for r in intercontract.findings(corpus).collect()}
    for path in SAMPLES:
        kind, detector, _ = path.split("/")
        detector = "delegatecall" if detector == "upgradeability" else detector
        assert ((detector, path) in seen) == (kind == "bad"), path


def test_severities_and_lines(found):
    got = {(r.path, r.rule_id): (r.severity, r.line) for r in found.collect()}
    assert got["bad/reentrancy/Bank.sol", "REENTRANCY-001"] == ("critical", 10)
    assert got["bad/reentrancy/Helper.sol", "REENTRANCY-002"] == ("high", 10)
    assert got["bad/reentrancy/Till.sol", "REENTRANCY-001"] == ("critical", 9)  # the variable is a base's in another file
    assert got["bad/reentrancy/Branch.sol", "REENTRANCY-002"] == ("high", 8)  # and so is the helper
    assert got["bad/override-removes-restriction/Door.sol", "INIT-005"] == ("critical", 7)
    assert got["bad/unchecked-call/Payer.sol", "CALL-002"] == ("medium", 9)
    assert got["bad/signature-replay/Permit.sol", "DEFI-003"][0] == "critical"


def test_scanner_ignores_braces_in_comments_and_strings():
    text = 'contract A { // {\n string s = "}{"; /* } */\n function f()\n external\n { if (x) { y(); } }\n function g() external;\n}\ncontract B {}'
    got = {(b["kind"], b["name"]): (b["start_line"], b["end_line"], b["has_body"]) for b in scanner.blocks(text)}
    assert got[("contract", "A")] == (1, 7, True) and got[("function", "f")] == (3, 5, True) and got[("function", "g")][2] is False and got[("contract", "B")] == (8, 8, True)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='{}()";/*\n abcontrfuis', max_size=120))
def test_scanner_takes_any_text(text):
    scanner.blocks(text)
    scanner.state_variables(text)
    assert len(scanner.blank(text)) == len(text)


def test_sources_with_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([("a.sol", None, "k"), ("b.sol", "", "k"), ("c.sol", "contract C { function f() external { tx.origin == x; } }", "k")], "path string, source string, name string")
    c = structure.Corpus(df, materialize)
    assert c.lines.count() == 2 and [r.name for r in c.functions.collect()] == ["f"]
    assert detectors.scan(c).count() >= 0 and detectors.scan(structure.Corpus(df.limit(0), materialize)).count() == 0
    with pytest.raises(ValueError):
        detectors.scan(c, ["nothing"])


@pytest.mark.parametrize("signature,hexes", [("transfer(address,uint256)", "a9059cbb"), ("approve(address,uint256)", "095ea7b3"), ("balanceOf(address)", "70a08231")])
def test_known_selectors(signature, hexes):
    assert keccak.selector(signature).hex() == hexes
    assert keccak.canonical_signature("f", ["uint", "IThing[]", "bytes32"]) == "f(uint256,address[],bytes32)"


@pytest.mark.parametrize("glob,path,hit", [("test/**", "test/a/b.sol", True), ("test/**", "tests/a.sol", False), ("**/*V2.sol", "x/y/AV2.sol", True), ("**/*V2.sol", "AV2.sol", True), ("*.sol", "a/b.sol", False), ("a?.sol", "ab.sol", True), ("[ab].sol", "a.sol", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(globs.glob_regex(glob), path)) == hit


def test_closure_and_cycles_match_brute_force(spark):
    rnd = random.Random(2)
    edges = {(rnd.randrange(9), rnd.randrange(9)) for _ in range(13)}
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a int, b int")
    reach = set(edges)
    while True:
        more = {(x, w) for x, y in reach for z, w in edges if y == z} - reach
        if not more:
            break
        reach |= more
    pairs = materialize(closure.closure(df, "a", "b"), "t")
    assert {(r.a, r.b) for r in pairs.collect()} == reach
    want = {x for x, y in reach if x != y and (y, x) in reach}
    assert {r.node for r in closure.cycles(pairs, "a", "b").collect()} == want
    paths = closure.simple_paths(df, "a", "b", max_depth=8).collect()
    assert all(len(set(r.path)) == len(r.path) for r in paths) and {(r.a, r.b) for r in paths} == {(x, y) for x, y in reach if x != y}
    assert closure.closure(df.limit(0), "a", "b").count() == 0


def test_inheritance(corpus):
    links = inheritance.override_links(corpus.blocks)
    lost = {r.path for r in inheritance.regressions(links).collect()}
    assert lost == {"bad/override-removes-restriction/Child.sol"}
    across = inheritance.regressions(inheritance.override_links(corpus.blocks, corpus.lineage))
    assert {r.path for r in across.collect()} == {f"bad/override-removes-restriction/{x}.sol" for x in ("Child", "Door")}
    eff = {(r.contract, r.function): r.declared_in for r in inheritance.effective_functions(corpus.blocks).where("path like 'good/override%'").collect()}
    assert eff["Child", "set"] == "Child" and eff["Parent", "set"] == "Parent"
    kinds = {r.modifier: r.kind for r in inheritance.function_guards(corpus.blocks).collect()}
    assert kinds["onlyOwner"] == "access control" and kinds["nonReentrant"] == "reentrancy guard" and kinds["initializer"] == "initializer"
    signed = inheritance.signatures(corpus.blocks)
    assert inheritance.selector_collisions(signed.where("path not like 'lib/%'")).count() == 0
    assert [r.selector for r in inheritance.selector_collisions(signed).collect()] == ["42966c68"]


def test_operations_and_guards(spark):
    text = """contract M {
    bool locked; uint256 a; address owner;
    function f() external {
        require(msg.sender == owner, "x");
        require(!locked); locked = true;
        if (msg.sender == owner) {
            a = 1;
        }
        x.call{value: 1}("");
        locked = false;
    }
}"""
    c = structure.Corpus(spark.createDataFrame([("m.sol", text)], "path string, source string"), materialize)
    assert {r.kind for r in guards.early_guards(c.functions).collect()} >= {"access", "reentrancy"}
    assert [r.variable for r in guards.custom_mutexes(c.functions, c.variables).collect()] == ["locked"]
    assert [r.line for r in guards.conditional_writes(c.functions).collect()] == [7]
    ops = state_ops.state_ops(c.functions, c.blocks, c.variables)
    bad = state_ops.cei_violations(ops).collect()
    assert [(r.variable, r.call_line, r.write_line) for r in bad] == [("locked", 9, 10)]
    one = state_ops.operation_summary(ops).first()
    assert one.write_before_call and one.write_after_call and one.calls == 1


def _unit():
    call = lambda head, *args: {"nodeType": "FunctionCall", "id": 1, "expression": head, "arguments": list(args)}
    ident = lambda n: {"nodeType": "Identifier", "id": 2, "name": n}
    member = lambda m, e: {"nodeType": "MemberAccess", "id": 3, "memberName": m, "expression": e}
    assign = lambda a, b: {"nodeType": "ExpressionStatement", "expression": {"nodeType": "Assignment", "operator": "=", "leftHandSide": a, "rightHandSide": b}}
    stmt = lambda e: {"nodeType": "ExpressionStatement", "expression": e}
    fn = lambda name, vis, params, body: {"nodeType": "FunctionDefinition", "name": name, "visibility": vis, "kind": "function", "parameters": {"nodeType": "ParameterList", "parameters": [
        {"nodeType": "VariableDeclaration", "name": p, "stateVariable": False} for p in params]}, "body": {"nodeType": "Block", "statements": body}}
    return {"nodeType": "SourceUnit", "nodes": [{"nodeType": "ContractDefinition", "name": "C", "nodes": [
        {"nodeType": "VariableDeclaration", "name": "total", "stateVariable": True, "visibility": "public"}, {"nodeType": "VariableDeclaration", "name": "idle", "stateVariable": True},
        fn("go", "external", ["to"], [assign(ident("mid"), ident("to")), stmt(call(ident("inner"), ident("mid"))), stmt(call(member("call", ident("mid")))), assign(ident("total"), ident("mid"))]),
        fn("inner", "internal", ["x"], [stmt(call(ident("go"), ident("x")))]), None]}]}


def _tree(params, body):
    return {"nodeType": "SourceUnit", "nodes": [{"nodeType": "ContractDefinition", "name": "T", "nodes": [{"nodeType": "FunctionDefinition", "name": "f", "visibility": "public", "kind": "function",
        "parameters": {"nodeType": "ParameterList", "parameters": [{"nodeType": "VariableDeclaration", "name": p, "stateVariable": False} for p in params]}, "body": {"nodeType": "Block", "statements": body}}]}]}


def _set(target, source):
    one, two = ({"nodeType": "Identifier", "name": n} for n in (target, source))
    return {"nodeType": "ExpressionStatement", "expression": {"nodeType": "Assignment", "operator": "=", "leftHandSide": one, "rightHandSide": two}}


def test_trees_calls_and_taint(spark):
    df = spark.createDataFrame([(1, json.dumps(_unit())), (2, "{"), (3, None)], "record_id bigint, text string").where("text is not null")
    n = materialize(astgraph.ast_nodes(df), "n")
    assert {(r.caller, r.callee) for r in astgraph.call_edges(n).collect()} == {("C.go", "C.inner"), ("C.inner", "C.go")}
    assert {(r.symbol, r.access) for r in astgraph.uses(n).collect()} == {("total", "write")}
    assert [r.symbol for r in astgraph.after_call(astgraph.uses(n), astgraph.calls(n)).collect()] == ["total"]
    assert {r.symbol: (r.unused, r.write_only) for r in astgraph.symbol_summary(n).collect()} == {"total": (False, True), "idle": (True, False)}
    reach = {r.function: r for r in astgraph.reach_summary(n).collect()}
    assert reach["C.inner"].reaches_call and reach["C.inner"].reachable and not reach["C.inner"].calls_out
    assert [(r.size, r.risk) for r in astgraph.risky_cycles(n).collect()] == [(2, "high")]
    flow = taint.flows(n).collect()
    assert {(r.symbol, r.sink, tuple(r.chain)) for r in flow} == {("mid", "call", ("to", "mid"))}
    assert {r.symbol for r in taint.tainted_storage(n).collect()} == {"total"}
    assert {r.function: r.sinks for r in taint.function_summaries(n).collect()} == {"C.go": ["call"], "C.inner": ["call"]}


def test_taint_goes_on_until_nothing_is_new(spark):
    chain = [_set(f"v{i + 1}", f"v{i}") for i in range(30)]
    late = [_set("x", "b"), _set("y", "x")]
    body = [_set("b", "p"), *late, *chain]
    df = spark.createDataFrame([(1, json.dumps(_tree(["p", "v0"], body))), (2, json.dumps(_tree(["a"], [_set("b", "a"), _set("x", "b"), _set("y", "x"), _set("q", "z"), _set("z", "y"), _set("x", "a")])))], "record_id bigint, text string")
    n = materialize(astgraph.ast_nodes(df), "n")
    got = {(r.record_id, r.symbol): r.since for r in taint.tainted_symbols(n).collect()}
    assert got[1, "v30"] == 32 and got[1, "y"] == 2
    assert got[2, "x"] == 1 and got[2, "y"] == 2 and (2, "q") not in got


def test_lineage_reaches_across_files(spark):
    rows = [("o/r/a.sol", 'import "./b.sol";\ncontract A is B { }'), ("o/r/b.sol", 'import "lib/c.sol";\ncontract B is C { modifier m() { require(msg.sender == boss); _; } }'), ("o/r/lib/c.sol", "contract C { uint x; function f() public { } }"),
            ("o/s/b.sol", "contract B { function other() public { } }"), ("o/r/d.sol", "contract D is A, Gone { function g() public m { } }")]
    c = structure.Corpus(spark.createDataFrame(rows, "path string, source string"), materialize)
    got = {(r.path, r.contract, r.ancestor_path, r.ancestor, r.depth) for r in c.lineage.collect()}
    a, b, cc, dd = "o/r/a.sol", "o/r/b.sol", "o/r/lib/c.sol", "o/r/d.sol"
    assert got == {(a, "A", b, "B", 1), (a, "A", cc, "C", 2), (b, "B", cc, "C", 1), (dd, "D", a, "A", 1), (dd, "D", b, "B", 2), (dd, "D", cc, "C", 3), (dd, "D", "", "Gone", 1)}
    assert {(r.contract, r.function, r.declared_in) for r in inheritance.effective_functions(c.blocks, c.lineage).where("contract = 'D'").collect()} == {("D", "g", "D"), ("D", "f", "C")}
    assert [(r.modifier, r.kind) for r in inheritance.function_guards(c.blocks, c.lineage).collect()] == [("m", "access control")]
    assert {r.variable for r in state_ops.known_variables(c.blocks, c.variables, c.lineage).where("contract = 'D'").collect()} == {"x"}


def test_bytecode(spark):
    meta = "a2646970667358221220" + "ab" * 32 + "64736f6c6343000811" + "0033"
    rows = [(1, "0x6001" + meta, "6001" + meta.replace("ab", "cd")), (2, "63a9059cbb14ff", "63a9059cbb14ff"), (3, None, "00"), (4, "00", None), (5, "60ff32", "6000f4"), (6, "zz", "")]
    df = spark.createDataFrame(rows, "id int, deployed string, local string")
    assert {r.id: r.match for r in bytecode.compare(df).collect()} == {1: "partial", 2: "exact", 3: "unverified", 4: "no_source", 5: "mismatch", 6: "no_source"}
    assert [(r.offset, r.deployed, r.local) for r in bytecode.differences(df.where("id = 5"), "id").collect()] == [(1, "ff32", "00f4")]
    ins = materialize(bytecode.disassemble(df, "id", "deployed"), "ins")
    assert {(r.id, r.name) for r in bytecode.noted_opcodes(ins.where("id in (2, 5)"), "id").collect()} == {(2, "SELFDESTRUCT"), (5, "ORIGIN")}
    assert {(r.id, r.name) for r in bytecode.byte_patterns(df.where("id in (2, 5)"), "id", "deployed").collect()} == {(2, "SELFDESTRUCT"), (5, "SELFDESTRUCT"), (5, "ORIGIN")}
    assert [(r.id, r.selector) for r in bytecode.function_selectors(ins, "id").collect()] == [(2, "a9059cbb")]
    p = spark.createDataFrame([("", bytecode.MINIMAL_PROXY + "11" * 20)], "source string, code string")
    assert bytecode.proxies(p).first().implementation == "0x" + "11" * 20


def test_after_detection(spark, found):
    f = findings.fingerprints(found)
    moved = findings.fingerprints(found.withColumn("line", F.col("line") + 5).withColumn("path", F.concat(F.lit("./"), "path")))
    assert f.join(moved, "fingerprint_id", "left_anti").count() == 0
    base = materialize(findings.create_baseline(f), "base")
    new, old, gone = findings.baseline_diff(f, base)
    assert new.count() == 0 and old.count() == f.count() and gone.count() == 0
    assert findings.merge_baseline(base, base).count() == base.count()
    o = spark.createDataFrame([("reentrancy", "low", None), ("AUTH-001", None, "low")], "name string, severity string, confidence string")
    changed = {(r.rule_id, r.severity, r.confidence) for r in findings.apply_overrides(found, o).where("detector in ('reentrancy', 'tx-origin')").collect()}
    assert changed == {("REENTRANCY-001", "low", "high"), ("REENTRANCY-002", "low", "medium"), ("AUTH-001", "high", "low")}
    assert findings.at_least(found, "critical").where("severity <> 'critical'").count() == 0
    assert findings.exclude_paths(found, ["bad/**"]).where("path like 'bad/%'").count() == 0
    assert findings.suppress_configured(found, [findings.Ignore(expires="2020-01-01"), findings.Ignore(expires="never")], "2024-01-01").count() == found.count()
    assert findings.suppress_configured(found, [findings.Ignore()], "2024-01-01").count() == 0


def test_inline_suppression(spark):
    text = "// audit-disable-next-line AUTH-001, X-1\na\n/* audit-disable */\nb\n// audit-enable\nc\n# audit-disable all"
    files = spark.createDataFrame([("p", text), ("q", None)], "path string, source string")
    got = {(r.rule_id, r.start, r.end) for r in findings.suppress_intervals(files).collect()}
    assert got == {("AUTH-001", 2, 2), ("X-1", 2, 2), ("*", 3, 5), ("*", 7, 2147483647)}
    rows = [("p", n, r) for n in range(1, 9) for r in ("AUTH-001", "Z-9")]
    df = spark.createDataFrame(rows, "path string, line int, rule_id string")
    left = {(r.line, r.rule_id) for r in findings.suppress_inline(df, findings.suppress_intervals(files)).collect()}
    assert left == {(1, "AUTH-001"), (1, "Z-9"), (2, "Z-9"), (6, "AUTH-001"), (6, "Z-9")}


def test_reports(spark, found):
    for kind in reports.REPORTS:
        out = io.StringIO()
        reports.report(kind, found, out, 3, [("x.sol", "unreadable")])
        if kind == "json":
            doc = json.loads(out.getvalue())
            assert doc["summary"]["findings"] == found.count() == len(doc["findings"]) and doc["errors"]
        if kind == "sarif":
            doc = json.loads(out.getvalue())
            assert len(doc["runs"][0]["results"]) == found.count()
        assert out.getvalue()
        empty = io.StringIO()
        reports.report(kind, found.limit(0), empty, 0)
    with pytest.raises(ValueError):
        reports.report("pdf", found, io.StringIO(), 0)
    counts = {(r.dimension, r.value): r.findings for r in statistics.finding_counts(found).collect()}
    assert counts["total", ""] == found.count()
    errors = spark.createDataFrame([], "path string")
    assert findings.exit_code(found, errors, "high").first().exit_code == 1 and findings.exit_code(found.limit(0), errors, "high").first().exit_code == 0
    assert formal.fuzz_targets(found, k=3).count() == 3 and formal.test_scripts(formal.fuzz_targets(found, k=3)).count() == 6


def test_statistics(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0)], "detector string, seconds double")
    t = {r.detector: r for r in statistics.timing(runs).collect()}
    assert t["a"].mean == 2.0 and t["a"].stddev == 1.0 and t["a"].share == 0.5
    slow = statistics.slowdowns(statistics.timing(runs), statistics.timing(runs.withColumn("seconds", F.col("seconds") / 2)))
    assert {r.detector for r in slow.collect()} == {"a", "b"}
    acc = statistics.accuracy(spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "detector string, k0 int"), spark.createDataFrame([("d", 1), ("d", 3)], "detector string, k0 int"), ["k0"]).first()
    assert (acc.true_positives, acc.false_positives, acc.false_negatives) == (1, 2, 1)
    assert rules.search(rules.catalogue(spark), "auth", ["high"]).count() == 1 and rules.catalogue(spark).count() == 44


def test_files_config_and_baselines(spark, tmp_path):
    for name in ("a.sol", "test/b.sol", "lib/c.sol", "x y+z.sol", "d.t.sol", "n.txt"):
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("contract A {\n}\n")
    got = {r.path for r in src.read_sources(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.sol", "x y+z.sol"}
    assert src.read_sources(spark, str(tmp_path / "src"), defaults=False).count() == 5
    text = "version: 1\nscan:\n  severity: low # kept\nexclude:\n  - 'a/**'\nrules:\n  AUTH-001:\n    severity: critical\nignore:\n  - rule: X\n    path: b/*\ndetectors:\n  disable: [flash-loan, shadowing]\n"
    c = src.load_config(text)
    assert c.severity == "low" and c.exclude == ["a/**"] and c.overrides == {"AUTH-001": {"severity": "critical"}} and c.ignore == [{"rule": "X", "path": "b/*"}] and c.disabled == ["flash-loan", "shadowing"]
    for bad in ("nope: 1", "scan:\n  severity: huge", "a: 1\na: 2", "scan:\n\tx: 1"):
        with pytest.raises(ValueError):
            src.load_config(bad)
    rows = spark.createDataFrame([("f1", "R", "low", "p", "t", None, None)], "fingerprint_id string, rule_id string, severity string, file_path string, title string, suppressed_at timestamp, note string")
    src.write_baseline(rows, str(tmp_path / "base"), "/p", "1")
    assert [r.fingerprint_id for r in src.read_baseline(spark, str(tmp_path / "base")).collect()] == ["f1"]


def test_multi_file_sources(spark):
    doc = json.dumps({"language": "Solidity", "sources": {"a.sol": {"content": "A"}, "b.sol": {"content": "B"}}})
    rows = [(1, "{" + doc + "}", "N"), (2, doc, "N"), (3, "contract C {}", "N"), (4, None, None), (5, "{not json", None)]
    got = src.verified_files(spark.createDataFrame(rows, "address int, sourcecode string, contractname string")).collect()
    assert sorted((r.address, r.path, r.source) for r in got) == [(1, "a.sol", "A"), (1, "b.sol", "B"), (2, "a.sol", "A"), (2, "b.sol", "B"), (3, "N.sol", "contract C {}"), (5, "main.sol", "{not json")]


def test_stream(spark, tmp_path):
    from solstrata.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.sol").write_text(SAMPLES["bad/tx-origin/Wallet.sol"])
    for _ in range(2):  # the second run finds nothing new
        q = incremental.scan_stream(incremental.stream_sources(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["tx-origin"])
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_vyper_functions(spark):
    text = "@external\ndef f(to: address):\n    send(to, 1)\n    self.x = 1\n\n@external\n@nonreentrant('lock')\ndef g(to: address):\n    send(to, 1)\n    self.x = 1\n\n@external\ndef h(to: address):\n    self.x = 1\n    send(to, 1)\n"
    c = structure.Corpus(spark.createDataFrame([("a.vy", text)], "path string, source string"), materialize)
    assert [(r.name, r.visibility, r.start_line, r.end_line) for r in c.functions.orderBy("start_line").collect()] == [("f", "external", 2, 4), ("g", "external", 8, 10), ("h", "external", 13, 15)]
    assert [(r.function, r.line) for r in detectors.scan(c, ["vyper-reentrancy"]).collect()] == [("f", 3)]


def test_offsets_scopes_and_as_of(spark):
    text = "é\ncontract A {\n function f() external {\n }\n}\n"
    files = spark.createDataFrame([("a.sol", text)], "path string, source string")
    c = structure.Corpus(files, materialize)
    points = spark.createDataFrame([("a.sol", 0), ("a.sol", 3), ("a.sol", 99), ("b.sol", 1)], "path string, offset int")
    assert [(r.path, r.offset, r.line, r.column) for r in structure.offset_lines(points, files).orderBy("path", "offset").collect()] == [("a.sol", 0, 1, 1), ("a.sol", 3, 2, 1), ("a.sol", 99, 6, 1), ("b.sol", 1, None, None)]
    at = spark.createDataFrame([("a.sol", 1), ("a.sol", 4), ("b.sol", 1)], "path string, line_no int")
    assert {(r.path, r.line_no): r.scope_name for r in structure.scope_at_line(at, structure.scopes(c.blocks)).collect()} == {("a.sol", 1): None, ("a.sol", 4): "A", ("b.sol", 1): None}
    assert {(r.path, r.line_no): r.function_name for r in structure.enclosing_function(at, c.blocks).collect()} == {("a.sol", 1): None, ("a.sol", 4): "f", ("b.sol", 1): None}
    both = spark.createDataFrame([("x/a.sol", 'import "./b.sol";\nimport {T} from "lib1/t.sol";'), ("x/b.sol", ""), ("node_modules/lib1/t.sol", "")], "path string, source string")
    assert {(r.target, r.resolved) for r in structure.resolve_imports(both).collect()} == {("./b.sol", "x/b.sol"), ("lib1/t.sol", "node_modules/lib1/t.sol")}


def test_explorer_source(spark, tmp_path):
    from solstrata.sources import explorer

    a, b, c = ("0x" + x * 40 for x in "abc")
    (tmp_path / f"{a}.json").write_text(json.dumps({"status": "1", "result": [{"SourceCode": "contract A {}", "ContractName": "A"}]}))
    (tmp_path / f"{b}.json").write_text(json.dumps({"status": "1", "result": [{"SourceCode": ""}]}))
    spark.dataSource.register(explorer.ExplorerSource)
    df = spark.read.format("explorer").option("path", str(tmp_path)).option("addresses", f"{a},{b.upper().replace('0X', '0x')},{c}").option("partitions", "2").option("rate", "1000").load()
    assert {r.address: (r.is_verified, r.error) for r in df.collect()} == {a: (True, None), b: (False, None), c: (False, "FileNotFoundError")}
    with pytest.raises(ValueError):
        explorer.check_address("0x12")
    slept, now = [], [0.0]
    bucket = explorer.TokenBucket(2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        bucket.take()
    assert slept == [0.5, 0.5]


def test_command_line(spark, tmp_path, capsys):
    from solstrata import cli

    for name in ("bad/tx-origin/Wallet.sol", "bad/reentrancy/Bank.sol"):
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(SAMPLES[name])
    root, base = str(tmp_path / "src"), str(tmp_path / "base")
    assert cli.main(["scan", root, "--format", "json"]) == 1
    doc = json.loads(capsys.readouterr().out)
    assert doc["summary"]["files"] == 2 and {f["rule_id"] for f in doc["findings"]} == {"AUTH-001", "REENTRANCY-001"}
    assert cli.main(["scan", root, "--detectors", "tx-origin", "--fail-on", "critical"]) == 0
    assert cli.main(["baseline", "create", root, "--file", base]) == 0
    assert cli.main(["scan", root, "--baseline", base]) == 0
    assert cli.main(["explain", "reentrancy"]) == 0 and cli.main(["explain", "nothing"]) == 2
    assert cli.main(["rules", "list", "--severity", "low"]) == 0 and "INIT-003" in capsys.readouterr().out
