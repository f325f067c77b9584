"""Compiler syntax trees as tables: nodes with context, symbols and their uses, call graphs.

One Arrow-batched pass over the JSON buffers gives every typed object with its parent, role, order and enclosing contract and
function; all else is joins and aggregates on that table.

Defined results: unreadable trees have no nodes; objects without a type are looked through; a node without id still counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.functions.arrow_batches import byte_slices
from solstrata.functions.json_tape import JsonTape, sound_tape
from solstrata.operators.closure import closure, cycles

#: Attributes of nodes that become columns: column, key.
ATTRIBUTES = (
    ("name", "name"), ("member", "memberName"), ("operator", "operator"), ("value", "value"), ("visibility", "visibility"), ("kind", "kind"), ("mutability", "stateMutability"),
    ("state_variable", "stateVariable"), ("contract_kind", "contractKind"),
)
NODE_SCHEMA = (
    "record_id bigint, node int, parent int, role string, ord int, type string, ast_id string, contract string, function string, function_node int, statement int, in_target boolean, "
    + ", ".join(f"{c} string" for c, _ in ATTRIBUTES)
)
# Member calls that leave the contract.
EXTERNAL_MEMBERS = ("call", "send", "transfer", "delegatecall", "staticcall")


def _attribute(tape: JsonTape, key: str) -> np.ndarray:
    out = np.full(len(tape.open_pos), None, dtype=object)
    colons = tape.colons_named(key)
    out[tape.colon_container[colons]] = tape.scalars(colons).to_pylist()
    return out


def _nodes(batch: pa.RecordBatch, tape: JsonTape, type_key: str) -> pa.RecordBatch:
    n = len(tape.open_pos)
    kind = _attribute(tape, type_key)
    typed = np.array([k is not None for k in kind], bool)
    body = tape.body.tobytes()
    start, end = tape.key_start, tape.key_end
    key_of = np.full(n, "", dtype=object)
    named = np.flatnonzero(tape.open_key >= 0)
    key_of[named] = [body[start[k] : end[k]].decode("utf-8", "replace") for k in tape.open_key[named].tolist()]
    cont = tape.container
    lists = np.flatnonzero((cont >= 0) & (tape.open_key < 0))
    key_of[lists] = key_of[cont[lists]]
    name = _attribute(tape, "name")
    up = np.full(n, -1)
    role = key_of.copy()
    contract = np.full(n, "", dtype=object)
    function = np.full(n, "", dtype=object)
    fnode = np.full(n, -1)
    statement = np.full(n, -1)
    target = np.zeros(n, bool)
    # openers are in order of position, so a container always comes before what it holds
    for i in range(n):
        p = cont[i]
        if p < 0:
            continue
        up[i] = p if typed[p] else up[p]
        contract[i], function[i], fnode[i], statement[i], target[i] = contract[p], function[p], fnode[p], statement[p], target[p]
        k = kind[i]
        if k == "ContractDefinition":
            contract[i] = name[i] or ""
        elif k in ("FunctionDefinition", "ModifierDefinition"):
            function[i], fnode[i], statement[i] = name[i] or "", i, -1
        if key_of[i] == "leftHandSide":
            target[i] = True
        elif key_of[i] in ("rightHandSide", "indexExpression", "arguments"):
            target[i] = False
        if key_of[i] == "statements" and tape.open_key[i] < 0 and statement[i] < 0:
            statement[i] = tape.ordinal[i]
    at = np.flatnonzero(typed)
    first = np.searchsorted(tape.open_doc, tape.open_doc[at])
    local = lambda x: np.where(x[at] >= 0, x[at] - first, -1).astype(np.int32)
    text = lambda x: pa.array(x[at], pa.string())
    ordinal = np.where(tape.open_key[at] < 0, tape.ordinal[at], 0).astype(np.int32)
    columns = [batch.column("record_id").take(pa.array(tape.open_doc[at])), pa.array((at - first).astype(np.int32)), pa.array(local(up)), text(role), pa.array(ordinal), text(kind), text(_attribute(tape, "id")),
               text(contract), text(function), pa.array(local(fnode)), pa.array(statement[at].astype(np.int32)), pa.array(target[at])]
    columns += [text(name if key == "name" else _attribute(tape, key)) for _, key in ATTRIBUTES]
    names = ["record_id", "node", "parent", "role", "ord", "type", "ast_id", "contract", "function", "function_node", "statement", "in_target", *[c for c, _ in ATTRIBUTES]]
    return pa.RecordBatch.from_arrays(columns, names)


def ast_nodes(records: DataFrame, type_key: str = "nodeType") -> DataFrame:
    """One row per typed object of records (record_id, text), numbered in pre-order; `type_key` is ast_type for Vyper trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                part, tape = sound_tape(part, "text")
                if tape is not None:
                    yield _nodes(part, tape, type_key)

    return records.select("record_id", "text").mapInArrow(run, NODE_SCHEMA)


def functions(nodes: DataFrame) -> DataFrame:
    """(record_id, contract, function, node, visibility, mutability): functions, constructors, fallback and receive; modifiers as nodes too."""
    rows = nodes.where(F.col("type").isin("FunctionDefinition", "ModifierDefinition"))
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.coalesce("kind", F.lit("fallback")))
    return rows.select("record_id", "contract", name.alias("function"), "node", F.coalesce("visibility", F.lit("public")).alias("visibility"), "mutability", (F.col("type") == "ModifierDefinition").alias("is_modifier"))


def state_symbols(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'VariableDeclaration' and state_variable = 'true'").select("record_id", "contract", F.col("name").alias("symbol"), "visibility").distinct()


def calls(nodes: DataFrame) -> DataFrame:
    """(record_id, contract, function, function_node, node, callee, member, is_external): calls with the name or member they call."""
    heads = nodes.where("role = 'expression'").select("record_id", F.col("parent").alias("node"), F.col("type").alias("head"), F.col("name").alias("callee"), F.col("member").alias("member"))
    rows = nodes.where("type = 'FunctionCall' and function_node >= 0").select("record_id", "contract", "function", "function_node", "node", "statement")
    out = rows.join(heads, ["record_id", "node"], "left")
    return out.select("record_id", "contract", "function", "function_node", "node", "statement", "callee", "member", F.coalesce(F.col("member").isin(*EXTERNAL_MEMBERS), F.lit(False)).alias("is_external"))


def uses(nodes: DataFrame) -> DataFrame:
    """(record_id, contract, function, function_node, node, statement, symbol, access): reads and writes of state variables in functions."""
    idents = nodes.where("type = 'Identifier' and function_node >= 0").select("record_id", "contract", "function", "function_node", "node", "statement", F.col("name").alias("symbol"), F.when(F.col("in_target"), "write").otherwise("read").alias("access"))
    return idents.join(state_symbols(nodes).select("record_id", "contract", "symbol"), ["record_id", "contract", "symbol"], "left_semi")


def after_call(uses_: DataFrame, calls_: DataFrame) -> DataFrame:
    """Writes of state variables that come after a call out of the contract in the same function."""
    first = calls_.where("is_external").groupBy("record_id", "function_node").agg(F.min("node").alias("first_call"))
    return uses_.where("access = 'write'").join(first, ["record_id", "function_node"]).where("node > first_call").select("record_id", "contract", "function", "symbol", "node", "first_call")


def symbol_summary(nodes: DataFrame) -> DataFrame:
    """(record_id, contract, symbol, reads, writes, unused, write_only) of state variables."""
    counted = uses(nodes).groupBy("record_id", "contract", "symbol").agg(F.count_if(F.col("access") == "read").alias("reads"), F.count_if(F.col("access") == "write").alias("writes"))
    out = state_symbols(nodes).select("record_id", "contract", "symbol").distinct().join(counted, ["record_id", "contract", "symbol"], "left").fillna(0, ["reads", "writes"])
    return out.withColumn("unused", F.expr("reads + writes = 0")).withColumn("write_only", F.expr("reads = 0 and writes > 0"))


def call_edges(nodes: DataFrame) -> DataFrame:
    """(record_id, caller, callee, resolved): calls by name to functions of the same contract, else of another contract of the unit.

    Functions are written Contract.function. A name no function of the unit has gives no edge.
    """
    targets = functions(nodes).where("not is_modifier").select("record_id", F.col("contract").alias("target"), F.col("function").alias("called")).distinct()
    named = calls(nodes).withColumn("called", F.coalesce("callee", "member")).where("called is not null")
    options = named.join(targets, ["record_id", "called"]).withColumn("same", F.when(F.col("contract") == F.col("target"), 0).otherwise(1))
    best = options.groupBy("record_id", "contract", "function", "node", "called").agg(F.min(F.struct("same", "target")).alias("m"))
    return best.select("record_id", F.concat_ws(".", "contract", "function").alias("caller"), F.concat_ws(".", "m.target", "called").alias("callee"), (F.col("m.same") == 0).alias("resolved")).distinct()


def reach_summary(nodes: DataFrame) -> DataFrame:
    """(record_id, function, calls_out, writes_state, reaches_call, reaches_write, reachable): own and transitive properties of functions.

    reachable: public or external, or called from such a function.
    """
    from solstrata.session import materialize

    f = functions(nodes).where("not is_modifier").select("record_id", F.concat_ws(".", "contract", "function").alias("f"), "visibility")
    out = calls(nodes).where("is_external").select("record_id", F.concat_ws(".", "contract", "function").alias("f")).distinct().withColumn("calls_out", F.lit(True))
    writes = uses(nodes).where("access = 'write'").select("record_id", F.concat_ws(".", "contract", "function").alias("f")).distinct().withColumn("writes_state", F.lit(True))
    own = f.groupBy("record_id", "f").agg(F.bool_or(F.col("visibility").isin("public", "external")).alias("entry")).join(out, ["record_id", "f"], "left").join(writes, ["record_id", "f"], "left").fillna(False, ["calls_out", "writes_state"])
    own = materialize(own, "functions")
    pairs = materialize(closure(call_edges(nodes), "caller", "callee", ["record_id"]), "call-closure")
    down = pairs.join(own.select("record_id", F.col("f").alias("callee"), "calls_out", "writes_state"), ["record_id", "callee"]).groupBy("record_id", F.col("caller").alias("f")).agg(F.bool_or("calls_out").alias("c"), F.bool_or("writes_state").alias("w"))
    up = pairs.join(own.where("entry").select("record_id", F.col("f").alias("caller")), ["record_id", "caller"], "left_semi").select("record_id", F.col("callee").alias("f")).distinct().withColumn("r", F.lit(True))
    joined = own.join(down, ["record_id", "f"], "left").join(up, ["record_id", "f"], "left").fillna(False, ["c", "w", "r"])
    return joined.select("record_id", F.col("f").alias("function"), "calls_out", "writes_state", F.expr("calls_out or c").alias("reaches_call"), F.expr("writes_state or w").alias("reaches_write"), F.expr("entry or r").alias("reachable"))


def risky_cycles(nodes: DataFrame) -> DataFrame:
    """(record_id, component, size, calls_out, risk): call cycles, and whether any function in them calls out."""
    members = cycles(closure(call_edges(nodes), "caller", "callee", ["record_id"]), "caller", "callee", ["record_id"])
    out = calls(nodes).where("is_external").select("record_id", F.concat_ws(".", "contract", "function").alias("node")).distinct().withColumn("o", F.lit(True))
    found = members.join(out, ["record_id", "node"], "left").groupBy("record_id", "component").agg(F.count("*").alias("size"), F.coalesce(F.bool_or("o"), F.lit(False)).alias("calls_out"))
    return found.withColumn("risk", F.when(F.col("calls_out"), "high").otherwise("low"))
