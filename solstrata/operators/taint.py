"""Values that callers control, and where they end up, by fixed points over syntax trees and calls.

Labels and sinks are small dimensions. Within a function a value flows from a read to the target of the same assignment, never
backwards; between functions it flows with calls, however deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.operators.astgraph import call_edges, calls, functions
from solstrata.operators.closure import closure
from solstrata.session import materialize

# Labels with priority, sinks with severity.
LABELS = (("msg.sender", 6), ("tx.origin", 5), ("msg.value", 4), ("msg.data", 4), ("parameter", 3), ("block", 2), ("external call", 1), ("derived", 0))
SINKS = {"delegatecall": "critical", "selfdestruct": "critical", "suicide": "critical", "call": "high", "transfer": "high", "send": "high", "staticcall": "medium"}


def sources(nodes: DataFrame) -> DataFrame:
    """(record_id, function_node, symbol, label, since): parameters of functions anyone may call, members of msg, tx and block, and what calls return.

    The label of msg and tx is that of the member read; what a call out of the contract returns is known from its statement on.
    """
    on = ["record_id", "function_node"]
    begin = F.lit(-1).alias("since")
    open_ = functions(nodes).where("visibility in ('public', 'external') and not is_modifier").select("record_id", F.col("node").alias("function_node"))
    params = nodes.where("type = 'VariableDeclaration' and role = 'parameters' and coalesce(state_variable, 'false') <> 'true' and name is not null")
    params = params.join(open_, on, "left_semi").select(*on, F.col("name").alias("symbol"), F.lit("parameter").alias("label"), begin)
    member = nodes.where("type = 'MemberAccess'").select("record_id", F.col("node").alias("parent"), F.col("member").alias("read"))
    read = F.concat_ws(".", "name", "read")
    builtin = F.when(read.isin("msg.sender", "msg.value", "msg.data", "tx.origin"), read).when(F.col("name") == "block", "block")
    direct = nodes.where("type = 'Identifier' and name in ('msg', 'tx', 'block') and function_node >= 0").select(*on, "parent", "name").join(member, ["record_id", "parent"])
    direct = direct.select(*on, F.col("name").alias("symbol"), builtin.alias("label"), begin).where("label is not null")
    out_of = calls(nodes).where(F.col("member").isin("call", "staticcall", "delegatecall")).select(*on, "statement").distinct()
    got = writes(nodes).join(out_of, [*on, "statement"]).select(*on, F.col("target").alias("symbol"), F.lit("external call").alias("label"), F.col("statement").alias("since"))
    return params.unionByName(direct).unionByName(got).groupBy(*on, "symbol", "label").agg(F.min("since").alias("since"))


def writes(nodes: DataFrame) -> DataFrame:
    """(record_id, function_node, statement, target): identifiers an assignment writes, and variables a statement declares."""
    on = ["record_id", "function_node", "statement"]
    said = nodes.where("function_node >= 0 and statement >= 0 and name is not null")
    return said.where("(type = 'Identifier' and in_target) or (type = 'VariableDeclaration' and role = 'declarations')").select(*on, F.col("name").alias("target"))


def assignments(nodes: DataFrame) -> DataFrame:
    """(record_id, function_node, source, target, at): an identifier read in an assignment and the one it writes; at is its place."""
    on = ["record_id", "function_node", "statement"]
    reads = nodes.where("type = 'Identifier' and function_node >= 0 and statement >= 0 and not in_target").select(*on, F.col("name").alias("source"))
    both = reads.join(writes(nodes), on).where("source <> target")
    return both.select("record_id", "function_node", "source", "target", F.col("statement").alias("at")).distinct()


def tainted_symbols(nodes: DataFrame) -> DataFrame:
    """(record_id, function_node, symbol, label, since, chain): symbols a source reaches, with the first statement and the way there.

    A flow uses assignments at or after the one it came from. Rounds go on until nothing new or earlier comes; a symbol that is reached
    again at an earlier statement goes on from there, so each has its earliest statement per label. Statements are finite, so it ends.
    """
    key = ["record_id", "function_node", "symbol", "label"]
    step = materialize(assignments(nodes), "taint-steps")
    front = known = materialize(sources(nodes).select("*", F.array("symbol").alias("chain")), "taint")
    while front.limit(1).count():
        moved = front.withColumnRenamed("symbol", "source").join(step, ["record_id", "function_node", "source"]).where("at >= since")
        moved = moved.groupBy("record_id", "function_node", F.col("target").alias("symbol"), "label").agg(F.min(F.struct(F.col("at").alias("since"), F.concat("chain", F.array("target")).alias("chain"))).alias("m"))
        fresh = moved.select(*key, "m.since", "m.chain").join(known.select(*key, F.col("since").alias("was")), key, "left").where("was is null or since < was").drop("was")
        front = materialize(fresh, "taint")
        every = known.unionByName(front).groupBy(*key).agg(F.min(F.struct("since", "chain")).alias("m"))
        known = materialize(every.select(*key, "m.since", "m.chain"), "taint-known")
    return known


def flows(nodes: DataFrame) -> DataFrame:
    """(record_id, contract, function, symbol, label, sink, severity, chain): tainted symbols used in calls that matter."""
    sinks = calls(nodes).withColumn("sink", F.coalesce("member", "callee")).where(F.col("sink").isin(*SINKS))
    used = nodes.where("type = 'Identifier' and function_node >= 0").select("record_id", "function_node", "statement", F.col("name").alias("symbol"))
    hit = sinks.select("record_id", "contract", "function", "function_node", "statement", "sink").join(used, ["record_id", "function_node", "statement"])
    severity = F.create_map(*[x for k, v in SINKS.items() for x in (F.lit(k), F.lit(v))])
    out = hit.join(tainted_symbols(nodes), ["record_id", "function_node", "symbol"]).where("since <= statement - if(label = 'external call', 1, 0)")
    out = out.groupBy("record_id", "contract", "function", "symbol", "label", "sink").agg(F.min("chain").alias("chain"))
    return out.withColumn("severity", severity[F.col("sink")])


def bounded_flows(nodes: DataFrame) -> DataFrame:
    """flows with confidence: one step lower if the symbol was compared in a require, assert or if before."""
    tests = nodes.where("type = 'Identifier' and function_node >= 0").select("record_id", "contract", "function", F.col("name").alias("symbol"), F.col("parent").alias("node"))
    compared = nodes.where("type = 'BinaryOperation' and operator in ('<', '<=', '>', '>=', '==', '!=')").select("record_id", "node")
    checked = tests.join(compared, ["record_id", "node"], "left_semi").select("record_id", "contract", "function", "symbol").distinct().withColumn("checked", F.lit(True))
    out = flows(nodes).join(checked, ["record_id", "contract", "function", "symbol"], "left")
    return out.withColumn("confidence", F.when(F.col("checked"), "medium").otherwise("high")).drop("checked")


def function_summaries(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(record_id, function, sinks, recursive): sinks a function's parameters reach, its own or through callees (up to max_depth, if given)."""
    own = flows(nodes).where("label = 'parameter'").select("record_id", F.concat_ws(".", "contract", "function").alias("f"), "sink").distinct()
    own = materialize(own, "taint-own")
    pairs = materialize(closure(call_edges(nodes), "caller", "callee", ["record_id"], max_depth), "taint-calls")
    through = pairs.join(own.withColumnRenamed("f", "callee"), ["record_id", "callee"]).select("record_id", F.col("caller").alias("f"), "sink")
    loops = pairs.where("caller = callee").select("record_id", F.col("caller").alias("f")).distinct().withColumn("recursive", F.lit(True))
    out = own.unionByName(through).groupBy("record_id", "f").agg(F.array_sort(F.collect_set("sink")).alias("sinks"))
    return out.join(loops, ["record_id", "f"], "left").select("record_id", F.col("f").alias("function"), "sinks", F.coalesce("recursive", F.lit(False)).alias("recursive"))


def strongest_label(tainted: DataFrame) -> DataFrame:
    """(record_id, function_node, symbol, label): the label of highest priority of each symbol."""
    priority = F.create_map(*[x for k, v in LABELS for x in (F.lit(k), F.lit(v))])
    return tainted.groupBy("record_id", "function_node", "symbol").agg(F.max_by("label", F.struct(priority[F.col("label")], "label")).alias("label"))


def tainted_storage(nodes: DataFrame) -> DataFrame:
    """(record_id, contract, symbol, reads): state variables a tainted value is written to, and how often they are read."""
    from solstrata.operators.astgraph import uses

    used = materialize(uses(nodes), "uses")
    writes = used.where("access = 'write'").join(tainted_symbols(nodes).where("since >= 0").select("record_id", "function_node", "symbol").distinct(), ["record_id", "function_node", "symbol"], "left_semi")
    marked = writes.select("record_id", "contract", "symbol").distinct()
    return marked.join(used.where("access = 'read'").groupBy("record_id", "contract", "symbol").agg(F.count("*").alias("reads")), ["record_id", "contract", "symbol"], "left").fillna(0, ["reads"])
