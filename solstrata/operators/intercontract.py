"""Calls between the contracts of a project: edges by name, what they reach, cycles, and the findings they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.operators.closure import closure, cycles
from solstrata.operators.detectors import ACCESS_GUARDS, STATE_WRITE, _finding, _title, _whole
from solstrata.operators.structure import Corpus, rx
from solstrata.session import materialize

# Words of functions that give prices; members that are no calls of contracts.
PRICE_WORDS = ("price", "rate", "oracle", "latest", "reserve", "quote", "twap", "getamount")
_MEMBER = r"\b[A-Za-z_][\w\]\[()]*\s*\.\s*([A-Za-z_]\w*)\s*(?:\{[^}]*\})?\s*\("
_PLAIN = r"(?<![.\w])([A-Za-z_]\w*)\s*\("
LOW_LEVEL = ("call", "delegatecall", "staticcall", "send", "transfer")


def nodes(c: Corpus) -> DataFrame:
    """(project, path, contract, function, start_line, visibility, guarded, writes): functions with a body; the project is the part of the path before the second /."""
    f = c.functions.where("has_body and name <> ''").withColumn("project", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))
    return f.select("project", "path", "contract", F.col("name").alias("function"), "start_line", "visibility", rx(_whole(), *ACCESS_GUARDS).alias("guarded"), (rx("code", STATE_WRITE) & ~F.col("mutability").isin("view", "pure")).alias("writes"), "code", "signature")


def call_edges(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Edges (project, caller, callee, external, call) to functions of that name in the project, and calls no name resolves (project, caller, call).

    Functions are Contract.function; other contracts only if the function may be called from outside. Edges by name are may-edges.
    """
    n = nodes(c)
    said = F.array_distinct(F.concat(F.transform(F.regexp_extract_all("code", F.lit(_MEMBER), F.lit(1)), lambda x: F.struct(x.alias("call"), F.lit(True).alias("member"))),
        F.transform(F.regexp_extract_all("code", F.lit(_PLAIN), F.lit(1)), lambda x: F.struct(x.alias("call"), F.lit(False).alias("member")))))
    made = n.select("project", "contract", F.concat_ws(".", "contract", "function").alias("caller"), F.explode(said).alias("x")).select("project", "contract", "caller", "x.call", "x.member").distinct()
    targets = n.select("project", F.col("contract").alias("target"), F.col("function").alias("call"), F.col("visibility").isin("public", "external").alias("open")).distinct()
    edges = made.join(targets, ["project", "call"]).where(F.expr("(not member and contract = target) or (member and open)"))
    edges = edges.select("project", "caller", F.concat_ws(".", "target", "call").alias("callee"), (F.col("contract") != F.col("target")).alias("external"), "call").distinct()
    low = made.where(F.col("member") & F.col("call").isin(*LOW_LEVEL)).select("project", "caller", "call").distinct()
    return edges, low


def findings(c: Corpus, max_depth: int | None = None) -> DataFrame:
    """Cycles between contracts, unprotected calls that write state elsewhere, prices from other contracts, and flows over a boundary."""
    n = materialize(nodes(c).withColumn("f", F.concat_ws(".", "contract", "function")), "x-nodes")
    edges, _ = call_edges(c)
    edges = materialize(edges, "x-edges")
    at = n.groupBy("project", "f").agg(F.min(F.struct("path", "start_line", "contract", "function", "signature", "guarded", "writes", "visibility")).alias("n")).select("project", "f", "n.*").withColumnRenamed("function", "name")
    pairs = materialize(closure(edges, "caller", "callee", ["project"], max_depth), "x-closure")
    looped = cycles(pairs, "caller", "callee", ["project"]).withColumnRenamed("node", "f")
    outer = edges.where("external")
    crossing = looped.select("project", "f", "component").join(outer.select("project", F.col("caller").alias("f")).distinct(), ["project", "f"], "left_semi")
    one = _finding(at.join(crossing, ["project", "f"]), "start_line", "INTERCONTRACT-001", "intercontract", "critical", "high", _title("Cycle of calls between contracts"), F.col("signature"))
    callee = at.where("writes").select("project", F.col("f").alias("callee"))
    called = outer.join(callee, ["project", "callee"], "left_semi").select("project", F.col("caller").alias("f")).distinct()
    two = _finding(at.where("not guarded and visibility in ('public', 'external')").join(called, ["project", "f"]), "start_line", "INTERCONTRACT-002", "intercontract", "high", "medium", _title("Unprotected call that writes elsewhere"), F.col("signature"))
    priced = outer.where(F.lower("call").rlike("|".join(PRICE_WORDS))).select("project", F.col("caller").alias("f")).distinct()
    three = _finding(at.join(priced, ["project", "f"]), "start_line", "INTERCONTRACT-003", "intercontract", "high", "low", _title("Price from another contract"), F.col("signature"))
    entry = at.where("visibility in ('public', 'external')").select("project", F.col("f").alias("caller"))
    _, low = call_edges(c)
    sink = low.select("project", F.col("caller").alias("callee")).distinct()
    crossed = pairs.join(outer.select("project", "caller").distinct(), ["project", "caller"], "left_semi").join(entry, ["project", "caller"], "left_semi").join(sink, ["project", "callee"], "left_semi")
    four = _finding(at.join(crossed.select("project", F.col("caller").alias("f")).distinct(), ["project", "f"]), "start_line", "INTERCONTRACT-004", "intercontract", "medium", "medium", _title("Caller's values reach a call in another contract"), F.col("signature"))
    return one.unionByName(two).unionByName(three).unionByName(four)
