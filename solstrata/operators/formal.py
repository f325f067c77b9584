"""Targets for fuzzers and symbolic tools, made from findings. Tools are not run; scripts and targets are made for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.operators.rules import severity_rank

# Detectors whose findings become targets, the property to hold, and values to begin with.
PROPERTIES = {
    "reentrancy": ("balance of the contract never falls below what it owes", ["0", "1", "2**128"]),
    "integer-overflow": ("no result is smaller than an addend", ["0", "1", "2**256-1"]),
    "access-control": ("only the owner changes privileged state", ["0x0", "0xdeadbeef"]),
    "delegatecall": ("the implementation is never an address a caller chose", ["0x0", "0xdeadbeef"]),
    "unchecked-call": ("a failed call reverts", ["0", "1"]),
}


def fuzz_targets(findings: DataFrame, least: str = "high", k: int = 5) -> DataFrame:
    """(rank, path, contract, function, detector, severity, property, seeds): the k most severe findings that have a property; a top-k."""
    known = F.create_map(*[x for d, (p, seeds) in PROPERTIES.items() for x in (F.lit(d), F.struct(F.lit(p).alias("property"), F.array(*map(F.lit, seeds)).alias("seeds")))])
    rows = findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least))).withColumn("p", known[F.col("detector")]).where("p is not null")
    name = F.coalesce(F.nullif("function", F.lit("")), F.regexp_extract("snippet", r"(\w+)\s*\(", 1))
    contract = F.coalesce(F.nullif("contract", F.lit("")), F.regexp_extract("path", r"([^/]+)\.\w+$", 1))
    top = rows.orderBy(severity_rank(F.col("severity")).desc(), "path", "line", "rule_id").limit(k)
    return top.select("path", contract.alias("contract"), name.alias("function"), "detector", "severity", "p.property", "p.seeds")


def test_scripts(targets: DataFrame) -> DataFrame:
    """(name, language, script): a property test in Solidity and a driver in Python for each target."""
    solidity = F.concat(F.lit("// "), "property", F.lit('\nimport "'), "path", F.lit('";\ncontract Test'), "contract", F.lit(" is "), "contract", F.lit(" {\n    function check_"), "function", F.lit("() public view returns (bool) { return true; }\n}\n"))
    python = F.concat(F.lit("# "), "property", F.lit("\nCONTRACT = '"), "contract", F.lit("'\nFUNCTION = '"), "function", F.lit("'\nSEEDS = ['"), F.array_join("seeds", "', '"), F.lit("']\n"))
    both = F.array(F.struct(F.lit("solidity").alias("language"), solidity.alias("script")), F.struct(F.lit("python").alias("language"), python.alias("script")))
    return targets.select(F.concat_ws("_", "contract", "function").alias("name"), F.explode(both).alias("s")).select("name", "s.*")


def tool_results(lines: DataFrame, text: str = "line") -> DataFrame:
    """(name, status, trace) from the JSON lines of a tool; lines that are no JSON are left out. status failed is a violation."""
    parsed = lines.select(F.from_json(text, "name string, status string, trace array<string>").alias("r")).where("r.name is not null")
    return parsed.select("r.*").withColumn("is_violation", F.lower("status").isin("failed", "falsified", "violation"))


def result_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("properties"), F.count_if("is_violation").alias("violations"))
