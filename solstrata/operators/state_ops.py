"""The ordered operations of functions: calls out of the contract, writes and reads of state variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstrata.operators.inheritance import lineage
from solstrata.operators.structure import rx

# Member calls that do not hand over control.
SAFE_CALLS = ("balanceOf", "decimals", "symbol", "name", "totalSupply", "allowance", "ownerOf", "push", "pop", "length", "add", "sub", "mul", "div", "mod", "toString", "encode", "encodePacked", "decode", "contains", "at")
_CALL = r"([A-Za-z_][\w\]\[.()]*)\s*\.\s*(call|send|transfer|delegatecall|transferFrom|safeTransfer|safeTransferFrom|\w+)\s*(?:\{[^}]*\})?\s*\("
_LOW = r"\.\s*(call|send|transfer|delegatecall)\s*[\({]"
_INTERFACE = r"\b(I[A-Z]\w*|IERC\w+)\s*\([^()]*\)\s*\.\s*(\w+)\s*[\({]"
_WRITE = r"(?:^|[;{(]|\bdelete\s)\s*([A-Za-z_]\w*)((?:\s*\[[^\]]*\]|\.\w+)*)\s*(?:[-+*/|&^%]?=(?!=)|\+\+|--)|\bdelete\s+([A-Za-z_]\w*)|(?:\+\+|--)\s*([A-Za-z_]\w*)|\b([A-Za-z_]\w*)\s*\.\s*(?:push|pop)\s*\("


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def known_variables(blocks: DataFrame, variables: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(path, contract, variable): own and inherited state variables, constants left out; `lines` is the lineage of the contracts."""
    on = ["declared_path", "declared_in"]
    own = variables.where("not is_constant").select(F.col("path").alias("declared_path"), F.col("contract").alias("declared_in"), F.col("name").alias("variable"))
    lines = lineage(blocks) if lines is None else lines
    up = lines.select("path", "contract", F.col("ancestor_path").alias("declared_path"), F.col("ancestor").alias("declared_in"))
    selves = own.select(F.col("declared_path").alias("path"), F.col("declared_in").alias("contract"), *on).distinct()
    return up.unionByName(selves).join(own, on).select("path", "contract", "variable").distinct()


def statements(functions: DataFrame) -> DataFrame:
    """(path, contract, function, start_line, k, text, first): the parts of each function between semicolons, with the line each begins on.

    Lines are counted along in one pass over the parts.
    """
    parts = F.split("code", ";", -1)
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("firsts"))
    counted = F.aggregate(parts, begin, lambda acc, x: F.struct((acc["at"] + _breaks(x)).alias("at"), F.concat(acc["firsts"], F.array(acc["at"])).alias("firsts")))["firsts"]
    rows = functions.select("path", "contract", F.col("name").alias("function"), "start_line", "body_line", F.posexplode(F.arrays_zip(parts.alias("text"), counted.alias("before"))).alias("k", "x"))
    return rows.select("path", "contract", "function", "start_line", "k", "x.text", (F.col("body_line") + F.col("x.before")).alias("first"))


def state_ops(functions: DataFrame, blocks: DataFrame, variables: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(path, contract, function, start_line, seq, line, kind, variable, text) with kind call, write or read.

    Statements are the parts between semicolons, in order. In a statement the call comes before the write, as it is evaluated first.
    """
    parts = statements(functions)
    at = ["path", "contract", "function", "start_line"]
    before = F.regexp_extract("text", f"(?s)^(.*?)(?:{_LOW}|{_INTERFACE})", 1)
    upto_name = F.call_function("regexp_extract", "text", F.concat(F.lit(r"(?s)^(.*?)\b"), "variable", F.lit(r"\b")), F.lit(1))
    calls = parts.where(rx("text", _LOW, _INTERFACE)).where(~F.regexp_extract("text", _INTERFACE, 2).isin(*SAFE_CALLS) | rx("text", _LOW))
    calls = calls.select(*at, (F.col("first") + _breaks(before)).alias("line"), (F.col("k") * 3).alias("seq"), F.lit("call").alias("kind"), F.lit(None).cast("string").alias("variable"), F.trim("text").alias("text"))
    names = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(_WRITE), F.lit(g)) for g in (1, 3, 4, 5)]))
    writes = parts.select(*at, "first", (F.col("k") * 3 + 1).alias("seq"), F.explode(F.array_distinct(F.filter(names, lambda x: x != ""))).alias("variable"), F.trim("text").alias("text"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))
    reads = parts.select(*at, "first", (F.col("k") * 3 + 2).alias("seq"), F.explode(words).alias("variable"), F.trim("text").alias("text"))
    known = known_variables(blocks, variables, lines)
    kept = writes.withColumn("kind", F.lit("write")).unionByName(reads.withColumn("kind", F.lit("read"))).join(known, ["path", "contract", "variable"], "left_semi")
    kept = kept.withColumn("line", F.col("first") + _breaks(upto_name))
    return calls.unionByName(kept.select(*calls.columns))


def helper_calls(functions: DataFrame, every: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Operations of kind call for statements that call an own or inherited function which calls out; `every` has all functions."""
    helpers = every.where(rx("code", _LOW, _INTERFACE)).select("path", "contract", F.col("name").alias("called")).distinct()
    if lines is not None:
        up = lines.select(F.col("path").alias("p"), F.col("contract").alias("c"), F.col("ancestor_path").alias("path"), F.col("ancestor").alias("contract"))
        helpers = helpers.unionByName(helpers.join(up, ["path", "contract"]).select(F.col("p").alias("path"), F.col("c").alias("contract"), "called")).distinct()
    parts = statements(functions)
    said = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![.\w])([A-Za-z_]\w*)\s*\("), F.lit(1))))
    rows = parts.withColumn("called", said).where("called <> function").join(helpers, ["path", "contract", "called"], "left_semi")
    before = F.call_function("regexp_extract", "text", F.concat(F.lit(r"(?s)^(.*?)\b"), "called", F.lit(r"\b")), F.lit(1))
    return rows.select("path", "contract", "function", "start_line", (F.col("first") + _breaks(before)).alias("line"), (F.col("k") * 3).alias("seq"), F.lit("call").alias("kind"), F.col("called").alias("variable"), F.trim("text").alias("text"))


def cei_violations(ops: DataFrame) -> DataFrame:
    """(path, contract, function, start_line, call_line, write_line, variable, call_text, distance): a write after a call in one function."""
    on = ["path", "contract", "function", "start_line"]
    first = ops.where("kind = 'call'").groupBy(*on).agg(F.min(F.struct("seq", "line", "text")).alias("c"))
    after = ops.where("kind = 'write'").join(first, on).where(F.col("seq") > F.col("c.seq"))
    return after.select(*on, F.col("c.line").alias("call_line"), F.col("line").alias("write_line"), "variable", F.col("c.text").alias("call_text"), (F.col("line") - F.col("c.line")).alias("distance"))


def operation_summary(ops: DataFrame) -> DataFrame:
    """(path, contract, function, calls, writes, write_before_call, write_after_call, writes_privileged)."""
    on = ["path", "contract", "function", "start_line"]
    per = ops.groupBy(*on).agg(F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "write").alias("writes"), F.min(F.when(F.col("kind") == "call", F.col("seq"))).alias("first_call"),
        F.min(F.when(F.col("kind") == "write", F.col("seq"))).alias("first_write"), F.max(F.when(F.col("kind") == "write", F.col("seq"))).alias("last_write"),
        F.bool_or((F.col("kind") == "write") & rx("variable", r"(?i)owner|admin|governance|token|vault|implementation|oracle")).alias("writes_privileged"))
    return per.select("path", "contract", "function", "start_line", "calls", "writes", F.coalesce(F.col("first_write") < F.col("first_call"), F.lit(False)).alias("write_before_call"),
        F.coalesce(F.col("last_write") > F.col("first_call"), F.lit(False)).alias("write_after_call"), F.coalesce("writes_privileged", F.lit(False)).alias("writes_privileged"))
