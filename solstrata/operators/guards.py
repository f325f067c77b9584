"""Checks at the beginning of functions, hand-made mutexes, and the conditions around a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from solstrata.operators.structure import rx

# Kinds of guard in the order in which they decide, and how far a guard may be from the beginning.
GUARD_KINDS = (
    ("access", r"(?:require|if)\s*\([^;]*msg\.sender\s*[!=]=|(?:require|if)\s*\([^;]*[!=]=\s*msg\.sender|_check(Owner|Role)\s*\(|hasRole\s*\("),
    ("reentrancy", r"(?:require|if)\s*\([^;]*_?(locked|entered|mutex|unlocked|status)\b|_nonReentrantBefore\s*\("),
    ("initialized", r"(?:require|if)\s*\([^;]*_?initialized\b"),
    ("paused", r"(?:require|if)\s*\([^;]*_?paused\b"),
    ("condition", r"^\s*(?:require|assert)\s*\(|^\s*if\s*\([^;]*\)\s*\{?\s*revert"),
)
GUARD_LINES = 20


def early_guards(functions: DataFrame) -> DataFrame:
    """(path, contract, function, line, kind, condition): guards in the first lines, before any call out or state write at the outer level."""
    rows = functions.select("path", "contract", F.col("name").alias("function"), "start_line", "body_line", F.posexplode(F.split("code", "\n")).alias("k", "text"))
    rows = rows.where(F.col("k") < GUARD_LINES)
    step = F.length("text") - F.length(F.replace("text", F.lit("{"), F.lit(""))) - F.length("text") + F.length(F.replace("text", F.lit("}"), F.lit("")))
    w = Window.partitionBy("path", "contract", "function", "start_line").orderBy("k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))
    ends = rx("text", r"\.\s*(call|transfer|send)\s*[\({]", r"^\s*\w+\s*(?:\[.*\]\s*)?[-+*/]?=\s*[^=]") & (F.col("depth") == 0)
    rows = rows.withColumn("stopped", F.coalesce(F.max(ends.cast("int")).over(before), F.lit(0)))
    kind = None
    for name, pattern in GUARD_KINDS:
        kind = F.when(rx("text", pattern), name) if kind is None else kind.when(rx("text", pattern), name)
    out = rows.where("stopped = 0").withColumn("kind", kind).where("kind is not null")
    return out.select("path", "contract", "function", (F.col("body_line") + F.col("k")).alias("line"), "kind", F.regexp_extract("text", r"\((.*)\)", 1).alias("condition"))


def custom_mutexes(functions: DataFrame, variables: DataFrame) -> DataFrame:
    """(path, contract, function, variable): a bool state variable that is tested, set and reset, in this order."""
    flags = variables.where("type = 'bool'").select("path", F.col("name").alias("variable"))
    rows = functions.select("path", "contract", F.col("name").alias("function"), "start_line", F.posexplode(F.split("code", ";")).alias("k", "text"))
    on = ["path", "contract", "function", "start_line", "variable"]

    def seen(pattern: str, alias: str, least: bool) -> DataFrame:
        hit = rows.withColumn("variable", F.regexp_extract("text", pattern, 1)).where("variable <> ''").join(flags, ["path", "variable"], "left_semi")
        return hit.groupBy(*on).agg((F.min if least else F.max)("k").alias(alias))

    check = seen(r"(?:require|if)\s*\(\s*!?\s*([A-Za-z_]\w*)\b", "check", True)
    sets = seen(r"(?:^|[{}\s])([A-Za-z_]\w*)\s*=\s*(?:true|false)\b", "first", True)
    resets = seen(r"(?:^|[{}\s])([A-Za-z_]\w*)\s*=\s*(?:true|false)\b", "last", False)
    out = check.join(sets, on).join(resets, on).where("check < first and first < last")
    return out.select("path", "contract", "function", "variable")


def branch_context(functions: DataFrame) -> DataFrame:
    """(path, contract, function, line, conditions): the if-conditions around each line of code, outermost first.

    A fold over the lines of one function keeps the stack of open braces; functions are rows, so nothing is shuffled.
    """
    fold = """aggregate(transform(split(code, '\n'), (x, i) -> named_struct('x', x, 'i', i)),
      named_struct('stack', cast(array() as array<string>), 'out', cast(array() as array<struct<i:int,conditions:array<string>>>)),
      (acc, l) -> named_struct(
        'stack', slice(concat(acc.stack, transform(sequence(1, greatest(length(l.x) - length(replace(l.x, '{', '')), 0), 1), k -> regexp_extract(l.x, '\\\\bif\\\\s*\\\\((.*)\\\\)\\\\s*\\\\{', 1))), 1,
           greatest(size(acc.stack) + length(l.x) - length(replace(l.x, '{', '')) - (length(l.x) - length(replace(l.x, '}', ''))), 0)),
        'out', concat(acc.out, array(named_struct('i', l.i, 'conditions', filter(acc.stack, s -> s <> ''))))),
      acc -> acc.out)"""
    fold = fold.replace("sequence(1, greatest(length(l.x) - length(replace(l.x, '{', '')), 0), 1)", "array_repeat(1, length(l.x) - length(replace(l.x, '{', '')))")
    rows = functions.select("path", "contract", F.col("name").alias("function"), "body_line", F.explode(F.expr(fold)).alias("c"))
    return rows.select("path", "contract", "function", (F.col("body_line") + F.col("c.i")).alias("line"), F.col("c.conditions").alias("conditions"))


def conditional_writes(functions: DataFrame) -> DataFrame:
    """Lines under a condition on the sender that assign something: (path, contract, function, line)."""
    text = functions.select("path", "contract", F.col("name").alias("function"), "body_line", F.posexplode(F.split("code", "\n")).alias("k", "text"))
    writes = text.where(rx("text", r"^\s*\w+(?:\[[^\]]*\])*\s*[-+*/]?=[^=]")).select("path", "contract", "function", (F.col("body_line") + F.col("k")).alias("line"))
    under = branch_context(functions).where(F.exists("conditions", lambda x: x.contains("msg.sender"))).select("path", "contract", "function", "line")
    return writes.join(under, ["path", "contract", "function", "line"], "left_semi")
