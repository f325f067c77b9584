"""Source texts as tables: lines, blocks, scopes, state variables, pragma versions, imports.

Relational steps stay JVM-side; one Arrow-batched Python function finds blocks, since matching braces outside comments
and strings is a fold that no window expresses. Rows are independent, so nothing is shuffled.

Defined results: null sources have no lines and no blocks; an unclosed body ends with the text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from solstrata.functions import scanner
from solstrata.functions.arrow_batches import byte_slices


def rx(column: Column | str, *patterns: str) -> Column:
    """Whether any of the patterns occurs; `.` and line ends know only \\n, null counts as no."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.rlike("(?d)" + "|".join(patterns)), F.lit(False))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line): lines from 1, carriage returns kept, a last empty line too."""
    return files.where("source is not null").select("path", F.posexplode(F.split("source", "\n", -1)).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_no"), "line")


def _scan(files: DataFrame, find: Callable[[str, str], list[dict]], fields: str) -> DataFrame:
    schema = "path string, " + fields
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "source", 1 << 20):
                rows = [{"path": p} | row for p, s in zip(part.column("path").to_pylist(), part.column("source").to_pylist()) for row in find(p or "", s)]
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return files.where("source is not null").select("path", "source").mapInArrow(run, schema)


def _find_blocks(path: str, source: str) -> list[dict]:
    return scanner.vyper_blocks(source) if path.lower().endswith(".vy") else scanner.blocks(source)


def blocks(files: DataFrame) -> DataFrame:
    """One row per contract, interface, library, function, constructor, modifier, and unchecked or assembly region."""
    return _scan(files, _find_blocks, scanner.BLOCK_FIELDS)


def state_variables(files: DataFrame) -> DataFrame:
    return _scan(files.where(~F.lower("path").endswith(".vy")), lambda _, s: scanner.state_variables(s), scanner.VAR_FIELDS)


def scopes(blocks_: DataFrame) -> DataFrame:
    """(path, kind, name, start_line, end_line) of contracts, interfaces and libraries."""
    return blocks_.where(F.col("kind").isin("contract", "interface", "library")).select("path", "kind", "name", "start_line", "end_line")


def scope_at_line(points: DataFrame, scopes_: DataFrame) -> DataFrame:
    """Range join: points (path, line_no, ...) with kind and name of the scope around them, null outside any."""
    inside = scopes_.select("path", F.col("kind").alias("scope_kind"), F.col("name").alias("scope_name"), "start_line", "end_line")
    cond = (points["path"] == inside["path"]) & points["line_no"].between(inside["start_line"], inside["end_line"])
    return points.join(inside, cond, "left").drop(inside["path"]).drop("start_line", "end_line")


def enclosing_function(points: DataFrame, blocks_: DataFrame) -> DataFrame:
    """As-of join: points (path, line_no, ...) with the last function that begins at or before them in the file."""
    from pyspark.sql import Window

    heads = blocks_.where("kind = 'function'").select("path", F.col("start_line").alias("line_no"), F.col("name").alias("function_name"))
    extra = [c for c in points.columns if c not in ("path", "line_no")]
    marks = heads.select("path", "line_no", F.lit(0).alias("is_point"), "function_name", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra])
    both = marks.unionByName(points.withColumn("is_point", F.lit(1)).withColumn("function_name", F.lit(None).cast("string")))
    w = Window.partitionBy("path").orderBy("line_no", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("function_name", F.last("function_name", ignorenulls=True).over(w)).where("is_point = 1").drop("is_point")


def versions(files: DataFrame) -> DataFrame:
    """(path, pragma, major, minor, patch, below_08): the compiler version; none counts as 0.8.0, an unreadable one as a risk."""
    pragma = F.regexp_extract("source", r"pragma\s+solidity\s+([^;]+);", 1)
    part = lambda n: F.regexp_extract("pragma", r"(\d+)\.(\d+)\.(\d+)", n).try_cast("int")
    out = files.where("source is not null").select("path", pragma.alias("pragma")).select("path", "pragma", part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))
    below = F.when(F.col("pragma") == "", False).when(F.col("major").isNull(), True).otherwise((F.col("major") == 0) & (F.col("minor") < 8))
    return out.withColumn("below_08", below)


def offset_lines(points: DataFrame, files: DataFrame) -> DataFrame:
    """points (path, offset, ...) with the line and column (from 1) of a 0-based byte offset; beyond the end it is the last line."""
    joined = points.join(files.select("path", F.encode("source", "UTF-8").alias("_bytes")), "path", "left")
    before = F.decode(F.expr("substring(_bytes, 1, greatest(offset, 0))"), "UTF-8")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return joined.withColumn("line", line).withColumn("column", F.octet_length(F.substring_index(before, "\n", -1)) + 1).drop("_bytes")


_IMPORT = r"""(?m)^\s*import\s+(?:[^;"']*\s)?["']([^"']+)["']"""


def imports(files: DataFrame) -> DataFrame:
    """(path, target): what a file imports, as written."""
    return files.select("path", F.explode(F.regexp_extract_all("source", F.lit(_IMPORT), 1)).alias("target"))


def resolve_imports(files: DataFrame, roots: tuple[str, ...] = ("", "node_modules/", "lib/", "packages/")) -> DataFrame:
    """(path, target, resolved): the file an import means: relative to the importer first, then below each root, then below each root of its repository."""
    found = imports(files)
    folder = F.regexp_replace("path", r"[^/]*$", "")
    joined = F.when(F.col("target").startswith("."), F.concat(folder, "target"))
    parts = F.aggregate(
        F.split(F.col("candidate"), "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when((x == ".") | (x == ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    repo = F.regexp_extract("path", r"^([^/]+/[^/]+/)[^/]", 1)
    below = [*[F.lit(r) for r in roots], *[F.when(repo != "", F.concat(repo, F.lit(r))) for r in roots]]
    options = F.array(joined, *[F.when(~F.col("target").startswith("."), F.concat(r, F.col("target"))) for r in below])
    tried = found.select("path", "target", F.posexplode(options).alias("priority", "candidate")).where("candidate is not null")
    tried = tried.withColumn("candidate", F.array_join(parts, "/"))
    known = files.select(F.regexp_replace("path", r"^(\./|/)+", "").alias("candidate"), F.col("path").alias("resolved")).distinct()
    return tried.join(known, "candidate").groupBy("path", "target").agg(F.min_by("resolved", "priority").alias("resolved"))


@dataclass
class Corpus:
    """Files (path, source) and the tables made from them, each built once."""

    files: DataFrame
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df

    @functools.cached_property
    def blocks(self) -> DataFrame:
        return self.keep(blocks(self.files), "blocks")

    @functools.cached_property
    def variables(self) -> DataFrame:
        return self.keep(state_variables(self.files), "state-variables")

    @functools.cached_property
    def functions(self) -> DataFrame:
        return self.blocks.where("kind = 'function'")

    @functools.cached_property
    def callables(self) -> DataFrame:
        return self.blocks.where(F.col("kind").isin("function", "receive", "fallback"))

    @functools.cached_property
    def contracts(self) -> DataFrame:
        return self.blocks.where(F.col("kind").isin("contract", "interface", "library"))

    @functools.cached_property
    def lineage(self) -> DataFrame:
        from solstrata.operators.inheritance import lineage

        return self.keep(lineage(self.blocks, resolve_imports(self.files)), "lineage")

    @functools.cached_property
    def lines(self) -> DataFrame:
        return lines(self.files)
