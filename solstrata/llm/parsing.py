"""Source files that do not parse, per file and as rates per repository and language.

The language of a file is that of its extension. Each file's tokens are run through the memoised derivatives of its
language's grammar; the memo is shared by all files a Python worker sees. Nothing is shuffled to flag files; the rates
are one partial aggregation.

Defined results: files of other extensions, without path or without content are 'unknown' and never flagged; an
empty file is valid except as JSON, where a value is missing; a file too long to be usual is read whole like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstrata.functions.arrow_batches import byte_slices

# Languages by extension.
_LANGUAGE_OF = {"sol": "Solidity", "vy": "Vyper", "py": "Python", "json": "JSON"}
_OTHER = "other"


def extension(path: str = "file_path") -> Column:
    return F.lower(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"\.([A-Za-z0-9]+)$", 1))


def parse_files(files: DataFrame, file_id: str = "file_id", path: str = "file_path", content: str = "content") -> DataFrame:
    """(file_id, repo, file_path, language, status, line, token) of every file.

    status is ok, broken (line and kind of the token that cannot stand there), truncated (last line) or unknown.
    """
    rows = files.select(F.col(file_id).cast("bigint").alias("file_id"), "repo", F.col(path).alias("file_path"), extension(path).alias("ext"), F.col(content).alias("content"))
    known = rows.where(F.col("ext").isin(*_LANGUAGE_OF) & F.col("content").isNotNull())
    rest = rows.where(~F.coalesce(F.col("ext").isin(*_LANGUAGE_OF), F.lit(False)) | F.col("content").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from solstrata.llm.languages import LANGUAGES, check

        for batch in batches:
            for part in byte_slices(batch, "content"):
                exts = part.column("ext").to_pylist()
                got = [check(e, t) for e, t in zip(exts, part.column("content").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("file_id"), part.column("repo"), part.column("file_path"), pa.array([LANGUAGES[e][0] for e in exts], pa.string()),
                     pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())],
                    ["file_id", "repo", "file_path", "language", "status", "line", "token"])

    schema = "file_id bigint, repo string, file_path string, language string, status string, line int, token string"
    parsed = known.mapInArrow(run, schema)
    none = F.lit(None).cast("string")
    unknown = rest.select("file_id", "repo", "file_path", none.alias("language"), F.lit("unknown").alias("status"), F.lit(None).cast("int").alias("line"), none.alias("token"))
    return parsed.unionByName(unknown)


def broken_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files that are not valid in the language of their extension."""
    return parse_files(files).where(F.col("status").isin("broken", "truncated")).select("file_id")


def path_tail(path: str, repo: str) -> Column:
    """A path as the repository sees it: one kind of separator, nothing up to and with the repository's name, no leading ./ or /."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    after = F.expr(f"case when {repo} is not null and instr(replace({path}, '\\\\', '/'), concat('/', {repo}, '/')) > 0 then 1 else 0 end")
    tail = F.expr(f"substring_index(replace({path}, '\\\\', '/'), concat('/', {repo}, '/'), -1)")
    return F.regexp_replace(F.when(after == 1, tail).otherwise(slashed), r"^(\./|/)+", "")


def flagged_files(files: DataFrame, errors: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, language, status, line, token, reports) of flagged files; reports counts their distinct error rows."""
    flags = parse_files(files).where(F.col("status").isin("broken", "truncated")).withColumn("tail", path_tail("file_path", "repo"))
    told = errors.where(F.col("repo").isNotNull() & F.col("file").isNotNull()).select("repo", path_tail("file", "repo").alias("tail"), F.coalesce("error", F.lit("")).alias("error"))
    told = told.groupBy("repo", "tail").agg(F.count_distinct("error").alias("n"))
    out = flags.join(told, ["repo", "tail"], "left")
    return out.select("file_id", "repo", "file_path", "language", "status", "line", "token", F.coalesce("n", F.lit(0)).alias("reports"))


def failure_rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, broken, truncated, rate) with a row per repository and language, per language (repo null), and for all.

    Files that are not checked count under the language 'other', have no rate and don't enter that of all files.
    """
    parsed = parse_files(files).select(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("language", F.lit(_OTHER)).alias("language"), "status")
    counts = parsed.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "broken").alias("broken"), F.count_if(F.col("status") == "truncated").alias("truncated"))
    checked = F.col("language") != _OTHER
    sums = [F.sum("files").alias("every"), *[F.coalesce(F.sum(F.when(checked, F.col(c))), F.lit(0)).alias(c) for c in ("files", "broken", "truncated")]]
    out = counts.groupingSets([["repo", "language"], ["language"], []], "repo", "language").agg(*sums)
    out = out.withColumn("files", F.when(F.col("language") == _OTHER, F.col("every")).otherwise(F.col("files")))
    bad = F.col("broken") + F.col("truncated")
    rate = F.when(F.col("language").isNull() | checked, F.round(bad / F.nullif("files", F.lit(0)), 6))
    return out.select("repo", "language", "files", "broken", "truncated", rate.alias("rate"))
