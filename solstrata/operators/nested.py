"""Deeply nested JSON records as flat related tables, each child naming its parent.

Records arrive as JSON text. On the JVM side unreadable texts are dropped and repeated deliveries reduced to
one; the rest is flattened from Arrow buffers: list offsets say how many children a parent has, the
parent-index kernel says whose child an element is, and keys travel down by vectorised take: through the lists of a log level by
level, and through the objects of a syntax tree, whatever they are nested in, likewise. No text is parsed row by row; only
strings with escapes are decoded one at a time.

Defined results: null, blank or unreadable texts give no rows; a null or absent list has no elements; a null element
counts as an element of its list but has no children; a record without id is kept, each delivery by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstrata.functions.arrow_batches import byte_slices
from solstrata.functions.json_tape import JsonTape, sound_tape
from solstrata.operators.snapshots import small_side
from solstrata.session import materialize

EDGE_SCHEMA = "record_id bigint, child string, parent string"
#: The list paths of a log: a name per level below the root.
LOG_PATHS = (
    ("runs",),
    ("runs", "results"),
    ("runs", "results", "locations"),
    ("runs", "results", "codeFlows"),
    ("runs", "results", "codeFlows", "threadFlows"),
    ("runs", "results", "codeFlows", "threadFlows", "locations"),
)


#: Records above which the winning deliveries are joined by shuffle instead of being sent to every executor (24 bytes each).
WINNERS = 2_000_000


def latest_readable(df: DataFrame, record_id: str, text: str, order: Sequence[str]) -> DataFrame:
    """(record_id, text): one readable text per record, the delivery that is last by `order` (nulls first).

    The winners are found on ids and order alone, by a partial aggregate; texts meet them in a semi join and are not shuffled, but
    for records whose last delivery is there several times, which are reduced. Rows with a null id are kept one by one.
    """
    on = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    keys = [f"_o{i}" for i in range(len(order))]
    rows = df.select(F.col(record_id).alias("record_id"), *on, F.col(text).alias("text"))
    readable = rows.where("json_object_keys(text) is not null")
    alone = readable.where("record_id is null")
    named = readable.where("record_id is not null")
    last = named.groupBy("record_id", *keys).agg(F.count("*").alias("n")).groupBy("record_id").agg(F.max(F.struct(*keys, "n")).alias("w"))
    last = materialize(last.select(F.col("record_id").alias("w_id"), *[F.col("w")[k].alias(f"w{k}") for k in keys], F.col("w.n").alias("n")), "last-deliveries")
    same = F.col("record_id") == F.col("w_id")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"w{k}"))
    one = named.join(small_side(last.where("n = 1"), WINNERS), same, "left_semi").select("record_id", "text")
    out = one.unionByName(alone.groupBy(keys[-1]).agg(F.max_by("text", F.struct(*keys)).alias("text")).select(F.lit(None).cast(df.schema[record_id].dataType).alias("record_id"), "text"))
    if last.where("n > 1").limit(1).count():
        several = named.join(small_side(last.where("n > 1"), WINNERS), same, "left_semi")
        out = out.unionByName(several.groupBy("record_id").agg(F.max("text").alias("text")))
    return out


def _elements(tape: JsonTape, lists: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parent positions (into `lists`), ordinals and openers (-1: not an object) of all elements of the lists."""
    sizes = tape.list_lengths(lists)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = int(offsets[-1])
    ordinals = np.arange(total) - np.repeat(offsets[:-1], sizes)
    column = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ordinals))
    parents = pc.list_parent_indices(column)
    opener = np.full(total, -1, np.int64)
    slot = np.full(len(tape.open_pos) + 1, -1, np.int64)
    slot[lists] = np.arange(len(lists))
    kids = np.flatnonzero((tape.container >= 0) & ~tape.open_is_list)
    kids = kids[slot[tape.container[kids]] >= 0]
    opener[offsets[slot[tape.container[kids]]] + tape.ordinal[kids]] = kids
    return parents, ordinals, opener


def _child_level(tape: JsonTape, level: tuple, name: str) -> tuple:
    """From a level (openers, names, record ids) to the elements of its lists `name`: the same three, and the parents' names."""
    holders, names, ids = level
    named = tape.lists_named(name)
    slot = np.full(len(tape.open_pos) + 1, -1, np.int64)
    slot[holders[holders >= 0]] = np.flatnonzero(holders >= 0)
    named = named[slot[tape.container[named]] >= 0]
    of = pa.array(slot[tape.container[named]])
    at, ordinals, opener = _elements(tape, named)
    parent, ident = names.take(of).take(at), ids.take(of).take(at)
    big = pa.large_string()
    dot = pc.if_else(pc.equal(parent, pa.scalar("", big)), pa.scalar("", big), pa.scalar(".", big))
    child = pc.binary_join_element_wise(parent, dot, pa.scalar(f"{name}[", big), pa.array(ordinals).cast(big), pa.scalar("]", big), pa.scalar("", big))
    return (opener, child, ident), parent


def _root_level(batch: pa.RecordBatch, tape: JsonTape) -> tuple:
    roots = np.flatnonzero((tape.container < 0) & ~tape.open_is_list)
    return roots, pa.array([""] * len(roots), pa.large_string()), batch.column("record_id").take(pa.array(tape.open_doc[roots]))


def _flatten_paths(batch: pa.RecordBatch, tape: JsonTape, paths: Sequence[Sequence[str]]) -> Iterator[pa.RecordBatch]:
    levels = {(): _root_level(batch, tape)}
    for path in paths:
        levels[tuple(path)], parent = _child_level(tape, levels[tuple(path[:-1])], path[-1])
        _, child, ident = levels[tuple(path)]
        if len(child):
            yield pa.RecordBatch.from_arrays([ident, child.cast(pa.string()), parent.cast(pa.string())], ["record_id", "child", "parent"])


def flatten_lists(records: DataFrame, paths: Sequence[Sequence[str]] = LOG_PATHS) -> DataFrame:
    """Rows (record_id, child, parent), one per element of the lists at `paths` of records (record_id, text).

    A child is named by its path, such as `runs[0].results[2]`; the parent of a first-level element is ''.
    """
    paths = [tuple(p) for p in paths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                part, tape = sound_tape(part, "text")
                if tape is not None:
                    yield from _flatten_paths(part, tape, paths)

    return records.select("record_id", "text").mapInArrow(run, EDGE_SCHEMA)


def _flatten_nodes(batch: pa.RecordBatch, tape: JsonTape, type_key: str, id_key: str, root_type: str, columns: Sequence[str] = ()) -> pa.RecordBatch:
    n = len(tape.open_pos)

    def held(key: str) -> tuple[np.ndarray, pa.LargeStringArray]:
        """For each opener the number of its value of a key, -1 for none, and the values."""
        colons = tape.colons_named(key)
        values = tape.scalars(colons)
        there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        of = np.full(n, -1, np.int64)
        of[tape.colon_container[colons[there]]] = there
        return of, values

    def take(of: np.ndarray, values: pa.LargeStringArray) -> pa.Array:
        return values.take(pa.array(np.where(of >= 0, of, 0), mask=of < 0)) if len(values) else pa.nulls(len(of), pa.large_string())

    id_of, ids = held(id_key)
    type_of, types = held(type_key)
    node = (type_of >= 0) & (id_of >= 0)
    is_root = np.zeros(n, bool)
    typed = np.flatnonzero(type_of >= 0)
    if len(typed):
        is_root[typed] = pc.equal(types, root_type).fill_null(False).to_numpy(zero_copy_only=False)[type_of[typed]]
    above = tape.enclosing(node)
    out = np.flatnonzero(node & ~is_root)
    up = above[out]
    parent = take(np.where(up >= 0, id_of[up], -1), ids).fill_null("")
    arrays = [batch.column("record_id").take(pa.array(tape.open_doc[out])), take(id_of[out], ids).cast(pa.string()), parent.cast(pa.string())]
    for key in columns:
        of, values = held(key)
        arrays.append(take(of[out], values).cast(pa.string()))
    return pa.RecordBatch.from_arrays(arrays, ["record_id", "child", "parent", *[f"v{i}" for i in range(len(columns))]])


def flatten_nodes(records: DataFrame, type_key: str = "nodeType", id_key: str = "id", root_type: str = "SourceUnit") -> DataFrame:
    """Rows (record_id, child, parent), one per object at any depth that has both a type and an id.

    child and parent are ids as text; the parent is the nearest enclosing object that has both, '' if there is none.
    Objects of `root_type` give no row of their own. A key with a null value counts as absent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                part, tape = sound_tape(part, "text")
                if tape is not None:
                    yield _flatten_nodes(part, tape, type_key, id_key, root_type)

    return records.select("record_id", "text").mapInArrow(run, EDGE_SCHEMA)


def node_table(records: DataFrame, columns: Sequence[str] = ("nodeType", "name", "src"), type_key: str = "nodeType", id_key: str = "id", root_type: str = "SourceUnit") -> DataFrame:
    """The related table of syntax nodes: a row per edge of `flatten_nodes` with record_id, row_key, parent_key and scalar fields of the node as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                part, tape = sound_tape(part, "text")
                if tape is not None:
                    yield _flatten_nodes(part, tape, type_key, id_key, root_type, columns)

    flat = records.select("record_id", "text").mapInArrow(run, EDGE_SCHEMA + "".join(f", v{i} string" for i in range(len(columns))))
    return flat.select("record_id", F.col("child").alias("row_key"), F.col("parent").alias("parent_key"), *[F.col(f"v{i}").alias(c) for i, c in enumerate(columns)])


def record_edges(logs: DataFrame, units: DataFrame) -> DataFrame:
    """(record_kind, record_id, child, parent) of all logs and syntax trees; repeated deliveries count once."""
    sarif = flatten_lists(latest_readable(logs, "log_id", "payload", ["received_at", "delivery_id"]))
    ast = flatten_nodes(latest_readable(units, "unit_id", "ast_json", ["compiled_at", "delivery_id"]))
    kind: list[tuple[str, DataFrame]] = [("sarif", sarif), ("ast", ast)]
    parts = [df.select(F.lit(k).alias("record_kind"), "record_id", "child", "parent") for k, df in kind]
    return parts[0].unionByName(parts[1])


#: Columns of the related tables of a log, below the keys (record_id, row key, parent key): name, type, path in the element.
LOG_TABLES: dict[tuple[str, ...], Sequence[tuple[str, str]]] = {
    ("runs",): (("tool_name", "$.tool.driver.name"), ("tool_version", "$.tool.driver.version")),
    ("runs", "results"): (("rule_id", "$.ruleId"), ("level", "$.level"), ("message", "$.message.text")),
    ("runs", "results", "locations"): (
        ("uri", "$.physicalLocation.artifactLocation.uri"),
        ("start_line", "$.physicalLocation.region.startLine"),
    ),
    ("runs", "results", "codeFlows"): (("message", "$.message.text"),),
    ("runs", "results", "codeFlows", "threadFlows"): (("flow_id", "$.id"), ("message", "$.message.text")),
    ("runs", "results", "codeFlows", "threadFlows", "locations"): (
        ("uri", "$.location.physicalLocation.artifactLocation.uri"),
        ("start_line", "$.location.physicalLocation.region.startLine"),
        ("importance", "$.importance"),
        ("message", "$.location.message.text"),
    ),
}


def _element_texts(batch: pa.RecordBatch, tape: JsonTape, path: Sequence[str]) -> Iterator[pa.RecordBatch]:
    level, parent = _root_level(batch, tape), None
    for name in path:
        level, parent = _child_level(tape, level, name)
    opener, child, ident = level
    at = np.flatnonzero(opener >= 0)
    data = tape.body.tobytes()
    start, end = tape.open_pos[opener[at]].tolist(), (tape.close_pos[opener[at]] + 1).tolist()
    texts = np.full(len(opener), None, dtype=object)
    texts[at] = [data[a:b].decode("utf-8", "replace") for a, b in zip(start, end)]
    if len(opener):
        columns = [ident, child.cast(pa.string()), parent.cast(pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["record_id", "row_key", "parent_key", "element"])


def related_table(records: DataFrame, path: Sequence[str], columns: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """One related table: a row per element at `path` with record_id, row_key, parent_key and the given columns as text.

    The element's own text is cut out of the buffer by its offsets; the columns are read from it on the JVM side.
    """
    path = tuple(path)
    columns = LOG_TABLES[path] if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                part, tape = sound_tape(part, "text")
                if tape is not None:
                    yield from _element_texts(part, tape, path)

    flat = records.select("record_id", "text").mapInArrow(run, "record_id bigint, row_key string, parent_key string, element string")
    values: list[Column] = [F.get_json_object("element", where).alias(name) for name, where in columns]
    return flat.select("record_id", "row_key", "parent_key", *values)
