"""Schemas that drift between files of JSON entries.

Everything goes through one ingestion with a rescue column: the target schema is enforced, fields the target doesn't know, or
whose values don't fit its types, are kept as JSON. `ingest_records` does it for entries and for the elements of their lists, and
`field_changes` reads from its typed columns and its rescue which fields each dump has, and compares each dump with the one before.
`consistent_entries` approves what was found: fields that a chain of renames connects with a target column are replayed
into it, approved new fields are promoted to columns of their own, and the rest stays in the rescue.

All of it is JVM-side. Only where a field went and another came are values looked at, by their hashes, counted exactly. Pairs of
a lost and a new field are made by what speaks for them (a shared value, a shared word, a like name), never all with all. So neither a
dump, nor a folder, nor a wide schema is gathered in one place.

Defined results: unreadable entries and entries that are no object are left out of comparisons (a dump without any
readable entry is no dump) but kept whole in the rescue column of the table; rows without folder, dump or time take
no part in comparisons; an entry delivered twice changes nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstrata.operators.snapshots import small_side
from solstrata.session import materialize

# JSON types, fixed values.
_TYPES = ("string", "number", "boolean", "array", "object")

#: The JSON type that values of a column type have; others are rescued by a strict ingestion.
_WRITTEN_AS = {"string": "string", "timestamp": "string", "int": "number", "bigint": "number", "double": "number", "boolean": "boolean", "map<string,string>": "object", "array<variant>": "array"}
#: What a variant's own type is called where it is of a JSON type that casts would take for another.
_OWN_TYPE = {"string": "= 'STRING'", "boolean": "= 'BOOLEAN'", "number": "rlike '^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)'"}

#: What a value looks like; values that say the same in another JSON type have the same shape.
_SHAPE = r"""case when t in ('array', 'object') then 'list'
 when t = 'boolean' or c in ('true', 'false') then 'bool'
 when c rlike '^\\d{4}-\\d\\d-\\d\\d([T ]\\d\\d:\\d\\d.*)?$' or c rlike '^1[4-9]\\d{8}(\\d{3})?(\\.\\d+)?$' then 'time'
 when c rlike '^-?\\d+$' then 'integer' when c rlike '^-?\\d+\\.\\d+$' then 'decimal'
 when c rlike '^(0x)?[0-9a-fA-F]{8,}$' then concat('hex', length(c))
 when c rlike '^v?\\d+(\\.\\d+)+([-+].*)?$' then 'version'
 when c rlike '^\\S*[=;,]\\S*$' and not c rlike '[()\\[\\]]' then 'list'
 when c rlike '^\\S*[/\\\\]\\S*$' then 'path' when c rlike '^\\S+$' then 'word'
 when c rlike '[;=(){}]' then 'code' else 'prose' end"""

#: What is compared: the parts of a list (in whatever JSON type it is written), else the value itself.
_ITEMS = r"""case when shape = 'list' then array_distinct(filter(regexp_extract_all(c, '[A-Za-z0-9_.\\-]+', 0), x -> not x in ('name', 'version', 'id')))
 when shape = 'time' then array(coalesce(cast(unix_seconds(try_cast(c as timestamp)) as string), left(c, 10))) else array(c) end"""
_WORDS = r"""if(shape = 'prose', array_distinct(regexp_extract_all(lower(c), '[\\p{L}]+', 0)), array())"""


def _known(entries: DataFrame, folder: str, dump: str, written: str, text: str) -> DataFrame:
    known = entries.where(F.col(folder).isNotNull() & F.col(dump).isNotNull() & F.col(written).isNotNull())
    return known.select(F.col(folder).alias("folder"), F.col(dump).alias("dump"), F.col(written).alias("written"), F.col(text).alias("text"))


def ingest_records(entries: DataFrame, text: str, keys: Sequence[str], target: Mapping[str, str], rescued: str = "_rescued") -> DataFrame:
    """(keys..., level, a typed column per target field, rescued): a row per readable entry, level '', and per object in its lists.

    target maps fields to column types; `findings[].line` is the field `line` of the elements of the list `findings`, whose level
    is `findings[].`. A value of another JSON type than its column's, and any field the target doesn't know, is in
    `rescued`, a map from names to JSON. Each text is parsed once. Nulls are neither typed nor rescued.
    """
    lists = [f for f, kind in target.items() if kind == "array<variant>"]
    docs = entries.select(*keys, F.expr(f"try_variant_get(try_parse_json(`{text}`), '$', 'map<string,variant>')").alias("doc")).where("doc is not null")
    parts = "array(named_struct('level', '', 'fields', doc))"
    for name in lists:
        of = f"try_variant_get(doc['{name}'], '$', 'array<variant>')"
        parts += f", transform(coalesce({of}, array()), x -> named_struct('level', '{name}[].', 'fields', try_variant_get(x, '$', 'map<string,variant>')))"
    rows = docs.select(*keys, F.explode(F.expr(f"concat({parts})")).alias("x")).select(*keys, "x.level", "x.fields").where("fields is not null")
    typed, fits = [], []
    for field, kind in target.items():
        level, _, name = field.rpartition("[].")
        level = level + "[]." if level else ""
        value = f"if(level = '{level}', fields['{name}'], null)"
        got = f"to_json(try_variant_get({value}, '$', '{kind}'))" if kind == "array<variant>" else f"try_variant_get({value}, '$', '{kind}')"
        own = _OWN_TYPE.get(_WRITTEN_AS[kind])
        typed.append(F.expr(f"if(schema_of_variant({value}) {own}, {got}, null)" if own else got).alias(field))
        fits.append(F.when(F.col(f"`{field}`").isNotNull(), F.lit(name)))
    out = rows.select(*keys, "level", "fields", *typed)
    held = F.array_compact(F.array(*fits)) if fits else F.expr("cast(array() as array<string>)")
    rest = F.map_filter("fields", lambda k, v: ~F.is_variant_null(v) & ~F.array_contains(held, k))
    return out.withColumn(rescued, F.transform_values(rest, lambda k, v: F.to_json(v))).drop("fields")


#: JSON type of a rescued text, and its content without quotes.
_RESCUED_TYPE = "case left(json, 1) when '\"' then 'string' when '{' then 'object' when '[' then 'array' when 't' then 'boolean' when 'f' then 'boolean' else 'number' end"
_RESCUED_TEXT = "if(left(json, 1) = '\"', try_variant_get(try_parse_json(json), '$', 'string'), json)"


def field_types(records: DataFrame, target: Mapping[str, str], rescued: str = "_rescued") -> DataFrame:
    """(folder, dump, level, name, written, json_type): the fields of each dump, with the type that most of their values have.

    Typed columns are counted as they are; only what was rescued is looked at by name.
    """
    on = ["folder", "dump"]
    dumps = records.groupBy(*on).agg(F.min("written").alias("written"), *[F.count(f"`{f}`").alias(f) for f in target])
    parts = [f.rpartition("[].") for f in target]
    each = F.array(*[F.struct(F.lit(a + "[]." if a else "").alias("level"), F.lit(n).alias("name"), F.lit(_WRITTEN_AS[k]).alias("t"), F.col(f"`{f}`").alias("n")) for (a, _, n), (f, k) in zip(parts, target.items())])
    typed = dumps.select(*on, F.explode(each).alias("x")).select(*on, "x.*").where("n > 0")
    odd = records.where(F.size(rescued) > 0).select(*on, "level", F.explode(rescued).alias("name", "json")).withColumn("t", F.expr(_RESCUED_TYPE)).groupBy(*on, "level", "name", "t").agg(F.count("*").alias("n"))
    counts = typed.unionByName(odd).groupBy(*on, "level", "name").agg(F.max_by("t", F.struct("n", "t")).alias("json_type"))
    return counts.join(dumps.select(*on, "written"), on)


def field_values(records: DataFrame, wanted: DataFrame, target: Mapping[str, str], rescued: str = "_rescued") -> DataFrame:
    """(folder, dump, level, name, kind, item, shapes) of the wanted (folder, dump, level, name): distinct values (kind 'v') and words of prose ('w'), as hashes.

    A field has a row with a null item if its only values are empty.
    """
    on = ["folder", "dump", "level", "name"]
    texts = F.array_compact(F.array(*[F.when(F.col(f"`{f}`").isNotNull(), F.struct(F.lit(f.rpartition("[].")[2]).alias("name"), F.lit(_WRITTEN_AS[k]).alias("t"), _as_text(f, k).alias("c"))) for f, k in target.items()]))
    odd = F.transform(F.map_entries(rescued), lambda e: F.struct(e["key"].alias("name"), F.lit(None).cast("string").alias("t"), e["value"].alias("c")))
    dumps = small_side(materialize(wanted.select("folder", "dump").distinct(), "wanted-dumps"))
    rows = records.join(dumps, ["folder", "dump"], "left_semi").select("folder", "dump", "level", F.explode(F.concat(texts, odd)).alias("x")).select("folder", "dump", "level", "x.*")
    rows = rows.join(small_side(wanted), on, "left_semi").withColumnRenamed("c", "json")
    rows = rows.withColumn("c", F.when(F.col("t").isNull(), F.expr(_RESCUED_TEXT)).otherwise(F.col("json"))).withColumn("t", F.coalesce("t", F.expr(_RESCUED_TYPE)))
    rows = rows.withColumn("shape", F.expr(_SHAPE)).withColumn("v", F.expr(_ITEMS)).withColumn("w", F.expr(_WORDS))
    item = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), F.unhex(F.md5(F.nullif(x, F.lit("")))).alias("item")))
    rows = rows.select(*on, "shape", F.explode(F.when(F.size("v") + F.size("w") > 0, F.concat(item("v"), item("w"))).otherwise(F.expr("array(named_struct('kind', 'v', 'item', cast(null as binary)))"))).alias("x"))
    return rows.groupBy(*on, "x.kind", "x.item").agg(F.collect_set("shape").alias("shapes"))


def _as_text(field: str, kind: str) -> Column:
    c = F.col(f"`{field}`")
    return F.to_json(c) if kind.startswith("map") else c.cast("string")


def field_profiles(values: DataFrame) -> DataFrame:
    """(folder, dump, level, name, shapes, n, words): the shapes of each field's values and the number of distinct values and words."""
    n = lambda k: F.count(F.when(F.col("kind") == k, F.col("item")))
    return values.groupBy("folder", "dump", "level", "name").agg(F.array_distinct(F.flatten(F.collect_set("shapes"))).alias("shapes"), n("v").alias("n"), n("w").alias("words"))


def shared_values(values: DataFrame, steps: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """(folder, dump, level, old_name, new_name, both_n, both_words): how many values and words a lost and a new field share, if any.

    Flags are in too many fields to say anything and make no pairs.
    """
    on = ["folder", "dump", "level"]
    telling = values.where("item is not null and not array_contains(shapes, 'bool')").drop("shapes")
    old = telling.withColumnRenamed("dump", "before").withColumnRenamed("name", "old_name").join(steps, ["folder", "before"])
    old = old.join(small_side(gone.select(*on, "old_name")), [*on, "old_name"], "left_semi").drop("before")
    new = telling.withColumnRenamed("name", "new_name").join(small_side(come.select(*on, "new_name")), [*on, "new_name"], "left_semi")
    both = old.join(new, [*on, "kind", "item"])
    return both.groupBy(*on, "old_name", "new_name").agg(F.count_if(F.col("kind") == "v").alias("both_n"), F.count_if(F.col("kind") == "w").alias("both_words"))


_NAME_TOKENS = "transform(split(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '$1_$2')), '[_. -]+'), x -> rtrim('s', x))"
_NAME_LIKENESS = f"""case
 when lower(regexp_replace(old_name, '[_. -]', '')) = lower(regexp_replace(new_name, '[_. -]', '')) then 1.0
 when length(least(old_name, new_name)) >= 3 and (startswith(lower(old_name), lower(new_name)) or startswith(lower(new_name), lower(old_name))
   or endswith(lower(old_name), lower(new_name)) or endswith(lower(new_name), lower(old_name))) then 0.7
 when size(array_intersect({_NAME_TOKENS.format("old_name")}, {_NAME_TOKENS.format("new_name")})) > 0 then 0.6 else 0.0 end"""

#: By what names are paired: the name itself, its words, and its first and last three letters.
_NAME_KEYS = f"""array_distinct(filter(concat(array(lower(regexp_replace({{0}}, '[_. -]', '')), concat('<', left(lower({{0}}), 3)), concat('>', right(lower({{0}}), 3))),
 {_NAME_TOKENS}), x -> x <> ''))"""

#: Likeness of a removed and an added field. Shared values decide, unless they say little (flags, small numbers), and one
#: shared hash, path, line of code or sentence says enough; a like name counts only for values of a like shape; sentences
#: of the same vocabulary come last. Below 0.4 it is no rename.
_LIKENESS = """case
 when alike and both_n > 0 and (old_shapes[0] like 'hex%' or old_shapes[0] in ('path', 'code', 'prose')) then 1 + shared + 0.5 * name_like
 when alike and not old_shapes[0] in ('bool', 'integer') and shared >= 0.3 then 1 + shared + 0.5 * name_like
 when alike and old_shapes[0] = 'integer' and shared >= 0.5 and least(old_n, new_n) >= 5 then 1 + 0.5 * shared + 0.5 * name_like
 when alike and name_like > 0 then 0.5 + 0.5 * name_like + 0.3 * shared
 when name_like = 1.0 then 0.9
 when name_like >= 0.7 and arrays_overlap(old_shapes, array('integer', 'word', 'bool')) and arrays_overlap(new_shapes, array('integer', 'word', 'bool')) then 0.6
 when alike and old_shapes[0] = 'list' then 0.4 + 0.5 * shared
 when alike and both_words >= 0.3 * least(old_words, new_words) and least(old_words, new_words) >= 5 then 0.4 + 0.5 * both_words / least(old_words, new_words)
 else 0.0 end"""


def best_pairs(pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on..., old_name, new_name) of pairs (on..., old_name, new_name, likeness): taken in the order of likeness, then names, each name once.

    Pairs that are the best of both their names are taken at once, and their names' other pairs dropped, until none is left: that
    is the same as going through all pairs in order, without gathering them.
    """
    order = [F.desc("likeness"), "old_name", "new_name"]
    left, out = pairs, None
    while left.limit(1).count():
        first = left.withColumn("x", F.row_number().over(Window.partitionBy(*on, "old_name").orderBy(*order))).withColumn("y", F.row_number().over(Window.partitionBy(*on, "new_name").orderBy(*order)))
        first = materialize(first.where("x = 1 and y = 1").select(*on, "old_name", "new_name"), "best-pairs")
        out = first if out is None else out.unionByName(first)
        left = left.join(first.select(*on, "old_name"), [*on, "old_name"], "left_anti").join(first.select(*on, "new_name"), [*on, "new_name"], "left_anti")
        left = materialize(left, "pairs-left")
    return out if out is not None else pairs.select(*on, "old_name", "new_name")


def field_changes(entries: DataFrame, folder: str, dump: str, written: str, text: str, target: Mapping[str, str] | None = None) -> DataFrame:
    """(dump, change, field, new_field): each dump against the dump before it by `written` in the same folder.

    change is added, removed, renamed or retyped. A rename pairs a removed with an added field of the same level; pairs are
    taken in the order of their likeness (ties by name), each field once. target is the schema that is enforced first; results do not
    depend on it, but what fits it is counted without being looked at by name.
    """
    target = RECORD_TARGET if target is None else target
    known = _known(entries, folder, dump, written, text)
    records = materialize(ingest_records(known, "text", ["folder", "dump", "written"], target), "records")
    types = materialize(field_types(records, target), "field-types")
    dumps = types.groupBy("folder", "dump").agg(F.min("written").alias("written"))
    w = Window.partitionBy("folder").orderBy("written", "dump")
    steps = small_side(materialize(dumps.select("folder", "dump", F.lag("dump").over(w).alias("before")).where("before is not null"), "dump-steps"))
    at = ["folder", "dump", "level", "name"]
    new = types.join(steps, ["folder", "dump"]).select(*at, F.col("before").alias("before_new"), F.col("json_type").alias("new_type"))
    old = types.withColumnRenamed("dump", "before").join(steps, ["folder", "before"]).select(*at, "before", F.col("json_type").alias("old_type"))
    both = materialize(old.join(new, at, "full").where("not old_type <=> new_type"), "field-steps")
    gone = both.where("new_type is null").select("folder", "dump", "level", F.col("name").alias("old_name"), "before", "old_type")
    come = both.where("old_type is null").select("folder", "dump", "level", F.col("name").alias("new_name"), F.col("before_new").alias("before"), "new_type")
    on = ["folder", "dump", "level"]
    # values are looked at only where a field went and another came, and only of those fields
    both_ways = gone.select(*on).distinct().join(come.select(*on).distinct(), on)
    wanted = gone.join(both_ways, on, "left_semi").select("folder", F.col("before").alias("dump"), "level", F.col("old_name").alias("name"))
    wanted = wanted.unionByName(come.join(both_ways, on, "left_semi").select("folder", "dump", "level", F.col("new_name").alias("name"))).distinct()
    values = materialize(field_values(records, materialize(wanted, "wanted-fields"), target), "field-values")
    profiles = field_profiles(values)
    said = ["shapes", "n", "words"]
    old = gone.join(profiles.select("folder", F.col("dump").alias("before"), "level", F.col("name").alias("old_name"), F.struct(*said).alias("old")), ["folder", "before", "level", "old_name"]).drop("before")
    new = come.drop("before").join(profiles.select("folder", "dump", "level", F.col("name").alias("new_name"), F.struct(*said).alias("new")), ["folder", "dump", "level", "new_name"])
    old, new = materialize(old, "fields-gone"), materialize(new, "fields-come")
    shared = shared_values(values, steps, old, new)
    key = lambda df, name: df.select(*on, name, F.explode(F.expr(_NAME_KEYS.format(name))).alias("key"))
    named = key(old, "old_name").join(key(new, "new_name"), [*on, "key"]).select(*on, "old_name", "new_name")
    # a list that goes while one list comes needs no other sign
    alone = lambda df, x, name: df.where(F.array_contains(f"{x}.shapes", "list")).groupBy(*on).agg(F.count("*").alias("k"), F.min(name).alias(name)).where("k = 1").drop("k")
    lists = alone(old, "old", "old_name").join(alone(new, "new", "new_name"), on)
    none = [F.lit(0).cast("bigint").alias(c) for c in ("both_n", "both_words")]
    pairs = shared.unionByName(named.unionByName(lists).select(*on, "old_name", "new_name", *none)).groupBy(*on, "old_name", "new_name").agg(F.max("both_n").alias("both_n"), F.max("both_words").alias("both_words"))
    pairs = pairs.join(old, [*on, "old_name"]).join(new, [*on, "new_name"])
    pairs = pairs.select(*on, "old_name", "new_name", F.array_sort("old.shapes").alias("old_shapes"), F.col("new.shapes").alias("new_shapes"), F.col("old.n").alias("old_n"), F.col("new.n").alias("new_n"),
        F.col("old.words").alias("old_words"), F.col("new.words").alias("new_words"), F.expr("arrays_overlap(old.shapes, new.shapes)").alias("alike"), F.expr(_NAME_LIKENESS).alias("name_like"), "both_n", "both_words",
        "old_type", "new_type")
    pairs = materialize(pairs.withColumn("shared", F.expr("both_n / greatest(least(old_n, new_n), 1)")).withColumn("likeness", F.expr(_LIKENESS)).where("likeness >= 0.4"), "field-pairs")
    chosen = materialize(best_pairs(pairs.select(*on, "old_name", "new_name", "likeness"), on), "field-renames")
    added = come.join(chosen.select(*on, "new_name"), [*on, "new_name"], "left_anti")
    removed = gone.join(chosen.select(*on, "old_name"), [*on, "old_name"], "left_anti")
    renamed = pairs.select(*on, "old_name", "new_name", "old_type", "new_type").join(chosen, [*on, "old_name", "new_name"])

    def rows(df: DataFrame, change: str, field: str, other: str) -> DataFrame:
        return df.select("dump", F.lit(change).alias("change"), F.concat("level", field).alias("field"), F.concat("level", other).alias("new_field"))

    kept = both.where("old_type <> new_type")
    parts = [rows(added, "added", "new_name", "new_name"), rows(removed, "removed", "old_name", "old_name"), rows(kept, "retyped", "name", "name"),
        rows(chosen, "renamed", "old_name", "new_name"), rows(renamed.where("old_type <> new_type"), "retyped", "new_name", "new_name")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Target schema of a cache entry.
ENTRY_TARGET: dict[str, str] = {
    "filepath": "string", "file_hash": "string", "tool_version": "string", "detector_versions": "map<string,string>",
    "analyzed_at": "timestamp", "finding_count": "int", "duration_ms": "bigint", "findings": "variant",
}
#: The schema enforced on entries and their findings when dumps are compared.
RECORD_TARGET: dict[str, str] = {
    "filepath": "string", "file_hash": "string", "tool_version": "string", "detector_versions": "map<string,string>", "analyzed_at": "string", "finding_count": "bigint", "findings": "array<variant>",
    **{f"findings[].{f}": "string" for f in ("detector", "title", "file", "code_snippet", "description", "severity", "confidence", "rule_id")}, "findings[].line": "bigint",
}
#: New fields that were approved for columns of their own.
ENTRY_APPROVED: dict[str, str] = {"schema_version": "int", "language": "string", "config_hash": "string", "from_cache": "boolean", "size_bytes": "bigint"}


def _typed(doc: str, field: str, kind: str) -> Column:
    path = "$['" + field.replace("'", "\\'") + "']"
    if kind == "timestamp":
        text = f"try_variant_get({doc}, \"{path}\", 'string')"
        number = f"try_variant_get({doc}, \"{path}\", 'double')"
        return F.expr(f"coalesce(timestamp_seconds(if({number} > 1e11, {number} / 1000, {number})), try_cast({text} as timestamp))")
    if kind == "map<string,string>":
        pairs = f"try_variant_get({doc}, \"{path}\", 'array<struct<name:string,version:string>>')"
        text = f"try_variant_get({doc}, \"{path}\", 'string')"
        listed = f"if(forall({pairs}, x -> x.name is not null), map_from_entries(array_distinct({pairs})), null)"
        written = f"if({text} rlike '^[^=;]+=[^=;]*(;[^=;]+=[^=;]*)*$', str_to_map({text}, ';', '='), null)"
        return F.expr(f"coalesce(try_variant_get({doc}, \"{path}\", '{kind}'), {listed}, {written})")
    return F.expr(f"try_variant_get({doc}, \"{path}\", '{kind}')")


def rescue_ingest(df: DataFrame, text: str, target: Mapping[str, str], rescued: str = "_rescued") -> DataFrame:
    """The columns of df but `text`, one typed column per target field, and `rescued`: JSON of all that isn't in them.

    A field is rescued if the target doesn't know it or its value isn't null and can't be cast; a text that is no readable
    object is rescued whole, under `_unreadable`. An existing column of a target's name is kept as `source_<name>`.
    """
    for name in [*target, rescued]:
        if name in df.columns and name != text:
            df = df.withColumnRenamed(name, f"source_{name}")
    doc = df.withColumn("_doc", F.expr(f"try_parse_json(`{text}`)"))
    doc = doc.withColumn("_fields", F.expr(f"if(schema_of_variant(_doc) like 'OBJECT%', from_json(`{text}`, 'map<string,variant>'), null)"))
    typed = doc.select(*[c for c in df.columns if c != text], text, "_fields", *[_typed("_doc", f, k).alias(f) for f, k in target.items()])
    cast = F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in target]) if target else F.expr("array('')")
    rest = F.map_filter("_fields", lambda k, v: ~F.array_contains(F.array_compact(cast), k) & ~F.is_variant_null(v))
    typed = typed.withColumn(rescued, F.when(F.col("_fields").isNotNull(), F.when(F.size(rest) > 0, F.to_json(rest))).otherwise(F.to_json(F.struct(F.col(text).alias("_unreadable")))))
    return typed.drop("_fields", text)


def replay(df: DataFrame, fields: Mapping[str, tuple[str, Sequence[str]]], rescued: str = "_rescued") -> DataFrame:
    """Fill nulls of typed columns from rescued fields: fields maps a column to its type and the names to try, in order.

    Rescued values that were used leave the rescue; the others stay. All columns are replayed in one pass.
    """
    if not fields:
        return df
    doc = f"try_parse_json(`{rescued}`)"
    filled, used = [], []
    for field, (kind, names) in fields.items():
        values = [_typed(doc, n, kind) for n in names]
        used.append(F.when(F.col(field).isNull(), F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for v, n in zip(values, names)])))
        filled.append(F.coalesce(F.col(field), *values).alias(f"_new_{field}"))
    taken = lambda k: functools.reduce(lambda x, y: x | y, [k.eqNullSafe(u) for u in used])
    left = F.map_filter(F.from_json(rescued, "map<string,variant>"), lambda k, v: ~taken(k))
    rest = F.when(F.coalesce(*used).isNull(), F.col(rescued)).when(F.size(left) > 0, F.to_json(left)).alias(f"_new_{rescued}")
    # new names first: a lambda would take an alias of the same list for the column of that name
    out = df.select("*", *filled, rest)
    new = {*fields, rescued}
    return out.select(*[F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in df.columns])


def promote(df: DataFrame, field: str, kind: str, names: Sequence[str] = (), rescued: str = "_rescued") -> DataFrame:
    """Add an approved field as a typed column and replay what was rescued under its name (and `names`)."""
    if field in df.columns:
        raise ValueError(f"{field} is a column already")
    return replay(df.withColumn(field, F.expr(f"cast(null as {kind})")), {field: (kind, [field, *names])}, rescued)


def names_of(changes: DataFrame, fields: Sequence[str]) -> dict[str, list[str]]:
    """For each field the other names that chains of reported renames connect with it, in the order of their names.

    Only distinct names come to the driver: they are parts of the schema, as columns are. A name that leads to several fields is
    left to the first.
    """
    links = changes.where("change = 'renamed' and not contains(field, '[].')").select("field", "new_field").distinct()
    near: dict[str, set[str]] = {}
    for one, two in links.toLocalIterator():
        near.setdefault(one, set()).add(two)
        near.setdefault(two, set()).add(one)
    out: dict[str, list[str]] = {}
    taken = set(fields)
    for field in fields:
        found, todo = [], [field]
        while todo:
            for name in sorted(near.get(todo.pop(), ())):
                if name not in taken:
                    taken.add(name)
                    found.append(name)
                    todo.append(name)
        out[field] = sorted(found)
    return out


def consistent_entries(entries: DataFrame, text: str = "payload", folder: str = "cache_dir", dump: str = "dump_id", written: str = "written_at") -> DataFrame:
    """All cache entries in the target schema: renames that were found are replayed, approved fields promoted, what is left over is JSON."""
    changes = materialize(field_changes(entries, folder, dump, written, text), "field-changes")
    names = names_of(changes, [*ENTRY_TARGET, *ENTRY_APPROVED])
    rows = replay(rescue_ingest(entries, text, ENTRY_TARGET), {f: (kind, names[f]) for f, kind in ENTRY_TARGET.items() if names[f]})
    for field, kind in ENTRY_APPROVED.items():
        if field not in rows.columns:
            rows = rows.withColumn(field, F.expr(f"cast(null as {kind})"))
    return replay(rows, {f: (kind, [f, *names[f]]) for f, kind in ENTRY_APPROVED.items()})
