"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstrata.llm import canonical, leakage, licenses, neardup, packing, parsing
from solstrata.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]

#: Problem 2 is stated for runs of three words and a likeness of 0.6.
RUN_WORDS, LIKENESS = 3, 0.6
MIN_WORDS = 12


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, d, "verified_sources"), "source_id", "sourcecode", RUN_WORDS, LIKENESS)
    return pairs.select(F.col("id_a").alias("source_id_a"), F.col("id_b").alias("source_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "verified_sources")
    groups = neardup.similar_groups(sources, "source_id", "sourcecode", RUN_WORDS, LIKENESS).withColumnRenamed("id", "source_id")
    return groups.join(sources.select("source_id", "contractname"), "source_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.broken_files(table(spark, d, "source_files"))


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return parsing.flagged_files(table(spark, d, "source_files"), table(spark, d, "analysis_errors"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.failure_rates(table(spark, d, "source_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return licenses.licenses(table(spark, d, "verified_sources"), table(spark, d, "license_files"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "containers"))


#: Packs over the least possible number that a packing may need.
FILL_FACTOR = 1.02


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of container whether every text with tokens is placed whole and once, no pack holds more than the capacity, and packs are hardly more than the least."""
    containers = table(spark, d, "containers")
    counts = materialize(packing.token_counts(table(spark, d, "documents")), "token-counts")
    packed = materialize(packing.pack_documents(counts, containers), "packed")
    fill = packing.pack_fill(packed, containers).withColumn("close_to_least", F.col("packs") <= F.ceil(F.col("least_packs") * FILL_FACTOR) + 1)
    full = packed.groupBy("container_id", "pack_id").agg(F.sum("piece_tokens").alias("used")).groupBy("container_id").agg(F.max("used").alias("fullest"))
    whole = packed.groupBy("container_id", "doc_id").agg(F.sum("piece_tokens").alias("placed"), F.count("*").alias("pieces"))
    both = whole.join(counts.where("n_tokens > 0"), "doc_id", "full").join(F.broadcast(containers.select("container_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))), "container_id", "left")
    right = F.coalesce(F.expr("placed = n_tokens and pieces = (n_tokens + capacity - 1) div capacity"), F.lit(False))
    seen = both.groupBy("container_id").agg(F.bool_and(right).alias("right"), F.count("*").alias("n"))
    total = counts.where("n_tokens > 0").agg(F.count("*").alias("every"))
    out = containers.select("container_id", F.col("capacity_tokens").alias("capacity")).where("capacity > 0").join(fill.select("container_id", "close_to_least"), "container_id").join(full, "container_id").join(seen, "container_id")
    out = out.withColumn("every", F.lit(total.first()[0]))
    return out.select("container_id", F.expr("right and n = every").alias("placed_once"), F.expr("fullest <= capacity").alias("within_capacity"), "close_to_least")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), MIN_WORDS)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), 80, 3)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_classes(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p2_found, p2_groups, p4_found, p4_flags, p4_rates, p6_found, p7_packing, p7_fill, p8_found, p8_items, p8_passages, p9_found, p9_canonical, p9_classes)
}

def _letters() -> str:
    """Rows (c, t): what becomes of a character by itself, from the Unicode tables; written as its base letters and accents apart."""
    like = canonical._LOOK_ALIKES  # fixed values
    rows = []
    for code in [*range(0xA0, 0x3100), *range(0xA640, 0xAB70), *range(0xFB00, 0xFB07), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        c, kind = chr(code), unicodedata.category(chr(code))
        if kind == "Cf" or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0) or 0xFE00 <= code < 0xFE10 or 0xE0100 <= code < 0xE01F0:
            t = "" if code not in range(0x600, 0x606) and code not in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2) else c  # signs of Arabic show
        elif code in (0xA0, 0x2007, 0x202F, 0x3000):
            t = " "
        else:
            wide = 0xFF00 <= code or code in range(0x2160, 0x2180) and len(unicodedata.normalize("NFKC", c)) == 1 or code in range(0xFB00, 0xFB07) or 0x1D400 <= code < 0x1D800
            plain = unicodedata.normalize("NFKC", c) if wide else c
            t = "".join(like.get(x, x) for x in unicodedata.normalize("NFD", plain))
        if t != c:
            rows.append(f"(chr({code}), '{t.replace(chr(39), chr(39) * 2)}')")
    return ", ".join(rows)


def _forms(name: str, key: str) -> str:
    """SQL of (key, text, form): texts taken apart into characters, each looked up in a table, and put together again."""
    emoji = "between 8592 and 11263 or unicode({0}) between 126976 and 129791"
    return f"""letters(c, t) as (values {_letters()}),
chars as (select {key}, i, c, lag(c) over w as before, lag(c, 2) over w as before2, lead(c) over w as after from (
    select {key}, unnest(regexp_extract_all(text, '(?s).')) as c, unnest(range(len(regexp_extract_all(text, '(?s).')))) as i from {name} where text is not null) window w as (partition by {key} order by i)),
shown as (select {key}, string_agg(case when c = chr(8205) and (unicode(after) {emoji.format("after")}) and (unicode(before) {emoji.format("before")} or before = chr(65039) and (unicode(before2) {emoji.format("before2")})) then c
    else coalesce(t, c) end, '' order by i) as form from chars left join letters using (c) group by {key}),
forms as (select d.{key}, d.text, nfc_normalize(coalesce(form, '')) as form from {name} d left join shown using ({key}) where d.text is not null)"""


def _runs(name: str, key: str) -> str:
    return f"""(with {_forms(name, key)}, w as (select {key}, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') as w from forms)
select distinct {key}, array_to_string(w[i:i + {MIN_WORDS - 1}], ' ') as run from w, unnest(range(1, len(w) - {MIN_WORDS - 2})) as t(i))"""


_P8 = f"select distinct doc_id, item_id from {_runs('documents', 'doc_id')} join {_runs('eval_items', 'item_id')} using (run)"
_P9 = f"with {_forms('documents', 'doc_id')}"

ORACLES: dict[str, str] = {
    "p2_found": r"""
with words as (select source_id, regexp_extract_all(lower(sourcecode), '[\p{L}\p{N}_]+') as w from verified_sources),
runs as (select distinct source_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run from words, unnest(range(1, len(w) - 1)) as t(i)),
sizes as (select source_id, count(*) as n from runs group by source_id),
shared as (select a.source_id as x, b.source_id as y, count(*) as c from runs a join runs b on a.run = b.run and a.source_id < b.source_id group by all)
select x as source_id_a, y as source_id_b from shared join sizes p on p.source_id = x join sizes q on q.source_id = y
where c >= 0.6 * (p.n + q.n - c)""",
    "p2_groups": r"""
with recursive words as (select source_id, contractname, regexp_extract_all(lower(sourcecode), '[\p{L}\p{N}_]+') as w from verified_sources where sourcecode is not null),
sets as (select source_id, contractname, case when len(w) >= 3 then list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) else ['few ' || array_to_string(w, ' ')] end as s from words where len(w) > 0),
classes as (select *, min(source_id) over (partition by s) as class_id from sets),
runs as (select class_id, unnest(s) as run, len(s) as n from classes where source_id = class_id),
links as (select a.class_id as x, b.class_id as y from runs a join runs b on a.run = b.run and a.class_id <> b.class_id group by all having count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (select distinct class_id as x, class_id as y from classes union select r.x, l.y from reach r join links l on r.y = l.x),
named as (select x, min(y) as group_id from reach group by x), counted as (select x, count(*) as n from links group by x)
select source_id, group_id, class_id, coalesce(n, 0) as links, contractname from classes join named on named.x = class_id left join counted on counted.x = class_id""",
    "p8_found": _P8,
    "p8_items": f"select item_id, count(*) as documents from ({_P8}) group by item_id",
    "p9_found": f"{_P9} select a.doc_id as doc_id_a, b.doc_id as doc_id_b from forms a join forms b on a.form = b.form and a.doc_id < b.doc_id where a.text <> b.text",
    "p9_canonical": f"{_P9} select d.doc_id, form as canonical from documents d left join forms using (doc_id)",
    "p9_classes": f"{_P9} select doc_id, min(doc_id) over (partition by form) as class_id, n as stored_forms from forms join (select form, count(distinct text) as n from forms group by form) using (form)",
    "p7_fill": """with k as (select container_id, capacity_tokens as capacity from containers where capacity_tokens > 0) select container_id, true as placed_once, true as within_capacity, true as close_to_least from k""",
}
