"""One consistent form for texts that look alike but differ in their characters.

The mapping is SQL that DuckDB runs inside each Arrow partition: invisible characters go, `nfc_normalize` composes
accents, `translate` maps full-width forms, non-breaking spaces and look-alike letters (mathematical alphabets and ligatures too) to plain ones, and
a second `nfc_normalize` composes what the translation made possible. Letter case, punctuation, line ends and ordinary
white space stay as they are.

Defined results: a null text has a null form; an empty text is its own form; joiners between emoji stay, for
without them the emoji looks different.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.functions.arrow_batches import byte_slices
from solstrata.session import materialize

# Letters of other scripts that look like a Latin letter, then that letter.
_LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j",
    "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "к": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "α": "a", "ρ": "p", "ι": "i", "υ": "u", "κ": "k", "γ": "y",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "ɡ": "g", "ɑ": "a", "Օ": "O", "Տ": "S", "Լ": "L",
}
# No-break space, figure space, narrow no-break space, ideographic space (the full-width form of a space).
_SPACES = "   　"
# Characters that show nothing. The joiner 200D is treated apart.
_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
_EMOJI = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
_HELD = ""


def _pairs() -> dict[str, str]:
    """Single characters to single characters: look-alikes, their accented forms, full-width forms, numerals that are one letter, and spaces."""
    out = dict(_LOOK_ALIKES) | {c: " " for c in _SPACES} | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in _LOOK_ALIKES:
            composed = unicodedata.normalize("NFC", _LOOK_ALIKES[base] + "".join(marks))
            if len(composed) == 1:
                out[chr(code)] = composed
    for code in [*range(0xFF65, 0xFF9E), *range(0xFFE0, 0xFFE7), *range(0x2160, 0x2180)]:
        folded = unicodedata.normalize("NFKC", chr(code))
        if len(folded) == 1:
            out[chr(code)] = folded
    return out


def _styled() -> dict[str, str]:
    """Letters and digits of the mathematical alphabets, and their plain look-alikes; few texts have any."""
    out = {}
    for code in range(0x1D400, 0x1D800):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain != chr(code):
            out[chr(code)] = _LOOK_ALIKES.get(plain, plain)
    return out


#: Ligatures, which look like the letters they join.
_LIGATURES = {chr(code): unicodedata.normalize("NFKC", chr(code)) for code in range(0xFB00, 0xFB07)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str) -> str:
    """DuckDB expression for the consistent form of a text column."""
    pairs = _pairs()
    joined = f"({_EMOJI})(\\x{{FE0F}}?)\\x{{200D}}({_EMOJI})"
    held = column
    for _ in range(2):  # matches don't overlap, so chains of joined emoji need a second pass
        held = f"regexp_replace({held}, '{joined}', '\\1\\2{_HELD}\\3', 'g')"
    shown = f"replace(regexp_replace({held}, '{_INVISIBLE}', '', 'g'), '{_HELD}', chr(8205))"
    styled = _styled()
    plain = f"translate({shown}, {_quoted(''.join(styled))}, {_quoted(''.join(styled.values()))})"
    for joined, letters in _LIGATURES.items():
        plain = f"replace({plain}, {_quoted(joined)}, {_quoted(letters)})"
    rare = f"case when regexp_matches({column}, '[\\x{{FB00}}-\\x{{FB06}}\\x{{1D400}}-\\x{{1D7FF}}]') then {plain} else {shown} end"
    return f"nfc_normalize(translate(nfc_normalize({rare}), {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))}))"


def words_sql(column: str) -> str:
    """DuckDB expression for the words of a text in consistent form and lower case, joined by single spaces."""
    return f"trim(regexp_replace(lower({canonical_sql(column)}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
    con.execute("set preserve_insertion_order = true")
    return con


def run_sql(con, sql: str, batch: pa.RecordBatch) -> pa.Table:
    con.register("part", pa.Table.from_batches([batch]))
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        con.unregister("part")


def in_duckdb(df: DataFrame, sql: str, text: str, schema: str) -> DataFrame:
    """Run `sql` over table `part` for runs of rows of each partition of df; the SQL must work row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in batches:
            for part in byte_slices(batch, text):
                yield from run_sql(con, sql, part).to_batches()

    return df.mapInArrow(run, schema)


def canonical_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, canonical): the consistent form of every text."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return in_duckdb(rows, f"select doc_id, {canonical_sql('text')} as canonical from part", "text", "doc_id bigint, canonical string")


def look_alike_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stored, form): 128-bit digests of each text as stored and in consistent form; null texts are left out."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sql = f"select doc_id, unhex(md5(text)) as stored, unhex(md5({canonical_sql('text')})) as form from part"
    return in_duckdb(rows, sql, "text", "doc_id bigint, stored binary, form binary")


def look_alike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, stored_forms): one row per document; class_id is the least id that has the same form."""
    keys = materialize(look_alike_keys(docs, doc_id, text), "look-alike")
    classes = keys.groupBy("form", "stored").agg(F.min("doc_id").alias("low")).groupBy("form").agg(F.min("low").alias("class_id"), F.count("*").alias("stored_forms"))
    return keys.join(classes, "form").select("doc_id", "class_id", "stored_forms")


def look_alike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose stored texts differ but have the same consistent form.

    Exact copies are reduced to one class before anything is paired, so many copies of one text pair with nothing
    among themselves; a pair of different stored texts is then expanded to its documents, which are the result.
    """
    keys = materialize(look_alike_keys(docs, doc_id, text), "look-alike")
    stored = keys.groupBy("form", "stored").agg(F.count("*").alias("copies"))
    mixed = stored.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    stored = stored.join(mixed, "form").select("form", "stored")
    pairs = stored.withColumnRenamed("stored", "one").join(stored.withColumnRenamed("stored", "two"), "form").where("one < two").select("one", "two")
    members = keys.select("doc_id", "stored")
    both = pairs.join(members.select(F.col("stored").alias("one"), F.col("doc_id").alias("x")), "one").join(members.select(F.col("stored").alias("two"), F.col("doc_id").alias("y")), "two")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
