"""The license of each code file and repository.

Templates with optional and replaceable sections are compiled into backtracking grammars and matched against the
complete text of a comment or license file. In a template, `[...]` is optional, `(a|b)` a choice, `<n>` stands for at most
n words that may be anything, `<*>` for any number of them, `<but x>` likewise but without the words x, and `{spdx}` for a license expression, the name of a license at
least. All ways in which a text matches count, so a text can name several licenses. What the templates find is then
aggregated: names that differ are a conflict, no name leaves the next source of evidence to decide.

Defined results: a record has what its header comments and its license field name; if these name nothing, what
its repository has; without repository UNKNOWN. Null and empty fields name nothing. Records without id and license files without
repository are left out. Header comments are those before the first code of each file; later comments and string
constants say nothing about the license.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstrata.functions.arrow_batches import byte_slices
from solstrata.operators.snapshots import small_side
from solstrata.session import materialize

CONFLICT, UNKNOWN = "CONFLICT", "UNKNOWN"

# How licenses are named, as templates in lower case without commas, quotes and full stops at the end.
_NAMES: dict[str, list[str]] = {
    "MIT": ["[the ](mit|m.i.t.|expat)[( |-)(license|licence)]"],
    "Apache-2.0": ["[the ]apache[ software][( |-)(license|licence)][( |-)(version|v)]( |-|)(2|2.0)[ (license|licence)]"],
    "GPL-2.0": ["[the ]{gpl}{v2}"],
    "GPL-3.0": ["[the ]{gpl}{v3}"],
    "LGPL-3.0": ["[the ]{lgpl}{v3}"],
    "AGPL-3.0": ["[the ]{agpl}{v3}"],
    "BSD-3-Clause": ["[the ](bsd( |-)3( |-)clause|3( |-)clause bsd|(new|modified|revised) bsd)[ (new|revised)][ or (new|revised)][ (license|licence)]"],
    "MPL-2.0": ["[the ](mozilla public (license|licence)|mpl)( |-|)[(version|v|v.)][ ](2|2.0)"],
    "BUSL-1.1": ["[the ](business source (license|licence)|busl|bsl)[( |-)][(version|v|v.)][ ][1.1]"],
    "Unlicense": ["[the ]unlicense"],
    "UNLICENSED": ["unlicensed"],
}
_PARTS = {
    "gpl": "[gnu ](general public (license|licence)|gpl)",
    "lgpl": "[gnu ](lesser general public (license|licence)|lgpl)",
    "agpl": "[gnu ](affero general public (license|licence)|agpl)",
    "v2": "[( |-)][(version|v|v.)][ ](2|2.0)[(-only|-or-later|+| only| or later| or any later version)]",
    "v3": "[( |-)][(version|v|v.)][ ](3|3.0)[(-only|-or-later|+| only| or later| or any later version)]",
}
# What header comments and license files look like. Matched completely, after cleaning.
_TEMPLATES = [
    "[<*> ]spdx-license-identifier[ ]:[ ]{spdx}[ <*>]",
    "[<*> ](licensed|released|distributed|published|offered|available|provided|used) under [the terms of ][either ][of ]{spdx}[ <*>]",
    "[<*> ]under the terms of [either ][of ]{spdx}[ <*>]",
    "[<*> ][@custom:](license|licence)[ ]:[ ]{spdx}[ <*>]",
    "[<*> ]@custom:(license|licence) {spdx}[ <*>]",
    "[<*> ](license|licence) {spdx}[ <*>]",
    "[<*> ]permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files[ <*>]{=MIT}",
    "[<*> ]this is free and unencumbered software released into the public domain[ <*>]{=Unlicense}",
    "[<*> ]this source code form is subject to the terms of the mozilla public license v. 2.0[ <*>]{=MPL-2.0}",
    "[<*> ]redistribution and use in source and binary forms <but advertising materials> (neither the name of|the name of the author may not be used|the names of the contributors may not be used)[ <*>]{=BSD-3-Clause}",
    "[<*> ](redistribute it and/or modify it|it) under the terms of the gnu general public (license|licence) as published by the free software foundation[ either] version 2 of the (license|licence)[ <*>]{=GPL-2.0}",
    "[<*> ](redistribute it and/or modify it|it) under the terms of the gnu general public (license|licence) as published by the free software foundation[ either] version 3 of the (license|licence)[ <*>]{=GPL-3.0}",
    "[<*> ](redistribute it and/or modify it|it) under the terms of the gnu lesser general public (license|licence) as published by the free software foundation[ either] version 3 of the (license|licence)[ <*>]{=LGPL-3.0}",
    "[<*> ](redistribute it and/or modify it|it) under the terms of the gnu affero general public (license|licence) as published by the free software foundation[ either] version 3 of the (license|licence)[ <*>]{=AGPL-3.0}",
    # heads of the full texts
    "[<*> ]gnu general public license version 2 june 1991[ <*>]{=GPL-2.0}",
    "[<*> ]gnu general public license version 3 29 june 2007[ <*>]{=GPL-3.0}",
    "[<*> ]gnu lesser general public license version 3 29 june 2007[ <*>]{=LGPL-3.0}",
    "[<*> ]gnu affero general public license version 3 19 november 2007[ <*>]{=AGPL-3.0}",
    "[<*> ]apache license version 2.0 january 2004[ <*>]{=Apache-2.0}",
    "[<*> ]mozilla public license[ version] 2.0[ <1>] 1 definitions[ <*>]{=MPL-2.0}",
    "[<*> ]business source license 1.1[ <1>] (license text copyright|parameters|licensor)[ <*>]{=BUSL-1.1}",
]
#: Matched against each paragraph.
_TITLE = "{spdx}[ copyright <*>]"
#: Words before a name that make it that of another license, or of one that holds later.
_NOT_AFTER = "(?<!change )"


def clean(text: str) -> str:
    """Lower case, one blank between words, without quotes, commas and the full stops that end sentences."""
    text = re.sub(r"[\"'`“”‘’]", "", text.lower())
    text = re.sub(r"[,;](?=\s|$)|\.(?=\s|$)(?<!\bv\.)(?<!m\.i\.t\.)", " ", text)
    return re.sub(r"\s+", " ", text).strip()


def compile_template(template: str, parts: dict[str, str]) -> str:
    """Pattern of a backtracking matcher for a template; parts are patterns by name."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c == "[":
            out.append("(?:")
        elif c == "]":
            out.append(")?")
        elif c == "(":
            out.append("(?:")
        elif c in ")|":
            out.append(c)
        elif c == "<":
            end = template.index(">", i)
            most = template[i + 1 : end]
            if most.startswith("but "):
                out.append(rf"(?:(?!{re.escape(most[4:])})\S+ )*?(?!{re.escape(most[4:])})\S+")
            else:
                out.append(r"\S+(?: \S+)*?" if most == "*" else rf"\S+(?: \S+){{0,{int(most) - 1}}}?")
            i = end
        elif c == "{":
            end = template.index("}", i)
            out.append(parts[template[i + 1 : end]])
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _anywhere(template: str, parts: dict[str, str]) -> re.Pattern:
    """Pattern whose every find is a complete match of a template: free outer sections only have to end at a blank."""
    inner = template.removeprefix("[<*> ]").removesuffix("[ <*>]")
    before = r"(?<!\S)" + _NOT_AFTER if template.startswith("[<*> ]") else r"\A"
    return re.compile(before + compile_template(inner, parts) + (r"(?!\S)" if template.endswith("[ <*>]") else r"\Z"))


@functools.lru_cache(maxsize=1)
def _grammars() -> tuple[list[tuple[str, re.Pattern]], list[tuple[re.Pattern, str | None]], re.Pattern]:
    parts = {k: compile_template(v, {}) for k, v in _PARTS.items()}
    names = [(spdx, "|".join(compile_template(t, parts) for t in texts)) for spdx, texts in _NAMES.items()]
    any_name = "(?:" + "|".join(f"(?:{p})" for _, p in names) + ")(?![\\w-])(?!\\.\\d)"
    held = {"spdx": rf"(?P<spdx>\(? ?{any_name}(?: with [\w.-]+)?(?: (?:or|and) {any_name}(?: with [\w.-]+)?)* ?\)?)"}
    templates: list[tuple[re.Pattern, str | None]] = []
    for text in _TEMPLATES:
        text, _, said = text.partition("{=")
        templates.append((_anywhere(text, held), said.rstrip("}") or None))
    return [(s, re.compile(p)) for s, p in names], templates, _anywhere(_TITLE, held)


def named(text: str) -> str | None:
    """The license a name stands for."""
    text = clean(text)
    for spdx, pattern in _grammars()[0]:
        if pattern.fullmatch(text):
            return spdx
    return None


def expression(text: str) -> frozenset[str]:
    """The licenses of an expression: one for a choice between them, several if all apply."""
    text = re.sub(r"[()]", " ", clean(text))
    out = set()
    for all_of in re.split(r"\s+and\s+", text):
        choice = sorted({n for part in re.split(r"\s+or\s+(?!(?:any )?later)", all_of) if (n := named(re.sub(r"\s+with\s+\S+", "", part)))})
        if choice:
            out.add(" OR ".join(choice))
    return frozenset(out)


#: Results by digest of the text, so that what is kept is small however long texts are; emptied when full.
_known: dict[bytes, frozenset[str]] = {}


def licenses_of_text(text: str) -> frozenset[str]:
    """Licenses that a comment or license file names, by all templates and wherever they match."""
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if digest not in _known:
        if len(_known) >= 50_000:
            _known.clear()
        _known[digest] = _licenses_of_text(text)
    return _known[digest]


def _licenses_of_text(text: str) -> frozenset[str]:
    _, templates, title = _grammars()
    cleaned = clean(text)
    out: set[str] = set()
    for pattern, said in templates:
        for m in pattern.finditer(cleaned):
            out |= {said} if said else expression(m["spdx"])
    for paragraph in re.split(r"(?:\r\n|\r|\n)\s*[\r\n]", text):
        if m := title.match(clean(paragraph)):
            out |= expression(m["spdx"])
    return frozenset(out)


_COMMENT = re.compile(r"(\s*)(//[^\n\r]*|/\*.*?\*/)", re.S)


def header_comments(source: str) -> list[str]:
    """Texts of the comments before the first code; neighbouring line comments are one text, blank lines part them."""
    out: list[str] = []
    pos, last_line = 1 if source.startswith("﻿") else 0, False
    while m := _COMMENT.match(source, pos):
        gap, body = m.groups()
        if body.startswith("//"):
            text = body.lstrip("/")
            if last_line and len(re.findall(r"\r\n|\r|\n", gap)) == 1:
                out[-1] += "\n" + text
            else:
                out.append(text)
            last_line = True
        else:
            out.append("\n".join(re.sub(r"^\s*\*+(?!/)", "", line) for line in body[2:-2].lstrip("*!").splitlines()))
            last_line = False
        pos = m.end()
    return out


def source_texts(sourcecode: str) -> Iterable[str]:
    """The files of a verified source: itself, or the contents of a compiler input, plain or in doubled braces."""
    text = sourcecode.strip()
    if text.startswith("{"):
        try:
            doc = json.loads(text[1:-1] if text.startswith("{{") else text)
            sources = doc.get("sources", doc)
            return [s["content"] for s in sources.values() if isinstance(s, dict) and isinstance(s.get("content"), str)]
        except (ValueError, AttributeError):
            pass
    return [sourcecode]


def record_licenses(sourcecode: str | None, licensetype: str | None) -> list[str]:
    found: set[str] = set()
    for source in source_texts(sourcecode or ""):
        for comment in header_comments(source):
            found |= licenses_of_text(comment)
    kind = clean(licensetype or "")
    outer = re.fullmatch(r"(.*?) ?\(([^()]*)\)", kind)
    for part in [kind] if outer is None else [outer[1], outer[2]]:
        if name := named(part):
            found.add(name)
            break
    else:
        found |= expression(kind)
    return sorted(found)


def file_licenses(content: str | None, path: str | None) -> list[str]:
    """What a license, readme or package file names."""
    text = content or ""
    if (path or "").lower().endswith(".json"):
        try:
            value = json.loads(text).get("license")
            if isinstance(value, dict):
                value = value.get("type")
            return sorted(expression(value)) if isinstance(value, str) else []
        except (ValueError, AttributeError):
            return []
    text = re.sub(r"^\s*[#*=>-]+\s*", "", text, flags=re.M)
    return sorted(licenses_of_text(text))


def _verdict(names: str) -> Column:
    return F.when(F.size(names) == 0, None).when(F.size(names) == 1, F.element_at(names, 1)).otherwise(CONFLICT)


def _named(df: DataFrame, texts: tuple[str, str], by: str) -> DataFrame:
    """df with an array column `names`: what `by` (record_licenses or file_licenses) finds in two text columns, which are dropped."""
    one, two = texts
    keep = [f for f in df.schema.fields if f.name not in texts]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", names array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = {"record": record_licenses, "file": file_licenses}[by]
        for batch in batches:
            for part in byte_slices(batch, one):
                names = [find(a, b) for a, b in zip(part.column(one).to_pylist(), part.column(two).to_pylist())]
                columns = [part.column(f.name) for f in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.list_(pa.string()))], [*[f.name for f in keep], "names"])

    return df.mapInArrow(run, schema)


def _file_named(df: DataFrame) -> DataFrame:
    return _named(df.select("repo", F.coalesce("content", F.lit("")).alias("content"), F.col("file_path").alias("path")), ("content", "path"), "file")


def repository_licenses(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, license) of every repository that has a source or a license file."""
    named_files = _file_named(files.where(F.col("repo").isNotNull())).select("repo", F.explode_outer("names").alias("name"))
    every = named_files.unionByName(sources.where(F.col("repo").isNotNull()).select("repo", F.lit(None).cast("string").alias("name")))
    sets = every.groupBy("repo").agg(F.collect_set("name").alias("names"))  # at most as many names as there are licenses
    return sets.select("repo", F.coalesce(_verdict("names"), F.lit(UNKNOWN)).alias("license"))


def licenses(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(subject, subject_key, license): subject file per record of sources, subject repo per repository."""
    repos = materialize(repository_licenses(sources, files), "repo-licenses")
    rows = sources.where(F.col("source_id").isNotNull()).select(F.col("source_id").cast("string").alias("key"), "repo", F.coalesce("sourcecode", F.lit("")).alias("sourcecode"), "licensetype")
    own = _named(rows, ("sourcecode", "licensetype"), "record").select("key", "repo", _verdict("names").alias("own"))
    both = own.join(small_side(repos), "repo", "left")
    found = both.select(F.lit("file").alias("subject"), F.col("key").alias("subject_key"), F.coalesce("own", "license", F.lit(UNKNOWN)).alias("license"))
    return found.unionByName(repos.select(F.lit("repo").alias("subject"), F.col("repo").alias("subject_key"), "license"))
