import json
import random
import time
import re
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from solstrata.llm import canonical, languages, leakage, licenses, packing, parsing
from solstrata.llm.derivatives import Grammar

DOCS = "doc_id bigint, text string, stored string, form string, words string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)], DOCS)


def test_look_alikes(spark):
    texts = ["Vault é 10", "Vａult e\u0301 １０", "V\u0430ult\u00a0é\u200b 10", "Vault e 10", None, "", "\u200d", "\u0451", "e\u0308", "\u0435\u0308", "👩\u200d💻 x", "👩💻 x", "Vault é 10", "x" * 300_000, "x" * 299_999 + "\u0445"]
    got = {tuple(r) for r in canonical.look_alike_pairs(docs(spark, texts)).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (1, 12), (2, 12), (5, 6), (7, 8), (7, 9), (8, 9), (13, 14)}
    classes = {r.doc_id: (r.class_id, r.stored_forms) for r in canonical.look_alike_classes(docs(spark, texts)).collect()}
    assert classes[12] == (0, 3) and classes[3] == (3, 1) and 4 not in classes
    forms = {r.doc_id: r.canonical for r in canonical.canonical_texts(docs(spark, texts)).collect()}
    assert forms[2] == "Vault é 10" and forms[4] is None and forms[10] == texts[10]
    assert canonical.look_alike_pairs(docs(spark, texts).limit(0)).count() == 0


def test_styled_letters_ligatures_and_numerals(spark):
    texts = ["office XV A", "o\ufb03ce XV A", "office \u2169\u2164 A", "\U0001d428\U0001d41f\U0001d41f\U0001d422\U0001d41c\U0001d41e XV \u13aa", "o\u00b2", "o2"]
    got = {r.doc_id: r.canonical for r in canonical.canonical_texts(docs(spark, texts)).collect()}
    assert {got[i] for i in range(4)} == {"office XV A"} and got[4] != got[5]


def test_many_copies_pair_only_with_other_texts(spark):
    texts = ["same text"] * 400 + ["same\u00a0text"]
    assert canonical.look_alike_pairs(docs(spark, texts)).count() == 400


def form(text):
    table = str.maketrans(canonical._pairs())
    text = re.sub("[\u00ad\u200b-\u200f\u2060\ufeff]", "", text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(table))


def test_leaks_match_brute_force(spark):
    rnd = random.Random(7)
    words = ["a", "I", "of", "vault", "owner", "é", "ｘ1", "transferred", "b2", "к"]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60))) for _ in range(25)] + [None, ""]
    texts = []
    for _ in range(150):
        t = [rnd.choice(words) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.5:
            w = (rnd.choice(items[:25])).split()
            at = rnd.randrange(len(w))
            t[len(t) // 2 : len(t) // 2] = w[at : at + rnd.choice([5, 11, 12, 13, 40])]
        texts.append((", " if rnd.random() < 0.3 else "\r\n").join(t).upper() if rnd.random() < 0.3 else " ".join(t))
    texts += [None, "", "z " * 50_000]
    split = lambda t: re.findall(r"[^\W_]+", form(t).lower())
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    by_item = {i: runs(split(t)) for i, t in enumerate(items) if t}
    want = {(d, i) for d, t in enumerate(texts) if t for i, r in by_item.items() if r & runs(split(t))}
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, suite string")
    got = [tuple(r) for r in leakage.leaked_items(docs(spark, texts), frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    sizes = [len(x.item_ids) for x in leakage.item_blocks(leakage.item_texts(frame)[0], block_bytes=200)]
    assert sum(sizes) == 25 and len(sizes) > 3
    assert leakage.leaked_items(docs(spark, texts), frame.limit(0)).count() == 0 and leakage.leaked_items(docs(spark, texts).limit(0), frame).count() == 0


def test_blocks_equal_items_and_hot_stretches_lose_nothing(spark, monkeypatch):
    rnd = random.Random(17)
    words = ["a", "of", "vault", "owner", "transferred"]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(12, 40))) for _ in range(40)]
    items += [i.upper() for i in items[:10]]
    texts = [" ".join(rnd.choice(words) for _ in range(30)) + " " + rnd.choice(items) + " x " + rnd.choice(items) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    whole = {tuple(r) for r in leakage.leaked_items(docs(spark, texts), frame).collect()}
    runs = lambda t: {tuple(w[i : i + 12]) for w in [t.lower().split()] for i in range(len(w) - 11)}
    assert whole == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if runs(t) & runs(x)}
    monkeypatch.setattr(leakage, "item_blocks", lambda texts, blocks=leakage.item_blocks: blocks(texts, 500))
    assert {tuple(r) for r in leakage.leaked_items(docs(spark, texts), frame).collect()} == whole
    index = leakage.QGramIndex(list(range(len(items))), [i.lower() for i in items])
    import pyarrow as pa

    body, offsets = leakage.text_buffer(pa.array([f" {t.lower()} \0" for t in texts]))
    found = [x.tolist() for x in leakage.matches(index, body, offsets, 12)]
    monkeypatch.setattr(leakage, "HITS", 50)
    assert [x.tolist() for x in leakage.matches(index, body, offsets, 12)] == found and set(zip(*found)) == whole


def test_passages_of_documents_match_brute_force(spark):
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9)))
    items = [" ".join(word() for _ in range(20)) for _ in range(5)]
    texts = []
    for _ in range(30):
        part = list(rnd.choice(items)[:110])
        for _ in range(rnd.randint(0, 5)):
            part[rnd.randrange(len(part))] = rnd.choice("xyz")
        texts.append(" ".join([" ".join(word() for _ in range(rnd.randint(0, 40))), "".join(part), " ".join(word() for _ in range(rnd.randint(0, 40)))]).strip())
    frame = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = leakage.leaked_passages(docs(spark, texts), frame, 52, 2).collect()
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            padded = f" {item} "
            if any(edits_within(padded[s : s + 52], f" {t} ") <= 2 for s in range(len(padded) - 51) if padded[s] == " "):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in rows} == want and want
    for r in rows:
        near = f" {texts[r.doc_id]} "[r.doc_at : r.doc_at + 52 + 8]
        assert edits_within(f" {items[r.item_id]} "[r.item_at : r.item_at + 52], near) == r.edits <= 2


def test_items_quoted_in_a_numbered_list_are_all_found(spark):
    items = [" ".join(f"{w}{i}" for w in "who may call the withdraw function of this vault after each deposit".split()) for i in range(4)]
    texts = [" ".join(f"{n} {t}" for n, t in enumerate(items, 1)), " 7 ".join(items[1:3])]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = sorted(tuple(r) for r in leakage.leaked_items(docs(spark, texts), frame).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2)]


def edits_within(passage, text):
    """Least edits by which a passage occurs anywhere in a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_passages_with_edits_match_brute_force():
    rnd = random.Random(11)
    letters = "abcdefghij klm"
    make = lambda n: re.sub(" +", " ", "".join(rnd.choice(letters) for _ in range(n))).strip()
    items = [make(rnd.randint(60, 120)) for _ in range(6)]
    texts = []
    for _ in range(24):
        item = rnd.choice(items)
        at = rnd.randrange(max(1, len(item) - 55))
        part = list(item[at : at + rnd.choice([30, 56, 60])])
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(part))
            rnd.choice([lambda: part.__setitem__(k, "x"), lambda: part.insert(k, "y"), lambda: part.pop(k)])()
        texts.append(make(rnd.randint(0, 40)) + "".join(part) + make(rnd.randint(0, 40)))
    index = leakage.QGramIndex(list(range(len(items))), items)
    import numpy as np
    import pyarrow as pa

    body, offsets = leakage.text_buffer(pa.array([f" {t} \0" for t in texts]))
    width, edits = 52, 2
    got = {(d, i) for d, i, *_ in leakage.regions(index, body, offsets, width, edits)}
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            padded = f" {item} "
            if any(edits_within(padded[s : s + width], f" {t} ") <= edits for s in range(len(padded) - width + 1) if padded[s] == " "):
                want.add((d, i))
    assert got == want and want
    assert leakage.least_edits(np.frombuffer(b"abcd", np.uint8)[None], np.frombuffer(b"xabzd", np.uint8)[None]).tolist() == [1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), min_size=1), st.integers(40, 90))
def test_histogram_is_placed_whole(histogram, capacity):
    placed = Counter()
    for pattern, packs in packing.pack_histogram(histogram, capacity):
        held = list(packing.pattern_items(pattern))
        assert sum(length * n for length, n in held) <= capacity and packs > 0
        for length, n in held:
            placed[length] += n * packs
    assert placed == Counter(histogram)


def test_packs_do_not_depend_on_settings_or_order(spark, data):
    counts = packing.materialize(packing.token_counts(spark.read.parquet(f"{data}/documents.parquet")), "counts")
    kinds = spark.read.parquet(f"{data}/containers.parquet")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in (4, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = packing.pack_documents(counts if n == 4 else counts.orderBy("n_tokens"), kinds)
            got.append({tuple(r) for r in rows.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1] == got[2] and got[0]


def test_a_large_capacity_is_packed_soon_and_well():
    rnd = random.Random(2)
    histogram = Counter(min(1_000_000, int(rnd.paretovariate(0.7) * 50)) for _ in range(300_000))
    began = time.perf_counter()
    packs = packing.pack_histogram(histogram, 1_000_000)
    assert time.perf_counter() - began < 10
    least = -(-sum(length * n for length, n in histogram.items()) // 1_000_000)
    assert sum(n for _, n in packs) <= 1.01 * least + 1


def test_many_kinds_of_container(spark):
    counts = spark.createDataFrame([(i, i % 9) for i in range(40)], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([(i, 8 + i % 3) for i in range(packing.CONTAINER_BLOCK + 3)], "container_id bigint, capacity_tokens int")
    got = Counter()
    for r in packing.pack_documents(counts, kinds).collect():
        got[r.container_id] += r.piece_tokens
    assert got == {i: sum(k % 9 for k in range(40)) for i in range(packing.CONTAINER_BLOCK + 3)}


def test_packing(spark):
    rnd = random.Random(1)
    sizes = [rnd.choice([1, 7, 7, 7, 30, 64, 65, 200]) for _ in range(500)] + [0, 640]
    counts = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, capacity string")
    kinds = spark.createDataFrame([(1, "s", 64), (2, "m", 1000), (3, "none", 0)], "container_id bigint, label string, capacity_tokens int")
    rows = packing.pack_documents(counts, kinds).collect()
    used, whole = Counter(), Counter()
    for r in rows:
        used[r.container_id, r.pack_id] += r.piece_tokens
        whole[r.container_id, r.doc_id] += r.piece_tokens
        assert r.piece_tokens == min({1: 64, 2: 1000}[r.container_id], sizes[r.doc_id] - r.piece_no * 64 * (r.container_id == 1))
    assert all(n <= {1: 64, 2: 1000}[c] for (c, _), n in used.items())
    assert whole == Counter({(c, i): n for c in (1, 2) for i, n in enumerate(sizes) if n})
    assert len([k for k in used if k[0] == 1]) <= 1.02 * sum(sizes) / 64 + 1
    assert packing.pack_documents(counts.limit(0), kinds).count() == 0
    texts = docs(spark, ["one two three", None, "", "word " * 3000])
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(texts).collect()} == {0: 3, 3: 3001}


@pytest.mark.parametrize("text,status", [
    ("", "ok"), ("pragma solidity ^0.8.0;\ncontract A { function f(uint a) public view returns (uint) { return a > 1 ? a : 2; } }", "ok"), ("contract A {", "truncated"),
    ("contract A { <<<<<<< HEAD\n}", "broken"), ("// ======= fine\ncontract A { string s = \"}\"; }", "ok"), ("contract A { function f() { (bool ok, ) = x.call{value: 1}(\"\"); } }", "ok"),
    ("contract A { uint a = 1 }", "broken"), ("/* open", "broken"), ("library L { using A for *; error E(uint); event V(address indexed a); struct S { uint a; } enum T { X, Y } }", "ok"),
    ("contract A { function f() external { assembly { let x := mload(0x40) if iszero(x) { revert(0, 0) } for { let i := 0 } lt(i, 2) { i := add(i, 1) } { } switch x case 0 { } default { } } } }", "ok"),
    ("contract A { function f() public { try b.c() returns (uint x) { } catch Error(string memory r) { } catch { } unchecked { i++; } for (uint i; i < 3; ++i) { } } }", "ok"),
])
def test_solidity(text, status):
    assert languages.check("sol", text)[0] == status


@pytest.mark.parametrize("text,status", [
    ("# @version 0.3.9\nx: public(uint256)\n\n@external\ndef f(a: uint256) -> bool:\n    assert a > 1, \"no\"\n    self.x += a\n    log E(a)\n    for i in range(3):\n        pass\n    return True\n", "ok"),
    ("event E:\n    a: uint256\nstruct S:\n    b: address\ninterface I:\n    def f(a: address) -> uint256: view\n", "ok"), ("@external\ndef f(a: uint256", "truncated"), ("contract A { }", "broken"),
    ("import os\n\nclass A:\n    pass\n", "broken"), ("@external\ndef f():\n    x: uint256 = 1\n  y: uint256 = 2\n", "broken"),
])
def test_vyper(text, status):
    assert languages.check("vy", text)[0] == status


PYTHON = [
    "x = 1\n", "def f(a, *b, c=1, **d) -> int:\n  return a if b else c\n", "class A(B, metaclass=C):\n    x: int = 3\n\n    @p\n    async def f(self):\n        async with a as b, c:\n            await d\n",
    "try:\n  pass\nexcept (A, B) as e:\n  raise X from e\nelse:\n  y\nfinally:\n  z\n", "[x for x in y if x]\n{a: b for a, b in c}\n{1, 2}\nlambda *a: (yield)\n", "if (n := f(x)) > 1: pass\nelif y: pass\nelse:\n  q\n",
    "match x:\n  case [1, *r] if r: pass\n  case A(b=2) | {'k': v}: pass\n  case _: pass\n", "f(*a, **k)[1:2, ::3].b\nprint(f'{x!r:>{w}}')\n", "from . import a as b, c\nimport x.y as z\nglobal q\ndel a[0], b.c\n",
    "x = (1,\n  2)\ny = [\n]\n", "def f(", "x = = 1\n", "  x = 1\n", "if x:\npass\n", "print 'x'\n", "x = '''a\nb'''\n", "x = 'a\n", "1abc\n", "a = b = c, *d = e\n", "while True:\n\tbreak\n", "<<<<<<< a\n", "x = 1;;\n", "return\n", "x: int\n", "assert a, b\n", "\\\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_agrees_with_its_own_parser(text):
    import ast

    try:
        ast.parse(text)
        sound = True
    except SyntaxError:
        sound = False
    assert (languages.check("py", text)[0] == "ok") == sound


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]",:0123456789.eE-+truefalsnl \n\\u', max_size=14))
def test_json_agrees_with_a_parser(text):
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
        sound = True
    except (ValueError, ZeroDivisionError):
        sound = False
    assert (languages.check("json", text)[0] == "ok") == sound


def test_deep_nesting_and_memo():
    deep = "[" * 3000
    assert languages.check("json", deep)[0] == "truncated" and languages.check("json", deep + "]" * 3000)[0] == "ok"
    g = Grammar({"file": "'a' file 'b' | 'c'?"}, "file")
    a, b, c = (g.token(x) for x in "abc")
    assert g.run([a, a, c, b, b]) is None and g.run([a, b, b]) == 2 and g.run([a]) == 1 and g.run([g.token("z")]) == 0


def test_flags_and_rates(spark):
    schema = "file_id bigint, repo string, file_path string, content string, ext string, status string"
    rows = [(1, "o/r", "./a.SOL", "contract A {", "x", "x"), (2, "o/r", "b.json", "{}", "x", "x"), (3, None, "c.json", "", "x", "x"), (4, "o/r", "d.txt", "{", "x", "x"), (5, "o/r", None, "{", "x", "x"), (6, "o/r", "e.py", None, "x", "x")]
    files = spark.createDataFrame(rows, schema)
    errors = spark.createDataFrame([("o/r", "/w/o/r/a.SOL", "parse"), ("o/r", "a.SOL", "parse"), ("o/r", "\\a.SOL", "late"), (None, "a", None)], "repo string, file string, error string")
    assert {r.file_id for r in parsing.broken_files(files).collect()} == {1, 3}
    flags = {r.file_id: (r.status, r.reports) for r in parsing.flagged_files(files, errors).collect()}
    assert flags == {1: ("truncated", 2), 3: ("truncated", 0)}
    rates = {(r.repo, r.language): (r.files, r.rate) for r in parsing.failure_rates(files).collect()}
    assert rates["o/r", "JSON"] == (1, 0.0) and rates[None, "JSON"] == (2, 0.5) and rates[None, None] == (3, round(2 / 3, 6))
    assert parsing.broken_files(files.limit(0)).count() == 0


@pytest.mark.parametrize("text,name", [
    ("MIT License (MIT)", ["MIT"]), ("GNU General Public License v3.0 (GNU GPLv3)", ["GPL-3.0"]), ("none", []), ("No License (None)", []), (None, []), ("", []), ("BSD 3-clause \"New\" (BSD-3-Clause)", ["BSD-3-Clause"]),
    ("The Unlicense (Unlicense)", ["Unlicense"]), ("unlicensed", ["UNLICENSED"]), ("GPL-2.0-or-later", ["GPL-2.0"]), ("Business Source License (BSL 1.1)", ["BUSL-1.1"]), ("LGPL-3.0+", ["LGPL-3.0"]),
])
def test_license_names(text, name):
    assert licenses.record_licenses("", text) == name


@pytest.mark.parametrize("source,names", [
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncontract A {}", ["Apache-2.0 OR MIT"]), ("/* SPDX-License-Identifier: GPL-3.0-only */", ["GPL-3.0"]), ("contract A {} // SPDX-License-Identifier: MIT", []),
    ("// SPDX-License-Identifier: SEE LICENSE IN LICENSE\n", []), ("/*\n This file is part of X.\n\n It may be used under the terms of\n the MIT license.\n*/", ["MIT"]),
    ("// prose about permits and limits\n\n// Licensed under Apache License, Version 2.0.\ncontract A { string s = \"GPL-3.0\"; }", ["Apache-2.0"]),
    ("/// Copyright 2021 some developers\n/// License: GNU Affero General Public License v3\n", ["AGPL-3.0"]), ("", []), ("// SPDX-License-Identifier: MIT WITH Some-exception", ["MIT"]),
    ("{{\"sources\": {\"a\": {\"content\": \"// SPDX-License-Identifier: MIT\\n\"}, \"b\": {\"content\": \"// SPDX-License-Identifier: MPL-2.0\\n\"}}}}", ["MIT", "MPL-2.0"]),
])
def test_license_headers(source, names):
    assert licenses.record_licenses(source, None) == names


@pytest.mark.parametrize("text,names", [
    ("// SPDX-License-Identifier: MIT\n// Licensed under the GPL-3.0\n", ["GPL-3.0", "MIT"]), ("/* SPDX-License-Identifier: MIT\n SPDX-License-Identifier: MPL-2.0 */", ["MIT", "MPL-2.0"]),
    ("// Licensed under MIT or Apache-2.0\n// Copyright x", ["Apache-2.0 OR MIT"]), ("// SPDX-License-Identifier: MIT\n// license: mit", ["MIT"]),
    ("// SPDX-License-Identifier: BUSL-1.1\n// Change License: GPL-2.0-or-later", ["BUSL-1.1"]), ("// SPDX-License-Identifier: LGPL-3.0\n", ["LGPL-3.0"]),
])
def test_all_licenses_of_one_comment(text, names):
    assert licenses.record_licenses(text, None) == names


@pytest.mark.parametrize("text,names", [
    ("# Tool\n\nSPDX-License-Identifier: MIT\n\nSome words. Parts were released under Apache 2.0.", ["Apache-2.0", "MIT"]), ("MIT License\n\nCopyright x\n\nApache License 2.0\n\nCopyright y", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: MIT OR\nApache-2.0\n", ["Apache-2.0 OR MIT"]), ("# Tool\n\nwords", []),
])
def test_all_licenses_of_one_file(text, names):
    assert licenses.file_licenses(text, "README.md") == names


WORDS = "this work of many authors comes with some further notes on where each part was taken from "
BSD = """Copyright (c) 2020, X. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""


@pytest.mark.parametrize("text,names", [
    (BSD.format(""), ["BSD-3-Clause"]), (BSD.format("3. All advertising materials mentioning features of this software must display an acknowledgement.\n\n"), []), (BSD[: BSD.index("{}")], []),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + WORDS * 90, ["Apache-2.0"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + WORDS * 90, ["GPL-2.0"]), ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + WORDS * 90, ["GPL-3.0"]),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + WORDS * 90, ["LGPL-3.0"]), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\n" + WORDS * 90, ["AGPL-3.0"]),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n" + WORDS * 90, ["MPL-2.0"]),
    ("Business Source License 1.1\n\nLicense text copyright (c) 2017 X. \"Business Source License\" is a trademark.\n\nParameters\n\nLicensor: Y\n\nChange License: GNU General Public License v2.0 or later\n\n"
     + WORDS * 90 + "\n1. To specify as the Change License the GPL Version 2.0 or any later version, or a license that is compatible", ["BUSL-1.1"]),
    ("# Tool\n\n" + WORDS * 20 + "\n\nReleased under the MIT license.\n\n" + WORDS * 20, ["MIT"]),
], ids=range(11))
def test_full_license_texts(text, names):
    assert licenses.file_licenses(text, "LICENSE") == names


@pytest.mark.parametrize("name,names", [("Apache-2.0", ["Apache-2.0"]), ("GPL-2", ["GPL-2.0"]), ("GPL-3", ["GPL-3.0"]), ("LGPL-3", ["LGPL-3.0"]), ("MPL-2.0", ["MPL-2.0"]), ("MPL-1.1", []), ("LGPL-2.1", [])])
def test_license_texts_of_the_system(name, names):
    from pathlib import Path

    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no such text here")
    assert licenses.file_licenses(path.read_text(), "LICENSE") == names


def test_long_header_blocks():
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    for kind, name in (("", "GPL-3.0"), ("Lesser ", "LGPL-3.0"), ("Affero ", "AGPL-3.0")):
        assert licenses.record_licenses(f"/* {WORDS * 9}\n{free.format(kind)}\n{WORDS * 9} */", None) == [name]
    assert licenses.record_licenses(f"/*\n * SPDX-License-Identifier: MPL-2.0\n * {WORDS * 9}\n */", None) == ["MPL-2.0"]
    assert licenses.record_licenses(f"/* {WORDS * 9} Licensed under Apache-2.0. {WORDS * 9} */", None) == ["Apache-2.0"]


def test_licenses_of_records_and_repositories(spark):
    schema = "source_id bigint, repo string, sourcecode string, licensetype string, name string, names string"
    rows = [(1, "r", "// SPDX-License-Identifier: MIT\n", "GPL-3.0"), (2, "r", "contract A {}", None), (3, None, None, " "), (4, "q", "", "mit"), (5, "p", "", None), (6, "both", "", None)]
    sources = spark.createDataFrame([(*r, "x", "x") for r in rows], schema)
    files = spark.createDataFrame([("r", "LICENSE", "Apache 2.0 license"), ("r", "package.json", '{"license": "Apache-2.0"}'), ("s", "README.md", "# Title\n\nwords"), ("both", "COPYING", "MIT License\n\nCopyright x"), ("both", "a", "SPDX-License-Identifier: MPL-2.0"), (None, "LICENSE", "MIT"), ("t", None, None)], "repo string, file_path string, content string")
    got = {(r.subject, r.subject_key): r.license for r in licenses.licenses(sources, files).collect()}
    assert got == {
        ("file", "1"): "CONFLICT", ("file", "2"): "Apache-2.0", ("file", "3"): "UNKNOWN", ("file", "4"): "MIT", ("file", "5"): "UNKNOWN", ("file", "6"): "CONFLICT", ("repo", "r"): "Apache-2.0",
        ("repo", "q"): "UNKNOWN", ("repo", "p"): "UNKNOWN", ("repo", "both"): "CONFLICT", ("repo", "s"): "UNKNOWN", ("repo", "t"): "UNKNOWN",
    }
    assert licenses.licenses(sources.limit(0), files.limit(0)).count() == 0


def test_queries(spark, data):
    from solstrata.llm import queries

    want = {"p2_found": ["source_id_a", "source_id_b"], "p4_found": ["file_id"], "p6_found": ["subject", "subject_key", "license"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id_a", "doc_id_b"]}
    for name, query in queries.QUERIES.items():
        df = query(spark, data)
        assert name not in want or df.columns == want[name]
        df.count()
