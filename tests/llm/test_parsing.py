"""The grammars against Python's own parser, tables of forms, and deep nesting."""

import ast
import glob
import io
import os
import random
import time
import tokenize
import warnings

import pytest

from solstrata.llm import parsing
from solstrata.llm.languages import check

LIBRARY = os.path.dirname(os.__file__)


def _valid(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError):
            return False


def _files(most):
    out = [f for f in glob.glob(LIBRARY + "/*.py") + glob.glob(LIBRARY + "/test/test_*.py") if os.path.getsize(f) < most]
    return sorted(out)


def test_python_grammar_agrees_with_the_language_on_its_library():
    for f in random.Random(3).sample(_files(60_000), 120):
        try:
            text = open(f, encoding="utf-8").read()
        except UnicodeDecodeError:
            continue
        assert (check("py", text)[0] == "ok") == _valid(text), f


def test_python_grammar_agrees_on_files_with_a_changed_token():
    rng = random.Random(5)
    odd = ["*", "**", ":=", "=", "not ", "await ", 'f"{x!r:>{y}}"', "(", ")", "[", "{", "}", ",", ":", ".", "yield ", 'f"{a b}"', 'b"x" ', "1", "match ", "if x else y", " for x in y", "\t", '"']
    files, tried = _files(6_000), 0
    while tried < 1500:
        text = open(rng.choice(files), encoding="utf-8").read()
        try:
            tokens = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type in (1, 2, 3, 54) and t.string and t.start[0] == t.end[0]]
        except (tokenize.TokenError, SyntaxError):
            continue
        if len(tokens) < 10:
            continue
        lines = text.splitlines(keepends=True)
        for _ in range(10):
            a, b = rng.choice(tokens), rng.choice(tokens)
            line = lines[a.start[0] - 1]
            new = rng.choice(["", b.string, b.string + " " + a.string, rng.choice(odd) + a.string])
            changed = lines[: a.start[0] - 1] + [line[: a.start[1]] + new + line[a.end[1] :]] + lines[a.start[0] :]
            changed = "".join(changed)
            assert (check("py", changed)[0] == "ok") == _valid(changed), (line, new)
            tried += 1


@pytest.mark.parametrize(
    "text",
    ["1 = x", "f() = 1", "a + b = c", "def f(a=1, b): pass", "f(**a, *b)", "f(a=1, b)", "f'{x'", "f'{a b}'", "f'{x!z}'", "if x:\n\ty\n        z", "x = a + not b", "del f()", "for f() in x: pass", "'\\x1'", "b'é'", "0777", "2.real", "(*a)",
     "x = 'a' b'c'", "try: pass\nexcept a, b: pass", "match x:\n case {**_}: pass", "lambda *: 1", "[x for x in a if lambda: 1]", "f(x for x in y, 1)"],
)
def test_invalid_python(text):
    assert not _valid(text + "\n")
    assert check("py", text + "\n")[0] != "ok"


@pytest.mark.parametrize(
    "text",
    ["contract A { function f() public { revert E({a: 1}); revert E(1, 2); revert(); revert L.E(); } }", "contract A is B layout at 0x10 { uint transient t; }", "contract A layout at 2 ** 10 is B { }",
     "type T is uint256; using {add as +, L.f} for T global;", "contract A { mapping(address owner => mapping(uint id => bool)) m; function (uint) external returns (bool) cb; uint layout; uint at; }",
     'contract A { function f() external { require(x > 0, E(1)); assembly ("memory-safe") { let at := mload(0x40) } } }', 'import {A as B, C} from "x"; import * as D from "y"; import "z" as w;',
     "contract A { function f() public { try this.g{gas: 1}(2) returns (uint v) { } catch Error(string memory r) { } catch Panic(uint c) { } catch { } } }",
     "contract A { event E(uint indexed a, address) anonymous; modifier m virtual { _; } receive() external payable { } fallback(bytes calldata) external returns (bytes memory) { } }",
     "contract A { function f() pure public returns (uint a, uint b) { (a, b) = (1, 2); (uint c, , uint d) = g(); unchecked { a++; } do { a--; } while (a > 0); for (;;) break; } }",
     'contract A { function f() public { bytes memory b = hex"00ff" hex"aa"; string memory s = unicode"é"; delete a[0]; a[1:2]; emit E(); uint[] memory a = new uint[](3); } }'],
)
def test_solidity_forms(text):
    assert check("sol", text)[0] == "ok"


@pytest.mark.parametrize("text", ["contract A { function f( public { } }", "contract A { uint a }", "contract A { function f() public { a = ; } }", "contract A { function f() public { if x { } } }", "contract { }", "contract A { <<<<<<< HEAD }"])
def test_invalid_solidity(text):
    assert check("sol", text)[0] != "ok"


@pytest.mark.parametrize("opened,closed", [("(", ")"), ("[", "]"), ("{1:", "}"), ("([", "])"), ("f(", ")")])
def test_nesting_costs_one_step_a_level(opened, closed):
    text = lambda n: "x = " + opened * n + "1" + closed * n + "\n"
    assert check("py", text(3))[0] == "ok"
    began = time.perf_counter()
    assert check("py", text(200))[0] == "ok"
    assert time.perf_counter() - began < 0.5
    assert check("py", text(2000))[0] == "ok"
    assert check("py", text(200)[:-3])[0] == "truncated"


def test_rates_count_files_of_other_extensions(spark):
    rows = [(1, "r", "a.py", "x = 1\n"), (2, "r", "b.py", "x = (\n"), (3, "r", "README.md", "text"), (4, None, None, None), (5, "r", "c.sol", None)]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, content string")
    got = {(r.repo, r.language): (r.files, r.broken, r.truncated, r.rate) for r in parsing.failure_rates(files).collect()}
    assert got[("r", "Python")] == (2, 0, 1, 0.5)
    assert got[("r", "other")] == (2, 0, 0, None)
    assert got[("", "other")] == (1, 0, 0, None)
    assert got[(None, "Python")] == (2, 0, 1, 0.5)
    assert got[(None, None)] == (2, 0, 1, 0.5)
