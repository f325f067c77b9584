"""Memoised parsing with derivatives.

A grammar is a graph of languages. The derivative of a language by a token is the language of what may follow that
token, so a text is valid if the last derivative contains the empty text. Languages are interned (equal ones are one number)
and derivatives memoised across texts, so parsing turns into a table lookup per token as soon as its shapes have been seen.

An empty derivative marks the exact token that cannot stand where it is; a last derivative without the empty text means that
the text ends too early. Grammars must not be left-recursive; ambiguity does no harm, since equal alternatives collapse and
common beginnings of alternatives are taken out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

EMPTY, EPSILON = 0, 1
#: Memoised derivatives and interned languages above which both are dropped and built anew.
MEMO_LIMIT = 400_000

_NOTATION = re.compile(r"\s*(?:'([^']+)'|([A-Z_]+)|([a-z][a-z0-9_]*)|([|()*+?]))")


class Grammar:
    """Languages built from rules in a small notation: 'x' and NAME are tokens, name a rule, | ( ) * + ? as usual."""

    def __init__(self, rules: dict[str, str], start: str):
        self.rule_texts, self.start_rule = rules, start
        self.tokens: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.nodes: list[tuple] = [("empty",), ("epsilon",)]
        self.interned: dict[tuple, int] = {("empty",): EMPTY, ("epsilon",): EPSILON}
        self.memo: dict[int, int] = {}
        self.nullables: dict[int, bool] = {EMPTY: False, EPSILON: True}
        self.rules: dict[str, int] = {}
        for name, text in self.rule_texts.items():
            self.rules[name] = self._parse(text)
        self._null_rules: set[str] = set()
        while True:
            more = {n for n, node in self.rules.items() if n not in self._null_rules and self._null(node)}
            if not more:
                break
            self._null_rules |= more
            self.nullables = {EMPTY: False, EPSILON: True}
        self.start = self.rules[self.start_rule]

    def token(self, kind: str) -> int:
        """Number of a kind of token; kinds no rule names get one too, and have an empty derivative everywhere."""
        return self.tokens.setdefault(kind, len(self.tokens))

    def _node(self, *shape) -> int:
        got = self.interned.get(shape)
        if got is None:
            got = self.interned[shape] = len(self.nodes)
            self.nodes.append(shape)
        return got

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPSILON:
            return b
        if b == EPSILON:
            return a
        shape = self.nodes[a]
        if shape[0] == "cat":
            return self.cat(shape[1], self.cat(shape[2], b))
        if shape[0] == "alt":
            return self.alt([self.cat(x, b) for x in shape[1:]])
        return self._node("cat", a, b)

    def alt(self, parts: Sequence[int]) -> int:
        flat: set[int] = set()
        for p in parts:
            shape = self.nodes[p]
            if shape[0] == "alt":
                flat.update(shape[1:])
            elif p != EMPTY:
                flat.add(p)
        if len(flat) > 1:
            flat = self._factored(flat)
        if len(flat) <= 1:
            return next(iter(flat), EMPTY)
        return self._node("alt", *sorted(flat))

    def _factored(self, parts: set[int]) -> set[int]:
        """The alternatives with common beginnings taken out: h x | h y | h is h (x | y | epsilon).

        Since no sequence begins with alternatives either (see cat), languages are tries, or stacks that share their lower parts:
        what begins alike is derived once, and nesting costs a step per level however many readings a beginning has.
        """
        tails: dict[int, list[int]] = {}
        for p in parts:
            shape = self.nodes[p]
            head, tail = (shape[1], shape[2]) if shape[0] == "cat" else (p, EPSILON)
            tails.setdefault(head, []).append(tail)
        if len(tails) == len(parts):
            return parts
        out: set[int] = set()
        for head, rest in tails.items():
            node = self.cat(head, self.alt(rest))
            shape = self.nodes[node]
            out.update(shape[1:] if shape[0] == "alt" else (node,))
        return out

    def star(self, a: int) -> int:
        return EPSILON if a in (EMPTY, EPSILON) else self._node("star", a)

    def _parse(self, text: str) -> int:
        words = [m.groups() for m in _NOTATION.finditer(text)]
        at = 0

        def choice() -> int:
            nonlocal at
            parts = [sequence()]
            while at < len(words) and words[at][3] == "|":
                at += 1
                parts.append(sequence())
            return self.alt(parts)

        def sequence() -> int:
            nonlocal at
            parts = []
            while at < len(words) and words[at][3] not in ("|", ")"):
                quoted, kind, rule, mark = words[at]
                at += 1
                if mark == "(":
                    node = choice()
                    at += 1
                elif rule:
                    node = self._node("rule", rule)
                else:
                    node = self._node("token", self.token(quoted or kind))
                while at < len(words) and words[at][3] in ("*", "+", "?"):
                    node = {"*": self.star, "+": lambda n: self.cat(n, self.star(n)), "?": lambda n: self.alt([n, EPSILON])}[words[at][3]](node)
                    at += 1
                parts.append(node)
            out = EPSILON
            for node in reversed(parts):
                out = self.cat(node, out)
            return out

        return choice()

    def _null(self, n: int) -> bool:
        kind, *rest = self.nodes[n]
        if kind == "cat":
            return self._null(rest[0]) and self.nullable(rest[1])
        if kind == "alt":
            return any(self.nullable(x) for x in rest)
        if kind == "rule":
            return rest[0] in self._null_rules
        return kind in ("star", "epsilon")

    def nullable(self, n: int) -> bool:
        got = self.nullables.get(n)
        if got is None:
            got = self.nullables[n] = self._null(n)
        return got

    def derive(self, n: int, t: int) -> int:
        key = n << 10 | t
        got = self.memo.get(key)
        if got is None:
            got = self.memo[key] = self._derive(n, t)
        return got

    def _derive(self, n: int, t: int) -> int:
        shape = self.nodes[n]
        kind = shape[0]
        if kind == "token":
            return EPSILON if shape[1] == t else EMPTY
        if kind == "cat":
            first = self.cat(self.derive(shape[1], t), shape[2])
            return self.alt([first, self.derive(shape[2], t)]) if self.nullable(shape[1]) else first
        if kind == "alt":
            return self.alt([self.derive(x, t) for x in shape[1:]])
        if kind == "star":
            return self.cat(self.derive(shape[1], t), n)
        if kind == "rule":
            return self.derive(self.rules[shape[1]], t)
        return EMPTY

    def run(self, tokens: Sequence[int]) -> int | None:
        """None if the tokens are a text of the language; the number of the failing token, or len(tokens) if more must follow."""
        if len(self.memo) > MEMO_LIMIT or len(self.nodes) > MEMO_LIMIT:
            self._reset()
        memo, derive, state = self.memo, self.derive, self.start
        for i, t in enumerate(tokens):
            now = memo.get(state << 10 | t)
            if now is None:
                now = derive(state, t)
            if now == EMPTY:
                return i
            state = now
        return None if self.nullable(state) else len(tokens)
