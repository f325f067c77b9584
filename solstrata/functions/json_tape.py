"""Structure of many JSON texts at once, from the buffers of an Arrow string array.

A tape lists the structural characters of all texts of a batch. Depths come from one running sum and
containers from one sorted search, so no text is parsed row by row and nesting may be of any depth.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from solstrata.functions.arrow_batches import text_buffer

_OPEN, _CLOSE, _COMMA, _COLON = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _c in b"{[":
    _KIND[_c] = _OPEN
for _c in b"}]":
    _KIND[_c] = _CLOSE
_KIND[ord(",")] = _COMMA
_KIND[ord(":")] = _COLON
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


class JsonTape:
    """Tape of readable JSON texts; texts must have been checked (see `readable`), nulls removed.

    Openers are numbered in order of position: `open_pos`, `open_doc`, `open_is_list`, `container` (the
    opener around it, -1 for a root), `open_key` (number of the colon naming it, -1 in a list) and `ordinal`
    (its place among the elements of a list). Colons: `colon_container` and `key_span`.
    """

    def __init__(self, texts: pa.Array):
        body, offsets = text_buffer(texts)
        self.body, self.offsets, self.n_docs = body, offsets, len(texts)
        n = len(body)
        quote = body == ord('"')
        slash = body == ord("\\")
        if slash.any():
            at = np.arange(n)
            last_plain = np.maximum.accumulate(np.where(slash, -1, at))
            q = np.flatnonzero(quote)
            before = np.where(q > 0, q - 1 - last_plain[np.maximum(q - 1, 0)], 0)
            self.quotes = q[before % 2 == 0]
            quote = np.zeros(n, bool)
            quote[self.quotes] = True
        else:
            self.quotes = np.flatnonzero(quote)
        kind = _KIND[body]
        inside = np.logical_xor.accumulate(quote) if n else quote
        kind[inside] = 0
        self.tape = tape = np.flatnonzero(kind)
        kind = kind[tape]
        is_open, is_close = kind == _OPEN, kind == _CLOSE
        depth = np.cumsum(is_open.astype(np.int64) - is_close)
        span = n + 1
        opens = np.flatnonzero(is_open)
        self.open_pos = tape[opens]
        self.open_is_list = body[self.open_pos] == ord("[")
        self.open_doc = np.searchsorted(offsets, self.open_pos, side="right") - 1
        open_depth = depth[opens]
        by_depth = np.argsort(open_depth, kind="stable")
        ladder = open_depth[by_depth] * span + self.open_pos[by_depth]

        def around(level: np.ndarray, pos: np.ndarray) -> np.ndarray:
            k = np.searchsorted(ladder, level * span + pos, side="left") - 1
            found = by_depth[np.maximum(k, 0)] if len(by_depth) else np.zeros(len(pos), np.int64)
            return np.where(level > 0, found, -1)

        self.container = around(open_depth - 1, self.open_pos)
        commas = np.flatnonzero(kind == _COMMA)
        comma_in = around(depth[commas], tape[commas])
        order = np.lexsort((tape[commas], comma_in))
        self._comma_key = comma_in[order] * span + tape[commas][order]
        self._span = span
        colons = np.flatnonzero(kind == _COLON)
        self.colon_pos = tape[colons]
        self.colon_container = around(depth[colons], self.colon_pos)
        k = np.searchsorted(self.quotes, self.colon_pos) - 1
        self.key_start, self.key_end = self.quotes[k - 1] + 1, self.quotes[k]
        before = opens - 1
        named = (before >= 0) & (kind[np.maximum(before, 0)] == _COLON) & (self.container >= 0)
        colon_of = np.full(len(tape), -1)
        colon_of[colons] = np.arange(len(colons))
        self.open_key = np.where(named, colon_of[np.maximum(before, 0)], -1)
        closes = np.flatnonzero(is_close)
        close_of = around(depth[closes] + 1, tape[closes])
        self.close_pos = np.zeros(len(opens), np.int64)
        self.close_pos[close_of] = tape[closes]
        self.ordinal = self._commas_before(self.container, self.open_pos)
        self.single_root = self._single_root(open_depth)

    def _commas_before(self, container: np.ndarray, pos: np.ndarray) -> np.ndarray:
        base = container * self._span
        return np.searchsorted(self._comma_key, base + pos) - np.searchsorted(self._comma_key, base)

    def _single_root(self, open_depth: np.ndarray) -> np.ndarray:
        """Texts that are one object or list and nothing else but white space."""
        roots = np.flatnonzero(open_depth == 1)
        count = np.bincount(self.open_doc[roots], minlength=self.n_docs)
        ok = count == 1
        solid = np.concatenate([[0], np.cumsum(~_BLANK[self.body])])
        first = np.zeros(self.n_docs, np.int64)
        last = np.zeros(self.n_docs, np.int64)
        first[self.open_doc[roots]] = self.open_pos[roots]
        last[self.open_doc[roots]] = self.close_pos[roots] + 1
        outside = solid[np.minimum(first, len(self.body))] - solid[self.offsets[:-1]] + solid[self.offsets[1:]] - solid[np.minimum(last, len(self.body))]
        return ok & (outside == 0)

    def colons_named(self, name: str) -> np.ndarray:
        """Numbers of the colons whose key is `name`; keys with escapes are decoded one by one."""
        want = np.frombuffer(name.encode(), np.uint8)
        hit = np.flatnonzero(self.key_end - self.key_start == len(want))
        for i, byte in enumerate(want):
            hit = hit[self.body[self.key_start[hit] + i] == byte]
        escaped = self._escaped_keys()
        if len(escaped):
            more = [i for i in escaped if json.loads(b'"' + self.body[self.key_start[i] : self.key_end[i]].tobytes() + b'"') == name]
            hit = np.union1d(hit, np.asarray(more, np.int64)).astype(np.int64)
        return hit

    def _escaped_keys(self) -> np.ndarray:
        slashes = np.flatnonzero(self.body == ord("\\"))
        if not len(slashes):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.searchsorted(slashes, self.key_start) < np.searchsorted(slashes, self.key_end))

    def lists_named(self, name: str) -> np.ndarray:
        """Numbers of the list openers that are the value of a key `name`."""
        keyed = np.flatnonzero((self.open_key >= 0) & self.open_is_list)
        return keyed[np.isin(self.open_key[keyed], self.colons_named(name))]

    def list_lengths(self, lists: np.ndarray) -> np.ndarray:
        """Elements of each list, null elements and scalars included."""
        start, end = self.open_pos[lists] + 1, self.close_pos[lists]
        solid = np.concatenate([[0], np.cumsum(~_BLANK[self.body])])
        filled = solid[end] - solid[start] > 0
        key = lists * self._span
        commas = np.searchsorted(self._comma_key, key + self._span) - np.searchsorted(self._comma_key, key)
        return np.where(filled, commas + 1, 0)

    def scalars(self, colons: np.ndarray) -> pa.LargeStringArray:
        """Scalar values after the given colons as text; strings without their quotes, null for null and nested ones.

        The values are cut out of the buffer together; only strings with escapes are decoded one by one.
        """
        if not len(colons):
            return pa.array([], pa.large_string())
        solid = np.flatnonzero(~_BLANK[self.body])
        start = solid[np.searchsorted(solid, self.colon_pos[colons] + 1)]
        head = self.body[start]
        quoted, nested = head == ord('"'), (head == ord("{")) | (head == ord("["))
        stop = self.tape[np.minimum(np.searchsorted(self.tape, start), len(self.tape) - 1)]
        end = solid[np.searchsorted(solid, stop) - 1] + 1  # without the blanks before what follows
        k = np.searchsorted(self.quotes, start[quoted])
        start, end = start.copy(), end.copy()
        start[quoted] += 1
        end[quoted] = self.quotes[k + 1]
        end[nested] = start[nested]
        size = end - start
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.body[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        null = nested | (~quoted & (head == ord("n")))
        valid = pa.array(~null)
        texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)), valid.buffers()[1])
        slashes = np.flatnonzero(self.body == ord("\\"))
        escaped = np.flatnonzero(quoted & (np.searchsorted(slashes, start) < np.searchsorted(slashes, end)))
        if len(escaped):
            plain = [json.loads(b'"' + self.body[start[i] : end[i]].tobytes() + b'"') for i in escaped.tolist()]
            mask = np.zeros(len(size), bool)
            mask[escaped] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([p.encode("utf-8", "replace").decode() for p in plain], pa.large_string()))
        return texts

    def enclosing(self, chosen: np.ndarray) -> np.ndarray:
        """For each opener the nearest opener around it that is chosen, -1 if there is none.

        Openers are the children lists of their containers: list offsets count them, the parent-index kernel names their parents,
        and what is known of the parents is taken for the children, level after level.
        """
        n = len(self.open_pos)
        held = np.flatnonzero(self.container >= 0)
        order = held[np.argsort(self.container[held], kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(self.container[held], minlength=n))]).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(order, pa.int64()))
        parent = pc.list_parent_indices(lists).to_numpy()
        nearest = np.full(n, -1, np.int64)
        level = np.flatnonzero(self.container < 0)
        begin, size = offsets[:-1], np.diff(offsets)
        while len(level):
            kids = size[level]
            at = np.repeat(begin[level] - (np.cumsum(kids) - kids), kids) + np.arange(kids.sum())
            up, level = parent[at], order[at]
            nearest[level] = np.where(chosen[up], up, nearest[up])
        return nearest


def sound_rows(texts: pa.Array) -> np.ndarray:
    """Which texts can go on a tape: even quotes, balanced brackets, no raw control or single quote where none may be.

    A grammar check on the JVM side comes first; it lets single quotes and control characters pass, which this stops.
    """
    body, offsets = text_buffer(texts)
    n, docs = len(body), len(texts)
    if not n:
        return np.zeros(docs, bool)
    quote = body == ord('"')
    slash = body == ord("\\")
    if slash.any():
        at = np.arange(n)
        last_plain = np.maximum.accumulate(np.where(slash, -1, at))
        q = np.flatnonzero(quote)
        odd = (np.where(q > 0, q - 1 - last_plain[np.maximum(q - 1, 0)], 0) % 2) == 1
        quote[q[odd]] = False
    count = np.concatenate([[0], np.cumsum(quote)])
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    inside = (count[1:] - count[offsets[:-1]][doc]) % 2 == 1
    bad_char = np.where(inside, body < 32, body == ord("'"))
    kind = _KIND[body]
    step = np.where(inside, 0, (kind == _OPEN).astype(np.int64) - (kind == _CLOSE))

    def total(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x)])
        return run[offsets[1:]] - run[offsets[:-1]]

    return (total(quote) % 2 == 0) & (total(step) == 0) & (total(bad_char) == 0)


def sound_tape(batch: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, JsonTape | None]:
    """The rows of `batch` whose text is one sound JSON object or list, and their tape."""
    ok = sound_rows(batch.column(column))
    if not ok.all():
        batch = batch.filter(pa.array(ok))
    while batch.num_rows:
        tape = JsonTape(batch.column(column))
        if tape.single_root.all():
            return batch, tape
        batch = batch.filter(pa.array(tape.single_root))
    return batch, None
