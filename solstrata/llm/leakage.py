"""Evaluation texts that occur, whole or in part, in documents.

Q-gram lemma filtering: if a passage of w characters occurs with at most k edits, it shares at least
w + 1 - (k + 1) q of its character q-grams with the document, and they lie in a band of diagonals.

(1) One scan of the documents keeps the regions dense enough in q-grams known from any item. It needs a bitmap of the items'
q-grams only, of FILTER_BITS at most, whatever the items; a full one lets more regions pass and loses none. (2) The regions, a
small part of the corpus, meet the q-gram index of the items block after block: hits are counted in overlapping bands of
diagonals per document and item, and bands below the bound are discarded. (3) What is left is verified by alignment within the band.

Texts are compared as their words in the consistent form of `canonical`, in lower case, joined by single spaces. Items that
are equal in this form are looked for once. Nothing is shuffled but the items, so no repo or item can be too hot.

Defined results: null and empty texts share nothing; a document and an item give one row however often they match;
items with fewer words than asked for cannot be found; rows without id are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.functions.arrow_batches import byte_slices, text_buffer
from solstrata.llm.canonical import connection, in_duckdb, run_sql, words_sql
from solstrata.operators.snapshots import small_side
from solstrata.session import materialize

Q = 16
#: Bytes of item text in one block, whose index (about 25 times that) every executor holds while the block is looked for.
BLOCK_BYTES = 4 << 20
#: Most bits of the bitmap of all items' q-grams, by power of two (16 MB).
FILTER_BITS = 27
#: Hits looked at together.
HITS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def q_gram_hashes(body: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q = 16 bytes that begin at each position (shorter by Q - 1 than body)."""
    if len(body) < Q:
        return np.zeros(0, np.uint64)
    word = np.zeros(len(body) - 7, np.uint64)
    for i in range(8):
        word |= body[i : len(body) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    h = word[:-8] * _MIX
    h ^= h >> np.uint64(29)
    h += word[8:] * _MIX2
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h


def whole_q_grams(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the q-grams that begin at `at` lie in one text, that is have no NUL in them."""
    cuts = np.flatnonzero(body == 0)
    return np.searchsorted(cuts, at) == np.searchsorted(cuts, at + Q)


class QGramFilter:
    """A bitmap of the q-grams of all items: what it doesn't know is in no item."""

    def __init__(self, item_bytes: int):
        self.bits = min(FILTER_BITS, max(16, (16 * item_bytes).bit_length()))
        self.map = np.zeros(1 << (self.bits - 3), np.uint8)

    def add(self, text: str) -> None:
        at = q_gram_hashes(np.frombuffer(b" " + text.encode() + b" ", np.uint8)) >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.map, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def known(self, body: np.ndarray) -> np.ndarray:
        """Whether each q-gram of body is known; those that span two texts are not."""
        place = (q_gram_hashes(body) >> np.uint64(64 - self.bits)).astype(np.uint32)
        hit = ((self.map[place >> np.uint32(3)] >> (place & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).view(bool)
        at = np.flatnonzero(hit)
        hit[at[~whole_q_grams(body, at)]] = False
        return hit


class QGramIndex:
    """All q-grams of a block of items, with their places in the joined text of the items."""

    def __init__(self, item_ids: list[int], texts: list[str]):
        parts = [b" " + t.encode() + b" \x00" for t in texts]
        self.item_ids = np.array(item_ids, np.int64)
        self.starts = np.cumsum([0, *map(len, parts)])[:-1]
        self.body = np.frombuffer(b"".join(parts), np.uint8)
        hashes = q_gram_hashes(self.body)
        at = np.arange(len(hashes))
        at = at[whole_q_grams(self.body, at)]  # those that span two items are none
        order = np.argsort(hashes[at], kind="stable")
        self.places = at[order]
        self.hashes = hashes[at][order]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash is that of some item's q-gram."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def hits(self, at: np.ndarray, hashes: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, place in the items) of all places of the q-grams at the positions `at`, about HITS at a time.

        All hits of a stretch, which begins at the numbers `cut` of `at`, with one item come together: a stretch with too many hits is
        taken for one range of items after the other.
        """
        first, last = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        edges = np.concatenate([[0], cut, [len(at)]])
        size = np.concatenate([[0], np.cumsum(last - first)])
        begin = 0
        while begin < len(edges) - 1:
            end = max(begin + 1, int(np.searchsorted(size[edges], size[edges[begin]] + HITS, "right")) - 1)
            part = slice(int(edges[begin]), int(edges[end]))
            pos, lo, hi = at[part], first[part], last[part]
            many = -(-int((hi - lo).sum()) // HITS)
            bounds = [0, len(self.body)]
            if many > 1:
                bounds = [0, *np.unique(self.starts[np.searchsorted(self.starts, np.arange(1, many) * (len(self.body) // many)) - 1]).tolist(), len(self.body)]
            for x, y in zip(bounds[:-1], bounds[1:]):
                if y <= x:
                    continue
                a, b = lo, hi
                if many > 1:
                    a = np.array([i + np.searchsorted(self.places[i:j], x) for i, j in zip(lo.tolist(), hi.tolist())], np.int64)
                    b = np.array([i + np.searchsorted(self.places[i:j], y) for i, j in zip(lo.tolist(), hi.tolist())], np.int64)
                n = b - a
                if n.sum():
                    yield np.repeat(pos, n), self.places[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            begin = end


def bands(index: QGramIndex, offsets: np.ndarray, origin: np.ndarray, pos: np.ndarray, place: np.ndarray, edits: int, need: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(document number, item number, lowest diagonal, places) of the overlapping bands in which at least `need` different q-grams are hit.

    A band has 2 * (edits + 1) diagonals, and every diagonal lies in two of them, so edits + 1 neighbouring ones are always in one.
    Bands are cut by places in the document and in the item, whatever they are joined with; origin is where each text begins in its document.
    """
    step = edits + 1
    doc = np.searchsorted(offsets, pos, "right") - 1
    item = np.searchsorted(index.starts, place, "right") - 1
    shift = offsets[:-1] - origin
    low = (pos - shift[doc] - (place - index.starts[item])) // step
    band, doc, item, place = (np.concatenate(x) for x in ((low, low - 1), (doc, doc), (item, item), (place, place)))
    order = np.lexsort((place, band, item, doc))
    band, doc, item, place = band[order], doc[order], item[order], place[order]
    if not len(doc):
        return
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)]))
    end = np.append(begin[1:], len(doc))
    enough = end - begin >= need
    for g0, g1 in zip(begin[enough].tolist(), end[enough].tolist()):
        where = np.unique(place[g0:g1])
        if len(where) >= need:
            yield int(doc[g0]), int(item[g0]), int(band[g0]) * step + int(shift[doc[g0]]) - int(index.starts[item[g0]]), where


def least_edits(passages: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edits by which each passage (a row of w bytes) occurs in its window (a row of w + band - 1 bytes), both ends of it free.

    All rows are aligned at once: cell j of row i stands for the window's byte i + j, so only the diagonals of the band exist.
    """
    n, w = passages.shape
    band = windows.shape[1] - w + 1
    big = w + band
    before = np.zeros((n, band), np.int32)
    for i in range(w):
        now = before + (windows[:, i : i + band] != passages[:, i : i + 1])
        now[:, :-1] = np.minimum(now[:, :-1], before[:, 1:] + 1)
        for j in range(1, band):
            now[:, j] = np.minimum(now[:, j], now[:, j - 1] + 1)
        before = np.minimum(now, big)
    return before.min(axis=1)


def dense(known: np.ndarray, width: int, edits: int) -> np.ndarray:
    """Which q-grams lie in a stretch, as long as a passage can get, with as many known ones as the passage must share."""
    need = width + 1 - (edits + 1) * Q
    if need < 1:
        raise ValueError(f"with {edits} edits a passage of {width} bytes need not share a q-gram")
    reach = width + edits - Q + 1
    run = np.concatenate([[0], np.cumsum(known)])
    stop = np.minimum(np.arange(len(known)) + reach, len(known))
    full = np.flatnonzero(run[stop] - run[:-1] >= need)
    near = np.zeros(len(known) + 1, np.int64)
    np.add.at(near, full, 1)
    np.add.at(near, stop[full], -1)
    return np.cumsum(near[:-1]) > 0


def regions(index: QGramIndex, body: np.ndarray, offsets: np.ndarray, width: int, edits: int, origin: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document number, item number, place in item, place in document, edits): passages of `width` bytes, from the blank before
    a word, that occur with at most `edits` edits.

    Of neighbouring passages of one item and band the one with the fewest edits is kept, the first in item and document of several.
    """
    hashes = q_gram_hashes(body)
    known = index.known(hashes) & whole_q_grams(body, np.arange(len(hashes)))
    need, reach = width + 1 - (edits + 1) * Q, width + edits - Q + 1
    at = np.flatnonzero(known & dense(known, width, edits))
    found: dict[tuple[int, int, int], tuple[int, int, int, int, int]] = {}
    # no passage spans a gap in the hits that is longer than a passage, so stretches between gaps are looked at in turn
    for pos, place in index.hits(at, hashes, np.flatnonzero(np.diff(at) > reach + Q) + 1):
        _stretch(index, body, offsets, np.zeros(len(offsets) - 1, np.int64) if origin is None else origin, pos, place, width, edits, need, found)
    return sorted(found.values())


def _stretch(index: QGramIndex, body: np.ndarray, offsets: np.ndarray, origin: np.ndarray, pos: np.ndarray, place: np.ndarray, width: int, edits: int, need: int, found: dict) -> None:
    """Add to found the passages among the hits."""
    step = edits + 1
    todo = []
    ends = np.append(index.starts[1:], len(index.body)) if len(index.starts) else index.starts
    for d, it, lowest, where in bands(index, offsets, origin, pos, place, edits, need):
        i0, i1 = int(index.starts[it]), int(ends[it]) - 1
        starts = np.arange(max(i0, int(where[0]) + Q - width), min(int(where[-1]), i1 - width) + 1)
        starts = starts[index.body[starts] == 32]
        inside = np.searchsorted(where, starts + width - Q, "right") - np.searchsorted(where, starts, "left")
        starts = starts[inside >= need]
        todo.append((np.full(len(starts), d), np.full(len(starts), it), starts, np.full(len(starts), lowest)))
    if not todo:
        return
    d_all, it_all, s_all, low_all = (np.concatenate(x) for x in zip(*todo))
    for k0 in range(0, len(s_all), 4096):
        d, it, s, begin = (x[k0 : k0 + 4096] for x in (d_all, it_all, s_all, s_all + low_all))
        cells = begin[:, None] + np.arange(width + 2 * step - 1)
        ok = (cells >= offsets[d][:, None]) & (cells < offsets[d + 1][:, None])
        windows = np.where(ok, body[np.clip(cells, 0, len(body) - 1)], 255)  # 255 is in no text
        cost = least_edits(index.body[s[:, None] + np.arange(width)], windows)
        for k in np.flatnonzero(cost <= edits).tolist():
            at_item = int(s[k] - index.starts[it[k]])
            row = (int(d[k]), int(it[k]), at_item, int(max(begin[k], offsets[d[k]]) - offsets[d[k]]), int(cost[k]))
            key = (row[0], row[1], at_item // width)
            if key not in found or (row[4], row[2], row[3]) < (found[key][4], *found[key][2:4]):
                found[key] = row


def longest_word_run(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the longest run of whole equal words of two byte arrays aligned on one diagonal; spaces separate words."""
    same = a == b
    space = same & (a == 32)
    best = 0
    cut = np.flatnonzero(~same)
    bounds = np.concatenate([[-1], cut, [len(a)]])
    spaces = np.flatnonzero(space)
    per_run = np.searchsorted(spaces, bounds[1:]) - np.searchsorted(spaces, bounds[:-1])
    if len(per_run):
        best = int(per_run.max()) - 1  # n spaces inside a run of equal bytes enclose n - 1 whole words
    return max(best, 0)


def word_regions(known: np.ndarray, body: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of known q-grams begin and end that can hold a passage of min_words words."""
    width = 2 * min_words + 1  # characters of the shortest such passage with the blanks around it; with no edits all its q-grams are shared
    need = width - Q + 1
    if need < 1:
        raise ValueError(f"a passage of {min_words} words may be shorter than a q-gram")
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    spaces = np.concatenate([[0], np.cumsum(body == 32)])
    ok = (end - begin >= need) & (spaces[np.minimum(end + Q - 1, len(body))] - spaces[begin] > min_words)
    return begin[ok], end[ok]


def matches(index: QGramIndex, body: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, item number) for texts, joined in `body` with a NUL after each, with a shared run of min_words words.

    The edit budget is 0: of the q-grams that begin at the blank before a word of the passage, all but those of its last Q
    characters are shared on one diagonal, so bands with fewer are discarded; alignment without edits compares along a diagonal.
    """
    hashes = q_gram_hashes(body)
    begin, end = word_regions(index.known(hashes), body, min_words)
    word_start = np.flatnonzero(body[:-1] == 32)  # the q-gram from the blank before a word
    lo, hi = np.searchsorted(word_start, begin), np.searchsorted(word_start, end)
    n = hi - lo
    at = word_start[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    found: set[tuple[int, int]] = set()
    ends = np.append(index.starts[1:], len(index.body)) if len(index.starts) else index.starts
    for pos, place in index.hits(at, hashes, np.cumsum(n)[:-1]):
        for d, it, lowest, _ in bands(index, offsets, np.zeros(len(offsets) - 1, np.int64), pos, place, 0, max(1, min_words - Q // 2)):
            for diagonal in (lowest, lowest + 1):
                if (d, it) not in found:
                    a0, a1 = max(int(offsets[d]), int(index.starts[it]) + diagonal), min(int(offsets[d + 1]), int(ends[it]) + diagonal)
                    if a1 > a0 and longest_word_run(body[a0:a1], index.body[a0 - diagonal : a1 - diagonal]) >= min_words:
                        found.add((d, it))
    out = np.array(sorted(found), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def item_texts(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rep, words) of the items with words, one for equal ones, and (rep, item_id) of all: written tables."""
    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    words = in_duckdb(rows, f"select item_id, {words_sql('text')} as words from part", "text", "item_id bigint, words string").where("words <> ''")
    words = materialize(words.distinct().withColumn("digest", F.unhex(F.md5("words"))), "item-words")
    low = words.groupBy("digest").agg(F.min("item_id").alias("rep"))
    members = materialize(words.select("item_id", "digest").join(low, "digest").select("rep", "item_id"), "item-members")
    return materialize(words.join(members.where("rep = item_id").select("item_id"), "item_id", "left_semi").select(F.col("item_id").alias("rep"), "words"), "items"), members


_WORDS_OF_DOC = f"select doc_id, ' ' || {words_sql('text')} || ' ' || chr(0) as words from part"


def item_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[QGramIndex]:
    """Indexes of the items (rep, words), block after block; rows come to the driver one partition at a time."""
    ids, block, size = [], [], 0
    for row in texts.toLocalIterator():
        ids.append(row.rep)
        block.append(row.words)
        size += len(row.words)
        if size >= block_bytes:
            yield QGramIndex(ids, block)
            ids, block, size = [], [], 0
    if ids:
        yield QGramIndex(ids, block)


#: From what is known and the texts, where regions begin and end (in bytes).
Regions = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def dense_regions(docs: DataFrame, texts: DataFrame, where: Regions, doc_id: str, text: str) -> DataFrame:
    """(doc_id, at, words): the parts of the documents' words that can hold a passage of any item; at is where a part begins."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    seen = QGramFilter(texts.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0])
    for row in texts.toLocalIterator():
        seen.add(row.words)
    shared = spark.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                got = run_sql(con, _WORDS_OF_DOC, part).combine_chunks()
                if not got.num_rows:
                    continue
                body, offsets = text_buffer(got.column("words").chunk(0))
                begin, end = where(shared.value.known(body), body, offsets)
                doc = np.searchsorted(offsets, begin, "right") - 1
                held = [body[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([got.column("doc_id").chunk(0).take(pa.array(doc)), pa.array(begin - offsets[doc]), pa.array(held, pa.binary())], ["doc_id", "at", "words"])

    return materialize(rows.mapInArrow(run, "doc_id bigint, at bigint, words binary"), "dense-regions")


def _per_block(docs: DataFrame, items: DataFrame, where: Regions, find: Callable, schema: str, doc_id: str, text: str) -> DataFrame:
    """What `find(index, ids, places, body, offsets)` gives for the dense regions of the documents and each block of items."""
    spark = docs.sparkSession
    texts, members = item_texts(items)
    parts = dense_regions(docs, texts, where, doc_id, text)
    out = None
    for index in item_blocks(texts):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.column("words").to_pylist()
                size = np.cumsum([0, *(len(w) + 1 for w in held)])
                start = 0
                while start < len(held):  # about 4 MB of regions at a time
                    stop = max(start + 1, int(np.searchsorted(size, size[start] + (4 << 20), "right")) - 1)
                    body = np.frombuffer(b"".join(w + b"\x00" for w in held[start:stop]), np.uint8)
                    part = batch.slice(start, stop - start)
                    yield find(shared.value, part.column("doc_id"), part.column("at").to_numpy(), body, size[start : stop + 1] - size[start])
                    start = stop

        found = materialize(parts.mapInArrow(run, schema), "leaks")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema).withColumnRenamed("rep", "item_id")
    return out.join(small_side(members), "rep").drop("rep")


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents that share at least min_words consecutive words with an item."""

    def where(known: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = word_regions(known, body, min_words)
        return begin, end + Q - 1

    def find(index: QGramIndex, ids: pa.Array, places: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        d, i = matches(index, body, offsets, min_words)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(index.item_ids[i])], ["doc_id", "rep"])

    found = _per_block(docs, items, where, find, "doc_id bigint, rep bigint", doc_id, text)
    return found.select("doc_id", "item_id").distinct()


def leaked_passages(docs: DataFrame, items: DataFrame, width: int = 80, edits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_at, doc_at, edits): passages of `width` bytes of an item, from the blank before a word, that occur in a
    document with at most `edits` edits.

    Places are bytes in the words joined by single spaces; of passages that overlap the best per `width` bytes of the item is told.
    """
    room = 3 * edits + 2  # what a band reaches beyond a passage

    def where(known: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = dense(known, width, edits)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2] + Q - 1
        first, last = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, np.minimum(end, len(body)) - 1, "right") - 1
        n = last - first + 1
        doc = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin, end = np.maximum(np.repeat(begin, n) - room, offsets[doc]), np.minimum(np.repeat(end, n) + room, offsets[doc + 1] - 1)
        # regions of one document that now overlap are one
        if len(begin):
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (begin[1:] > np.maximum.accumulate(end)[:-1])])
            begin, end = begin[new], np.maximum.reduceat(end, np.flatnonzero(new))
        return begin, end

    def find(index: QGramIndex, ids: pa.Array, places: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        rows = np.array(regions(index, body, offsets, width, edits, places), np.int64).reshape(-1, 5)
        at = rows[:, 3] + places[rows[:, 0]]
        columns = [ids.take(pa.array(rows[:, 0])), pa.array(index.item_ids[rows[:, 1]]), *[pa.array(x.astype(np.int32)) for x in (rows[:, 2], at, rows[:, 4])]]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "rep", "item_at", "doc_at", "edits"])

    found = _per_block(docs, items, where, find, "doc_id bigint, rep bigint, item_at int, doc_at int, edits int", doc_id, text)
    # a document can have several regions with one item
    key = ["doc_id", "item_id", F.expr(f"item_at div {width}")]
    best = found.groupBy(*key[:2], key[2].alias("part")).agg(F.min(F.struct("edits", "item_at", "doc_at")).alias("m"))
    return best.select("doc_id", "item_id", "m.item_at", "m.doc_at", "m.edits")
