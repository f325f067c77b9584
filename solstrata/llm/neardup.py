"""Records whose texts differ by small edits, insertions or reordering.

A text is the set of its distinct runs of `k` words; two texts are alike if |common| / |union| reaches a
threshold. Equal sets are reduced to one representative first. Each representative gets a fingerprint of 256 bits (one
per min-wise hash) and a few band keys. Fingerprints with a common band key are put into Gray order, in which
neighbours differ in few bits, and a hierarchical index is built over that order: an upper node keeps the bits all
its fingerprints agree on (mask and pattern), so the differences between two nodes' shared patterns are a lower bound for all
pairs below, and whole groups are dropped as soon as the accumulated differences exceed the radius. What remains is
checked exactly on the sets.

Band keys are what makes the search scale: at the radius a likeness of 0.6 needs (about a third of the bits), Gray
order alone leaves every fingerprint within reach of every node, so a single index would look at all pairs.

A band key that very many representatives have is split into blocks, and each two blocks are a task of their own; nothing
is capped. Sizes come from counts of 65,536 slots, which is what is broadcast, whatever the number of keys.

Defined results: null texts and texts without a word are alike to nothing; a text of fewer than k words is one
run; equal sets are alike; a record given twice under one id counts once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.functions.arrow_batches import byte_slices
from solstrata.session import materialize

HASHES = 256
#: 64-bit words of a fingerprint, one bit for each hash.
WORDS = HASHES // 64
_PRINT = [f"f{i}" for i in range(WORDS)]
SLOTS = 1 << 16
#: Rows of one band key above which the key is split into blocks.
BLOCK_ROWS = 2000
FAN_OUT = 8
#: Ids (8 bytes each) up to which they are sent to every executor.
WANTED_IDS = 2_000_000
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_SHIFT = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32))


def band_shape(threshold: float) -> tuple[int, int]:
    """(hashes per band, bands): the longest bands that leave a pair exactly at the threshold unfound with at most
    0.5 % probability, and as many of them as bring that to 0.15 %, if there are so many."""
    miss = lambda r, n: (1 - threshold**r) ** n
    rows = max(r for r in range(1, 17) if miss(r, HASHES // r) <= 0.005 or r == 1)
    return rows, next((n for n in range(1, HASHES // rows) if miss(rows, n) <= 0.0015), HASHES // rows)


def radius(threshold: float) -> int:
    """Differing bits within which a pair at the threshold lies, by four standard deviations."""
    p = (1 - threshold) / 2
    return math.ceil(HASHES * p + 4 * math.sqrt(HASHES * p * (1 - p)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
    return _powers


def word_runs(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its runs of k words."""
    parts = []
    for t in texts:
        if not t.isascii():
            t = " ".join(re.findall(r"\w+", t.lower()))
        parts.append(t.encode("utf-8", "surrogatepass"))
    body = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    power, inverse = _power_tables(len(body) + 1)
    is_word = _WORD[body]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view(np.int8), [0]])))
    start, stop = edges[::2], edges[1::2]
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[body] + np.uint64(1)) * power[: len(body)], dtype=np.uint64)])
    words = _mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        runs = _mix(runs * np.uint64(_BASE) + words[i : len(words) - k + 1 + i])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            short = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    short = _mix(np.array([short * np.uint64(_BASE) + w]))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(runs: np.ndarray) -> np.ndarray:
    """The least value of each of the HASHES hash functions over a set."""
    a, b = _SHIFT
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (runs >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(x), 512):
        v = x[s : s + 512, None] * a + b
        v ^= v >> np.uint32(15)
        best = np.minimum(best, v.min(axis=0))
    return best * np.uint32(0x9E3779B1)


def fingerprint(mins: np.ndarray) -> list[int]:
    """One bit of each min-hash, as signed 64-bit numbers."""
    return np.packbits((mins >> np.uint32(31)).astype(np.uint8)).view(">i8").tolist()


def _texts(df: DataFrame, record_id: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & F.col(record_id).isNotNull()).select(F.col(record_id).cast("bigint").alias("id"), F.col(text).alias("text"))


def features(df: DataFrame, record_id: str, text: str, k: int, threshold: float) -> DataFrame:
    """(id, set_key, f0..f3, bands): digest of the set, fingerprint and 32-bit band keys of every text with words."""
    rows, bands = band_shape(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in byte_slices(batch, "text", 2 << 20):
                sets = word_runs(part.column("text").to_pylist(), k)
                at = [i for i, s in enumerate(sets) if len(s)]
                mins = [min_hashes(sets[i]) for i in at]
                prints = [fingerprint(m) for m in mins]
                keys = [[xxhash.xxh32_intdigest(m[j * rows : (j + 1) * rows].tobytes(), j) - (1 << 31) for j in range(bands)] for m in mins]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(at, pa.int64())), pa.array([xxhash.xxh3_128_digest(sets[i].tobytes()) for i in at], pa.binary()),
                     *[pa.array([p[i] for p in prints], pa.int64()) for i in range(WORDS)], pa.array(keys, pa.list_(pa.int32()))],
                    ["id", "set_key", *_PRINT, "bands"])

    return _texts(df, record_id, text).mapInArrow(run, f"id bigint, set_key binary, {', '.join(f'{f} bigint' for f in _PRINT)}, bands array<int>")


def run_sets(df: DataFrame, record_id: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(id, runs): the sets of the wanted (id) texts, as sorted 64-bit numbers.

    `wanted` must be a written table. Its ids meet the texts before these are hashed where they fit into WANTED_IDS, else the sets after.
    """
    few = wanted.count() <= WANTED_IDS
    texts = _texts(df, record_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 2 << 20):
                sets = [s.view(np.int64) for s in word_runs(part.column("text").to_pylist(), k)]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "runs"])

    sets = (texts.join(F.broadcast(wanted), "id", "left_semi") if few else texts).mapInArrow(run, "id bigint, runs array<bigint>")
    return sets if few else sets.join(wanted, "id", "left_semi")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each fingerprint (a row of words, the highest first) in Gray order, as words to sort by."""
    rank = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    odd = np.cumsum(rank & np.uint64(1), axis=1) % np.uint64(2) == 1  # ones in the words so far, by parity
    rank[:, 1:] = np.where(odd[:, :-1], ~rank[:, 1:], rank[:, 1:])
    return rank


class GrayIndex:
    """Hierarchical index of the fingerprints of many groups, each group in Gray order.

    Level 0 holds the fingerprints; a node of the next level stands for up to FAN_OUT neighbours of one group and keeps
    the bits they share. The top level has one node per group.
    """

    def __init__(self, group: np.ndarray, side: np.ndarray, prints: np.ndarray):
        rank = gray_rank(prints)
        self.order = np.lexsort((*rank.T[::-1], group))
        group = group[self.order]
        self.side = side[self.order]
        prints = prints[self.order]
        self.pattern, self.mask, self.child = [prints], [np.full_like(prints, ~np.uint64(0))], []
        while True:
            new = np.concatenate([[True], group[1:] != group[:-1]])
            if new.all():
                break
            begin = np.flatnonzero(new)
            place = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
            first = np.flatnonzero(place % FAN_OUT == 0)
            all_one = np.bitwise_and.reduceat(self.pattern[-1], first, axis=0)
            any_one = np.bitwise_or.reduceat(self.pattern[-1] | ~self.mask[-1], first, axis=0)
            every = np.bitwise_and.reduceat(self.mask[-1], first, axis=0)
            self.mask.append(every & ~(all_one ^ any_one))
            self.pattern.append(all_one & self.mask[-1])
            self.child.append(np.append(first, len(group)))
            group = group[first]

    def pairs(self, radius: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of rows of one group within the radius; across sides if the group has two, each pair once."""
        top = len(self.pattern) - 1
        roots = np.arange(len(self.pattern[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                keep = a != b
                two = self.side[a] != self.side[b]
                keep &= two | (self.side[a] == 0)
                if keep.any():
                    yield self.order[a[keep]], self.order[b[keep]]
                continue
            if len(a) > limit // (FAN_OUT * FAN_OUT) and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            child = self.child[level - 1]
            na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
            n = na * nb
            at = np.repeat(np.arange(len(a)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y = child[a][at] + k // nb[at], child[b][at] + k % nb[at]
            keep = (a[at] != b[at]) | (x <= y)
            x, y = x[keep], y[keep]
            p, m = self.pattern[level - 1], self.mask[level - 1]
            differ = np.bitwise_count((p[x] ^ p[y]) & m[x] & m[y]).sum(axis=1)
            near = differ <= radius
            stack.append((level - 1, x[near], y[near]))


def _bucket_pairs(rows: pd.DataFrame, reach: int) -> Iterator[pa.RecordBatch]:
    key = rows["task"].to_numpy()
    new = np.concatenate([[True], key[1:] != key[:-1]])
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    group = np.cumsum(new) - 1
    more = size[group] > 1
    if not more.any():
        return
    rows, group = rows[more], group[more]
    ids = rows["id"].to_numpy()
    # side 0: pairs within count; side 1 and 2: only pairs across
    index = GrayIndex(group, rows["side"].to_numpy(), rows[_PRINT].to_numpy().view(np.uint64))
    for a, b in index.pairs(reach):
        x, y = ids[a], ids[b]
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        pair = pair[pair[:, 0] != pair[:, 1]]
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def candidate_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: representatives with a common band key whose fingerprints lie within the radius. reps must be a written table."""
    reach = radius(threshold)
    banded = reps.select("id", *_PRINT, F.posexplode("bands").alias("band", "value"))
    banded = banded.withColumn("key", F.col("band").cast("bigint") * F.lit(1 << 32) + F.col("value")).drop("band", "value")
    banded = banded.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int"))
    slots = materialize(banded.groupBy("slot").agg(F.count("*").alias("n")), "band-slots")  # at most SLOTS rows
    mean = (slots.agg(F.sum("n")).first()[0] or 0) / SLOTS
    blocks = F.ceil((F.col("n") - F.lit(2 * mean)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")
    hot = slots.select("slot", blocks).where("blocks > 1")
    rows = banded.join(F.broadcast(hot), "slot", "left")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("byte")
    task = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    rows = rows.select(task.alias("task"), "id", side.alias("side"), *_PRINT).repartition("task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.to_pandas()
            held.append(part)
            count += len(part)
            if count < 100_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(rows["task"].to_numpy(), rows["task"].iloc[-1], "left"))
            if cut:
                yield from _bucket_pairs(rows.iloc[:cut], reach)
            held = [rows.iloc[cut:]]
            count = len(held[0])
        if held:
            yield from _bucket_pairs(pd.concat(held, ignore_index=True), reach)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def verified_pairs(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, common, total) of the candidates whose sets reach the threshold."""
    second = candidates.join(sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b")), "b")
    both = second.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("runs_a", "runs_b")).alias("common"), (F.size("runs_a") + F.size("runs_b")).alias("sizes"))
    counted = counted.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("total"))
    return counted.where(F.col("common") >= F.lit(threshold) * F.col("total") - F.lit(1e-9))


def near_duplicates(df: DataFrame, record_id: str, text: str, k: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, members): (a, b) between representatives of different texts, and (id, rep) of every text with words.

    Copies, that is texts with equal sets, share the representative with the least id and have no links among themselves.
    """
    every = materialize(features(df, record_id, text, k, threshold), "near-features")
    reps = every.groupBy("set_key").agg(F.min_by(F.struct("id", *_PRINT, "bands"), "id").alias("r"))
    reps = materialize(reps.select("set_key", "r.*"), "near-reps")
    members = every.select("id", "set_key").distinct().join(reps.select("set_key", F.col("id").alias("rep")), "set_key").select("id", "rep")
    candidates = materialize(candidate_pairs(reps, threshold), "near-candidates")
    wanted = materialize(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-wanted")
    links = verified_pairs(candidates, run_sets(df, record_id, text, k, wanted), threshold)
    return materialize(links.select("a", "b"), "near-links"), materialize(members, "near-members")


def similar_pairs(df: DataFrame, record_id: str, text: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b), a < b: all records at least as alike as the threshold, copies included."""
    links, members = near_duplicates(df, record_id, text, k, threshold)
    one, two = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.join(one, "a").join(two, "b").select("x", "y")
    copied = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    copies = members.join(copied, "rep")
    same = copies.select("rep", F.col("id").alias("x")).join(copies.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    both = across.where("x <> y").unionByName(same)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id): connected components by the least id, with large and small stars in turn.

    Each round is written to the shared folder. Stars of any size are only ever aggregated or joined, never collected.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "component-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-edges")
        now = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
        if now == before:
            break
        before = now
    label = edges.groupBy("u").agg(F.min("v").alias("group_id"))
    return nodes.join(label.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def similar_groups(df: DataFrame, record_id: str, text: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, group_id, class_id, links): one row per record with words.

    class_id is the least id with an equal set, group_id the least id of all that chains of links reach, links the number of
    classes its class is linked to.
    """
    found, members = near_duplicates(df, record_id, text, k, threshold)
    groups = components(members.select(F.col("rep").alias("id")).distinct(), found)
    ends = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(groups.select(F.col("id").alias("rep"), "group_id"), "rep").join(ends, "rep", "left")
    return out.select("id", "group_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
