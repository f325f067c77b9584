import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from solstrata.llm import neardup


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        if len(w) >= k:
            out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        elif w:
            out[i] = {tuple(w)}
    return out


def brute(texts, k, threshold):
    s = sets_of(texts, k)
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9}


def corpus(seed=1, families=12, size=9):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for _ in range(families):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 200))]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8, 14])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts[n] = (" " if rnd.random() < 0.5 else "\r\n").join(t).upper() if rnd.random() < 0.3 else " ".join(t)
            n += 1
    for odd in (None, "", "  ;; ", "one", "ONE", "one two", "é ü", "É Ü", "x" * 200_000, "a b c"):
        texts[n] = odd
        n += 1
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], "source_id bigint, sourcecode string, id string, rep int")


def test_pairs_match_brute_force(spark):
    texts = corpus()
    df = frame(spark, texts)
    for k, threshold in ((3, 0.6), (5, 0.8)):
        got = [tuple(r) for r in neardup.similar_pairs(df, "source_id", "sourcecode", k, threshold).collect()]
        want = brute(texts, k, threshold)
        assert len(got) == len(set(got)) and not set(got) - want
        assert len(want - set(got)) <= 0.01 * len(want)
    assert neardup.similar_pairs(df.limit(0), "source_id", "sourcecode").count() == 0
    twice = df.unionByName(df)
    assert {tuple(r) for r in neardup.similar_pairs(twice, "source_id", "sourcecode", 3, 0.6).collect()} == {tuple(r) for r in neardup.similar_pairs(df, "source_id", "sourcecode", 3, 0.6).collect()}


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    texts = corpus(3, families=1, size=90)
    whole = {tuple(r) for r in neardup.similar_pairs(frame(spark, texts), "source_id", "sourcecode", 3, 0.6).collect()}
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    split = {tuple(r) for r in neardup.similar_pairs(frame(spark, texts), "source_id", "sourcecode", 3, 0.6).collect()}
    assert split == whole == brute(texts, 3, 0.6)


def test_groups(spark):
    texts = corpus(4)
    got = {r.id: r for r in neardup.similar_groups(frame(spark, texts), "source_id", "sourcecode", 3, 0.6).collect()}
    pairs = brute(texts, 3, 0.6)
    s = sets_of(texts, 3)
    assert set(got) == set(s)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in s}
    assert all(r.class_id == min(j for j in s if s[j] == s[i]) for i, r in got.items())


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    n = 500
    base = rng.integers(0, 1 << 62, (15, neardup.WORDS), dtype=np.uint64)
    prints = base[rng.integers(0, 15, n)].copy()
    for _ in range(15):
        prints[np.arange(n), rng.integers(0, neardup.WORDS, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    group = np.sort(rng.integers(0, 4, n))
    side = rng.integers(0, 3, n).astype(np.int8)
    got = [tuple(sorted(p)) for a, b in neardup.GrayIndex(group, side, prints).pairs(25, 1 << 10) for p in zip(a.tolist(), b.tolist())]
    near = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]).sum() <= 25 and group[i] == group[j] and (side[i] != side[j] or side[i] == 0)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if near(i, j)}
    assert len(got) == len(set(got)) and set(got) == want


def test_gray_rank_is_the_place_in_gray_order():
    for value in [0, 1, 5, (1 << 200) + 77, (1 << 256) - 1]:
        gray = value ^ (value >> 1)
        words = np.array([[gray >> (64 * (neardup.WORDS - 1 - i)) & ((1 << 64) - 1) for i in range(neardup.WORDS)]], dtype=np.uint64)
        rank = 0
        for w in neardup.gray_rank(words)[0]:
            rank = rank << 64 | int(w)
        assert rank == value


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_runs_are_those_of_the_words(texts):
    got = neardup.word_runs(texts, 3)
    want = sets_of(dict(enumerate(texts)), 3)
    assert [len(g) for g in got] == [len(want.get(i, ())) for i in range(len(texts))]
