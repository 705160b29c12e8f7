import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from filmloom.llm import similar, simhash


def brute_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_firsts(texts):
    """Smallest index of each group linked by a Jaccard similarity of 0.8, over all pairs."""
    sets, root = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i for i in range(len(texts)) if top(i) == i}


@pytest.fixture(scope="module")
def edited():
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    texts = []
    for n in (30, 60, 100, 100, 300, 300):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 12):
            other = list(base)
            for at in draw.sample(range(n), edits):
                other[at] = word()
            texts.append(" ".join(other))
        chain = list(base)
        for _ in range(8):  # each near the one before, the last far from the first
            chain[draw.randrange(n)] = word()
            texts.append(" ".join(chain))
    return texts


def test_one_word_replaced_is_a_near_copy(spark, data):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50] + ["other"] + words[51:])), (3, " ".join(f"x{w}" for w in words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, docs, data).collect()) == [1, 3]


@pytest.mark.parametrize("slice_", [256, 3])
def test_stage_equals_brute_force_jaccard(spark, data, edited, slice_, monkeypatch):
    monkeypatch.setattr(similar, "SLICE", slice_)
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")
    assert {r.doc_id for r in P.simhash_dedup(spark, docs, data).collect()} == brute_firsts(edited)


def test_bands_propose_pairs_of_0_8():
    draw = np.random.default_rng(5)
    missed = 0
    for n in (5, 20, 100) * 100:
        both = draw.integers(0, 1 << 63, 8 * n, dtype=np.uint64)
        own = draw.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        missed += not (similar.bands(np.r_[both, own[:n]]) == similar.bands(np.r_[both, own[n:]])).any()
    assert missed == 0


def test_close_fingerprints_link_first(spark, data, monkeypatch):
    """Long texts with a word replaced have close fingerprints: these link them, and the bands are left with none of their pairs."""
    draw = random.Random(7)
    texts = []
    for _ in range(4):
        words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
        texts += [" ".join([*words[:at], "other", *words[at + 1 :]]) for at in (0, 0, 700, 1500, 2999)]
    sims = [simhash.fingerprint(t, 5) for t in texts]
    far = [[(a ^ b).bit_count() > 3 for b in sims[: i - i % 5]] for i, a in enumerate(sims)]
    assert all(map(all, far))
    asked, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, sets, least: asked.append({frozenset(r) for r in pairs.collect()}) or verified(pairs, sets, least))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, docs, data).collect()) == [0, 5, 10, 15]
    linked = sum(len(set(sims[k : k + 5])) > 1 and max((a ^ b).bit_count() for a in sims[k : k + 5] for b in sims[k : k + 5]) <= 3 for k in (0, 5, 10, 15))
    close, rest = asked[:2]
    assert linked and len(close) >= 3 * linked and not close & rest and len(rest) <= 3 * (4 - linked)


def test_equal_fingerprints_of_unlike_texts_are_no_copies(spark, data, monkeypatch):
    """Every pair that fingerprints propose is verified."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "a b c d e f g")], "doc_id long, text string")
    prints = similar._prints
    monkeypatch.setattr(similar, "_prints", lambda rows, shingle: prints(rows, shingle).withColumn("sim", F.lit(5).cast("long")))
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, docs, data).collect()) == [1, 2]
