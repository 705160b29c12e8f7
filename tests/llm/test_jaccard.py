import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from filmloom.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
HOW = jaccard.Jaccard()


def shingles(text, size=5):
    words = WORD.findall((text or "").encode().lower())
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_force(rows):
    """[(doc_id, n, component)] by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=key)


def edited(rng, text, share):
    return " ".join(f"x{rng.random()}" if rng.random() < share else w for w in text.split())


def corpus(seed, n=60):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for _ in range(n):
        base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 4, 5, 6, 30, 120, 400])))
        if rng.random() < 0.4:
            base += " " + passage
        rows += [base] + [edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04])) for _ in range(rng.choice([0, 1, 2, 6]))]
        if rng.random() < 0.3:
            rows.append(base + " " + " ".join(base.split()[: len(base.split()) // rng.choice([3, 4, 5])]) + f" e{rng.random()}")
    chain = [f"c{i}" for i in range(150)]
    rows += [" ".join(chain[k : k + 100]) for k in range(0, 50, 3)]
    rows += [None, "", " \n\t ", "One two", "one TWO", "one two three", "É é É é É", "é É é É é"]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[1]), (3, rows[3]), (3, rows[3])]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(4) for c in ("fp", "n", "token", "block", "component_id", "_k1", "items", "g")})


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small):
    if small:  # many blocks, several levels of nodes, few frequent shingles known, texts split in pieces
        for name, value in {"LOAD": 300, "LIGHT": 100, "AT_ONCE": 3, "FAN_BITS": 1, "FREQUENT": 20 * (seed - 2), "PIECE": 50, "ENTRIES": 300, "BUCKET": 500}.items():
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed)
    assert result(jaccard.linked(frame(spark, rows).repartition(4))) == brute_force(rows)


def test_odd_and_empty_tables(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert result(jaccard.linked(odd_documents)) == brute_force(rows)
    assert jaccard.linked(no_documents).count() == 0


def test_shingle_sets_do_not_depend_on_pieces(monkeypatch):
    text = ("Ab cD é\x0b中 " * 300).encode() + b" end"
    whole = jaccard.shingle_set(text, jaccard.Words(), 5)
    assert len(whole) == len(shingles(text.decode()))
    monkeypatch.setattr(jaccard, "PIECE", 7)
    assert (jaccard.shingle_set(text, jaccard.Words(), 5) == whole).all()


def similar_sets(rng, n, size):
    base = rng.integers(0, 1 << 63, size * 4, dtype=np.uint64)
    return [np.unique(np.r_[rng.choice(base[: size + k % 7 * 9], size, replace=False), rng.integers(0, 1 << 63, k % 30, dtype=np.uint64)]) for k in range(n)]


@pytest.mark.parametrize("words", [1, 4, 32])
def test_traversal_prunes_no_similar_pair(words):
    rng = np.random.default_rng(words)
    sets = [s for size in (5, 40, 60, 300) for s in similar_sets(rng, 40, size)] + [rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(30)]
    sets = [np.unique(s) for s in sets]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if HOW.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    tree = jaccard.Tree(sets, np.arange(len(sets)), words)
    assert near and near <= set(zip(*map(np.ndarray.tolist, jaccard.traversed(tree, tree, HOW))))
    half = len(sets) // 2
    a, b = jaccard.Tree(sets[:half], np.arange(half), words), jaccard.Tree(sets[half:], np.arange(half, len(sets)), words)
    across = {(i, j - half) for i, j in near if i < half <= j}
    assert across <= set(zip(*map(np.ndarray.tolist, jaccard.traversed(a, b, HOW))))


def test_traversal_prunes_most_pairs():
    rng = np.random.default_rng(5)
    groups = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(30)]
    sets = [np.unique(np.r_[g[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for g in groups for k in range(10)]
    tree = jaccard.Tree(sets, np.arange(300), 64)
    i, j = jaccard.traversed(tree, tree, HOW)
    assert 30 * 45 <= len(i) < 300 * 299 / 2 / 20
    labelled = jaccard.Tree(sets, np.repeat(np.arange(30), 10), 64)
    assert not len(jaccard.traversed(labelled, labelled, HOW)[0])


def test_links_hold_each_group_together_without_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    members = [(k, k, np.unique(np.r_[base[2:], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for k in range(200)]
    assert len(jaccard.tree_links(members, [], HOW)) == 199
    assert len(jaccard.tree_links(members[:90], members[90:], HOW)) == 199


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    known = (pool[::3], rng.permutation(len(pool[::3])) + 1)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.sort(rng.choice(pool, n, replace=False))
        out = int(rng.integers(0, n // 9 + 1))
        b = np.unique(np.r_[rng.choice(a, n - out, replace=False), rng.choice(pool, out)])
        if HOW.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            assert len(np.intersect1d(jaccard.first_shingles(a, known, HOW), jaccard.first_shingles(b, known, HOW)))


def test_workers_hold_little(spark, monkeypatch):
    """Words known and bytes of a batch are bounded, whatever the texts; before, only rows of a batch were."""
    monkeypatch.setattr(jaccard, "WORDS_KNOWN", 10)
    words = jaccard.Words()
    assert all(words[b"%d" % (k % 25)] == xxhash.xxh64_intdigest(b"%d" % (k % 25), jaccard.SEED) and len(words) <= 10 for k in range(500))

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        assert jaccard.linked(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).count() == 2
        texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("text"))
        assert max(r.n for r in texts.mapInArrow(held, "n long").collect()) <= 1.2 * jaccard.BATCH
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)


def test_blocks_start_no_python_workers_of_their_own(spark, monkeypatch):
    """Rows of Python objects are an RDD of Python, for which each executor starts further workers; Arrow tables are not."""
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(data) or create(self, data, *a, **b))
    keys = create(spark, [(1, 10, 50), (1, 11, 50), (2, 12, 400)], "token long, fp long, n long")
    assert {r.fp for r in jaccard._blocks(keys, HOW).collect()} == {10, 11, 12}
    assert made and all(isinstance(x, pa.Table) for x in made)
