import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from unicodedata import category

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filmloom.llm import chat, common, hamming, licenses, mixing, packing, quality, registry, sharding, simhash, suffixes, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def run(spark, data, name):
    return registry.queries()[name](spark, data).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = duck.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, data).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert Counter(map(tuple, got[columns].values.tolist())) == Counter(map(tuple, want[columns].values.tolist()))


# 1 ---------------------------------------------------------------- top-k search


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_top_k_with_copies_ties_and_far_queries(spark, broadcast):
    rng = np.random.default_rng(3)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63, 60)] + [5] * 30 + [5 ^ 1, 5 ^ 3, -1]
    rows = [(i, c) for i, c in enumerate(codes)] + [(0, codes[0])]
    df = spark.createDataFrame(rows, "id long, code long").withColumn("least", F.lit(0))
    got = defaultdict(list)
    for r in hamming.top_k(df.select("id", "code"), hamming.Search(k=7, every=10, broadcast=broadcast)).collect():
        got[r.query_id].append((r.distance, r.id))
    for q, code in rows:
        if q % 10 == 0 and q:
            want = sorted(((c ^ code) & (2**64 - 1)).bit_count() * 1000 + i for i, c in rows)[:7]
            assert sorted(d * 1000 + i for d, i in got[q]) == want
    assert hamming.top_k(df.where("id < 0").select("id", "code")).count() == 0


def test_radii_meet_every_code_once(spark):
    rng = np.random.default_rng(31)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    df = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code long, least long")
    index, asked = hamming._by_segment(df, ["code", "least"]), df.where("least < 3").select("code", F.lit(64).alias("bound"))
    seen = Counter()
    for radius in range(hamming.BITS + 1):
        for r in hamming.met(index, asked, radius).collect():
            seen[r.query, r.code] += 1
            assert r.distance == ((r.query ^ r.code) & (2**64 - 1)).bit_count() >= hamming.SEGMENTS * radius
    assert seen == Counter({(q, c): 1 for q in codes[:3] for c in codes})


def test_few_codes_are_looked_at(spark):
    """At radius 2 a query of uniform codes meets about 4 * 137 / 65536 of them: below one in a hundred."""
    rng = np.random.default_rng(32)
    rows = [(int(c), i) for i, c in enumerate(rng.integers(-(2**63), 2**63, 20_000))]
    df = spark.createDataFrame(rows, "code long, least long")
    index, asked = hamming._by_segment(df, ["code", "least"]), df.where("least < 50").select("code", F.lit(64).alias("bound"))
    looked = sum(hamming.met(index, asked, r).count() for r in range(3))
    assert 50 * 20_000 * 0.004 < looked < 50 * 20_000 * 0.02


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (1, [1.0, None, -1.0, 2.0]), (2, None), (None, [1.0])], "vec_id long, embedding array<float>")
    df = df.withColumns({c: F.lit(1) for c in ("id", "code", "segment", "value", "query", "distance", "rank")})
    assert {r.id: r.code for r in hamming.sign_codes(df).collect()} == {0: -1, 1: 9, 2: 0}


# 2 ------------------------------------------------------------------------ mixing


def check_mix(rows, sizes, sources):
    total = sum(sum(s) for s in sources.values())
    names = sorted((n for n in sources if n is not None)) + ([None] if None in sources else [])
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    capped: set = set()
    while True:
        rest = 1.5 * total - sum(2 * sum(sources[n]) for n in capped)
        open_ = sum(weight[n] for n in names if n not in capped)
        want = {n: 2 * sum(sources[n]) if n in capped else rest * weight[n] / open_ for n in names}
        over = {n for n in names if want[n] > 2 * sum(sources[n]) + 1e-9}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sum(sources[r.source])
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for n in names:
        assert abs(taken[n] - want[n]) <= max(sources[n]) / 2 + 1e-6
    assert Counter(r.size for r in rows) == Counter(sizes)


def test_mix_meets_its_targets_and_reruns_agree(spark, data, texts):
    rows = run(spark, data, "op2_mixing")
    sizes = {i: len(WORD.findall(r.text)) for i, r in texts.items()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    sources = defaultdict(list)
    for i, r in texts.items():
        sources[r.source].append(sizes[i])
    check_mix(rows, list(sizes.values()), sources)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, data, "op2_mixing")))


def test_mix_of_odd_documents(spark, odd_documents, no_documents):
    rows = mixing.mixed(odd_documents).collect()
    sources = defaultdict(list)
    for r in odd_documents.collect():
        sources[r.source].append(len(WORD.findall(r.text or "")))
    check_mix(rows, [s for v in sources.values() for s in v], sources)
    assert mixing.mixed(no_documents).count() == 0
    again = mixing.repeat_documents(odd_documents)
    assert again.columns == odd_documents.columns
    assert again.count() == sum(r.copies for r in rows)


def test_the_tree_has_several_levels(spark):
    rows = [(i, f"s{i % 2}", " ".join("w" * (i % 37 + 1))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(df, mixing.Mix(fan_in=8, share=1.3)).groupBy("source").agg(F.sum("taken").alias("k"), F.max("target").alias("t")).collect()
    assert len(got) == 2 and all(abs(r.k - r.t) <= 20 for r in got)


def test_one_row_said_very_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 64)
    rows = [(7, "one two three", "a")] * 700 + [(k, "w " * (k % 9 + 1), "ab"[k % 2]) for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = defaultdict(list)
    for _, text, source in rows:
        sources[source].append(len(text.split()))
    got = mixing.mixed(df).collect()
    check_mix(got, [s for v in sources.values() for s in v], sources)
    assert sum(r.doc_id == 7 for r in got) == 700
    packed = packing.pack(df, packing.Packing(longest=10, buckets=3, budget=60)).groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("top")).collect()
    assert sum(r.n for r in packed) == len(rows) and all(r.n == r.slots == r.top + 1 for r in packed)
    check_shards(sharding.shard_documents(df).collect(), len(rows))


# 3 -------------------------------------------------------------------- token counts


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, data, texts, odd_documents, no_documents):
    rows = run(spark, data, "op3_token_counts")
    want = dict(zip(texts, library([r.text for r in texts.values()])))
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 1024) and r.n_bytes == len(texts[r.doc_id].text.encode()) for r in rows)
    odd = [r.text for r in odd_documents.collect()]
    got = tokens.token_counts(odd_documents).collect()
    assert Counter((r.n_bytes, r.n_tokens) for r in got) == Counter(zip((len((t or "").encode()) for t in odd), library(odd)))
    assert tokens.token_counts(no_documents).count() == 0


def test_characters_are_sorted_as_the_library_sorts_them():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    pre, unsure = tokens.load(source).pre_tokenizer, 0
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]):
        pattern = tokens.pattern_for(c)
        if pattern is not tokens.PIECES:
            unsure += ord(c) < 0x530
        if pattern is None:
            assert category(c) == "Cn"
            continue
        s = f"a{c}1 {c}{c}b,{c}"
        assert [at for _, at in pre.pre_tokenize_str(s)] == [m.span() for m in pattern.finditer(s)]
    assert unsure < 20
    counter = tokens.Counter2(source, {}, tokens.Counting())
    for word in ("hello", " the", "éü", "  ", "\n", "don't", "\x00\x01"):
        assert counter.encoded(word) == len(counter.tokenizer.encode(word, add_special_tokens=False).ids)


def test_counts_do_not_depend_on_the_tables(spark, data):
    docs = common.table(spark, data, "documents")
    small = tokens.Counting(frequent=300, cached=50)
    a, b = tokens.token_counts(docs, small), tokens.token_counts(docs)
    assert a.exceptAll(b).count() == 0


# 4 ------------------------------------------------------------------- license scans


def test_alignment_is_increasing_and_true():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([b"%d" % rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(licenses.align(list("abcdef"), list("abXdef"))) == 5
    seq = [(k, v) for k, v in enumerate(rng.sample(range(50), 50))]
    best = [1] * 50
    for k in range(50):
        best[k] = 1 + max((best[j] for j in range(k) if seq[j][1] < seq[k][1]), default=0)
    assert len(licenses.increasing(seq)) == max(best)


def test_license_scan(spark, data, texts, odd_documents, no_documents):
    rows = run(spark, data, "op4_license_scan")
    found = {r.doc_id: r.license for r in rows}
    assert len(rows) == len(texts)
    for i, r in texts.items():
        for name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"):
            if licenses.TEMPLATES[name] in r.text:
                assert found[i] is not None
        if "icense" not in r.text:
            assert found[i] is None
    odd = {(r.doc_id, r.license) for r in licenses.license_scan(odd_documents).collect()}
    assert (7, "Apache-2.0") in odd and (3, None) in odd
    assert licenses.license_scan(no_documents).count() == 0
    twice = spark.createDataFrame([(1, "x " * 500 + licenses.TEMPLATES["MIT"] + " y " * 9 + licenses.TEMPLATES["MIT-text"][:-200])], "doc_id long, text string")
    (r,) = licenses.license_scan(twice).collect()
    assert r.license == "MIT" and r.first_word == 500 and r.end_word == 505


# 5 ------------------------------------------------------------------------- simhash


def brute_simhash(rows):
    prints = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    return prints


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(ids))]


def test_simhash_equals_brute_force(spark, data, texts):
    ids = sorted(texts)
    prints = brute_simhash([(i, texts[i].text) for i in ids])
    want = dict(zip(ids, zip((f"{p:016x}" for p in prints), brute_components(ids, prints))))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, data, "op5_simhash_dedup")} == want


@pytest.mark.parametrize("crowded", [2048, 4])
def test_links_of_close_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(crowded)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(25)})
    ids = rng.sample(range(10_000), len(prints))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long")
    labels = {r.node: r.component for r in common.components(simhash.links(df)).collect()}
    assert [labels.get(i, i) for i in ids] == brute_components(ids, prints)


def test_simhash_of_odd_documents(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[2] == 1 and by[4] == 3 and by[5] == 3
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}


# 6 -------------------------------------------------------------------- suffix arrays


def brute_repeats(rows, length):
    seen, each = Counter(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        each.append([b[s : s + length] for s in range(len(b) - length + 1)])
        seen.update(each[-1])
    out = Counter()
    for (doc_id, text), parts in zip(rows, each):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s, x in enumerate(parts):
            if seen[x] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        c = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        out[doc_id, len(b), int(c.sum()), int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def as_counter(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,crowded", [(1, 1024), (2, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    rng = random.Random(seed)

    def letters(n, of="abcdefgh"):
        return "".join(rng.choice(of) for _ in range(n))

    base, passages = [letters(rng.randrange(500)) for _ in range(20)], [letters(rng.randrange(30, 90)) for _ in range(5)]
    docs = [(None, None), (900, ""), (901, base[3]), (901, base[3])]
    for k in range(200):
        kind = rng.randrange(6)
        if kind < 2:
            t = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("abcdefghé")
            t = "".join(t)
        elif kind < 4:
            t = letters(rng.randrange(150)) + rng.choice(passages) + letters(rng.randrange(150))
        elif kind == 4:
            t = rng.choice(["a", "ab", "xyz"]) * rng.randrange(120)
        else:
            t = letters(rng.randrange(300), "ab")
        docs.append((k, t))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_counter(suffixes.cleaned(df, suffixes.Repeats(length=40, window=16))) == brute_repeats(docs, 40)


def repetitive(seed):
    """Texts of few letters with copies, edits, shared passages at every place, the ends too, and runs."""
    rng = random.Random(seed)
    letters = lambda n, of="abcdefgh": "".join(rng.choice(of) for _ in range(n))
    passage, docs = letters(60), []
    for k in range(150):
        cut = rng.randrange(40, 61)
        t = letters(rng.randrange(80)) + rng.choice([passage[:cut], passage[-cut:], passage + passage[:30]])
        docs.append((k, t + letters(rng.choice([0, 0, 3, 50]))))
    return docs


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_at_the_ends_of_texts(spark, seed):
    docs = repetitive(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_counter(suffixes.cleaned(df, suffixes.Repeats(length=40, window=16))) == brute_repeats(docs, 40)


@pytest.fixture
def small_parts(spark, monkeypatch):
    """Batches of three rows and many tasks, so that most neighbours in an order lie in two of either."""
    monkeypatch.setattr(common, "small_batches", lambda spark, *a, **k: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_all_neighbours_in_an_order_are_compared(spark, small_parts):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(4), rng.randrange(1, 5), rng.randrange(1, 30)) for _ in range(150)})
    common_to = lambda x, y: next((k for k in range(3) if x[k] != y[k]), 3)
    right = {x: max(common_to(x, y) for y in rows if y != x) for x in rows}

    def compare(columns, n, before):
        return [np.arange(len(n)) + before, suffixes._with_next(suffixes._in_common(*columns), np.where(n > 1, 3, 0))]

    df = spark.createDataFrame([(*x, 1) for x in rows], "sym long, c1 long, c2 long, n long")
    found = suffixes._by_order(df, ["sym", "c1", "c2"], ["sym", "c1", "c2"], "name, lcp", compare, "lcp").collect()
    assert {(r.sym, r.c1, r.c2): r.lcp for r in found} == right
    assert [(r.sym, r.c1, r.c2) for r in sorted(found, key=lambda r: r.name)] == rows
    assert len({r.name for r in found}) == len(rows) and len({r.name >> 40 for r in found}) > 1


@pytest.mark.parametrize("seed", [12, 13])
def test_repeats_whose_neighbours_lie_in_other_batches_and_tasks(spark, small_parts, seed):
    docs = repetitive(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_counter(suffixes.cleaned(df, suffixes.Repeats(length=40, window=16))) == brute_repeats(docs, 40)


def test_the_order_of_suffixes_decides(spark, monkeypatch):
    docs = repetitive(5)
    df, r = spark.createDataFrame(docs, "doc_id long, text string"), suffixes.Repeats(length=40, window=16)
    right, ranks = brute_repeats(docs, 40), suffixes.sampled_ranks

    def shuffled(strings, r):
        depth, found = ranks(strings, r)
        return depth, found.withColumn("rank", F.xxhash64("h", "i")).withColumn("lcp", F.lit(0).cast("long"))

    monkeypatch.setattr(suffixes, "sampled_ranks", shuffled)
    assert as_counter(suffixes.cleaned(df, r)) != right
    monkeypatch.setattr(suffixes, "sampled_ranks", ranks)
    nothing = lambda strings, ranks, depth: strings.select("h", "i", F.lit(0).cast("long").alias("lcp"))
    monkeypatch.setattr(suffixes, "merged", nothing)
    assert as_counter(suffixes.cleaned(df, r)) != right


def test_a_passage_of_many_documents_makes_few_rows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWDED", 64)
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = letters(80)
    docs = [(k, letters(70) + passage + letters(70)) for k in range(400)]
    df, r = spark.createDataFrame(docs, "doc_id long, text string"), suffixes.Repeats(length=40, window=16)
    made, joined = [], suffixes._joined
    monkeypatch.setattr(suffixes, "_joined", lambda rows, keys: made.append(common.cut(joined(rows, keys))) or made[-1])
    assert as_counter(suffixes.cleaned(df, r)) == brute_repeats(docs, 40)
    assert made[0].count() <= 8 * len(docs)


def test_repeats_of_the_smallest_tables(spark, data, texts):
    got = as_counter(registry.queries()["op6_suffix_array_dedup"](spark, data))
    assert got == brute_repeats([(i, r.text) for i, r in texts.items()], 400)


def test_texts_without_repeats_are_not_shuffled(spark, monkeypatch):
    """Where the lists are too large for a broadcast, only texts that may be in them are joined by a shuffle."""
    passage = "".join(random.Random(1).choices("abcdefgh ", k=120))
    own = ["".join(random.Random(k).choices("ijklmnopqrstuvwxyz ", k=200)) for k in range(200)]
    docs = [(k, t + (passage if k in (3, 90) else "")) for k, t in enumerate(own)] + [(200, own[7]), (201, None), (202, "")]
    df, r, met, parted = spark.createDataFrame(docs, "doc_id long, text string"), suffixes.Repeats(length=40, window=16), [], common.parted

    def watched(rows, keys, h):
        may, rest = parted(rows, keys, h)
        met.append((may.count(), rest.count()))
        return may, rest

    monkeypatch.setattr(common, "fits", lambda *a, **k: False)
    monkeypatch.setattr(common, "parted", watched)
    assert as_counter(suffixes.cleaned(df, r)) == brute_repeats(docs, 40)
    assert met == [(2, 199), (4, 199)]


def test_ranks_of_earlier_rounds_are_dropped(spark, monkeypatch):
    docs = [(k, "ab" * 300 + "c" * k) for k in range(4)]
    df, r, made, cut = spark.createDataFrame(docs, "doc_id long, text string"), suffixes.Repeats(length=40, window=16), [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, label="step", compression=None: made.append((label, cut(df, label, compression))) or made[-1][1])
    assert as_counter(suffixes.cleaned(df, r)) == brute_repeats(docs, 40)
    ranks = [x.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") for label, x in made if label == "sampled-ranks"]
    assert len(ranks) > 1 and not any(map(os.path.exists, ranks))


def test_repeats_of_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert as_counter(suffixes.cleaned(odd_documents)) == brute_repeats(rows, 400)
    assert suffixes.cleaned(no_documents).count() == 0
    stripped = suffixes.strip_repeats(odd_documents, suffixes.Repeats(length=60, window=32))
    assert stripped.columns == odd_documents.columns
    assert {r.doc_id: r.text for r in stripped.collect()}[1] == "" and stripped.count() == len(rows)


# 7 ------------------------------------------------------------------------- packing


def test_boundaries_have_the_least_padding():
    from itertools import combinations

    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randrange(40): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        k, lengths = rng.randrange(1, 5), sorted(counts)

        def padding(bounds):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in counts.items())

        best = min(padding((*c, lengths[-1])) for j in range(k) for c in combinations(lengths[:-1], min(j, len(lengths) - 1)))
        assert padding(packing.boundaries(counts, k)) == best


def test_packing(spark, data, texts, odd_documents, no_documents):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        plain = tokens.ranked(f.read())
    for df in (common.table(spark, data, "documents"), odd_documents.dropDuplicates()):
        rows = packing.pack(df, packing.Packing(longest=100, buckets=4, budget=900)).collect()
        batches, of = defaultdict(list), defaultdict(dict)
        for r in rows:
            assert len(r.ids) == r.n_tokens <= r.bucket <= 100 and r.padding == r.bucket - r.n_tokens
            batches[r.bucket, r.batch].append(r.slot)
            if r.doc_id is not None:
                of[r.doc_id][r.piece] = r.ids
        for (bucket, _), slots in batches.items():
            assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= 900
        # batches are full but for the last of a bucket
        last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
        assert all(len(v) == max(1, 900 // max(b, 1)) for (b, k), v in batches.items() if k < last[b])
        # the pieces of a document are its tokens again, whole but for the last
        want = {r.doc_id: plain.encode_ordinary(r.text or "") for r in df.collect() if r.doc_id is not None}
        assert {i: [x for k in sorted(p) for x in p[k]] for i, p in of.items()} == want
        assert all(len(x) == 100 for p in of.values() for k, x in p.items() if k < max(p))
    assert packing.pack(odd_documents).agg(F.count("*"), F.sum("n_tokens")).first()[0] > odd_documents.count()
    assert packing.pack(no_documents).count() == 0


def test_long_texts_are_encoded_in_parts_as_in_the_whole():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        plain = tokens.ranked(f.read())
    rng = random.Random(77)
    for _ in range(200):
        s = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", "1", "é", "中", "!", " x"]) for _ in range(rng.randrange(80)))
        parts = [*tokens.stretches(s, 7)]
        assert "".join(parts) == s and [i for p in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(s)


# 8 ----------------------------------------------------------------- chat formatting


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_chat_round_trip(spark, data):
    conversations = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{data}/conversations.parquet").collect(), key=lambda r: r.turn):
        conversations[r.conv_id].append((r.role, r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    conversations[-1] = [("user", said), ("assistant", said)]
    rows = run(spark, data, "op8_chat_formatting")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}
    assert got == {k: digests(v) for k, v in conversations.items()}


def test_chat_of_odd_turns(spark):
    rows = [
        (1, 0, "user", "<|im_start|> <\\|x <|", 1), (1, 1, "assistant", None, 1), (1, None, "assistant", "é\n\U0001f600 <|endoftext|>", 1),
        (2, 0, None, "", 1), (2, 0, None, "", 1), (None, 3, "assistant", "lost", 1), (3, 1, "a\n<|im_sep|>", "long " * 50_000, 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.formatted(df)).collect()}
    want = defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        want[c].append((r or "", x or ""))
    assert got == {k: digests(v) for k, v in want.items()}
    assert chat.read_back(chat.formatted(df.where("conv_id > 9"))).count() == 0
    flat = chat.formatted(df.where("conv_id = 1")).orderBy("from_id").collect()
    assert [r.from_id for r in flat] == [sum(len(x.ids) for x in flat[:k]) for k in range(len(flat))]


def test_escaping_can_be_undone():
    rng = random.Random(8)
    for _ in range(500):
        s = "".join(rng.choice("<|\\>a") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)


# 9 ------------------------------------------------------------------- quality rules


def base_numbers(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    parts = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = Counter(parts)
    again = {j for k, x in enumerate(parts) if often[x] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def check_quality(rows, of):
    for r in rows:
        want = of[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_numbers_and_verdicts(spark, data, texts):
    rows = run(spark, data, "op9_quality_rules")
    check_quality(rows, {i: base_numbers(r.text) for i, r in texts.items()})
    kept = {r.doc_id: r.kept for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    good = [kept[i] for i, q in labels.items() if q == 1 and i in kept]
    assert sum(good) >= 0.95 * len(good)
    junk = [i for i, r in texts.items() if base_numbers(r.text)[2] > base_numbers(r.text)[0]]
    assert junk and sum(kept[i] for i in junk) <= max(1, 0.05 * len(junk))  # a short one says little


def test_quality_of_odd_documents(odd_documents, no_documents):
    rows = [r for r in quality.judged(odd_documents).collect() if r.doc_id is not None]
    check_quality(rows, {r.doc_id: base_numbers(r.text) for r in odd_documents.collect()})
    assert quality.judged(no_documents).count() == 0
    assert quality.passing(odd_documents).columns == odd_documents.columns
    assert {r.doc_id for r in quality.passing(odd_documents).collect()} >= {1, 2, 6}


def test_mcd_ignores_a_third_of_outliers(spark):
    rng = np.random.default_rng(9)
    p = len(quality.Rules().floors)
    clean, bad = rng.normal(0, 1, (400, p)), rng.normal(0, 0.1, (100, p)) + 30
    df = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([clean, bad])], "g string, " + ", ".join(f"x{i} double" for i in range(p)))
    (r,) = quality.estimate(df, p, quality.Rules()).collect()
    assert all(abs(r[f"m{i}"]) < 0.4 for i in range(p)) and all(0.25 < r[f"c{i}_{i}"] < 4 for i in range(p))


# 10 ----------------------------------------------------------------------- sharding


def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(40)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1 and set(by) <= set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark, data, texts, odd_documents, no_documents):
    rows = run(spark, data, "op10_sharding")
    check_shards(rows, len(texts))
    assert all(r["size"] == len(texts[r.doc_id].text.encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].text.encode()) for r in rows)
    check_shards(sharding.shard_documents(odd_documents).collect(), odd_documents.count())
    grown = Counter(r.next_shard for r in rows)
    assert set(grown) <= set(range(41)) and max(grown.values()) - min(grown[s] for s in range(41)) <= 1
    assert sharding.shard_documents(no_documents).count() == 0


def test_little_moves_to_a_shard_more(spark):
    """A shard more must take 1 / 41 of the rows; beyond that only what overflows in either ring moves."""
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = sharding.shard_documents(df)
    moved, to_new = rows.agg(F.count_if(F.col("shard") != F.col("next_shard")), F.count_if(F.col("next_shard") == 40)).first()
    assert to_new in (200_000 // 41, 200_000 // 41 + 1)
    assert moved <= 0.12 * 200_000


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_bounded_loads(slack):
    placed = {}
    for shards in (40, 41):
        ring = sharding.Ring(shards, slack=slack)
        stops = [c for c, _ in ring.arcs()]
        arcs = np.searchsorted(stops, [k * 2654435761 % sharding.CELLS for k in range(40_000)]) % len(stops)
        counts = Counter(arcs.tolist())
        load, of = Counter(), {}
        for arc, first, end, shard, slot in ring.walk([counts.get(a, 0) for a in range(len(stops))]):
            assert slot == load[shard]
            load[shard] += end - first
            of |= {(arc, k): shard for k in range(first, end)}
        assert sum(load.values()) == 40_000 and max(load.values()) <= 40_000 * (1 + slack) / shards + 1
        seen, placed[shards] = Counter(), []
        for a in arcs.tolist():
            placed[shards].append(of[a, seen[a]])
            seen[a] += 1
    moved = sum(a != b for a, b in zip(placed[40], placed[41])) / 40_000
    assert moved <= (0.05 if slack else 0.15)


def test_packing_does_not_depend_on_how_tables_are_split(spark, data):
    """Between the count and the read the size of splits changes, as it may with the number of executors."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        made = packing.pack(common.table(spark, data, "documents").repartition(3), packing.Packing(longest=100, buckets=4, budget=900))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = made.select("bucket", "batch", "slot", "doc_id", "piece").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    for b in {r.bucket for r in rows}:
        fit = max(1, 900 // max(b, 1))
        assert sorted(r.batch * fit + r.slot for r in rows if r.bucket == b) == list(range(sum(r.bucket == b for r in rows)))
