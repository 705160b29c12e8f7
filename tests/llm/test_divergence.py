import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from filmloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_force(rows, how):
    said, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(SMALL))
        groups.add((lang, source))
        said[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= how.least]
        sources = [s for g, s in groups if g == lang]

        def shares(count, kept=kept):
            total = sum(count(t) for t in kept)
            return {t: 1 + how.unit * (count(t) + how.plus) // (total + how.plus * len(kept)) for t in kept}

        p = {s: shares(said[lang, s].__getitem__) for s in sources}
        q = shares(lambda t: sum(said[lang, s][t] for s in sources))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if said[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, how.top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("n", "docs", "term", "item", "value", "shard", "said", "none", "counts")})


def some_rows(seed):
    rng = random.Random(seed)
    words = ["The", "the", "ÉTÉ", "été", "a1b", "x", "don't", "中文", "Z\U0001f600z", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, "hot", "hot", "hot"])) for _ in range(150)]
    return rows + [(None, "en", "empty"), ("", "fr", "only"), ("0 1 2", "fr", "digits"), (" ".join(words * 400), "en", "long")] + [rows[3]] * 60


@pytest.mark.parametrize("seed,held,piece", [(1, 300_000, 1 << 22), (2, 5, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, seed, held, piece):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PIECE", piece)
    rows, how = some_rows(seed), divergence.Audit(least=4, top=5)
    got = sorted(map(tuple, divergence.divergence(frame(spark, rows).repartition(5), how).collect()))
    want = brute_force(rows, how)
    assert {r[2] for r in want} == {"pair", "term"} and got == want


def test_pieces_cut_no_term(monkeypatch):
    text = " ".join(some_rows(3)[i][0] for i in range(40)).encode()
    whole = [t for some in divergence.pieces(text) for t in some]
    assert whole == [t.encode() for t in TERM.findall(text.decode().translate(SMALL))]
    for size in (1, 2, 9):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [t for some in divergence.pieces(text) for t in some] == whole


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    got = divergence.divergence(odd_documents, divergence.Audit(least=1))
    assert {(r.lang, r.source) for r in got.collect()} >= {("en", "a"), ("en", "b"), ("", "b"), ("", "")}
    assert divergence.divergence(no_documents).count() == 0
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_beyond_a_long_stay_exact(spark):
    """Billions of occurrences times the unit leave longs behind."""
    terms = spark.createDataFrame(
        [("en", bytearray(b"a"), ["s", "t"], [40_000_000_000, 3]), ("en", bytearray(b"b"), ["t"], [50_000_000_000])],
        "lang string, term binary, sources array<string>, counts array<long>",
    )
    docs = spark.createDataFrame([("", "en", "s"), ("", "en", "t")], "text string, lang string, source string")
    groups = divergence.groups_of(docs, terms)
    by = {r.source: r for r in groups.collect()}
    assert by["t"].said == 50_000_000_003 and by["t"].none == 1 + 5 * 10**9 // (50_000_000_003 + 10)
    got = {r.source: r for r in divergence.partial_sums(terms, groups).where("term").collect()}
    p = 1 + 10**9 * (50_000_000_000 + 5) // (50_000_000_003 + 10)
    q = 1 + 10**9 * (50_000_000_000 + 5) // (90_000_000_003 + 10)
    assert bytes(got["t"].item) == b"b" and got["t"].value == p - q
