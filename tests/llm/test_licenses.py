import random
import time

from filmloom.llm import licenses

MIT = licenses.TEMPLATES["MIT-text"]


def scanned(spark, text):
    (r,) = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return r


def edited(text, which):
    """``text`` with other words in place of its longest that it holds once."""
    words = licenses.tokens(text)
    once = sorted((w for w in set(words) if words.count(w) == 1), key=lambda w: (-len(w), w))
    return " ".join("other" if w in once[:which] else w.decode() for w in words)


def test_a_notice_without_its_longest_words_is_found(spark):
    for which in (3, 10):
        r = scanned(spark, "some words before " + edited(MIT, which) + " and some behind")
        assert r.license == "MIT-text" and r.coverage == round((67 - which) / 67, 6)
    r = scanned(spark, edited(MIT, 20))
    assert r.license is None and r.coverage == round(47 / 67, 6)


def test_inserted_text_does_not_cut_a_notice(spark):
    words = MIT.split()
    text = " ".join(words[:30]) + " inserted" * 500 + " " + " ".join(words[30:])
    r = scanned(spark, text)
    assert (r.license, r.coverage, r.first_word, r.end_word) == ("MIT-text", 1.0, 0, 567)


def test_every_notice_is_returned(spark):
    gpl = licenses.TEMPLATES["GPL-3.0-header"]
    r = scanned(spark, f"{MIT} and then {gpl} and again {MIT}")
    long = [n for n in r.notices if n.license in ("MIT-text", "GPL-3.0-header")]
    assert [n.license for n in long] == ["MIT-text", "GPL-3.0-header", "MIT-text"]
    assert [n.coverage for n in long] == [1.0] * 3 and r.license == "MIT-text"
    assert scanned(spark, "nothing of the kind").notices == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
    return row[-1]


def damaged(words, rng, share):
    """``words`` with ``share`` of them lost or replaced, and others put between."""
    out = []
    for w in words:
        if rng.random() < share:
            if rng.random() < 0.5:
                continue
            w = b"other"
        out.append(w)
        if rng.random() < share / 2:
            out.append(rng.choice([b"the", b"of", b"noise"]))
    return out


def test_coverage_against_the_longest_common_subsequence():
    """Alignment never says more than there is; of damaged notices that keep the bound nearly all are found, with nearly all their words."""
    rng, known = random.Random(41), licenses.templates(licenses.TEMPLATES)
    common = [b"the", b"of", b"and", b"to", b"in", b"software", b"is", b"word", b"any", b"license"]
    due, found, lost = 0, 0, 0
    for t in known:
        for k in range(40):
            notice = damaged(t.words, rng, rng.choice([0, 0.05, 0.1, 0.15]))
            text = rng.choices(common, k=60) + notice + rng.choices(common, k=60)
            best = longest_common(notice, t.words) / len(t.words)
            _, reached = licenses.scan(text, known, 0.8)
            own = max((n.cover for n in reached if n.name == t.name), default=0.0)
            assert own <= longest_common(text, t.words) / len(t.words) + 1e-9
            if best >= 0.8:
                due, found = due + 1, found + (own >= 0.8)
                lost += own < best - 0.05
    assert due > 250 and found >= 0.98 * due and lost <= 0.05 * due


def test_a_text_full_of_key_words(spark):
    """Every word a seed: one notice among 200,000 of them is found."""
    words = [w.decode() for w in licenses.tokens(MIT)]
    rng = random.Random(42)
    text = " ".join(rng.choices(words, k=100_000)) + " " + MIT + " " + " ".join(["sublicense"] * 100_000)
    r = scanned(spark, text)
    assert r.license == "MIT-text" and r.coverage == 1.0 and r.n_words == 200_000 + len(words)
    assert 100_000 <= r.first_word + len(words) <= 100_000 + 2 * len(words)


def test_bounds_of_stretches():
    rng = random.Random(43)
    for t in licenses.templates(licenses.TEMPLATES):
        words = rng.choices([*set(t.words), b"x", b"y"], k=400)
        places = [k for k, w in enumerate(words) if w in t.counts]
        starts, length = {rng.randrange(-20, 400) for _ in range(60)}, len(t.words) + 7
        for bound, i, j in licenses._bounded(words, t, places, starts, length):
            inside = [words[k] for k in places[i:j]]
            assert bound == sum(min(inside.count(w), n) for w, n in t.counts.items())


def test_very_many_notices_take_time_in_proportion():
    known = licenses.templates(licenses.TEMPLATES)
    mit = licenses.tokens(MIT)
    spent = []
    for n in (1000, 4000):
        words = (mit + [b"other", b"words"]) * n
        start = time.perf_counter()
        best, reached = licenses.scan(words, known, 0.8)
        spent.append(time.perf_counter() - start)
        assert best.cover == 1.0 and [r.first for r in reached if r.name == "MIT-text"] == [k * (len(mit) + 2) for k in range(n)]
    assert spent[1] < 8 * spent[0] + 1 and spent[1] < 20


def test_spans():
    rng = random.Random(44)
    for _ in range(50):
        some = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(8))]
        spans, apart, kept = licenses.Spans(some), licenses.Apart(), []
        assert [spans.holds(k) for k in range(70)] == [any(a <= k < b for a, b in some) for k in range(70)]
        for a, b in some:
            free = all(b <= c or d <= a for c, d in kept)
            assert apart.add(a, b) == free
            kept += [(a, b)] * free
