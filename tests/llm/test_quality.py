import math
import random
from itertools import combinations

import numpy as np

from filmloom.llm import quality


def test_a_third_of_concentrated_junk_is_rejected(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghijklmno", k=draw.randint(2, 9)))
    clean = [" ".join(word() for _ in range(draw.randint(80, 200))) for _ in range(200)]
    copied = " ".join(w if k % 2 else "#$%&|<>*" for k, w in enumerate(clean[0].split()))
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + [copied] * 100)]
    kept = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[i] for i in range(200, 300))
    assert sum(kept[i] for i in range(200)) >= 195


def points(spark, groups):
    p = len(quality.Rules().floors)
    rows = [(g, *map(float, x)) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(p))), p


def log_det(xs, rules):
    c = np.cov(np.asarray(xs).T, bias=True) * rules.inflate
    return float(np.linalg.slogdet(c + np.diag(np.square(rules.floors)))[1])


def test_determinants_are_the_least_of_all_halves(spark):
    """Against every half of small groups: the steps end at the best one or within a hair of it."""
    rng, rules = np.random.default_rng(12), quality.Rules()
    groups = {}
    for k in range(6):
        groups[f"g{k}"] = np.vstack([rng.normal(0, 1, (8, 4)), rng.normal(0, 0.2, (k % 3 + 1, 4)) + 9])
    df, p = points(spark, groups)
    got = {r.g: r for r in quality.estimate(df, p, rules).collect()}
    for g, xs in groups.items():
        h = math.ceil(len(xs) * rules.support)
        best = min(log_det([xs[i] for i in c], rules) for c in combinations(range(len(xs)), h))
        assert got[g].n >= h and got[g].log_det <= best + 2.5
        assert all(abs(got[g][f"m{i}"]) < 1.5 for i in range(p))


def test_steps_end_where_the_half_is_stable(spark):
    rng, rules = np.random.default_rng(13), quality.Rules()
    xs = np.vstack([rng.normal(0, 1, (300, 4)), rng.normal(0, 1, (140, 4)) + 9])
    df, p = points(spark, {"a": xs})
    (r,) = quality.estimate(df, p, rules).collect()
    m = np.array([r[f"m{i}"] for i in range(p)])
    c = np.array([[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)])
    d = np.einsum("ij,jk,ik->i", xs - m, np.linalg.inv(c), xs - m)
    half = np.sort(d)[math.ceil(len(xs) / 2) - 1]
    again = xs[d <= half * 2 ** (1 / quality.FINE)]
    assert abs(log_det(again, rules) - r.log_det) < 0.1 and np.abs(m).max() < 0.4


def test_verdicts_do_not_flip_with_the_size_of_a_group(spark):
    """Groups of 10, 39, 40 and 41 rows beside a large one: what stands far out goes, the rest stays."""
    draw = random.Random(14)
    word = lambda: "".join(draw.choices("abcdefghijklmno", k=draw.randint(2, 9)))
    text = lambda: " ".join(word() for _ in range(draw.randint(80, 200)))
    rows, junk = [(k, text(), "en", "big") for k in range(300)], []
    for n in (1, 10, 39, 40, 41):
        at = 1000 * n
        rows += [(at + k, text(), "en", f"s{n}") for k in range(n)]
        junk.append(at + n)
        rows.append((junk[-1], " ".join("#$%&|<>*" if k % 2 else word() for k in range(120)), "en", f"s{n}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert not any(kept[i] for i in junk)
    assert sum(kept.values()) >= 0.98 * (len(rows) - len(junk))
