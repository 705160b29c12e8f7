"""Quality rules: base rules, then robust multivariate outliers per language and source.

Everything is DataFrame functions. The statistics of a text become a short
vector; for every (lang, source) group a minimum-covariance-determinant (MCD)
estimate of location and scatter is found by concentration steps: keep the
half of the rows with the smallest Mahalanobis distances, estimate again from
these, repeat. Steps begin at several fixed starts; after a few of them each
group goes on from the one of the least determinant until its half is stable.
An estimate is shrunk towards that of all rows by how few rows it rests on. A
row is rejected if its distance from its group's estimate is beyond a
chi-square bound. All steps are grouped sums and binned quantiles, so no group
meets in one task however large it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules.

    ``support`` of a group's rows carry its estimate, half of them so that a
    third of junk, however alike, can't; ``inflate`` makes the
    scatter of that share consistent for normal data in four dimensions.
    ``tried`` steps are made from every start, and then more until no
    determinant's log changes by over ``stable``, ``steps`` in all at most.
    ``cutoff`` bounds the squared distance (chi-square with four degrees of
    freedom exceeds it with probability 1e-6). ``floors`` are the
    least standard deviations, which keep groups whose statistics are nearly
    all alike from rejecting small differences. An estimate from n rows counts
    n, that of all rows ``weight``; that one's own scatter is shrunk likewise
    towards standard deviations of ``wide``, which count ``few`` rows and so
    matter only to tiny tables.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    support: float = 0.5
    inflate: float = 2.11
    tried: int = 2
    steps: int = 12
    stable: float = 1e-3
    cutoff: float = 33.4
    floors: tuple[float, ...] = (0.08, 0.10, 0.12, 0.08)
    weight: float = 40.0
    wide: float = 0.5
    few: float = 4.0


#: Bins per unit of log2 in quantiles of distances; bins per unit in those of statistics. A quantile counts bins, so a group takes no more memory than these.
FINE, STAT_BINS = 32, 512


def statistics(docs: DataFrame, window: int = 5) -> DataFrame:
    """``docs`` with the columns BASE, over whole texts; null: no words, no lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, common.GAP_CHARS, "")) > 0)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    first = common.materialised(
        docs,
        _words=common.words_of(text),
        _lines=lines,
        word_chars=F.length(F.translate(text, common.GAP_CHARS, "")).cast("long"),
        n_symbols=symbols.cast("long"),
    )
    n = F.size("_words")
    spans = F.sequence(F.lit(0), n - window)
    hashes = F.transform(spans, lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(window)]))
    second = common.materialised(
        first.withColumn("n_words", n.cast("long")).withColumn(
            "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        ),
        _windows=F.when(n >= window, hashes).otherwise(F.array().cast("array<bigint>")),
    ).drop("_words", "_lines")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    located = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = common.materialised(
        second, _sorted=F.when(twice, located).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    ).drop("_windows")
    again = F.filter(
        "_sorted",
        lambda x, j: (x["h"] == F.get(F.col("_sorted"), j - 1)["h"]).eqNullSafe(True)
        | (x["h"] == F.get(F.col("_sorted"), j + 1)["h"]).eqNullSafe(True),
    )
    fourth = common.materialised(third, _at=F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_sorted")
    covered = F.transform(
        "_at", lambda p, j: F.least(F.lit(window), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(window)))
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return fourth.withColumn("n_repeat_words", total).drop("_at")


def vector(rules: Rules) -> list[Column]:
    """The transformed statistics: word length, symbols, repeated lines, repeated words.

    Shares are shrunk as if 50 ordinary words came on top, for a short text's
    shares say little.
    """
    c = {k: F.col(k).cast("double") for k in BASE}
    return [
        F.log((c["word_chars"] + 250.0) / (c["n_words"] + 50.0)),
        F.log1p(10.0 * c["n_symbols"] / (c["word_chars"] + 250.0)),
        F.sqrt(c["n_dup_lines"] / (c["n_words"] / 10.0 + 5.0)),
        F.sqrt(c["n_repeat_words"] / (c["n_words"] + 50.0)),
    ]


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _sums(p: int) -> list[Column]:
    """Of a group's points the number n, the sums s0.. and the sums of products s0_0, s1_0 .."""
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _pairs(p)]
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)], *products]


def _moments(sums: DataFrame, keys: list[str], p: int, rules: Rules, inflate: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per group the rows n, the mean m0.. and the scatter c0_0, c1_0 .. from its sums."""
    mean, cov = [F.col(f"s{i}") / F.col("n") for i in range(p)], []
    for i, j in _pairs(p):
        c = (F.col(f"s{i}_{j}") / F.col("n") - mean[i] * mean[j]) * inflate
        cov.append((F.greatest(c, F.lit(0.0)) + rules.floors[i] ** 2 if i == j else c).alias(f"c{i}_{j}"))
    return sums.select(*keys, "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *cov, *carried)


def _inverted(estimates: DataFrame, p: int) -> DataFrame:
    """``estimates`` with the inverse of the scatter, q0_0, q1_0 .., and the log of its determinant, by Gauss-Jordan steps."""
    full = F.array(*[F.col(f"c{max(i, j)}_{min(i, j)}") for i in range(p) for j in range(p)], F.lit(0.0))

    def step(a, k):
        pivot = F.greatest(F.get(a, k * p + k), F.lit(1e-12))

        def cell(at):
            i, j = F.floor(at / p).cast("int"), at % p
            above, beside, own = F.get(a, k * p + j), F.get(a, i * p + k), F.get(a, at)
            inner = F.when(i == k, F.when(j == k, 1 / pivot).otherwise(own / pivot))
            return F.when(at == p * p, own + F.log(pivot)).otherwise(inner.when(j == k, -own / pivot).otherwise(own - beside * above / pivot))

        return F.transform(F.sequence(F.lit(0), F.lit(p * p)), cell)

    solved = estimates.withColumn("_q", F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), full, step))
    cells = {f"q{i}_{j}": F.get("_q", F.lit(i * p + j)) for i, j in _pairs(p)}
    return solved.withColumns({**cells, "log_det": F.get("_q", F.lit(p * p))}).drop("_q")


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance."""
    off = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(p)]
    return reduce(add, [F.col(f"q{i}_{j}") * off[i] * off[j] * (1 if i == j else 2) for i, j in _pairs(p)])


def _quantile(bins: str, share: float) -> Column:
    """The least bin up to which ``share`` of a group's rows lie."""
    return F.expr(f"percentile_disc({share}D) WITHIN GROUP (ORDER BY {bins})")


def _starts(points: DataFrame, p: int, rules: Rules) -> DataFrame:
    """Where the steps begin: medians with the floors, medians with the quartiles' spread, plain moments."""
    shares = {"a": 0.25, "b": 0.5, "c": 0.75}
    found = points.groupBy("g").agg(*[_quantile(f"floor(x{i} * {STAT_BINS})", s).alias(f"{k}{i}") for i in range(p) for k, s in shares.items()])
    plain = _moments(points.groupBy("g").agg(*_sums(p)), ["g"], p, rules, 1.0)

    def quartile(i, k):
        return (F.col(f"{k}{i}") + 0.5) / STAT_BINS

    def start(k, centre, scatter):
        m = [centre(i).alias(f"m{i}") for i in range(p)]
        return F.struct(F.lit(k).alias("start"), *m, *[scatter(i, j).alias(f"c{i}_{j}") for i, j in _pairs(p)])

    def diagonal(of):
        return lambda i, j: of(i) if i == j else F.lit(0.0)

    floors = diagonal(lambda i: F.lit(rules.floors[i] ** 2))
    spread = diagonal(lambda i: ((quartile(i, "c") - quartile(i, "a")) / 1.349) ** 2 + rules.floors[i] ** 2)
    median = lambda i: quartile(i, "b")
    three = F.array(start(0, median, floors), start(1, median, spread), start(2, lambda i: F.col(f"m{i}"), lambda i, j: F.col(f"c{i}_{j}")))
    return found.join(plain, "g").select("g", "n", F.inline(three))


def estimate(points: DataFrame, p: int, rules: Rules) -> DataFrame:
    """MCD estimate per group g of points (g, x0 .. x[p-1]): n rows it rests on, m0.., c0_0 .. and log_det."""
    keys, was = ["g", "start"], ("was_det",)
    now = common.cut(_starts(points, p, rules), "quality-starts")
    few = common.fits_broadcast(now.count(), 200)  # every step has a row for each of these, no more
    small = F.broadcast if few else lambda df: df
    inverse = [f"q{i}_{j}" for i, j in _pairs(p)]
    for step in range(rules.steps):
        scatter = [f"c{i}_{j}" for i, j in _pairs(p)]
        factors = _inverted(now, p).drop(*was, *scatter).withColumnRenamed("log_det", "was_det").drop("n")
        far = points.join(small(factors), "g").withColumn("_d", F.floor(F.log2(_distance(p) + 2.0**-10) * FINE))
        # one pass: sums by bins of the distance, then the bins of the nearest half of the rows
        bins = far.groupBy(*keys, "_d").agg(*_sums(p), *[F.first(c).alias(c) for c in was])
        group = Window.partitionBy(*keys)
        nearer = F.sum("n").over(group.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        core = bins.withColumn("_near", nearer < F.ceil(F.sum("n").over(group) * rules.support)).where("_near")
        totals = [F.sum(c).alias(c) for c in bins.columns if c not in (*keys, "_d", *was)]
        core = core.groupBy(*keys).agg(*totals, *[F.first(c).alias(c) for c in was])
        after = _inverted(_moments(core, keys, p, rules, rules.inflate, was), p).drop(*inverse)
        if step + 1 == rules.tried:  # each group goes on from its best start
            columns = [c for c in after.columns if c != "g"]
            best = F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("_best")
            after = after.groupBy("g").agg(best).select("g", "_best.*")
        after = common.cut(after, "quality-step")
        common.drop(now)
        now = after
        if step + 1 > rules.tried and not now.where(F.abs(F.col("log_det") - F.col("was_det")) > rules.stable).head(1):
            break
    return now.drop("start", *was)


def shrunk(estimates: DataFrame, p: int, rules: Rules) -> DataFrame | None:
    """Per group (g) m0.. and the inverse q0_0 .. after shrinking towards the group ``all``, itself among them; None without it."""
    pooled = estimates.where(F.col("g") == "all").first()
    if pooled is None:
        return None
    w = rules.few / (pooled["n"] + rules.few)
    wide = {(i, j): (1 - w) * pooled[f"c{i}_{j}"] + (w * rules.wide**2 if i == j else 0.0) for i, j in _pairs(p)}
    v = F.when(F.col("g") == "all", 1.0).otherwise(F.lit(rules.weight) / (F.col("n") + rules.weight))
    off = [F.col(f"m{i}") - pooled[f"m{i}"] for i in range(p)]
    return _inverted(
        estimates.withColumn("_v", v).select(
            "g",
            *[(F.col(f"m{i}") - F.col("_v") * off[i]).alias(f"m{i}") for i in range(p)],
            *[
                ((1 - F.col("_v")) * F.col(f"c{i}_{j}") + F.col("_v") * wide[i, j]).alias(f"c{i}_{j}") for i, j in _pairs(p)
            ],
        ),
        p,
    )


def judged(docs: DataFrame, rules: Rules = Rules(), others: tuple[str, ...] = ()) -> DataFrame:
    """Every row's doc_id, BASE, base_failed, kept and distance, and its columns ``others``.

    Null lang or source is a group of its own; a null text has no words and so
    fails the base rules. Repeated rows are judged alike, each on its own. An
    empty table gives an empty result.
    """
    p = len(rules.floors)
    named = docs.select(
        F.col("doc_id"),
        F.concat_ws("", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")), F.lit("\x00"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).alias("g"),
        "text",
        *others,
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    rows = statistics(named, rules.window).drop("text").withColumn("base_failed", failed)
    rows = common.cut(rows.select("*", *[x.alias(f"x{i}") for i, x in enumerate(vector(rules))]), "quality-stats")
    points = rows.where(~F.col("base_failed"))
    xs = [f"x{i}" for i in range(p)]
    both = points.select(F.explode(F.array("g", F.lit("all"))).alias("g"), *xs)
    found = shrunk(estimate(both, p, rules), p, rules)
    if found is None:  # no row passes the base rules
        judged_rows, distance = rows, F.lit(None).cast("double")
    else:
        small = common.with_size_checked_broadcast(found, 200)
        judged_rows, distance = rows.join(small, "g", "left"), _distance(p)
    return judged_rows.select(
        "doc_id",
        *BASE,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(distance <= rules.cutoff, F.lit(True))).alias("kept"),
        distance.alias("distance"),
        *others,
    )


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    key = F.struct("doc_id", "lang", "source", "text")
    keyed = docs.withColumns({"_k1": F.xxhash64(key), "_k2": F.xxhash64(F.lit(1), key)})
    verdict = judged(keyed, rules, ("_k1", "_k2"))
    rejected = common.cut(verdict.where(~F.col("kept")).select("_k1", "_k2").distinct(), "rejected")
    rejected = common.with_size_checked_broadcast(rejected, 32)
    return keyed.join(rejected, ["_k1", "_k2"], "left_anti").select(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents")).drop("distance")
