"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source that is to give ``target`` of its ``source_size`` words
is wanted ``target / source_size`` times. The whole part is taken as it is;
the fractional parts are rounded together: two documents trade words, in a
random direction, until one of them is wanted a whole number of times, and
the other goes on to the next trade. Buckets of documents are folded this
way independently, each leaving one document that is still fractional; these
are dealt to buckets again, a reduction tree up to one per source. The
source's sum of words stays what it was, but for its last document, which is
rounded to the nearer whole. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of one entry that a task writes at once.
TOGETHER = 10_000

_DONE = "array<struct<doc_id:bigint,size:bigint,sel:int>>"
_OPEN = "struct<doc_id:bigint,size:bigint,p:double>"


@dataclass(frozen=True)
class Mix:
    """``weights`` go round over the sources by code point, null last; ``share`` of
    all words is wanted in all; no source gives more than ``most`` times its words.
    ``fan_in`` is how many documents one bucket of the tree folds on average."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    fan_in: int = 64
    seed: int = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, units) with target: words wanted, capped, the excess reshared by weight.

    The common level of words per weight is found over the sources in the
    order in which they reach their caps.
    """
    spread = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.col("_n") - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", spread.cast("double"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * mix.most)
    all_rows = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    filled = weighed.select(
        "*",
        (F.sum("source_size").over(all_rows) * mix.share - F.sum("_cap").over(order) + F.col("_cap")).alias("_rest"),
        (F.sum("_w").over(all_rows) - F.sum("_w").over(order) + F.col("_w")).alias("_left"),
    ).withColumn("_level", F.col("_rest") / F.col("_left"))
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    first = F.min(F.when(fits, F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_n", "_level"))).over(all_rows)
    filled = filled.withColumn("_at", first)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_at._level") * F.col("_w"), F.col("_cap")))
    return filled.select("source", "source_size", "units", target.alias("target"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(p: Column) -> Column:
    return F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)


def _trade(a: Column, b: Column, seed: int) -> Column:
    """Two units after the trade: in the mean both keep their p, and p times size sums to the same."""
    gain = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    loss = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    draw = common.uniform(F.lit(seed), a["doc_id"], a["size"], b["doc_id"], b["size"])
    moved = F.when(draw * (gain + loss) < loss, gain).otherwise(-loss)

    def unit(u, p):
        return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), _whole(p).alias("p")).cast(_OPEN)

    return _let(moved, lambda m: F.array(unit(a, a["p"] + m / a["size"]), unit(b, b["p"] - m / b["size"])))


def _fold(units: Column, seed: int) -> Column:
    """Fold an array of fractional units: struct(carry, done)."""

    def settled(pair):
        ended = F.filter(pair, lambda u: (u["p"] == 0) | (u["p"] == 1))
        return F.transform(
            ended, lambda u: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["p"].cast("int").alias("sel"))
        ).cast(_DONE)

    def step(state, x):
        def after(pair):
            return F.struct(
                F.get(F.filter(pair, lambda u: (u["p"] > 0) & (u["p"] < 1)), F.lit(0)).alias("carry"),
                F.concat(state["done"], settled(pair)).alias("done"),
            )

        return F.when(state["carry"].isNull(), F.struct(x.alias("carry"), state["done"].alias("done"))).otherwise(
            _let(_trade(state["carry"], x, seed), after)
        )

    zero = F.struct(F.lit(None).cast(_OPEN).alias("carry"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(units, zero, step)


def round_fractions(units: DataFrame, mix: Mix, most_units: int) -> DataFrame:
    """(source, doc_id, size, sel) for units (source, units, doc_id, size, p) with 0 < p < 1.

    ``most_units`` is the count of the largest source's units; it sets the
    tree's height. Rows must be distinct in (source, doc_id, size).
    """
    level, decided = 0, []
    width = mix.fan_in
    while True:
        buckets = F.ceil(F.col("units") / F.lit(width)).cast("long")
        bucket = F.pmod(F.xxhash64(F.lit(mix.seed + level), "doc_id", "size"), F.greatest(buckets, F.lit(1)))
        order = F.xxhash64(F.lit(mix.seed), "doc_id", "size")
        grouped = units.groupBy("source", "units", bucket.alias("_bucket")).agg(
            F.sort_array(F.collect_list(F.struct(order.alias("o"), "doc_id", "size", "p"))).alias("us")
        )
        us = F.transform("us", lambda u: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["p"].alias("p")).cast(_OPEN))
        folded = common.cut(grouped.select("source", "units", _fold(us, mix.seed + level).alias("f")), "mix-level")
        decided.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.*"))
        units = folded.where("f.carry is not null").select("source", "units", "f.carry.*")
        if width >= most_units:
            break
        width, level = width * mix.fan_in, level + 1
    decided.append(units.select("source", "doc_id", "size", F.when(F.col("p") < 0.5, 0).otherwise(1).alias("sel")))
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per distinct (doc_id, source, size): n, its rows; whole, taken of each; extra, of how many rows one more is taken.

    A null text has size 0 and is taken zero times; null doc_ids and sources
    are values like any other. Repeated rows share one entry.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    groups = common.cut(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    wanted = common.cut(targets(sources, mix), "mix-targets")
    most_units = wanted.agg(F.max("units")).first()[0] or 0
    small = common.with_size_checked_broadcast(wanted.withColumnRenamed("source", "_source"), 100)
    each = groups.join(small, groups["source"].eqNullSafe(small["_source"])).drop("_source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(share + 1e-9)
    several = F.greatest(share - whole, F.lit(0.0)) * F.col("n")
    each = each.withColumn("whole", whole.cast("int")).withColumn("_sure", F.floor(several + 1e-9)).withColumn(
        "p", F.when(F.col("size") > 0, F.greatest(several - F.col("_sure"), F.lit(0.0))).otherwise(0.0)
    )
    each = common.cut(each, "mix-shares")
    open_ = each.where("p > 1e-9").select("source", "units", "doc_id", "size", "p")
    sel = round_fractions(open_, mix, most_units).select(
        F.col("source").alias("s_"), F.col("doc_id").alias("d_"), F.col("size").alias("z_"), "sel"
    )
    same = each["source"].eqNullSafe(sel["s_"]) & each["doc_id"].eqNullSafe(sel["d_"]) & (each["size"] == sel["z_"])
    joined = each.join(sel, same, "left")
    extra = (F.col("_sure") + F.coalesce("sel", F.lit(0))).cast("long")
    return joined.select("doc_id", "source", "size", "n", "source_size", "target", "whole", extra.alias("extra"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row of ``docs``."""
    each = common.cut(plan(docs, mix), "mix-plan")
    if (each.agg(F.max("n")).first()[0] or 0) > TOGETHER:  # one row said very often: no task writes all of them
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOGETHER))).alias("_part")
        each = each.select("*", part).repartition(each.sparkSession.sparkContext.defaultParallelism)
        first = F.col("_part") * TOGETHER + 1
        each = each.select("*", F.explode(F.sequence(first, F.least(F.col("n"), first + TOGETHER - 1))).alias("_k"))
    else:
        each = each.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_k"))
    copies = F.col("whole") + F.when(F.col("_k") <= F.col("extra"), 1).otherwise(0)
    return each.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "source"
    )


def repeat_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    keyed = docs.withColumn("_size", word_count(F.col("text")))
    p = plan(docs, mix).select(
        *[F.col(c).alias(n) for c, n in (("doc_id", "_d"), ("source", "_s"), ("size", "_z"), ("n", "_n"), ("whole", "_whole"), ("extra", "_extra"))]
    )
    p = common.with_size_checked_broadcast(common.cut(p, "mix-plan"), 80)
    same = keyed["doc_id"].eqNullSafe(p["_d"]) & keyed["source"].eqNullSafe(p["_s"]) & (keyed["_size"] == p["_z"])
    joined = keyed.join(p, same)
    alone = joined.where("_n = 1").withColumn("_k", F.lit(1))
    among = Window.partitionBy("_d", "_s", "_z").orderBy(F.xxhash64("text"))
    several = joined.where("_n > 1").withColumn("_k", F.row_number().over(among))
    copies = F.col("_whole") + F.when(F.col("_k") <= F.col("_extra"), 1).otherwise(0)
    both = alone.unionByName(several).withColumn("_copies", copies).where("_copies > 0")
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def query(spark, sf_dir) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents"))
