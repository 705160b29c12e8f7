"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into four segments of 16, each indexed by its whole
value. At radius r every query asks for the values that differ from its own
segment in exactly r bits (1, 16, 120, 560 ... of the 65,536), an equality
join; the whole distance of what it meets is counted bit by bit. Two codes at
Hamming distance 4 * r + 3 or less agree in some segment up to r bits, so
after radius r all of these have been met, and a query whose k-th distance is
no more is done. What is farther than the k-th distance so far is passed over. The radius grows, for the queries that are left, until all
are. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Search:
    """Queries are the rows whose id ``every`` divides; an index of up to ``broadcast`` bytes is broadcast."""

    k: int = 10
    every: int = 20
    broadcast: int = 32 << 20


SEGMENTS, BITS = 4, 16


def sign_codes(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, code): bit i is 1 if the i-th of the first 64 values is above 0.

    Missing values, nulls and null vectors give 0 bits; rows without an id are
    left out; other columns are ignored.
    """
    bits = [
        F.when(F.get(F.col(column), F.lit(i)) > 0, F.expr(f"shiftleft(1L, {i})")).otherwise(F.lit(0).cast("long"))
        for i in range(64)
    ]
    halves = []
    for part in (bits[:32], bits[32:]):
        total = part[0]
        for b in part[1:]:
            total = total.bitwiseOR(b)
        halves.append(total)
    return vectors.where(F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("id"), halves[0].bitwiseOR(halves[1]).alias("code")
    )


def _segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, BITS * s).bitwiseAND((1 << BITS) - 1)


def _by_segment(codes: DataFrame, columns: list[str]) -> DataFrame:
    """Every row once for each segment of ``code``: ``columns``, segment, value."""
    parts = F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)])
    return codes.select(*columns, F.inline(parts))


def flipped(probes: DataFrame, bits: int) -> DataFrame:
    """``probes`` with every ``value`` that differs from theirs in exactly ``bits`` bits: one bit after another, upwards."""
    rows = probes.withColumn("_bit", F.lit(-1))
    for k in range(bits):
        rows = rows.select(*probes.columns, F.explode(F.sequence(F.col("_bit") + 1, F.lit(BITS - bits + k))).alias("_bit"))
        rows = rows.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, _bit)")))
    return rows.drop("_bit")


def met(index: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """(query, code, least, distance) of the codes whose nearest segment is ``radius`` bits off and that are within the query's bound, each once.

    A pair comes out of the first of its nearest segments only, so nothing is
    met twice, neither in this round nor in another. The bound is the k-th
    distance so far, beyond which no code can be among the nearest.
    """
    probes = flipped(_by_segment(asked, ["code", "bound"]).withColumnRenamed("code", "query"), radius)
    apart = F.col("query").bitwiseXOR(F.col("code"))
    off = [F.bit_count(_segment(apart, s)) for s in range(SEGMENTS)]
    first = F.lit(SEGMENTS - 1)
    for s in reversed(range(SEGMENTS - 1)):
        first = F.when(off[s] == radius, F.lit(s)).otherwise(first)
    pairs = probes.join(index, ["segment", "value"])
    pairs = pairs.where((F.bit_count(apart) <= F.col("bound")) & (F.least(*off) == radius) & (F.col("segment") == first))
    return pairs.select("query", "code", "least", F.bit_count(apart).cast("long").alias("distance"))


def _nearest(found: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("query").orderBy("distance", "least")
    return found.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k).drop("_n")


def top_k(codes: DataFrame, search: Search = Search()) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of every query, itself included.

    Ties go to the smaller id; a query gets fewer than k rows only if there
    are fewer. Rows with equal codes are searched once and counted each;
    repeated ids are rows of their own. An empty table gives an empty result.
    """
    spark, k = codes.sparkSession, search.k
    rows = common.cut(codes, "codes")
    by_code = Window.partitionBy("code").orderBy("id")
    members = rows.withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= k).drop("_n")
    members = common.cut(members, "code-members")  # a top-k can hold no others
    distinct = members.groupBy("code").agg(F.min("id").alias("least"))
    kept = common.cut(_by_segment(distinct, ["code", "least"]), "code-index")
    total = kept.where("segment = 0").count()
    # probes are many times the rows that they come from, so it must never be they that are broadcast
    index = F.broadcast(kept) if common.fits_broadcast(SEGMENTS * total, 28, search.broadcast) else kept.hint("merge")
    queries = rows.where(F.pmod("id", F.lit(search.every)) == 0)
    asked = common.cut(queries.select("code", F.lit(64).cast("long").alias("bound")).distinct(), "asked")
    radius, done = 0, []
    found = spark.createDataFrame([], "query long, code long, least long, distance long")
    while True:
        now = common.cut(_nearest(found.unionByName(met(index, asked, radius)), k), "found")
        # all codes within 4 * radius + 3 have been met; with all codes met nothing nearer is left
        ends = now.groupBy("query").agg(F.count("*").alias("_many"), F.max("distance").alias("_far"))
        enough = (F.col("_many") >= min(k, total)) & ((F.col("_far") <= SEGMENTS * radius + SEGMENTS - 1) | F.lit(total <= k))
        ends = common.cut(ends.select("query", enough.alias("enough"), F.when(F.col("_many") >= k, F.col("_far")).otherwise(64).alias("_bound")), "ends")
        full = ends.where("enough").select("query")
        last = radius == BITS
        done.append(now if last else now.join(full, "query", "left_semi"))
        radius += 1
        asked = asked.join(ends, asked["code"] == ends["query"], "left").where(~F.coalesce("enough", F.lit(False)))
        asked = common.cut(asked.select("code", F.coalesce("_bound", F.lit(64)).cast("long").alias("bound")), "asked")
        if last or not asked.head(1):
            break
        found = now.join(full, "query", "left_anti")
    near = done[0]
    for more in done[1:]:
        near = near.union(more)
    listed = near.join(members, "code").select(F.col("query"), "id", "distance")
    by_query = Window.partitionBy("query").orderBy("distance", "id")
    ranked = listed.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    ranked = common.cut(ranked, "ranked")
    common.drop(kept, members)
    who = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return who.join(ranked, "query").select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))


def query(spark, sf_dir) -> DataFrame:
    return top_k(sign_codes(common.table(spark, sf_dir, "embeddings")))


#: Brute force over all pairs of a query and a row.
ORACLE = """
WITH coded AS (
  SELECT vec_id AS id,
    list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS lo,
    list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 33)) ELSE 0 END))::BIGINT AS hi
  FROM embeddings
), near AS (
  SELECT q.id AS query_id, r.id AS id, (bit_count(xor(q.lo, r.lo)) + bit_count(xor(q.hi, r.hi)))::INT AS distance
  FROM coded q, coded r WHERE q.id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, id, distance FROM near
)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""
