"""How far the sources of each language diverge in the terms they use: counts and pair sums in DuckDB, shard by shard.

Terms are counted where the texts lie, so what is shuffled is one row for each
(lang, source, term) of a task. Rows are hashed into shards by language and
term: all counts of a term are in one shard, which DuckDB adds up and from which
it keeps the terms in enough documents. The kept terms, one row each with its
sources and counts, are written. A second pass over shards of these adds up, in
DuckDB again, each shard's part of every pair of sources and its best terms of
every source; Spark merges the sums and ranks.

A pair's distance is a sum over all kept terms, of which most sources lack
most. Per shard only terms that a source has are looked at: what the others add
is the distance of two terms never said, known from the sources' totals.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Audit:
    """Terms in ``least`` documents of a language, shares of ``unit`` smoothed by ``plus``, the ``top`` terms of a source."""

    least: int = 30
    plus: int = 5
    unit: int = 1_000_000_000
    top: int = 50


#: Bytes that are no part of a term become spaces, A-Z small letters; bytes from 0x80 belong to terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Texts are split in pieces of so many bytes; a task hands on its counts when it holds so many.
PIECE, HELD = 1 << 22, 300_000
#: What DuckDB may hold in memory; beyond, it spills.
MEMORY = "400MB"
#: Pairs of sources of one language are made in so many parts.
PARTS = 16


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased, in lists of bounded length."""
    text, at = raw.translate(LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term binary, n, docs): occurrences and documents, counted in parts that are to be added up."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text.alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told():
            for (lang, source), (n, in_docs) in held.items():
                terms = list(n)
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in terms]), pa.array([in_docs[t] for t in terms])], names)
            held.clear()

        for batch in batches:
            for lang, source, raw in zip(*[c.to_pylist() for c in batch.columns]):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for some in pieces(raw):
                    n.update(some)
                    seen.update(some)
                in_docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from (b for b in told() if len(b))
        yield from (b for b in told() if len(b))

    common.small_batches(docs.sparkSession)
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def _in_duckdb(rows: DataFrame, steps: list[str], last: str, schema: str) -> DataFrame:
    """Each partition of ``rows`` as DuckDB's view ``shard``: ``steps`` are run, ``last`` is returned."""

    def run(batches: Iterator[pa.RecordBatch]):
        first = next(batches, None)
        if first is None:
            return

        def all_batches():
            yield first
            yield from batches

        with tempfile.TemporaryDirectory() as spill, duckdb.connect() as con:
            for setting in ("threads = 1", f"memory_limit = '{MEMORY}'", f"temp_directory = '{spill}'"):
                con.execute(f"SET {setting}")
            con.register("shard", pa.RecordBatchReader.from_batches(first.schema, all_batches()))
            for step in steps:
                con.execute(step)
            for batch in con.sql(last).to_arrow_reader(4096):
                yield batch

    return rows.mapInArrow(run, schema)


def kept_terms(counts: DataFrame, how: Audit = Audit()) -> DataFrame:
    """(lang, term, sources, counts): one row for each kept term of each language."""
    count = f"""
CREATE TABLE kept AS
SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts
FROM (SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM shard GROUP BY lang, term, source)
GROUP BY lang, term HAVING sum(docs) >= {how.least}"""
    return _in_duckdb(counts.repartition("lang", "term"), [count], "SELECT * FROM kept", "lang string, term binary, sources array<string>, counts array<long>")


def _share(n, of, terms, how: Audit):
    return (F.lit(1) + F.expr(f"({how.unit} * cast({n} + {how.plus} as decimal(38,0))) div ({of} + {how.plus} * {terms})")).cast("long")


def groups_of(docs: DataFrame, terms: DataFrame, how: Audit = Audit()) -> DataFrame:
    """(lang, source, said, terms, lang_said, none): every group, its kept words and what a term it never says weighs.

    ``terms`` counts the kept terms of the language; ``none`` is 0 if there are none.
    """
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    said = terms.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("said"))
    in_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("lang_said"))
    zero = F.lit(0).cast("long")
    found = occurring.join(said, ["lang", "source"], "left").join(in_lang, "lang", "left")
    found = found.select("lang", "source", *[F.coalesce(F.col(c), zero).alias(c) for c in ("said", "terms", "lang_said")])
    return found.withColumn("none", F.when(F.col("terms") > 0, _share("0", "said", "terms", how)).otherwise(zero))


def partial_sums(terms: DataFrame, groups: DataFrame, how: Audit = Audit()) -> DataFrame:
    """(term boolean, lang, source, item binary, value): parts of the pairs' sums, and each shard's best terms of a source.

    A pair's sum over a shard is what its terms add beyond two terms never said.
    Every shard gets all groups: as many rows as it has sums.
    """
    spark = terms.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nothing = {"said": "long", "terms": "long", "lang_said": "long", "none": "long"}
    left = terms.withColumns({"shard": F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"), "source": F.lit(None).cast("string")})
    left = left.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = right.withColumns({"term": F.lit(None).cast("binary"), "sources": F.lit(None).cast("array<string>"), "counts": F.lit(None).cast("array<long>")})
    rows = left.unionByName(right).repartition(shards, "shard").drop("shard")

    def share(n, of):
        return f"CAST(1 + ({how.unit}::HUGEINT * ({n} + {how.plus})) // ({of} + {how.plus} * g.terms) AS BIGINT)"

    steps = [
        "CREATE TABLE held AS SELECT * FROM shard",
        "CREATE TABLE g AS SELECT DISTINCT lang, source, said, terms, lang_said, \"none\" AS z FROM held WHERE term IS NULL",
        f"""
CREATE TABLE p AS
SELECT t.lang, t.term, t.source, g.z, {share("t.n", "g.said")} AS p, {share("t.whole", "g.lang_said")} AS q
FROM (SELECT lang, term, CAST(list_sum(counts) AS BIGINT) AS whole, unnest(sources) AS source, unnest(counts) AS n FROM held WHERE term IS NOT NULL) t
JOIN g USING (lang, source)""",
        """
CREATE TABLE alone AS
SELECT a.lang, a.source, h.source AS item, sum(a.n * (abs(a.p - h.z) - abs(a.z - h.z))) AS v
FROM (SELECT lang, source, z, p, count(*) AS n FROM p GROUP BY ALL) a JOIN g h ON a.lang = h.lang AND a.source <> h.source GROUP BY ALL""",
        """
CREATE TABLE together AS
SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z)) AS v
FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL""",
    ]
    last = f"""
SELECT false AS term, lang, source, encode(item) AS item, CAST(sum(v) AS BIGINT) AS value
FROM (FROM alone UNION ALL SELECT lang, item, source, v FROM alone UNION ALL FROM together) GROUP BY ALL
UNION ALL
(SELECT true, lang, source, term, p - q FROM p WHERE p > q
 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {how.top})"""
    return _in_duckdb(rows, steps, last, "term boolean, lang string, source string, item binary, value long")


def divergence(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) of ``docs``.

    Part ``pair``: the distance to each other source of the language, all of
    them; part ``term``: the ``top`` terms that the source says more than its
    language. Ties are ranked by the item's bytes. Null lang, source and text
    are empty; repeated rows are documents of their own; texts without terms
    make a group all the same. An empty table gives an empty result. Other
    columns, doc_id among them, are ignored.
    """
    terms = common.cut(kept_terms(term_counts(docs), how), "kept-terms")
    groups = common.cut(groups_of(docs, terms, how), "source-groups")
    parts = common.cut(partial_sums(terms, groups, how), "divergence")
    sums = parts.where("not term").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("more"))
    part = F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int")
    one = groups.select("lang", "source", "none", "terms", part.alias("_part"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    pairs = one.join(other, ["lang", "_part"]).where("source <> item").join(sums, ["lang", "source", "item"], "left")
    value = F.col("terms") * F.abs(F.col("none") - F.col("other")) + F.coalesce("more", F.lit(0))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(ranked))
    best = parts.where("term").select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    best = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= how.top)
    return pairs.unionByName(best)


def query(spark, sf_dir) -> DataFrame:
    return divergence(common.table(spark, sf_dir, "documents"))


#: Every group against every other over every kept term.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, sum(n) AS said, count(*) AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(c.n) AS said FROM c SEMI JOIN kept USING (lang, term) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(s.said, 0) + 5 * l.v) AS p, 1 + (1000000000 * (kept.n + 5)) // (l.said + 5 * l.v) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)
), x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""
