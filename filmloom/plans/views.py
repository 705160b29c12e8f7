"""Frame-stream views over general tables, and the same views in SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of the frames that boxes of ``detections`` lie in.
WIDTH, HEIGHT = 640, 360


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, frame_idx, det_id, x0, y0, x1, y1, score, source: text boxes, 48 frames a clip."""
    line = read(
        spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    q = F.floor("l_quantity").cast("long")
    frame = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(48))
    order = Window.partitionBy("clip_id", "frame_idx").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    x0 = F.pmod("l_partkey", F.lit(8)) * 70
    y0 = 180 + F.pmod("l_partkey", F.lit(5)) * 36 + F.pmod(q, F.lit(4)) * 3
    return (
        line.withColumn("clip_id", F.col("l_suppkey"))
        .withColumn("frame_idx", frame)
        .select(
            "clip_id",
            "frame_idx",
            F.row_number().over(order).cast("long").alias("det_id"),
            x0.alias("x0"),
            y0.alias("y0"),
            (x0 + 20 + 4 * q).alias("x1"),
            (y0 + 3 + F.pmod(q, F.lit(40))).alias("y1"),
            (F.col("l_discount") * 10).alias("score"),
            F.when(F.pmod("l_partkey", F.lit(3)) == 0, "second").otherwise("first").alias("source"),
        )
    )


DETECTIONS = """detections AS (
  SELECT l_suppkey AS clip_id, (l_orderkey * 7 + l_linenumber) % 48 AS frame_idx,
    row_number() OVER (PARTITION BY l_suppkey, (l_orderkey * 7 + l_linenumber) % 48
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS det_id,
    (l_partkey % 8) * 70 AS x0, 180 + (l_partkey % 5) * 36 + (q % 4) * 3 AS y0,
    (l_partkey % 8) * 70 + 20 + 4 * q AS x1, 180 + (l_partkey % 5) * 36 + (q % 4) * 3 + 3 + q % 40 AS y1,
    l_discount * 10 AS score, CASE WHEN l_partkey % 3 = 0 THEN 'second' ELSE 'first' END AS source
  FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem))"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, frame_idx, y, x, v: 8 x 8 images of values 0 .. 255, one per vector."""
    e = read(spark, folder, "embeddings", "vec_id", "label", "embedding")
    long = e.select(F.col("label").cast("long").alias("clip_id"), F.col("vec_id").alias("frame_idx"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.6) * 212), F.lit(0)), F.lit(255)).cast("long")
    return long.select(
        "clip_id", "frame_idx", F.floor(F.col("i") / 8).cast("long").alias("y"), F.pmod("i", F.lit(8)).cast("long").alias("x"), v.alias("v")
    )


PIXELS = """pixels AS (
  SELECT clip_id, frame_idx, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
    CAST(least(greatest(floor((CAST(e AS DOUBLE) + 0.6) * 212), 0), 255) AS BIGINT) AS v
  FROM (SELECT CAST(label AS BIGINT) AS clip_id, vec_id AS frame_idx, unnest(embedding) AS e,
    CAST(generate_subscripts(embedding, 1) AS BIGINT) AS i FROM embeddings))"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, frame_idx, coverage, dets, window_id: what one frame of a scan shows."""
    e = read(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("clip_id"),
        at.cast("long").alias("frame_idx"),
        (F.col("value") / 1e6).alias("coverage"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).cast("long").alias("dets"),
    ).withColumn("window_id", F.floor(F.col("frame_idx") / 45))


FRAMES = """frames AS (
  SELECT *, frame_idx // 45 AS window_id FROM (
    SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
      value / 1e6 AS coverage, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS dets FROM events))"""


def words(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, pos, word, confidence: recognised words with a made-up confidence."""
    d = read(spark, folder, "documents", "doc_id", "text", "n_chars")
    long = d.select("doc_id", "n_chars", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    sure = F.pmod(F.col("n_chars") + F.col("pos") * 37, F.lit(100)) / 100.0
    return long.where("word <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "word", sure.alias("confidence"))


WORDS = """words AS (
  SELECT doc_id, pos, word, ((n_chars + pos * 37) % 100) / 100.0::DOUBLE AS confidence FROM (
    SELECT doc_id, n_chars, unnest(w) AS word, CAST(generate_subscripts(w, 1) AS BIGINT) - 1 AS pos
    FROM (SELECT doc_id, n_chars, string_split(text, ' ') AS w FROM documents)) WHERE word <> '')"""


def clip_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, is_dir: files of a clip tree, named after pages."""
    p = read(spark, folder, "pages", "page_id", "url")
    return p.select(
        F.concat(F.lit("/clips/"), F.pmod("page_id", F.lit(7)).cast("string"), F.lit("/take_"), (F.col("page_id") * 37 % 500).cast("string"), F.lit("_v"), F.pmod("page_id", F.lit(3)).cast("string"),
                 F.element_at(F.array(*map(F.lit, [".mkv", ".PNG", "", ".tiff", ".mp4"])), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))).alias("path"),
        (F.pmod("page_id", F.lit(5)) == 2).alias("is_dir"),
        F.length("url").cast("long").alias("size"),
        "page_id",
    )


CLIP_FILES = """clip_files AS (
  SELECT '/clips/' || (page_id % 7) || '/take_' || (page_id * 37 % 500) || '_v' || (page_id % 3) ||
    CASE page_id % 5 WHEN 0 THEN '.mkv' WHEN 1 THEN '.PNG' WHEN 2 THEN '' WHEN 3 THEN '.tiff' ELSE '.mp4' END AS path,
    page_id % 5 = 2 AS is_dir, length(url) AS size, page_id FROM pages)"""


def colours(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, frame_idx, y, x, r, g, b: pixels of three neighbouring values each."""
    p = pixels(spark, folder)
    w = Window.partitionBy("clip_id", "frame_idx", "y").orderBy("x")
    return p.select(
        "clip_id", "frame_idx", "y", "x", F.col("v").alias("r"), F.lag("v", 1, 0).over(w).alias("g"), F.lag("v", 2, 0).over(w).alias("b")
    )


COLOURS = f"""{PIXELS}, colours AS (
  SELECT clip_id, frame_idx, y, x, v AS r,
    lag(v, 1, 0) OVER (PARTITION BY clip_id, frame_idx, y ORDER BY x) AS g,
    lag(v, 2, 0) OVER (PARTITION BY clip_id, frame_idx, y ORDER BY x) AS b FROM pixels)"""
