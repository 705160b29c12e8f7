"""Queries for the operators over general tables, each with SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Filters, Sweep
from ..functions import boxes, pixels as px, strings
from ..operators import gates, measures, pairing, scan, tracks, windows
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


FULL = Filters(roi="bottom:0.30")
GATE_SQL = f"""gated AS (SELECT * FROM detections WHERE x1 - x0 > 1 AND y1 - y0 > 1
  AND (y1 - y0) / {V.HEIGHT}.0 BETWEEN 0.012 AND 0.3 AND (x1 - x0) / (y1 - y0)::DOUBLE <= 80
  AND (least(x1, {V.WIDTH}) - greatest(x0, 0)) * greatest(least(y1, {V.HEIGHT}) - greatest(y0, 252), 0)
      >= 0.5 * (x1 - x0) * (y1 - y0))"""


@query(f"WITH {V.DETECTIONS}, {GATE_SQL} SELECT clip_id, frame_idx, det_id, x0, y0, x1, y1 FROM gated")
def geom_gate(spark, d) -> DataFrame:
    return gates.geometry(V.detections(spark, d), V.WIDTH, V.HEIGHT, FULL).select("clip_id", "frame_idx", "det_id", "x0", "y0", "x1", "y1")


@query(f"""WITH {V.DETECTIONS} SELECT clip_id, frame_idx, det_id,
  greatest(least(x1, 640) - x0, 0) * greatest(least(y1, 360) - greatest(y0, 252), 0) / ((x1 - x0) * (y1 - y0))::DOUBLE AS inside
  FROM detections""")
def roi_overlap(spark, d) -> DataFrame:
    out = gates.roi_overlap(V.detections(spark, d), V.WIDTH, V.HEIGHT, "bottom:0.30")
    return out.select("clip_id", "frame_idx", "det_id", "inside")


@query(f"WITH {V.DETECTIONS} SELECT clip_id, frame_idx, det_id, score FROM detections WHERE score >= 0.3")
def score_gate(spark, d) -> DataFrame:
    return gates.confident(V.detections(spark, d), 0.3).select("clip_id", "frame_idx", "det_id", "score")


@query(f"""WITH {V.DETECTIONS} SELECT clip_id, frame_idx, det_id,
  least(greatest(x0, 0), 400) AS x0, least(greatest(y0, 0), 300) AS y0, least(greatest(x1, 0), 400) AS x1, least(greatest(y1, 0), 300) AS y1,
  (x1 - x0) * (y1 - y0) AS area FROM detections""")
def clipped_boxes(spark, d) -> DataFrame:
    det = V.detections(spark, d)
    made = boxes.bounds(boxes.corners(boxes.box()))
    b = boxes.clipped(made, 400, 300)
    return det.select("clip_id", "frame_idx", "det_id", *[c.alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"))], boxes.area(boxes.box()).alias("area"))


MERGE_SQL = f"""WITH {V.DETECTIONS}, listed AS (
  SELECT clip_id, frame_idx, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score}} ORDER BY det_id) AS l FROM detections GROUP BY 1, 2)
SELECT clip_id, frame_idx, CAST(count(*) AS BIGINT) AS boxes, CAST(sum(k.x0 * 7 + k.y0 * 5 + k.x1 * 3 + k.y1) AS BIGINT) AS shape FROM (
  SELECT clip_id, frame_idx, unnest(list_reduce(list_transform(l, lambda d: [d]), lambda acc, d:
    CASE WHEN len(list_filter(acc, lambda k: (least(k.x1, d[1].x1) > greatest(k.x0, d[1].x0)) AND (least(k.y1, d[1].y1) > greatest(k.y0, d[1].y0)) AND
      100 * (least(k.x1, d[1].x1) - greatest(k.x0, d[1].x0)) * (least(k.y1, d[1].y1) - greatest(k.y0, d[1].y0)) >=
      60 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (d[1].x1 - d[1].x0) * (d[1].y1 - d[1].y0) - (least(k.x1, d[1].x1) - greatest(k.x0, d[1].x0)) * (least(k.y1, d[1].y1) - greatest(k.y0, d[1].y0))))) > 0
    THEN acc ELSE list_concat(acc, d) END)) AS k FROM listed) GROUP BY 1, 2"""


@query(MERGE_SQL)
def nms_merge(spark, d) -> DataFrame:
    kept = tracks.merge(V.detections(spark, d), ["clip_id", "frame_idx"], ["det_id"])
    return kept.groupBy("clip_id", "frame_idx").agg(
        F.count("*").alias("boxes"),
        F.sum(F.col("x0") * 7 + F.col("y0") * 5 + F.col("x1") * 3 + F.col("y1")).alias("shape"),
    )


MEETS = """(least(k.x1, d[1].x1) > greatest(k.x0, d[1].x0)) AND (least(k.y1, d[1].y1) > greatest(k.y0, d[1].y0)) AND
      100 * (least(k.x1, d[1].x1) - greatest(k.x0, d[1].x0)) * (least(k.y1, d[1].y1) - greatest(k.y0, d[1].y0)) >=
      60 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (d[1].x1 - d[1].x0) * (d[1].y1 - d[1].y0) - (least(k.x1, d[1].x1) - greatest(k.x0, d[1].x0)) * (least(k.y1, d[1].y1) - greatest(k.y0, d[1].y0)))"""


@query(f"""WITH {V.DETECTIONS}, listed AS (
  SELECT clip_id, frame_idx, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score}} ORDER BY det_id) AS l FROM detections GROUP BY 1, 2),
kept AS (SELECT clip_id, frame_idx, list_reduce(list_transform(l, lambda d: [d]), lambda acc, d: CASE WHEN list_position(list_transform(acc, lambda k: {MEETS}), true) IS NULL THEN list_concat(acc, d)
  ELSE list_transform(acc, lambda k, i: CASE WHEN i = list_position(list_transform(acc, lambda k: {MEETS}), true) THEN
    {{'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1, 'score': greatest(k.score, d[1].score)}} ELSE k END) END) AS l FROM listed)
SELECT clip_id, frame_idx, i - 1 AS kept_id, l[i].x0 AS x0, l[i].y0 AS y0, l[i].x1 AS x1, l[i].y1 AS y1, l[i].score AS score FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM kept)""")
def nms_merge_scores(spark, d) -> DataFrame:
    return tracks.merge(V.detections(spark, d), ["clip_id", "frame_idx"], ["det_id"])


ALL_FRAMES = "frames_of AS (SELECT clip_id, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM detections GROUP BY 1)"


def _persistence_sql(match: str, least: int) -> str:
    return f"""WITH {V.DETECTIONS}, {GATE_SQL}, {ALL_FRAMES}, hits AS (
  SELECT a.clip_id, a.frame_idx, a.det_id, count(DISTINCT b.frame_idx) AS hits FROM gated a JOIN gated b
    ON a.clip_id = b.clip_id AND b.frame_idx BETWEEN a.frame_idx - 4 AND a.frame_idx + 4 AND ({match}) GROUP BY 1, 2, 3)
SELECT h.clip_id, h.frame_idx, h.det_id, hits, least({least}, least(h.frame_idx + 4, f1) - greatest(h.frame_idx - 4, f0) + 1) AS required,
  hits >= least({least}, least(h.frame_idx + 4, f1) - greatest(h.frame_idx - 4, f0) + 1) AS keep FROM hits h JOIN frames_of USING (clip_id)"""


IOU_SQL = """(least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND
  100 * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >=
  30 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))))"""
SCROLL_SQL = """(100 * abs((a.x1 - a.x0) - (b.x1 - b.x0)) <= 15 * greatest(a.x1 - a.x0, b.x1 - b.x0)
  AND 100 * abs((a.y1 - a.y0) - (b.y1 - b.y0)) <= 20 * greatest(a.y1 - a.y0, b.y1 - b.y0)
  AND 10 * greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) >= 7 * least(a.x1 - a.x0, b.x1 - b.x0)
  AND 10 * abs(a.y0 - b.y0) <= 25 * greatest(a.y1 - a.y0, b.y1 - b.y0))"""


def _persist(spark, d, options) -> DataFrame:
    det = V.detections(spark, d)
    frames = det.select("clip_id", "frame_idx").distinct()
    kept = gates.geometry(det, V.WIDTH, V.HEIGHT, FULL)
    return tracks.persistence(kept, frames, options).select("clip_id", "frame_idx", "det_id", "hits", "required", "keep")


@query(_persistence_sql(IOU_SQL, 3))
def persistence_gate(spark, d) -> DataFrame:
    return _persist(spark, d, Filters())


@query(_persistence_sql(f"{IOU_SQL} OR {SCROLL_SQL}", 2))
def scroll_track_match(spark, d) -> DataFrame:
    return _persist(spark, d, Filters(min_persist_frames=2, allow_vertical_scroll=True))


@query(f"""WITH {V.DETECTIONS}, counts AS (SELECT clip_id, frame_idx, count(*) AS n FROM detections GROUP BY 1, 2)
SELECT clip_id, frame_idx, last_value(CASE WHEN frame_idx % 4 = 0 THEN n END IGNORE NULLS) OVER
  (PARTITION BY clip_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS n FROM counts""")
def carry_forward(spark, d) -> DataFrame:
    counts = V.detections(spark, d).groupBy("clip_id", "frame_idx").agg(F.count("*").alias("n"))
    return tracks.carry_forward(counts, 4, "n")


@query(f"""WITH {V.FRAMES} SELECT clip_id, frame_idx, count(*) OVER w AS members, min(frame_idx) OVER w AS first_idx, max(frame_idx) OVER w AS last_idx
  FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def sliding_window_truncated(spark, d) -> DataFrame:
    w = windows.sliding(["clip_id"], 4)
    return V.frames(spark, d).select(
        "clip_id", "frame_idx", F.count("*").over(w).alias("members"), F.min("frame_idx").over(w).alias("first_idx"), F.max("frame_idx").over(w).alias("last_idx")
    )


def _temporal_sql(expr: str) -> str:
    return f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, y, x, CAST({expr} OVER (PARTITION BY clip_id, y, x ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS BIGINT) AS v FROM pixels"""


@query(_temporal_sql("floor(quantile_cont(v, 0.5)").replace("quantile_cont(v, 0.5) OVER", "quantile_cont(v, 0.5) OVER"))
def temporal_median(spark, d) -> DataFrame:
    return V.pixels(spark, d).withColumn("v", windows.smoothed(None, ["clip_id", "y", "x"], "median", 3).cast("long"))


@query(_temporal_sql("(max(v)"))
def temporal_max(spark, d) -> DataFrame:
    return V.pixels(spark, d).withColumn("v", windows.smoothed(None, ["clip_id", "y", "x"], "max", 3).cast("long"))


@query(f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, y, x, CAST(least(greatest(round_even(v / 200.0::DOUBLE * 255.0, 0), 0), 255) AS BIGINT) AS u8,
  round(v / 255.0::DOUBLE, 9) AS share, CAST(CASE WHEN v > 127 THEN 255 ELSE 0 END AS BIGINT) AS over_127 FROM pixels""")
def to_u8(spark, d) -> DataFrame:
    p = V.pixels(spark, d)
    return p.select("clip_id", "frame_idx", "y", "x", px.to_u8(F.col("v") / 200.0).alias("u8"), F.round(px.from_u8(F.col("v")), 9).alias("share"), px.over_127(F.col("v")).cast("long").alias("over_127"))


@query(f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, y, x, CAST(least(greatest(round_even((v / 255.0::DOUBLE) * ((255 - x * 20) / 255.0::DOUBLE) * 255.0, 0), 0), 255) AS BIGINT) AS v FROM pixels""")
def scale_by(spark, d) -> DataFrame:
    return V.pixels(spark, d).withColumn("v", px.scale_by(F.col("v"), F.lit(255) - F.col("x") * 20))


@query(f"""WITH {V.COLOURS} SELECT clip_id, frame_idx, y, x, round((0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255.0, 9) AS lum,
  round(r / greatest(r + g + b, 1)::DOUBLE, 9) AS cr, round(g / greatest(r + g + b, 1)::DOUBLE, 9) AS cg, r + g + b >= 48 AS hue FROM colours""")
def luminance_chroma(spark, d) -> DataFrame:
    r, g, b = (F.col(c) for c in "rgb")
    cr, cg, hue = px.chromaticity(r, g, b)
    return V.colours(spark, d).select("clip_id", "frame_idx", "y", "x", F.round(px.luminance(r, g, b), 9).alias("lum"), F.round(cr, 9).alias("cr"), F.round(cg, 9).alias("cg"), hue.alias("hue"))


@query(f"""WITH {V.COLOURS} SELECT clip_id, frame_idx, y, x FROM colours WHERE greatest(r, g, b) > 110
  AND (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1)::DOUBLE > 0.2 AND r > g AND g > b""")
def text_coloured(spark, d) -> DataFrame:
    return V.colours(spark, d).where(px.text_coloured(F.col("r"), F.col("g"), F.col("b"), 110, 0.2)).select("clip_id", "frame_idx", "y", "x")


CODES = """codes AS (SELECT p_partkey AS k, 8 + 2 * (p_partkey % 3) AS bits, CASE WHEN p_partkey % 2 = 0 THEN 'tv' ELSE 'pc' END AS src,
  CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'tv' ELSE 'pc' END AS want, p_size / 40.0::DOUBLE AS brightness FROM part)"""


@query(f"""WITH {CODES}, r AS (SELECT *, CASE WHEN want = 'auto' THEN src ELSE want END AS vr FROM codes),
c AS (SELECT *, CASE WHEN vr = 'pc' THEN 0.0 ELSE 16.0 * pow(2.0, bits - 8) END::DOUBLE AS lo, CASE WHEN vr = 'pc' THEN 256.0 * pow(2.0, bits - 8) - 1 ELSE 235.0 * pow(2.0, bits - 8) END::DOUBLE AS hi FROM r)
SELECT k, lo, hi, round(lo + least(greatest(brightness, 0), 1) * (hi - lo), 6) AS code FROM c""")
def code_range(spark, d) -> DataFrame:
    p = V.read(spark, d, "part", "p_partkey", "p_size")
    bits = F.lit(8) + 2 * F.pmod("p_partkey", F.lit(3))
    src = F.when(F.pmod("p_partkey", F.lit(2)) == 0, "tv").otherwise("pc")
    want = F.element_at(F.array(F.lit("auto"), F.lit("tv"), F.lit("pc")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
    vr = px.resolve_range(want, src)
    lo, hi = px.code_range(bits, vr)
    return p.select(F.col("p_partkey").alias("k"), lo.alias("lo"), hi.alias("hi"), F.round(px.brightness_to_code(F.col("p_size") / 40.0, bits, vr), 6).alias("code"))


@query(f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, y, x, round(least(greatest((v * 4 - 64) / 876.0::DOUBLE, 0), 1), 9) AS guide,
  CAST(least(greatest(round_even(v * 4 * (1 - x / 8.0::DOUBLE) + 700.0::DOUBLE * (x / 8.0::DOUBLE), 0), 0), 1023) AS BIGINT) AS painted,
  round(least(greatest(v * 4 / 1023.0::DOUBLE * 255, 0), 255), 6) AS shown,
  round(CASE WHEN x = 0 THEN v / 255.0::DOUBLE ELSE least(greatest((v / 255.0::DOUBLE) / (x / 8.0::DOUBLE), 0), 1) END, 9) AS norm FROM pixels""")
def alpha_blend(spark, d) -> DataFrame:
    v, a = F.col("v") * 4, F.col("x") / 8.0
    return V.pixels(spark, d).select(
        "clip_id", "frame_idx", "y", "x",
        F.round(px.depth_guide(v, F.lit(64.0), F.lit(940.0)), 9).alias("guide"),
        px.blend(v, a, F.lit(700.0), F.lit(1023)).alias("painted"),
        F.round(px.depth_to_display(v, F.lit(1023)), 6).alias("shown"),
        F.round(px.normalised(F.col("v") / 255.0, a), 9).alias("norm"),
    )


@query(f"WITH {V.PIXELS} SELECT clip_id, frame_idx, round(sum(v) / (255.0 * count(*)), 9) AS coverage, max(v) AS peak, bool_or(v > 0) AS any_set FROM pixels GROUP BY 1, 2")
def coverage(spark, d) -> DataFrame:
    return measures.coverage(V.pixels(spark, d), ["clip_id", "frame_idx"]).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {V.PIXELS} SELECT clip_id, frame_idx, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in measures.PERCENTS) + " FROM pixels GROUP BY 1, 2")
def pixel_percentiles(spark, d) -> DataFrame:
    return measures.percentiles(V.pixels(spark, d), ["clip_id", "frame_idx"])


@query(f"""WITH {V.PIXELS}, bins AS (SELECT clip_id, frame_idx, v, count(*) AS n FROM pixels GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER a AS w, sum(n * v) OVER a AS s FROM bins
  WINDOW u AS (PARTITION BY clip_id, frame_idx ORDER BY v), a AS (PARTITION BY clip_id, frame_idx)),
b AS (SELECT *, CASE WHEN w - w0 > 0 THEN round(CAST(s0 * w - s * w0 AS DOUBLE) * CAST(s0 * w - s * w0 AS DOUBLE) / CAST(w0 * (w - w0) AS DOUBLE), 6) ELSE 0.0 END AS bv FROM c)
SELECT clip_id, frame_idx, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY bv DESC, v) AS rn FROM b) WHERE rn = 1""")
def otsu_threshold(spark, d) -> DataFrame:
    return measures.otsu(V.pixels(spark, d), ["clip_id", "frame_idx"]).select("clip_id", "frame_idx", "threshold")


@query(f"""WITH {V.PIXELS} SELECT clip_id, y, x, max(v) / 255.0::DOUBLE AS alpha,
  greatest(coalesce(max(CASE WHEN least(v / 255.0::DOUBLE / ((1 + frame_idx % 4) / 4.0::DOUBLE), 1) > 0.25 THEN (1 + frame_idx % 4) / 4.0::DOUBLE END), 0), 0) AS level FROM pixels GROUP BY 1, 2, 3""")
def compose_max(spark, d) -> DataFrame:
    p = V.pixels(spark, d).withColumns({"alpha": F.col("v") / 255.0, "level": (F.lit(1) + F.pmod("frame_idx", F.lit(4))) / 4.0})
    return measures.composed(p, ["clip_id", "y", "x"])


PRIOR_SQL = f"""{V.PIXELS}, peaks AS (SELECT *, max(v) OVER (PARTITION BY clip_id, frame_idx) AS peak FROM pixels),
trust AS (SELECT *, bool_or(peak >= 0.8 * 255 AND v > 127) OVER (PARTITION BY clip_id, y, x ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trusted FROM peaks)"""


@query(f"WITH {PRIOR_SQL} SELECT clip_id, frame_idx, y, x, trusted FROM trust")
def prior_or_window(spark, d) -> DataFrame:
    return measures.remembered_pixels(V.pixels(spark, d), 3, 0.8).select("clip_id", "frame_idx", "y", "x", "trusted")


@query(f"""WITH {PRIOR_SQL}, each AS (SELECT clip_id, frame_idx, y // 3 AS label, count(*) AS area, count(*) FILTER (trusted) AS inside FROM trust WHERE v > 127 GROUP BY 1, 2, 3)
SELECT clip_id, frame_idx, label, area, inside, inside / area::DOUBLE AS overlap,
  sum(inside) OVER (PARTITION BY clip_id, frame_idx) / (sum(area) OVER (PARTITION BY clip_id, frame_idx))::DOUBLE AS prior_overlap FROM each""")
def prior_overlap_weighted(spark, d) -> DataFrame:
    p = measures.remembered_pixels(V.pixels(spark, d), 3, 0.8).where("v > 127")
    p = p.withColumn("label", F.floor(F.col("y") / 3)).withColumn("allowed", F.col("trusted"))
    return measures.blob_support(p, ["clip_id", "frame_idx"])


@query(f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, y // 3 AS label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1,
  quantile_cont(v, 0.5) AS median FROM pixels WHERE v > 127 GROUP BY 1, 2, 3""")
def blob_stats(spark, d) -> DataFrame:
    p = V.pixels(spark, d).where("v > 127").withColumn("label", F.floor(F.col("y") / 3))
    return measures.blob_stats(p, ["clip_id", "frame_idx", "label"])


VERDICT_SQL = f"""{V.FRAMES}, h AS (SELECT *, dets >= 1 AND coverage >= 2e-05 AS hit FROM frames),
brk AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, window_id ORDER BY frame_idx) AS brk FROM h),
runs AS (SELECT *, sum(hit::INT) OVER (PARTITION BY clip_id, window_id, brk ORDER BY frame_idx) AS run FROM brk),
cum AS (SELECT *, sum(hit::INT) OVER w AS text_frames, max(run) OVER w AS longest_run FROM runs WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
flag AS (SELECT *, text_frames >= 6 AND longest_run >= 3 AS flagged FROM cum),
stop AS (SELECT *, min(CASE WHEN flagged THEN frame_idx END) OVER (PARTITION BY clip_id) AS stop FROM flag)"""


@query(f"WITH {VERDICT_SQL} SELECT clip_id, frame_idx, hit, CAST(run AS BIGINT) AS run, CAST(text_frames AS BIGINT) AS text_frames, CAST(longest_run AS BIGINT) AS longest_run, flagged FROM flag")
def verdict_runs(spark, d) -> DataFrame:
    return windows.observed(V.frames(spark, d)).select("clip_id", "frame_idx", "hit", "run", "text_frames", "longest_run", "flagged")


@query(f"""WITH {VERDICT_SQL} SELECT clip_id, count(*) AS frames_scanned, CAST(max(text_frames) AS BIGINT) AS text_frames, CAST(max(longest_run) AS BIGINT) AS longest_run,
  greatest(max(coverage), 0.0) AS peak_coverage, bool_or(flagged) AS flagged,
  array_to_string(list_sort(list(frame_idx) FILTER (hit))[1:8], ',') AS hits FROM stop WHERE stop IS NULL OR frame_idx <= stop GROUP BY 1""")
def verdict_early_exit(spark, d) -> DataFrame:
    return windows.verdicts(V.frames(spark, d)).withColumn("hits", F.array_join(F.transform("hits", lambda h: h.cast("string")), ","))


@query(f"""WITH {V.FRAMES} SELECT * FROM (SELECT clip_id, frame_idx, coverage, row_number() OVER (PARTITION BY clip_id ORDER BY coverage DESC, frame_idx) AS rank
  FROM frames WHERE dets >= 1) WHERE rank <= 3""")
def topk_evidence(spark, d) -> DataFrame:
    return windows.strongest(V.frames(spark, d)).select("clip_id", "frame_idx", "coverage", "rank")


def _clips(spark, d) -> DataFrame:
    return V.read(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("clip_id"), (F.col("s_suppkey") * 97 % 3000 - 50).alias("total_frames"))


CLIPS = "clips AS (SELECT s_suppkey AS clip_id, s_suppkey * 97 % 3000 - 50 AS total_frames FROM supplier)"
PLAN_SQL = """plan AS (
  SELECT clip_id, 0 AS start, CASE WHEN total_frames > 0 THEN total_frames END AS count FROM clips WHERE total_frames <= 45 * 8
  UNION SELECT clip_id, CAST(round_even(i * (total_frames - 45) / 7.0::DOUBLE, 0) AS BIGINT), 45 FROM clips, range(8) t(i) WHERE total_frames > 45 * 8)"""
SWEEP_SQL = """shape AS (SELECT *, greatest(1, least(8, CAST(floor(total_frames * 0.25::DOUBLE) AS BIGINT) // 6)) AS k FROM clips),
sweep AS (SELECT clip_id, 0 AS start, 48 AS count FROM shape WHERE total_frames <= 0
  UNION SELECT clip_id, 0, total_frames FROM shape WHERE total_frames > 0 AND (k = 1 OR total_frames <= 6 * k)
  UNION SELECT clip_id, CAST(round_even(i * (total_frames - 6) / (k - 1)::DOUBLE, 0) AS BIGINT), 6 FROM shape, range(8) t(i) WHERE total_frames > 0 AND k > 1 AND total_frames > 6 * k AND i < k)"""


@query(f"WITH {CLIPS}, {PLAN_SQL} SELECT clip_id, start::BIGINT AS start, coalesce(count, -1)::BIGINT AS count FROM plan")
def plan_windows(spark, d) -> DataFrame:
    return windows.window_plan(_clips(spark, d), 8, 45, 10).withColumn("count", F.coalesce("count", F.lit(-1)).cast("long"))


@query(f"WITH {CLIPS}, {SWEEP_SQL} SELECT clip_id, start::BIGINT AS start, count::BIGINT AS count FROM sweep")
def sweep_plan(spark, d) -> DataFrame:
    return windows.sweep_plan(_clips(spark, d))


@query(f"""WITH {CLIPS}, {PLAN_SQL}, {SWEEP_SQL},
a AS (SELECT clip_id, sum(count) + 10 * count(*) AS cheap, count(*) AS n FROM sweep GROUP BY 1),
b AS (SELECT clip_id, sum(coalesce(count, greatest(total_frames, 1))) + 10 * count(*) AS blind FROM plan JOIN clips USING (clip_id) GROUP BY 1)
SELECT clip_id, CAST(cheap AS BIGINT) AS cheap, CAST(blind AS BIGINT) AS blind, n >= 3 AND cheap < 0.8::DOUBLE * blind AS worth_it FROM a JOIN b USING (clip_id)""")
def sweep_worth(spark, d) -> DataFrame:
    return windows.sweep_is_worth_it(_clips(spark, d), Sweep(), 8, 45, 10)


@query(f"""WITH {V.FRAMES}, t AS (SELECT clip_id, max(frame_idx) + 1 AS total_frames FROM frames GROUP BY 1),
hits AS (SELECT DISTINCT clip_id, frame_idx FROM frames WHERE coverage > 0.00029),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS g FROM
  (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS gap FROM hits)),
s AS (SELECT clip_id, g, (min(frame_idx) + max(frame_idx)) // 2 AS c FROM g WHERE g <= 4 GROUP BY 1, 2)
SELECT DISTINCT clip_id, least(greatest(0, c - 3), greatest(0, total_frames - 7)) AS start, 7::BIGINT AS count FROM s JOIN t USING (clip_id)""")
def confirm_sessions(spark, d) -> DataFrame:
    frames = V.frames(spark, d)
    clips = frames.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("total_frames"))
    return windows.confirm_plan(frames.where("coverage > 0.00029"), clips, 7, 3)


@query(f"""WITH {V.WORDS}, l AS (SELECT *, lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS kept FROM words)
SELECT doc_id, pos, word FROM l WHERE length(kept) >= 3 AND confidence >= 0.45 AND len(list_distinct(string_split(kept, ''))) > 1""")
def legible_words(spark, d) -> DataFrame:
    return V.words(spark, d).where(strings.legible(F.col("word"), F.col("confidence"))).select("doc_id", "pos", "word")


KEYS_SQL = r"""f AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM clip_files),
k AS (SELECT *, lower(CASE WHEN is_dir THEN name ELSE regexp_replace(name, '\.[^.]+$', '') END) AS key, lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) AS ext FROM f)"""


def _depth_files(spark, d) -> tuple[DataFrame, DataFrame]:
    files = V.clip_files(spark, d)
    depth = files.select(F.regexp_replace(F.regexp_replace("path", "/clips/", "/depth/"), r"(_v\d)", "$1_depth").alias("path"), "is_dir")
    return files, depth


@query(f"""WITH {V.CLIP_FILES}, {KEYS_SQL}, dep AS (SELECT replace(regexp_replace(path, '(_v\\d)', '\\1_depth'), '/clips/', '/depth/') AS path, key || '_depth' AS key, is_dir, ext, lower(regexp_replace(name, '(_v\\d)', '\\1_depth')) AS name FROM k),
r AS (SELECT c.page_id, c.path, d.path AS depth_path, row_number() OVER (PARTITION BY c.page_id ORDER BY CASE WHEN d.is_dir = c.is_dir THEN 0 ELSE 1 END,
  CASE WHEN d.ext IN ('.mp4', '.mov', '.mkv', '.avi', '.webm', '.m4v') OR d.is_dir THEN 0 ELSE 1 END, d.name, d.path) AS rn, count(d.path) OVER (PARTITION BY c.page_id) AS n
  FROM k c LEFT JOIN dep d ON c.key || '_depth' = d.key)
SELECT page_id, path, depth_path, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM r WHERE rn = 1""")
def pair_depth_ranked(spark, d) -> DataFrame:
    files, depth = _depth_files(spark, d)
    return pairing.find_depth(files.select("page_id", "path", "is_dir"), depth).select("page_id", "path", "depth_path", "status")


@query(f"WITH {V.CLIP_FILES}, {KEYS_SQL} SELECT key, array_to_string(list_sort(list(path)), ';') AS paths, count(*) AS n FROM k GROUP BY 1")
def depth_index(spark, d) -> DataFrame:
    return pairing.depth_index(V.clip_files(spark, d)).withColumn("paths", F.array_join("paths", ";"))


@query(f"""WITH {V.CLIP_FILES}, n AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM clip_files WHERE lower(path) LIKE '%.png' OR lower(path) LIKE '%.tiff'),
m AS (SELECT *, CAST(regexp_extract(regexp_replace(name, '\\.[^.]+$', ''), '(\\d+)\\D*$', 1) AS BIGINT) AS number FROM n)
SELECT path, folder, number, row_number() OVER (PARTITION BY folder ORDER BY number, lower(name), path) - 1 AS frame_idx FROM m""")
def natural_frame_order(spark, d) -> DataFrame:
    return pairing.frame_order(V.clip_files(spark, d).select("path").distinct()).select("path", "folder", "number", "frame_idx")


SQL["natural_frame_order"] = SQL["natural_frame_order"].replace("FROM clip_files WHERE", "FROM (SELECT DISTINCT path FROM clip_files) WHERE")


@query(f"""WITH {V.CLIP_FILES} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS stills FROM clip_files WHERE lower(path) LIKE '%.png' OR lower(path) LIKE '%.tiff' GROUP BY 1""")
def is_sequence(spark, d) -> DataFrame:
    return pairing.is_sequence(V.clip_files(spark, d))


@query(f"""WITH {V.CLIP_FILES} SELECT path, replace(path, '/clips/', '/out/') AS dst FROM clip_files WHERE page_id % 4 > 0
UNION ALL SELECT '/other' || path, '/out/' || regexp_extract(path, '([^/]*)$', 1) FROM clip_files WHERE page_id % 4 = 0""")
def destinations(spark, d) -> DataFrame:
    files = V.clip_files(spark, d)
    path = F.when(F.pmod("page_id", F.lit(4)) > 0, F.col("path")).otherwise(F.concat(F.lit("/other"), F.col("path")))
    return files.select(path.alias("path")).withColumn("dst", strings.destination(F.col("path"), "/clips", "/out"))


@query(f"""WITH {V.CLIP_FILES}, there AS (SELECT path AS dst, max(size) AS size, is_dir FROM clip_files WHERE path LIKE '%_v0%' GROUP BY path, is_dir)
SELECT c.page_id, CASE WHEN t.dst IS NULL THEN 'copied' WHEN t.is_dir OR c.is_dir OR t.size = c.size THEN 'exists' ELSE 'exists (differs)' END AS action
FROM clip_files c LEFT JOIN there t ON c.path = t.dst""")
def copy_actions(spark, d) -> DataFrame:
    files = V.clip_files(spark, d)
    moves = files.select("page_id", F.col("path").alias("dst"), F.col("size").alias("src_size"), F.col("is_dir").alias("src_dir"))
    there = files.where(F.contains("path", F.lit("_v0"))).groupBy("path", "is_dir").agg(F.max("size").alias("size"))
    return pairing.copy_plan(moves, there).select("page_id", "action")


@query(f"""WITH {V.CLIP_FILES}, done AS (SELECT DISTINCT path FROM clip_files WHERE path LIKE '%_v0%') SELECT page_id, path FROM clip_files WHERE path NOT IN (SELECT path FROM done)""")
def anti_skip_existing(spark, d) -> DataFrame:
    files = V.clip_files(spark, d)
    return gates.not_done(files, files.where(F.contains("path", F.lit("_v0"))), "path").select("page_id", "path")


@query(f"""WITH {V.FRAMES}, a AS (SELECT clip_id, frame_idx - 2 AS frame_idx, coverage FROM frames WHERE frame_idx >= 2), b AS (SELECT clip_id, frame_idx - 5 AS frame_idx, dets FROM frames WHERE frame_idx >= 5)
SELECT clip_id, frame_idx, coverage, dets FROM a JOIN b USING (clip_id, frame_idx)""")
def zip_offsets(spark, d) -> DataFrame:
    f = V.frames(spark, d)
    return pairing.zipped(f.select("clip_id", "frame_idx", "coverage"), f.select("clip_id", "frame_idx", "dets"), 2, 5)


@query(f"WITH {V.FRAMES} SELECT clip_id, frame_idx, coverage FROM frames WHERE frame_idx >= 7 AND frame_idx < 27")
def stretch_of_frames(spark, d) -> DataFrame:
    return pairing.stretch(V.frames(spark, d), 3, 4, 20).select("clip_id", "frame_idx", "coverage")


@query(f"WITH {V.FRAMES} SELECT clip_id, frame_idx, coverage FROM frames WHERE frame_idx IN (0, 4, 8, 12, 40, 41)")
def sample_frames(spark, d) -> DataFrame:
    f = V.frames(spark, d)
    numbers = f.select("clip_id", F.explode(strings.frame_numbers(F.lit("40,41, 0-12:4"))).alias("frame_idx"))
    return pairing.sampled(f, numbers).select("clip_id", "frame_idx", "coverage")


ON_OFF_SQL = f"""{V.PIXELS}, rows_ AS (SELECT clip_id, frame_idx, y, count(*) FILTER (v > 127) AS n FROM pixels GROUP BY 1, 2, 3),
r AS (SELECT *, n - quantile_cont(n, 0.5) OVER (PARTITION BY clip_id, y) AS r FROM rows_),
s AS (SELECT clip_id, frame_idx, round(sum(r), 6) AS signal FROM r GROUP BY 1, 2),
m AS (SELECT *, min(signal) OVER c AS lo, max(signal) OVER c - min(signal) OVER c AS span FROM s WINDOW c AS (PARTITION BY clip_id)),
state AS (SELECT clip_id, frame_idx, signal, CASE WHEN span >= 1 AND (signal - lo) / span > 0.5 THEN 'on' WHEN span >= 1 AND (signal - lo) / span < 0.2 THEN 'off' ELSE 'neither' END AS state FROM m)"""


def _states(spark, d) -> DataFrame:
    rows = V.pixels(spark, d).groupBy("clip_id", "frame_idx", "y").agg(F.count_if(F.col("v") > 127).alias("n"))
    return measures.on_off(rows)


@query(f"WITH {ON_OFF_SQL} SELECT clip_id, frame_idx, signal, state FROM state")
def on_off_frames(spark, d) -> DataFrame:
    return _states(spark, d)


@query(f"""WITH {ON_OFF_SQL}, e AS (SELECT p.clip_id, y, x, round(avg(CASE WHEN state = 'on' THEN (v > 127)::INT::DOUBLE END), 6) AS on_mean, round(avg(CASE WHEN state = 'off' THEN (v > 127)::INT::DOUBLE END), 6) AS off_mean
  FROM pixels p JOIN state USING (clip_id, frame_idx) GROUP BY 1, 2, 3)
SELECT *, on_mean >= 0.5 AND (off_mean IS NULL OR on_mean - off_mean >= 0.05) AS candidate FROM e""")
def label_pixels(spark, d) -> DataFrame:
    lit = V.pixels(spark, d).join(_states(spark, d).select("clip_id", "frame_idx", "state"), ["clip_id", "frame_idx"])
    return measures.label_pixels(lit.withColumn("lit", (F.col("v") > 127).cast("int")), 0.5, 0.05)


SCORE_SQL = f"""{V.PIXELS}, p AS (SELECT clip_id, frame_idx, v > 127 AS pred, v > 120 AND x < 6 AS truth, v > 120 AND x BETWEEN 1 AND 4 AS core FROM pixels),
sc AS (SELECT clip_id, frame_idx, count(*) FILTER (pred AND truth) / greatest(count(*) FILTER (pred OR truth), 1)::DOUBLE AS iou,
  count(*) FILTER (pred AND core) / greatest(count(*) FILTER (core), 1)::DOUBLE AS recall, count(*) FILTER (pred AND truth) / greatest(count(*) FILTER (pred), 1)::DOUBLE AS precision FROM p GROUP BY 1, 2)"""


def _scores(spark, d) -> DataFrame:
    v, x = F.col("v"), F.col("x")
    p = V.pixels(spark, d).withColumns({"pred": v > 127, "truth": (v > 120) & (x < 6), "core": (v > 120) & x.between(1, 4)})
    return measures.mask_scores(p, ["clip_id", "frame_idx"])


@query(f"WITH {SCORE_SQL} SELECT clip_id, frame_idx, iou, recall, precision FROM sc")
def mask_score(spark, d) -> DataFrame:
    return _scores(spark, d)


@query(f"""WITH {SCORE_SQL} SELECT clip_id, round(quantile_cont(iou, 0.5), 6) AS iou, round(quantile_cont(recall, 0.5), 6) AS recall,
  round(quantile_cont(precision, 0.5), 6) AS precision, min(iou) AS worst, count(*) AS frames FROM sc GROUP BY 1""")
def score_summary(spark, d) -> DataFrame:
    return measures.score_summary(_scores(spark, d), ["clip_id"])


def _parts(spark, d) -> DataFrame:
    det = V.detections(spark, d)
    return det.select(
        "clip_id", "frame_idx", F.col("det_id").alias("label"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"),
        (F.col("x1") - F.col("x0")).alias("bw"), (F.col("y1") - F.col("y0")).alias("bh"), F.col("y0").cast("double").alias("cy"), F.col("score"),
    )


PARTS = f"{V.DETECTIONS}, parts AS (SELECT clip_id, frame_idx, det_id AS label, (x1 - x0) * (y1 - y0) AS area, x1 - x0 AS bw, y1 - y0 AS bh, y0::DOUBLE AS cy, score FROM detections)"


@query(f"WITH {PARTS} SELECT clip_id, frame_idx, label FROM parts WHERE area >= 300 AND bh BETWEEN 8 AND 36 AND bw <= 180")
def letter_components(spark, d) -> DataFrame:
    return gates.letters(_parts(spark, d), 300, 8, 36, 180).select("clip_id", "frame_idx", "label")


@query(f"""WITH {PARTS}, t AS (SELECT *, quantile_cont(bh, 0.5) OVER (PARTITION BY clip_id, frame_idx) AS tall, cy - lag(cy) OVER (PARTITION BY clip_id, frame_idx ORDER BY cy, label) AS step FROM parts),
g AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 2.0 * tall THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, frame_idx ORDER BY cy, label) AS band FROM t),
i AS (SELECT *, sum(area) OVER (PARTITION BY clip_id, frame_idx, band) AS ink FROM g),
b AS (SELECT *, first_value(band) OVER (PARTITION BY clip_id, frame_idx ORDER BY ink DESC, band) AS best FROM i)
SELECT clip_id, frame_idx, label, CAST(band AS BIGINT) AS band FROM b WHERE band = best""")
def text_band_groups(spark, d) -> DataFrame:
    return measures.text_band(_parts(spark, d), ["clip_id", "frame_idx"]).select("clip_id", "frame_idx", "label", "band")


@query(f"""WITH {PARTS}, j AS (SELECT *, area >= 0.5 * quantile_cont(area, 0.5) OVER w AS big FROM parts WINDOW w AS (PARTITION BY clip_id, frame_idx)),
m AS (SELECT *, CASE WHEN big THEN bh END AS vote, quantile_cont(CASE WHEN big THEN bh END, 0.5) OVER w AS mid, count(CASE WHEN big THEN bh END) OVER w AS votes FROM j WINDOW w AS (PARTITION BY clip_id, frame_idx)),
f AS (SELECT *, abs(vote - mid) AS far FROM m), b AS (SELECT *, greatest(2.0, 3 * quantile_cont(far, 0.5) OVER (PARTITION BY clip_id, frame_idx)) AS bar FROM f),
o AS (SELECT *, far <= bar AS ok, avg((far <= bar)::INT::DOUBLE) OVER (PARTITION BY clip_id, frame_idx) AS share FROM b)
SELECT clip_id, frame_idx, label FROM o WHERE votes < 3 OR share < 0.6 OR far IS NULL OR ok""")
def agreement_veto(spark, d) -> DataFrame:
    return gates.agreeing(_parts(spark, d), ["clip_id", "frame_idx"], "bh", 2.0, 0.6).select("clip_id", "frame_idx", "label")


def _tilt_sql(keys: str) -> str:
    """tilts (keys, tilt, best, flat) of the pixels above half: sheared by every angle, the fewest rows win."""
    return f"""ink AS (SELECT *, y // 4 AS det_id FROM pixels WHERE v > 127), angles AS (SELECT CAST(2 * k AS DOUBLE) AS angle, tan(radians(2 * k)) AS slope FROM range(-23, 24) t(k)),
mid AS (SELECT *, avg(x) OVER (PARTITION BY {keys}) AS m FROM ink),
band AS (SELECT {keys}, angle, round_even(y - (x - m) * slope, 0) AS band, sum(v) AS s FROM mid, angles GROUP BY ALL),
score AS (SELECT {keys}, angle, CAST(sum(s * s) AS BIGINT) AS score FROM band GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, abs(angle), angle DESC) AS rn, max(score) FILTER (angle = 0) OVER (PARTITION BY {keys}) AS flat FROM score),
tilts AS (SELECT {keys}, CASE WHEN score <= flat * 1.2::DOUBLE THEN 0.0::DOUBLE ELSE angle END AS tilt, score AS best, flat FROM won WHERE rn = 1)"""


@query(f"""WITH {V.PIXELS}, {_tilt_sql("clip_id, frame_idx, det_id")},
u AS (SELECT *, bool_or(abs(tilt) <= 8) OVER w AS level, bool_or(abs(tilt) > 8) OVER w AS sloped FROM tilts WINDOW w AS (PARTITION BY clip_id, frame_idx))
SELECT clip_id, frame_idx, det_id, tilt FROM u WHERE abs(tilt) <= 8 AND NOT (sloped AND NOT level)""")
def upright_rule(spark, d) -> DataFrame:
    """Halves of images as boxes, by the tilt of their own ink."""
    keys = ["clip_id", "frame_idx", "det_id"]
    ink = V.pixels(spark, d).where("v > 127").withColumn("det_id", F.floor(F.col("y") / 4))
    return gates.upright(measures.tilt_scores(ink, keys), keys[:2]).select(*keys, "tilt")


@query(f"WITH {PARTS} SELECT clip_id, frame_idx, sum(area * (label % 5) // 10) / greatest(sum(area), 1)::DOUBLE AS fill, sum(area * (label % 5) // 10) / greatest(sum(area), 1)::DOUBLE < 0.2 AS thin FROM parts GROUP BY 1, 2")
def thin_frames(spark, d) -> DataFrame:
    ink = _parts(spark, d).select("clip_id", "frame_idx", F.floor(F.col("area") * F.pmod("label", F.lit(5)) / 10).alias("ink"), F.col("area").alias("box_area"))
    return gates.thin_frames(ink, ["clip_id", "frame_idx"], 0.2)


@query("SELECT s_suppkey AS clip_id, round(greatest(0.012, 0.02, 14.0::DOUBLE / (120 + s_suppkey % 1000)), 9) AS min_text_height FROM supplier")
def size_floor(spark, d) -> DataFrame:
    clips = V.read(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("clip_id"), (120 + F.pmod("s_suppkey", F.lit(1000))).alias("height"))
    return gates.size_floor(clips, Filters()).select("clip_id", F.round("min_text_height", 9).alias("min_text_height"))


@query(f"WITH {V.FRAMES} SELECT clip_id, frame_idx // 6 AS cluster, count(*) FILTER (coverage > 0.0002) AS hits, count(*) AS seen FROM frames GROUP BY 1, 2 HAVING count(*) FILTER (coverage > 0.0002) >= 2")
def sweep_clusters(spark, d) -> DataFrame:
    f = V.frames(spark, d).withColumns({"cluster": F.floor(F.col("frame_idx") / 6), "hit": F.col("coverage") > 0.0002})
    return gates.hit_clusters(f, ["clip_id"])


@query(f"""WITH {V.COLOURS}, l AS (SELECT *, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255.0 AS lum FROM colours),
p AS (SELECT clip_id, frame_idx, quantile_cont(lum, 0.05) AS p5, quantile_cont(lum, 0.1) AS p10, quantile_cont(lum, 0.5) AS p50, quantile_cont(lum, 0.9) AS p90, quantile_cont(lum, 0.95) AS p95 FROM l GROUP BY 1, 2),
s AS (SELECT clip_id, frame_idx, count(*) AS lit, (stddev_pop(r / greatest(r + g + b, 1)::DOUBLE) + stddev_pop(g / greatest(r + g + b, 1)::DOUBLE)) / 2 AS spread FROM l JOIN p USING (clip_id, frame_idx)
  WHERE r + g + b >= 48 AND CASE WHEN p95 - p50 >= p50 - p5 THEN lum >= p90 - 1e-12 ELSE lum <= p10 + 1e-12 END GROUP BY 1, 2)
SELECT clip_id, frame_idx, round(greatest(p95 - p50, p50 - p5), 6) AS contrast, p95 - p50 >= p50 - p5 AS light, coalesce(lit, 0) AS lit, round(spread, 6) AS spread,
  greatest(p95 - p50, p50 - p5) >= 0.16 AND (coalesce(lit, 0) < 8 OR spread <= 0.14) AS keep FROM p LEFT JOIN s USING (clip_id, frame_idx)""")
def chroma_flatness(spark, d) -> DataFrame:
    out = gates.flat_and_contrasty(V.colours(spark, d), ["clip_id", "frame_idx"])
    return out.withColumns({"contrast": F.round("contrast", 6), "spread": F.round("spread", 6)})


@query(f"""WITH {V.PIXELS}, {_tilt_sql("clip_id, frame_idx")} SELECT clip_id, frame_idx, tilt, best, flat FROM tilts""")
def baseline_tilt(spark, d) -> DataFrame:
    ink = V.pixels(spark, d).where("v > 127")
    return measures.tilt_scores(ink, ["clip_id", "frame_idx"])


@query(f"""WITH {VERDICT_SQL}, v AS (SELECT clip_id, CASE WHEN bool_or(flagged) THEN 'text' ELSE 'clean' END AS verdict FROM stop GROUP BY 1) SELECT verdict, count(*) AS clips FROM v GROUP BY 1""")
def report_totals(spark, d) -> DataFrame:
    v = windows.verdicts(V.frames(spark, d))
    return measures.report_totals(v.select("clip_id", F.when(F.col("flagged"), "text").otherwise("clean").alias("verdict")))


@query("""WITH p AS (SELECT p_partkey AS k, 640 + p_partkey % 2 AS rw, 640 AS dw, p_partkey % 50 AS rf, p_size AS df, p_partkey % 3 = 0 AS ex, 24 + p_partkey % 2 AS rn, 8 + 2 * (p_partkey % 3) AS bits FROM part)
SELECT k, array_to_string(list_filter([CASE WHEN rw <> dw THEN 'resolution differs' END, CASE WHEN rf > 0 AND df > 0 AND rf <> df AND ex THEN 'frame count differs' END,
  CASE WHEN rf > 0 AND df > 0 AND rf <> df AND NOT ex THEN 'frame counts are estimated' END, CASE WHEN rn <> 24 THEN 'fps differs' END, CASE WHEN bits < 10 THEN 'depth map is ' || bits || '-bit' END], lambda x: x IS NOT NULL), '; ') AS notes FROM p""")
def alignment_notes(spark, d) -> DataFrame:
    p = V.read(spark, d, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    pairs = p.select(
        k.alias("k"), (640 + F.pmod(k, F.lit(2))).alias("rgb_width"), F.lit(640).alias("depth_width"), F.lit(360).alias("rgb_height"), F.lit(360).alias("depth_height"),
        F.pmod(k, F.lit(50)).alias("rgb_frames"), F.col("p_size").alias("depth_frames"), (F.pmod(k, F.lit(3)) == 0).alias("rgb_exact"), F.lit(True).alias("depth_exact"),
        (24 + F.pmod(k, F.lit(2))).alias("rgb_fps_num"), F.lit(1).alias("rgb_fps_den"), F.lit(24).alias("depth_fps_num"), F.lit(1).alias("depth_fps_den"), (8 + 2 * F.pmod(k, F.lit(3))).alias("depth_bits"),
    )
    return pairing.alignment_notes(pairs).select("k", F.array_join("notes", "; ").alias("notes"))


@query(f"""WITH {V.COLOURS}, p AS (SELECT *, CAST(round_even((r + g + b) / 3.0::DOUBLE, 0) AS BIGINT) AS plane, (r * 3 + x * 5) % 256 AS wanted FROM colours)
SELECT clip_id, frame_idx, y, x, CASE WHEN wanted - plane + r < 0 THEN 0 WHEN wanted - plane + r > 255 THEN 255 ELSE wanted - plane + r END AS r,
  CASE WHEN wanted - plane + g < 0 THEN 0 WHEN wanted - plane + g > 255 THEN 255 ELSE wanted - plane + g END AS g,
  CASE WHEN wanted - plane + b < 0 THEN 0 WHEN wanted - plane + b > 255 THEN 255 ELSE wanted - plane + b END AS b FROM p""")
def delta_write(spark, d) -> DataFrame:
    """A plane written back into stills of three channels by the stills' own writer, frame by frame."""
    import numpy as np
    import pandas as pd

    from ..sources import stills

    def run(pdf):
        image = np.zeros((8, 8, 3), np.uint8)
        ys, xs = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        image[ys, xs] = pdf[["r", "g", "b"]].to_numpy()
        plane = np.zeros((8, 8), np.uint16)
        plane[ys, xs] = (pdf["r"].to_numpy() * 3 + xs * 5) % 256
        out = stills.decode(stills.encode(stills.with_plane(image, plane)))[ys, xs].astype(np.int64)
        return pd.DataFrame({"clip_id": pdf["clip_id"], "frame_idx": pdf["frame_idx"], "y": ys, "x": xs, "r": out[:, 0], "g": out[:, 1], "b": out[:, 2]})

    return V.colours(spark, d).groupBy("clip_id", "frame_idx").applyInPandas(run, "clip_id long, frame_idx long, y long, x long, r long, g long, b long")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '420' WHEN 1 THEN '444' WHEN 2 THEN '400' ELSE '420' END AS chroma,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 10 END AS BIGINT) AS bits FROM part""")
def pixel_formats(spark, d) -> DataFrame:
    names = F.array(*map(F.lit, ["yuv420p10le", "yuvj444p", "gray16be", "nv12"]))
    fmt = F.element_at(names, (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    chroma, bits = strings.pixel_format(fmt)
    return V.read(spark, d, "part", "p_partkey").select("p_partkey", chroma.alias("chroma"), bits.alias("bits"))


@query("SELECT page_id, substr(sha256(length(html) || '|' || page_id || '|' || html), 1, 16) AS fingerprint FROM pages")
def source_fingerprint(spark, d) -> DataFrame:
    p = V.read(spark, d, "pages", "page_id", "html")
    return p.select("page_id", strings.fingerprint(F.length("html"), F.col("page_id"), F.col("html")).alias("fingerprint"))


@query(f"""WITH {V.DETECTIONS}, n AS (SELECT det_id, clip_id, frame_idx, x0 / 640.0::DOUBLE AS a, x1 / 640.0::DOUBLE AS c, y0 / 360.0::DOUBLE AS b, y1 / 360.0::DOUBLE AS d, score FROM detections)
SELECT clip_id, frame_idx, det_id, CAST(floor(round(a * 640, 6)) AS BIGINT) AS x0, CAST(floor(round(b * 360, 6)) AS BIGINT) AS y0, CAST(ceil(round(c * 640, 6)) AS BIGINT) AS x1, CAST(ceil(round(d * 360, 6)) AS BIGINT) AS y1 FROM n WHERE score >= 0.3 AND c > a AND d > b""")
def relative_boxes(spark, d) -> DataFrame:
    from ..sources import detectors

    det = V.detections(spark, d).select("clip_id", "frame_idx", "det_id", "score", *[(F.col(c) / float(n)).alias(c) for c, n in (("x0", 640), ("y0", 360), ("x1", 640), ("y1", 360))])
    return detectors.from_relative(det, 640, 360, 0.3).select("clip_id", "frame_idx", "det_id", "x0", "y0", "x1", "y1")


@query(f"""WITH {V.DETECTIONS} SELECT clip_id, frame_idx, det_id, x0, y0, x0 + (x1 - x0) // 2 - 20 AS x1, y1 FROM detections WHERE x0 + (x1 - x0) // 2 - 20 > x0 AND y1 > y0""")
def extents(spark, d) -> DataFrame:
    """Boxes given as xmin, xmax, ymin, ymax, of which some are turned inside out."""
    from ..sources import detectors

    middle = F.col("x0") + F.floor((F.col("x1") - F.col("x0")) / 2) - 20
    return detectors.from_extents(V.detections(spark, d).select("clip_id", "frame_idx", "det_id", F.array("x0", middle, "y0", "y1").alias("extent")))


def _planes(spark, d) -> DataFrame:
    """clip_id, frame_idx, values: images of 8 x 8 by clip, numbered without gaps."""
    e = V.pixels(spark, d).groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    return e.select(F.col("clip_id").cast("string").alias("clip_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.transform("p", lambda p: p["v"]).alias("values"))


def _bytes_of(values, kind: str):
    """Values of an image as bytes: one, two (little end first) or a float in 255ths each."""
    import numpy as np

    @F.pandas_udf("binary")
    def made(v):
        if kind == "float":
            return v.map(lambda a: (np.asarray(a, np.float32) / np.float32(255)).tobytes())
        return v.map(lambda a: np.asarray(a, kind).tobytes())

    return made(values)


def _unpacked(rows: DataFrame, column: str, width: int) -> DataFrame:
    """clip_id, frame_idx, y, x, v from images of 8 x 8 as bytes."""
    one = lambda i, k: F.conv(F.hex(F.substring(F.col(column), i * width + k + 1, F.lit(1))), 16, 10).cast("long")
    value = lambda i: one(i, 0) if width == 1 else one(i, 0) + 256 * one(i, 1)
    long = rows.select("clip_id", "frame_idx", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), value)).alias("i", "v"))
    return long.select("clip_id", "frame_idx", F.floor(F.col("i") / 8).alias("y"), F.pmod("i", F.lit(8)).cast("long").alias("x"), "v")


PLANES_SQL = f"""{V.PIXELS}, planes AS (SELECT CAST(clip_id AS VARCHAR) AS clip_id, dense_rank() OVER (PARTITION BY clip_id ORDER BY frame_idx) - 1 AS frame_idx, y, x, v FROM pixels)"""


@query(f"""WITH {PLANES_SQL}, often AS (SELECT clip_id, y, x, avg(CASE WHEN v > 127 THEN 1.0::DOUBLE ELSE 0 END) >= 0.4 AS truth FROM planes GROUP BY 1, 2, 3),
labelled AS (SELECT o.*, bool_and(n.truth) AS core FROM often o JOIN often n ON o.clip_id = n.clip_id AND abs(o.y - n.y) <= 1 AND abs(o.x - n.x) <= 1 GROUP BY ALL),
shown AS (SELECT clip_id, frame_idx FROM planes GROUP BY 1, 2 HAVING count(*) FILTER (v > 127) >= 16)
SELECT clip_id, frame_idx, count(*) FILTER (v > 127 AND truth) / greatest(count(*) FILTER (v > 127 OR truth), 1)::DOUBLE AS iou,
  count(*) FILTER (v > 127 AND core) / greatest(count(*) FILTER (core), 1)::DOUBLE AS recall, count(*) FILTER (v > 127 AND truth) / greatest(count(*) FILTER (v > 127), 1)::DOUBLE AS precision
FROM planes JOIN labelled USING (clip_id, y, x) JOIN shown USING (clip_id, frame_idx) WHERE clip_id IN (SELECT clip_id FROM often WHERE truth) GROUP BY 1, 2""")
def label_scores(spark, d) -> DataFrame:
    """Masks of frames against their clip's label: the pixels that are lit in four of ten frames."""
    from ..sources import labels

    planes, long = _planes(spark, d), F.posexplode("values").alias("i", "v")
    pixels = planes.select("clip_id", "frame_idx", long).withColumns({"y": F.floor(F.col("i") / 8), "x": F.pmod("i", F.lit(8)), "lit": F.col("v") > 127})
    glyphs = pixels.groupBy("clip_id", "y", "x").agg(F.avg(F.col("lit").cast("double")).alias("often")).where("often >= 0.4")
    shown = pixels.groupBy("clip_id", "frame_idx").agg(F.when(F.count_if("lit") >= 16, "on").otherwise("off").alias("state"))
    eight = [F.lit(8).alias("height"), F.lit(8).alias("width")]
    made = labels.gathered(glyphs, shown, planes.select("clip_id").distinct().select("clip_id", *eight))
    return labels.scored(planes.select("clip_id", "frame_idx", *eight, _bytes_of(F.col("values"), "u1").alias("mask")), made)


@query(f"""WITH {PLANES_SQL}, near AS (SELECT *, list_sort(list(v) OVER (PARTITION BY clip_id, y, x ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS n FROM planes),
smooth AS (SELECT *, (n[(len(n) - 1) // 2 + 1] + n[len(n) // 2 + 1]) // 2 AS s FROM near),
lit AS (SELECT DISTINCT a.clip_id, a.frame_idx, a.y, a.x FROM planes a JOIN planes b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE b.v >= 64)
SELECT clip_id, frame_idx, y, x, CAST(CASE WHEN l.y IS NULL THEN 0 ELSE s END AS BIGINT) AS v FROM smooth LEFT JOIN lit l USING (clip_id, frame_idx, y, x)""")
def mask_frames(spark, d) -> DataFrame:
    """Masks from patches: composed, their medians over three frames, their level spread by two pixels."""
    from ..config import build
    from ..operators import masks

    planes = _planes(spark, d)
    frames = planes.select("clip_id", "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"))
    zero, eight = F.lit(0), F.lit(8)
    found = planes.select(
        "clip_id", "frame_idx", F.lit(1).cast("long").alias("det_id"), zero.alias("x0"), zero.alias("y0"), eight.alias("h"), eight.alias("w"),
        F.lit(1.0).cast("float").alias("level"), _bytes_of(F.col("values"), "float").alias("alpha"),
    )
    return _unpacked(masks.masks(frames, found, build(**{"temporal.prior_window": 0}), 16), "mask", 1)


@query(f"""WITH {PLANES_SQL}, m AS (SELECT *, CASE WHEN v > 170 THEN 1.0::DOUBLE WHEN v > 120 THEN 0.2::DOUBLE ELSE 0 END AS a FROM planes)
SELECT clip_id, frame_idx, y, x, CAST(round(4 * v * (1 - a) + 869.92::DOUBLE * a) AS BIGINT) AS v FROM m""")
def repair_depth(spark, d) -> DataFrame:
    """Text painted into depth planes at one level, without healing, growing or feathering."""
    from ..config import build
    from ..operators import masks

    planes = _planes(spark, d)
    size = [F.lit(8).alias("height"), F.lit(8).alias("width")]
    depth = planes.select("clip_id", "frame_idx", *size, _bytes_of(F.transform("values", lambda v: 4 * v), "<u2").alias("data"))
    alpha = F.transform("values", lambda v: F.when(v > 170, 255).when(v > 120, 51).otherwise(0))
    mask = planes.select("clip_id", "frame_idx", *size, _bytes_of(alpha, "u1").alias("mask"))
    options = build(**{"composite.heal": "none", "composite.dilate": 0, "composite.feather": 0.0})
    return _unpacked(masks.repaired(depth, mask, options, 10, "tv"), "data", 2)


def _events(spark, d, last: bool = False) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("frame_idx"), (F.col("value") / 1e6).alias("coverage"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("dets"),
        F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")).alias("ts"),
    )


STREAM_SQL = VERDICT_SQL.replace("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx", "event_id AS frame_idx").replace("frame_idx // 45 AS window_id", "0 AS window_id")


@query(f"""WITH {STREAM_SQL} SELECT clip_id, count(*) AS frames_scanned, CAST(max(text_frames) AS BIGINT) AS text_frames, CAST(max(longest_run) AS BIGINT) AS longest_run,
  greatest(max(coverage), 0.0) AS peak_coverage, bool_or(flagged) AS flagged FROM stop WHERE stop IS NULL OR frame_idx <= stop GROUP BY 1""")
def stream_verdicts(spark, d) -> DataFrame:
    from ..streaming import verdicts as S

    rows = S.drained(spark, S.stream_verdicts(_events(spark, d).drop("ts")), "update")
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("clip_id", "late")]), "frames_scanned")
    return rows.groupBy("clip_id").agg(last.alias("v")).select("clip_id", "v.*")


#: Boxes for each core that a stream may hold in its state at once.
STREAM_BOXES = 2_000_000


@query(_persistence_sql(IOU_SQL, 3))
def stream_persistence(spark, d) -> DataFrame:
    """Boxes arrive as streams of files, one after another, each with some of the clips and a box without area at a later frame behind them."""
    from functools import reduce

    from .. import steps
    from ..streaming import persistence
    from ..streaming import verdicts as S

    det = V.detections(spark, d)
    parts = -(-max(1, det.count()) // (STREAM_BOXES * spark.sparkContext.defaultParallelism))
    part = F.pmod(F.xxhash64("clip_id"), F.lit(parts)).alias("part")
    sides = ["clip_id", "frame_idx", "det_id", "x0", "y0", "x1", "y1"]
    kept = gates.geometry(det, V.WIDTH, V.HEIGHT, FULL).select(*[F.col(c).cast("long").alias(c) for c in sides])
    ends = steps.cut(det.groupBy("clip_id").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last")), "ends")
    later = ends.agg(F.coalesce(F.max("last"), F.lit(0)) + 1000).first()[0]
    end = spark.range(parts).select(F.lit(-1).cast("long"), F.lit(later).cast("long"), *[F.lit(0).cast("long")] * 5, "id")
    folder = steps.fresh(spark, "boxes")
    kept.select("*", part).union(end).write.partitionBy("part").parquet(folder)
    found = []
    for k in range(parts):
        boxes = spark.readStream.schema(kept.schema).parquet(f"{folder}/part={k}")
        found.append(S.drained(spark, persistence.stream_persistence(boxes, ends.where(part == k)), "append"))
    return reduce(DataFrame.union, found)


@query("""WITH f AS (SELECT user_id AS clip_id, event_id AS frame_idx, value AS v FROM events)
SELECT clip_id, frame_idx, quantile_cont(v, 0.5) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM f""")
def stream_medians(spark, d) -> DataFrame:
    from ..streaming import verdicts as S

    ends = V.read(spark, d, "events", "user_id", "event_id").groupBy(F.col("user_id").alias("clip_id")).agg(F.max("event_id").alias("end"))
    frames = _events(spark, d).select("clip_id", "frame_idx", (F.col("coverage") * 1e6).alias("v")).join(ends, "clip_id")
    return S.drained(spark, S.stream_medians(frames.select("clip_id", "frame_idx", "v", (F.col("frame_idx") == F.col("end")).alias("last")), 2), "append").withColumn("v", F.round("v", 6))


SQL["stream_medians"] = SQL["stream_medians"].replace("quantile_cont(v, 0.5) OVER", "round(quantile_cont(v, 0.5) OVER").replace("2 FOLLOWING) AS v", "2 FOLLOWING), 6) AS v")


@query("""WITH h AS (SELECT user_id AS clip_id, ts FROM events WHERE value >= 100),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY clip_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM h),
s AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT clip_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS hits FROM s GROUP BY clip_id, k""")
def stream_hit_sessions(spark, d) -> DataFrame:
    from ..streaming import verdicts as S

    hits = _events(spark, d).where("coverage >= 0.0001").select("clip_id", "ts")
    rows = S.drained(spark, S.hit_sessions(hits, "6 hours"), "complete")
    return rows.select("clip_id", F.unix_micros("start").alias("start_us"), "hits")


@query("""SELECT user_id AS clip_id, CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start_us, count(*) AS hits, max(value) / 1e6 AS peak FROM events WHERE value >= 100 GROUP BY 1, 2""")
def stream_tumbling_hits(spark, d) -> DataFrame:
    from ..streaming import verdicts as S

    hits = _events(spark, d).where("coverage >= 0.0001").select("clip_id", "ts", "coverage")
    rows = S.drained(spark, S.tumbling_hits(hits, "1 day"), "complete")
    return rows.select("clip_id", F.unix_micros("start").alias("start_us"), "hits", "peak")


TRIAGE_SQL = f"""WITH {V.FRAMES}, {V.WORDS}, c AS (SELECT clip_id, max(frame_idx) + 1 AS n FROM frames GROUP BY 1),
sweep AS (SELECT clip_id, n, CASE WHEN k = 1 OR n <= 6 * k THEN 1 ELSE k END AS k, k = 1 OR n <= 6 * k AS whole FROM (SELECT clip_id, n, greatest(1, least(8, (n * 25 // 100) // 6)) AS k FROM c)),
sw AS (SELECT DISTINCT clip_id, CASE WHEN whole THEN 0 ELSE CAST(round_even(i * (n - 6) / (k - 1)::DOUBLE, 0) AS BIGINT) END AS a, CASE WHEN whole THEN n ELSE 6 END AS len FROM sweep, range(8) r(i) WHERE i < k),
bl AS (SELECT DISTINCT clip_id, CASE WHEN n <= 360 THEN 0 ELSE CAST(round_even(i * (n - 45) / 7.0::DOUBLE, 0) AS BIGINT) END AS a, CASE WHEN n <= 360 THEN n ELSE 45 END AS len FROM c, range(8) r(i)),
worth AS (SELECT clip_id FROM (SELECT clip_id, sum(len) + 10 * count(*) AS cheap, count(*) AS k FROM sw GROUP BY 1) JOIN (SELECT clip_id, sum(len) + 10 * count(*) AS blind FROM bl GROUP BY 1) USING (clip_id) WHERE k >= 3 AND cheap < 0.8::DOUBLE * blind),
swept AS (SELECT f.clip_id, f.frame_idx, sw.a, f.dets >= 1 AS hit FROM frames f JOIN sw ON sw.clip_id = f.clip_id AND f.frame_idx BETWEEN sw.a AND sw.a + len - 1 SEMI JOIN worth ON worth.clip_id = f.clip_id),
hits AS (SELECT clip_id, frame_idx FROM swept SEMI JOIN (SELECT clip_id, a FROM swept GROUP BY 1, 2 HAVING count(*) FILTER (hit) >= 2) USING (clip_id, a) WHERE hit),
looked AS (SELECT clip_id, count(*) AS swept_frames, (SELECT count(*) FROM hits h WHERE h.clip_id = s.clip_id) AS sweep_hits FROM swept s GROUP BY 1),
once AS (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS gap FROM (SELECT DISTINCT * FROM hits)),
grouped AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS g FROM once),
close AS (SELECT DISTINCT clip_id, least(greatest(0, (a + b) // 2 - 22), greatest(0, n - 45)) AS a, 45 AS len FROM (SELECT clip_id, g, min(frame_idx) AS a, max(frame_idx) AS b FROM grouped WHERE g <= 4 GROUP BY 1, 2) JOIN c USING (clip_id)),
plan AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY a) AS w FROM (SELECT * FROM close UNION ALL SELECT * FROM bl ANTI JOIN worth USING (clip_id))),
seen AS (SELECT f.clip_id, f.frame_idx, f.coverage, f.dets, w, f.dets >= 1 AND f.coverage >= 2e-5::DOUBLE AS hit FROM frames f JOIN plan p ON p.clip_id = f.clip_id AND f.frame_idx BETWEEN p.a AND p.a + p.len - 1),
broken AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, w ORDER BY frame_idx) AS island FROM seen),
run AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, w, island ORDER BY frame_idx) AS run FROM broken),
obs AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER o AS texts, max(run) OVER o AS longest, row_number() OVER o AS step FROM run WINDOW o AS (PARTITION BY clip_id ORDER BY w, frame_idx ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT clip_id, min(step) FILTER (texts >= 6 AND longest >= 3) AS last FROM obs GROUP BY 1),
kept AS (SELECT o.*, last IS NOT NULL AS flagged FROM obs o JOIN stop USING (clip_id) WHERE last IS NULL OR step <= last),
v AS (SELECT clip_id, count(*) AS frames_scanned, CAST(max(texts) AS BIGINT) AS text_frames, CAST(max(longest) AS BIGINT) AS longest_run, greatest(max(coverage), 0) AS peak_coverage, bool_or(flagged) AS flagged,
  array_to_string((list(frame_idx ORDER BY frame_idx) FILTER (hit))[1:8], ' ') AS hits FROM kept GROUP BY 1),
best AS (SELECT clip_id, frame_idx, row_number() OVER (PARTITION BY clip_id ORDER BY coverage DESC, frame_idx) AS rank FROM kept WHERE dets >= 1 QUALIFY rank <= 3),
said AS (SELECT doc_id % 150 AS clip_id, pos // 4 AS frame_idx, pos, word, confidence, lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS l FROM words),
r AS (SELECT *, confidence >= 0.45::DOUBLE AND length(l) >= 3 AND length(replace(l, l[1], '')) > 0 AS good FROM said JOIN best USING (clip_id, frame_idx)),
f AS (SELECT clip_id, min(rank) FILTER (good) AS rank FROM r GROUP BY 1),
t AS (SELECT r.clip_id, any_value(f.rank) IS NOT NULL AS legible, CASE WHEN any_value(f.rank) IS NULL THEN array_to_string((list(word ORDER BY r.rank, pos, word))[1:6], ' ') ELSE array_to_string(list(word ORDER BY pos, word) FILTER (good AND r.rank = f.rank), ' ') END AS words FROM r JOIN f USING (clip_id) GROUP BY 1)
SELECT clip_id, CASE WHEN NOT coalesce(flagged, false) THEN 'clean' WHEN coalesce(legible, false) THEN 'text' ELSE 'rejected' END AS verdict,
  CASE WHEN frames_scanned IS NULL THEN 'swept' WHEN flagged THEN 'read' ELSE 'confirmed' END AS stage, n AS total_frames, coalesce(swept_frames, 0) AS swept_frames, coalesce(sweep_hits, 0) AS sweep_hits,
  coalesce(frames_scanned, 0) AS frames_scanned, coalesce(text_frames, 0) AS text_frames, coalesce(longest_run, 0) AS longest_run, coalesce(peak_coverage, 0) AS peak_coverage,
  coalesce(hits, '') AS hits, CASE WHEN flagged THEN coalesce(words, '') ELSE '' END AS words
FROM c LEFT JOIN looked USING (clip_id) LEFT JOIN v USING (clip_id) LEFT JOIN t USING (clip_id)"""


@query(TRIAGE_SQL)
def triage_report(spark, d) -> DataFrame:
    """Verdicts of clips read in waves: sweep, windows one after another, strongest frames one after another."""
    from .. import steps
    from ..config import Config
    from ..operators import staged

    frames = V.frames(spark, d)
    words = V.words(spark, d).select(F.pmod("doc_id", F.lit(150)).alias("clip_id"), F.floor(F.col("pos") / 4).alias("frame_idx"), "pos", "word", "confidence")
    look = staged.from_table(frames.drop("window_id"))
    spoken = V.read(spark, d, "documents", "doc_id").select(F.pmod("doc_id", F.lit(150)).alias("clip_id")).distinct()

    def read(wanted: DataFrame) -> DataFrame:
        """Words of the wanted frames; these are cut down to clips that have words, so that mostly no word is shuffled."""
        asked = steps.cut(wanted.select("clip_id", "frame_idx").join(spoken, "clip_id", "left_semi"), "asked")
        return words.join(steps.few(asked), ["clip_id", "frame_idx"])

    out = staged.triage(frames.select("clip_id", "frame_idx"), staged.Eyes(look, look, read), Config(), radius=10)
    out = out.select("clip_id", "verdict", "stage", "total_frames", "swept_frames", "sweep_hits", "frames_scanned", "text_frames", "longest_run", "peak_coverage", "hits", "words")
    out = out.fillna(0, ["swept_frames", "sweep_hits", "frames_scanned", "text_frames", "longest_run", "peak_coverage"])
    return out.withColumns({c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))) for c in ("hits", "words")})


@query(f"""WITH {PARTS} SELECT clip_id, frame_idx, label FROM parts WHERE area >= 60 AND score >= 0.2 AND bh / 8.0::DOUBLE >= 0.8
  AND (label % 5 = 0 OR (area <= 0.35::DOUBLE * 200 * 60 AND NOT (bw >= 199 AND bh >= 59) AND bh / 8.0::DOUBLE <= greatest(3.0, 0.1::DOUBLE * bh)))""")
def stroke_components(spark, d) -> DataFrame:
    from ..config import Strokes

    parts = _parts(spark, d).withColumns(
        {"crop_w": F.lit(200), "crop_h": F.lit(60), "strength": F.col("score"), "stroke": F.col("bh") / 8.0, "text_height": F.col("bh"), "segmented": F.pmod("label", F.lit(5)) == 0}
    )
    options = Strokes(min_cc_area=60, min_relative_strength=0.2, max_stroke=3.0, max_stroke_frac=0.1)
    return gates.stroke_components(parts, options).select("clip_id", "frame_idx", "label")


@query(f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, y, x, round(least(greatest(greatest(v / 255.0::DOUBLE - (40 + x * 10) / 255.0::DOUBLE, 0) / greatest(abs(1.0 - (40 + x * 10) / 255.0::DOUBLE), 0.05), 0), 1), 9) AS alpha FROM pixels""")
def residual_opacity(spark, d) -> DataFrame:
    behind = (F.lit(40) + F.col("x") * 10) / 255.0
    signal = F.greatest(F.col("v") / 255.0 - behind, F.lit(0.0))
    return V.pixels(spark, d).select("clip_id", "frame_idx", "y", "x", F.round(px.residual_opacity(signal, behind, True, 0.05), 9).alias("alpha"))


@query(f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, round(least(greatest(quantile_cont(v * 4, 0.9) + 0.08::DOUBLE * 876, 64), 940), 6) AS code
  FROM pixels WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY 1, 2""")
def relative_code(spark, d) -> DataFrame:
    ring = V.pixels(spark, d).where(F.col("y").isin(0, 7) | F.col("x").isin(0, 7))
    return measures.relative_code(ring.withColumn("v", F.col("v") * 4), ["clip_id", "frame_idx"], 0.08, 64.0, 940.0)


@query(f"WITH {V.COLOURS} SELECT clip_id, frame_idx, y, x, CAST(round_even((r + g + b) / 3.0::DOUBLE, 0) AS BIGINT) AS plane FROM colours")
def plane_of_channels(spark, d) -> DataFrame:
    return V.colours(spark, d).select("clip_id", "frame_idx", "y", "x", F.rint((F.col("r") + F.col("g") + F.col("b")) / 3.0).cast("long").alias("plane"))


@query(f"""WITH {V.PIXELS}, strong AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY clip_id, frame_idx, y) AS mid FROM pixels),
m AS (SELECT clip_id, frame_idx, y, quantile_cont(v, 0.5) AS median FROM strong WHERE v >= mid GROUP BY 1, 2, 3)
SELECT clip_id, frame_idx, round(quantile_cont(median, 0.9) - quantile_cont(median, 0.1), 6) AS spread FROM m GROUP BY 1, 2""")
def colour_spread(spark, d) -> DataFrame:
    return measures.colour_spread(V.pixels(spark, d).withColumn("label", F.col("y")), ["clip_id", "frame_idx"])


@query(f"""WITH {V.FRAMES} SELECT a.clip_id, a.frame_idx, a.coverage, b.dets, c.window_id FROM frames a JOIN (SELECT * FROM frames WHERE dets >= 1) b USING (clip_id, frame_idx)
  JOIN (SELECT * FROM frames WHERE coverage > 0.0001) c USING (clip_id, frame_idx)""")
def preview_join(spark, d) -> DataFrame:
    f = V.frames(spark, d)
    rgb, depth = f.select("clip_id", "frame_idx", "coverage"), f.where("dets >= 1").select("clip_id", "frame_idx", "dets")
    mask = f.where("coverage > 0.0001").select("clip_id", "frame_idx", "window_id")
    return pairing.zipped(pairing.zipped(rgb, depth), mask)


@query(f"""WITH {V.PIXELS}, verdict AS (SELECT clip_id, frame_idx, y // 3 AS label, CASE WHEN count(*) FILTER (v > 127) >= 10 THEN 255 ELSE 0 END AS keep FROM pixels GROUP BY 1, 2, 3)
SELECT clip_id, frame_idx, y, x, CAST(v & keep AS BIGINT) AS v FROM pixels p JOIN verdict k USING (clip_id, frame_idx) WHERE p.y // 3 = k.label""")
def verdict_lookup(spark, d) -> DataFrame:
    p = V.pixels(spark, d).withColumn("label", F.floor(F.col("y") / 3))
    return measures.held_to_verdicts(p, ["clip_id", "frame_idx"], 10).select("clip_id", "frame_idx", "y", "x", "v")


@query(f"""WITH {V.PIXELS}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY y, x) - 1 AS rn, count(*) OVER (PARTITION BY clip_id, frame_idx) AS n FROM pixels WHERE v > 100)
SELECT clip_id, frame_idx, y, x FROM n WHERE n <= 20 OR rn % (n // 20 + 1) = 0""")
def ink_stride(spark, d) -> DataFrame:
    return measures.thinned(V.pixels(spark, d).where("v > 100"), ["clip_id", "frame_idx"], ["y", "x"], 20).select("clip_id", "frame_idx", "y", "x")


@query(f"WITH {V.FRAMES} SELECT DISTINCT clip_id, frame_idx FROM frames WHERE dets >= 1 EXCEPT SELECT clip_id, frame_idx FROM frames WHERE coverage > 0.0001")
def on_off_difference(spark, d) -> DataFrame:
    f = V.frames(spark, d)
    return f.where("dets >= 1").select("clip_id", "frame_idx").subtract(f.where("coverage > 0.0001").select("clip_id", "frame_idx"))


@query(f"""WITH {V.PIXELS}, b AS (SELECT clip_id, frame_idx, y // 4 AS label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pixels WHERE v > 170 GROUP BY 1, 2, 3)
SELECT DISTINCT p.clip_id, p.frame_idx, p.y, p.x FROM pixels p JOIN b ON p.clip_id = b.clip_id AND p.frame_idx = b.frame_idx AND p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1""")
def region_mask(spark, d) -> DataFrame:
    p = V.pixels(spark, d)
    blobs = measures.blob_stats(p.where("v > 170").withColumn("label", F.floor(F.col("y") / 4)), ["clip_id", "frame_idx", "label"])
    return measures.region_pixels(p, blobs, ["clip_id", "frame_idx"]).select("clip_id", "frame_idx", "y", "x")


@query(f"""WITH {V.PIXELS}, tile AS (SELECT * FROM pixels), bad AS (SELECT * FROM tile WHERE v > 170), good AS (SELECT * FROM tile WHERE v <= 170),
n AS (SELECT b.clip_id, b.frame_idx, b.y, b.x, min((b.y - g.y) * (b.y - g.y) + (b.x - g.x) * (b.x - g.x)) AS gap FROM bad b JOIN good g USING (clip_id, frame_idx) GROUP BY 1, 2, 3, 4)
SELECT * FROM n""")
def nearest_valid(spark, d) -> DataFrame:
    """Squared distance of every masked pixel to its nearest valid one, by a pass along the rows and one across."""
    from ..operators import planes

    p = V.pixels(spark, d)
    found = planes.nearest_valid(p.withColumn("v", F.when(F.col("v") <= 170, F.col("v"))), 8)
    bad = p.where("v > 170").select("clip_id", "frame_idx", "y", "x")
    return found.where("gap is not null").join(bad, ["clip_id", "frame_idx", "y", "x"]).select("clip_id", "frame_idx", "y", "x", "gap")


@query(f"""WITH {PLANES_SQL}, sure AS (SELECT clip_id, frame_idx FROM planes GROUP BY 1, 2 HAVING max(v) >= 200),
lit AS (SELECT p.* FROM planes p SEMI JOIN sure USING (clip_id, frame_idx) WHERE v > 127),
shown AS (SELECT DISTINCT clip_id, frame_idx FROM planes WHERE v > 127)
SELECT DISTINCT s.clip_id, s.frame_idx, p.y, p.x FROM shown s JOIN lit l ON s.clip_id = l.clip_id AND abs(s.frame_idx - l.frame_idx) <= 3
JOIN planes p ON p.clip_id = s.clip_id AND p.frame_idx = s.frame_idx AND ((p.y = l.y AND abs(p.x - l.x) <= 1) OR (p.x = l.x AND abs(p.y - l.y) <= 1))""")
def bit_memory(spark, d) -> DataFrame:
    """What the confident frames around a frame show, grown by a cross: words of bits, in the JVM throughout."""
    from ..kernels.arrays import ellipse
    from ..operators import planes

    long = _planes(spark, d).select("clip_id", "frame_idx", F.posexplode("values").alias("i", "v"))
    pixels = long.withColumns({"y": F.floor(F.col("i") / 8), "x": F.pmod("i", F.lit(8)).cast("long")})
    plane = planes.packed_pixels(pixels, F.col("v") > 127)
    sure = pixels.groupBy("clip_id", "frame_idx").agg(F.max("v").alias("m")).where("m >= 200")
    memory = planes.dilated(planes.around(plane.join(sure, planes.FRAME, "left_semi"), 3, plane), ellipse(3))
    return planes.pixels_of(memory).where("y < 8 and x < 8")


@query(f"""WITH RECURSIVE {V.PIXELS}, lit AS MATERIALIZED (SELECT clip_id, frame_idx, y, x, y * 8 + x AS i FROM pixels WHERE v > 150),
touch AS MATERIALIZED (SELECT a.frame_idx, a.clip_id, a.i AS a, b.i AS b FROM lit a JOIN lit b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT clip_id, frame_idx, a, b FROM touch UNION SELECT r.clip_id, r.frame_idx, r.a, t.b FROM reach r JOIN touch t ON r.clip_id = t.clip_id AND r.frame_idx = t.frame_idx AND r.b = t.a),
named AS (SELECT clip_id, frame_idx, a, min(b) AS root FROM reach GROUP BY 1, 2, 3)
SELECT l.clip_id, l.frame_idx, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1
FROM named n JOIN lit l ON l.clip_id = n.clip_id AND l.frame_idx = n.frame_idx AND l.i = n.a GROUP BY l.clip_id, l.frame_idx, root""")
def pixel_components(spark, d) -> DataFrame:
    """Area and box of every connected part of the bright pixels, from runs that touch."""
    from ..operators import planes

    found = planes.components(planes.packed_pixels(V.pixels(spark, d), F.col("v") > 150))
    return planes.blobs(found).drop("label")


@query(f"""WITH {V.CLIP_FILES}, {KEYS_SQL} SELECT page_id, '/out/' || (page_id % 7) || '/' || key || '_depth.mkv' AS dst FROM k""")
def depth_destinations(spark, d) -> DataFrame:
    f = V.clip_files(spark, d)
    depth = F.concat(F.lit("/depth/elsewhere/"), pairing.clip_key(F.col("path"), F.col("is_dir")), F.lit("_depth.mkv"))
    return f.select("page_id", strings.depth_destination(depth, F.col("path"), "/clips", "/out").alias("dst"))


@query(f"""WITH {V.WORDS}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM words)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS words FROM w WHERE rn <= 6 GROUP BY 1""")
def first_words(spark, d) -> DataFrame:
    return scan.first_words(V.words(spark, d), ["doc_id"], 6).select("doc_id", F.array_join("words", " ").alias("words"))


def _films(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rgb, depth, detections) of 96 x 56: every image of the table is a frame's scene, and the bright ones carry a line of bars, in front of it."""
    import numpy as np
    import pandas as pd

    from ..sources.frames import FRAME

    shown = _planes(spark, d).withColumn("lit", F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v) >= 64 * 120)
    names = [x.split()[0] for x in FRAME.split(", ")]

    def draw(depth: bool):
        def run(batches):
            for batch in batches:
                out = []
                for clip, i, values, lit in zip(batch["clip_id"], batch["frame_idx"], batch["values"], batch["lit"]):
                    scene = np.kron(np.asarray(values).reshape(8, 8) // 2, np.ones((7, 12), int))
                    bars = np.zeros(scene.shape, bool)
                    for x in range(24, 72, 9):
                        bars[36:47, x : x + 3] = lit
                    plane = np.where(bars, 900, 300 + scene).astype(np.uint16) if depth else np.repeat(np.where(bars, 250, scene).astype(np.uint8)[..., None], 3, axis=2)
                    out.append((clip, i, f"f{i:05d}.png", 56, 96, 1 if depth else 3, 16 if depth else 8, plane.tobytes()))
                yield pd.DataFrame(out, columns=names)

        return shown.mapInPandas(run, FRAME)

    box = {"det_id": 1, "x0": 22, "y0": 34, "x1": 74, "y1": 49}
    dets = shown.where("lit").select("clip_id", "frame_idx", *[F.lit(v).cast("long").alias(k) for k, v in box.items()], F.lit(0.9).alias("score"))
    return draw(False), draw(True), dets


@query(None)
def masks_for_frames(spark, d) -> DataFrame:
    """Masks of the frames that show text, from no more than their context: scenes of the embeddings, with their depth."""
    from ..config import build
    from ..operators import masks

    rgb, depth, dets = _films(spark, d)
    config = build("both", **{"filters.min_text_height": 0.05})
    m = masks.masks_for(rgb, dets, dets.select("clip_id", "frame_idx"), config, depth=depth, codes=(0.0, 1023.0))
    return m.select("clip_id", "frame_idx", "height", "width", F.sha2("mask", 256).alias("mask_sha"))


@query(f"""WITH {V.CLIP_FILES}, {KEYS_SQL}, e AS (SELECT *, regexp_extract(name, '[^.](\\.[^.]+)$', 1) AS own FROM k)
SELECT page_id, CASE WHEN is_dir THEN path || '_fixed' ELSE regexp_replace(path, '[^/]*$', '') || regexp_replace(name, '\\.[^.]+$', '') || '_fixed' || CASE WHEN own = '' THEN '.mp4' ELSE own END END AS dst,
  CASE WHEN NOT is_dir AND ext IN ('.png', '.tif', '.tiff', '.ppm', '.pgm') THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS clip FROM e""")
def suggested_outputs(spark, d) -> DataFrame:
    f = pairing.collapsed(V.clip_files(spark, d))
    return f.select("page_id", strings.suggested_output(F.col("path"), F.col("is_dir")).alias("dst"), "clip")


@query(f"""WITH {V.PIXELS} SELECT clip_id, frame_idx, avg(CASE WHEN v >= 6 THEN 1.0::DOUBLE ELSE 0 END) AS covered, max(v) / 255.0::DOUBLE AS peak, 64 + 0.92::DOUBLE * 876 AS painted FROM pixels GROUP BY 1, 2""")
def preview_numbers(spark, d) -> DataFrame:
    return measures.preview_numbers(V.pixels(spark, d), ["clip_id", "frame_idx"], 64.0, 940.0, 0.92)
