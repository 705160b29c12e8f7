"""Clips copied or moved, file by file in the tasks. Nothing is overwritten, and a run that ended can be run again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import steps
from ..sources import files

DONE = "src string, dst string, action string"


def files_of(clips: DataFrame, found: DataFrame) -> DataFrame:
    """Files (src, dst, size) of clips (src, dst), each a file or a folder of stills, from a listing (path, size)."""
    single = clips.join(found.select(F.col("path").alias("src"), "size"), "src")
    inside = found.select("path", "size", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("src"), F.regexp_extract("path", r"/([^/]*)$", 1).alias("_name"))
    folder = clips.join(inside, "src").select(F.col("path").alias("src"), F.concat("dst", F.lit("/"), "_name").alias("dst"), "size")
    return single.select("src", "dst", "size").unionByName(folder)


def carried_out(moves: DataFrame, move: bool = False, chunk: int = 8 << 20) -> DataFrame:
    """(src, dst, action) of files (src, dst, size): copied, moved, exists, exists (differs), or error and what went wrong.

    A file is written beside its place and put there when it is whole, so one
    that exists is either a whole copy or somebody else's; that tells what an
    earlier run has done. A source goes only when its copy has its size. What is to be done is
    written down first, since listings change while files move.
    """
    moves = steps.cut(moves.select("src", "dst", "size"), "moves")

    def one(src: str, dst: str, size: int) -> str:
        (store, a), (target, b) = files.located(src), files.located(dst)
        there = target.get_file_info(b)
        if there.type.name != "NotFound":
            return "exists" if there.type.name == "Directory" or there.size == size else "exists (differs)"
        target.create_dir(b.rsplit("/", 1)[0], recursive=True)
        part = f"{b}.part"
        with store.open_input_stream(a) as f, target.open_output_stream(part) as g:
            while data := f.read(chunk):
                g.write(data)
        if target.get_file_info(part).size != size:
            raise OSError(f"{src} changed while it was copied")
        target.move(part, b)
        if move:
            store.delete_file(a)
        return "moved" if move else "copied"

    def run(batches):
        for batch in batches:
            out = []
            for src, dst, size in zip(batch["src"], batch["dst"], batch["size"]):
                try:
                    out.append((src, dst, one(src, dst, int(size))))
                except OSError as e:
                    out.append((src, dst, f"error: {e}"))
            yield pd.DataFrame(out, columns=["src", "dst", "action"])

    spark = moves.sparkSession
    dealt = moves.select("src", "dst", "size").repartition(spark.sparkContext.defaultParallelism * 4, "src")
    return dealt.mapInPandas(run, DONE)


def clip_actions(done: DataFrame, clips: DataFrame) -> DataFrame:
    """(src, dst, action) of clips (src, dst) from their files' actions: an error if any is one, else what happened to any, else exists."""
    kind = F.when(F.startswith("action", F.lit("error")), F.struct(F.lit(0).alias("k"), "action"))
    kind = kind.when(F.col("action") == "exists (differs)", F.struct(F.lit(1).alias("k"), "action")).when(F.col("action") != "exists", F.struct(F.lit(2).alias("k"), "action"))
    kind = kind.otherwise(F.struct(F.lit(3).alias("k"), "action"))
    folder = F.regexp_extract("src", r"^(.*)/[^/]*$", 1)
    each = done.select(F.explode(F.array("src", folder)).alias("src"), kind.alias("kind"))
    return clips.join(each, "src").groupBy("src", "dst").agg(F.min("kind")["action"].alias("action"))
