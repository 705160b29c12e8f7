"""Command line: ``python -m filmloom.cli probe|detect|masks|preview|fix|scan|triage|query ...`` over tables in a folder.

Exit codes: 0 done, 1 failed, 2 wrong use, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as C


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="filmloom", description=__doc__)
    p.add_argument("--profile", choices=sorted(C.PROFILES))
    p.add_argument("--set", action="append", default=[], metavar="SECTION.OPTION=VALUE", help="any option, over the profile")
    sub = p.add_subparsers(dest="command", required=True)
    probe = sub.add_parser("probe", help="clips of a folder and their fingerprints")
    probe.add_argument("root")
    probe.add_argument("--out", help="a table in place of the listing")
    for name, text in (
        ("detect", "the boxes that pass the gates, as a table"),
        ("masks", "masks from folders of stills and a table of boxes"),
        ("preview", "masks of a few frames of every clip, as in a full run"),
    ):
        masks = sub.add_parser(name, help=text)
        masks.add_argument("stills")
        masks.add_argument("boxes")
        masks.add_argument("out")
        masks.add_argument("--depth", help="folders of depth stills that veto glyphs off the text's depth")
        masks.add_argument("--bits", type=int, default=10)
        masks.add_argument("--range", choices=("tv", "pc"), default="pc")
        if name == "preview":
            masks.add_argument("--frames", required=True, help="such as 12,40 or 0-120:20")
    fix = sub.add_parser("fix", help="repaired depth from depth stills and a mask cache")
    fix.add_argument("depth")
    fix.add_argument("masks")
    fix.add_argument("out")
    fix.add_argument("--bits", type=int, default=10)
    fix.add_argument("--range", choices=("tv", "pc"), default="pc")
    triage = sub.add_parser("triage", help="report of clips from a table of frames")
    triage.add_argument("frames")
    triage.add_argument("out", help="a folder; clips that its report has already are left out")
    triage.add_argument("--boxes", help="a table of boxes with their tilt, from which those that count are counted anew")
    seen = sub.add_parser("scan", help="report of folders of stills, of which no more frames are read than needed")
    seen.add_argument("stills")
    seen.add_argument("out", help="a folder for the report; clips that it has already are left out")
    seen.add_argument("--boxes", help="a table of boxes; without it the batch detectors of detect.detectors look for them")
    seen.add_argument("--plugins", action="append", default=[], metavar="MODULE", help="a module, or a file of one, that registers batch detectors or word readers")
    seen.add_argument("--reader", help="a registered word reader")
    seen.add_argument("--depth", help="a tree in which the clips' depth maps are looked for")
    seen.add_argument("--dest", help="where clips with text are copied to, with their depth maps; those that are there already are left out")
    seen.add_argument("--move", action="store_true")
    seen.add_argument("--dry-run", action="store_true", help="say what would be copied")
    for p_ in (triage, seen):
        p_.add_argument("--words", help="a table of words (clip_id, frame_idx, pos, word, confidence)")
        p_.add_argument("--no-sweep", action="store_true", help="read every clip's windows without a sweep before")
    triage.add_argument("--pairs", help="a table of depth maps (clip_id, depth_path, depth_status)")
    triage.add_argument("--copies", help="a table of copies (clip_id, rgb_action, rgb_dest, depth_action)")
    query = sub.add_parser("query", help="one of the named queries over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("out")
    return p


def options(args) -> C.Config:
    chosen = {}
    for item in args.set:
        name, eq, value = item.partition("=")
        if not eq or name not in C.option_names():
            raise SystemExit(2)
        chosen[name] = C.coerce(name, value)
    return C.build(args.profile, **chosen)


def work(spark: SparkSession, args, config: C.Config) -> None:
    from .kernels.repair import code_range
    from .operators import gates, masks, scan
    from .sources import catalog, frames

    if args.command == "probe":
        files = catalog.listing(spark, args.root)
        found = catalog.clips(files, args.root)
        marks = catalog.fingerprints(spark, args.root)
        if args.out:
            found.join(marks, "path", "left").write.parquet(args.out)
        else:
            found.show(found.count(), truncate=False)
            marks.show(marks.count(), truncate=False)
    elif args.command in ("detect", "masks", "preview"):
        listing, dets = frames.listed(spark, args.stills), spark.read.parquet(args.boxes)
        rgb, sizes = frames.read_stills(spark, args.stills), frames.still_sizes(listing)
        more = {"sizes": sizes}
        if args.depth:
            more |= {"depth": frames.read_depth(spark, args.depth), "codes": code_range(args.bits, args.range)}
        if args.command == "detect":
            kept = masks.boxes(sizes, dets, config)
            good = gates.overlaid(masks.looks(rgb, kept), config.filters)
            kept.join(good, ["clip_id", "frame_idx", "det_id"]).write.parquet(args.out)
        elif args.command == "preview":
            numbers = F.explode(F.array(*[F.lit(n).cast("long") for n in C.parse_frames(args.frames)])).alias("frame_idx")
            wanted = rgb.select("clip_id").distinct().select("clip_id", numbers)
            masks.masks_for(rgb, dets, wanted, config, **more).write.parquet(args.out)
        else:
            frames.write_cache(masks.run(rgb, dets, config, **more), args.out, {"source": args.stills, "version": 1})
    elif args.command == "fix":
        depth = frames.read_depth(spark, args.depth)
        fixed = masks.repaired(depth, frames.read_cache(spark, args.masks), config, args.bits, args.range)
        frames.write_depth(fixed, args.out)
    elif args.command == "triage":
        seen = scan.not_reported(spark, spark.read.parquet(args.frames), args.out)
        if args.boxes:
            seen = scan.looked_at(seen, spark.read.parquet(args.boxes), config.filters, config.level, config.size)
        words, pairs, copied = (spark.read.parquet(t) if t else None for t in (args.words, args.pairs, args.copies))
        sweep = None if args.no_sweep else config.sweep
        scan.write_report(scan.triage(seen, words, pairs, copied, sweep, config.thresholds, config.reading, config.scan, config.halo), args.out)
    elif args.command == "scan":
        scanned(spark, args, config)
    else:
        from .plans.queries import QUERIES

        QUERIES[args.name](spark, args.folder).write.parquet(args.out)


def scanned(spark: SparkSession, args, config: C.Config) -> None:
    """Triage in waves, then copies of what has text, then the report."""
    import importlib

    from . import steps
    from .operators import copies, pairing, scan, staged
    from .sources import catalog, files, frames

    for module in args.plugins:
        if module.endswith(".py"):  # a file goes to the workers as well
            spark.sparkContext.addPyFile(module)
            module = module.rsplit("/", 1)[-1][:-3]
        importlib.import_module(module)
    listing = scan.not_reported(spark, frames.listed(spark, args.stills), args.out)
    root, dest = files.qualified(spark, args.stills), None if args.dest is None else files.qualified(spark, args.dest)
    if dest is not None and not args.dry_run:  # clips whose copy is there are done
        there = frames.listed(spark, dest).select("clip_id").distinct() if files.exists(dest) else None
        if there is not None:
            to = F.concat(F.lit(dest), F.expr(f"substring(clip_id, {len(root) + 1})"))
            listing = listing.withColumn("_to", to).join(there.withColumnRenamed("clip_id", "_to"), "_to", "left_anti").drop("_to")
    boxes, words = (spark.read.parquet(t) if t else None for t in (args.boxes, args.words))
    clips = listing.select(F.col("clip_id").alias("path"), F.lit(True).alias("is_dir")).distinct()
    pairs = None
    if args.depth:
        tree = catalog.listing(spark, args.depth, addresses=True)
        folders = pairing.is_sequence(tree).select(F.col("folder").alias("path"), F.lit(True).alias("is_dir"))
        found = pairing.find_depth(clips, folders.unionByName(tree.select("path", F.lit(False).alias("is_dir"))))
        pairs = steps.cut(found.select(F.col("path").alias("clip_id"), "depth_path", F.col("status").alias("depth_status")), "pairs")
    report = staged.triage(listing, staged.eyes_for_stills(config, boxes, words, args.reader), config, pairs, sweep=not args.no_sweep)
    report = steps.cut(report, "report")
    if dest is not None:
        text = report.where("verdict = 'text'")
        to = F.concat(F.lit(dest), F.expr(f"substring(clip_id, {len(root) + 1})"))
        beside = F.concat(F.regexp_extract(to, r"^(.*)/[^/]*$", 1), F.lit("/"), F.regexp_extract("depth_path", r"([^/]+)/*$", 1))
        rgb = text.select(F.col("clip_id").alias("src"), to.alias("dst"))
        depth = text.where("depth_path is not null").select(F.col("depth_path").alias("src"), beside.alias("dst"))
        both = steps.cut(rgb.unionByName(depth).distinct(), "copies")
        found = catalog.listing(spark, args.stills, addresses=True).select("path", "size")
        found = found if not args.depth else found.unionByName(catalog.listing(spark, args.depth, addresses=True).select("path", "size")).distinct()
        if args.dry_run:
            done = both.withColumn("action", F.lit("would move" if args.move else "would copy"))
        else:
            done = copies.clip_actions(steps.cut(copies.carried_out(copies.files_of(both, found), args.move), "copied"), both)
        done = steps.cut(done, "copied")
        own = done.select(F.col("src").alias("clip_id"), F.col("action").alias("rgb_action"), F.col("dst").alias("rgb_dest"))
        pair = done.select(F.col("src").alias("depth_path"), F.col("action").alias("depth_action"))
        report = report.drop("rgb_action", "rgb_dest", "depth_action").join(own, "clip_id", "left").join(pair, "depth_path", "left").select(*scan.REPORT)
    scan.write_report(report, args.out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = options(args)
    spark = SparkSession.builder.appName("filmloom").getOrCreate()
    try:
        work(spark, args, config)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  the message is all a user needs
        print(f"filmloom: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
