"""Exact repeated passages by a distributed suffix array (difference cover modulo 3).

Wanted: every byte covered by a string of ``length`` bytes that starts
anywhere else as well. Sorting all byte suffixes would move each byte many
times, so the suffix array is built over a shorter string with the same
repeats:

1. Anchors. The start of the least 8-byte hash in each window of ``window``
   bytes is an anchor; equal strings have equal anchors. An anchor's symbol
   stands for the ``length - window + 1`` bytes behind it, which every string
   of ``length`` bytes that has this anchor contains. Symbols seen once in
   the corpus can't lie in a repeat and end a run; what is left is a
   collection of strings of symbols.
2. Difference cover. Suffixes at places 1 and 2 modulo 3 are sampled; their
   triples of symbols are sorted and named, the names' triples sorted and
   named again, and so on until names seen twice span ``length`` bytes. The
   remaining suffixes (place 0) are merged by (symbol, rank of the next)
   against place 1 and by (two symbols, rank of the one after) against
   place 2. Adjacent suffixes in these orders are compared: stretches of
   symbols that they share are repeats, and a string that holds more symbols
   than its suffix shares with a neighbour is none.
3. Ends. Where a repeat ends between anchors, the strings of ``length`` bytes
   that the order leaves open are compared within their anchor's symbol.

All sorts and regroupings are Spark shuffles of narrow rows of numbers; a
task holds one text's anchors or a stretch of sorted rows at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Texts are read in stretches of so many places, for a place has 19 bits within one.
STRETCH = 1 << 19
#: Runs of symbols are numbered this far apart, so that no suffix reaches into the next.
APART = 30
#: Symbols with more distinct surroundings than this have their strings dealt out by digest.
CROWDED = 1024
#: Strings and spans that a task holds before it hands them on.
HELD = 20_000
#: Surroundings seen more often than this meet their rows by a broadcast; there is at most one for so many rows.
FREQUENT = 4096


@dataclass(frozen=True)
class Repeats:
    """``window`` must be a power of two of at most 128, and less than ``length``."""

    length: int = 400
    window: int = 128

    @property
    def body(self) -> int:
        return self.length - self.window + 1


def anchors(text: bytes, r: Repeats):
    """Arrays (place, first, last): the anchors whose symbols lie in the text, and the windows that have them.

    Windows go on to the end of the text, so that a string has the same anchors
    wherever it stands.
    """
    parts = []
    for base in range(0, max(len(text) - r.window - 6, 0), STRETCH):
        part = text[base : base + STRETCH + r.window + 6]
        starts, n = len(part) - r.window - 6, len(part) - 7
        key = np.empty(n, np.uint64)
        for o in range(8):
            key[o::8] = np.frombuffer(part, "<u8", offset=o, count=(len(part) - o) // 8)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key = (key >> np.uint64(20) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
        step = 1
        while step < r.window:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        place = (key[:starts] & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = np.r_[0, new], np.r_[new, starts] - 1
        parts.append((place[first] + base, first + base, last + base))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    place, first, last = (np.concatenate(x) for x in zip(*parts))
    new = np.r_[True, place[1:] != place[:-1]]  # an anchor of two stretches is one
    place, first, last = place[new], first[new], last[np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]]
    fits = place + r.body <= len(text)
    return place[fits], first[fits], last[fits]


def _packed(place, first, last, clipped=0):
    return place << 22 | clipped << 14 | (place - first) << 7 | (place - last)


def _unpacked(packed):
    """place, first, last, and how many of the windows up to last begin too late for a whole string."""
    place = packed >> 22
    return place, place - (packed >> 7 & 127), place - (packed & 127), packed >> 14 & 255


def _batch(schema: str, columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def _columns(batch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def _whole_groups(batches, keys: int):
    """Columns of sorted batches, cut so that no group of equal first ``keys`` columns is split."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _columns(batch)
        edge = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            edge[0] |= bool(held) and held[-1][k][-1] != now[k][0]
            edge[1:] |= now[k][1:] != now[k][:-1]
        at = np.flatnonzero(edge)
        if len(at):
            done = [*held, [x[: at[-1]] for x in now]]
            if sum(len(x[0]) for x in done):
                yield [np.concatenate(x) for x in zip(*done)]
            held = [[x[at[-1] :] for x in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _by_text(rows: DataFrame, order: list[str], schema: str, work) -> DataFrame:
    """``work`` over the columns of whole texts, sorted by text (h) and ``order``."""

    def run(batches):
        for columns in _whole_groups(batches, 1):
            yield _batch(schema, work(*columns))

    return rows.repartition("h").sortWithinPartitions("h", *order).mapInArrow(run, schema)


def _by_order(rows: DataFrame, keys: list[str], others: list[str], results: str, work, near: str | None = None, label: str = "in-order") -> DataFrame:
    """``others`` of ``rows`` with what ``work`` finds for their keys, long columns ``results``.

    Equal keys are counted together first, so that a key of many rows is one
    row; the distinct keys are range-partitioned and sorted, and ``work(columns,
    n, before)`` gets them in the global order, with how many rows each stands
    for and how many keys the task has seen before. ``near`` is the result that
    is the greatest over both neighbours of a key, if there is one: a task
    takes two keys along from batch to batch, and the first and last keys of
    all tasks are compared after these are written.
    """
    out = [f"r_{k}" for k in keys]
    schema = ", ".join(f"{c} long" for c in [*out, *results.split(", "), "edge"])

    def run(batches):
        base = seen = (TaskContext.get().partitionId() << 40) + 1
        kept, ready = None, 0  # the last two keys, one of which is done

        def told(columns, until, last=False):
            edge = np.arange(len(columns[0])) + seen == base
            edge[-1] |= last
            found = [*columns[:-1], *work(columns[:-1], columns[-1], seen), edge.astype(np.int64)]
            return _batch(schema, [x[ready:until] for x in found])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = _columns(batch)
            columns = [np.concatenate(x) for x in zip(kept, now)] if kept else now
            n = len(columns[0])
            yield told(columns, n - 1)
            over = max(0, n - 2)
            kept, ready, seen = [x[over:] for x in columns], n - 1 - over, seen + over
        if kept:
            yield told(kept, len(kept[0]), True)

    distinct = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    found = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    same = [rows[k] == found[o] for k, o in zip(keys, out)]
    edge = F.when(F.col("edge") == 1, F.struct(*[F.col(o) for o in out])).alias("edge")
    done = rows.join(found, same).select(*[rows[c] for c in others], *results.split(", "), edge)
    return _across_tasks(common.cut(done, label), work, results.split(", ").index(near), near) if near else done.drop("edge")


def _across_tasks(done: DataFrame, work, which: int, near: str) -> DataFrame:
    """``done`` without ``edge``, the first and last keys of tasks, of which there are two a task; ``near`` with what these share."""
    edges = done.where("edge is not null").select("edge.*").distinct().toArrow()
    columns = [x.to_numpy() for x in edges.columns]
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    # a task's first and last key are compared as well, which share no more than is so
    more = work(columns, np.ones(len(order), np.int64), 0)[which]
    if not more.any():
        return done.drop("edge")
    some = more > 0
    met = done.sparkSession.createDataFrame(pa.table([x[some] for x in (*columns, more)], [*edges.column_names, "_more"]))
    same = [F.col(f"edge.{k}") == met[k] for k in edges.column_names]
    best = F.greatest(near, F.coalesce("_more", F.lit(0).cast("long"))).alias(near)
    return done.join(F.broadcast(met), same, "left").select(*[best if c == near else c for c in done.columns if c != "edge"])


def _with_next(shared_with_next: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What each key shares at most: with rows of its own, with the key before or the one after."""
    best = own.copy()
    best[1:] = np.maximum(best[1:], shared_with_next)
    best[:-1] = np.maximum(best[:-1], shared_with_next)
    return best


def _next_at(h, i, by: int, values):
    """For each row, the value at place i + ``by`` of the same text; 0 if there is none."""
    text = np.r_[0, np.cumsum(h[1:] != h[:-1])]
    key = text << 34 | i
    at = np.minimum(np.searchsorted(key, key + by), len(key) - 1)
    return np.where(key[at] == key + by, values[at], 0)


def _digests(texts: DataFrame, r: Repeats, schema: str, rows) -> DataFrame:
    """``rows(h, bytes, anchors, digest)``, columns of ``schema``, of every text (h, text) that has anchors."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = text.encode()
                found = anchors(b, r)
                if len(found[0]):
                    out.append(rows(h, b, found, digest))
            if out:
                whole = [np.concatenate(x) for x in zip(*out)]
                for at in range(0, len(whole[0]), 100_000):
                    yield _batch(schema, [x[at : at + 100_000] for x in whole])

    return texts.select("h", "text").mapInArrow(run, schema)


def _symbols(b: bytes, place: np.ndarray, r: Repeats, digest) -> np.ndarray:
    sym = np.fromiter((digest(b[x : x + r.body]) for x in place.tolist()), np.uint64, len(place)).view(np.int64)
    return np.where(sym == 0, 1, sym)


def symbol_rows(texts: DataFrame, r: Repeats) -> DataFrame:
    """(sym, ctx, h, place) of every anchor of texts (h, text)."""

    def rows(h, b, found, digest):
        place, first, last = found
        clipped = np.clip(last - (len(b) - r.length), 0, r.window)
        edges = zip(first.tolist(), (last - clipped).tolist(), place.tolist())
        ctx = [digest(b[x : y + r.length], (z - x) << 8 | max(y - x + 1, 0)) for x, y, z in edges]
        whole = np.array(ctx, np.uint64).view(np.int64), np.full(len(place), h), _packed(place, first, last, clipped)
        return _symbols(b, place, r, digest), *whole

    return _digests(texts, r, "sym long, ctx long, h long, place long", rows)


def symbols_seen_twice(texts: DataFrame, r: Repeats) -> DataFrame:
    """(sym) of the symbols that two anchors or more have."""
    alone = _digests(texts, r, "sym long", lambda h, b, found, digest: (_symbols(b, found[0], r, digest),))
    often = alone.groupBy("sym").agg(F.count("*").alias("n")).where("n > 1").select("sym")
    return common.cut(often, "symbols-seen-twice")  # a table of its own, so that a frequent symbol's join can be split


def symbol_strings(symbols: DataFrame, often: DataFrame) -> DataFrame:
    """(h, i, place, sym, ctx, c1, c2): symbols seen twice or more, numbered within runs; 0 ends a run."""
    kept = symbols.join(often, "sym").select("h", "place", "sym", "ctx")

    def work(h, packed, sym, ctx):
        once = np.r_[True, (h[1:] != h[:-1]) | (packed[1:] != packed[:-1])]
        h, packed, sym, ctx = (x[once] for x in (h, packed, sym, ctx))
        _, first, last, _ = _unpacked(packed)
        text = np.r_[True, h[1:] != h[:-1]]
        run = text | np.r_[True, first[1:] != last[:-1] + 1]
        at, runs = np.arange(len(h)), np.cumsum(run)
        start = np.maximum.accumulate(np.where(run, at, 0))
        of_text = np.maximum.accumulate(np.where(text, at, 0))
        # every run starts at a multiple of 3, beyond the reach of the one before
        i = (start - of_text + 2) // 3 * 3 + (runs - runs[of_text]) * APART + (at - start)
        return h, i, packed, sym, ctx, _next_at(h, i, 1, sym), _next_at(h, i, 2, sym)

    schema = "h long, i long, place long, sym long, ctx long, c1 long, c2 long"
    return _by_text(kept, ["place"], schema, work)


def _in_common(sym, c1, c2, same=True):
    """Symbols that neighbours in an order share at their start, three at most."""
    a = (sym[1:] == sym[:-1]) & same
    b = a & (c1[1:] == c1[:-1]) & (c1[1:] != 0)
    c = b & (c2[1:] == c2[:-1]) & (c2[1:] != 0)
    return a.astype(np.int64) + b + c


def sampled_ranks(strings: DataFrame, r: Repeats) -> tuple[int, DataFrame]:
    """How many symbols the names span, and (h, i, rank, lcp) of the suffixes at places 1 and 2 modulo 3.

    Triples are named in their order, then triples of names, and so on, until
    names that occur again span a string of ``length`` bytes or reach the end
    of their run. lcp is what a suffix shares at most with any other sampled
    one: exact up to three symbols, then no more than there is.
    """
    three = ["sym", "c1", "c2"]
    triples = strings.where("i % 3 <> 0").select(*three, "h", "i", F.shiftright("place", 22).alias("at"))

    def name(columns, n, before):
        return [np.arange(len(n)) + before, np.zeros(len(n), np.int64)]

    named, depth, before = _by_order(triples, three, ["h", "i", "at", *three], "name, lcp", name), 3, []

    while True:

        def names_of(h, i, at, sym, c1, c2, name, lcp, by=depth):
            last = _next_at(h, i, 2 * by, name)
            # what three names span at least; without a third they reach their run's end
            span = np.where(last > 0, _next_at(h, i, 2 * by, at) + r.body - at, r.length)
            return name, _next_at(h, i, by, name), last, sym, c1, c2, h, i, at, span, lcp

        def rank(columns, n, before, by=depth):
            n0, n1, n2, *firsts = columns
            a = n0[1:] == n0[:-1]
            b = a & (n1[1:] == n1[:-1]) & (n1[1:] > 0)
            own = np.where(n > 1, by * (1 + (n1 > 0) + (n2 > 0)), 0)
            near = np.where(a, by * (a.astype(np.int64) + b), _in_common(*firsts))
            return np.arange(len(n)) + before, _with_next(near, own), n

        keys, kept = ["n0", "n1", "n2", *three], ["h", "i", "at", *three, "span", "lcp"]
        schema = ", ".join(f"{c} long" for c in ["n0", "n1", "n2", *three, "h", "i", "at", "span", "lcp"])
        again = _by_text(named.select("h", "i", "at", *three, "name", "lcp"), ["i"], schema, names_of)
        ranked = _by_order(again, keys, kept, "name, more, n", rank, "more", "sampled-ranks")
        ranked, depth = ranked.withColumn("lcp", F.greatest("lcp", "more")).drop("more"), 3 * depth
        common.drop(*before)
        before = [ranked]
        if not ranked.where((F.col("n") > 1) & (F.col("span") < r.length)).head(1):
            return depth, ranked.select("h", "i", F.col("name").alias("rank"), "lcp")
        named = ranked


def merged(strings: DataFrame, ranks: DataFrame, depth: int) -> DataFrame:
    """(h, i, lcp): place 0 merged with place 1 (list 1) and with place 2 (list 2), neighbours compared.

    ``depth`` is how many symbols equal ranks have in common, unless their run ends before.
    """
    none = F.lit(0).cast("long")
    rows = strings.select("h", "i", none.alias("rank"), "sym", "c1", "c2").union(ranks.select("h", "i", "rank", none, none, none))

    def keys(h, i, rank, sym, c1, c2):
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1])])
        rank, sym, c1, c2 = (np.add.reduceat(x, new) for x in (rank, sym, c1, c2))
        h, i = h[new], i[new]
        one, two = i % 3 != 2, i % 3 != 1
        after, later = _next_at(h, i, 1, rank), _next_at(h, i, 2, rank)
        return (
            np.r_[np.full(one.sum(), 1), np.full(two.sum(), 2)],
            np.r_[sym[one], sym[two]],
            np.r_[np.zeros(one.sum(), np.int64), c1[two]],
            np.r_[after[one], later[two]],
            np.r_[c1[one], c1[two]],
            np.r_[c2[one], c2[two]],
            np.r_[h[one], h[two]],
            np.r_[i[one], i[two]],
        )

    by = ["list", "sym", "second", "rank", "c1", "c2"]  # the last two follow from the others
    keyed = _by_text(rows, ["i"], ", ".join(f"{c} long" for c in [*by, "h", "i"]), keys)

    def compare(columns, n, before):
        which, sym, _, rank, c1, c2 = columns
        own = np.where(n > 1, which + np.where(rank > 0, depth, 0), 0)
        return [_with_next(_in_common(sym, c1, c2, which[1:] == which[:-1]), own)]

    return _by_order(keyed, by, ["h", "i"], "lcp", compare, "lcp", "merged")


def shared(strings: DataFrame, compared: DataFrame, r: Repeats) -> DataFrame:
    """What adjacent suffixes share, as (h, place, sym, ctx, kind).

    kind 0: strings of ``length`` bytes that start at sym .. ctx are repeats.
    kind 1 and 2: an anchor all of whose strings lie in such stretches, or not.
    A string holds as many symbols as there are anchors in its first window;
    strings that hold more than their suffix shares with its neighbours in the
    order are no repeats, so they are left out.
    """
    none = F.lit(0).cast("long")
    rows = strings.select("h", "i", "place", "sym", "ctx", none.alias("lcp")).union(
        compared.select("h", "i", none, none, none, "lcp")
    )

    def work(h, i, packed, sym, ctx, lcp):
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1])])
        lcp = np.maximum.reduceat(lcp, new)
        packed, sym, ctx = (np.add.reduceat(x, new) for x in (packed, sym, ctx))
        h, i = h[new], i[new]
        place, first, last, clipped = _unpacked(packed)
        last = last - clipped
        at = np.arange(len(h))
        end_of_run = np.flatnonzero(np.r_[(h[1:] != h[:-1]) | (i[1:] != i[:-1] + 1), True])
        final = np.minimum(at + np.maximum(lcp, 1) - 1, end_of_run[np.searchsorted(end_of_run, at)])
        until = place[final] + r.body - r.length
        good = (lcp > 0) & (until >= place)
        text = np.cumsum(np.r_[True, h[1:] != h[:-1]])
        beyond = at + np.minimum(lcp, 3)
        known = (lcp < 3) & (beyond <= end_of_run[np.searchsorted(end_of_run, at)])
        high = np.where(known, np.minimum(last, place[np.minimum(beyond, len(h) - 1)] - r.window), last)
        g, a, b = text[good] << 40, place[good], until[good]
        if len(a):  # joined to stretches, text by text
            reach = np.maximum.accumulate(g + b)
            split = np.r_[True, (g + a)[1:] > reach[:-1] + 1]
            s0 = np.flatnonzero(split)
            starts, ends = (g + a)[s0], reach[np.r_[s0[1:] - 1, len(a) - 1]]
            k = np.searchsorted(starts, (text << 40) + first, "right") - 1
            inside = (k >= 0) & (ends[np.maximum(k, 0)] >= (text << 40) + high)
            who, lo, hi = h[good][s0], a[s0], ends - g[s0]
        else:
            inside, who, lo, hi = np.zeros(len(h), bool), h[:0], h[:0], h[:0]
        z, may = np.zeros(len(who), np.int64), (lcp > 0) & (high >= first)
        packed, kind = _packed(place[may], first[may], high[may]), 2 - inside.astype(np.int64)
        return np.r_[who, h[may]], np.r_[z, packed], np.r_[lo, sym[may]], np.r_[hi, ctx[may]], np.r_[z, kind[may]]

    return _by_text(rows, ["i"], "h long, place long, sym long, ctx long, kind long", work)


def _islands(places: list[int]):
    """Runs (first, last) of sorted whole numbers."""
    begin = prev = places[0]
    for a in [*places[1:], None]:
        if a is None or a > prev + 1:
            yield begin, prev
            begin = a
        prev = a


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high): the ranges of each key, those that meet or overlap joined."""
    within = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("*", reach.alias("_reach"))
    new = F.coalesce(F.col("low") > F.col("_reach") + 1, F.lit(True)).cast("int")
    rows = rows.withColumn("_k", F.sum(new).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_k").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_k")


def _open_strings(texts: DataFrame, each: DataFrame, r: Repeats) -> DataFrame:
    """(sym, ctx, low, high): repeated strings, as offsets from the anchor, of surroundings seen once.

    Strings are compared only within their anchor's symbol, each surroundings
    (all bytes of the strings that the anchor owns) once.
    """
    unsure = (F.col("n") == 1) & (F.col("kind") == 2)
    of_symbol = each.groupBy("sym").agg(F.max(unsure).alias("need"), F.count("*").alias("many")).where("need")
    asked = each.join(of_symbol.select("sym", "many"), "sym").select("sym", "ctx", "at", "many")
    lists = asked.select("at.*", "sym", "ctx", (F.col("many") > CROWDED).alias("hot")).groupBy("h").agg(
        F.collect_list(F.struct("place", "sym", "ctx", "hot")).alias("asked")
    )
    lists = common.cut(lists, "passage-ends")
    texts = common.maybe_among(texts, lists, "h")
    lists = common.with_size_checked_broadcast(lists, 48, "asked", 56)
    schema = "sym long, sub long, ctx long, low long, high long, bytes binary"
    types = [pa.int64()] * 5 + [pa.binary()]

    def strings(batches):
        out, first_with, spans = [], {}, {}

        def flushed():
            for (sym, ctx), lows in spans.items():
                out.extend((sym, ctx | 1, ctx, low, high, None) for low, high in _islands(sorted(lows)))
            for k in range(0, len(out), 4096):
                yield _batch(schema, [pa.array(c, t) for c, t in zip(zip(*out[k : k + 4096]), types)])
            out.clear(), first_with.clear(), spans.clear()

        for batch in batches:
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = text.encode()
                for x in asked:
                    place, first, last, _ = _unpacked(x["place"])
                    sym, ctx = x["sym"], x["ctx"]
                    if not x["hot"]:
                        out.append((sym, 0, ctx, first - place, 0, b[first : last + r.length]))
                        continue
                    # a crowded symbol's strings are dealt out one by one, equal ones held together once
                    for s in range(first, last + 1):
                        d, here = xxhash.xxh3_128_digest(b[s : s + r.length]), (sym, ctx, s - place)
                        known = first_with.setdefault((sym, d), here)
                        if known is here:
                            out.append((sym, int.from_bytes(d[:8], "big", signed=True) | 1, ctx, s - place, 0, d))
                        else:
                            for y in (known, here):
                                spans.setdefault(y[:2], set()).add(y[2])
                    if len(out) + len(spans) > HELD:
                        yield from flushed()
        yield from flushed()

    rows = texts.join(lists, "h").select("text", "asked").mapInArrow(strings, schema)

    def twice(columns):
        sym, sub, ctx, low, high, data = columns
        new = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | (sub[1:] != sub[:-1])])
        out = []
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(sym)]):
            seen: dict[bytes, list] = {}
            for k in range(s, e):
                b = data[k]
                if b is None:  # known already
                    out.append((int(sym[k]), int(ctx[k]), int(low[k]), int(high[k])))
                elif sub[k]:
                    seen.setdefault(b, []).append((k, int(low[k])))
                else:
                    for a in range(len(b) - r.length + 1):
                        seen.setdefault(xxhash.xxh3_128_digest(b[a : a + r.length]), []).append((k, int(low[k]) + a))
            hits: dict[int, list[int]] = {}
            for who in seen.values():
                if len(who) > 1:
                    for k, a in who:
                        hits.setdefault(k, []).append(a)
            for k, places in hits.items():
                out += [(int(sym[k]), int(ctx[k]), a, z) for a, z in _islands(sorted(places))]
        return [np.array(c, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4

    done = "sym long, ctx long, low long, high long"

    def run(batches):
        for columns in _whole_groups(batches, 2):
            yield _batch(done, twice(columns))

    found = rows.repartition("sym", "sub").sortWithinPartitions("sym", "sub").mapInArrow(run, done)
    found = common.cut(found, "string-ends")
    common.drop(lists)
    return found


def _hashed(docs: DataFrame, seed: int, *others: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.lit(seed), text).alias("h"), *others)


def repeated(docs: DataFrame, r: Repeats = Repeats()) -> tuple[int, DataFrame, DataFrame]:
    """(seed, copies, stretches) for documents (doc_id, text).

    ``copies``: hashes (h) of texts of ``length`` bytes or more that occur
    twice. ``stretches``: (h, spans), where repeated strings start in a text.
    The seed is one under which no two different texts share a hash.
    """
    spark, seed = docs.sparkSession, 0
    long_enough = docs.where(F.octet_length("text") >= r.length)
    while True:
        hashed = _hashed(long_enough, seed)
        other = F.xxhash64(F.lit(seed + 1_000_003), "text")
        groups = hashed.groupBy("h").agg(
            F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.min(other).alias("o0"), F.max(other).alias("o1")
        )
        several = common.cut(groups.where("n > 1"), "copies")
        if not several.where("o0 <> o1").head(1):
            break
        seed += 1
    copies = several.select("h", "rep")
    texts = common.with_listed(hashed, copies, "h", 48).where(
        F.col("rep").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))
    ).select("h", "text")
    common.small_batches(spark, 1000)
    often = symbols_seen_twice(texts, r)
    strings = common.cut(symbol_strings(symbol_rows(texts, r), often), "symbol-strings")
    depth, ranks = sampled_ranks(strings, r)
    compared = merged(strings, ranks, depth).union(ranks.select("h", "i", "lcp"))
    found = common.cut(shared(strings, compared, r), "shared")
    common.drop(often, strings, ranks, compared)
    each = found.where("kind > 0").groupBy("sym", "ctx").agg(
        F.count("*").alias("n"), F.max("kind").alias("kind"), F.min(F.struct("h", "place")).alias("at")
    )
    each = common.cut(each, "surroundings")
    strings_open = _open_strings(texts, each, r)
    ends = _joined(strings_open, ["sym", "ctx"])
    # surroundings seen twice are repeats as a whole; the few seen very often are kept apart
    whole = each.where("n > 1 and kind = 2").select(
        "sym", "ctx", (-F.shiftright("at.place", 7).bitwiseAND(127)).alias("low"), (-F.col("at.place").bitwiseAND(127)).alias("high"), "n"
    )
    frequent = common.with_size_checked_broadcast(whole.where(F.col("n") > FREQUENT).drop("n"), 48)
    rare = ends.join(whole, ["sym", "ctx"], "left_anti").union(whole.where(F.col("n") <= FREQUENT).drop("n"))
    marks, place = found.where("kind = 2"), F.shiftright("place", 22)
    others = marks.join(frequent.select("sym", "ctx"), ["sym", "ctx"], "left_anti").join(rare, ["sym", "ctx"])
    part = marks.join(frequent, ["sym", "ctx"]).unionByName(others)
    part = part.select("h", (place + F.col("low")).alias("low"), (place + F.col("high")).alias("high"))
    bulk = found.where("kind = 0").select("h", F.col("sym").alias("low"), F.col("ctx").alias("high"))
    spans = _joined(bulk.union(part), ["h"]).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
    spans = common.cut(spans, "stretches")
    common.drop(found, each, strings_open)
    return seed, copies, spans


def cleaned(docs: DataFrame, r: Repeats = Repeats(), others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row, and the columns ``others`` as they are.

    Null texts are empty; texts shorter than ``length`` stay as they are;
    repeated rows are copies and lose all their bytes. kept_sha256 is of the
    bytes that stay; kept_text leaves out characters that a cut divides. An
    empty table gives an empty result.
    """
    carried = [f"_o{k}" for k in range(len(others))]
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c).alias(o) for c, o in zip(others, carried)],
    )
    seed, copies, spans = repeated(docs.select("doc_id", "text"), r)
    listed = common.cut(copies.select("h", F.lit(True).alias("copy")).join(spans, "h", "full"), "copies-and-stretches")
    common.drop(copies, spans)
    rows = common.with_listed(_hashed(docs, seed, *carried), listed, "h", 48, "spans", 40)
    long_enough = F.octet_length("text") >= r.length
    rows = rows.select(
        "doc_id",
        "text",
        (F.coalesce("copy", F.lit(False)) & long_enough).alias("copy"),
        F.when(long_enough, F.col("spans")).alias("spans"),
        *carried,
    )
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    types = [pa.int64()] * 4 + [pa.string(), pa.string()]
    schema = rows.select(
        "doc_id",
        *[F.lit(0).cast("long").alias(n) for n in names[1:4]],
        *[F.lit("").alias(n) for n in names[4:]],
        *carried,
    ).schema

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, copy, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
                b = text.encode()
                cuts = [[0, len(b)]] if copy else []
                for x in [] if copy else spans or []:
                    low, high = x["low"], x["high"] + r.length
                    if cuts and low <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], high)
                    else:
                        cuts.append([low, high])
                edges = [0, *(y for c in cuts for y in c), len(b)]
                kept = b"".join(b[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                stays = kept.decode("utf-8", "ignore") if cuts else text
                out.append((doc_id, len(b), len(b) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), stays))
            if out:
                made = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([*made, *batch.columns[4:]], [*names, *carried])

    done = rows.mapInArrow(run, schema)
    return done.select(*names, *[F.col(o).alias(c) for o, c in zip(carried, others)])


def strip_repeats(docs: DataFrame, r: Repeats = Repeats()) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts, and n_chars (if there) to match. A null text becomes empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = cleaned(docs, r, others).withColumn("n_chars", F.length("kept_text").cast("long"))
    return done.withColumn("text", F.col("kept_text")).select(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    return cleaned(common.table(spark, sf_dir, "documents")).withColumnRenamed("kept_text", "text")
