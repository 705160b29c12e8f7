"""Packing by optimal length buckets.

The histogram of all lengths decides the buckets: dynamic programming finds
the upper bounds that minimise padding when every sequence is padded to its
bucket's bound. Inside a bucket sequences fill batches up to a token budget.
Sequences are token ids: a batch's rows, padded to its bucket's bound, are what
a training step reads, and the pieces of a document are its ids again.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import ranked, stretches


@dataclass(frozen=True)
class Packing:
    """``longest`` is the most tokens of one sequence; longer documents go on in a
    further sequence, so nothing is cut off and the histogram has at most
    ``longest`` + 1 entries. ``budget`` bounds a batch's tokens, padding included."""

    tokenizer: str = "byte_bpe_50k.tiktoken"
    longest: int = 2048
    buckets: int = 8
    budget: int = 16384


def boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in all."""
    if not counts:
        return []
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    rows, tokens = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * lengths)]
    best = np.where(np.arange(len(n) + 1) == 0, 0.0, np.inf)
    cuts = []
    for _ in range(min(buckets, len(n))):
        after, cut = np.full(len(n) + 1, np.inf), np.zeros(len(n) + 1, np.int64)
        after[0] = 0
        for j in range(1, len(n) + 1):
            padding = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            cut[j] = int(padding.argmin())
            after[j] = padding[cut[j]]
        best = after
        cuts.append(cut)
    bounds, j = [], len(n)
    for cut in reversed(cuts):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(bounds)


#: How ids lie in the tables between the steps: bytes, four of them an id, the low halves of a row's ids before the high ones.
STORED = "doc_id long, piece long, n_tokens long, ids binary"


def _stored(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows' ids (``ends`` are the rows' limits in ``ids``) as bytes that compress well: equal sequences are equal bytes."""
    two = np.frombuffer(ids.astype("<u4").tobytes(), "<u2").reshape(-1, 2)
    rows = [two[a:b].T.tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.array(rows, pa.binary())


def _as_lists(stored: pa.Array) -> pa.ListArray:
    """``_stored`` the other way round."""
    rows = [np.frombuffer(x, "<u2").reshape(2, -1) for x in stored.to_pylist()]
    ends = np.r_[0, np.cumsum([x.shape[1] for x in rows])].astype(np.int32)
    both = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), "<u2")
    ids = both[0].astype(np.int32) | (both[1].astype(np.int32) << 16)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def sequences(docs: DataFrame, packing: Packing) -> DataFrame:
    """(doc_id, piece, n_tokens, ids as ``STORED``): documents as sequences of at most ``longest`` tokens; empty and null texts: one of length 0."""
    spark, longest = docs.sparkSession, packing.longest
    with open(public_tokenizers.path(packing.tokenizer), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        made = ranked(shared.value)
        for batch in batches:
            rows, flat, ends = [], [], [0]

            def flush():
                who, piece = zip(*rows) if rows else ((), ())
                limits = np.array(ends, np.int64)
                out = [pa.array(who, pa.int64()), pa.array(piece, pa.int64()), pa.array(np.diff(limits)), _stored(np.array(flat, np.int64), limits)]
                return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "n_tokens", "ids"])

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, piece = [], 0
                parts = [*stretches(text or "")]
                for k, part in enumerate(parts):
                    held += made.encode_ordinary(part)
                    for at in range(0, max(len(held), 1), longest):
                        if at + longest < len(held) or k == len(parts) - 1:
                            rows.append((doc_id, piece))
                            flat += held[at : at + longest]
                            ends.append(len(flat))
                            piece += 1
                        else:
                            held = held[at:]
                    if len(flat) > 1 << 20:
                        yield flush()
                        rows, flat, ends = [], [], [0]
            yield flush()

    common.small_batches(spark)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, STORED)


def _numbered(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``rows`` with _bucket, _part and _at: a row's number among those of its bucket in its task's part, written down with it."""
    which = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        which = F.when(F.col("n_tokens") <= int(bounds[k]), F.lit(k)).otherwise(which)

    def run(batches):
        next_ = np.zeros(len(bounds), np.int64)
        for batch in batches:
            bucket = batch.column(4).to_numpy()
            at = np.zeros(len(bucket), np.int64)
            for k in np.unique(bucket):
                here = np.flatnonzero(bucket == k)
                at[here] = next_[k] + np.arange(len(here))
                next_[k] += len(here)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "_at"])

    chosen = rows.select("doc_id", "piece", "n_tokens", "ids", which.alias("_bucket"), F.spark_partition_id().alias("_part"))
    schema = f"{STORED}, _bucket int, _part int, _at long"
    return common.cut(chosen.mapInArrow(run, schema), "sequences-numbered", "zstd")


def _read(rows: DataFrame) -> DataFrame:
    """``rows`` with their ids as lists; ids are the last column."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _as_lists(batch.column(batch.num_columns - 1))], batch.schema.names)

    types = [f"{c} {t}" for c, t in rows.dtypes[:-1]]
    return rows.mapInArrow(run, ", ".join([*types, "ids array<int>"]))


def pack(docs: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """doc_id, piece, n_tokens, bucket (its upper bound), batch, slot (row in the batch), padding, ids.

    Null and empty texts go in as sequences of length 0; repeated rows are
    sequences of their own; other columns are left out. An empty table gives
    an empty result. Sequences are numbered where they lie, so no token moves:
    a task writes each row with its part and its number in its bucket there,
    and parts go on from where those before them end. How tables are split when they are
    read again does not matter. What the driver and each task hold is a row for each part.
    """
    rows = common.cut(sequences(docs, packing), "sequences", "zstd")
    counts = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}  # at most longest + 1
    bounds = np.array(boundaries(counts, packing.buckets) or [0], np.int64)
    dealt = _numbered(rows, bounds)
    common.drop(rows)
    found = dealt.groupBy("_part", "_bucket").count().collect()
    parts = sorted({r["_part"] for r in found})
    each = np.zeros((len(parts), len(bounds)), np.int64)
    for r in found:
        each[bisect_left(parts, r["_part"]), r["_bucket"]] = r["count"]
    starts = (np.cumsum(each, axis=0) - each).tolist()
    table = rows.sparkSession.createDataFrame([*zip(parts, starts)], "_part int, _starts array<long>")
    fits = F.array(*[F.lit(int(n)).cast("long") for n in np.maximum(packing.budget // np.maximum(bounds, 1), 1)])
    upper = F.array(*[F.lit(int(n)).cast("long") for n in bounds])
    at, fit = F.get("_starts", F.col("_bucket")) + F.col("_at"), F.get(fits, F.col("_bucket"))
    out = dealt.join(F.broadcast(table), "_part").withColumns({"_n": at, "_fit": fit, "bucket": F.get(upper, F.col("_bucket"))})
    placed = out.select(
        "doc_id", "piece", "n_tokens", "bucket", F.floor(F.col("_n") / F.col("_fit")).cast("long").alias("batch"), F.pmod("_n", "_fit").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"), "ids"
    )
    return _read(placed)


def query(spark, sf_dir) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
