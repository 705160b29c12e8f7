"""Token counts by map-side lookup in two tiers.

A text's pre-tokens are looked up in a broadcast table of frequent ones, then
in the worker's own cache; only what neither knows is encoded. The table holds
the pre-tokens that are in the vocabulary, which a tokenizer takes up in the
order of their frequency, so it needs no pass over the corpus and is bounded
by the vocabulary. Pre-tokens are never shuffled, and every row stays where it
was read.
"""

from __future__ import annotations

import os
import re
from base64 import b64decode
from dataclasses import dataclass
from itertools import islice
from unicodedata import category

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The tokenizer's pattern in terms of the faster standard module.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that need the pattern itself.
UNSURE = re.compile(r"[^\u0000-\u001b\u0020-\u00b1\u00b4-\u00b8\u00ba-\u00bb\u00bf-\u052f\u2010-\u2060]")
#: The tokenizer's pattern as it is, for all other writing.
WIDE = regex.compile(public_tokenizers.PATTERN)
#: A long text may be cut here: what stands before and behind is encoded as in the whole.
BREAK = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Counting:
    """The tables only save time, never change a count: ``frequent`` bounds the
    broadcast tier, ``cached`` a worker's own. ``limit`` is what over_limit means."""

    tokenizer: str = "byte_bpe_50k.json"
    special: str = "<|endoftext|>"
    frequent: int = 50_000
    cached: int = 400_000
    limit: int = 1024


def load(source: str):
    """The library's tokenizer from its JSON text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source)


def ranked(source: bytes):
    """The same vocabulary's tokenizer from its table of ranks, several times as fast; control strings are plain text to it."""
    import tiktoken

    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines())}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)]


def pattern_for(text: str):
    """What cuts a text as the library does; None if it has characters newer than Python's Unicode, which the library may sort otherwise."""
    if not UNSURE.search(text):
        return PIECES
    return None if any(category(c) == "Cn" for c in set(text)) else WIDE


def pieces(text: str, pattern, at_once: int = 100_000):
    """Lists of pre-tokens; a long text comes in several."""
    if len(text) <= 1 << 20:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, at_once)):
        yield part


def stretches(text: str, size: int = 1 << 20):
    """A text in parts of about ``size`` characters that are encoded as they are in the whole."""
    at = 0
    while len(text) - at > size and (m := BREAK.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Counter2:
    """Counts tokens of texts with a fixed first tier and a bounded second."""

    def __init__(self, source: str, frequent: dict[str, int], counting: Counting):
        self.tokenizer, self.frequent, self.counting = load(source), frequent, counting
        self.model, self.characters, self.cache = self.tokenizer.model, byte_characters(), {}

    def encoded(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self.model.tokenize("".join([self.characters[b] for b in piece.encode()])))

    def lengths(self, missing: list[str]) -> int:
        known = list(map(self.cache.get, missing))
        if None not in known:
            return sum(known)
        new = list(dict.fromkeys(p for p, n in zip(missing, known) if n is None))
        if len(self.cache) + len(new) > self.counting.cached:
            self.cache, new = {}, list(dict.fromkeys(missing))
        self.cache.update((p, self.encoded(p)) for p in new)
        return sum(map(self.cache.__getitem__, missing))

    def count(self, text: str | None) -> int:
        parts = (text or "").split(self.counting.special)
        total = len(parts) - 1
        for part in parts:
            if (pattern := pattern_for(part)) is None:
                total += len(self.tokenizer.encode(part, add_special_tokens=False).ids)
                continue
            for found in pieces(part, pattern):
                known = list(map(self.frequent.get, found))
                if None in known:
                    total += self.lengths([p for p, n in zip(found, known) if n is None])
                    total += sum(filter(None, known))
                else:
                    total += sum(known)
        return total


def frequent_lengths(source: str, counting: Counting) -> dict[str, int]:
    """Token counts of the vocabulary's own pre-tokens, the most frequent first."""
    tokenizer = load(source)
    ids = range(min(tokenizer.get_vocab_size(with_added_tokens=False), counting.frequent))
    found = (tokenizer.decode([i]) for i in ids)
    usual = [p for p in dict.fromkeys(found) if p and "\ufffd" not in p and (x := pattern_for(p)) and x.findall(p) == [p]]
    return dict(zip(usual, (len(x.ids) for x in tokenizer.encode_batch(usual, add_special_tokens=False))))


def token_counts(docs: DataFrame, counting: Counting = Counting()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text counts as empty.

    The special string inside a text is one token, as the library has it by
    default. Repeated rows are counted each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(public_tokenizers.path(counting.tokenizer), encoding="utf-8") as f:
        source = f.read()
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast((source, frequent_lengths(source, counting)))

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter2(*shared.value, counting)
            found = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    )
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > counting.limit)


def query(spark, sf_dir) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
