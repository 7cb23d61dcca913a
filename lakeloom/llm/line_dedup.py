"""Line deduplication by the shortest runs of lines with enough words.

From each line forward and from each line back, a chunk is the shortest run of lines that has ``least_words`` words. A
passage of lines that stands elsewhere and has that many words is covered by chunks that lie in it: each of its lines
begins one, or else is in the one that ends with the passage. So any repeated run of lines is found whole, wherever its
lines are broken and whatever stands around it. A long line (of ``least_words`` and more) is a chunk by itself.

A chunk that stands anywhere else in the corpus is removed but where it stands first (by id, then text, then line).
Short hashes only nominate, through a bitmap of those that came again: chunks are grouped by the SHA-256 of their text. A short line that stands beside a removed
chunk, and is the same beside the first one, goes with it. Every removed line has an equal line at an earlier place, so
its first copy always stays.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bounded, cut, free_name, table, text_slices, tidy

_KEYS = ["k1", "k2"]


def chunks(lines: list[str], least_words: int = 20) -> list[tuple[int, int, int]]:
    """(first line, line after the last, hash) of each shortest run of lines with enough words, seen from either end."""
    raw = [line.encode("utf-8", "surrogatepass") for line in lines]
    upto = list(itertools.accumulate((len(r.split()) for r in raw), initial=0))
    if upto[-1] < least_words:
        return []
    spans, end, start = set(), 1, 0
    for at in range(len(lines)):
        while end < len(lines) and upto[end] - upto[at] < least_words:
            end += 1
        end = max(end, at + 1)
        if upto[end] - upto[at] >= least_words:
            spans.add((at, end))
        while start < at and upto[at + 1] - upto[start + 1] >= least_words:
            start += 1
        if upto[at + 1] - upto[start] >= least_words:
            spans.add((start, at + 1))
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(r).to_bytes(8, "little") for r in raw]
    return [(s, e, digest(b"".join(hashes[s:e]))) for s, e in sorted(spans)]


def _same(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash_rows(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([_signed(h) for text in texts for _, _, h in chunks(text.split("\n"), least_words)], pa.int64())], ["h"])

    return run


def _text_rows(least_words: int, sieve):
    """Digests of the chunks that the sieve lets through, and of the short lines beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        bits = sieve.value
        mask = 8 * len(bits) - 1
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            for start, texts in text_slices(batch, "text", 1_000_000):
                rows = []
                for i, text in enumerate(texts, start):
                    lines = text.split("\n")
                    for s, e, h in chunks(lines, least_words):
                        if bits[(h & mask) >> 3] >> (h & 7) & 1:
                            beside = [_same(lines[n]) if 0 <= n < len(lines) and len(lines[n].split()) < least_words else None for n in (s - 1, e)]
                            rows.append((k1[i], k2[i], s, e, _same("\n".join(lines[s:e])), *beside))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["k1", "k2", "first", "end", "chunk", "above", "below"])

    return run


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest, spans = batch.select([c for c in batch.schema.names if c not in ("text", "spans")]), batch.column("spans").to_pylist()
        for start, texts in text_slices(batch, "text"):
            new, gone, total = [], [], []
            missing = batch.column("text").is_null().to_pylist()
            for i, text in enumerate(texts, start):
                lines = text.split("\n")
                drop = {n for span in spans[i] or () for n in range(span["first"], span["end"])}
                new.append(None if missing[i] else "\n".join([x for n, x in enumerate(lines) if n not in drop]) if drop else text)
                gone.append(sorted(drop))
                total.append(0 if missing[i] else len(lines))
            part = rest.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, pa.string()), pa.array(total, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32()))], [*part.schema.names, "text", "n_lines", "n_removed", "removed_lines"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """``docs`` as ``k1, k2, id, text``, and the line spans to remove from each text (``k1, k2, spans``).

    Rows alike in id and text have one key, and so the same fate; ``k1`` is the id (the least long for a null one).
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("text is not null")
    again = cut(bounded(known).mapInArrow(tidy(_hash_rows(least_words)), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    sieve = docs.sparkSession.sparkContext.broadcast(bitmap(again))  # 128 MB at most; it only saves moving chunks that stand once
    texts = cut(bounded(known).mapInArrow(tidy(_text_rows(least_words, sieve)), "k1 long, k2 long, first int, end int, chunk binary, above binary, below binary"))
    place = F.struct("k1", "k2", "first", "above", "below")
    # cut, so that the join below has plain sides and Spark can split a chunk that stands very often
    groups = cut(texts.groupBy("chunk").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = texts.join(groups, "chunk").where((F.col("k1") != F.col("kept.k1")) | (F.col("k2") != F.col("kept.k2")) | (F.col("first") != F.col("kept.first")))
    first = F.col("first") - F.coalesce((F.col("above") == F.col("kept.above")).cast("int"), F.lit(0))
    end = F.col("end") + F.coalesce((F.col("below") == F.col("kept.below")).cast("int"), F.lit(0))
    spans = later.select("k1", "k2", F.struct(first.alias("first"), end.alias("end")).alias("span"))
    return rows, spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20) -> DataFrame:
    """``docs`` with each text rewritten, and ``n_lines, n_removed, removed_lines`` (numbers from 0) added.

    All rows stay, also where no line is left (an empty text). A null text stays null and takes no part; an empty table
    gives no rows. Other columns are kept as they are; where one of the added names is taken, underscores go in front.
    """
    _, spans = removals(docs, id_col, text_col, least_words)
    names = {c: free_name(docs, c) for c in ("n_lines", "n_removed", "removed_lines")}
    others = [c for c in docs.columns if c != text_col]
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(text_col).alias("k2")]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.col(text_col).cast("string").alias("text"), *keys)
    plain = plain.join(spans, _KEYS, "left").drop(*_KEYS)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(others)), "text string, n_lines long, n_removed long, removed_lines array<int>"])
    back = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("text")}
    return bounded(plain).mapInArrow(tidy(_rewrite), schema).select(*(back[c].alias(c) for c in docs.columns), *(F.col(c).alias(names[c]) for c in ("n_lines", "n_removed", "removed_lines")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated passages removed."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "removed_lines")
