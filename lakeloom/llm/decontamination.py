"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are lists of words. A running Karp-Rabin hash over ``least`` words finds the places where a
text has a run of words of some item (the seeds). For each text and item that share a seed, tiles are laid greedily: the
longest common run of unmarked words is marked on both sides, again and again, down to runs of ``least`` words. The share
of the item's words under tiles decides, so a passage is found whole, in pieces, or with its pieces in another order.

A benchmark of ``broadcast_bytes`` or less is sent to all tasks. A larger one stays a table: texts and items meet by a
join on the hashes of their runs, and each pair is tiled where its two texts have been joined.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bounded, cut, few, free_name, in_bitmap, keep_rows, table, text_slices, tidy

_NOT_WORD = bytes(i if i >= 0x80 or chr(i).isalnum() else 32 for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters and digits, and of all characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_NOT_WORD).split()


def running_hashes(tokens: np.ndarray, least: int) -> np.ndarray:
    """The Karp-Rabin hash of each run of ``least`` tokens."""
    n = len(tokens) - least + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(least):
        out = out * _BASE + tokens[k : k + n]
    return out ^ (out >> np.uint64(31))


def token_codes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64, count=len(tokens))


def diagonals(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal hashes: place in the item, place in the text, and number of hashes, of each.

    Only where a run begins or ends is held, never each pair of equal hashes, so many equal words cost no more memory.
    """
    order = np.argsort(text, kind="stable")
    low, high = (np.searchsorted(text[order], item, side=s) for s in ("left", "right"))
    begin: list[tuple[np.ndarray, np.ndarray]] = []
    stop: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(high > low).tolist():
        j = order[low[i] : high[i]]
        goes_on = (j + 1 < len(text)) & (text[np.minimum(j + 1, len(text) - 1)] == item[i + 1]) if i + 1 < len(item) else np.zeros(len(j), bool)
        came = (j > 0) & (text[j - 1] == item[i - 1]) if i else np.zeros(len(j), bool)
        for out, at in ((begin, j[~came]), (stop, j[~goes_on])):
            out.append((np.full(len(at), i), at))
    if not begin:
        return (np.zeros(0, dtype=np.int64),) * 3
    i, j, i_end, j_end = (np.concatenate([x[k] for x in out]) for out, k in ((begin, 0), (begin, 1), (stop, 0), (stop, 1)))
    a, b = np.lexsort((i, i - j)), np.lexsort((i_end, i_end - j_end))  # the nth beginning and the nth end of a diagonal belong together
    return i[a], j[a], i_end[b] - i[a] + 1


def tiles(item: list[bytes], text: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, words) from ``diagonals``, whose words are compared here.

    Longest first, then the earliest in the item, then in the text. A run that an earlier tile has cut into is put back
    with what is left of it.
    """
    heap: list[tuple[int, int, int]] = []
    for i, j, n in zip(*(x.tolist() for x in runs), strict=True):
        n += least - 1
        if item[i : i + n] == text[j : j + n]:
            heap.append((-n, i, j))
            continue
        k = 0  # hashes that agreed by chance: the words tell
        while k < n:
            e = k
            while e < n and item[i + e] == text[j + e]:
                e += 1
            if e - k >= least:
                heap.append((k - e, i + k, j + k))
            k = e + 1
    heapq.heapify(heap)
    used_item, used_text, out, left = bytearray(len(item)), bytearray(len(text)), [], len(item)
    while heap and left >= least:
        n, i, j = heapq.heappop(heap)
        n = -n
        if used_item.find(1, i, i + n) < 0 and used_text.find(1, j, j + n) < 0:
            out.append((i, j, n))
            used_item[i : i + n] = used_text[j : j + n] = b"\x01" * n
            left -= n
            continue
        free = np.frombuffer(used_item, np.uint8, n, i) | np.frombuffer(used_text, np.uint8, n, j)
        edge = np.flatnonzero(np.diff(np.r_[1, free, 1]))
        for k, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - k >= least:
                heapq.heappush(heap, (k - e, i + k, j + k))
    return out


def tiled(item: list[bytes], hashes: np.ndarray, text: list[bytes], text_hashes: np.ndarray, least: int) -> tuple[int, int, int, int] | None:
    """An item's words, tiles, words under tiles and longest tile in a text; None without a tile."""
    found = tiles(item, text, diagonals(hashes, text_hashes), least)
    return (len(item), len(found), sum(t[2] for t in found), max(t[2] for t in found)) if found else None


def run_hashes(tokens: list[bytes], least: int) -> np.ndarray:
    return running_hashes(token_codes(tokens), least)


class Block:
    """A small benchmark with the hashes of its runs."""

    def __init__(self, items: list[tuple[int | None, str]], least: int):
        self.least = least
        made = [(i, words(t)) for i, t in items]
        self.items = [(i, w, run_hashes(w, least)) for i, w in made if len(w) >= least]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in self.items)])
        owner = np.repeat(np.arange(len(self.items)), [len(h) for _, _, h in self.items])
        pairs = np.unique(np.rec.fromarrays([hashes, owner.astype(np.int64)], names="h,o")) if len(hashes) else np.rec.fromarrays([hashes, owner.astype(np.int64)], names="h,o")
        self.hashes, self.owner = np.ascontiguousarray(pairs["h"]), np.ascontiguousarray(pairs["o"])
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item, its words, tiles, words under tiles, longest tile) of the items that share a run with the text."""
        tokens = words(text)
        if len(tokens) < self.least or not len(self.hashes):
            return []
        h = run_hashes(tokens, self.least)
        seen = np.unique(h[self.sieve[(h >> np.uint64(44)).astype(np.int64)]])
        first, last = (np.searchsorted(self.hashes, seen, side=s) for s in ("left", "right"))
        owners = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.owner[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True) if b > a)]))
        found = []
        for n in owners.tolist():
            item, own, hashes = self.items[n]
            if hit := tiled(own, hashes, tokens, h, self.least):
                found.append((item, *hit))
        return found


_FOUND = "doc_id long, item_id long, item_words long, n_tiles long, covered_words long, longest_tile long, coverage double"


def _plain(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows, benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _small(items: DataFrame, broadcast_bytes: int) -> list[tuple[int | None, str]] | None:
    """All items where they have ``broadcast_bytes`` or less, else None."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("size")).first()["size"]
    return [(r["item_id"], r["text"]) for r in items.collect()] if size <= broadcast_bytes else None


def _batch(found: list[tuple], schema: str) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [()] * len(schema.split(", "))
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, schema.split(", "), strict=True)], [x.split()[0] for x in schema.split(", ")])


def _by_join(rows: DataFrame, items: DataFrame, coverage: float, least: int) -> DataFrame:
    """``digest`` (SHA-256 of a text) and the columns of ``tilings`` but the id, for distinct texts, by joins on run hashes.

    Texts and items meet by a common run. The runs of texts are sifted by a bitmap of the items' runs before they are
    moved; the side of the items is a table of its own, so that Spark can split a run which very many texts have.
    """

    def runs(key: str, bits=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(key).to_pylist()
                for start, texts in text_slices(batch, "text", 1_000_000):
                    for i, text in enumerate(texts, start):
                        h = np.unique(run_hashes(words(text), least))
                        h = h if bits is None else h[in_bitmap(bits.value, h)]
                        yield pa.RecordBatch.from_arrays([pa.array([keys[i]] * len(h), pa.string()), pa.array(h.view(np.int64))], [key, "h"])

        return run

    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = rows.where("text is not null").select("text", digest.alias("digest"))
    kinds = items.select("text", digest.alias("item")).dropDuplicates(["item"])
    item_runs = cut(bounded(kinds).mapInArrow(tidy(runs("item")), "item string, h long"))
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(item_runs.select("h").distinct()))  # 128 MB at most
    text_runs = bounded(texts).mapInArrow(tidy(runs("digest", bits)), "digest string, h long")
    pairs = cut(text_runs.join(item_runs, "h").select("digest", "item").distinct())
    own = texts.join(few(pairs.select("digest").distinct()), "digest", "left_semi").dropDuplicates(["digest"])
    both = pairs.join(own.withColumnRenamed("text", "x"), "digest").join(kinds.select("item", F.col("text").alias("y")), "item").select("digest", "item", "x", "y")
    schema = "digest string, item string, item_words long, n_tiles long, covered_words long, longest_tile long, coverage double"

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for digest_, item, x, y in zip(*(batch.column(c) for c in ("digest", "item", "x", "y")), strict=True):
                text, own_ = words(x.as_py()), words(y.as_py())
                hit = tiled(own_, run_hashes(own_, least), text, run_hashes(text, least), least)
                if hit and hit[2] >= coverage * hit[0]:
                    found.append((digest_.as_py(), item.as_py(), *hit, hit[2] / hit[0]))
            yield _batch(found, schema)

    return bounded(both).mapInArrow(tidy(lay), schema)


def tilings(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, least: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 16_000_000) -> DataFrame:
    """``doc_id, item_id, item_words, n_tiles, covered_words, longest_tile, coverage`` where coverage reaches the threshold.

    Items with fewer than ``least`` words cannot be told from chance and are not searched (``too_short`` counts them).
    Null texts match nothing; equal items and repeated rows give a row each; rows without an id appear with a null id;
    empty tables give no rows; other columns do not matter. Very long or repetitive texts cost memory in proportion. A
    benchmark of ``broadcast_bytes`` or less is sent to the tasks; a larger one is joined, with the same rows.
    """
    rows, items = _plain(docs, benchmark, id_col, text_col)
    small = _small(items, broadcast_bytes)
    if small is None:
        found = cut(_by_join(rows, items, coverage, least))
        digest = F.sha2(F.col("text").cast("binary"), 256)
        out = found.join(rows.select("doc_id", digest.alias("digest")), "digest").join(items.select("item_id", digest.alias("item")), "item")
        return out.select(*(c.split()[0] for c in _FOUND.split(", ")))
    shared = docs.sparkSession.sparkContext.broadcast(Block(small, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = []
            for start, texts in text_slices(batch, "text"):
                for i, text in enumerate(texts, start):
                    found += [(ids[i], *hit, hit[3] / hit[1]) for hit in shared.value.search(text) if hit[3] >= coverage * hit[1]]
            yield _batch(found, _FOUND)

    return bounded(rows).mapInArrow(tidy(search), _FOUND)


def too_short(benchmark: DataFrame, least: int = 5) -> DataFrame:
    """``item_id, n_words`` of the items that have too few words to be searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(words(x)) for _, texts in text_slices(batch, "text") for x in texts]
            yield _batch([(i, n) for i, n in zip(batch.column("item_id").to_pylist(), sizes, strict=True) if n < least], "item_id long, n_words long")

    return bounded(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "item_id long, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, least: int = 5, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` without the rows whose text covers a benchmark item; rows and items are treated as by ``tilings``."""
    rows, items = _plain(docs, benchmark, "doc_id", "text")
    small = _small(items, broadcast_bytes)
    if small is None:
        found = _by_join(rows, items, coverage, least).select(F.col("digest").alias(key := free_name(docs, "digest"))).distinct()
        return docs.join(few(cut(found)), F.sha2(docs["text"].cast("string").cast("binary"), 256) == F.col(key), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(Block(small, least))
    return keep_rows(docs, "text", lambda texts: [all(hit[3] < coverage * hit[1] for hit in shared.value.search(text)) for text in texts])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return tilings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
