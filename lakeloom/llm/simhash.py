"""SimHash near-duplicates by bit-sliced Hamming comparison.

A fingerprint has 64 bits; it is made from the XXH64 hashes of a text's word shingles. Fingerprints that differ in at
most ``radius`` bits link, and documents that links connect form a component.

Equal fingerprints are one class from the start, so a large group of exact copies is one row in the search. The search
splits the 64 bits into ``radius + 2`` bands; two fingerprints within the radius agree on two bands at least, so each
class is filed once under every pair of bands and only classes in one file are compared. A file beyond ``block`` classes
is dealt into blocks and every pair of blocks becomes a task of its own: no link is lost and no task grows with the file.
Comparison is bit-sliced: lane j of a 64-bit word holds bit b of pair j, and carry-save counters add the planes for all
lanes at once; words whose lanes all exceed the radius are abandoned before the other planes are read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, bounded, components, cut, cut_narrow, few, free_name, table, text_slices, tidy

SEED = 42
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Files of up to so many rows are compared together, many to one pass over the planes.
SMALL = 64
#: Pairs in one such pass.
LANES = 1 << 17
#: Bits of a set's parities.
PARITY = 512
#: Rows of a file that a quick search compares a row with.
NEXT = 4


class Nearest:
    """Of links that come in arrays, one for each row at most: to the nearest row with a smaller id, the smallest of equals."""

    def __init__(self, ids: np.ndarray, fps: np.ndarray):
        self.ids, self.fps = ids, fps
        self.distance, self.to = np.full(len(ids), 65), np.zeros(len(ids), dtype=np.int64)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        if not len(left):
            return
        below = self.ids[left] < self.ids[right]
        row, other = np.where(below, right, left), np.where(below, left, right)
        distance = np.bitwise_count(self.fps[left] ^ self.fps[right]).astype(np.int64)
        order = np.lexsort((self.ids[other], distance, row))
        order = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        row, other, distance = row[order], other[order], distance[order]
        better = (distance < self.distance[row]) | ((distance == self.distance[row]) & (self.ids[other] < self.ids[self.to[row]]))
        self.distance[row[better]], self.to[row[better]] = distance[better], other[better]

    @property
    def edges(self) -> list[tuple[int, int]]:
        found = np.flatnonzero(self.distance < 65)
        return list(zip(found.tolist(), self.to[found].tolist(), strict=True))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text; zero when it has no word.

    Only A-Z are lower-cased; words are runs without space, tab, newline, vertical tab, form feed and carriage return.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = [digest(b" ".join(found), SEED)]
    elif words == 3:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(found, found[1:], found[2:])]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(found[i:] for i in range(words)))]
    return majority(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (fp as signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, words) for _, texts in text_slices(batch, "text") for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def within_radius(differences: np.ndarray, radius: int) -> np.ndarray:
    """Which of the XORed pairs have at most ``radius`` bits set, counted over vertical bit planes."""
    n = len(differences)
    if not n:
        return np.zeros(0, dtype=bool)
    planes = bit_planes(differences, _ONES)
    return np.unpackbits(_few(planes.__getitem__, planes.shape[1], radius).view(np.uint8), bitorder="little")[:n].astype(bool)


def bit_planes(values: np.ndarray, fill: np.uint64) -> np.ndarray:
    """Row b: bit b of all values, 64 values to a word; the last word is filled up."""
    padded = np.full(-(-len(values) // 64) * 64, fill)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _few(plane: Callable[[int], np.ndarray], words: int, radius: int) -> np.ndarray:
    """Words of lanes whose bits over all 64 planes number ``radius`` or fewer, by carry-save addition."""
    digits = max(1, (radius + 1).bit_length())
    alive, out = None, np.zeros(words, dtype=np.uint64)
    counters = [np.zeros(words, dtype=np.uint64) for _ in range(digits)]
    over = np.zeros(words, dtype=np.uint64)
    for b in range(64):
        carry = plane(b) if alive is None else plane(b)[alive]
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if b % 4 == 3:  # abandon the words whose lanes have all exceeded the radius
            over |= _above(counters, radius)
            stay = over != _ONES
            left = int(stay.sum())
            if not left:
                return out
            if left < 0.6 * len(over):
                alive = np.flatnonzero(stay) if alive is None else alive[stay]
                counters, over = [c[stay] for c in counters], over[stay]
    out[slice(None) if alive is None else alive] = ~over
    return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter is greater than ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for d in range(len(counters) - 1, -1, -1):
        if radius >> d & 1:
            equal = equal & counters[d]
        else:
            above, equal = above | (equal & counters[d]), equal & ~counters[d]
    return above


def _block_links(fps: np.ndarray, side: np.ndarray, cross: bool, radius: int, found: Forest | Nearest | None = None) -> list[tuple[int, int]]:
    """The links in one file as ``found`` gathers them (else a spanning forest); ``cross``: only those between its two blocks (side 0 and 1)."""
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(fps)),) * 2
    found = found or Forest(len(fps))
    if not len(rows) or not len(cols):
        return []
    planes = bit_planes(fps[cols], np.uint64(0))
    words = planes.shape[1]
    step = max(1, 4096 // words)
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        own = np.where(fps[part][None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1) == 1, _ONES, np.uint64(0))
        near = _few(lambda b, own=own: (planes[b][None, :] ^ own[b][:, None]).ravel(), len(part) * words, radius)
        hit = np.flatnonzero(near)
        if not len(hit):
            continue
        lane = np.flatnonzero(np.unpackbits(near[hit].view(np.uint8), bitorder="little"))
        word = hit[lane >> 6]
        a, b = word // words, (word % words) * 64 + (lane & 63)
        real = b < len(cols)
        a, b = part[a[real]], cols[b[real]]
        found.add(a, b) if cross else found.add(a[a < b], b[a < b])
    return found.edges


def _compare(radius: int, nearest: bool):
    """Streams files, sorted by key, and emits the links in each: a spanning forest, or those to the nearest."""

    def gather(ids: np.ndarray, fps: np.ndarray) -> Forest | Nearest:
        return Nearest(ids, fps) if nearest else Forest(len(ids))

    def links(keys: np.ndarray, cross: np.ndarray, side: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        small = (sizes <= SMALL) & ~cross[starts]
        # the many small files together: rows at each distance within a file, as lanes of one comparison
        file_end = np.where(np.repeat(small, sizes), np.repeat(starts + sizes, sizes), 0)
        found = gather(ids, fps)
        left, right, held = [], [], 0
        for d in range(1, int(sizes[small].max(initial=1))):
            a = np.flatnonzero(np.arange(len(keys) - d) + d < file_end[: len(keys) - d])
            left.append(a)
            right.append(a + d)
            held += len(a)
            if held > LANES:
                _add_near(found, fps, left, right, radius)
                left, right, held = [], [], 0
        _add_near(found, fps, left, right, radius)
        edges = found.edges
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            part = slice(s, s + n)
            edges += [(s + x, s + y) for x, y in _block_links(fps[part], side[part], bool(cross[s]), radius, gather(ids[part], fps[part]))]
        return [(int(ids[a]), int(ids[b])) for a, b in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("file", "cross", "side", "id", "fp")
        kept: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
                kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
                if not len(kept[0]):
                    continue
                end = int(np.flatnonzero(np.r_[True, kept[0][1:] != kept[0][:-1]])[-1])  # the last file may go on
            elif kept is None or not len(kept[0]):
                break
            else:
                end = len(kept[0])
            if end:
                key, cross, side, ids, fps = (x[:end] for x in kept)
                edges = links(key, cross, side, ids, fps.view(np.uint64))
                kept = [x[end:] for x in kept]
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return run


def _add_near(found: Forest | Nearest, fps: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], radius: int) -> None:
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        near = within_radius(fps[a] ^ fps[b], radius)
        found.add(a[near], b[near])


def hamming_links(classes: DataFrame, radius: int = 2, block: int = 4096, nearest: bool = False) -> DataFrame:
    """Edges ``a, b`` (ids) of a graph with the same components as all pairs of ``id, fp`` within ``radius`` bits.

    With ``nearest``, the edges are those from each row to the nearest one with a smaller id, in each file that it is
    in. ``fp`` values must be distinct. At most ``2 * block`` rows meet in one comparison.
    """
    bands = radius + 2
    width = [64 // bands + (i < 64 % bands) for i in range(bands)]
    at = [sum(width[:i]) for i in range(bands)]
    part = [F.shiftrightunsigned("fp", at[i]).bitwiseAND((1 << width[i]) - 1) for i in range(bands)]
    # the number of the pair of bands takes part in the key, which is compared only for equality
    keys = [F.xxhash64(F.lit(n), part[i], part[j]) for n, (i, j) in enumerate(itertools.combinations(range(bands), 2))]
    filed = classes.select("id", "fp", F.explode(F.array(*keys)).alias("file"))
    sizes = cut(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1"))  # a plain side of the join, so that Spark can split a hot file
    dealt = filed.join(sizes, "file").withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    # block i meets each block j once, in task (min, max); with one block that is the file itself
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    pairs = pairs.select(
        F.when(F.col("blocks") == 1, F.col("file")).otherwise(F.xxhash64("file", F.least("own", "other"), F.greatest("own", "other"))).alias("file"),
        (F.col("own") != F.col("other")).alias("cross"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "fp",
    )
    return pairs.repartition("file").sortWithinPartitions("file", "cross").mapInArrow(tidy(_compare(radius, nearest)), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included. A null text counts as empty, and empty
    texts share the fingerprint zero. A row without id has a fingerprint but no component and links nothing. Repeated
    rows and ids are kept as they are; an empty table gives no rows; other columns do not matter.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    # an id that stands on several rows joins their classes
    again = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"), F.count_distinct("fp").alias("n")).where("n > 1")
    twice = prints.join(again.select("doc_id"), "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    linked = components(hamming_links(classes, radius).union(twice))
    named = classes.join(linked, classes.id == linked.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def similarity(left: str | None, right: str | None, words: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; a shorter text is one shingle, and texts without words are alike."""
    if left == right:
        return 1.0
    a, b = ((x or "").encode("utf-8", "surrogatepass").lower().split() for x in (left, right))
    if a == b:
        return 1.0
    a, b = (set(zip(*(x[i:] for i in range(words)))) if len(x) >= words else {tuple(x)} for x in (a, b))
    return (both := len(a & b)) / (len(a) + len(b) - both)


def shingle_hashes(text: str | None, words: int = 5) -> tuple[bytes, np.ndarray]:
    """SHA-256 of the words of a text, and the sorted distinct hashes of the shingles that ``similarity`` compares."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = hashlib.sha256(b" ".join(found)).digest()
    if len(found) < words:
        return digest, np.array([xxhash.xxh64_intdigest(b" ".join(found), len(found))], dtype=np.uint64)
    code = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    mixed = np.zeros(len(code) - words + 1, dtype=np.uint64)
    for i in range(words):
        mixed = (mixed + code[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return digest, np.unique(mixed * np.uint64(0xFF51AFD7ED558CCD))


def parity(hashes: np.ndarray) -> bytes:
    """``PARITY`` bits: whether the hashes that fall to each are odd in number. Bits that differ are shingles that differ, at least."""
    odd = np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes: the bits that are set in over half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):  # a very long text needs no more memory than this
        part = np.ascontiguousarray(hashes[start : start + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint_pairs(prints: DataFrame, radius: int = 2, block: int = 4096) -> DataFrame:
    """Pairs ``a, b`` (the larger id first) of rows ``id, fp`` that connect all rows within ``radius`` bits of each other.

    A row meets the first of its fingerprint, and the first of each fingerprint the nearest ones in the files of
    ``hamming_links``, by bit-sliced comparison.
    """
    classes = cut_narrow(prints.groupBy("fp").agg(F.min("id").alias("id")))
    equal = prints.join(classes.select("fp", F.col("id").alias("b")), "fp").where("id <> b").select(F.col("id").alias("a"), "b")
    return equal.union(hamming_links(classes, radius, block, nearest=True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()


#: Bands and least hashes to a band. Two sets of similarity 0.8 have no band in common in 3 of a million cases, rarer above.
BANDS, DEPTH = 24, 4


@functools.lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return tuple(random.integers(0, 2**64, (BANDS * DEPTH, 1), dtype=np.uint64) | np.uint64(i) for i in (0, 1))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set: the least of its hashes under ``DEPTH`` random orders."""
    salt, factor = _permutations()
    least = np.full(BANDS * DEPTH, _ONES)
    for start in range(0, len(hashes), 4096):  # a very long text needs no more memory than this
        mixed = (hashes[start : start + 4096] ^ salt) * factor
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * factor).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, DEPTH).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _shared_shingles(least: float, quick: bool):
    """Streams files, sorted by key, and emits pairs that may be ``least`` alike and are in different groups.

    Sizes and parities refuse a pair only where they prove it less alike. ``quick``: a spanning forest of the pairs among
    a row, the ``NEXT`` rows after it and the first one of its file; else all pairs of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                new.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1))
                kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
                end = int(np.flatnonzero(np.r_[True, kept[0][1:] != kept[0][:-1]])[-1])  # the last file may go on
            elif kept is None:
                break
            else:
                end = len(kept[0])
            if end:
                yield from search(*(x[:end] for x in kept))
                kept = [x[end:] for x in kept]

    def search(keys, cross, side, ids, group, n, bits) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        first, stop = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)

        def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (group[a] != group[b]) & (~cross[a] | (side[a] != side[b])) & (np.minimum(n[a], n[b]) + 1e-9 >= least * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            both = n[a] + n[b]
            apart = both - 2 * np.ceil(least / (1 + least) * both - 1e-9)
            ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= apart
            return a[ok], b[ok]

        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            if len(low):
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], ["a", "b"])

        if quick:
            found, rows = Forest(len(keys)), np.arange(len(keys))
            for b in (first, *(rows + d for d in range(1, NEXT + 1))):
                a = rows[(b != rows) & (b < stop)]
                for s in range(0, len(a), LANES):
                    found.add(*near(a[s : s + LANES], b[a[s : s + LANES]]))
            if found.edges:
                yield from out(*np.array(found.edges).T)
            return
        # row i meets the rows after it in its file, a bounded number of pairs at a time
        after = stop - np.arange(len(keys)) - 1
        total = np.cumsum(after)
        i = 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + LANES, side="right")))
            own = np.repeat(np.arange(i, j), after[i:j])
            skip = np.repeat(np.cumsum(after[i:j]) - after[i:j], after[i:j])
            yield from out(*near(own, own + 1 + np.arange(len(own)) - skip))
            i = j

    return run


def alike_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, block: int = 4096, quick: int = 3, radius: int = 2) -> DataFrame:
    """``node, component`` over ids: the components of all pairs of texts whose Jaccard similarity is ``least`` or more.

    Texts with the same words are one class. A class is filed under a key for each of ``BANDS`` bands of least hashes
    (MinHash) of its shingles. SimHash comes first: pairs whose fingerprints of the same shingles differ in ``radius``
    bits or fewer, compared bit by bit over planes (``fingerprint_pairs``). Texts of similarity 0.8 differ in ten bits on
    average, so the bands find what is beyond the radius. Quick searches over them gather large groups: over the first
    ``quick`` bands, then over all, one text of each group in a file, in time that is linear. The last search takes the
    files in which groups still meet, and every pair there that may be alike and is not in one group yet; a file beyond
    ``block`` classes is dealt into pairs of blocks. Exact similarity decides; a pair of similarity 0.8 is missed in 3 of a million cases (see ``BANDS``). Null
    counts as empty, rows without an id take no part, and an empty table gives no rows.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    again = cut_narrow(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    rows = rows.join(few(again), "id", "left_anti").union(rows.join(few(again), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text", 500_000):
                made = [shingle_hashes(x, shingle) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, len(texts)), pa.array([d for d, _ in made], pa.binary()), pa.array([len(h) for _, h in made], pa.int64()),
                     pa.array([parity(h) for _, h in made], pa.binary()), pa.array([bands(h).view(np.int64) for _, h in made], pa.list_(pa.int64())),
                     pa.array(np.array([majority(h) for _, h in made], dtype=np.uint64).view(np.int64))],
                    ["id", "words", "n", "bits", "bands", "fp"],
                )

    known = cut(bounded(rows).mapInArrow(tidy(sets), "id long, words binary, n long, bits binary, bands array<long>, fp long"))
    classes = cut_narrow(known.groupBy("words").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("words", F.col("id").alias("b")))
    same = cut_narrow(known.select("id", "words").join(few(classes), "words").where("id <> b").select(F.col("id").alias("a"), "b"))
    known = known.join(few(same.select(F.col("a").alias("id"))), "id", "left_anti").drop("words")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            near = pa.array([similarity(x[i].as_py(), y[i].as_py(), shingle) >= least for i in range(batch.num_rows)], pa.bool_())
            yield batch.select(["a", "b"]).filter(near)

    def linked(filed: DataFrame, fast: bool) -> DataFrame:
        """The pairs that are alike among rows ``file, cross, side, id, group``."""
        about = known.select("id", "n", "bits").join(few(filed.select("id").distinct()), "id", "left_semi")
        files = filed.join(few(cut_narrow(about), 200_000), "id").select("file", "cross", "side", "id", "group", "n", "bits")
        pairs = cut_narrow(files.repartition("file").sortWithinPartitions("file", "cross", "n", "id").mapInArrow(tidy(_shared_shingles(least, fast)), "a long, b long").distinct())
        return checked(pairs)

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike."""
        nominated = cut_narrow(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        texts = cut(rows.join(few(nominated), "id", "left_semi"))
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        return cut_narrow(both.select("a", "b", "x", "y").mapInArrow(tidy(alike), "a long, b long"))

    def grouped(found: DataFrame, first: int = BANDS) -> DataFrame:
        """``id, group, file`` of the first bands (else all), in the files in which groups meet."""
        so_far = cut_narrow(components(found))
        filed = known.join(few(so_far), known.id == so_far.node, "left").select("id", F.coalesce("component", "id").alias("group"), F.explode(F.slice("bands", 1, first)).alias("file"))
        met = cut_narrow(filed.groupBy("file").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("file"))
        return cut_narrow(filed.join(few(met), "file").select("id", "group", "file"))

    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    plain = (F.lit(False).alias("cross"), F.lit(0).alias("side"), "id", "group")

    def parts(filed: DataFrame) -> DataFrame:
        """Files, cut into parts of about ``block`` rows, as a quick search takes them."""
        sizes = cut_narrow(filed.groupBy("file").agg(F.count("*").alias("size")).where("size > 1"))
        return cut_narrow(filed.join(few(sizes), "file").withColumn("blocks", F.ceil(F.col("size") / block)).select(F.xxhash64("file", own).alias("file"), *plain))

    found = checked(cut_narrow(fingerprint_pairs(known.select("id", "fp"), radius, block)))
    for first in (quick, BANDS):
        one = grouped(found, first).groupBy("file", "group").agg(F.min("id").alias("id"))
        found = cut_narrow(found.union(linked(parts(one), True)))
    filed = grouped(found)
    sizes = cut_narrow(filed.groupBy("file").agg(F.count("*").alias("size")))
    filed = filed.join(few(sizes), "file").withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("own", own)
    dealt = filed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).select(
        F.when(F.col("blocks") == 1, F.col("file")).otherwise(F.xxhash64("file", F.least("own", "other"), F.greatest("own", "other"))).alias("file"),
        (F.col("own") != F.col("other")).alias("cross"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "group",
    )
    return components(found.union(linked(cut_narrow(dealt), False)).union(same))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without the rows that are near-duplicates of one that stays: of each group, the one with the smallest id.

    Two texts link if the exact Jaccard similarity of their shingles (``shingle`` words) is ``least`` or more; all such
    pairs make the groups (see ``alike_components``). Rows without an id stay; rows that share an id share its fate,
    which the least of their texts decides; null counts as empty.
    """
    linked = alike_components(docs, id_col, text_col, shingle, least)
    key = free_name(docs, "dropped_id")
    dropped = linked.where("node <> component").select(F.col("node").alias(key))
    return docs.join(few(dropped), docs[id_col] == dropped[key], "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
