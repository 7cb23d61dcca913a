"""Helpers that several operators share: text columns, Arrow batches, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one on a local master (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Narrow rows that one partition takes, where their number is known.
PART_ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` narrow rows at most, in no more partitions than they need, so that few rows make few tasks and files."""
    return df.coalesce(1 + rows // PART_ROWS)


def cut_narrow(df: DataFrame) -> DataFrame:
    """A table of narrow rows, computed once, kept in the shared folder, and read in partitions by its number of rows."""
    made = cut(df)
    return gathered(made, made.count())


#: Bytes of an Arrow batch on its way to a Python worker, where the session does not say otherwise.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python workers Arrow batches of about ``BATCH_BYTES`` at most.

    Spark's own default is 10,000 rows or 64 MB, held several times over at both ends. A limit that the user has set stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow batch (null as empty), in runs of about ``limit`` bytes, each with the row at which it begins.

    A run always has one text at least, so that a very long text is a run by itself.
    """
    column_ = batch.column(column)
    texts = column_.cast(pa.large_string())
    ends = texts.buffers()[1] if len(texts) else None
    if ends is None:
        if len(texts):
            yield 0, [x or "" for x in texts.to_pylist()]
        return
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, [x or "" for x in texts.slice(start, stop - start).to_pylist()]
        start = stop


#: What drops the caches that a Python worker holds, by operator.
_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None]) -> None:
    """An operator keeps something for its next task in this worker; ``drop`` lets go of it."""
    _held[owner] = drop


def give_back() -> None:
    """Hands memory that is free in this process back to the system, which Python and Arrow else keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


def let_go(owner: str) -> None:
    """Drops what tasks of operators other than ``owner`` left in this worker."""
    others = [name for name in _held if name != owner]
    for name in others:
        _held.pop(name)()
    if others:
        give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which first drops what tasks of other operators left in this worker, and at its end gives free memory back.

    Spark uses a Python worker again for later stages, so what one operator caches would stay in memory under all others.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        yield from run(batches)
        give_back()

    return task


def keep_rows(docs: DataFrame, text_col: str, test: Callable[[list[str]], list[bool]], limit: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` whose text passes a test; no column is moved between tasks, and null counts as empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [bool(x) for _, texts in text_slices(batch, at, limit) for x in test(texts)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return bounded(docs).mapInArrow(tidy(run), docs.schema)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of narrow rows, marked for broadcast if a count shows that it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bitmap(hashes: DataFrame, column: str = "h", most: int = 1 << 30) -> bytes:
    """A bitmap of a column of hashes, 16 bits to each row, and ``most`` bits (128 MB) at most; see ``in_bitmap``.

    It only sifts: where more rows than fit set its bits, more gets through, and an exact step decides.
    """
    size = 1 << 20
    rows = hashes.count()
    while size < min(most, 16 * rows):
        size *= 2
    slot = F.col(column).bitwiseAND(size - 1)
    parts = hashes.groupBy(F.floor(slot / 32768).alias("part")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits"))
    out = bytearray(size // 8)
    for r in parts.toLocalIterator():  # 4 KB a row
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def in_bitmap(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in a bitmap."""
    slot = hashes.astype(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (np.frombuffer(bits, dtype=np.uint8)[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Forest:
    """A spanning forest of links that come in arrays: as many edges as joined nodes, however many links there are."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.label[left], self.label[right]
        new = a != b
        if not new.any():
            return
        left, right, a, b = left[new], right[new], a[new], b[new]
        _, first = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for i in first.tolist():
            x, y = find(int(a[i])), find(int(b[i]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((int(left[i]), int(right[i])))
        root = np.arange(len(self.label))
        root[list(parent)] = [find(x) for x in list(parent)]
        self.label = root[self.label]


def _changed(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``: the smallest node that it reaches.

    Alternates the large-star and small-star rewrites until the edges stay as they are, which takes a number of rounds
    that is logarithmic in the diameter. A node's neighbours are only ever reduced to their minimum and joined back,
    never collected, so a hub costs no more than its edges. Each round is cut from its lineage; of many edges so are the
    minima, so that the joins have plain sides and Spark can split a hub's edges over tasks.
    """
    edges = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    edges = cut(edges)
    state = _changed(edges)
    n, before = state[0], None  # edges never grow in number
    edges = gathered(edges, n)
    while state[0] and state != before:
        few_parts = lambda df: gathered(df, n)
        keep = (lambda df: cut(few_parts(df))) if state[0] > 1_000_000 else few_parts
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large)
        low = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        edges = cut(few_parts(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()))
        before, state = state, _changed(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
