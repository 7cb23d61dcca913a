"""Embedding near-duplicates by Euclidean p-stable hashing.

Each normalised vector is projected on random Gaussian directions; the projections, shifted and divided into steps of
``width``, give one key per table from ``depth`` directions. Vectors with a common key in some table are compared by
exact cosine in double precision, so that no link below the threshold is reported.

``depth`` follows from the number of distinct vectors (so that a bucket of unrelated vectors stays small) and the number
of tables from the recall asked for at the threshold itself; closer pairs are found with a probability near one. Equal
vectors are one class with a count. A bucket beyond ``block`` classes is dealt into blocks, and each pair of blocks is
compared in a task of its own: nothing is capped. Pairs are never emitted: a task returns the number of links of each
class and a spanning forest of them. A pair that meets in several tables counts in the first only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, bounded, components, cut, table


def collision(distance: float, width: float) -> float:
    """The probability that one quantised Gaussian projection is the same for two points at ``distance``."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float = 0.9, recall: float = 0.95, width: float = 2.5, bucket: int = 64) -> tuple[int, int]:
    """Directions to a key, and tables, for ``n`` distinct vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    depth = max(4, math.ceil(math.log(max(n, 1) / bucket) / -math.log(far))) if n > bucket else 4
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**depth)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _keys(depth: int, tables: int, width: float, seed: int):
    """Adds the keys of all tables to batches of ``id, n, vec``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
            keys = np.zeros((len(vecs), tables), dtype=np.int32)
            for dim in np.unique(sizes).tolist():
                random = np.random.default_rng([seed, dim])
                directions, shift = random.standard_normal((dim, tables * depth)), random.uniform(0, width, tables * depth)
                factors = random.integers(0, 2**63, depth, dtype=np.uint64) | np.uint64(1)
                at = np.flatnonzero(sizes == dim)
                for rows in np.array_split(at, -(-len(at) // 4096)):
                    x = unit(_matrix(vecs.take(pa.array(rows))))
                    step = np.floor((x @ directions + shift) / width).astype(np.int64).view(np.uint64).reshape(len(rows), tables, depth)
                    mixed = (step * factors).sum(axis=2, dtype=np.uint64) + np.uint64(dim)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                    keys[rows] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "vec")), flat], ["id", "n", "vec", "keys"])

    return run


def _compare(threshold: float, tile: int = 1024):
    """Streams buckets, sorted by ``file``; emits links per class (``b`` their number) and edges (``b`` the other id)."""

    def pairs(x: np.ndarray, keys: np.ndarray, table_: int, rows: np.ndarray, cols: np.ndarray, cross: bool):
        for r in range(0, len(rows), tile):
            for c in range(0 if cross else r, len(cols), tile):
                i, j = rows[r : r + tile], cols[c : c + tile]
                near = x[i] @ x[j].T >= threshold
                if not cross and r == c:
                    near = np.triu(near, 1)
                a, b = np.nonzero(near)
                for s in range(0, len(a), 200_000):
                    left, right = i[a[s : s + 200_000]], j[b[s : s + 200_000]]
                    first = ~(keys[left, :table_] == keys[right, :table_]).any(axis=1)
                    yield left[first], right[first]

    def bucket(rows: dict, s: int, e: int, out: list) -> None:
        part = slice(s, e)
        ids, n, cross, side, table_ = (rows[c][part] for c in ("id", "n", "cross", "side", "t"))
        vec, keys = rows["vec"].slice(s, e - s), rows["keys"].slice(s, e - s)
        sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():  # keys of unlike dimensions may collide
            at = np.flatnonzero(sizes == dim)
            if len(at) < 2:
                continue
            x = unit(_matrix(vec.take(pa.array(at))))
            k = keys.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            if cross[0]:
                r, c = np.flatnonzero(side[at] == 0), np.flatnonzero(side[at] == 1)
            else:
                r = c = np.arange(len(at))
            links, forest = np.zeros(len(at), dtype=np.int64), Forest(len(at))
            for left, right in pairs(x, k, int(table_[0]), r, c, bool(cross[0])):
                np.add.at(links, left, n[at[right]])
                np.add.at(links, right, n[at[left]])
                forest.add(left, right)
            if forest.edges:
                out += [(int(ids[at[a]]), int(ids[at[b]]), True) for a, b in forest.edges]
                out += [(int(ids[at[a]]), int(links[a]), False) for a in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
                if not held.num_rows:
                    continue
            elif held is None or not held.num_rows:
                break
            file = held.column("file").to_numpy()
            starts = np.r_[np.flatnonzero(np.r_[True, file[1:] != file[:-1]]), len(file)]
            if batch is not None:
                starts = starts[:-1]  # the last bucket may go on in the next batch
            rows = {c: held.column(c).to_numpy() for c in ("id", "n", "cross", "side", "t")}
            rows |= {c: held.column(c).combine_chunks() for c in ("vec", "keys")}
            rows |= {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in rows.items() if c in ("vec", "keys")}
            out: list[tuple[int, int, bool]] = []
            for s, e in itertools.pairwise(starts.tolist()):
                if e - s > 1:
                    bucket(rows, s, e, out)
            held = held.slice(int(starts[-1])) if batch is not None else None
            if out:
                a, b, edge = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(edge, pa.bool_())], ["a", "b", "edge"])

    return run


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = 0.95, width: float = 2.5, block: int = 2048, seed: int = 7, broadcast_rows: int = 500_000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing
    (their component is their own id, and they are kept). Vectors of unlike dimensions do not link. Equal vectors link;
    rows that repeat an id are separate vectors. Other columns do not matter; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    rows = rows.withColumn("vec", F.when(F.col("vec_id").isNotNull() & usable(F.col("vec")), F.transform("vec", lambda x: x + F.lit(0).cast("float"))))  # no negative zero
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "n", "vec")
    depth, tables = plan_tables(classes.count(), threshold, recall, width)
    hashed = cut(bounded(classes).mapInArrow(_keys(depth, tables, width, seed), f"id long, n long, vec {rows.schema['vec'].dataType.simpleString()}, keys array<int>"))
    file = F.col("t") * F.lit(2**32) + F.col("key")
    large = hashed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = cut(large.select("t", "key", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    known = F.broadcast(large) if large.count() <= broadcast_rows else large
    dealt = hashed.select("id", "n", "vec", "keys", F.posexplode("keys").alias("t", "key")).join(known, ["t", "key"], "left")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = dealt.select(
        F.when(F.col("blocks").isNull(), file).otherwise(F.xxhash64(file, F.least("own", "other"), F.greatest("own", "other"))).alias("file"),
        F.coalesce(F.col("own") != F.col("other"), F.lit(False)).alias("cross"), F.coalesce((F.col("own") > F.col("other")).cast("int"), F.lit(0)).alias("side"), "t", "id", "n", "vec", "keys",
    )
    found = cut(dealt.repartition("file").sortWithinPartitions("file", "t", "cross").mapInArrow(_compare(threshold), "a long, b long, edge boolean"))
    numbers = found.where("not edge").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others"))
    linked = components(found.where("edge").select("a", "b")).withColumnRenamed("node", "id")
    named = hashed.select("id", "n", "vec").join(numbers, "id", "left").join(linked, "id", "left").select("vec", F.coalesce("component", "id").alias("c"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("l"))
    # rows without a usable vector stay out of the join, where they would all have one key
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.where("vec is not null").join(named, "vec").select("vec_id", F.col("l").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept")).union(alone)


def op7_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector at cosine 0.9."""
    return links(table(spark, sf_dir, "embeddings"))
