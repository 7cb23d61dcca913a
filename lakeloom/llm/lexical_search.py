"""Ranked lexical search over a clustered index, exact, with whole shards skipped by their bounds.

Recursive graph bisection orders the documents: a bipartite graph of documents and (hashed) terms is halved again and
again so that the logarithmic gaps of the terms' postings get small, by swapping the documents whose moves gain most. It
is fitted on a bounded sample of documents; what it leaves is a tree that routes any document by the sum of its terms'
moving costs, and every document is routed and indexed. Documents of a leaf stand together in shards of ``SHARD`` at most,
and are numbered in the new order; a leaf with more documents (a third of all, if they are copies) is dealt over as many
splits as it needs.

The index has a row for each shard and term: the numbers of the documents, their impacts, and the largest impact, which
bounds what the term can add in the shard. A search sums those bounds for each query and shard, visits the shards in the
order of their bounds in a few growing rounds, and stops for a query once no shard left reaches its tenth best score.
A shard whose bound equals that score is still visited, as an equal score with a smaller ``doc_id`` comes first.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.ordered import with_position

from .common import bounded, cut, cut_narrow, shared_folder, table, text_slices, tidy

#: Documents of a shard at most, documents that the bisection is fitted on at most, its depth, its hashed terms.
SHARD, SAMPLE, DEPTH, SLOTS = 1024, 4096, 6, 8192
#: Queries that are searched together, and shards that each of them visits in the first round (16 times as many in each further one).
QUERY_BLOCK, FIRST_SHARDS = 2000, 4

_TURN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased; null has none. All bytes of a character beyond ASCII are term bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TURN).split()


def _slots(found) -> np.ndarray:
    """The hashed terms of a document, each once."""
    return np.unique(np.fromiter((zlib.crc32(t) % SLOTS for t in found), dtype=np.int64))


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    """What a term with ``degree`` documents costs in a part of ``size``: a logarithmic gap for each posting."""
    return degree * (math.log2(max(size, 1)) - np.log2(degree + 1))


class Bisection:
    """A tree of halvings: for each inner node (in heap order from 1) the terms' moving costs and a threshold.

    A document belongs to the lower half of a node if the sum of its terms' costs, those of the upper half less those of
    the lower one, is above the threshold.
    """

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.costs = np.zeros((1 << depth, SLOTS), dtype=np.float32)
        self.threshold = np.zeros(1 << depth, dtype=np.float32)

    @classmethod
    def fit(cls, sample: list[np.ndarray], depth: int = DEPTH, rounds: int = 12) -> Bisection:
        """Fits the tree on the hashed terms of a sample of documents."""
        made = cls(depth)
        parts = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            docs = parts.pop(node, np.zeros(0, dtype=np.int64))
            lower = made._halve(node, [sample[i] for i in docs], rounds)
            parts[2 * node], parts[2 * node + 1] = docs[lower], docs[~lower]
        return made

    def _halve(self, node: int, docs: list[np.ndarray], rounds: int) -> np.ndarray:
        n = len(docs)
        lower = np.arange(n) < n // 2
        if n < 4:
            return lower
        owner, slot = np.repeat(np.arange(n), [len(d) for d in docs]), np.concatenate(docs)
        for last in (*[False] * rounds, True):
            here, sizes = lower[owner], (int(lower.sum()), int(n - lower.sum()))
            a, b = np.bincount(slot[here], minlength=SLOTS), np.bincount(slot[~here], minlength=SLOTS)
            to_a, to_b = _cost(a + 1, sizes[0]) - _cost(a, sizes[0]), _cost(b + 1, sizes[1]) - _cost(b, sizes[1])
            if last:
                self.costs[node] = to_b - to_a
                value = np.bincount(owner, self.costs[node][slot], minlength=n)
                self.threshold[node] = np.median(value)
                return value > self.threshold[node]
            off_a, off_b = _cost(a, sizes[0]) - _cost(np.maximum(a - 1, 0), sizes[0]), _cost(b, sizes[1]) - _cost(np.maximum(b - 1, 0), sizes[1])
            gain = np.bincount(owner, np.where(here, (off_a - to_b)[slot], (off_b - to_a)[slot]), minlength=n)
            down, up = np.flatnonzero(lower), np.flatnonzero(~lower)
            down, up = down[np.argsort(-gain[down], kind="stable")], up[np.argsort(-gain[up], kind="stable")]
            k = min(len(down), len(up))
            swaps = int(np.count_nonzero(gain[down[:k]] + gain[up[:k]] > 1e-9))
            if swaps:
                lower[down[:swaps]], lower[up[:swaps]] = False, True
            else:
                rounds = 0
        raise AssertionError("the last round returns")

    def route(self, slots: np.ndarray) -> tuple[int, float]:
        """A document's leaf, and by how much it belongs to its half of the last node."""
        sums = self.costs[:, slots].sum(axis=1)
        node, over = 1, 0.0
        for _ in range(self.depth):
            over = float(sums[node] - self.threshold[node])
            node = 2 * node + (over <= 0)
        return node - (1 << self.depth), over


def _sampled(docs: DataFrame, rows: int) -> list[np.ndarray]:
    """The hashed terms of ``SAMPLE`` documents at most, chosen by a hash of id and text."""
    share = min(1 << 20, math.ceil((1 << 20) * SAMPLE / max(rows, 1)))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share).limit(SAMPLE).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([_slots(set(terms(t))).astype(np.int16).tobytes() for t in texts], pa.binary())], ["slots"])

    return [np.frombuffer(r["slots"], dtype=np.int16).astype(np.int64) for r in bounded(chosen).mapInArrow(tidy(run), "slots binary").toLocalIterator() if r["slots"]]


def _routed(docs: DataFrame, tree: Bisection) -> tuple[int, int, dict[int, int]]:
    """Of all documents with a term: their number, the number of their terms, and their number by leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(1 << tree.depth, dtype=np.int64), np.zeros(1 << tree.depth, dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch):
                for text in texts:
                    if found := terms(text):
                        leaf = tree.route(_slots(set(found)))[0]
                        count[leaf] += 1
                        total[leaf] += len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count), pa.array(total)], ["leaf", "n", "terms"])

    rows = bounded(docs).select("text").mapInArrow(tidy(run), "leaf long, n long, terms long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).collect()
    return sum(r["n"] for r in rows), sum(r["terms"] for r in rows), {r["leaf"]: r["n"] for r in rows}


class Index:
    """A clustered index in the shared folder: ``path`` of its rows, the number of documents with a term, of their terms."""

    def __init__(self, path: str, n_docs: int, n_terms: int):
        self.path, self.n_docs, self.n_terms = path, n_docs, n_terms

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


_INDEX = "shard long, term binary, top long, docs array<int>, impacts array<int>, ids array<long>"


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """Indexes every row of ``docs`` that has a term, under ``path`` (a new one in the shared folder).

    Rows without an id and repeated rows are documents of their own. Null and empty texts have no terms and are not in the
    index; an empty table gives an empty one. Other columns, whatever their names, do not matter.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tree = Bisection.fit(_sampled(docs, docs.count()))
    n_docs, n_terms, leaves = _routed(docs, tree)
    splits = [max(1, math.ceil(leaves.get(leaf, 0) / SHARD)) for leaf in range(1 << tree.depth)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                keys = batch.column("deal").slice(start, len(texts)).to_pylist()
                at, leaf, split, over, sizes, lengths, flat, times = [], [], [], [], [], [], [], []
                for i, text in enumerate(texts):
                    found = Counter(terms(text))
                    if not found:
                        continue
                    where, margin = tree.route(_slots(found))
                    at.append(start + i)
                    leaf.append(where)
                    split.append(keys[i] % splits[where])
                    over.append(margin)
                    sizes.append(len(found))
                    lengths.append(sum(found.values()))
                    flat.extend(found.keys())
                    times.extend(found.values())
                ends = pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(leaf, pa.int32()), pa.array(split, pa.int64()), pa.array(over, pa.float64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, pa.binary())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))],
                    ["doc_id", "leaf", "split", "over", "n", "terms", "times"],
                )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, size, key = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            keys = list(zip(batch.column("leaf").to_pylist(), batch.column("split").to_pylist(), strict=True))
            begin = 0
            for i, k in enumerate([*keys, None]):
                if i < len(keys) and k == key and size + i - begin < SHARD:
                    continue
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                    size += i - begin
                if i < len(keys):
                    if held:
                        yield _shard(made, held, n_docs, n_terms)
                        made += 1
                    held, size, key, begin = [], 0, k, i
        if held:
            yield _shard(made, held, n_docs, n_terms)

    deal = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 40)).alias("deal")
    parsed = bounded(docs.select("doc_id", "text", deal)).mapInArrow(tidy(parse), "doc_id long, leaf int, split long, over double, n long, terms array<binary>, times array<int>")
    ordered = parsed.repartition("leaf", "split").sortWithinPartitions("leaf", "split", F.desc("over"), "doc_id")
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    ordered.mapInArrow(tidy(shards), _INDEX).write.parquet(path)
    return Index(path, n_docs, n_terms)


def _shard(number: int, parts: list[pa.RecordBatch], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The index rows of one shard, whose documents stand in ``parts`` in their new order."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    lists = whole.column("terms").combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    code = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    tf = whole.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    m = 25 + 75 * whole.column("n").to_numpy().astype(np.int64) * n_docs // n_terms
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    order = np.argsort(code, kind="stable")
    sizes = np.bincount(code, minlength=len(coded.dictionary))
    ends = np.r_[0, np.cumsum(sizes)]
    top = np.maximum.reduceat(impact[order], ends[:-1])
    k = len(sizes)
    lists_of = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.r_[ends, ends[-1]], pa.int32()), pa.array(values, kind))
    ids = pa.array([None] * k + [whole.column("doc_id").to_pylist()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k + 1, number), pa.int64()), pa.concat_arrays([coded.dictionary, pa.array([None], pa.binary())]), pa.array(np.r_[top, 0], pa.int64()), lists_of(doc[order], pa.int32()), lists_of(impact[order].astype(np.int32), pa.int32()), ids],
        ["shard", "term", "top", "docs", "impacts", "ids"],
    )


def _score(wanted: dict[int, list[tuple[bytes, int]]], best: int):
    """Scores the documents of one shard for the queries that visit it, and gives each query's best."""

    def run(index: pa.Table, visits: pa.Table) -> pa.Table:
        postings, ids = {}, []
        docs, impacts = index.column("docs").combine_chunks(), index.column("impacts").combine_chunks()
        ends, flat, values = docs.offsets.to_numpy(), docs.values.to_numpy(zero_copy_only=False), impacts.values.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = impacts.offsets.to_numpy()
        for i, term in enumerate(index.column("term").to_pylist()):
            if term is None:
                ids = index.column("ids")[i].as_py()
            else:
                postings[term] = flat[ends[i] : ends[i + 1]], values[starts[i] : starts[i + 1]]
        key = np.array([-(1 << 63) if x is None else x for x in ids], dtype=np.int64)
        out: list[tuple[int, int | None, int]] = []
        for query in visits.column("query").to_pylist():
            total = np.zeros(len(ids), dtype=np.int64)
            for term, weight in wanted[query]:
                if term in postings:
                    at, impact = postings[term]
                    total[at] += weight * impact
            found = np.flatnonzero(total)
            if len(found) > best:
                least = np.partition(total[found], len(found) - best)[len(found) - best]
                found = found[total[found] >= least]
                found = found[np.lexsort((key[found], -total[found]))[:best]]
            out.extend((query, ids[i], int(total[i])) for i in found.tolist())
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query": pa.array(columns[0], pa.int32()), "doc_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})

    return run


def search(index: Index, items: DataFrame, best: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of each row of ``items``, equal scores by ascending ``doc_id``.

    Only documents with a score above 0 come, so an item without a term (null and empty texts) or without a known one has no
    rows. Rows of ``items`` that repeat, or have no id, are ranked each. Documents without an id stand before
    others of the same score.
    """
    spark = items.sparkSession
    items = cut(with_position(items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")), F.asc_nulls_first("item_id"), "text", name="query").withColumn("query", F.col("query").cast("int")))
    out = None
    for first in range(1, items.count() + 1, QUERY_BLOCK):
        block = items.where(F.col("query").between(first, first + QUERY_BLOCK - 1))
        found = _search_block(index, {r["query"]: Counter(terms(r["text"])) for r in block.select("query", "text").toLocalIterator()}, spark, best)
        found = block.join(F.broadcast(found), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out if out is not None else items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)


def _search_block(index: Index, asked: dict[int, Counter], spark: SparkSession, best: int) -> DataFrame:
    """``query, rank, doc_id, score`` for one block of queries, given as counts of their terms."""
    known = F.broadcast(spark.createDataFrame([(None,), *((t,) for t in sorted(set().union(*asked.values())))], "asked binary"))  # null: the row of ids
    at = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    rows = index.rows(spark)
    rows.join(known, F.col("term").eqNullSafe(F.col("asked")), "left_semi").write.parquet(at)
    hot = spark.read.parquet(at)
    held = {bytes(r["term"]): r["df"] for r in hot.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
    wanted = {q: [(t, n * weight[t]) for t, n in found.items() if weight.get(t)] for q, found in asked.items()}
    parts = F.broadcast(spark.createDataFrame([(q, t, w) for q, found in wanted.items() for t, w in found], "query int, term binary, weight long"))
    left = cut_narrow(hot.where("term is not null").select("shard", "term", "top").join(parts, "term").groupBy("query", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "source")
    top = spark.createDataFrame([], "query int, doc_id long, score long, rank int")
    visit = FIRST_SHARDS
    while True:
        picks = cut(left.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "shard"))).where(F.col("n") <= visit).drop("n"))
        if picks.isEmpty():
            return top
        shards = hot.join(picks.select("shard").distinct(), "shard", "left_semi")
        scored = shards.groupBy("shard").cogroup(picks.groupBy("shard")).applyInArrow(_score(wanted, best), "query int, doc_id long, score long")
        both = top.drop("rank").withColumn("source", F.lit(0)).union(scored.withColumn("source", F.lit(1)))
        top = cut(both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best).drop("source"))
        least = F.broadcast(top.where(F.col("rank") == best).select("query", F.col("score").alias("least")))
        left = cut_narrow(left.join(picks, ["query", "shard"], "left_anti").join(least, "query", "left").where("least is null or bound >= least").drop("least"))
        visit *= 16


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each row of ``benchmark``."""
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM cut WHERE len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY term),
asked AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY i, item_id, term),
scored AS (
  SELECT i, item_id, r, doc_id, sum(times * weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (r), stats GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
