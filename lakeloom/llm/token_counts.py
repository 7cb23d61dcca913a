"""Exact token counts of whole texts, with resynchronisation for huge ones.

Texts up to ``long_chars`` characters are encoded whole. A longer text is cut into chunks that overlap, the chunks are
spread over the cluster and encoded apart, and neighbours are spliced at a boundary that both encodings have.

A byte-level vocabulary whose tokens all encode to themselves gives the same pieces whether pairs merge by a list of
merges or by the rank of what they give: where merging inside a token has come to two parts that make it up, those are the
parts of its own merge. So whole texts are counted by rank, which is quicker, if all their characters belong to classes
that have not changed since Unicode 3.2 and they hold no special string; other texts are counted by the library itself.

Why a common boundary is safe: the library first splits a text into words by scanning from left to right, and where it
goes on from a position depends only on what follows. So once two chunks have a word boundary at the same place, all
that follows is the same in both, and tokens never span words. A chunk's last words may be affected by its end, so only
boundaries with ``TAIL_WORDS`` words and ``TAIL_BYTES`` bytes after them count. Where the overlap holds no common
boundary (one word as long as the overlap), the texts concerned are encoded again with an overlap four times as wide.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, table, text_slices

TAIL_WORDS, TAIL_BYTES = 4, 32


@functools.lru_cache(maxsize=4)
def tokenizer(name: str):
    """The tokenizer of a vocabulary file: a name in the public collection, or a path."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


@functools.lru_cache(maxsize=4)
def _token_bytes(name: str) -> np.ndarray:
    """The length in bytes of each id: byte-level tokens have a character for a byte, added ones are literal."""
    made = tokenizer(name)
    added = {i: t.content for i, t in made.get_added_tokens_decoder().items()}
    out = np.zeros(made.get_vocab_size(), dtype=np.int64)
    for token, i in made.get_vocab().items():
        out[i] = len(added[i].encode()) if i in added else len(token)
    return out


#: Fixed value: how the byte-level libraries split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=1)
def settled() -> np.ndarray:
    """The characters of the basic plane that are letters, numbers, blanks or neither in Unicode 3.2 as today."""
    kind = {"L": 1, "N": 2, "Z": 3}
    out = np.zeros(0x10000, dtype=bool)
    for c in range(0x10000):
        old, new = unicodedata.ucd_3_2_0.category(chr(c)), unicodedata.category(chr(c))
        out[c] = old not in ("Cn", "Cs", "Co") and kind.get(old[0]) == kind.get(new[0])
    return out


@functools.lru_cache(maxsize=4)
def by_rank(name: str):
    """An encoder by rank with the same results as ``tokenizer(name)`` on settled texts; None where that cannot be shown."""
    import json

    import tiktoken

    made = tokenizer(name)
    parts = json.loads(made.to_str())
    pre, model = parts["pre_tokenizer"] or {}, parts["model"]
    plain = parts["normalizer"] is None and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        return None
    added = {t["content"] for t in parts["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    if any([x.id for x in made.model.tokenize(t)] != [i] for t, i in vocabulary.items()):
        return None
    # byte-level tokens write each byte as a printable character
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    merged = {m if isinstance(m, str) else " ".join(m): r for r, m in enumerate(model["merges"])}
    rank = {"".join(m.split(" ")): r for m, r in merged.items()}
    ranks = {bytes(byte[c] for c in t): rank.get(t, -1) for t in vocabulary}
    ordered = {b: n for n, b in enumerate(sorted(ranks, key=lambda b: (ranks[b], b)))}  # single bytes first, then by merge
    return tiktoken.Encoding(name, pat_str=WORDS, mergeable_ranks=ordered, special_tokens={})


def counts(texts: list[str], name: str) -> list[int]:
    """The tokens of whole texts, as the library counts them."""
    encoder, special = by_rank(name), [t.content for t in tokenizer(name).get_added_tokens_decoder().values()]
    out, rest = [0] * len(texts), []
    for i, text in enumerate(texts):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if encoder is None or (len(code) and (code.max() > 0xFFFF or not settled()[code].all())) or any(x in text for x in special):
            rest.append(i)
        else:
            out[i] = len(encoder.encode_ordinary(text))
    for i, made in zip(rest, tokenizer(name).encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = len(made)
    return out


def chunk_spans(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges of the chunks of a text of ``n`` characters; the last one takes a remainder up to the overlap."""
    count = max(1, (n - overlap) // size) if n > size else 1
    return [(max(0, i * size - overlap), n if i == count - 1 else (i + 1) * size + overlap) for i in range(count)]


def chunk_counts(text: str, name: str, before: int, after: int | None) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Tokens of a chunk, and (place, tokens so far) of its word boundaries about both ends.

    ``before``: characters of the chunk in front of its nominal start (the middle of the left overlap); ``after``: those
    up to its nominal end, None for the last chunk. Places are in bytes, relative to the nominal start or end.
    """
    made = tokenizer(name).encode(text, add_special_tokens=False)
    ids, words = np.array(made.ids, dtype=np.int64), made.word_ids
    if not len(ids):
        return 0, [], [], [], []
    word = np.array([-1 if w is None else w for w in words])
    ends = np.cumsum(_token_bytes(name)[ids])
    new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    place = np.r_[0, ends][new]
    safe = (np.arange(len(new)) < len(new) - TAIL_WORDS) & (place <= ends[-1] - TAIL_BYTES)
    left_at = len(text[:before].encode("utf-8", "surrogatepass"))
    left = place <= 2 * left_at if before else np.zeros(len(new), bool)
    out: list[list[int]] = [(place[left] - left_at).tolist(), new[left].tolist(), [], []]
    if after is not None:
        right_at = len(text[:after].encode("utf-8", "surrogatepass"))
        right = safe & (place >= right_at - (ends[-1] - right_at) * 4)
        out[2:] = [(place[right] - right_at).tolist(), new[right].tolist()]
    return len(ids), *out


_CHUNKS = "k1 long, k2 long, chunk int, last boolean, n long, lp array<long>, lt array<long>, rp array<long>, rt array<long>"


def _cut_up(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1"), batch.column("k2")
            for start, texts in text_slices(batch, "text"):
                for i, text in enumerate(texts, start):
                    spans = chunk_spans(len(text), size, overlap)
                    for s in range(0, len(spans), 64):
                        part = spans[s : s + 64]
                        own = [(c, *span, 0 if not c else overlap, None if c == len(spans) - 1 else (c + 1) * size - span[0]) for c, span in enumerate(part, s)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k1[i].as_py()] * len(own), pa.int64()), pa.array([k2[i].as_py()] * len(own), pa.int64()), *(pa.array([o[j] for o in own], pa.int32()) for j in (0, 3, 4)), pa.array([text[o[1] : o[2]] for o in own], pa.string())],
                            ["k1", "k2", "chunk", "before", "after", "text"],
                        )

    return run


def _encode_chunks(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n, lp, lt, rp, rt = chunk_counts(r["text"], name, r["before"], r["after"])
                rows.append({"k1": r["k1"], "k2": r["k2"], "chunk": r["chunk"], "last": r["after"] is None, "n": n, "lp": lp, "lt": lt, "rp": rp, "rt": rt})
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("n", pa.int64()), ("lp", longs), ("lt", longs), ("rp", longs), ("rt", longs)]))

    return run


def _encode_whole(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n for _, texts in text_slices(batch, "text", 400_000) for n in counts(texts, name)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def splice(chunks: DataFrame) -> DataFrame:
    """``k1, k2, n_tokens`` of the texts whose chunks are given; ``n_tokens`` is null where two neighbours share no boundary.

    A text has the tokens of its last chunk, and for each splice those up to it on its left less those on its right.
    """
    order = Window.partitionBy("k1", "k2").orderBy("chunk")
    common = F.array_min(F.array_intersect("rp", "next_p"))
    spliced = chunks.withColumn("next_p", F.lead("lp").over(order)).withColumn("next_t", F.lead("lt").over(order)).withColumn("at", common)
    own = F.element_at("rt", F.array_position("rp", F.col("at")).cast("int"))
    other = F.element_at("next_t", F.array_position("next_p", F.col("at")).cast("int"))
    tokens = F.when(F.col("last"), F.col("n")).when(F.col("at").isNotNull(), own - other)
    spliced = spliced.select("k1", "k2", tokens.alias("t"))
    return spliced.groupBy("k1", "k2").agg(F.when(F.count_if(F.col("t").isNull()) == 0, F.sum("t")).alias("n_tokens"))


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", long_chars: int = 49_152, chunk_chars: int = 24_576, overlap: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row, as the library counts the whole text.

    No begin, end or added tokens, no truncation; special strings within texts as the library's default has them. A null
    text counts as empty (0 bytes, 0 tokens). Rows without an id and repeated rows are counted each; an empty table gives
    no rows; other columns do not matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > long_chars
    whole = rows.where(~is_long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    short = bounded(whole).mapInArrow(_encode_whole(name), "doc_id long, n_bytes long, n_tokens long")
    # Rows alike in id and text have one key and one count.
    long = rows.where(is_long).withColumns({"k1": F.xxhash64("doc_id", F.col("doc_id").isNull()), "k2": F.xxhash64("text")})
    keyed = cut(long.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first(F.octet_length("text").cast("long")).alias("n_bytes"), F.max(F.length("text")).alias("chars"), F.count("*").alias("copies")))
    longest = keyed.agg(F.max("chars")).first()[0] or 0
    todo, done, width = long.select("k1", "k2", "text"), None, overlap
    tasks = max(2, docs.sparkSession.sparkContext.defaultParallelism)
    while longest:
        size = max(chunk_chars, 4 * width)
        pieces = bounded(todo).mapInArrow(_cut_up(size, width), "k1 long, k2 long, chunk int, before int, after int, text string")
        made = pieces.repartition(max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_encode_chunks(name), _CHUNKS)
        found = cut(splice(made.dropDuplicates(["k1", "k2", "chunk"])))
        ready = found.where("n_tokens is not null")
        done = ready if done is None else done.union(ready)
        open_ = found.where("n_tokens is null")
        if open_.isEmpty():
            break
        todo, width = todo.join(open_.select("k1", "k2"), ["k1", "k2"], "left_semi"), 4 * width
    if done is None:
        return short
    spread = keyed.join(done, ["k1", "k2"]).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return short.union(spread.select("doc_id", "n_bytes", "n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)
