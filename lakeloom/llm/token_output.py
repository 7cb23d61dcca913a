"""Token ids of whole texts in compressed binary files, as a data source for Spark's reader and writer.

A file is a run of sections; each holds whole documents, in the order of their ids: a checksummed header and index (ids
and lengths of the documents, and the shares of order 0, from the section's own ids), a table of blocks (ids, bytes,
checksum), and the blocks' digits (``id_coder``). Blocks start with fresh predictions and have their own checksums, so
damage stays in one block and is found. The writer gives each task's file a name of its own and the driver renames them
and writes ``manifest.json`` (files in order, with the numbers of documents and ids) only when all tasks have succeeded,
so a task that runs twice leaves nothing behind.

Texts are encoded by distinct chunk: where no word of the vocabulary's pattern goes over white space, or from a plain letter
or digit on to punctuation, what stands between is encoded by the library once and looked up afterwards.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer, pre_tokenizers

from .common import bounded, give_back, hold, let_go, shared_folder, table
from .id_coder import BLOCK, LANES, Coder, shares
from .token_counts import tokenizer

#: Distinct chunks that a worker keeps, and their bytes (both besides those of one slice of texts, of ``SLICE`` bytes); ids gathered before a section is written.
CACHE_CHUNKS, CACHE_BYTES, SLICE, SECTION = 600_000, 16_000_000, 8_000_000, BLOCK * LANES
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_HEAD = struct.Struct("<4sIQIII")  # magic, documents, ids, blocks, index bytes, checksum
_MAGIC = b"IDS2"


#: The normalizer and the words of the vocabulary whose texts are taken apart further than at white space.
_NORMALIZED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A letter or digit before ASCII punctuation, where a word ends under ``_WORDS`` whatever follows; none of it is in a special string.
_BREAK, _BROKEN = r"""([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-/:;=?@\[-`{}~])""", r"\1 \2"
#: Words of letters that no normal form touches but lower case, and how many are encoded as one text.
_PLAIN, JOINED = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", 1000


class Encoder:
    """The library's ids of whole texts, each distinct chunk encoded once.

    Where the vocabulary's words are known (``_WORDS``), chunks end at white space and before punctuation, elsewhere with
    the text. Chunks of plain letters are encoded many at a time, by the library without the steps that leave them as they are. A word's last token, and
    no other, ends with the model's suffix, which gives each word its ids.
    """

    def __init__(self, name: str):
        self.library = tokenizer(name)
        self.vocabulary = self.library.get_vocab_size()
        self.plain = self._plain()
        self._clear()

    def _plain(self) -> Tokenizer | None:
        """The library for plain lower-case words between blanks; None where that is not shown to be the same."""
        parts = json.loads(self.library.to_str())
        normal, pre, suffix = parts["normalizer"] or {}, (parts["pre_tokenizer"] or {}).get("pretokenizers", []), parts["model"].get("end_of_word_suffix")
        split = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        same = len(pre) == 2 and pre[0] == split and {k: v for k, v in pre[1].items() if k != "trim_offsets"} == level
        added = [t["content"] for t in parts["added_tokens"]]
        if not same or not suffix or normal.get("normalizers") != _NORMALIZED or any(re.search(_BREAK, x) or re.search(_PLAIN, x) for x in added):
            return None
        made = Tokenizer.from_str(self.library.to_str())
        made.normalizer = None
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.vocabulary, dtype=bool)
        self.last[[i for t, i in parts["model"]["vocab"].items() if t.endswith(suffix)]] = True
        return made

    def _clear(self) -> None:
        self.known, self.sizes, self.flat = pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _one_by_one(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = [x.ids for start, stop in _runs(chunks, 400_000) for x in self.library.encode_batch_fast(chunks.slice(start, stop - start).to_pylist(), add_special_tokens=False)]
        return np.array([len(x) for x in made], dtype=np.int64), np.fromiter(itertools.chain.from_iterable(made), dtype=np.uint32)

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = pa.array(np.r_[np.arange(0, len(words), JOINED), len(words)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(bounds, words), pa.scalar(" ", pa.large_string())).to_pylist()
        ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in self.plain.encode_batch_fast(texts, add_special_tokens=False)), dtype=np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        return (np.diff(ends, prepend=0), ids) if len(ends) == len(words) else self._one_by_one(words)

    def _add(self, chunks: pa.Array) -> None:
        plain = pc.match_substring_regex(chunks, _PLAIN) if self.plain else pa.array(np.zeros(len(chunks), dtype=bool))
        for some, encode in ((chunks.filter(plain), self._joined), (chunks.filter(pc.invert(plain)), self._one_by_one)):
            if len(some):
                sizes, ids = encode(some)
                self.known = pa.concat_arrays([self.known, some])
                self.sizes, self.flat = np.r_[self.sizes, sizes], np.r_[self.flat, ids]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts (null: none) one after another, and the number of each text's ids."""
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.plain:
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(whole, pattern=_BREAK, replacement=_BROKEN))
        else:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1), pa.int32()), whole)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        if self.plain:
            chunks = pc.if_else(pc.match_substring_regex(chunks, _PLAIN), pc.utf8_lower(chunks), chunks)
        if len(self.known) > CACHE_CHUNKS or self.known.nbytes > CACHE_BYTES:
            self._clear()
        found = pc.index_in(chunks, value_set=self.known)
        place = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if found.null_count:
            missed = pc.is_null(found)
            rest, at = chunks.filter(missed), len(self.known)
            self._add(rest.unique())
            place[missed.to_numpy(zero_copy_only=False)] = at + pc.index_in(rest, value_set=self.known.slice(at)).to_numpy()
        where = place[coded.indices.to_numpy(zero_copy_only=False)]
        starts, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes[where]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts[where] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][lists.offsets.to_numpy()]
        return ids, np.diff(bounds)


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    hold("token_output", encoder.cache_clear)
    return Encoder(name)


def _runs(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield start, min(stop, len(column))
        start = stop


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of every row in ascending order of ``doc_id``, sorted by range.

    Null ids come first; rows that share an id are ordered by a hash of their text and by their place in the input, so
    that they spread over tasks. Other columns do not matter.
    """
    kinds = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = kinds.withColumns({"k": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    return bounded(keyed).orderBy(F.asc_nulls_first("doc_id"), "k", "row").select("doc_id", "text")


def _encoded(batch: pa.RecordBatch, name: str, tail: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Keys, ids and numbers of ids of the rows of a batch, whose second column holds ids or texts, in slices."""
    column = batch.column(1)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        made = encoder(name)
        for start, stop in _runs(column, SLICE):
            flat, sizes = made.encode(column.slice(start, stop - start))
            flat = np.insert(flat, np.repeat(np.cumsum(sizes), len(tail)), np.tile(tail, len(sizes)))
            yield batch.column(0).slice(start, stop - start).to_pylist(), flat, sizes + len(tail)
    else:
        raw = [b"" if x is None else x for x in column.to_pylist()]
        yield batch.column(0).to_pylist(), np.frombuffer(b"".join(raw), dtype="<u4"), np.array([len(x) // 4 for x in raw], dtype=np.int64)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _section(coder: Coder, keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one section."""
    if len(ids) and ids.max() >= coder.vocabulary:
        raise ValueError("an id is outside the vocabulary")
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    share = shares(np.bincount(ids, minlength=coder.vocabulary))
    made = coder.encode(blocks, share)
    null, held = np.array([k is None for k in keys], dtype=bool), share > 0
    parts = [np.array([k or 0 for k in keys], dtype="<i8"), np.packbits(null), np.array(lengths, dtype="<i8"), np.packbits(held), share[held].astype("<u4")]
    index = zlib.compress(b"".join(p.tobytes() for p in parts))
    entries = np.array([(len(b), len(m), zlib.crc32(m)) for b, m in zip(blocks, made, strict=True)], dtype="<u4").reshape(-1, 3).tobytes()
    head = _HEAD.pack(_MAGIC, len(keys), len(ids), len(blocks), len(index), zlib.crc32(index + entries))
    return b"".join([head, index, entries, *made])


def _sections(file, coder: Coder, name: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Keys, lengths and ids of each section of a file; raises where a checksum differs."""
    while head := file.read(_HEAD.size):
        magic, n_docs, n_ids, n_blocks, n_index, check = _HEAD.unpack(head)
        index, entries = file.read(n_index), file.read(12 * n_blocks)
        if magic != _MAGIC or zlib.crc32(index + entries) != check:
            raise ValueError(f"a section of {name} is damaged")
        plain = zlib.decompress(index)
        at = np.cumsum([0, 8 * n_docs, -(-n_docs // 8), 8 * n_docs, -(-coder.vocabulary // 8)]).tolist()
        keys, null = np.frombuffer(plain, "<i8", n_docs).tolist(), np.unpackbits(np.frombuffer(plain, np.uint8, at[2] - at[1], at[1]), count=n_docs)
        lengths, held = np.frombuffer(plain, "<i8", n_docs, at[2]), np.unpackbits(np.frombuffer(plain, np.uint8, at[4] - at[3], at[3]), count=coder.vocabulary)
        share = np.zeros(coder.vocabulary, dtype=np.int64)
        share[held > 0] = np.frombuffer(plain, "<u4", offset=at[4])
        rows = np.frombuffer(entries, "<u4").reshape(-1, 3).astype(np.int64)
        payloads = [file.read(int(n)) for n in rows[:, 1]]
        if bad := [i for i, p in enumerate(payloads) if zlib.crc32(p) != rows[i, 2]]:
            raise ValueError(f"block {bad[0]} of a section of {name} is damaged")
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *coder.decode(payloads, rows[:, 0], share)])
        if len(ids) != n_ids or lengths.sum() != n_ids:
            raise ValueError(f"a section of {name} is incomplete")
        yield [None if x else k for k, x in zip(keys, null, strict=True)], lengths, ids


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    docs: int
    ids: int


@dataclass
class IdFile(InputPartition):
    name: str
    start: int


@functools.lru_cache(maxsize=1)
def _coder(vocabulary: int) -> Coder:
    hold("token_output_coder", _coder.cache_clear)
    return Coder(vocabulary)


class IdWriter(DataSourceArrowWriter):
    """Rows ``doc_id, text`` or ``doc_id, ids`` in the order of their partitions."""

    def __init__(self, path: str, vocabulary: int, name: str, end_id: int | None):
        self.path, self.vocabulary, self.name, self.end_id = path, vocabulary, name, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = _place(self.path)
        part = TaskContext.get().partitionId()
        name, tail = f"_{uuid.uuid4().hex}", np.array([] if self.end_id is None else [self.end_id], dtype=np.uint32)
        coder, keys, lengths, held, size, docs, total = _coder(self.vocabulary), [], [], [], 0, 0, 0
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{name}") as out:
            for batch in iterator:
                for some, ids, sizes in _encoded(batch, self.name, tail):
                    keys += some
                    lengths += sizes.tolist()
                    held.append(ids.astype(np.uint32, copy=False))
                    size += len(ids)
                    if size >= SECTION:
                        out.write(_section(coder, keys, lengths, np.concatenate(held)))
                        docs, total, keys, lengths, held, size = docs + len(keys), total + size, [], [], [], 0
            if keys:
                out.write(_section(coder, keys, lengths, np.concatenate(held)))
        give_back()
        return Written(part, name, docs + len(keys), total + size)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _place(self.path)
        rows = []
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            if m.docs:
                files.move(f"{at}/{m.name}", f"{at}/part-{m.part:05d}.ids")
                rows.append({"file": f"part-{m.part:05d}.ids", "docs": m.docs, "ids": m.ids})
            else:
                files.delete_file(f"{at}/{m.name}")
        with files.open_output_stream(f"{at}/manifest.json") as out:
            out.write(json.dumps({"vocabulary": self.vocabulary, "files": rows}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, at = _place(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{at}/{m.name}")


class IdReader(DataSourceReader):
    """A file to a partition; each section is decoded by itself."""

    def __init__(self, path: str):
        self.path = path
        files, at = _place(path)
        with files.open_input_stream(f"{at}/manifest.json") as file:
            self.manifest = json.loads(file.read())

    def partitions(self) -> list[InputPartition]:
        out, start = [], 0
        for f in self.manifest["files"]:
            out.append(IdFile(f["file"], start))
            start += f["ids"]
        return out

    def read(self, partition: IdFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        files, at = _place(self.path)
        let_go("token_output_coder")  # the writer's encoder, if this worker has one
        start, coder = partition.start, _coder(self.manifest["vocabulary"])
        with files.open_input_stream(f"{at}/{partition.name}") as file:
            for keys, lengths, ids in _sections(file, coder, partition.name):
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                for i in range(0, len(keys), 1000):
                    some, end = slice(i, i + 1000), ends[i : i + 1000]
                    first = end - lengths[some]
                    values = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), pa.array(start + first), pa.array(lengths[some]), pa.array(values, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                start += len(ids)


class TokenIdSource(DataSource):
    """``spark.read.format("token_ids").load(path)``, and ``write`` of ``doc_id long, ids binary`` or ``doc_id long, text string``.

    Options of the writer: ``vocabulary`` (all ids are below it), and for texts ``tokenizer`` and ``endId``.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IdReader:
        return IdReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> IdWriter:
        end = self.options.get("endId", "")
        return IdWriter(self.options["path"], int(self.options.get("vocabulary", 1 << 16)), self.options.get("tokenizer", ""), int(end) if end else None)


def write_ids(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts and writes them under ``path``, a new folder, in ascending order of ``doc_id`` (see ``in_order``).

    The ids are the library's for the whole text, without special tokens added, and ``end_id`` after them; a null or empty
    text has the end id alone. An empty table gives no files but the manifest.
    """
    docs.sparkSession.dataSource.register(TokenIdSource)
    options = {"vocabulary": max(tokenizer(name).get_vocab_size(), (end_id or 0) + 1), "tokenizer": name, "endId": "" if end_id is None else end_id}
    in_order(docs, id_col, text_col).write.format("token_ids").options(**options).mode("append").save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files under ``path``; ``start`` counts the ids of all documents before."""
    spark.dataSource.register(TokenIdSource)
    return spark.read.format("token_ids").load(path)


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
