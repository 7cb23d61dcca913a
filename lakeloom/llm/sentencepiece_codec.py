"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is cut into marked words (runs of the space mark with what follows them, less a full stop and the like at the
end; no piece reaches over such a border).
The distinct words of a run of texts are sorted, which lays them out as the depth-first order of their trie, and a
forward pass walks down it: the scores of a word's prefixes stay on a stack and the next word goes on from the longest
prefix that the two share. Each word is so encoded once, and each shared prefix once.

The forward pass keeps for each prefix the last piece of its best path. Two kinds of model are read:

``unigram``: a path's score is the sum of its pieces' scores, and the best one stays.

``bpe``: the segmentation that merging by rank gives is the only path whose neighbours are all *stable*, that is, merging
the text of the two pieces anew gives the same two pieces. So the score of a step is 0 for a stable pair and minus
infinity for any other; one path per prefix is left. Stability is decided by merging the pair, once for each pair.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, hold, table, text_slices, tidy

MARK = "▁"
PUNCTUATION = ".,;:!?"
#: Words kept by a worker, about 270 bytes each.
CACHE_WORDS = 300_000
#: And its characters; words longer than the second are not kept.
CACHE_CHARS, KEEP_CHARS = 6_000_000, 64


class Codec:
    """Encodes and decodes with the pieces and scores of a model file (name in the public collection, or path)."""

    def __init__(self, name: str, kind: str = "bpe"):
        import os

        import sentencepiece

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        model = sentencepiece.SentencePieceProcessor(model_file=name)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        skip = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.setup(self.pieces, [model.get_score(i) for i in range(n)], skip, {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}, model.unk_id(), kind)

    def setup(self, pieces: list[str], scores: list[float], skip: list[bool], bytes_: dict[int, int], unknown: int, kind: str) -> None:
        self.pieces, self.scores, self.unknown, self.kind = pieces, scores, unknown, kind
        self.ids = {p: i for i, p in enumerate(pieces) if not skip[i]}
        self.byte_ids = bytes_ if len(bytes_) == 256 else {}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((scores[i] for i in self.ids.values()), default=0.0) - 10
        # lengths of the pieces that end in two given characters, longest first, and one for a single character
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], {1}).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.texts = [chr(self.id_bytes[i]) if self.id_bytes.get(i, 128) < 128 else p for i, p in enumerate(pieces)]
        self.high = {i for i, b in self.id_bytes.items() if b >= 128}
        self.stable: dict[int, bool] = {}
        # where words can be cut: before a mark, and between a letter or digit and a sign that no piece has after one
        cut = "".join(p for p in PUNCTUATION if not any(a.isalnum() and b == p for x in self.ids for a, b in zip(x, x[1:])))
        rest = f"[^{MARK}\\n\\t{cut}]*" + (f"(?:(?<![^\\W_])[{cut}][^{MARK}\\n\\t{cut}]*)*" if cut else "")
        self.words = re.compile(f"(?:{MARK}+|[^{MARK}\\n\\t]){rest}|\\n|\\t").findall
        self.edges: dict[str, tuple[float, list, list] | None] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.again: set[str] = set()
        self.held = 0  # characters of the words in known

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Merging by rank, as defined: the best-scored pair first, the leftmost of equals; stops at ``least`` parts."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, piece: str) -> tuple[float, list, list] | None:
        """When a piece is complete as merging goes on, and what stands at its left and right edge until when.

        Time is the worst rank merged so far. An edge is a list of (part, time it is there, time it is merged away).
        None for a piece that merging its own text does not give.
        """
        if piece in self.edges:
            return self.edges[piece]
        if len(piece) == 1:
            made = (-np.inf, [(piece, -np.inf, np.inf)], [(piece, -np.inf, np.inf)])
        else:
            made, parts = None, self.merge(piece, 2)
            if len(parts) == 2 and piece in self.ids and (a := self._edges(parts[0])) and (b := self._edges(parts[1])):
                time = max(-self.scores[self.ids[piece]], a[0], b[0])
                whole = (piece, time, np.inf)
                left, right = ([whole, (e[0][0], e[0][1], time), *e[1:]] for e in (a[1], b[2]))
                made = (time, left, right)
        self.edges[piece] = made
        return made

    def _stable(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when their text is merged (left: negative at the start of a word).

        They do unless, at some time, parts at the border would merge with each other; where times are equal, merging decides.
        """
        b = self._edges(self.pieces[right])
        if left < 0 or b is None:
            return b is not None
        a, ids, scores = self._edges(self.pieces[left]), self.ids, self.scores
        doubt = False
        for x, there, gone in a[2]:
            for y, there_too, gone_too in b[1]:
                k = ids.get(x + y)
                if k is not None:
                    time = max(-scores[k], there, there_too)
                    if time < gone and time < gone_too:
                        return False
                    doubt = doubt or (time <= gone and time <= gone_too)
        return not doubt or self.merge(self.pieces[left] + self.pieces[right]) == [self.pieces[left], self.pieces[right]]

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct word."""
        step = self._merge_step if self.kind == "bpe" else self._score_step
        out: dict[str, tuple[int, ...]] = {}
        # for each prefix of the word at hand: the last piece of its best path, where that begins, and the path's score
        last, begin, score = [-1], [0], [0.0]
        before = ""
        for word in sorted(set(words)):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :], score[shared + 1 :]
            step(word, shared + 1, last, begin, score)
            before = word
            path, end, plain = [], len(word), True
            while end:
                piece, s = last[end], begin[end]
                path.append(piece)
                plain = plain and piece >= 0
                end = s
            path.reverse()
            out[word] = tuple(path) if plain else self._with_unknown(word, path)
        return out

    def _with_unknown(self, word: str, path: list[int]) -> tuple[int, ...]:
        """A path in which unknown characters are their bytes, or the unknown id for a run of them."""
        got: list[int] = []
        at = 0
        for piece in path:
            if piece >= 0:
                got.append(piece)
                at += len(self.pieces[piece])
                continue
            if self.byte_ids:
                got += [self.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass")]
            elif not got or got[-1] != self.unknown:
                got.append(self.unknown)
            at += 1
        return tuple(got)

    def _merge_step(self, word: str, first: int, last: list[int], begin: list[int], score: list[float]) -> None:
        """Goes on over the prefixes from length ``first``, for ranks: the step to a prefix is the one whose pieces are stable."""
        get, lengths, one, stable = self.ids.get, self.lengths.get, (1,), self.stable
        known, n = stable.get, len(self.pieces)
        for end in range(first, len(word) + 1):
            found, start = -2, end - 1  # an unknown character never merges: what follows it starts anew
            for length in lengths(word[end - 2 : end], one) if end > 1 else one:
                if (s := end - length) < 0 or (piece := get(word[s:end])) is None:
                    continue
                left = last[s] if last[s] >= 0 else -1
                fits = known(key := left * n + piece)
                if fits is None:
                    if len(stable) > 500_000:
                        stable.clear()
                    fits = stable[key] = self._stable(left, piece)
                if fits:
                    found, start = piece, s
                    break
            last.append(found)
            begin.append(start)
            score.append(0.0)

    def _score_step(self, word: str, first: int, last: list[int], begin: list[int], score: list[float]) -> None:
        """Goes on over the prefixes from length ``first``, for scores: the best sum stays, the longest piece of equals."""
        ids, scores = self.ids, self.scores
        for end in range(first, len(word) + 1):
            found, start, best = -2, end - 1, score[end - 1] + self.least
            for s in range(max(0, end - self.longest), end):
                piece = ids.get(word[s:end])
                if piece is not None and (found == -2 or score[s] + scores[piece] > best):
                    found, start, best = piece, s, score[s] + scores[piece]
            last.append(found)
            begin.append(start)
            score.append(best)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of whole texts, and their numbers of marked words.

        Words seen lately are not encoded again, but for very long ones. When there are too many, in number or in
        characters, those stay that have come more than once.
        """
        cut = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set(chain.from_iterable(cut))
        fresh = distinct.difference(self.known)
        self.again.update(distinct.difference(fresh))
        if len(self.known) + len(fresh) > CACHE_WORDS or self.held > CACHE_CHARS:
            few = len(self.again) < CACHE_WORDS // 2 and sum(map(len, self.again)) < CACHE_CHARS // 2
            self.known = {w: self.known[w] for w in self.again} if few else {}
            self.held, self.again = sum(map(len, self.known)), set()
            fresh = distinct.difference(self.known)
        made = self.encode_words(fresh)
        passing = {w: made.pop(w) for w in [w for w in made if len(w) > KEEP_CHARS]}  # for these texts only
        self.held += sum(map(len, made))
        self.known.update(made)
        lasting = self.known
        known = (lambda w: lasting[w] if w in lasting else passing[w]) if passing else lasting.__getitem__
        return [np.fromiter(chain.from_iterable(map(known, words)), dtype=np.int32) for words in cut], [len(words) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the mark in front is the one that encoding adds."""
        ids, texts = list(ids), self.texts
        if self.high.isdisjoint(ids):
            text = "".join([texts[i] for i in ids])
        else:  # bytes of one character stand together
            out: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.id_bytes:
                    run.append(self.id_bytes[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(texts[i])
            text = "".join([*out, run.decode("utf-8", "replace")])
        return text[text.startswith(MARK) :].replace(MARK, " ")


@functools.lru_cache(maxsize=2)
def codec(name: str, kind: str = "bpe") -> Codec:
    hold("sentencepiece", codec.cache_clear)
    return Codec(name, kind)


_SCHEMA = "doc_id long, n_words long, n_pieces long, pieces array<int>, round_trip boolean"


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_pieces, pieces, round_trip`` for every row: the ids of its whole text.

    ``n_words`` counts the words that are encoded by themselves (marked words, cut at signs, tabs and new lines); ``round_trip`` says whether decoding gives the text back (a mark that stands in the
    text itself comes back as a space, as the model has it). A null or empty text has no pieces; rows without an id and
    repeated rows are encoded each; an empty table gives no rows; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(name, kind)
        for batch in batches:
            for start, texts in text_slices(batch, "text", 3_000_000):
                ids, words = made.encode(texts)
                sizes = [len(x) for x in ids]
                right = [made.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), flat, pa.array(right, pa.bool_())], ["doc_id", "n_words", "n_pieces", "pieces", "round_trip"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run, "sentencepiece"), _SCHEMA)


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe", id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """``doc_id, text`` from lists of ids; null for a null list or one that holds a null or an unknown id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(name, kind)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [made.decode(x) if x is not None and all(i is not None and 0 <= i < len(made.pieces) for i in x) else None for x in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return bounded(encoded).select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).cast("array<int>").alias("pieces")).mapInArrow(tidy(run, "sentencepiece"), "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return encode(table(spark, sf_dir, "documents"))
