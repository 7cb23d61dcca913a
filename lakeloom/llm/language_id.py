"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order four over lower-cased letters, all else being one space. A gram of up to four
characters packs into one 64-bit key (16 bits each; astral letters fold into the private area), and a model is a few
sorted key arrays with log-probabilities and back-off weights beside them. A text's language is the one with the lowest
cross-entropy per character.

Gram counts come from every training row: tasks count within their rows, Spark adds the counts up and makes the models'
tables from all of them (lower orders count the distinct characters in front). A model holds every gram that was seen, so
it grows with the corpus's distinct grams. Tables of up to ``broadcast_grams`` rows are sent to the tasks as arrays;
larger ones stay tables, and the grams of the distinct texts are joined with them. Rejection is calibrated on every
distinct training text, each judged by models of the half of the texts that it is not in: a text goes whose cross-entropy
exceeds, with regard to its length, what its language's own texts show. (With ``calibration_rows``, a sample calibrates
that the models do not learn from.)
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import of_columns
from .common import bounded, cut, keep_rows, table, text_slices, tidy

ORDER, BEGIN, SPACE = 4, 1, 32
#: Lengths beyond this do not make a rejection stricter.
CALIBRATED_LENGTH = 256
#: A text is rejected beyond this many times the calibration quantile.
MARGIN = 1.25
#: The quantile is this at least, for a few calibration texts tell little about the rare ones.
LEAST_EXCESS = 4.0
PIECE = 500_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts, in a row, and the text of each; three begin marks stand before each text."""
    marked = ["\x01\x01\x01" + t.lower().replace("\x01", " ") for t in texts]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(m) for m in marked])
    if len(code) and code.max() > 0xFFFF:
        high = code > 0xFFFF
        plain = np.where(high, SPACE, code)
        plain = np.where(_letters()[plain] | (plain == BEGIN), plain, SPACE)  # no letter has a code of the private area
        values, at = np.unique(code[high], return_inverse=True)
        plain[high] = np.array([0xE000 + (c & 0xFFF) if chr(c).isalpha() else SPACE for c in values.tolist()], dtype=np.uint32)[at]
        code = plain.astype(np.uint16)
    else:
        code = np.where(_letters()[code] | (code == BEGIN), code, SPACE).astype(np.uint16)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != SPACE) | (code[:-1] != SPACE)
    return code[keep], owner[keep]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed four-gram that ends at each character, the character's text, and whether it is a letter."""
    code, owner = characters(texts)
    wide = code.astype(np.uint64)
    packed = wide.copy()
    for k in range(1, ORDER):
        packed[k:] |= wide[:-k] << np.uint64(16 * k)
    own = code != BEGIN
    return packed[own], owner[own], code[own] != SPACE


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts in pieces that fit memory, and the text of each piece."""
    parts = [(t[s : s + PIECE], i) for i, t in enumerate(texts) for s in range(0, max(1, len(t)), PIECE)]
    return [p for p, _ in parts], np.array([i for _, i in parts], dtype=np.int64)


class Model:
    """One language: arrays of sorted keys, from order four down to one."""

    def __init__(self, grams_: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]], alphabet: int):
        self.keys, self.logp = ([x[i] for x in grams_] for i in (0, 1))
        self.contexts, self.backoff = ([x[i] for x in contexts] for i in (0, 1))
        self.unseen = float(-np.log(alphabet))

    def score(self, packed: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each packed four-gram after the others."""
        out = np.zeros(len(packed))
        open_ = np.arange(len(packed))
        for level in range(ORDER):
            n = ORDER - level
            key = packed[open_] & np.uint64((1 << 16 * n) - 1) if n < 4 else packed[open_]
            keys = self.keys[level]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            out[open_[hit]] += self.logp[level][at[hit]]
            open_, context = open_[~hit], key[~hit] >> np.uint64(16)
            if not len(open_):
                return out
            known = self.contexts[level]
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            seen = known[at] == context
            out[open_[seen]] += self.backoff[level][at[seen]]
        out[open_] += self.unseen
        return out


def entropies(texts: list[str], models: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text (rows) in each model, its characters, and its letters."""
    total = np.zeros((len(texts), len(models)))
    chars, letters = np.zeros(len(texts)), np.zeros(len(texts))
    parts, whole = _pieces(texts)
    s = 0
    while s < len(parts):
        e, size = s + 1, len(parts[s])
        while e < len(parts) and size + len(parts[e]) <= PIECE:
            size, e = size + len(parts[e]), e + 1
        packed, owner, letter = grams(parts[s:e])
        owner = whole[s:e][owner] if len(owner) else owner.astype(np.int64)
        distinct, at = np.unique(packed, return_inverse=True)
        for k, model in enumerate(models):
            total[:, k] -= np.bincount(owner, model.score(distinct)[at], minlength=len(texts))
        chars += np.bincount(owner, minlength=len(texts))
        letters += np.bincount(owner, letter, minlength=len(texts))
        s = e
    return total / np.maximum(chars, 1)[:, None], chars, letters


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``text, lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in text_slices(batch, "text", 1_000_000):
                by: dict[str, list[str]] = {}
                for i, text in enumerate(texts, start):
                    by.setdefault(langs[i], []).append(text)
                for lang, own in by.items():
                    parts, _ = _pieces(own)
                    for s in range(0, len(parts), 4096):
                        for piece in [parts[s : s + 4096]] if sum(map(len, parts[s : s + 4096])) <= 4 * PIECE else [[p] for p in parts[s : s + 4096]]:
                            mine = held.setdefault(lang, [])
                            mine.append(np.unique(grams(piece)[0], return_counts=True))
                            if sum(len(k) for k, _ in mine) > 600_000:
                                mine[:] = [merged(mine)]
        for lang, mine in held.items():
            keys, n = merged(mine)
            for s in range(0, len(keys), 100_000):
                part = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part]), pa.string()), pa.array(keys[part].view(np.int64)), pa.array(n[part])], ["lang", "gram", "n"])

    return bounded(rows).select("text", "lang").mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(n: int) -> Column:
    """The last ``n`` characters of a packed gram."""
    return F.col("gram") if n == ORDER else F.col("gram").bitwiseAND((1 << 16 * n) - 1)


def model_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``lang, level, gram, logp`` and ``lang, level, gram, backoff`` (contexts) of ``lang, gram, n``, and the alphabet's size.

    Level n holds grams of n characters. A lower order counts the distinct characters in front of its grams; p is the
    discounted share among its context's counts, and what discounting leaves goes to the shorter gram.
    """
    alphabet = counts.select(_tail(1)).distinct().count() + 1
    levels = [counts.select("lang", "gram", F.col("n").cast("double").alias("n"))]
    for n in range(ORDER - 1, 0, -1):
        levels.insert(0, cut(levels[0].groupBy("lang", _tail(n).alias("gram")).agg(F.count("*").cast("double").alias("n"))))
    below, grams_, contexts = None, [], []
    for n, level in enumerate(levels, 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = level.groupBy("lang").agg(F.when(once == 0, 0.5).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / (once + 2 * twice)))).alias("discount"))
        context = level.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        context = cut(context.join(F.broadcast(discount), "lang").withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total")))  # a row for each language
        p = level.withColumn("context", F.shiftrightunsigned("gram", 16)).join(context, ["lang", "context"])
        if below is None:
            p = p.withColumn("lower", F.lit(1.0 / alphabet))
        else:  # the shorter gram is there, as it was counted from the longer ones
            p = p.withColumn("tail", _tail(n - 1)).join(below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        below = cut(p.select("lang", "gram", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")).alias("p")))
        grams_.append(below.select("lang", F.lit(n).alias("level"), "gram", F.log("p").cast("float").alias("logp")))
        contexts.append(context.select("lang", F.lit(n).alias("level"), F.col("context").alias("gram"), F.log("weight").cast("float").alias("backoff")))
    return functools.reduce(DataFrame.union, grams_), functools.reduce(DataFrame.union, contexts), alphabet


@dataclass
class Fitted:
    """Languages in order, their tables, arrays of these where they are small enough, and the limits of calibration.

    ``limits`` has, for each language, the mean cross-entropy and how far above it a text may be.
    """

    languages: list[str]
    grams: DataFrame
    contexts: DataFrame
    alphabet: int
    models: list[Model] | None
    limits: np.ndarray | None = None


def _arrays(languages: list[str], grams_: DataFrame, contexts: DataFrame, alphabet: int) -> list[Model]:
    def parts(of: DataFrame, value: str) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        got = of.toArrow()
        code = got.column("lang").combine_chunks().dictionary_encode()
        place = np.array([languages.index(x) for x in code.dictionary.to_pylist()])[code.indices.to_numpy()] * ORDER + got.column("level").to_numpy() - 1
        key = got.column("gram").to_numpy().view(np.uint64)
        order = np.lexsort((key, place))
        ends = np.searchsorted(place[order], np.arange(len(languages) * ORDER + 1))
        key, values = key[order], got.column(value).to_numpy()[order]
        return {(x, n): (key[s:e], values[s:e]) for i, (s, e) in enumerate(zip(ends, ends[1:])) for x, n in [(languages[i // ORDER], i % ORDER + 1)]}

    keys, weights = parts(grams_, "logp"), parts(contexts, "backoff")
    return [Model([keys[x, n] for n in range(ORDER, 0, -1)], [weights[x, n] for n in range(ORDER, 0, -1)], alphabet) for x in languages]


def _fitted(counts: DataFrame, tables: tuple[DataFrame, DataFrame, int], broadcast_grams: int) -> Fitted | None:
    """Models of the languages in ``counts``, from their tables; None where there is none."""
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    grams_, contexts, alphabet = tables
    small = grams_.count() + contexts.count() <= broadcast_grams
    return Fitted(languages, grams_, contexts, alphabet, _arrays(languages, grams_, contexts, alphabet) if small else None)


def fit(rows: DataFrame, calibration_rows: int | None = 4000, broadcast_grams: int = 8_000_000) -> Fitted | None:
    """Models of ``text, lang`` rows, and the limits of acceptance; None where there is nothing to learn from.

    With ``calibration_rows`` None, the models learn from all rows and all distinct texts calibrate (``_crossed``).
    Otherwise a sample does, of distinct texts, the first by a hash: ``calibration_rows`` of them and a tenth at most. The
    models learn from all other rows, so that calibration texts are new to them. The excess over a language's mean counts
    times the root of the text's length; its limit comes from all languages together.
    """
    rows = rows.withColumn("h", F.xxhash64("text", "lang", F.lit(5)))
    if calibration_rows is None:
        return _crossed(rows, broadcast_grams)
    hashes = rows.select("h").distinct()
    wanted = min(calibration_rows, hashes.count() // 10)
    chosen = F.broadcast(cut(hashes.orderBy("h").limit(wanted)))  # calibration_rows at most
    counts = cut(gram_counts(rows.join(chosen, "h", "left_anti")))
    if counts.isEmpty():
        return None
    fitted = _fitted(counts, model_tables(counts), broadcast_grams)
    sample = rows.join(chosen, "h", "left_semi").dropDuplicates(["h"]).select(F.col("h").alias("doc_id"), "lang", "text")
    fitted.limits = _limits(judged(sample, fitted), fitted.languages)
    return fitted


def _crossed(rows: DataFrame, broadcast_grams: int) -> Fitted | None:
    """Models of all rows of ``text, lang, h``, and limits from all distinct texts.

    Texts fall into halves by a hash, so that all copies of one are in the same half, and each half is judged by models of
    the other one. The grams are counted once; the tables of the three sets of models are made together.
    """
    half = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(2))
    counts = cut(gram_counts(rows.select("text", F.concat(half.cast("string"), "lang").alias("lang"))))
    mark, lang = F.col("lang").substr(1, 1), F.expr("substring(lang, 2)")
    every = counts.groupBy(F.concat(F.lit("a"), lang).alias("lang"), "gram").agg(F.sum("n").alias("n"))
    counts = cut(every.union(counts.select(F.concat(F.when(mark == "0", "1").otherwise("0"), lang).alias("lang"), "gram", "n")))
    if counts.isEmpty():
        return None
    grams_, contexts, alphabet = model_tables(counts)
    of = lambda df, judge: df.where(mark == judge).withColumn("lang", lang)
    make = lambda judge: _fitted(of(counts, judge), (of(grams_, judge), of(contexts, judge), alphabet), broadcast_grams)
    seen = []
    for k in ("0", "1"):  # one after the other, so that the driver holds the arrays of one
        if (other := make(k)) is not None:
            own = rows.where(half == int(k)).select(F.col("h").alias("doc_id"), "lang", "text")
            seen.append(cut(judged(own, other).select("doc_id", "lang", "best", "entropy", "chars")))
    fitted = make("a")
    fitted.limits = _limits(functools.reduce(DataFrame.union, seen), fitted.languages)
    return fitted


def _limits(seen: DataFrame, languages: list[str]) -> np.ndarray:
    """The limits of ``languages`` from the distinct texts among ``judged`` ones; ``doc_id`` is a hash of text and language."""
    own = seen.where("lang = best and chars > 0").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("entropy").alias("entropy"), F.min("chars").alias("chars"))
    own = cut(own.select("lang", "entropy", F.least("chars", F.lit(CALIBRATED_LENGTH)).cast("double").alias("length")))
    means = {r["lang"]: r["mean"] for r in own.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("length")) / F.sum("length")).alias("mean")).collect()}
    limits = np.full((len(languages), 2), np.inf)
    limits[:, 0] = [means.get(x, np.inf) for x in languages]  # nothing to calibrate by: accept
    if means:
        mean = F.create_map(*(F.lit(v) for x in means.items() for v in x))[F.col("lang")]
        excess = of_columns(own, {"excess": (F.col("entropy") - mean) * F.sqrt("length")}, (0.999,))["excess"][0]
        limits[:, 1] = MARGIN * max(LEAST_EXCESS, excess)
    return limits


def decide(ce: np.ndarray, chars: np.ndarray, letters: np.ndarray, limits: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Best model, its cross-entropy, certainty, and whether calibration accepts, of each row of cross-entropies."""
    best, least = ce.argmin(axis=1), ce.min(axis=1)
    # 1 over the sum of likelihood ratios against the best, a text counting as 50 characters at most
    sure = 1 / np.exp(-(ce - least[:, None]) * np.minimum(chars, 50)[:, None]).sum(axis=1)
    accepted = letters > 0
    if limits is not None:
        accepted &= (least - limits[best, 0]) * np.sqrt(np.minimum(chars, CALIBRATED_LENGTH)) <= limits[best, 1]
    return best, least, sure, accepted


_JUDGED = "best string, entropy double, sure double, chars long, letters long, accepted boolean"


def _verdict(fitted_languages: list[str], limits: np.ndarray | None, ce: np.ndarray, chars: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
    best, least, sure, accepted = decide(ce, chars, letters, limits)
    return [pa.array([fitted_languages[b] for b in best], pa.string()), pa.array(least), pa.array(sure), pa.array(chars.astype(np.int64)), pa.array(letters.astype(np.int64)), pa.array(accepted)]


def judged(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """``doc_id, lang`` and ``best, entropy, sure, chars, letters, accepted`` from rows of ``doc_id, lang, text``."""
    languages, limits = fitted.languages, fitted.limits
    names = [c.split()[0] for c in _JUDGED.split(", ")]
    if fitted.models is None:
        digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        return rows.select("doc_id", "lang", digest.alias("digest")).join(_judged_by_join(rows, fitted), "digest").select("doc_id", "lang", *names)
    shared = rows.sparkSession.sparkContext.broadcast(fitted.models)  # broadcast_grams rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text", 1_000_000):
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *_verdict(languages, limits, *entropies(texts, shared.value))], ["doc_id", "lang", *names])

    return bounded(rows).select("doc_id", "lang", "text").mapInArrow(tidy(run), f"doc_id long, lang string, {_JUDGED}")


def _judged_by_join(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """``digest`` (SHA-256 of the text) and the columns of ``judged``, for each distinct text, by joins of grams."""
    languages, limits = fitted.languages, fitted.limits
    names = [c.split()[0] for c in _JUDGED.split(", ")]

    def text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text", 1_000_000):
                digests = batch.column("digest").slice(start, len(texts))
                for i, text in enumerate(texts):
                    for piece in _pieces([text])[0]:
                        packed, _, letter = grams([piece])
                        key, n = np.unique(packed, return_counts=True)
                        letters = np.bincount(np.searchsorted(key, packed), letter, minlength=len(key)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([digests[i].as_py()] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(letters)], ["digest", "gram", "n", "letters"])

    texts = rows.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # dropping repeats after the grams are made moves no text
    found = cut(bounded(texts).mapInArrow(tidy(text_grams), "digest string, gram long, n long, letters long").groupBy("digest", "gram").agg(F.max("n").alias("n"), F.max("letters").alias("letters")))
    known = found.select("gram").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, languages))))
    value, open_ = F.lit(None).cast("double"), F.lit(0.0)
    for n in range(ORDER, 0, -1):
        own = fitted.grams.where(F.col("level") == n).select("lang", F.col("gram").alias(f"g{n}"), F.col("logp").cast("double").alias(f"p{n}"))
        context = fitted.contexts.where(F.col("level") == n).select("lang", F.col("gram").alias(f"c{n}"), F.col("backoff").cast("double").alias(f"b{n}"))
        known = known.withColumn(f"g{n}", _tail(n)).withColumn(f"c{n}", F.shiftrightunsigned(_tail(n), 16)).join(own, ["lang", f"g{n}"], "left").join(context, ["lang", f"c{n}"], "left")
        value = F.coalesce(value, open_ + F.col(f"p{n}"))
        open_ = open_ + F.coalesce(F.col(f"b{n}"), F.lit(0.0))
    value = F.coalesce(value, open_ - float(np.log(fitted.alphabet)))
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    scores = cut(known.select("gram", place.alias("place"), value.alias("logp")).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("place", "logp"))).alias("s")))  # a value for each language
    sums = [F.sum(-F.col("n") * F.col("s")[k]["logp"]).alias(f"s{k}") for k in range(len(languages))]
    total = found.join(scores, "gram").groupBy("digest").agg(F.sum("n").alias("chars"), F.sum("letters").alias("letters"), *sums)
    whole = texts.select("digest").distinct().join(total, "digest", "left").na.fill(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, letters, *ce = (batch.column(c).to_numpy().astype(float) for c in ("chars", "letters", *(f"s{k}" for k in range(len(languages)))))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *_verdict(languages, limits, np.stack(ce, axis=1) / np.maximum(chars, 1)[:, None], chars, letters)], ["digest", *names])

    return bounded(whole).mapInArrow(tidy(run), f"digest string, {_JUDGED}")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id's text leaves 2 by four (also rows without id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def teachable(rows: DataFrame) -> DataFrame:
    """``text, lang`` of the rows to learn from."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    return known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def identify(docs: DataFrame, training: DataFrame | None = None, broadcast_grams: int = 8_000_000, calibration_rows: int | None = 4000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, accepted`` for every row of ``docs``.

    Models are learned from the rows of ``training`` (else ``docs``) that have a language and are not held out; for
    ``calibration_rows`` (None: all texts calibrate, and none is left out of the models) see ``fit``. A text
    that is null or has no letter is ``und`` with score 0, as is every text when there is nothing to learn from; other
    texts get the learned language of lowest cross-entropy, and ``accepted`` says whether it is within calibration.
    A row does not depend on the rows around it. Ties go to the first language by name; repeated rows and rows without
    id get a row each; an empty table gives no rows; other columns do not matter.
    """
    fitted = fit(teachable(docs if training is None else training), calibration_rows, broadcast_grams)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    if fitted is None:
        nothing = F.lit(None).cast("double")
        return rows.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), nothing.alias("entropy"), F.lit(False).alias("accepted"))
    none = F.col("letters") == 0
    return judged(rows, fitted).select(
        "doc_id", held_out().alias("held_out"), F.when(none, "und").otherwise(F.col("best")).alias("lang_pred"), F.when(none, 0.0).otherwise(F.col("sure")).alias("score"),
        F.when(~none, F.col("entropy")).alias("entropy"), "accepted",
    )


def keep_identified(docs: DataFrame, training: DataFrame | None = None, broadcast_grams: int = 8_000_000, calibration_rows: int | None = 4000) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects: texts that are null or have no letter, and texts unlike any language.

    Models and limits are those of ``identify``. Without any row to learn from, no text can be unlike a language, so only those without a letter go. Repeated rows and
    rows without id are judged each; an empty table gives no rows; other columns stay as they are.
    """
    fitted = fit(teachable(docs if training is None else training), calibration_rows, broadcast_grams)
    if fitted is None:
        return keep_rows(docs, "text", lambda texts: (entropies(texts, [])[2] > 0).tolist(), 1_000_000)
    if fitted.models is None:
        text = F.coalesce(docs["text"].cast("string"), F.lit(""))
        good = _judged_by_join(docs.select(text.alias("text")), fitted).where("accepted").select("digest")
        return docs.join(good, F.sha2(text.cast("binary"), 256) == good["digest"], "left_semi")
    shared, limits = docs.sparkSession.sparkContext.broadcast(fitted.models), fitted.limits  # broadcast_grams rows at most

    def test(texts: list[str]) -> list[bool]:
        ce, chars, letters = entropies(texts, shared.value)
        return decide(ce, chars, letters, limits)[-1].tolist()

    return keep_rows(docs, "text", test, 1_000_000)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(table(spark, sf_dir, "documents"), calibration_rows=None)
