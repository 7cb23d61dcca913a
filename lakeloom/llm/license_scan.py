"""Licence scan: an Aho-Corasick automaton finds notices, a shunting-yard parser evaluates licence expressions.

A text is reduced to its words (A-Z lower-cased; runs of digits, a-z and non-ASCII characters) with single spaces, and
one automaton over all phrases reads it once. Where it finds an identifier tag that a colon follows, the expression after
the colon is read from the raw text: ``and``, ``or``, ``with`` and parentheses over licence names. It ends with its line, but
goes on to the next one while a parenthesis is open or a name is still wanted; a blank line or a word that is no licence
name ends it in any case, and what is still open there is closed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, text_slices

#: Phrases that count as base places, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Longer notices, with the labels that they add.
NOTICES = {
    "apache license": "apache", "apache license version 2 0": "apache-2.0", "licensed under the apache license version 2 0": "apache-2.0",
    "mit license": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "mozilla public license": "mpl", "mozilla public license version 2 0": "mpl-2.0", "eclipse public license": "epl",
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc 4 0": "cc-by-nc-4.0", "cc by 4 0": "cc-by-4.0", "cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc0 1 0": "cc0", "dedicated to the public domain": "public-domain", "this is free and unencumbered software": "unlicense",
    "strictly confidential": "confidential", "proprietary and confidential": "confidential",
}
#: How freely a licence family lets a text be used, by the beginning of its label.
FREEDOM = {
    "cc-by-nc": 0.2, "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc-by": 0.9, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0,
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "apache": 1.0, "zlib": 1.0, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "agpl": 0.3, "gpl": 0.4, "reserved": 0.0, "confidential": 0.0,
}
TAG = "spdx license identifier"
_WORD_AT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A line's end with what may lead the next line, a name or parenthesis, and what ends an expression.
_PART = re.compile(r"(?P<line>\r?\n[ \t]*(?:[#*/;%-]+[ \t]*)?)|(?P<part>\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.+\-]*[A-Za-z0-9+])?)|(?P<end>[;,*<>\"'])")
#: What makes a word after a tag a tag's value: a colon, perhaps between quotes.
_COLON = re.compile(r"[ \t\"'*`]*:[ \t\"'*`]*")
_NOT_WORD = bytes(i if i >= 0x80 or chr(i).isdigit() or "a" <= chr(i) <= "z" else i + 32 if "A" <= chr(i) <= "Z" else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text. In UTF-8 every byte of a non-ASCII character is a word byte, so bytes do."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NOT_WORD).split(b" ") if text else []


def freedom(label: str) -> float:
    """The freedom of a licence name: that of the longest family it begins with, 0.5 for unknown names."""
    found = [k for k in FREEDOM if label.startswith(k)]
    return FREEDOM[max(found, key=len)] if found else 0.5


def is_name(word: str) -> bool:
    """Whether a word can name a licence: a label of the phrases or a family, or written as identifiers are.

    Those have a digit, a hyphen, or two letters and more that are all capitals.
    """
    known = word.lower() in FREEDOM or word.lower() in NOTICES.values()
    return known or any(c.isdigit() or c == "-" for c in word) or (len(word) > 1 and word.isupper())


def expression(text: str, start: int, stop: int, test: Callable[[str], bool] | None = None) -> list[str]:
    """The lower-cased names, operators and parentheses of the expression that begins at a place.

    The first name that fails ``test`` and the first blank line end it.
    """
    tokens: list[str] = []
    depth, wants_name, blank = 0, True, False
    for m in _PART.finditer(text, start, stop):
        if m["end"] or (m["line"] and (blank or (tokens and not depth and not wants_name))):
            break
        blank = bool(m["line"])
        if part := m["part"]:
            if test and part not in "()" and part.lower() not in ("and", "or", "with") and not test(part):
                break
            tokens.append(part.lower())
            depth += (part == "(") - (part == ")")
            wants_name = tokens[-1] in ("(", "and", "or", "with")
    return tokens


def to_postfix(tokens: list[str]) -> list[str] | None:
    """A licence expression as postfix tokens (shunting-yard; ``with`` binds tightest, then ``and``, then ``or``).

    Reads as far as the expression is well formed and closes what is open there; None when not even its first name is.
    """
    rank = {"or": 1, "and": 2, "with": 3}
    out: list[str] = []
    stack: list[str] = []
    wants_name, good, depth = True, 0, 0
    for at, token in enumerate(tokens):
        if token == "(" and wants_name:
            stack.append(token)
            depth += 1
        elif token == ")" and not wants_name and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif token in rank and not wants_name:
            while stack and rank.get(stack[-1], 0) >= rank[token]:
                out.append(stack.pop())
            stack.append(token)
            wants_name = True
        elif token not in rank and token not in "()" and wants_name:
            out.append(token)
            wants_name = False
        else:
            break
        if not wants_name:
            good = at + 1
    else:
        if not wants_name:
            return out + [x for x in reversed(stack) if x != "("]
    return to_postfix(tokens[:good]) if good else None


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """Freedom of an expression (``or``: the freer side; ``and``: the stricter; ``with``: an exception eases) and its licences."""
    stack: list[tuple[float, list[str]]] = []
    for token in postfix:
        if token in ("and", "or", "with"):
            (b, right), (a, left) = stack.pop(), stack.pop()
            stack.append((min(1.0, a + 0.1), left) if token == "with" else ((max if token == "or" else min)(a, b), left + right))
        else:
            stack.append((freedom(token), [token]))
    return stack[0]


@functools.lru_cache(maxsize=1)
def automaton():
    """All phrases, with a space at both ends, as one automaton over the words of a text joined by spaces."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, float | None, int]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, freedom and n_tags of one text."""
    found = [w for w in words(text) if w]
    joined = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    places, base, labels, tags, values = [], set(), set(), [], []
    counted, upto = 0, 0  # words before a place, counted on from the last one
    for end, phrase in automaton().iter(joined):
        if phrase in BASE or phrase == TAG:
            start = end - len(phrase) - 1
            counted, upto = counted + (joined.count(" ", upto, start) if start >= upto else -joined.count(" ", start, upto)), start
        if phrase in BASE:
            places.append(counted)
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        if phrase == TAG:
            tags.append(counted)
    colons = []
    if tags:
        ends = [m.end() for m in _WORD_AT.finditer(text or "")]  # where each word ends in the raw text
        colons = [_COLON.match(text or "", ends[n + 2]) for n in tags]
        for colon, stop in zip(colons, [*(ends[n] for n in tags[1:]), len(text or "")], strict=True):
            if colon and (postfix := to_postfix(expression(text or "", colon.end(), stop, is_name))):
                value, names = evaluate(postfix)
                values.append(value)
                labels.update(names)
    notices = labels | base
    score = 1.0 if values else 0.9 if labels else 0.6 if base else 0.0
    return (
        len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(notices)),
        score, min(values) if values else min(map(freedom, notices), default=None), sum(map(bool, colons)),
    )


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double, n_tags long"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``scan`` finds in every row.

    ``score`` is the strength of the evidence: 1 for a tag with a readable expression of licence names, 0.9 for a notice, 0.6 for a base
    phrase alone, else 0. ``freedom`` (0 to 1) evaluates the tags' expressions, or else takes the strictest notice; null
    without any. A null text counts as empty (no words) and a very long one is read whole, in time that is linear; rows
    without an id and repeated rows give a row each; an empty table gives no rows; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x) for _, texts in text_slices(batch, "text") for x in texts]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [c.split()[0] for c in _SCHEMA.split(", ")])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
