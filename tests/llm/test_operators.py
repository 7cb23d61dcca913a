"""Each operator against a plain version of itself, a library, an exact round trip, or held-out rows; and its edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import decontamination, embedding_lsh, language_id, license_scan, line_dedup, sentencepiece_codec, simhash, token_counts, toxicity, warc_fixity
from lakeloom.llm.common import Forest, components

SYLLABLES = {"en": "the an re ing tion er th on".split(), "fr": "eau que ré ment ou ai le".split(), "de": "sch ung ein ver keit zu".split()}
#: Null, empty, blank, one word, ties and repeats, no letter, very long words, odd characters.
EDGE = [None, "", "   \n\t ", "word", "word", "123 456", "é😀 \U00010348 ▁x", "x" * 3000, "a b", "a\x00b \x0b c\x0cd", "\n\n\n", "Don't  STOP,   now!\r\n"]


def prose(rng, lang="en", words=40, line=12):
    made = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + line]) + "." for i in range(0, words, line))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with exact and near copies, a shared passage and edge cases, and columns whose names clash with ours."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice(list(SYLLABLES)), rng.randint(3, 300)) for _ in range(60)]
    passage = prose(rng, "en", 66, 22)
    texts += [texts[0], texts[0], texts[3].replace("a", "b", 1), texts[7] + " the end", texts[5] + "\n" + passage, passage + "\n" + texts[9], texts[11] + "\n" + passage + "\n" + texts[13]]
    rows = [(i, t, "en", i, "k") for i, t in enumerate(texts + EDGE)] + [(None, "null id", None, 1, "k"), (4, "same id again", "en", 1, "k"), (4, "same id again", "en", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, component_id int, k1 string")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if not isinstance(x, list) else (False, tuple(x)) for x in r))


# ---- op1

def plain_scan(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = sorted(i for p in license_scan.BASE for i in range(len(found)) if found[i : i + len(p.split())] == p.split())
    labels = sorted({v for p, v in license_scan.BASE.items() if any(found[i : i + len(p.split())] == p.split() for i in range(len(found)))})
    return len(found), len(places), places[0] if places else None, places[-1] if places else None, ",".join(labels)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "general", "public", "license", "All", "rights", "reserved", "CC-BY", " ", "\n", "é", "cc by cc by", "x", "GNU General Public License v3"]), max_size=14))
def test_license_base(parts):
    text = " ".join(parts)
    assert license_scan.scan(text)[:5] == plain_scan(text)


def test_license_rows(docs):
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan_licenses(docs).collect()]
    assert key(got) == key([(i, *plain_scan(t)) for i, t in pairs(docs)])


def test_license_expressions():
    to_postfix = lambda e: license_scan.to_postfix(license_scan.expression(e, 0, len(e)))
    run = lambda e: license_scan.evaluate(to_postfix(e))
    assert to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert to_postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert run("MIT OR GPL-3.0-only")[0] == 1.0 and run("MIT AND GPL-3.0-only")[0] == 0.4
    assert run("GPL-2.0-only WITH Classpath-exception-2.0") == (0.5, ["gpl-2.0-only"])
    assert to_postfix(") or") is None and to_postfix("MIT and") == ["mit"] and to_postfix("((MIT") == ["mit"]
    found = license_scan.scan("# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND CC-BY-4.0\nAll rights reserved")
    assert found[4] == "cc-by,reserved" and {"apache-2.0", "mit", "cc-by-4.0", "reserved"} <= set(found[5].split(",")) and found[6] == 1.0 and found[8] == 1


def test_license_expressions_are_read_to_their_end():
    names = [f"licence-{i}.0" for i in range(60)]
    found = license_scan.scan("SPDX-License-Identifier: " + " OR ".join([*names, "Apache-2.0"]) + "\nx")
    assert set(found[5].split(",")) == {*names, "apache-2.0"} and found[7] == 1.0
    found = license_scan.scan("SPDX-License-Identifier: MIT " + "x " * 200 + "SPDX-License-Identifier: ISC")
    assert found[5] == "isc,mit" and found[8] == 2


    for text in ("SPDX-License-Identifier: gpl-2.0 and\n (mit or\n apache-2.0)\nand more", "# SPDX-License-Identifier: GPL-2.0 AND\n# (MIT\n# OR Apache-2.0)\n# isc"):
        assert license_scan.scan(text)[5] == "apache-2.0,gpl-2.0,mit"
    assert license_scan.scan("SPDX-License-Identifier: MIT\nor else")[5] == "mit"


@pytest.mark.parametrize(("text", "labels", "tags"), [
    ("SPDX-License-Identifier:\n\nThis module reads files.", "", 1), ("SPDX-License-Identifier:\nThis module reads files.", "", 1), ("The SPDX-License-Identifier tag is required", "", 0),
    ("SPDX-License-Identifier: MIT AND\n\nWe describe", "mit", 1), ("SPDX-License-Identifier: MIT AND\nWe describe", "mit", 1), ("SPDX-License-Identifier: (MIT", "mit", 1),
    ("SPDX-License-Identifier: MIT OR (Apache-2.0 AND ISC", "apache-2.0,isc,mit", 1), ("SPDX-License-Identifier: (MIT OR\n", "mit", 1), ('"SPDX-License-Identifier": "MIT"', "mit", 1),
    ("SPDX-License-Identifier:\nmit", "mit", 1), ("SPDX-License-Identifier : WTFPL", "wtfpl", 1), ("SPDX-License-Identifier:", "", 1), ("spdx license identifier A: b", "", 0),
])
def test_license_names_and_prose_after_a_tag(text, labels, tags):
    found = license_scan.scan(text)
    assert found[5] == labels and found[6] == (1.0 if labels else 0.0) and found[8] == tags


def test_license_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "MIT license", 5, "z"), (2, None, 6, None)], "doc_id long, text string, n_words int, labels string")
    assert {(r["doc_id"], r["n_words"], r["labels"]) for r in license_scan.scan_licenses(df).collect()} == {(1, 2, "mit"), (2, 0, "")}


def plain_value(tokens):
    """A recursive reading of a whole expression: (freedom, licences)."""

    def level(at, operators):
        if not operators:
            if tokens[at] == "(":
                value, at = level(at + 1, ("or", "and", "with"))
                return value, at + 1
            return (license_scan.freedom(tokens[at]), [tokens[at]]), at + 1
        (value, names), at = level(at, operators[1:])
        while at < len(tokens) and tokens[at] == operators[0]:
            (other, more), at = level(at + 1, operators[1:])
            value, names = (min(1.0, value + 0.1), names) if operators[0] == "with" else ((max if operators[0] == "or" else min)(value, other), names + more)
        return (value, names), at

    return level(0, ("or", "and", "with"))[0]


def test_license_scan_against_a_plain_one():
    """Notices found word by word and expressions read by recursion: labels, score and freedom of random texts."""
    rng = random.Random(17)

    def made(depth):
        if depth == 0 or rng.random() < 0.4:
            return [rng.choice(["mit", "gpl-3.0-only", "cc-by-nc-4.0", "apache-2.0", "odd-1.0", "mpl-2.0"])]
        inner = made(depth - 1) + [rng.choice(["and", "or"])] + made(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else [*inner, "with", "some-exception"]

    for _ in range(200):
        phrases = rng.sample(sorted(license_scan.NOTICES), rng.randint(0, 2)) + rng.sample(sorted(license_scan.BASE), rng.randint(0, 1))
        exprs = [made(rng.randint(0, 4)) for _ in range(rng.randint(0, 2))]
        parts = [p.upper() if rng.random() < 0.3 else p for p in phrases] + [f"// SPDX-License-Identifier: {' '.join(e)}" for e in exprs]
        rng.shuffle(parts)
        text = "\n".join(f"{x}\nfiller é words." for x in parts)
        found = license_scan.scan(text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        holds = lambda p: any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))  # noqa: E731, B023
        labels = {v for p, v in (license_scan.NOTICES | license_scan.BASE).items() if holds(p)}
        values = [plain_value(e) for e in exprs]
        for _, names in values:
            labels.update(names)
        assert set(filter(None, found[5].split(","))) == labels, text
        noticed = any(holds(p) for p in license_scan.NOTICES)
        assert found[6] == (1.0 if exprs else 0.9 if noticed else 0.6 if labels else 0.0)
        assert found[7] == (min(v for v, _ in values) if exprs else min(map(license_scan.freedom, labels), default=None)) and found[8] == len(exprs)


def test_license_scan_of_long_texts_and_none(spark, docs):
    long = "cc by " * 200_000 + "SPDX-License-Identifier: " + "(" * 5000 + "MIT" + ")" * 5000 + " or isc"
    found = license_scan.scan(long)
    assert found[1] == 200_000 and found[3] == 399_998 and found[5] == "cc-by,isc,mit"
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


# ---- op2

class PlainKneserNey:
    """Interpolated Kneser-Ney over dictionaries, straight from the definition."""

    def __init__(self, texts, alphabet):
        self.alphabet, self.counts = alphabet, {n: Counter() for n in range(1, 5)}
        for t in texts:
            for i in range(3, len(t)):
                self.counts[4][t[i - 3 : i + 1]] += 1
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        once = {n: Counter(c.values()) for n, c in self.counts.items()}
        self.discount = {n: min(0.95, max(0.1, o[1] / (o[1] + 2 * o[2]))) if o[1] else 0.5 for n, o in once.items()}

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / self.alphabet
        beside = {g: c for g, c in self.counts[n].items() if g[:-1] == gram[:-1]}
        if not beside:
            return self.p(gram[1:])
        total = sum(beside.values())
        return max(self.counts[n][gram] - self.discount[n], 0) / total + self.discount[n] * len(beside) / total * self.p(gram[1:])


def plain_characters(text):
    return "\x01\x01\x01" + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))


@pytest.mark.parametrize("broadcast_grams", [8_000_000, 0])
def test_language_models_against_plain_kneser_ney(spark, broadcast_grams):
    """Cross-entropies of every text, by arrays and by joins; letters beyond the basic plane, repeats, nulls and a long text."""
    rng = random.Random(3)
    texts = [(prose(rng, lang, rng.randint(1, 25)), lang) for lang in ("en", "de") for _ in range(25)]
    texts += [texts[0], texts[0], ("", "en"), (None, "de"), ("\U00010428\U00010429 ab", "en"), ("123 --", "de"), ("\ue123\ue124", "en"), (prose(rng, "en", 3000), "en")]
    rows = [(i, t, x) for i, (t, x) in enumerate(texts)] + [(None, "the thing", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("best", F.lit(1)).withColumn("digest", F.lit("x"))
    got = {r["doc_id"]: r for r in language_id.identify(df, broadcast_grams=broadcast_grams).collect()}
    assert len(got) == len(rows)
    spare = language_id.fit(language_id.teachable(df))
    assert (spare.models is None) is False and spare.languages == ["de", "en"]
    # the sample that calibrates is known by its hashes; the models learn from the other rows
    known = [r for r in language_id.teachable(df).withColumn("h", F.xxhash64("text", "lang", F.lit(5))).collect()]
    hashes = sorted({r["h"] for r in known})
    left = [r for r in known if r["h"] not in set(hashes[: len(hashes) // 10])]
    marked = {x: [plain_characters(r["text"]) for r in left if r["lang"] == x] for x in ("de", "en")}
    alphabet = len({c for ts in marked.values() for t in ts for c in t[3:]}) + 1
    models = {x: PlainKneserNey(ts, alphabet) for x, ts in marked.items()}
    for i, text, _ in rows[:12] + rows[50:57]:
        t = plain_characters(text or "")
        if not any(c.isalpha() for c in t):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        ce = {x: -sum(np.log(m.p(t[k - 3 : k + 1])) for k in range(3, len(t))) / (len(t) - 3) for x, m in models.items()}
        assert got[i]["entropy"] == pytest.approx(min(ce.values()), rel=1e-4), text
        assert got[i]["lang_pred"] == min(sorted(ce), key=ce.get)
    kept = {r["doc_id"] for r in language_id.keep_identified(df, broadcast_grams=broadcast_grams).collect()}
    assert kept == {i for i, r in got.items() if r["accepted"]}


def test_language_of_a_text_does_not_depend_on_its_batch():
    """A private-use character is no letter, also beside an astral one in the same slice."""
    alone = language_id.grams(["\ue123 \ue124"])
    beside = language_id.grams(["\ue123 \ue124", "a \U00010428 b"])
    own = beside[1] == 0
    assert not alone[2].any() and np.array_equal(beside[0][own], alone[0]) and not beside[2][own].any() and beside[2].sum() == 3


def test_language_rejection_of_junk(spark):
    """Random letters and scripts that were not learned go; clean texts of the learned languages stay."""
    rng = random.Random(29)
    clean = [(i, prose(rng, lang, rng.randint(20, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(200)) for _ in range(20)] + ["".join(rng.choice("абвгдежзик ") for _ in range(150)) for _ in range(20)]
    df = spark.createDataFrame(clean + [(1000 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_id.keep_identified(df).collect()}
    assert not [i for i in kept if i >= 1000] and len(kept) >= 398


def test_language_calibration_sample_is_bounded_by_distinct_texts(spark):
    """A text that a third of the rows repeat counts once, and the sample never exceeds its bound."""
    rng = random.Random(31)
    rows = [(i, prose(rng, "en", 30), "en") for i in range(200)] + [(1000 + i, "the thing and the thing", "en") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang")
    fitted = language_id.fit(df, calibration_rows=15)
    assert np.isfinite(fitted.limits).all()
    total = sum(len(plain_characters(t)) - 3 for _, t, _ in rows)
    counts = language_id.gram_counts(df).agg(F.sum("n")).first()[0]
    assert counts == total


@pytest.mark.parametrize("broadcast_grams", [8_000_000, 0])
def test_language_models_and_limits_come_from_all_texts(spark, broadcast_grams):
    """No text is left out of the models, and every distinct one calibrates, judged by plain models of the other half."""
    rng = random.Random(37)
    texts = [(prose(rng, lang, rng.randint(2, 9)), lang) for lang in ("en", "de") for _ in range(18)]
    texts += [texts[0]] * 30 + [("", "en"), ("123", "de")]
    df = spark.createDataFrame([(4 * i, *x) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    fitted = language_id.fit(df.select("text", "lang"), None, broadcast_grams)
    halves = {(r["text"], r["lang"]): r["half"] for r in df.select("text", "lang", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(2)).alias("half")).collect()}
    alphabet = len({c for t, _ in texts for c in plain_characters(t)[3:]}) + 1
    plain = lambda part: {x: PlainKneserNey([plain_characters(t) for t, y in texts if y == x and halves[t, y] in part], alphabet) for x in ("de", "en")}
    entropy = lambda t, m: -sum(np.log(m.p(t[k - 3 : k + 1])) for k in range(3, len(t))) / (len(t) - 3)
    judges, found = {0: plain([1]), 1: plain([0])}, []
    for (text, lang), half in halves.items():
        ce = {x: entropy(t, m) for x, m in judges[half].items()} if len(t := plain_characters(text)) > 3 else {}
        if ce and min(sorted(ce), key=ce.get) == lang:
            found.append((lang, ce[lang], min(len(t) - 3, language_id.CALIBRATED_LENGTH)))
    mean = {x: np.average([e for y, e, _ in found if y == x], weights=[n for y, _, n in found if y == x]) for x in ("de", "en")}
    most = np.quantile([(e - mean[x]) * np.sqrt(n) for x, e, n in found], 0.999)
    assert len(found) > 30 and fitted.languages == ["de", "en"]
    assert fitted.limits[:, 0] == pytest.approx([mean["de"], mean["en"]], rel=1e-4)
    assert fitted.limits[:, 1] == pytest.approx(language_id.MARGIN * max(language_id.LEAST_EXCESS, most), rel=1e-3)
    got = {r["doc_id"]: r for r in language_id.identify(df.limit(20), df.withColumn("doc_id", F.lit(0)), broadcast_grams, None).collect()}
    whole = plain([0, 1])
    for i in range(0, 20, 3):
        t = plain_characters(texts[i][0])
        assert got[4 * i]["entropy"] == pytest.approx(min(entropy(t, m) for m in whole.values()), rel=1e-4)


def test_language_rejection_by_all_texts(spark):
    """As the queries use it: junk goes and clean texts stay; one text, or none with a language, is enough to run."""
    rng = random.Random(41)
    clean = [(i, prose(rng, lang, rng.randint(20, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(200)) for _ in range(20)] + ["".join(rng.choice("абвгдежзик ") for _ in range(150)) for _ in range(20)]
    df = spark.createDataFrame(clean + [(1000 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_id.keep_identified(df, calibration_rows=None).collect()}
    assert not [i for i in kept if i >= 1000] and len(kept) >= 398
    assert {r["lang_pred"] for r in language_id.identify(df, df.where("doc_id = 0"), calibration_rows=None).collect()} == {clean[0][2]}
    assert {r["lang_pred"] for r in language_id.identify(df, df.where("lang is null"), calibration_rows=None).collect()} == {"und"}


def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(20, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(240))]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (None, "the thing", "en"), (1003, "the thing", None), (1004, "Ж" * 400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    held = [i for i, r in got.items() if r["held_out"] and i is not None and i < 1000]
    assert len(held) > 20 and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0 and not got[1001]["accepted"]
    assert got[1003]["lang_pred"] == "en" and got[None]["held_out"] and not got[1004]["accepted"]
    kept = {r["doc_id"] for r in language_id.keep_identified(df).collect()}
    assert kept == {i for i, r in got.items() if r["accepted"]} and len(kept) > 235
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_models_keep_rare_grams(spark):
    """Grams seen once stay, however long the corpus: the model is the one of all grams, counted plainly."""
    rng = random.Random(23)
    common = " ".join(prose(rng, "en", 2000, 1000).split())
    rows = [(f"{common} {i}", "en") for i in range(60)] + [("quixotic zephyrs jab my fjord", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sum(len(t) for t, _ in rows) > 2**19
    model = language_id.fit(df, calibration_rows=0).models[0]
    keys = np.unique(np.concatenate([language_id.grams([t])[0] for t, _ in rows]))
    assert np.array_equal(model.keys[0], keys)
    alphabet = np.unique(keys & np.uint64(0xFFFF))
    for context in np.unique(keys >> np.uint64(16))[:20].tolist() + [0x0001_0001_0099]:
        p = np.exp(model.score((np.uint64(context) << np.uint64(16)) | alphabet).astype(float)).sum()
        assert p + np.exp(model.score(np.array([(context << 16) | 0xFFFF], dtype=np.uint64)))[0] == pytest.approx(1, abs=1e-3)  # the alphabet and what was not seen


# ---- op3

def plain_coverage(item, text, least=5):
    """Greedy string tiling by looking for the longest unmarked common run each time."""
    used_i, used_t, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used_i and j + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        used_i.update(range(i, i + n))
        used_t.update(range(j, j + n))
        covered += n


def test_tiling_matches_plain(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25)))) for i in range(12)]
    texts = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _, item in rng.sample(items, 2):
            w = item.split()
            k = rng.randint(0, len(w))
            words = words[:5] + w[k:] + w[:k] + words[5:]  # its pieces in another order
        texts.append((i, " ".join(words)))
    docs_ = spark.createDataFrame(texts + [(100, None), (101, ""), (None, items[5][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    docs_, bench = docs_.withColumn("digest", F.lit("x")).withColumn("item_id", F.lit(0)), bench.withColumn("digest", F.lit(1)).withColumn("doc_id", F.lit(2))
    for size in (16_000_000, 0):  # sent, and joined
        got = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in decontamination.tilings(docs_, bench, coverage=0.4, broadcast_bytes=size).collect()}
        want = {}
        for d, t in [*texts, (None, items[5][1])]:
            for i, item in items:
                w = decontamination.words(item)
                covered = plain_coverage(w, decontamination.words(t)) if len(w) >= 5 else 0
                if covered and covered >= 0.4 * len(w):
                    want[d, i] = covered
        assert got == want and len(want) > 20
        clean = decontamination.decontaminate(docs_, bench, coverage=0.4, broadcast_bytes=size)
        assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in texts + [(100, 0), (101, 0), (None, 0)]} - {d for d, _ in want} and clean.columns == docs_.columns
    assert {r["item_id"] for r in decontamination.too_short(bench).collect()} >= {98, 99}
    twice = decontamination.tilings(docs_.union(docs_), bench.union(bench), coverage=0.4, broadcast_bytes=0)
    assert twice.count() == 4 * len(want) == decontamination.tilings(docs_.union(docs_), bench.union(bench), coverage=0.4).count()
    assert decontamination.tilings(docs_, bench.limit(0)).count() == 0 and decontamination.decontaminate(docs_.limit(0), bench).count() == 0


def test_tiling_of_repeated_words():
    """Equal words on both sides: runs are held by their ends, so memory and time stay small; and the tiles are the plain ones."""
    rng = random.Random(19)
    tiled = lambda item, text: decontamination.tiled(item, decontamination.run_hashes(item, 5), text, decontamination.run_hashes(text, 5), 5)
    for _ in range(60):
        item, text = ([b"a" if rng.random() < 0.8 else b"b" for _ in range(rng.randint(5, 30))] for _ in range(2))
        hit = tiled(item, text)
        assert (hit[2] if hit else 0) == plain_coverage(item, text)
    assert tiled([b"the"] * 1000, [b"the"] * 20_000) == (1000, 1, 1000, 1000)
    begin, _, n = decontamination.diagonals(np.ones(996, dtype=np.uint64), np.ones(19_996, dtype=np.uint64))
    assert len(begin) == 996 + 19_996 - 1 and n.max() == 996
    assert tiled([b"a", b"b"] * 500, [b"b", b"a"] * 5000)[2] == 1000


# ---- op4

def plain_dedup(rows, least=20):
    """Lines left in each text: chunks by a dictionary of their text."""
    places = {}
    signed = lambda i: -(2**63) if i is None else i
    for i, k2, t in rows:
        lines = t.split("\n")
        for s, e, _ in line_dedup.chunks(lines, least):
            places.setdefault("\n".join(lines[s:e]), set()).add((signed(i), k2, s))
    out = []
    for i, k2, t in rows:
        lines, drop = t.split("\n"), set()
        light = lambda ls, n: ls[n] if 0 <= n < len(ls) and len(ls[n].split()) < least else None
        for s, e, _ in line_dedup.chunks(lines, least):
            first = min(places["\n".join(lines[s:e])])
            if first != (signed(i), k2, s):
                drop.update(range(s, e))
                other = next(x.split("\n") for a, b, x in rows if (signed(a), b) == first[:2])
                above, below = light(lines, s - 1), light(lines, e)
                if above is not None and above == light(other, first[2] - 1):
                    drop.add(s - 1)
                if below is not None and below == light(other, first[2] + e - s):
                    drop.add(e)
        out.append((i, "\n".join(x for n, x in enumerate(lines) if n not in drop), sorted(drop)))
    return out


def test_line_dedup_matches_plain(docs):
    rows = [(r["doc_id"], r["k"], r["text"]) for r in docs.select("doc_id", F.xxhash64("text").alias("k"), "text").where("text is not null").collect()]
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed", "removed_lines"]
    got = [(r["doc_id"], r["text"], r["removed_lines"]) for r in out.collect()]
    assert key([g for g in got if g[1] is not None]) == key(plain_dedup(rows)) and len(got) == docs.count()
    assert sum(len(g[2]) for g in got) > 10
    before, after = ({line for _, t in x if t for line in t.split("\n")} for x in (pairs(docs), [g[:2] for g in got]))
    assert before <= after  # the first copy of every line stays
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_finds_moved_passages(spark):
    rng = random.Random(3)
    for lines in (1, 2, 4, 8):
        passage = prose(rng, "en", 64, 64 // lines)
        texts = [(i, f"{prose(rng, 'de', 30, 7)}\n{passage}\n{prose(rng, 'fr', 30, 6)}") for i in range(6)]
        left = [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()]
        assert passage in left[0]
        share = np.mean([sum(line in t.split("\n") for line in passage.split("\n")) / lines for t in left[1:]])
        assert share <= 0.5, lines


def test_line_dedup_removes_repeated_runs_whole(spark):
    """Against all runs of lines of 20 words and more that two texts share, found by brute force."""
    rng = random.Random(14)
    for line in (3, 5, 6, 8, (2, 9)):
        def short(lang, words, line=line):
            made, n = prose(rng, lang, words, 1000).replace(".", "").split(), 0
            out = []
            while n < words:
                k = line if isinstance(line, int) else rng.randint(*line)
                out.append(" ".join(made[n : n + k]))
                n += k
            return out

        passages = [short("en", n) for n in (55, 120) for _ in range(4)]
        texts = [short("de", rng.randint(10, 40)) + p + short("fr", rng.randint(10, 40)) for p in passages for _ in range(2)]
        want = []
        for d, own in enumerate(texts):
            drop = set()
            for other in texts[:d]:
                for i in range(len(own)):
                    for j in range(len(other)):
                        n = 0
                        while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                            n += 1
                        if sum(len(x.split()) for x in own[i : i + n]) >= 20:
                            drop.update(range(i, i + n))
            want.append(sorted(drop))
        got = line_dedup.dedup_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
        assert [r["removed_lines"] for r in got.orderBy("doc_id").collect()] == want and sum(map(bool, want)) == 8, line


# ---- op5

def test_fixity_finds_what_is_damaged(spark):
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "é" * (i % 7)) for i in range(300)] + [(7, None, None), (None, "u", ""), (7, "http://h/7", "<html>7"), (7, "http://h/7", "<html>7")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hash", F.lit(1))
    got = warc_fixity.audit_pages(pages, F.col("page_id") % 50 == 3).collect()
    assert {r["page_id"] for r in got if r["corrupt"]} == {3, 53, 103, 153, 203, 253} and len(got) == 302 and sum(r["copies"] for r in got) == 304
    for f in {r["warc_file"] for r in got}:
        own = sorted((r["seq"], r["start"], r["end"]) for r in got if r["warc_file"] == f)
        assert [o[0] for o in own] == list(range(len(own))) and all(a[2] == b[1] for a, b in zip(own, own[1:])) and own[0][1] == 0
    assert not any(r["corrupt"] for r in warc_fixity.audit_pages(pages).collect())
    assert warc_fixity.audit_pages(pages.limit(0)).count() == 0


def test_fixity_goes_through_many_files_and_lost_records(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"h{i}") for i in range(200)], "page_id long, url string, html string")
    placed = warc_fixity.layout(pages, file_records=5).cache()
    left = warc_fixity.tree(placed)
    assert left.file_levels < len(left.levels) and left.levels[-1].count() == 1
    changed = placed.withColumn("hash", F.when(F.col("page_id") == 77, F.lit("x")).otherwise(F.col("hash")))
    bad = warc_fixity.audit(left, warc_fixity.tree(changed)).collect()
    at = placed.where("page_id = 77").first()
    assert [(r["file"], r["seq"], r["start"], r["end"], r["right_hash"]) for r in bad] == [(at["warc_file"], at["seq"], at["start"], at["end"], "x")]
    lost = placed.where("page_id <> 77")
    assert warc_fixity.audit(left, warc_fixity.tree(lost)).where("right_hash is null").count() == 1


def test_fixity_descends_only_where_nodes_differ(spark):
    """The nodes that are compared are those on the way to the damage, also for trees of unlike height."""
    pages = spark.createDataFrame([(i, f"u{i}", f"h{i}") for i in range(1200)], "page_id long, url string, html string")
    placed = warc_fixity.layout(pages, file_records=10_000).cache()
    left = warc_fixity.tree(placed)
    changed = placed.withColumn("hash", F.when(F.col("seq") == 777, F.lit("x")).otherwise(F.col("hash")))
    steps = warc_fixity.descent(left, warc_fixity.tree(changed))
    assert [n.count() for _, n in steps] == [1, 1, 5, 16, 16] and [r["seq"] for r in warc_fixity.audit(left, warc_fixity.tree(changed)).collect()] == [777]
    short = warc_fixity.tree(changed.where("seq < 1000 and seq <> 5").withColumn("seq", F.col("seq") - (F.col("seq") > 5).cast("int")).where("seq < 200"))
    assert short.file_levels < left.file_levels
    steps = warc_fixity.descent(left, short)
    assert steps[0][0] == short.file_levels - 1 and steps[0][1].count() == 5
    found = warc_fixity.audit(left, short)
    assert found.count() == 1200 - 5 and found.where("right_hash is null").count() == 1000
    assert warc_fixity.descent(left, left)[-1][0] == len(left.levels) - 1 and warc_fixity.audit(left, left).count() == 0


def test_many_gzip_members_take_linear_time(spark, tmp_path):
    import gzip
    import time

    member = gzip.compress(bytes(random.Random(2).randrange(256) for _ in range(3000)))
    (tmp_path / "many.warc.gz").write_bytes(member * 6000)
    began = time.perf_counter()
    rows = warc_fixity.read_records(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.max("end").alias("e")).first()
    assert (rows["n"], rows["e"]) == (6000, 6000 * len(member)) and time.perf_counter() - began < 15


def test_read_records(spark, tmp_path):
    import gzip
    import hashlib

    raw = [b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in (b"one", b"", b"three" * 50)]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    zipped = [gzip.compress(r) for r in raw]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(zipped))
    got = sorted((r["warc_file"], r["seq"], r["start"], r["end"], r["hash"]) for r in warc_fixity.read_records(spark, str(tmp_path)).collect())
    want = []
    for f, parts in enumerate((raw, zipped)):
        at = 0
        for n, p in enumerate(parts):
            want.append((f, n, at, at + len(p), hashlib.sha256(p).hexdigest()))
            at += len(p)
    assert got == want


# ---- op6

def plain_components(ids, links):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = plain_components(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 12))
def test_bit_sliced_counts(values, radius):
    x = np.array([v & (v >> 7) & (v >> 13) & (v >> 29) for v in values], dtype=np.uint64)
    assert simhash.within_radius(x, radius).tolist() == [int(v).bit_count() <= radius for v in x]


def test_block_links_match_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for b in base]))
    side = (np.arange(len(fps)) % 2).astype(int)
    for cross in (False, True):
        links = [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 2 and (not cross or side[a] != side[b])]
        want = plain_components(range(len(fps)), links)
        assert plain_components(range(len(fps)), simhash._block_links(fps, side, cross, 2)) == want
    forest = Forest(5)
    forest.add(np.array([0, 1, 0, 3]), np.array([1, 2, 2, 4]))
    assert len(forest.edges) == 3


def test_nearest_links_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    noise = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)]
    fps = np.unique(np.array([int(base[rng.integers(0, 40)]) ^ n for n in noise], dtype=np.uint64))
    ids = rng.permutation(len(fps))
    side = np.arange(len(fps)) % 2
    for cross in (False, True):
        want = {}
        for a in range(len(fps)):
            near = [(int(fps[a] ^ fps[b]).bit_count(), ids[b], b) for b in range(len(fps)) if ids[b] < ids[a] and (not cross or side[a] != side[b])]
            near = [x for x in near if x[0] <= 6]
            if near:
                want[a] = min(near)[2]
        assert dict(simhash._block_links(fps, side, cross, 6, simhash.Nearest(ids, fps))) == want
    # over all files: each row that has a link meets a nearest one
    classes = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, fps.view(np.int64))], "id long, fp long")
    place = {int(i): int(f) for i, f in zip(ids, fps)}
    for block in (16, 4096):
        got = {}
        for r in simhash.hamming_links(classes, 6, block, nearest=True).collect():
            assert r["b"] < r["a"] and (place[r["a"]] ^ place[r["b"]]).bit_count() <= 6
            got[r["a"]] = min(got.get(r["a"], 99), (place[r["a"]] ^ place[r["b"]]).bit_count())
        least = {i: min(d) for i in place if (d := [x for j in place if j < i and (x := (place[i] ^ place[j]).bit_count()) <= 6])}
        assert got == least


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_all_pairs(docs, spark):
    rows = pairs(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    ids = {i for i, _ in rows if i is not None}
    known = [(i, p) for (i, _), p in zip(rows, prints) if i is not None]
    want = plain_components(ids, [(a, b) for a, p in known for b, q in known if a > b and (p ^ q).bit_count() <= 2])
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.groups(docs).collect()]
    assert key(got) == key([(i, p, want.get(i)) for (i, _), p in zip(rows, prints)])
    assert simhash.groups(docs.limit(0)).count() == 0
    # the hash is Spark's own
    assert spark.sql("select xxhash64('the an re')").first()[0] % 2**64 == __import__("xxhash").xxh64_intdigest("the an re", 42)


def test_files_beyond_a_block_lose_no_link(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 30), (1 << rng.integers(0, 62, 300)) | (1 << rng.integers(0, 62, 300))])).astype(np.int64)
    classes = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps)], "id long, fp long")
    want = plain_components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 2])
    for block in (16, 4096):
        got = {r["node"]: r["component"] for r in components(simhash.hamming_links(classes, 2, block)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_near_dedup_keeps_one_and_only_drops_what_is_alike(docs):
    kept = simhash.near_dedup(docs).collect()
    texts = dict((i, t) for i, t in pairs(docs) if i is not None)
    left = {r["doc_id"] for r in kept}
    assert {0, 3, 7} <= left and not {60, 61} & left and None in left
    for gone in set(texts) - left:
        assert max(simhash.similarity(texts[gone], texts[i]) for i in left if i is not None) >= 0.8
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_of_groups_within_reach_of_each_other(spark):
    """Many copies of texts that are near in bits but not alike: each text keeps one document."""
    rng = random.Random(8)
    frame, tail = prose(rng, "en", 160, 20).split(), lambda: prose(rng, "en", 60, 20).split()
    texts = [" ".join(frame + tail()) for _ in range(12)]
    near = [t.replace(t.split()[40], "other", 1) for t in texts]
    rows = [t for t in texts + near for _ in range(7)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in simhash.near_dedup(docs).collect()]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.similarity(rows[i], rows[j]) >= 0.8]
    want = plain_components(range(len(rows)), links)
    assert sorted(i for i, _ in left) == sorted(set(want.values())) and len(left) == 12


def test_near_dedup_compares_fingerprints_first(spark, monkeypatch):
    """Pairs by SimHash connect what all pairs within two bits do, and they are what the stage starts from."""
    rng = random.Random(43)
    made = [int(rng.getrandbits(64)) for _ in range(60)]
    made += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in made[:30]] + made[:10]
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(made)], "id long, fp long")
    want = plain_components(range(len(made)), [(a, b) for a in range(len(made)) for b in range(a) if (made[a] ^ made[b]).bit_count() <= 2])
    got = {r["node"]: r["component"] for r in components(simhash.fingerprint_pairs(prints)).collect()}
    assert {i: got.get(i, i) for i in want} == want
    _, hashes = simhash.shingle_hashes(prose(rng, "en", 50, 10))
    assert simhash.majority(hashes) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    text = prose(rng, "en", 900, 30)
    rows, seen, plain = [text, text + " end", prose(rng, "de", 90, 30)], [], simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda *a, **b: seen.append(plain(*a, **b)) or seen[0])
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert kept == {0, 2} and [tuple(r) for r in seen[0].collect()] == [(1, 0)]


def test_near_dedup_finds_added_and_cut_passages(spark):
    """Against all pairs of 0.8 and more, whatever their fingerprints: a passage appended, put in front, cut or replaced."""
    rng = random.Random(21)
    rows = []
    for _ in range(60):
        own = prose(rng, "en", rng.choice([60, 150, 400]), 1000).split()
        k = int(len(own) * rng.uniform(0.06, 0.24))
        more = prose(rng, "fr", k, 1000).split()
        rows += [" ".join(x) for x in (own, rng.choice([own + more, more + own, own[:-k], own[k:], own[: len(own) // 2] + more[: k // 2] + own[len(own) // 2 + k // 2 :]]))]
    rng.shuffle(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.similarity(rows[i], rows[j]) >= 0.8]
    far = [1 for i, j in links if (simhash.fingerprint(rows[i], 2) ^ simhash.fingerprint(rows[j], 2)).bit_count() > 10]
    assert len(links) > 25 and len(far) >= 3
    want = plain_components(range(len(rows)), links)
    left = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert left == set(want.values())


def test_near_dedup_looks_past_texts_that_share_a_template(spark):
    """Every text is about 0.77 like all others, and some are 0.8 like one: what fails first must not hide it."""
    rng = random.Random(22)
    frame = prose(rng, "en", 200, 1000).split()
    texts = [frame + prose(rng, "fr", 26, 1000).split() for _ in range(50)]
    rows = [" ".join(t) for t in texts] + [" ".join(t[:-14] + prose(rng, "de", 14, 1000).split()) for t in texts[::2]]
    rng.shuffle(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.similarity(rows[i], rows[j]) >= 0.8]
    assert 20 < len(links) < 200
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = plain_components(range(len(rows)), links)
    for block in (16, 4096):
        got = {r["node"]: r["component"] for r in simhash.alike_components(df, block=block).collect()}
        assert {i: got.get(i, i) for i in range(len(rows))} == want


# ---- op7

def test_embeddings_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    x = np.concatenate([centres, centres[:10] + 0.12 * rng.standard_normal((10, 24)), np.repeat(centres[:1], 5, axis=0) * 2, centres[20:21] + 0.02 * rng.standard_normal((60, 24))]).astype(np.float32)
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("c", F.lit(1))
    unit = embedding_lsh.unit(x.astype(float))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = plain_components(range(len(x)), np.argwhere(near).tolist())
    for block in (8, 2048):
        got = {r["vec_id"]: r for r in embedding_lsh.links(df, recall=0.999, block=block).collect()}
        assert len(got) == len(rows)
        assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
        assert [got[i]["component_id"] for i in range(len(x))] == [want[i] for i in range(len(x))]
        assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(6)) and got[1006]["n_links"] == got[1007]["n_links"] == 1
    assert embedding_lsh.links(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = embedding_lsh.unit(rng.standard_normal((400, 32)))
    b = rng.standard_normal((400, 32))
    b = embedding_lsh.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = 0.905 * a + np.sqrt(1 - 0.905**2) * b
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, c]))], "vec_id long, embedding array<double>")
    assert embedding_lsh.links(df).agg(F.sum("n_links")).first()[0] / 800 >= 0.9


# ---- op8

def test_token_counts_match_the_library(docs):
    made = token_counts.tokenizer("byte_bpe_50k.json")
    want = [(i, len((t or "").encode()), len(made.encode(t or "", add_special_tokens=False))) for i, t in pairs(docs)]
    for limits in ({}, {"long_chars": 60, "chunk_chars": 50, "overlap": 16}, {"long_chars": 200, "chunk_chars": 100, "overlap": 40}):
        assert key([tuple(r) for r in token_counts.count_tokens(docs, **limits).collect()]) == key(want)


def test_long_texts_of_every_kind(spark):
    rng = random.Random(6)
    texts = [" " * 4000, "a" * 5000, "\n" * 999 + "a" + " \t" * 999, "<|endoftext|>" * 300, "don't we'll I've " * 400, "é😀 漢字 " * 500, "x<|endof" * 600, prose(rng, "en", 2000), "1234567890" * 400, "".join(rng.choice(" \n\ta'sré1.") for _ in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = token_counts.tokenizer("byte_bpe_50k.json")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, long_chars=500, chunk_chars=400, overlap=64).collect()}
    assert got == {i: len(made.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


def test_counts_by_rank_are_the_librarys():
    """Every settled character in several surroundings, and texts that must go to the library itself."""
    name = "byte_bpe_50k.json"
    made, encoder = token_counts.tokenizer(name), token_counts.by_rank(name)
    settled = np.flatnonzero(token_counts.settled()).tolist()
    assert encoder is not None and len(settled) > 45_000
    for around in ("a%sb", "1%s2 %s", " \n%s\t", "'%ss %s."):
        texts = [around.replace("%s", chr(c)) for c in settled]
        want = [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)]
        assert [len(encoder.encode_ordinary(t)) for t in texts] == want
    texts = ["", "<|endoftext|>", "a <|endoftext|>b", "😀 é", "\ue000x", "\u0378", "漢字", "a" * 20_000, "\x00\x1f\x85\xa0 "]
    assert token_counts.counts(texts, name) == [len(made.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.by_rank("word_bpe_49k.json") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    made = token_counts.tokenizer("byte_bpe_50k.json")
    assert token_counts.counts([text], "byte_bpe_50k.json") == [len(made.encode(text, add_special_tokens=False))]


def test_counts_of_an_empty_table(docs):
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# ---- op9

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "é", "😀", "梦", "▁", "1", ".", ", ", "'s", "ß", "tion", "--", "()", "?!"]), max_size=25))
def test_pieces_match_the_library(library, parts):
    text = "".join(parts)
    codec = sentencepiece_codec.codec("piece_bpe_32k.model")
    ids = codec.encode([text])[0][0].tolist()
    assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)


def test_pieces_of_documents(docs, library):
    want = [(i, len(ids := library.encode(t or "")), ids) for i, t in pairs(docs)]
    out = sentencepiece_codec.encode(docs)
    got = out.collect()
    assert key([(r["doc_id"], r["n_pieces"], r["pieces"]) for r in got]) == key(want) and all(r["round_trip"] for r in got)
    back = [(r["doc_id"], r["text"]) for r in sentencepiece_codec.decode(out).collect()]
    assert key(back) == key([(i, (t or "").replace("▁", " ")) for i, t in pairs(docs)])
    assert sentencepiece_codec.encode(docs.limit(0)).count() == 0


def test_stability_of_pairs_is_what_merging_says():
    codec, rng = sentencepiece_codec.codec("piece_bpe_32k.model"), random.Random(7)
    ids = [i for p, i in codec.ids.items() if codec.merge(p) == [p]]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert codec._stable(a, b) == (codec.merge(codec.pieces[a] + codec.pieces[b]) == [codec.pieces[a], codec.pieces[b]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=8))
def test_unigram_paths_are_the_best(words):
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "bb", "abab"]
    scores = [0.0, -2.0, -2.3, -2.9, -3.1, -4.4, -4.0, -5.0]
    codec = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    codec.setup(pieces, scores, [True] + [False] * 7, {}, 0, "unigram")

    def best(word):
        if not word:
            return 0.0
        options = [scores[i] + best(word[len(p) :]) for i, p in enumerate(pieces) if i and word.startswith(p)]
        return max([*options, codec.least + best(word[1:])] if not options or word[0] == "c" else options)

    for word, ids in codec.encode_words(words).items():
        if "c" not in word:
            assert sum(scores[i] for i in ids) == pytest.approx(best(word)) and "".join(pieces[i] for i in ids) == word


# ---- op10

def test_toxicity_held_out(spark):
    rng = random.Random(8)
    bad = ["grumblefrotz", "zzquark", "blorptag"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(rng, rng.choice(list(SYLLABLES)), 60).split(" "), i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), i))
        labels.append((i, int(toxic)))
    rows += [(900, None, 0), (901, "", 0), (None, "idiot", 0), (902, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, known).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert len(held) > 40 and np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["predicted"] == got[901]["predicted"] == 0 and got[902]["score"] == got[0]["score"]
    assert toxicity.score_toxicity(df, known.limit(0)).where("score is null").isEmpty() and toxicity.score_toxicity(df.limit(0), known).count() == 0


def test_grammar_scores_clauses():
    lexicon = toxicity._lexicon(())
    f = dict(zip(toxicity.FEATURES, toxicity.features("You idiot. He said idiot. You are not an idiot. idiot", lexicon)))
    assert f["targeted"] > 0 and f["reported"] > 0 and f["negated"] > 0 and f["insult"] > 0
    assert toxicity.features("kill you", lexicon)[2] > 0 and toxicity.features("skillful idiotic", lexicon)[0] == 0
    machine = toxicity.Composed()
    state, out = machine.start, []
    for symbol in "TOI":
        state, written, factor = machine.step(state, symbol)
        out.append((written, factor))
    assert out[-1] == ("A", 1.5)


def plain_features(text, lexicon):
    """The cascade one transducer after another over every clause, each a pass over all classes."""
    sums, strongest, hits, lowered = [0.0] * 5, 0.0, 0, (text or "").lower()
    for clause in re.split(r"[.!?;\n]", lowered):
        tagged = [lexicon.weigh(w) for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]", clause)]
        symbols, weights = [c for c, _ in tagged], [w for _, w in tagged]
        for transducer, step in [(toxicity.FOLLOWED, -1), *((t, 1) for t in toxicity.CASCADE)]:
            state = 0
            for i in list(range(len(symbols)))[::step]:
                state, symbols[i], factor = transducer.arcs.get((state, symbols[i]), (state, symbols[i], 1.0))
                weights[i] *= factor
        for c, w in zip(symbols, weights):
            if w:
                sums[{"I": 0, "J": 0, "A": 1, "H": 2, "B": 2, "X": 3, "Y": 4}[c]] += w
                hits += 1
        strongest = max(strongest, sum(weights))
    return [np.log1p(x) for x in sums] + [np.log1p(strongest), np.log1p(1000 * hits / (len(lowered) + 100))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "IDIOTS", "you", "not", "said", '"', "kill", "hurt", "she", "thing", ".", "!", ";", "\n", ",", "never", "isn't", "grumble", "trash", "é"]), max_size=30))
def test_grammar_against_a_plain_cascade(parts):
    lexicon = toxicity._lexicon((("grum*", 5.0), ("thing", 1.5)))
    text = " ".join(parts)
    assert toxicity.features(text, lexicon) == pytest.approx(plain_features(text, lexicon))


def test_targets_that_follow_an_attack():
    lexicon = toxicity._lexicon(())
    near, far = (toxicity.features(t, lexicon) for t in ("idiot, you", "idiot, you know well what they did there to them"))
    assert near[1] == far[1] > 0 == near[0]
    assert toxicity.features("idiot of the one place you", lexicon)[1] == 0


def test_grammar_reads_long_texts_in_linear_time():
    import time

    lexicon = toxicity._lexicon(())
    for text in ("idiot, " * 150_000, "an idiot. " * 100_000, "word " * 300_000 + "idiot"):
        began = time.perf_counter()
        assert max(toxicity.features(text, lexicon)) > 0 and time.perf_counter() - began < 20


def test_keep_identified_without_labels(spark):
    rows = [(1, "some words", None), (1, "some words", None), (2, None, None), (3, "123 !", None), (None, "été", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert key([(r["doc_id"], r["text"]) for r in language_id.keep_identified(df).collect()]) == key([(1, "some words"), (1, "some words"), (None, "été")])


def test_sentencepiece_keeps_no_long_words(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_CHARS", 400)
    made = sentencepiece_codec.Codec("piece_bpe_32k.model", "bpe")
    fresh = sentencepiece_codec.Codec("piece_bpe_32k.model", "bpe")
    rng = random.Random(3)
    for n in range(12):
        texts = [prose(rng, "en", 30), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(900)), "the same words again", "y" * 200]
        fresh.known, fresh.again, fresh.held = {}, set(), 0
        assert [x.tolist() for x in made.encode(texts)[0]] == [x.tolist() for x in fresh.encode(texts)[0]], n
        assert max(map(len, made.known)) <= sentencepiece_codec.KEEP_CHARS and made.held == sum(map(len, made.known)) < 2_000


def test_toxicity_learns_one_text_an_id(spark):
    rows = [(i % 40, f"you are {'awful' if i % 2 else 'kind'} number {i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    once = docs.dropDuplicates()
    got = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got == {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(once, labels).collect()} and toxicity.score_toxicity(docs, labels).count() == 400
