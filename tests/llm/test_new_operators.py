"""Resampling, token id files and ranked search against plain versions of themselves, a library and exact round trips."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import id_coder, lexical_search, resampling, token_output

EDGE = [None, "", "   \n\t ", "word", "word", "123 456", "é😀 \U00010348 ▁x", "x" * 3000, "a b", "A\x00B \x0b c\x0cd", "Don't  STOP,   now!\r\n", "<|endoftext|> a<|startoftext|>b", "é ́x ΑΣ ΣΑ.", "日本語" * 50]
SYLLABLES = "the an re ing tion er th on eau que".split()


def prose(rng, words):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 2))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    """Random texts, copies, repeated and null ids, and columns whose names clash with the operators' own."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    rows = [(i, t, 1, "k", 2) for i, t in enumerate([*texts, *[texts[0]] * 30, *EDGE])] + [(None, "null id the an", 1, "k", 2), (4, "same id again", 1, "k", 2), (4, "same id again", 1, "k", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket int, w string, row int").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate([prose(rng, 8), "the the THE an", "unknownword", None, "", "word", prose(rng, 30)])] + [(1, "the the THE an", "x"), (None, "ing", "x")], "item_id long, text string, query string")


def pairs(df, key="doc_id"):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# ---- op11

def plain_resample(docs, target):
    grams = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    hashed = [[zlib.crc32(g.encode()) % 10_000 for g in grams(cut(t))] for _, t in docs]
    s, t = Counter(b for h in hashed for b in h), Counter(zlib.crc32(g.encode()) % 10_000 for _, x in target for g in grams(cut(x)))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    out = []
    for (i, text), h in zip(docs, hashed, strict=True):
        u = (int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[b] for b in h)
        out.append([i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(cut(text))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for n, r in enumerate(fit[: 30 * len(fit) // 100], 1):
        r[4] = n
    return [tuple(r) for r in out]


def test_resample(docs, items):
    made = resampling.resample(docs, items, share=(30, 100))
    assert key([tuple(r) for r in made.collect()]) == key(plain_resample(pairs(docs), pairs(items, "item_id")))


def test_resample_without_rows(docs, items):
    assert resampling.resample(docs.limit(0), items).collect() == []
    assert resampling.resample(docs, items.limit(0)).count() == docs.count()


# ---- op12

@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 49407), st.integers(0, 3)), max_size=60), max_size=8))
def test_coder_round_trip(blocks):
    coder = id_coder.Coder(49408)
    blocks = [np.array(b, dtype=np.int64) for b in blocks]
    made = coder.decode(coder.encode(blocks), [len(b) for b in blocks])
    assert [m.tolist() for m in made] == [b.tolist() for b in blocks]


def test_coder_carries_and_shrinks():
    rng = np.random.default_rng(0)
    coder = id_coder.Coder(1 << 16, lanes=7)
    blocks = [rng.integers(0, 1 << 16, 3000) for _ in range(20)] + [np.tile([5, 9, 65535], 1000), np.zeros(1, dtype=np.int64)]
    made = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(coder.decode(made, [len(b) for b in blocks]), blocks, strict=True))
    assert len(made[20]) * 8 < 0.5 * len(blocks[20])  # a repeated run costs next to nothing
    with pytest.raises(ValueError):
        id_coder.Coder(100).encode([np.array([100])])


def test_token_ids_equal_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    token_output.write_ids(docs, str(tmp_path / "ids"))
    made = token_output.read_ids(spark, str(tmp_path / "ids")).collect()
    raw = lambda t: struct.pack(f"<{len(x := [*library.encode(t or '', add_special_tokens=False).ids, 2])}I", *x)
    assert key([(r["doc_id"], bytes(r["ids"])) for r in made]) == key([(i, raw(t)) for i, t in pairs(docs)])
    made.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in made] == sorted((r["doc_id"] for r in made), key=lambda x: (x is not None, x))
    assert [r["start"] for r in made] == np.r_[0, np.cumsum([r["n_tokens"] for r in made])[:-1]].tolist()


def test_token_ids_of_no_rows_and_damage(spark, docs, tmp_path):
    token_output.write_ids(docs.limit(0), str(tmp_path / "none"))
    assert token_output.read_ids(spark, str(tmp_path / "none")).collect() == []
    token_output.write_ids(docs, str(tmp_path / "ids"))
    file = sorted((tmp_path / "ids").glob("*.ids"))[0]
    raw = bytearray(file.read_bytes())
    raw[-3] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        token_output.read_ids(spark, str(tmp_path / "ids")).collect()


def test_written_ids_come_back(spark, tmp_path):
    rows = [(1, np.array([7, 7, 7], dtype="<u4").tobytes()), (2, b""), (3, None)]
    spark.dataSource.register(token_output.TokenIdSource)
    spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1).write.format("token_ids").option("vocabulary", 8).mode("append").save(str(tmp_path / "x"))
    assert [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_output.read_ids(spark, str(tmp_path / "x")).collect()] == [(1, 0, 3, rows[0][1]), (2, 3, 0, b""), (3, 3, 0, b"")]


def test_coder_reaches_the_entropy_of_its_shares():
    rng = np.random.default_rng(1)
    chance = 1 / np.arange(1, 3001)
    ids = rng.permutation(49408)[:3000][rng.choice(3000, 60_000, p=chance / chance.sum())]
    blocks = [ids[i : i + id_coder.BLOCK] for i in range(0, len(ids), id_coder.BLOCK)]
    counts = np.bincount(ids, minlength=49408)
    share, coder = id_coder.shares(counts), id_coder.Coder(49408)
    assert share.sum() & (share.sum() - 1) == 0 and ((share > 0) == (counts > 0)).all()
    made = coder.encode(blocks, share)
    assert all((a == b).all() for a, b in zip(coder.decode(made, [len(b) for b in blocks], share), blocks, strict=True))
    p = counts[counts > 0] / len(ids)
    assert 8 * sum(map(len, made)) < 1.06 * len(ids) * -(p * np.log2(p)).sum()
    with pytest.raises(ValueError, match="no share"):
        coder.encode([np.flatnonzero(counts == 0)[:1]], share)


@pytest.mark.parametrize("counts", [np.zeros(5), np.ones(1), np.ones(1 << 16), np.r_[10**12, np.ones(60_000), 0]])
def test_shares_add_up_to_a_power_of_two(counts):
    share = id_coder.shares(counts)
    assert ((share > 0) == (counts > 0)).all() and int(share.sum()) & (int(share.sum()) - 1) == 0


def test_all_ids_of_a_section_come_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    flat = np.r_[rng.permutation(1 << 16), np.zeros(50_000, dtype=np.int64)].astype("<u4")
    rows = [(i, part.tobytes()) for i, part in enumerate(np.array_split(flat, 30))]
    spark.dataSource.register(token_output.TokenIdSource)
    spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1).write.format("token_ids").option("vocabulary", 1 << 16).mode("append").save(str(tmp_path / "x"))
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in token_output.read_ids(spark, str(tmp_path / "x")).collect()) == rows


@pytest.fixture(scope="module")
def id_encoder():
    return token_output.Encoder("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.one_of(st.sampled_from([*"aBst1 '.,;!-_|<>\n²ª×÷éÉßÿÀÞµſİΣςÅ’“é😀\x00\xa0\u2028\u0301\u0327\x85\ufeff", "'s", "n't", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "e\u0301", "word", "Word"]), st.characters(codec="utf-8")), max_size=14).map("".join), max_size=4))
def test_chunks_equal_the_library(id_encoder, texts):
    ids, sizes = id_encoder.encode(pa.array(texts, pa.string()))
    made = [id_encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for m in made for i in m] and sizes.tolist() == [len(m) for m in made]


def test_words_are_encoded_once_whatever_follows():
    made = token_output.Encoder("word_bpe_49k.json")
    made.encode(pa.array(["Loom, loom; LOOM! loom (loom)", "<|endoftext|>loom."]))
    assert sorted(made.known.to_pylist()) == sorted(["loom", ",", ";", "!", "(loom", ")", "<|endoftext|>loom", "."])


def test_vocabularies_whose_words_hold_blanks():
    made, texts = token_output.Encoder("byte_bpe_50k.json"), ["two words, two words", "", " \n a  b", "two words, two words", None]
    ids, sizes = made.encode(pa.array(texts))
    library = [made.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for m in library for i in m] and sizes.tolist() == [len(m) for m in library]


# ---- op13

def plain_search(docs, items, best=10):
    held = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n_docs, n_terms, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if score > 0:
                scores.append((score, i))
        scores.sort(key=lambda x: (-x[0], x[1] is not None, x[1]))
        out += [(item, rank, i, score) for rank, (score, i) in enumerate(scores[:best], 1)]
    return out


@pytest.mark.parametrize(("shard", "block"), [(1024, 2000), (8, 3)])
def test_search(docs, items, monkeypatch, shard, block):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(lexical_search, "FIRST_SHARDS", 1)
    made = lexical_search.search(lexical_search.build(docs), items)
    assert key([tuple(r) for r in made.collect()]) == key(plain_search(pairs(docs), pairs(items, "item_id")))


def test_search_without_rows(docs, items):
    assert lexical_search.search(lexical_search.build(docs.limit(0)), items).collect() == []
    assert lexical_search.search(lexical_search.build(docs), items.limit(0)).collect() == []


def test_bisection_keeps_like_documents_together():
    rng = random.Random(1)
    kinds = [[f"{k}{i}".encode() for i in range(40)] for k in "abcd"]
    sample = [lexical_search._slots(set(rng.sample(kinds[n % 4], 25))) for n in range(200)]
    tree = lexical_search.Bisection.fit(sample, depth=2)
    leaves = [tree.route(s)[0] for s in sample]
    assert sum(Counter(leaves[k::4]).most_common(1)[0][1] for k in range(4)) >= 180
