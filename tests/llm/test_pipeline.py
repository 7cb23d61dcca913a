"""The pipeline against a plain version of it on a small fixture."""

import random

import corpus_pipeline
from lakeloom.llm import common, decontamination, sentencepiece_codec, simhash
from pyspark.sql import functions as F

from .test_operators import pairs, plain_coverage, plain_dedup, prose


def test_pipeline_matches_plain_stages(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(rng, rng.choice(["en", "fr", "de"]), rng.randint(60, 160), 8) for _ in range(80)]
    items = [prose(rng, "en", 20, 20) for _ in range(3)]
    passage = prose(rng, "fr", 70, 35)
    texts += [texts[2] + "\n" + items[0], items[1] + "\n" + texts[3], texts[4].replace("e", "i", 1), texts[5], passage + "\n" + texts[6][:50], texts[7][:60] + "\n" + passage, None, "12 34", ""]
    langs = ["en"] * len(texts)
    rows = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    now = docs
    seen = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{n}"))
        out = spark.read.parquet(str(tmp_path / f"s{n}"))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        seen.append((name, now, out))
        now = out
    by = {name: (dict(pairs(a)), b) for name, a, b in seen}

    before, after = by["language_id"]
    assert set(before) - {i for i, _ in pairs(after)} == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}

    _, frame, out = next(s for s in seen if s[0] == "line_dedup")
    rows = [(r["doc_id"], r["k"], r["text"]) for r in frame.select("doc_id", F.xxhash64("text").alias("k"), "text").collect()]
    assert sorted((i, t) for i, t, _ in plain_dedup(rows)) == sorted(pairs(out))
    assert out.where("n_chars <> length(text)").isEmpty()

    before, after = by["near_dedup"]
    left = dict(pairs(after))
    for i in set(before) - set(left):  # what goes is like a smaller one that stays
        assert any(j < i and simhash.similarity(before[i], left[j]) >= 0.8 for j in left)
    alike = [(i, j) for i in left for j in left if i > j and simhash.similarity(left[i], left[j]) >= 0.8]
    assert not alike

    before, after = by["decontamination"]
    bad = {i for i, t in before.items() for item in items if plain_coverage(decontamination.words(item), decontamination.words(t)) >= 0.6 * len(decontamination.words(item))}
    assert bad and set(before) - {i for i, _ in pairs(after)} == bad

    before, after = by["sentencepiece"]
    codec = sentencepiece_codec.codec("piece_bpe_32k.model")
    assert {r["doc_id"]: codec.decode(r["pieces"]) for r in after.collect()} == before
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_pieces"]) for r in whole.collect()) == sorted((r["doc_id"], r["n_pieces"]) for r in after.collect())


def test_workers_let_go_of_what_other_operators_keep():
    sentencepiece_codec.codec.cache_clear()
    sentencepiece_codec.codec("piece_bpe_32k.model")
    assert list(common.tidy(lambda batches: batches, "sentencepiece")(iter("ab"))) == ["a", "b"]
    assert sentencepiece_codec.codec.cache_info().currsize == 1
    assert list(common.tidy(lambda batches: batches)(iter("ab"))) == ["a", "b"]
    assert sentencepiece_codec.codec.cache_info().currsize == 0 and not common._held
    sentencepiece_codec.codec("piece_bpe_32k.model")
    assert set(common._held) == {"sentencepiece"}
