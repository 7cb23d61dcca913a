"""Importance resampling towards a target distribution, in Spark SQL functions alone.

A document's features are the runs of 1 to ``longest`` consecutive words, hashed into buckets. Counts of the buckets over
all documents and over the target texts give each bucket a gain (the log ratio of its shares there and here), a document's
weight is the sum of its features' gains, and a seeded Gumbel value added to it makes the highest scores a draw without
replacement with chances in proportion to exp(weight / 1000).

The documents are read twice: once for the counts (partial counts of at most ``buckets`` rows a task are shuffled), once
for the weights (the gains, one row a bucket, are broadcast; one row a document is shuffled). Ranks come from a sort by
range and the numbers of rows of the partitions before, so nothing but one row for each partition comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.ordered import with_position

from .common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all ASCII but digits and small letters, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAPS), lambda w: w != "")


def features(texts: DataFrame, *keys: str, text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """``keys..., n_words, bucket``: a row for each feature of each text, repeats included; one with a null bucket for a text without words, and some besides.

    A row for each word holds the words that follow it; the array of words is behind an explode, so that Spark
    makes it once for a text and not once for each use.
    """
    taken = {k.lower() for k in keys}
    held, n_words, bucket = ("w" if "w" not in taken else "_w"), "n_words", "bucket"
    each = texts.select(*keys, F.explode(F.array(words(F.col(text_col)))).alias(held))
    size = F.size(held)
    rows = each.select(*keys, size.alias(n_words), F.arrays_zip(*(F.slice(held, i + 1, size).alias(f"w{i}") for i in range(longest))).alias("runs"))
    rows = rows.selectExpr(*(f"`{k}`" for k in keys), n_words, "inline_outer(runs)").toDF(*keys, n_words, *(f"w{i}" for i in range(longest)))
    made = []
    for n in range(1, longest + 1):
        parts = [p for i in range(n) for p in (F.lit(" "), F.col(f"w{i}"))][1:]
        made.append(F.crc32(F.concat(*parts).cast("binary")) % buckets)
    return rows.select(*keys, n_words, F.explode(F.array(*made)).alias(bucket))


def bucket_counts(texts: DataFrame, name: str, text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """``bucket`` and its number of features over all texts, where there are any."""
    return features(texts, text_col=text_col, buckets=buckets, longest=longest).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """``bucket, gain`` for each of the buckets: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), kept in the shared folder."""
    spark = docs.sparkSession
    both = cut(
        spark.range(buckets).withColumnRenamed("id", "bucket")
        .join(bucket_counts(docs, "s", text_col, buckets, longest), "bucket", "left")
        .join(bucket_counts(target, "t", target_col, buckets, longest), "bucket", "left").na.fill(0)
    )
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    one = lambda c: (F.col(c) + 1).cast("double")
    ratio = one("t") * float(total["s"] + buckets) / (one("s") * float(total["t"] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(key: Column, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hex digits of a SHA-256 of seed and key (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` for every row of ``docs``; ``rank`` is null where a row is not drawn.

    Of the rows with ``min_words`` words or more, the ``share`` (numerator, denominator; rounded down) with the highest
    scores are drawn; equal scores go to the smaller id, a null id first. Every row is drawn or not by itself, so
    repeated rows and ids get a rank each, in any order among rows that are alike in id and score. A null or empty text
    has no features and weight 0; other columns, whatever their names, do not matter; an empty table gives no rows, and
    an empty target leaves the add-one counts.
    """
    gain = F.broadcast(gains(docs, target, text_col, target_col, buckets, longest))
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    made = features(each, "row", "doc_id", buckets=buckets, longest=longest).join(gain, "bucket", "left")
    summed = made.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = summed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= min_words)
    placed = with_position(scored, F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id"), "row", name="place")
    drawn = share[0] * placed.where("fit").count() // share[1]
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place")).alias("rank"), F.col("n_words").cast("long").alias("n_words"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the texts of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in SQL; CRC-32 goes over the hex digits of each feature by the polynomial's table for half bytes (fixed values).
OP11_SQL = r"""
WITH half AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t),
texts AS (
  SELECT 'd' AS kind, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
cut AS (SELECT kind, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, doc_id, unnest(w) AS f FROM cut
  UNION ALL SELECT kind, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut
  UNION ALL SELECT kind, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM cut),
bytes AS (SELECT f, list_transform(range(0, len(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT f FROM runs)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
  xor(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) >> 4, t[(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) & 15) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, half),
counted AS (SELECT kind, doc_id, bucket FROM runs JOIN hashed USING (f)),
per AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM counted GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM per),
gain AS (SELECT bucket, floor(1000 * ln((per.t + 1)::DOUBLE * (total.s + 10000) / ((per.s + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain FROM per, total),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
scored AS (
  SELECT cut.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || cut.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weights ON cut.doc_id = weights.doc_id WHERE kind = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN rank <= 5 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank, n_words::BIGINT AS n_words
FROM scored LEFT JOIN ranked USING (doc_id)
"""
