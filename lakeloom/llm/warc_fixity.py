"""Merkle fixity audit of WARC replicas.

Records are laid out in files of about ``file_records`` records (dealt by content hash, so that no key makes a large
file), each with its byte range. A leaf is the SHA-256 of a record; a node is the SHA-256 of its children's hashes and of
the byte range that they cover, ``FANOUT`` children to a node, up to a root for each file and on to a root of the
archive. An audit compares two replicas' roots and goes down only where nodes differ, level by level, as a join with the
children of the nodes that differ; what it ends with are the byte ranges that are corrupt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

FANOUT = 16


def record(url: Column, page: Column, body: Column) -> Column:
    """The text of a WARC response record; its UTF-8 bytes are what is stored."""
    body = F.coalesce(body, F.lit(""))
    head = [F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: ")]
    return F.concat(*head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def layout(pages: DataFrame, replica_html: Column | None = None, file_records: int = 512) -> DataFrame:
    """``page_id, copies, warc_file, seq, start, end, hash, replica_hash``: where each distinct record stands.

    Records that are alike are one record with a count. ``seq`` orders a file by page id, then hash. ``replica_hash`` is
    that of the record with another body, ``replica_html``. Bodies are read once and go no further than their hashes.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    text = record(F.col("url"), F.col("page_id"), F.col("html"))
    other = text if replica_html is None else record(F.col("url"), F.col("page_id"), replica_html)
    rows = rows.select("page_id", F.sha2(text.cast("binary"), 256).alias("hash"), F.sha2(other.cast("binary"), 256).alias("replica_hash"), F.octet_length(text).cast("long").alias("length"))
    distinct = cut(rows.groupBy("hash").agg(F.min("page_id").alias("page_id"), F.min("replica_hash").alias("replica_hash"), F.min("length").alias("length"), F.count("*").alias("copies")))
    files = max(1, -(-distinct.count() // file_records))
    placed = distinct.withColumn("warc_file", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % files)
    order = Window.partitionBy("warc_file").orderBy("page_id", "hash")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("page_id", "copies", "warc_file", (F.row_number().over(order) - 1).cast("long").alias("seq"), (end - F.col("length")).alias("start"), end.alias("end"), "hash", "replica_hash")


@dataclass
class Tree:
    """Nodes ``file, idx, start, end, hash`` by level, leaves first; from level ``file_levels`` on, ``idx`` counts files."""

    levels: list[DataFrame]
    file_levels: int

    def roots(self, name: str) -> DataFrame:
        """``warc_file`` and the hash at the top of each file's tree."""
        return self.levels[self.file_levels - 1].select(F.col("file").alias("warc_file"), F.col("hash").alias(name))


def _parents(nodes: DataFrame, file: Column) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("idx", "start", "end", "hash")))  # FANOUT children at most
    parts = F.transform("c", lambda x: F.concat_ws(":", x["hash"], x["start"], x["end"]))
    return (
        nodes.groupBy(file.alias("file"), F.floor(F.col("idx") / FANOUT).alias("up")).agg(children.alias("c"))
        .select("file", F.col("up").alias("idx"), F.col("c")[0]["start"].alias("start"), F.element_at("c", -1)["end"].alias("end"), F.sha2(F.concat_ws("|", parts).cast("binary"), 256).alias("hash"))
    )


def tree(leaves: DataFrame) -> Tree:
    """The tree over ``warc_file, seq, start, end, hash``."""
    now = cut(leaves.select(F.col("warc_file").alias("file"), F.col("seq").alias("idx"), "start", "end", "hash"))
    levels = [now]
    width = now.groupBy("file").agg(F.max("idx").alias("m")).agg(F.max("m")).first()[0]
    while width:  # up to the root of each file
        now = cut(_parents(now, F.col("file")))
        levels.append(now)
        width //= FANOUT
    file_levels = len(levels)
    if levels[0].isEmpty():
        return Tree(levels, file_levels)
    now = now.select(F.lit(0).cast("long").alias("file"), F.col("file").alias("idx"), F.lit(0).cast("long").alias("start"), "end", "hash")
    width = now.agg(F.max("idx")).first()[0]
    levels.append(now)
    while width:
        now = cut(_parents(now, F.lit(0).cast("long")))
        levels.append(now)
        width //= FANOUT
    return Tree(levels, file_levels)


def descent(left: Tree, right: Tree) -> list[tuple[int, DataFrame]]:
    """The levels that an audit looks at, from the top: nodes ``file, idx`` of both sides that were compared, and ``differs``.

    The top is the highest level that both trees have. Where files have trees of unlike height that is the root of the
    lower one's files, else the lower one's top; from there only the children of nodes that differ are looked at.
    """

    def compared(level: int, within: DataFrame | None) -> DataFrame:
        sides = []
        for name, t in (("left", left), ("right", right)):
            nodes = t.levels[level].select("file", "idx", *(F.col(c).alias(f"{name}_{c}") for c in ("start", "end", "hash")))
            sides.append(nodes if within is None else nodes.withColumn("up", F.floor(F.col("idx") / FANOUT)).join(within, ["file", "up"], "left_semi").drop("up"))
        same = F.col("left_hash").eqNullSafe(F.col("right_hash")) & F.col("left_start").eqNullSafe(F.col("right_start")) & F.col("left_end").eqNullSafe(F.col("right_end"))
        return sides[0].join(sides[1], ["file", "idx"], "full").withColumn("differs", ~same)

    alike = left.file_levels == right.file_levels
    top = min(len(left.levels), len(right.levels)) if alike else min(left.file_levels, right.file_levels)
    steps: list[tuple[int, DataFrame]] = []
    for level in range(top - 1, -1, -1):
        within = None
        if steps:
            found = steps[-1][1].where("differs")
            if found.isEmpty():
                break
            # from files as nodes to the root of each file, else from nodes to their children
            within = found.select(F.col("idx").alias("file"), F.lit(0).cast("long").alias("up")) if level == left.file_levels - 1 else found.select("file", F.col("idx").alias("up"))
        steps.append((level, cut(compared(level, within))))
    return steps


def audit(left: Tree, right: Tree) -> DataFrame:
    """``file, seq, start, end, left_hash, right_hash`` of the leaves that differ (a null hash: missing on that side)."""
    level, last = descent(left, right)[-1]
    found = last.where("differs" if level == 0 else "false")
    return found.select("file", F.col("idx").alias("seq"), F.coalesce("left_start", "right_start").alias("start"), F.coalesce("left_end", "right_end").alias("end"), "left_hash", "right_hash")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Leaves ``warc_file, seq, start, end, hash`` of WARC files, gzipped by record or plain, numbered by path.

    One task reads a file, and in time that is linear; a record that does not parse ends its file with a leaf for the
    bytes that are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, at, rows = content.as_py(), 0, []
                view = memoryview(data)
                while at < len(data):
                    if data[at : at + 2] == b"\x1f\x8b":
                        member, end = zlib.decompressobj(31), at
                        try:
                            while end < len(data) and not member.eof:
                                member.decompress(view[end : end + 16384])
                                end += 16384
                            end = min(end, len(data)) - len(member.unused_data)
                        except zlib.error:
                            end = len(data)
                    else:
                        head = data.find(b"\r\n\r\n", at)
                        field = [x for x in data[at : max(at, head)].lower().split(b"\r\n") if x.startswith(b"content-length:")]
                        size = field[0].split(b":", 1)[1].strip() if field else b""
                        end = min(head + 8 + int(size), len(data)) if size.isdigit() else len(data)
                    rows.append((name, at, end, hashlib.sha256(view[at:end]).hexdigest()))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(range(len(rows)), pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)), pa.array([r[3] for r in rows], pa.string())], ["path", "seq", "start", "end", "hash"])

    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", "content").mapInArrow(run, "path string, seq long, start long, end long, hash string")
    numbers = files.select("path").withColumn("warc_file", F.row_number().over(Window.orderBy("path")) - 1)  # one row a file
    return rows.join(numbers, "path").select(F.col("warc_file").cast("long").alias("warc_file"), "seq", "start", "end", "hash", "path")


def audit_pages(pages: DataFrame, damaged: Column | None = None) -> DataFrame:
    """``page_id, copies, warc_file, seq, start, end, hash, corrupt, root, replica_root`` for each distinct record.

    The replica is the archive as it would be read back, in which the first byte of the bodies that ``damaged`` names is
    overwritten; the roots are those of the record's file. Null urls and bodies count as empty; a null page id is a record like another; rows that repeat are one
    record with a count; an empty table gives no rows; other columns do not matter.
    """
    damaged = F.coalesce(F.lit(False) if damaged is None else damaged, F.lit(False)) & (F.length("html") > 0)
    read = F.when(damaged, F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    placed = cut(layout(pages, read))
    replica = placed.select("warc_file", "seq", "start", "end", F.col("replica_hash").alias("hash"))
    left, right = tree(placed), tree(replica)
    bad = audit(left, right).select(F.col("file").alias("warc_file"), "seq", F.lit(True).alias("bad"))
    roots = left.roots("root").join(right.roots("replica_root"), "warc_file")
    out = placed.join(bad, ["warc_file", "seq"], "left").join(roots, "warc_file")
    return out.select("page_id", "copies", "warc_file", "seq", "start", "end", "hash", F.coalesce("bad", F.lit(False)).alias("corrupt"), "root", "replica_root")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, and which of them an audit against a damaged replica finds corrupt."""
    return audit_pages(table(spark, sf_dir, "pages"), F.col("page_id") % 97 == 13)


def _level_sql(name: str, below: str) -> str:
    parts = ", ".join(f"sha256(string_agg({h} || ':' || s || ':' || e, '|' ORDER BY idx)) AS {h}" for h in ("hash", "replica"))
    return f"{name} AS (SELECT warc_file, idx // {FANOUT} AS idx, min(s) AS s, max(e) AS e, {parts} FROM {below} GROUP BY warc_file, idx // {FANOUT})"


#: The tables of the audit, with trees of up to three levels above the records (4,096 records to a file).
OP5_SQL = f"""
WITH b AS (SELECT page_id, url, coalesce(html, '') AS html, coalesce(page_id % 97 = 13, FALSE) AND length(coalesce(html, '')) > 0 AS bad FROM pages),
c AS (
  SELECT page_id, bad, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, CASE WHEN bad THEN '#' || substr(html, 2) ELSE html END AS other FROM b),
r AS (SELECT page_id, bad, head || strlen(html) || gap || html || gap AS rec, head || strlen(other) || gap || other || gap AS rec2 FROM c),
d AS (SELECT min(page_id) AS page_id, bool_or(bad) AS bad, sha256(rec) AS hash, min(sha256(rec2)) AS replica, min(strlen(rec)) AS length, count(*) AS copies FROM r GROUP BY sha256(rec)),
f AS (SELECT *, CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / 512.0) AS BIGINT)) FROM d) AS warc_file FROM d),
o AS (SELECT *, sum(length) OVER w AS e, row_number() OVER w - 1 AS idx FROM f WINDOW w AS (PARTITION BY warc_file ORDER BY page_id NULLS FIRST, hash ROWS UNBOUNDED PRECEDING)),
l0 AS (SELECT warc_file, idx, CAST(e - length AS BIGINT) AS s, CAST(e AS BIGINT) AS e, hash, replica FROM o),
{_level_sql("l1", "l0")},
{_level_sql("l2", "l1")},
{_level_sql("l3", "l2")},
t AS (SELECT CASE WHEN max(idx) = 0 THEN 0 WHEN max(idx) < 16 THEN 1 WHEN max(idx) < 256 THEN 2 ELSE 3 END AS level FROM l0),
k AS (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3),
roots AS (SELECT warc_file, hash AS root, replica AS replica_root FROM k WHERE level = (SELECT level FROM t))
SELECT page_id, copies, o.warc_file, o.idx AS seq, CAST(e - length AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", hash, bad AS corrupt, root, replica_root
FROM o JOIN roots ON o.warc_file = roots.warc_file
"""
