"""Merkle fixity audit of WARC replicas: hash trees over records and ordered offset ranges, descended where they differ.

A replica's manifest has a row per record: file, id, copy (of equal ids), offset, length and SHA-256 of its bytes. In the
order of offsets, a record whose id hashes to a multiple of `fanout` starts a new range, a leaf; one whose hash is a multiple
of fanout ** 2 starts a node of leaves as well, and so on up to the file's root. A range is named by the record that starts
it, and its hash is over its records' ids, lengths, digests and offsets from its own start, so that a change, a loss or an
insertion alters the ranges that hold it and no others. A node's hash is that of its children in order. An audit compares
roots, then only the children of nodes that differ, and at last the records of the leaves that differ; all else is settled
by the node that matched, whose start says whether its records have moved. DataFrame expressions, but for reading raw files.

Status of a record: ok, changed (same place in the order of ids, other bytes), moved (same bytes, other offset), missing
(not in the replica), extra (only in the replica).

Each level is a written table, so the plan of a level does not hold those below it.

Defined cases: null url or html are empty; a null id gets a file by a hash of its content; repeated rows are copies of one
id, numbered in the order of their digests; an empty manifest against another makes all its records missing. Bytes of a
file that don't start a record end its parsing; the rest is one record without an id. A record of any length is one row of
a manifest; its bytes are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.session import Staged


@dataclass(frozen=True)
class Fixity:
    """fanout: records of a leaf and children of a node, on average; levels of nodes above the leaves, below the root; per_file: ids of a written file."""

    fanout: int = 16
    levels: int = 2
    per_file: int = 512


KEY = ["file", "id", "copy"]
#: Writes a table and reads it again; by default into the shared folder.
Table = Callable[[DataFrame], DataFrame]


def record_text(url, html):
    """A resource record of WARC/1.1 as text."""
    u, h = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), u)
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(h).cast("string"), F.lit("\r\n\r\n"), h, F.lit("\r\n\r\n"))


def manifest(hashed: DataFrame) -> DataFrame:
    """hashed(file, id, length, digest) with copy and offset: records stand in the order of id and digest."""
    numbered = hashed.withColumn("copy", F.row_number().over(W.partitionBy("file", "id").orderBy("digest")))
    before = F.sum("length").over(W.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "copy").rowsBetween(W.unboundedPreceding, -1))
    return numbered.select(*KEY, F.coalesce(before, F.lit(0)).alias("offset"), "length", "digest")


def hash_pages(pages: DataFrame, p: Fixity = Fixity()) -> DataFrame:
    """pages(page_id, url, html) to file, id, length, digest of their records."""
    odd = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1024))
    file = F.coalesce(F.floor(F.col("page_id") / p.per_file), odd).cast("long")
    rec = pages.select(file.alias("file"), F.col("page_id").cast("long").alias("id"), record_text(F.col("url"), F.col("html")).alias("r"))
    return rec.select("file", "id", F.octet_length("r").cast("long").alias("length"), F.sha2(F.col("r").cast("binary"), 256).alias("digest"))


def _names(p: Fixity) -> list[str]:
    """Columns that name a record's ranges: k0 the leaf, then the nodes above it, last the file's root."""
    return [f"k{level}" for level in range(p.levels + 2)]


def ranged(m: DataFrame, p: Fixity = Fixity()) -> DataFrame:
    """A manifest with k0, k1, ...: of each level the record that starts the range, '' for the file's first."""
    h = F.pmod(F.xxhash64(F.col("id").cast("string"), "copy"), F.lit(p.fanout ** (p.levels + 1)))
    name = F.concat_ws("#", F.col("id").cast("string"), F.col("copy").cast("string"))
    upto = W.partitionBy("file").orderBy("offset", F.col("id").asc_nulls_first(), "copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    *inner, root = _names(p)
    starts = [F.coalesce(F.last(F.when(h % p.fanout ** (k + 1) == 0, name), ignorenulls=True).over(upto), F.lit("")).alias(c) for k, c in enumerate(inner)]
    return m.select("*", *starts, F.lit("").alias(root))


def tree(m: DataFrame, p: Fixity = Fixity(), table: Table | None = None) -> list[DataFrame]:
    """Of ranged records the nodes of each level, leaves first: file, the names of the node and of those above it, start, hash."""
    names, out, table = _names(p), [], table or Staged(m.sparkSession).write
    kids = m.select("file", *names, "offset", F.to_json(F.struct("id", "copy", "length", "digest")).alias("kid"))
    for level in range(len(names)):
        own = names[level:]
        # the offsets are taken from the range's start, which the same aggregation finds
        nodes = kids.groupBy("file", *own).agg(F.min("offset").alias("start"), F.array_sort(F.collect_list(F.struct("offset", "kid"))).alias("kids"))
        line = F.concat_ws("|", F.transform("kids", lambda k: F.concat_ws(":", (k["offset"] - F.col("start")).cast("string"), k["kid"])))
        nodes = table(nodes.select("file", *own, "start", F.sha2(line, 256).alias("hash")))
        out.append(nodes)
        kids = nodes.select("file", *own[1:], F.col("start").alias("offset"), F.col("hash").alias("kid"))
    return out


def descend(a: list[DataFrame], b: list[DataFrame], p: Fixity = Fixity(), table: Table | None = None) -> list[DataFrame]:
    """Of each level, leaves first: the nodes (file, name, same, moved) that were compared, which are the children of nodes that differ."""
    names, out, bad, table = _names(p), [], None, table or Staged(a[0].sparkSession).write
    for level in range(len(a) - 1, -1, -1):
        own, above = names[level], names[level + 1] if bad is not None else None
        x, y = (t.join(bad, ["file", above], "left_semi") if above else t for t in (a[level], b[level]))
        x = x.select("file", own, "start", "hash")
        y = y.select("file", own, F.col("start").alias("_start"), F.col("hash").alias("_hash"))
        same = F.col("hash").eqNullSafe(F.col("_hash"))
        seen = table(x.join(y, ["file", own], "full_outer").select("file", own, same.alias("same"), F.coalesce(F.col("start") != F.col("_start"), F.lit(False)).alias("moved")))
        bad = seen.filter("not same").select("file", own)
        out.append(seen)
    return out[::-1]


def mismatches(a: list[DataFrame], b: list[DataFrame], p: Fixity = Fixity(), table: Table | None = None) -> DataFrame:
    """(file, k0) of the leaves that differ; below the roots, only children of nodes that differ are compared."""
    return descend(a, b, p, table)[0].filter("not same").select("file", "k0")


def audit(a: DataFrame, b: DataFrame, p: Fixity = Fixity(), table: Table | None = None) -> DataFrame:
    """Manifests of a replica and of another to KEY, offset, length, digest (of the first; of the other for extras) and status."""
    names, table = _names(p), table or Staged(a.sparkSession).write
    a, b = (table(ranged(m, p)) for m in (a, b))
    trees = [tree(m, p, table) for m in (a, b)]
    seen = descend(*trees, p, table)
    # the leaves under each node that matched take its word
    leaves = trees[0][0].select("file", *names)
    settled = [leaves.join(s.filter("same").select("file", k, "moved"), ["file", k]).select("file", "k0", "moved") for k, s in zip(names, seen, strict=True)]
    settled = table(reduce(DataFrame.union, settled))
    bad = seen[0].filter("not same").select("file", "k0")
    y = b.join(bad, ["file", "k0"], "left_semi").select(*(F.col(c).alias(f"_{c}") for c in (*KEY, "offset", "length", "digest")))
    x = a.join(bad, ["file", "k0"], "left_semi")
    same = (x["file"] == y["_file"]) & x["id"].eqNullSafe(y["_id"]) & (x["copy"] == y["_copy"])
    both = x.join(y, same, "full_outer")
    status = F.when(F.col("_file").isNull(), "missing").when(F.col("file").isNull(), "extra").when(F.col("digest") != F.col("_digest"), "changed").when(F.col("offset") != F.col("_offset"), "moved").otherwise("ok")
    found = both.select(*(F.coalesce(c, f"_{c}").alias(c) for c in (*KEY, "offset", "length", "digest")), status.alias("status"))
    rest = a.join(settled, ["file", "k0"]).select(*KEY, "offset", "length", "digest", F.when(F.col("moved"), "moved").otherwise("ok").alias("status"))
    return found.unionByName(rest)


def parse(data: bytes) -> Iterator[tuple[str | None, int, int, str]]:
    """(record id, offset, length, digest) of the records of a WARC file."""
    at, n = 0, len(data)
    while at < n:
        head = data.find(b"\r\n\r\n", at)
        fields: dict[bytes, bytes] = {}
        if data[at : at + 5] == b"WARC/" and head >= 0:
            for line in data[at:head].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                fields[k.strip().lower()] = v.strip()
        size = fields.get(b"content-length", b"")
        end = head + 4 + int(size) + 4 if size.isdigit() else n
        end = min(end, n)
        name = fields.get(b"warc-record-id")
        yield name.decode("utf-8", "replace") if size.isdigit() and name is not None else None, at, end - at, hashlib.sha256(data[at:end]).hexdigest()
        at = end


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the WARC files (uncompressed) of a folder; a file is one task's, so at most some hundred MB each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                rows = list(parse(data.as_py()))
                if rows:
                    ids, offs, sizes, digests = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array([name] * len(rows)), pa.array(ids, pa.string()), pa.array(offs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests)], ["file", "id", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    rows = files.mapInArrow(run, "file string, id string, offset long, length long, digest string")
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("file", "id").orderBy("offset"))).select(*KEY, "offset", "length", "digest")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, by a hash of the id modulo 64: 1 has a blank more, 2 is not there."""
    m = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 64
    m = F.coalesce(m, F.lit(0))
    return pages.select("page_id", "url", F.when(m == 1, F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).otherwise(F.col("html")).alias("html"), m.alias("m")).filter("m <> 2").drop("m")


def audit_pages(pages: DataFrame, p: Fixity = Fixity(), table: Table | None = None) -> DataFrame:
    """The pages as WARC records against the damaged replica: page_id, file, copy, offset, length, digest, status."""
    a, b = (manifest(hash_pages(x, p)) for x in (pages, damaged(pages)))
    return audit(a, b, p, table).select(F.col("id").alias("page_id"), "file", "copy", "offset", "length", "digest", "status")


FIXITY_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 64 AS m FROM pages),
u AS (SELECT page_id, page_id // 512 AS file, 0 AS side, url, h FROM p UNION ALL SELECT page_id, page_id // 512, 1, url, CASE WHEN m = 1 THEN h || ' ' ELSE h END FROM p WHERE m <> 2),
r AS (SELECT page_id, file, side, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM u),
d AS (SELECT page_id, file, side, strlen(r)::BIGINT AS length, sha256(r) AS digest FROM r),
o AS (SELECT *, (sum(length) OVER (PARTITION BY file, side ORDER BY page_id) - length)::BIGINT AS "offset" FROM d),
a AS (SELECT * FROM o WHERE side = 0), b AS (SELECT * FROM o WHERE side = 1)
SELECT a.page_id, a.file::BIGINT AS file, 1 AS copy, a."offset", a.length, a.digest, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'changed' WHEN a."offset" <> b."offset" THEN 'moved' ELSE 'ok' END AS status
FROM a LEFT JOIN b ON a.page_id = b.page_id
"""
