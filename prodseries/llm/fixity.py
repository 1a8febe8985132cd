"""Merkle fixity audit of archive replicas.

The records of each file are leaves, in the order of their offsets. A node of level 0 covers a range of LEAF bytes of
offsets and hashes what starts in it (offset, length and digest of each record); a node of the next level covers FANOUT
of these and hashes their digests; the root hashes what is left at the top. An audit compares the roots of two replicas
and then descends, level by level, only below nodes that differ; the records of the leaves that it ends in are compared
one by one.

Trees are stored as tables (file, level, node, digest), so that an audit reads records only where replicas differ. Every
grouping is bounded: by the records that start in LEAF bytes, and by FANOUT children.

Records: file, offset, length, record_id, digest. Cases: rows with a null file or offset have no place in an order and
are not looked at; a null digest counts as an empty one; exact repeats of a record at one place count once; several
records at one offset are all hashed, in the order of their ids; a file that one replica lacks altogether is reported
record by record; replicas without records have no roots and agree. Pages: each row is a record of its own, repeated
ones too; a null url or html is empty; an empty table has no records; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodseries.llm.storage import stored

#: Pages of a file from which it is split by content.
MOST_PAGES = 16_000
#: Bytes of offsets under a leaf node, children of a node, and levels: 1 MB x 16^5 is a TiB a top node.
LEAF, FANOUT, LEVELS = 1 << 20, 16, 6


def layout(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """Where the records of pages (page_id, url, html) lie in an archive, and what their bytes hash to, in it and in a
    replica that has suffered: file, offset, record_id, length, digest, worn_length, worn_digest, added_length, added_digest.

    A file takes the records of per_file page ids, in their order; pages without an id are dealt by a hash to files of
    about per_file pages. A file of more than MOST_PAGES different pages is split by content, and equal pages are one
    row until their offsets are known: no window holds more than a file's different pages. The bytes themselves are
    hashed where they are read and go through no shuffle.
    """
    url, html, page = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")), F.col("page_id")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    nameless = -(-pages.where("page_id IS NULL").count() // per_file)
    content = F.conv(F.substring(F.md5(F.concat(url, html)), 1, 8), 16, 10).cast("long")
    spread = F.concat(F.lit("none-"), F.pmod(content, F.lit(max(1, nameless))).cast("string"))
    file = F.coalesce(F.concat(F.lit("pages-"), F.floor(page / per_file).cast("string")), spread)
    mark = F.substring(F.md5(F.concat(url, F.lit(" "), F.coalesce(page.cast("string"), F.lit("")))), 1, 1)
    bytes_ = pages.select(file.alias("file"), page.alias("record_id"), content.alias("content"), mark.alias("mark"), head.alias("head"), html.alias("html"))
    bytes_ = bytes_.withColumn("payload", F.concat("head", "html", F.lit("\r\n\r\n")))
    rows = bytes_.select("file", "record_id", "content", *_hashed_as("", F.col("payload")), *_hashed_as("worn_", worn_payload()), *_hashed_as("added_", added_payload()))
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    parts = once.groupBy("file").agg(F.ceil(F.count("*") / MOST_PAGES).alias("parts")).where("parts > 1").withColumnRenamed("file", "_file")
    once = once.join(parts, F.col("file") == F.col("_file"), "left")
    once = once.withColumn("file", F.when(F.col("parts") > 1, F.concat("file", F.lit("-"), F.pmod("content", "parts").cast("string"))).otherwise(F.col("file")))
    order = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("first", F.coalesce(F.sum(F.col("length") * F.col("n")).over(order), F.lit(0)))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    hashes = [f"{p}{c}" for p in ("", "worn_", "added_") for c in ("length", "digest")]
    return copies.select("file", (F.col("first") + F.col("copy") * F.col("length")).alias("offset"), "record_id", *hashes)


def _hashed_as(prefix: str, payload: F.Column) -> list[F.Column]:
    return [F.octet_length(payload).cast("long").alias(f"{prefix}length"), F.sha2(payload, 256).alias(f"{prefix}digest")]


def worn_payload() -> F.Column:
    """The bytes of a record in a replica that has suffered, from its mark: of 16 records two have another character in
    the middle of the html, one ends there, and one is gone."""
    middle = F.length("head") + F.floor(F.length("html") / 2).cast("int")
    at = F.substring("payload", middle + 1, F.lit(1))
    other = F.concat(F.substring("payload", F.lit(1), middle), F.when(at == "x", "y").otherwise("x"), F.substring("payload", middle + 2, F.length("payload")))
    cut = F.substring("payload", F.lit(1), middle)
    mark = F.col("mark")
    return F.when(mark.isin("a", "7"), other).when(mark == "3", cut).when(mark != "b", F.col("payload"))


def added_payload() -> F.Column:
    """One record of 16 has a copy with more, behind the file's end."""
    return F.when(F.col("mark") == "c", F.concat("payload", F.lit("again")))


def index(placed: DataFrame) -> DataFrame:
    """The records of layout() in the archive."""
    return placed.select("file", "offset", "length", "record_id", "digest")


def records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    return index(layout(pages, per_file))


def worn(placed: DataFrame) -> DataFrame:
    """The records of layout() in the replica, each with the hash of its own bytes there."""
    kept = placed.where("worn_digest IS NOT NULL").select("file", "offset", F.col("worn_length").alias("length"), "record_id", F.col("worn_digest").alias("digest"))
    end = placed.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("end"))
    added = placed.where("added_digest IS NOT NULL").join(end, "file")
    return kept.unionByName(added.select(
        "file", (F.col("offset") + F.col("end")).alias("offset"), F.col("added_length").alias("length"), "record_id", F.col("added_digest").alias("digest")))


def _placed(replica: DataFrame) -> DataFrame:
    rows = replica.where("file IS NOT NULL AND offset IS NOT NULL")
    return rows.select("file", "offset", "length", "record_id", F.coalesce("digest", F.lit("")).alias("digest")).distinct()


def _node(level: int) -> F.Column:
    return F.floor(F.col("offset") / (LEAF * FANOUT**level)).cast("long")


def tree(replica: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(file, level, node, digest) of a replica; the root has level `levels` and node 0."""
    text = F.concat_ws(":", F.col("offset"), F.col("length"), F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.col("digest"))
    leaf = _placed(replica).select("file", _node(0).alias("node"), F.struct("offset", text.alias("text")).alias("child"))
    level = stored(_hashed(leaf, 0), "leaves")  # the levels above are made from this small table
    all_levels = level
    for k in range(1, levels + 1):
        up = F.floor(F.col("node") / FANOUT).cast("long") if k < levels else F.lit(0).cast("long")
        child = F.struct(F.col("node").alias("offset"), F.concat_ws(":", "node", "digest").alias("text"))
        level = _hashed(level.select("file", up.alias("node"), child.alias("child")), k)
        all_levels = all_levels.unionByName(level)
    return all_levels


def _hashed(children: DataFrame, level: int) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["text"]), ";")
    return children.groupBy("file", "node").agg(F.sha2(joined, 256).alias("digest")).select("file", F.lit(level).alias("level"), "node", "digest")


def audit(first: DataFrame, second: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Where the second replica differs from the first: file, offset, length, record_id, damage.

    damage: 'altered' (another digest or length), 'missing' or 'extra' (in the second).
    """
    one, two = stored(tree(first, levels), "tree"), stored(tree(second, levels), "tree")
    below = None
    for k in range(levels, -1, -1):
        left = one.where(F.col("level") == k).select("file", "node", F.col("digest").alias("left"))
        right = two.where(F.col("level") == k).select("file", "node", F.col("digest").alias("right"))
        if below is not None:
            up = F.floor(F.col("node") / FANOUT).cast("long") if k < levels - 1 else F.lit(0).cast("long")
            left, right = (x.withColumn("up", up).join(below, ["file", "up"], "left_semi").drop("up") for x in (left, right))
        differ = left.join(right, ["file", "node"], "full").where(~F.col("left").eqNullSafe(F.col("right")))
        below = stored(differ.select("file", F.col("node").alias("up")), "differ")
    leaves = below.withColumnRenamed("up", "node")
    sides = []
    for replica, name in ((first, "a"), (second, "b")):
        rows = _placed(replica).withColumn("node", _node(0)).join(leaves, ["file", "node"], "left_semi")
        id_ = F.coalesce(F.col("record_id").cast("string"), F.lit(""))
        sides.append(rows.select("file", "offset", id_.alias("id"), "record_id", F.struct("length", "digest").alias(name)))
    both = sides[0].join(sides[1].withColumnRenamed("record_id", "other"), ["file", "offset", "id"], "full")
    damage = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "altered")
    return both.select(
        "file", "offset", F.coalesce("a.length", "b.length").alias("length"), F.coalesce("record_id", "other").alias("record_id"), damage.alias("damage"),
    ).where("damage IS NOT NULL")


# The damage of worn(), found without trees and without hashing a replica.
SQL = r"""
WITH n AS (SELECT greatest(1, ceil(count(*) / 1000))::BIGINT AS files FROM pages WHERE page_id IS NULL),
r AS (
  SELECT coalesce('pages-' || floor(page_id / 1000)::BIGINT::VARCHAR, 'none-' || (('0x' || md5(coalesce(url, '') || coalesce(html, ''))[1:8])::BIGINT % n.files)::VARCHAR) AS file,
         page_id AS record_id, md5(coalesce(url, '') || ' ' || coalesce(page_id::VARCHAR, ''))[1] AS mark,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'Content-Length: '
         || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS whole
  FROM pages, n),
p AS (
  SELECT *, strlen(whole)::BIGINT AS length, (sum(strlen(whole)) OVER (PARTITION BY file))::BIGINT AS total,
         coalesce(sum(strlen(whole)) OVER (PARTITION BY file ORDER BY record_id NULLS FIRST, sha256(whole) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM r)
SELECT file, "offset", length, record_id, CASE mark WHEN 'b' THEN 'missing' ELSE 'altered' END AS damage FROM p WHERE mark IN ('a', '7', '3', 'b')
UNION ALL
SELECT file, "offset" + total, length + 5, record_id, 'extra' FROM p WHERE mark = 'c'
"""
