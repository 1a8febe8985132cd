"""Near-duplicate documents by min-max hashing.

A document is its set of different word shingles. Under each permutation of the shingles' hashes both the smallest and
the largest value are kept, so that HASHES evaluations a shingle give 2 x HASHES values; each band joins ROWS of them.
Two sets of similarity s agree in a band with probability s^ROWS: at 0.8 a pair is missed with probability
(1 - 0.8^7)^56, two in a million, and above that more rarely.

1. Documents with equal sets form a class; from here on only its smallest document counts.
2. In each bucket (equal band) every member is compared with the bucket's smallest: pairs grow with the members only.
3. What links is joined to components. Members of a bucket that are still in different components and were not compared
   yet are held against each other by their signatures, whose share of equal values estimates the similarity without
   bias; pairs down to four standard deviations below the limit are compared too. A large bucket is cut into blocks of
   bounded size for that, each pair of blocks a piece of work of its own: no pair is left out, and none is written out
   before its estimate is known.

Every link is confirmed on the full sets, made again from the whole texts of the two. No cap on buckets or partners.

Words are split at ASCII blanks after A-Z is lower-cased; a text of fewer than SIZE words is one shingle. Cases: null
text and text without words: empty set, linked with nothing. A row with a null doc_id links with nothing, has no
component, and is kept. Rows with one doc_id are one node, whatever their texts, and each gets its row. Other columns
are not looked at; an empty table gives an empty result. deduplicated() tells texts under one doc_id apart, and keeps
one of the rows that have doc_id and text in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodseries.llm.graph import components
from prodseries.llm.storage import dropped, stored

SIZE = 4
#: Linked are sets with 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS = 56, 7
HASHES = BANDS * ROWS // 2
#: Shingles hashed in one go, and shingles of sets that a verifying task remembers.
STEP, REMEMBERED = 2048, 2_000_000
#: Members of a bucket in one block.
BLOCK = 2048
#: Equal signature values from which two sets are compared: four standard deviations below the limit.
LEAST_EQUAL = int(2 * HASHES * (PERCENT / 100 - 4 * (PERCENT / 100 * (1 - PERCENT / 100) / (2 * HASHES)) ** 0.5))
_rng = np.random.default_rng(20)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_JOIN = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_WORD = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _WORD[k]
    return np.unique(_mix(total))


def bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One 64-bit key a band, and the lowest byte of each value as the signature."""
    small = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low, high = np.full(HASHES, 2**32 - 1, dtype=np.uint32), np.zeros(HASHES, dtype=np.uint32)
    for i in range(0, len(small), STEP):
        values = small[i : i + STEP, None] * _TIMES + _ADD
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    # a band takes either minima or maxima, so never two values of one permutation
    rows = np.concatenate([low, high]).reshape(BANDS, ROWS).astype(np.uint64)
    signature = (_mix(rows) & np.uint64(255)).astype(np.uint8)
    return _mix((rows * _JOIN).sum(1, dtype=np.uint64) ^ _BAND).astype(np.int64), signature.tobytes()


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, keys of the bands, signature) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_hexdigest

        names = ["doc_id", "n_shingles", "digest", "bands", "signature"]
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                sets = [shingles(t.as_py(), size) for t in part.column(1)]
                keys, signatures = zip(*(bands(s) if len(s) else (None, None) for s in sets))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
                ], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest string, bands array<bigint>, signature binary")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Those of pairs (a, b) of doc_ids whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                sets = []
                for text in (left.as_py(), right.as_py()):
                    name = xxh3_128_digest(text.encode())
                    if name not in known:
                        found = shingles(text, size)
                        held += len(found)
                        if held > REMEMBERED:
                            known, held = {}, len(found)
                        known[name] = found
                    sets.append(known[name])
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _sizes_allow(n: str, m: str) -> F.Column:
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


def groups(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    sketch = stored(sketches(docs, size), "sketch")
    linkable = sketch.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    of_set = [F.first(c).alias(c) for c in ("bands", "signature")]  # the same in all rows of a class
    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *of_set)
    classes = stored(classes, "classes")
    each = classes.select(F.explode("bands").alias("key"), "rep", "n")
    smallest = each.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    buckets = stored(smallest.select("key", "m", F.col("c.rep").alias("center"), F.col("c.n").alias("center_n")), "buckets")
    members = stored(each.join(buckets, "key"), "members")
    stars = members.where((F.col("rep") != F.col("center")) & _sizes_allow("n", "center_n"))
    stars = stored(stars.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = stored(confirmed(stars, docs, size), "links")
    # rows of one doc_id with different sets are one node
    several = linkable.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1")
    same = several.join(linkable.select("doc_id", "digest").distinct(), "doc_id").join(classes.select("digest", "rep"), "digest")
    own = stored(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links")
    links = links.unionByName(own)
    dropped(stars)
    first = components(links)
    rest = stored(_undecided(members, classes, first), "rest")
    more = stored(confirmed(rest, docs, size), "links")
    labels = components(links.unionByName(more)) if more.limit(1).count() else first
    for table in (buckets, members, links, rest, more):  # what the result does not read
        dropped(table)
    named = sketch.join(classes.select("digest", "rep"), "digest", "left")
    node = F.when(F.col("digest").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    known = named.select("doc_id", "n_shingles", node.alias("node")).join(labels, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return known.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _alike(batch: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole groups (key, i, j), sorted: the pairs (a, b) that may link by their signatures, sizes and components.

    A pair is given only in the first of the bands that the two share; so many shared buckets make no more rows.
    """
    key, i, j, block, n, component = (batch.column(c).to_numpy() for c in ("key", "i", "j", "block", "n", "component"))
    signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(len(key), -1)
    bands_of = batch.column("bands").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
    edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start, end in zip([0, *edges], [*edges, len(key)]):
        one = i[start] == j[start]
        for x in range(start, end):
            if not one and block[x] != i[start]:
                continue  # of two blocks each pair is met from the first
            g = slice(x + 1 if one else start, end)  # in one block, from the row that comes first
            fits = (component[g] != component[x]) & (100 * np.minimum(n[g], n[x]) >= PERCENT * np.maximum(n[g], n[x]))
            if not one:
                fits &= block[g] == j[start]
            at = g.start + np.flatnonzero(fits)
            at = at[(signature[at] == signature[x]).sum(1) >= LEAST_EQUAL]
            at = at[bands_of[x][(bands_of[at] == bands_of[x]).argmax(1)] == key[x]]
            left.append(np.full(len(at), x))
            right.append(at)
    rep = batch.column("rep").combine_chunks()
    yield pa.RecordBatch.from_arrays([rep.take(pa.array(np.concatenate(side))) for side in (left, right)], names=["a", "b"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_alike() for a stream of sorted rows; a group that a batch cuts is completed first."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        cut = np.flatnonzero(np.any([np.diff(x) != 0 for x in ids], axis=0)) + 1
        if held and len(batch) and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("key", "i", "j")):
            yield from _alike(pa.Table.from_batches(held))
            held = []
        if len(cut):
            yield from _alike(pa.Table.from_batches([*held, batch.slice(0, cut[-1])]))
            held, batch = [], batch.slice(cut[-1])
        if len(batch):
            held.append(batch)
    if held:
        yield from _alike(pa.Table.from_batches(held))


def _undecided(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket that may link, in different components and not compared yet."""
    known = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("key", "m", "center", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    known = known.where((F.col("rep") != F.col("center")) & (F.col("m") > 2)).join(mixed, "key", "left_semi")
    known = known.join(classes.select("rep", "signature", "bands"), "rep")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    known = known.withColumn("block", F.pmod(F.hash("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    known = known.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n",
        F.xxhash64("component").alias("component"), "signature", "bands")
    kind = known.schema["rep"].dataType.simpleString()
    grouped = known.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(_whole_groups, f"a {kind}, b {kind}").distinct()


def _named(docs: DataFrame) -> DataFrame:
    """(node, row): the rows with a doc_id, each under it; but other texts under the same doc_id get nodes of their own.

    Of several texts the one with the smallest hash keeps the doc_id. The others, few as a rule, are numbered after all
    doc_ids; where doc_ids are strings, they get longer ones.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_id"), F.struct(*docs.columns).alias("row"))
    ids = rows.groupBy("doc_id").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high"))
    several = ids.where("low < high").select(F.col("doc_id").alias("_id"), "low")
    others = rows.select("doc_id", "text_id").join(several, F.col("doc_id") == F.col("_id")).where("text_id > low").select("_id", F.col("text_id").alias("_text")).distinct()
    if docs.schema["doc_id"].dataType == T.StringType():
        name = F.concat_ws("\0", "_id", "_text")
    else:
        last = docs.agg(F.max("doc_id")).first()[0] or 0
        name = F.lit(last).cast("long") + F.monotonically_increasing_id() + 1
    others = stored(others.select("_id", "_text", name.alias("other")), "others")
    both = rows.join(others, (F.col("doc_id") == F.col("_id")) & (F.col("text_id") == F.col("_text")), "left")
    return both.select(F.coalesce("other", "doc_id").alias("node"), "row")


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id, and of equal doc_ids and texts one row; and the rows without a doc_id."""
    named = _named(docs)
    kept = groups(named.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")), size).where("kept").select("doc_id").distinct()
    plain = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no order and no hash
    one = named.groupBy("node").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    left = one.join(kept, F.col("node") == F.col("doc_id"), "left_semi").select("row.*")
    return left.unionByName(docs.where("doc_id IS NULL"))
