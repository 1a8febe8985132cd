"""Approximate nearest neighbours by cosine: inverted lists, scanned with an adaptive number of dimensions.

A k-means over a bounded sample gives the lists; every vector goes into the list of its nearest centroid. Within a list
the vectors are scaled to length 1 and turned by a random rotation, and a query runs over them in blocks of columns: after
each block a hypothesis test asks whether the distance so far, scaled up to all dimensions, can still be within the best
k; candidates that fail it are abandoned. What survives is measured exactly, in double precision on the original vectors.

Lists near each other form a group. The vectors of a group, by list, are cut into blocks of bounded size, and so are the
queries that look into a list of the group, each of which is there once with the lists it looks into. A block of vectors
meets a block of queries in an equi-join on the group, so a hot list is many tasks' work and no task holds more than two
blocks at once. There all queries of a list go over its columns together, as products of matrices, each pair with its
own test; the limit a query has after one list is the one it starts the next with.

Cases: a row with a null id takes no part, nor does a vector that is null, zero, or holds null or non-finite components,
nor one of another length than the most frequent (the larger, of two as frequent). Rows with one id are rows of their
own: each is a query where its id is, and each a candidate of the others. Equal scores go to the smaller id; fewer than
k candidates are all returned; without queries or candidates the result is empty; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodseries.llm.storage import LARGE_ROWS, stored

#: Rows that the centroids are fitted on, at most; vectors meant for a list; the most lists.
SAMPLE, PER_LIST, MOST_LISTS = 8192, 256, 1024
#: Share of the sample's true neighbours whose lists are to be probed, and rows of the sample that this is measured on.
COVERED, MEASURED = 0.98, 512
#: Vectors and queries of a block, dimensions looked at between two tests, and the test's slack.
BLOCK, QUERIES, COLUMNS, SLACK = 2048, 256, 16, 2.1
#: Lists of a group; one pair in so many that is left ends the common steps; pairs measured at a time.
GROUP, FEW, PAIRS = 8, 16, 4096
SEED = 7


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): the vectors that take part, as doubles, and a number of each row."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().sort(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == size.n) if size else rows
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def fit(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors, each of length 1."""
    rng = np.random.default_rng(SEED)
    lists = min(lists, len(sample))
    centers = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(1))
        centers = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centers)
    return centers


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int) -> int:
    """So many of the lists nearest to a query hold COVERED of its k true neighbours, within the sample."""
    some = sample[:: max(1, len(sample) // MEASURED)]
    alike = some @ sample.T
    near = np.argsort(-alike, axis=1)[:, 1 : k + 1]  # the first is the vector itself
    lists = (sample @ centers.T).argmax(1)
    place = np.argsort(np.argsort(-(some @ centers.T), axis=1), axis=1)
    places = np.sort(np.take_along_axis(place, lists[near], axis=1).ravel())
    return int(places[int(np.ceil(COVERED * len(places))) - 1]) + 1 if len(places) else len(centers)


def rotation(n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    """Scaled to length 1; by the largest component first, so that no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of v and of q, the same operations, so that equal vectors get equal scores."""
    v, q = v / np.abs(v).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum(1)))


def ranks(at: np.ndarray) -> np.ndarray:
    """Places from 0 within each run of equal values."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))


def rounding(n: int) -> float:
    """By so much a squared distance of n dimensions, summed up in single precision, may be off."""
    return 1e-6 * np.sqrt(n)


def scan(turned: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, squared distance) of what may be among the k nearest of each query but the row `own`.

    turned: dimensions x vectors, queries: queries x dimensions. limit: of each query, the k-th smallest distance so far;
    it is lowered here. All queries go over a block of columns together; a pair that fails a test is out, and once few
    pairs are left, the columns that follow are looked at for these alone.
    """
    n, kind = len(turned), turned.dtype

    def bar(stop: int) -> np.ndarray:
        return (limit * (stop / n) * ((1 + SLACK / np.sqrt(stop)) ** 2 if stop < n else 1.0) + rounding(n)).astype(kind)

    def dense(start: int, stop: int, a: np.ndarray) -> np.ndarray:
        """Of all pairs, over these columns, as one product: (-2 q, |q|^2, 1) by (a, 1, |a|^2)."""
        a, q = a[start:stop], queries[:, start:stop]
        left = np.concatenate([-2 * q, (q * q).sum(1, keepdims=True), np.ones((len(q), 1), dtype=kind)], axis=1)
        return left @ np.concatenate([a, np.ones((1, a.shape[1]), dtype=kind), (a * a).sum(0, keepdims=True)])

    keep = rows != own[:, None]
    if len(rows) > 4 * k and not np.isfinite(limit).all():
        # the first limit: the k-th smallest full distance among a few of them
        few = slice(None, None, max(1, len(rows) // (8 * k)))
        first = np.where(keep[:, few], dense(0, n, turned[:, few]), np.inf)
        np.minimum(limit, np.partition(first, k - 1, axis=1)[:, k - 1], out=limit)
    part, start = np.zeros(keep.shape, dtype=kind), 0
    while start < n and np.count_nonzero(keep) * FEW >= keep.size:
        stop = min(start + COLUMNS, n)
        part += dense(start, stop, turned)
        keep &= part <= bar(stop)[:, None]
        start = stop
    at, of = np.nonzero(keep)
    part = part[at, of]
    while start < n:
        stop = min(start + COLUMNS, n)
        part += ((turned[start:stop, of] - queries[at, start:stop].T) ** 2).sum(0)
        start, keep = stop, part <= bar(stop)[at]
        at, of, part = at[keep], of[keep], part[keep]
    order = np.lexsort((part, at))
    at, of, part = at[order], of[order], part[order]
    last = ranks(at) == k - 1
    limit[at[last]] = np.minimum(limit[at[last]], part[last])
    return at, of, part


def meet(block: tuple, asked: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the best k of a block for each of its queries, from the lists that the query looks into.

    block: lists, rows, ids, vectors, turned by dimension; asked: (query, list) pairs, rows, vectors, turned.
    """
    lists, rows, ids, vectors, turned = block
    (who, wanted), own, asked_vectors, queries = asked
    limit = np.full(len(own), np.inf)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=turned.dtype))]
    firsts = np.flatnonzero(np.diff(lists, prepend=-1))
    for start, stop in zip(firsts, [*firsts[1:], len(lists)]):
        these = who[wanted == lists[start]]
        if len(these):
            lowered = limit[these]
            at, of, part = scan(turned[:, start:stop], rows[start:stop], queries[these], own[these], lowered, k)
            limit[these] = lowered
            found.append((these[at], of + start, part))
    at, of, part = (np.concatenate(x) for x in zip(*found))
    keep = part <= limit[at] + rounding(len(turned))
    at, of = at[keep], of[keep]
    scores = np.zeros(len(at))
    for start in range(0, len(at), PAIRS):
        some = slice(start, start + PAIRS)
        scores[some] = cosine(vectors[of[some]].astype(float), asked_vectors[at[some]].astype(float))
    order = np.lexsort((ids[of], -scores, at))
    best = order[ranks(at[order]) < k]
    return at[best], ids[of[best]], scores[best]


def groups_of(centers: np.ndarray) -> np.ndarray:
    """A group for each list: GROUP lists or so that are near each other."""
    return (centers @ fit(centers, -(-len(centers) // GROUP)).T).argmax(1)


def _assigned(rows: DataFrame, centers: np.ndarray, groups: np.ndarray, probes: int, held: str) -> DataFrame:
    """(group, lists, row, id, v as bytes of `held`): each vector once in each group that holds some of its `probes` nearest lists."""
    sent = rows.sparkSession.sparkContext.broadcast((centers, groups))  # MOST_LISTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, groups = sent.value
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                v = part.column(2).flatten().to_numpy().reshape(len(part), -1)
                near = unit(v) @ centers.T
                lists = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(v), 1))
                at, lists = np.repeat(np.arange(len(v)), lists.shape[1]), lists.ravel()
                order = np.lexsort((lists, groups[lists], at))
                at, lists = at[order], lists[order]
                firsts = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(groups[lists], prepend=-1))
                ends = pa.array(np.append(firsts, len(lists)).astype(np.int32))
                data = [x.tobytes() for x in v.astype(held)]
                numbers, ids = (part.column(c).to_numpy()[at[firsts]].astype(np.int64) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(groups[lists[firsts]].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(lists.astype(np.int32))),
                    pa.array(numbers), pa.array(ids), pa.array([data[i] for i in at[firsts]], pa.binary()),
                ], names=["group", "lists", "row", "id", "v"])

    return rows.select("row", "vec_id", "v").mapInArrow(run, "group int, lists array<int>, row bigint, id bigint, v binary")


def _blocks(rows: DataFrame, size: int, by_column: bool, held: str) -> DataFrame:
    """(group, lists, rows, ids, v, turned): the rows of each group, by list, in blocks of about `size`, spread by a hash of the row.

    turned holds the unit vectors after the rotation in single precision, with by_column dimension by dimension. Both are
    stored, so that a block that meets many others is turned once.
    """
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))  # a row a group
    cut = rows.join(F.broadcast(sizes), "group").withColumn("part", F.pmod(F.hash("row"), F.col("parts")))
    grouped = cut.groupBy("group", "part").agg(F.array_sort(F.collect_list(F.struct("lists", "row", "id", "v"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column(4)[i].as_py()
                v = np.frombuffer(b"".join(data), held).reshape(len(data), -1)
                turn = rotation(v.shape[1]) if turn is None else turn
                turned = (unit(v.astype(float)) @ turn).astype(np.float32)
                more = [pa.array([x.tobytes()], pa.binary()) for x in (v, np.ascontiguousarray(turned.T) if by_column else turned)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:4], *more], names=["group", "lists", "rows", "ids", "v", "turned"])

    kind = "group int, lists array<array<int>>, rows array<bigint>, ids array<bigint>, v binary, turned binary"
    return stored(grouped.select("group", "m.lists", "m.row", "m.id", "m.v").mapInArrow(run, kind), "blocks", LARGE_ROWS)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest others."""
    rows = stored(usable(vectors), "vectors")
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()["v"]
    kind = "row bigint, query_id bigint, vec_id bigint, score double"
    if not len(sample):
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lists = int(np.clip(rows.count() // PER_LIST, 1, MOST_LISTS))
    scaled = unit(np.stack(sample))
    centers = fit(scaled, lists)
    probes = probes_for(scaled, centers, k)
    groups = groups_of(centers)
    # as single precision where the column itself is: nothing is lost, scores are computed in double precision
    held = "f4" if vectors.select(F.element_at("embedding", 1)).dtypes[0][1] == "float" else "f8"
    blocks = _blocks(_assigned(rows, centers, groups, 1, held), BLOCK, True, held)
    asked = _blocks(_assigned(rows.where(F.col("vec_id") % every == 0), centers, groups, probes, held), QUERIES, False, held)
    columns = ["lists", "rows", "ids", "v", "turned"]
    asked = asked.select("group", *(F.col(c).alias(f"asked_{c}") for c in columns))
    met = blocks.join(asked, "group").select(*columns, *(f"asked_{c}" for c in columns))
    n = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lists, asked_lists = (batch.column(c)[i].values for c in (0, 5))
                numbers, ids, asked_numbers, asked_ids = (batch.column(c)[i].values.to_numpy() for c in (1, 2, 6, 7))
                v, turned, asked_v, asked_turned = (np.frombuffer(batch.column(c)[i].as_py(), "f4" if c in (4, 9) else held) for c in (3, 4, 8, 9))
                wanted = np.repeat(np.arange(len(asked_numbers)), asked_lists.value_lengths().to_numpy()), asked_lists.flatten().to_numpy()
                block = lists.flatten().to_numpy(), numbers, ids, v.reshape(-1, n), turned.reshape(n, -1)
                at, best, scores = meet(block, (wanted, asked_numbers, asked_v.reshape(-1, n), asked_turned.reshape(-1, n)), k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(asked_numbers[at]), pa.array(asked_ids[at]), pa.array(best), pa.array(scores),
                ], names=["row", "query_id", "vec_id", "score"])

    found = met.mapInArrow(run, kind)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
