"""Hard negatives by inner product, with pruning by length and by coordinates.

Rows are dealt by their length into buckets, and each bucket into blocks of bounded size; a block holds, besides its
vectors, for each coordinate the list of its rows sorted by that coordinate of the unit vector. An anchor q that looks
for scores of at least t in a bucket whose longest vector has length l can only meet vectors whose angle to q has a
cosine of t / (|q| l) or more. If there is no such angle, the block is skipped. Else the angle bounds each coordinate
of a candidate: in the lists of the anchor's focus coordinates, its largest ones, these are ranges, whose rows are
intersected; what is in all of them is scored exactly, in integers. Where even the shortest range holds more than one
row in FEW, intersecting would cost more than it saves: such anchors are scored against the block by one matrix product.

Scores to look for come from a first look at the longest blocks (one in SHARE, at least LOOK): the k-th best score there
is a lower bound of the k-th best overall, so that nothing that counts is ever pruned; a task raises the bound as it goes
from block to block. The same is done twice: for the positives of each anchor, among the rows of its label, and then,
positives known, for the negatives in the range that each positive allows.

Each block of anchors meets each block of rows, in a cross join that copies neither to disk nor to the driver: a task
holds the rows of one block at a time, with GROUPS blocks of anchors and the best of each of these so far. It gives the
k best of each anchor and, for negatives, each positive.

Cases: rows with a null vec_id, label or vector, or a null or non-finite component take no part, nor do those of
another length than the most frequent (the larger, of two as frequent). Zero vectors take part. Rows with one vec_id are
rows of their own, and each other's partners. Ties go to the smaller vec_id. An anchor without positives gives no rows,
nor does a positive whose range is empty (a negative score) or meets nobody. Components are exact as doubles; a score
that no long can hold is an error. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodseries.llm.storage import LARGE_ROWS, stored

#: Rows of a block (their numbers are 16-bit), anchors of a block, length buckets at most, and blocks of the first look at least.
BLOCK, ASKED, BUCKETS, LOOK = 4096, 2048, 512, 2
#: One block in so many is in the first look; blocks of anchors that a task holds.
SHARE, GROUPS = 16, 8
#: Coordinates whose ranges are intersected, and slack of the ranges against rounding.
FOCUS, SLACK = 4, 1e-9
#: Ranges count up to one row in so many; scores of a product, pairs scored one by one and rows found that are held at a time.
FEW, CELLS, PAIRS, PENDING = 16, 1 << 21, 8192, 1 << 17
#: Score of a negative as a percentage of its positive's, from and to.
LOW, HIGH = 30, 90
#: No bound from below and from above.
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v, length): the rows that take part, v as the integers of the contract, held as doubles."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy().astype(np.int64)
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False)  # a null is nan
            ends = np.append(0, np.cumsum(sizes))
            bad = np.append(0, np.cumsum(~np.isfinite(x)))[ends]
            fine = bad[1:] == bad[:-1]
            for n in np.unique(sizes[fine]).tolist():
                at = np.flatnonzero(fine & (sizes == n))
                v = np.floor(256 * x[ends[at][:, None] + np.arange(n)])
                data = pa.array([r.tobytes() for r in v], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:3]), pa.array(np.full(len(at), n, dtype=np.int32)), data, pa.array(length(v))], names=["row", "vec_id", "label", "n", "v", "length"])

    whole = stored(numbered.mapInArrow(run, "row bigint, vec_id bigint, label bigint, n int, v binary, length double"), "vectors")
    size = whole.groupBy("n").count().sort(F.desc("count"), F.desc("n")).first()
    return (whole.where(F.col("n") == size.n) if size else whole).drop("n")


def length(v: np.ndarray) -> np.ndarray:
    """Euclidean; by the largest component first, so that no square overflows."""
    top = np.abs(v).max(1, initial=0.0)
    scaled = v / np.where(top > 0, top, 1.0)[:, None]
    return top * np.sqrt((scaled * scaled).sum(1))


def units(v: np.ndarray) -> np.ndarray:
    size = length(v)
    return v / np.where(size > 0, size, 1.0)[:, None]


def products(v: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their integers, else in Python's. most: of the components of v."""
    if most * np.abs(q).max(initial=0.0) * len(q) < 2**53:
        return (v @ q).astype(np.int64)
    q = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(row, q)) for row in v], dtype=object)


def focused(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The focus coordinates of each row, and its angles to them."""
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    return focus, np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))


def ranks(key: np.ndarray) -> np.ndarray:
    """Places from 0 within each run of equal values."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))


def true_places(hit: np.ndarray) -> np.ndarray:
    """As flatnonzero, which takes longer where little is true."""
    flat = hit.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return eights[flat[eights]]


class Block:
    """The rows of one block, with the sorted lists of their coordinates."""

    def __init__(self, rows, ids, labels, v: bytes, lists: bytes, longest: float):
        self.rows, self.ids, self.labels, self.longest = rows, ids, labels, longest
        self.v = np.frombuffer(v).reshape(len(rows), -1)
        self.unit, self.most = units(self.v), np.abs(self.v).max(initial=0.0)
        self.lists = np.frombuffer(lists, dtype=np.uint16).reshape(-1, len(rows))
        self.values = np.take_along_axis(self.unit.T, self.lists.astype(np.int64), axis=1)  # each list in its order
        self.single = self.v.astype(np.float32) if self.most < 2**24 else None
        self.room = np.zeros(0)

    def ranges(self, focus: np.ndarray, own: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each anchor and focus coordinate: low, high, and where these are in the list. cosine: the least that counts."""
        angle = np.arccos(np.minimum(cosine, 1.0) - SLACK)[:, None]
        low, high = np.cos(np.minimum(own + angle, np.pi)) - SLACK, np.cos(np.maximum(own - angle, 0)) + SLACK
        first, last = np.zeros(focus.shape, dtype=np.int64), np.zeros(focus.shape, dtype=np.int64)
        for f in np.unique(focus):
            at = focus == f
            first[at], last[at] = np.searchsorted(self.values[f], low[at], "left"), np.searchsorted(self.values[f], high[at], "right")
        return low, high, first, last

    def within(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row): the rows that are in all ranges of an anchor, from its shortest range."""
        each = np.arange(len(focus))
        shortest = (last - first).argmin(1)
        start, width = first[each, shortest], (last - first)[each, shortest]
        at = np.repeat(each, width)
        place = np.arange(len(at)) + np.repeat(start - np.cumsum(width) + width, width)
        of = self.lists[focus[at, shortest[at]], place].astype(np.int64)
        for i in range(focus.shape[1]):
            there = self.unit[of, focus[at, i]]
            keep = (there >= low[at, i]) & (there <= high[at, i])
            at, of = at[keep], of[keep]
        return at, of

    def scores(self, q: np.ndarray, lo: int, hi: int, single: bool) -> np.ndarray:
        """Inner products with the rows from lo to hi, in memory that the next call takes again."""
        v = (self.single if single else self.v)[lo:hi]
        if self.room.dtype != v.dtype or len(self.room) < len(q) * len(v):
            self.room = np.empty(max(CELLS, len(q) * len(v)), dtype=v.dtype)
        return np.matmul(q.astype(v.dtype), v.T, out=self.room[: len(q) * len(v)].reshape(len(q), len(v)))

    def candidates(self, q: np.ndarray, least: int | None) -> np.ndarray:
        """The rows that may score `least` or more with q; None: all."""
        every = np.arange(len(self.rows))
        if least is None or least <= 0 or not len(q):
            return every
        size = float(length(q[None])[0])
        if size == 0 or self.longest == 0:
            return every[:0]
        cosine = float(least) / (size * self.longest)
        if cosine > 1 + SLACK:
            return every[:0]
        focus, own = focused(q[None] / size)
        return self.within(focus, *self.ranges(focus, own, np.array([cosine])))[1]

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The places in `at` of the k best, of equal scores those of smaller ids."""
        order = sorted(range(len(at)), key=lambda i: (-int(scores[i]), int(self.ids[at[i]]), int(self.rows[at[i]])))
        return np.array(order[:k], dtype=np.int64)


class Asked:
    """The anchors of one block, by label, and the k best rows so far for each of them and of its places.

    least, most: of each anchor and place, the scores that count; least goes up with what is found.
    """

    def __init__(self, rows, labels, v: bytes, least: np.ndarray, most: np.ndarray, k: int):
        self.rows, self.labels, self.k = rows, labels, k
        self.v = np.frombuffer(v).reshape(len(rows), -1)
        self.size, self.top = length(self.v), np.abs(self.v).max(1, initial=0.0)
        self.focus, self.own = focused(units(self.v))
        self.least, self.most = np.where(least > most, MOST, least), most
        self.found, self.held, self.kept = [[np.zeros(0, dtype=np.int64)] * 4], 0, 0

    def add(self, at: np.ndarray, place: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.found.append([at * self.least.shape[1] + place, scores, ids, rows])
        self.held += len(at)
        if self.held > max(PENDING, 2 * self.kept):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """(anchor and place, score, id, row) of the k best of each."""
        key, scores, ids, rows = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((rows, ids, ~scores, key))
        rank = ranks(key[order])
        last, order = order[rank == self.k - 1], order[rank < self.k]
        self.least.flat[key[last]] = np.maximum(self.least.flat[key[last]], scores[last])
        self.found, self.held, self.kept = [[x[order] for x in (key, scores, ids, rows)]], len(order), len(order)
        return self.found[0]


def meet(block: Block, asked: Asked, same: bool) -> None:
    """Adds to `asked` the rows of the block, of the anchor's label (same) or of others, that may be among its k best."""
    k, places, n = asked.k, asked.least.shape[1], len(block.rows)
    bound = block.most * asked.top * block.v.shape[1]  # no sum is larger
    least = asked.least.min(1)
    start, stop = (np.searchsorted(block.labels, asked.labels, side) if same else np.full(len(least), x) for side, x in (("left", 0), ("right", n)))
    left = (stop > start) & ((least <= 0) | (least <= (1 + SLACK) * asked.size * block.longest))

    def add(at: np.ndarray, of: np.ndarray, scores: np.ndarray) -> None:
        for place in range(places):
            fits = (scores >= asked.least[at, place]) & (scores <= asked.most[at, place])
            asked.add(at[fits], place, scores[fits], block.ids[of[fits]], block.rows[of[fits]])

    def free(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        alike = block.labels[of] == asked.labels[at]
        return alike & (block.rows[of] != asked.rows[at]) if same else ~alike

    def product(some: np.ndarray, lo: int, hi: int, single: bool) -> None:
        """All of these anchors by the rows from lo to hi."""
        scores = block.scores(asked.v[some], lo, hi, single)
        hit = scores >= asked.least[some].min(1).astype(scores.dtype)[:, None]
        if hi - lo > k and np.count_nonzero(hit) > 4 * k * places * len(some):  # bounds from the block itself
            may = free(some[:, None], np.arange(lo, hi)[None])
            for place in range(places):
                from_, to = (x[some, place].astype(scores.dtype)[:, None] for x in (asked.least, asked.most))
                fits = np.where(may & (scores >= from_) & (scores <= to), scores, -np.inf).astype(scores.dtype)
                last = np.partition(fits, hi - lo - k, axis=1)[:, hi - lo - k]
                known = np.isfinite(last)
                asked.least[some[known], place] = np.maximum(asked.least[some[known], place], last[known].astype(np.int64))
            hit = may & (scores >= asked.least[some].min(1).astype(scores.dtype)[:, None])
        flat = true_places(hit)
        at, of = np.divmod(flat, hi - lo)
        at, of, scores = some[at], of + lo, scores.ravel()[flat].astype(np.int64)
        keep = free(at, of)
        add(at[keep], of[keep], scores[keep])

    for i in np.flatnonzero(left & (bound >= 2**53)).tolist():  # beyond the integers of a double
        of = block.candidates(asked.v[i], None if least[i] == LEAST else int(least[i]))
        of = of[free(np.full(len(of), i), of)]
        scores = products(block.v[of], asked.v[i], block.most)
        for place in range(places):
            fits = np.arange(len(of)) if same else np.flatnonzero((scores >= int(asked.least[i, place])) & (scores <= int(asked.most[i, place])))
            best = fits[block.best(of[fits], scores[fits], k)]
            asked.add(np.full(len(best), i), place, np.array([int(x) for x in scores[best]], dtype=np.int64), block.ids[of[best]], block.rows[of[best]])

    left &= bound < 2**53
    near = np.flatnonzero(left & (least > 0))
    wide = left.copy()
    if len(near):
        ranges = block.ranges(asked.focus[near], asked.own[near], least[near] / (asked.size[near] * block.longest))
        width = (ranges[3] - ranges[2]).min(1)
        few = width * FEW <= (stop - start)[near]
        wide[near[few]] = False
        at, of = block.within(asked.focus[near[few]], *(x[few] for x in ranges))
        at = near[few][at]
        keep = free(at, of)
        at, of = at[keep], of[keep]
        for i in range(0, len(at), PAIRS):
            a, o = at[i : i + PAIRS], of[i : i + PAIRS]
            add(a, o, np.einsum("ij,ij->i", block.v[o], asked.v[a]).astype(np.int64))
    for single in (True, False):
        those = np.flatnonzero(wide & ((bound < 2**24) == single))
        for run in np.split(those, np.flatnonzero(np.diff(start[those])) + 1) if len(those) else []:  # a run a label
            lo, hi = int(start[run[0]]), int(stop[run[0]])
            step = max(1, CELLS // (hi - lo))
            for i in range(0, len(run), step):
                product(run[i : i + step], lo, hi, single)


def blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(block, longest, rows, ids, labels, v, lists): the longest blocks, for a first look, and the others; block 0 holds the longest rows."""
    n = rows.count()
    probabilities = np.linspace(0, 1, min(BUCKETS, -(-n // BLOCK)) + 1)[1:-1] if n else []
    edges = sorted(set(rows.approxQuantile("length", [float(p) for p in probabilities], 1e-4)), reverse=True) if len(probabilities) else []
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e >= F.col("length"))) if edges else F.lit(0)
    dealt = rows.withColumn("bucket", bucket)
    sizes = {r.bucket: -(-r["count"] // BLOCK) for r in dealt.groupBy("bucket").count().collect()}  # BUCKETS rows at most
    parts, first, total = [], [], 0
    for b in range(len(edges) + 1):
        first.append(total)
        parts.append(max(1, sizes.get(b, 0)))
        total += parts[-1]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    number = of(first) + F.pmod(F.xxhash64("row"), of(parts)).cast("int")
    # a hash deals unevenly: in a long bucket a block is a little over BLOCK, and far from 2^16
    members = F.array_sort(F.collect_list(F.struct("label", "row", "vec_id", "v", "length")))
    packed = dealt.withColumn("block", number).groupBy("block").agg(members.alias("m"))
    packed = packed.select("block", F.array_max("m.length").alias("longest"), "m.row", "m.vec_id", "m.label", "m.v")
    names = ["block", "longest", "rows", "ids", "labels", "v", "lists"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                v = np.frombuffer(data := b"".join(one.column(5)[0].as_py())).reshape(len(one.column(2)[0]), -1)
                lists = np.argsort(units(v).T, axis=1, kind="stable").astype(np.uint16)
                more = [pa.array([data], pa.binary()), pa.array([lists.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*one.columns[:5], *more], names=names)

    look = max(LOOK, total // SHARE)
    kind = "block int, longest double, rows array<bigint>, ids array<bigint>, labels array<bigint>, v binary, lists binary"
    whole = stored(packed.mapInArrow(run, kind).withColumn("later", (F.col("block") >= look).cast("int")), "blocks", LARGE_ROWS, "later")
    return whole.where("later = 0").drop("later"), whole.where("later = 1").drop("later") if total > look else None


def _asked(anchors: DataFrame) -> DataFrame:
    """The anchors in blocks, GROUPS or so to a partition: the number of the block and, by label, arrays of each column."""
    columns = ["label", "row", "v", "least", "most"]
    parts = max(1, -(-anchors.count() // ASKED))
    each = F.array_sort(F.collect_list(F.struct(*columns)))
    packed = anchors.groupBy(F.pmod(F.hash("row"), F.lit(parts)).alias("asked")).agg(each.alias("a"))
    return packed.select("asked", *(F.col(f"a.{c}").alias(f"a_{c}") for c in columns)).repartition(-(-parts // GROUPS))


def _square(values: pa.ListArray, fill: int) -> np.ndarray:
    """A row a list, the shorter ones filled up."""
    sizes = values.value_lengths().to_numpy()
    out = np.full((len(sizes), int(sizes.max())), fill, dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values.flatten().to_numpy()
    return out


def scanned(of: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, place, row, vec_id, score): what may be among the k best of each anchor and place, k rows of each a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, groups = None, None, {}
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for i, (b, a) in enumerate(zip(column["block"].to_pylist(), column["asked"].to_pylist())):
                if b != number:  # a block comes once for each block of anchors, one after the other
                    values = [column[c][i].values.to_numpy() for c in ("rows", "ids", "labels")]
                    number, block = b, Block(*values, column["v"][i].as_py(), column["lists"][i].as_py(), column["longest"][i].as_py())
                if a not in groups:
                    rows, labels = (column[c][i].values.to_numpy() for c in ("a_row", "a_label"))
                    least, most = _square(column["a_least"][i].values, MOST), _square(column["a_most"][i].values, LEAST)
                    groups[a] = Asked(rows, labels, b"".join(column["a_v"][i].as_py()), least, most, k)
                meet(block, groups[a], same)
        for asked in groups.values():
            key, scores, ids, rows = asked.settle()
            at, place = np.divmod(key, asked.least.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(asked.rows[at]), pa.array((place + 1).astype(np.int32)), *map(pa.array, (rows, ids, scores))], names=["anchor", "place", "row", "vec_id", "score"])

    met = of.hint("shuffle_replicate_nl").crossJoin(_asked(anchors))
    return met.mapInArrow(run, "anchor bigint, place int, row bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best(first: DataFrame, rest: DataFrame | None, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, place, row, vec_id, score, rank): of each anchor, for each place from 1 of its arrays `least` and `most`, the k best rows
    of its label (same) or of other labels with scores in that range."""
    looked = stored(_ranked(scanned(first, anchors, same, k), k), "looked")
    if rest is None:
        return looked
    seen = looked.where(F.col("rank") == k).groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("seen"))
    raised = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("seen", i + 1), x)))
    anchors = stored(anchors.join(seen, "row", "left").withColumn("least", raised).drop("seen"), "anchors")
    return stored(_ranked(looked.drop("rank").unionByName(scanned(rest, anchors, same, k)), k), "best")


def mine(vectors: DataFrame, positives_of: int = 5, k: int = 10, every: int = 100, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (vec_id divisible by `every`) and each of its best rows of the same label, the k best rows of other
    labels whose score is from low to high percent of the positive's.
    """
    rows = usable(vectors)
    first, rest = blocks(rows)
    anchors = stored(rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v"), "anchors")
    open_ = (F.array(F.lit(int(x)).cast("long")) for x in (LEAST, MOST))
    positives = best(first, rest, anchors.withColumns(dict(zip(("least", "most"), open_))), True, positives_of)
    # from and to: the least and largest scores that the positive allows
    share = lambda p: F.col("score").cast("decimal(20,0)") * p / F.lit(100).cast("decimal(3,0)")
    bounds = F.struct("rank", F.ceil(share(low)).cast("long").alias("from"), F.floor(share(high)).cast("long").alias("to"))
    of_anchor = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(bounds)).alias("p"))  # positives_of at most
    of_anchor = of_anchor.select("row", F.col("p.from").alias("least"), F.col("p.to").alias("most"))
    negatives = best(first, rest, stored(anchors.join(of_anchor, "row"), "anchors"), False, k)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    named = positives.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
    both = negatives.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(both.hint("merge"), ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# All inner products.
SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
         s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""
