"""Interaction of filters, by decision diagrams over failure masks.

Each document becomes a mask of the filters that it fails. Counted by part and mask that is at most 2^filters rows a
part, and from them a diagram is built: a level a filter, a node a set of remaining failures with the weight (documents,
good ones, toxic ones) below it, equal nodes shared. An order of the filters is an order of the levels. All orders are
visited by swaps of two adjacent levels, each of which touches these two levels only; along the path on which every
filter passes, what leaves at a level is what that filter removes in this order.

audit() takes any table (part, mask, n, good, toxic); the mask's bit i is the i-th filter of `names`. The number of
orders is the factorial of the filters, so that six or seven are as many as one would ask for.

masks() has the five filters of the report. Texts are equal if their SHA-256 is. Cases: a null text is empty, and so equal to other
empty ones; a null source is the part ''; a row with a null doc_id is nobody's earlier copy, has none itself and no labels; rows with one doc_id each
count, and are not copies of each other; a document counts as good or toxic if any of its labels says so; null labels
say nothing; an empty table has no parts and gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodseries.llm.storage import stored

NAMES = "ABCDE"
#: The limits of the filters A to D.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 2, "[#$%&*|]"
Weight = tuple[int, int, int]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each document.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of the characters A-Z; D: holds a symbol of
    SYMBOLS; E: the text of a smaller doc_id. The words are runs between ASCII blanks.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    read = base.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("chars"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("upper"), F.col("text").rlike(SYMBOLS).alias("symbols"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))[0].alias("words"),
    )
    fails = [
        F.col("words.n") < LEAST_WORDS, 100 * F.col("words.different") < LEAST_DISTINCT * F.col("words.n"),
        100 * F.col("upper") > MOST_UPPER * F.col("chars"), F.col("symbols"),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    texts = stored(read.select("doc_id", "part", "digest", mask.alias("mask")), "masks")
    # hot texts are counted before the shuffle; the join back is a plain one, which Spark splits where it is skewed
    firsts = texts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = stored(firsts.where("first < last").select("digest", "first"), "firsts")
    named = texts.where("doc_id IS NOT NULL").join(firsts, "digest", "left")
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = named.join(said.where("good OR toxic"), "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << len(fails)).otherwise(0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    named = named.select("part", (F.col("mask") + copy).alias("mask"), flag("good"), flag("toxic"))
    nameless = texts.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return named.unionByName(nameless)


def counted(masks: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part and mask."""
    return masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def _sum(a: Weight, b: Weight) -> Weight:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Diagram:
    """Level by level the nodes (node if the filter passes, node if it fails) of the next level, and their weights."""

    def __init__(self, weights: dict[int, Weight], filters: int):
        self.order = [*range(filters)]
        self.levels: list[list[tuple[int, int]]] = []
        terminals: dict[Weight, int] = {}
        # from the last filter up: below[m] is the node of the documents whose earlier filters fail as in m
        below = [terminals.setdefault(weights.get(m, (0, 0, 0)), len(terminals)) for m in range(1 << filters)]
        self.weights: list[list[Weight]] = [[*terminals]]
        for _ in range(filters):
            half, made = len(below) // 2, {}
            below = [made.setdefault((below[m], below[m + half]), len(made)) for m in range(half)]
            self.levels.insert(0, [*made])
            self.weights.insert(0, self._weighed(self.levels[0], self.weights[0]))

    @staticmethod
    def _weighed(level: list[tuple[int, int]], below: list[Weight]) -> list[Weight]:
        return [_sum(below[passed], below[failed]) for passed, failed in level]

    def swap(self, k: int) -> None:
        """Exchange the levels k and k + 1. The nodes of level k stay what they stand for, so that nothing above changes."""
        upper, lower, made = self.levels[k], self.levels[k + 1], {}
        node = lambda pair: made.setdefault(pair, len(made))
        swapped = []
        for passed, failed in upper:
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            swapped.append((node((pp, fp)), node((pf, ff))))
        self.levels[k], self.levels[k + 1] = swapped, [*made]
        self.weights[k + 1] = self._weighed(self.levels[k + 1], self.weights[k + 2])
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """(filter, what stays, what it removes) along the path on which all filters pass."""
        at, found = 0, []
        for k, which in enumerate(self.order):
            passed, failed = self.levels[k][at]
            found.append((which, self.weights[k + 1][passed], self.weights[k + 1][failed]))
            at = passed
        return found


def plain_changes(n: int) -> Iterator[int]:
    """Positions k whose swaps with k + 1, one after the other, lead through all orders of n things."""
    if n < 2:
        return
    down = True
    for k in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if k is not None:
            yield k + 1 if down else k  # the last thing stands at the front, or at the end
        down = not down


def orders(weights: dict[int, Weight], names: str) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    diagram = Diagram(weights, len(names))
    seen = [([*diagram.order], diagram.steps())]
    for k in plain_changes(len(names)):
        diagram.swap(k)
        seen.append(([*diagram.order], diagram.steps()))
    fails, alone, total = ({} for _ in range(3))
    for _, steps in seen:
        fails[steps[0][0]] = steps[0][2][0]  # first in an order, a filter removes all that fail it
        alone[steps[-1][0]] = steps[-1][2][0]  # last, only those that fail nothing else
        for which, _, gone in steps:
            total[which] = total.get(which, 0) + gone[0]
    for order, steps in seen:
        name = "".join(names[i] for i in order)
        for step, (which, kept, gone) in enumerate(steps, 1):
            yield name, step, kept[0], gone[0], fails[which] - gone[0], alone[which], gone[1], gone[2], total[which]


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order of the filters and step; counts: part, mask, n, good, toxic."""
    each = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # at most 2^filters
    parts = counts.groupBy("part").agg(each.alias("masks"))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weights = {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}
                rows = [(part, *row) for row in orders(weights, names)]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *columns])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in columns))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(counted(masks(docs, labels)))


# Every order played through on the counts of the masks.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT doc_id, part, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda e: e <> '') AS words, length(x) AS chars,
         length(regexp_replace(x, '[^A-Z]', '', 'g')) AS upper, regexp_matches(x, '[#$%&*|]') AS symbols,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS copy
  FROM t),
m AS (
  SELECT part,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
          + CASE WHEN 100 * upper > 2 * chars THEN 4 ELSE 0 END + CASE WHEN symbols THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END) AS mask,
         count(*) AS n,
         count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) AS good,
         count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)) AS toxic
  FROM w GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31),
s AS (
  SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
