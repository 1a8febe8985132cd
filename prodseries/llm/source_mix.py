"""Mixing of sources to target weights, by entropy balancing.

Of all rates that give each source its target number of words, and no document more than MOST copies, those nearest to
one copy a document (in relative entropy) are rate = min(MOST, exp(multiplier * size)): the documents' counts are tilted
exponentially in what the constraint counts. The multipliers maximise the concave dual, one a source. They are found by
Newton iterations over the table of (source, size, documents), which has a row for each different size and not for each
document: gradient and curvature are sums that Spark takes before its shuffle, the state is a small table with a row a
source, and a bracket around each root keeps a step that leaves it from doing harm.

Rates become copies by one threshold a source. A document with rate r and a draw u in [0, 1), made from a hash, has its
first copy from threshold u - r on and its second from u + 1 - r on; at threshold 0 that is the usual random rounding.
The threshold is moved to where the words taken come nearest to the target, found by three rounds of histograms of 512
cells a source, so that the total does not depend on the draws: it misses the target by at most half of the words that lie in the
cell, whose width is 3e-8; that is about one document, or the copies of one row.

Sources take part by their code points, null last, and weigh WEIGHTS in turn; they share TOTAL of all words, but
no source more than MOST of its own: what is above goes to the others by weight, until none is above.

Cases: null and empty texts have size 0 and take nothing; a source without words gets the target 0; a null source is a
source of its own; rows that are equal in doc_id, source and text share one draw and are taken alike; a null doc_id is
kept; an empty table gives an empty result; other columns are not looked at. The same rows give the same mix each time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodseries.llm.storage import dropped, stored

#: Weights of the sources in turn, words of the mix as a share of all words, and most copies of a document.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2
#: Relative error of a source's words at which its multiplier is found, and rounds after which the rest stay as they are.
EXACT, ROUNDS = 1e-9, 80
#: Bits of a threshold's cell: three rounds of CELL_BITS each.
CELL_BITS, PASSES = 9, 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw) of each document; words are runs between ASCII blanks."""
    text = F.coalesce("text", F.lit(""))
    size = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "source", F.xxhash64(text), F.length(text)), 11) / float(1 << 53)
    return docs.select("doc_id", "source", size.alias("size"), draw.alias("draw"))


def on_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source; a null source counts as one."""
    named = sources.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL) -> DataFrame:
    """sources (source, source_size) with their target. A row a source is all that is ordered and summed here."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = stored(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))), "weights")
    words = total * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level rises, so sources that are full stay full
        above = MOST * F.col("source_size") < F.col("weight") * level
        found = weighed.agg(
            F.sum(above.cast("long")).alias("full"), F.sum(F.when(above, MOST * F.col("source_size")).otherwise(0)).alias("taken"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not found.open or found.full == full:
            break
        full, level = found.full, (words - found.taken) / found.open
    target = F.least(F.col("weight") * F.lit(level), (MOST * F.col("source_size")).cast("double"))
    return weighed.withColumn("target", target)


def _rate(multiplier: F.Column, size: F.Column) -> F.Column:
    return F.least(F.exp(F.least(multiplier * size, F.lit(math.log(MOST)))), F.lit(float(MOST)))


def multipliers(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, multiplier): sizes has (source, size, n), sources has (source, source_size, target).

    A target of MOST times the source's words has no finite multiplier; there, and where nothing is to be taken, null.
    """
    some = sources.where(f"target > 0 AND target < {MOST} * source_size * (1 - {EXACT})")
    unknown = F.lit(None).cast("double")
    state = some.select("source", "target", F.lit(0.0).alias("multiplier"), unknown.alias("low"), unknown.alias("high"), F.lit(False).alias("found"))
    state = stored(state, "multipliers")
    for _ in range(ROUNDS):
        open_ = state.where("NOT found")
        if not open_.limit(1).count():
            break
        rate = _rate(F.col("multiplier"), F.col("size"))
        sums = on_source(sizes, open_.select("source", "multiplier")).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"),
            F.sum(F.when(rate < MOST, F.col("n") * F.col("size") * F.col("size") * rate).otherwise(0.0)).alias("slope"))
        off = F.log(F.greatest(F.col("words"), F.lit(1e-300)) / F.col("target"))
        met = F.abs(F.col("words") - F.col("target")) <= EXACT * F.col("target")
        low = F.when(off < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("multiplier")).otherwise(F.col("high"))
        # of the logarithm of the words, which a tilt without limits makes convex; where all are at the limit, bisection
        newton = F.col("multiplier") - off * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        middle = F.when(F.col("low").isNull(), F.col("high") * 2).when(F.col("high").isNull(), F.col("low") * 2).otherwise((F.col("low") + F.col("high")) / 2)
        step = on_source(state, sums).withColumn("found", met).withColumn("low", low).withColumn("high", high)
        step = step.withColumn("multiplier", F.when(F.col("found"), F.col("multiplier")).when(inside, newton).otherwise(middle))
        done = state.where("found")
        new = stored(done.unionByName(step.select(*state.columns)), "multipliers")
        dropped(state)
        state = new
    return state.select("source", "multiplier")


def _cells(rows: DataFrame) -> DataFrame:
    """rows with `one` and `two`: the cells of the thresholds of the first and of the second copy."""
    bits = CELL_BITS * PASSES
    cell = lambda t: F.floor((t + 2.0) / 4.0 * float(1 << bits)).cast("long")  # noqa: E731  thresholds are between -2 and 2
    first = F.col("draw") - F.col("rate")
    return rows.withColumn("one", cell(first)).withColumn("two", cell(first + 1.0))


def cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cut): copies of cells below the cut together come nearest to the source's target."""
    each = rows.where("size > 0").select("source", "size", F.explode(F.array("one", "two")).alias("cell"))
    state = sources.where("target > 0").select("source", "target", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("below"))
    for k in range(PASSES):
        shift = CELL_BITS * (PASSES - 1 - k)
        at = F.shiftright("cell", shift)
        inside = on_source(each, state.select("source", "cut")).where(F.shiftright("cell", shift + CELL_BITS) == F.shiftright("cut", shift + CELL_BITS))
        counts = inside.groupBy("source", at.alias("at")).agg(F.sum("size").alias("words"))  # at most 512 rows a source
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("at"))
        placed = on_source(counts.withColumn("upto", upto), state).withColumn("upto", F.col("upto") + F.col("below"))
        # the first cell in which the target is met; the last one, should rounding of the target leave none
        met = F.min(F.when(F.col("upto") >= F.col("target"), F.struct("at", "upto", "words")))
        best = placed.groupBy("source", "target").agg(F.coalesce(met, F.max(F.struct("at", "upto", "words"))).alias("c"))
        cut, below = F.shiftleft("c.at", shift), F.col("c.upto") - F.col("c.words")
        if k == PASSES - 1:
            nearer = F.abs(F.col("c.upto") - F.col("target")) < F.abs(below - F.col("target"))
            cut, below = F.col("c.at") + nearer.cast("long"), F.when(nearer, F.col("c.upto")).otherwise(below)
        new = stored(best.select("source", "target", cut.cast("long").alias("cut"), below.alias("below")), "cuts")
        if k:
            dropped(state)
        state = new
    return state.select("source", "cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL) -> DataFrame:
    """doc_id, size, source_size, target, taken, and besides source, rate and copies, for each row of docs."""
    base = stored(sized(docs), "sizes")
    sizes = stored(base.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = stored(targets(sources, weights, total).select("source", "source_size", "target"), "targets")
    found = multipliers(sizes.where("size > 0"), sources).withColumnRenamed("source", "_s")
    known = sources.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    full = F.when(F.col("target") > 0, F.lit(float(MOST))).otherwise(0.0)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("multiplier").isNull(), full).otherwise(_rate(F.col("multiplier"), F.col("size")))
    rows = stored(_cells(on_source(base, known).withColumn("rate", rate)).drop("multiplier", "draw"), "rates")
    cut = cuts(rows, sources).withColumnRenamed("source", "_s")
    both = rows.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = (F.col("one") < F.col("cut")).cast("int") + (F.col("two") < F.col("cut")).cast("int")
    copies = F.when(F.col("size") > 0, F.coalesce(copies, F.lit(0))).otherwise(0)
    taken = (copies * F.col("size")).cast("long")
    return both.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "rate", copies.alias("copies"))
