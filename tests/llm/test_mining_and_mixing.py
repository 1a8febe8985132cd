"""Hard negatives, source mixes and the filter audit against plain versions, and on odd rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prodseries.llm import filter_audit, hard_negatives, source_mix

VECTORS = "vec_id long, embedding array<double>, label int"
DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
CLASH = "row v a label n mask part digest first last chars upper words good toxic draw size target rate one two cut weight _source block anchor rank place step kept".split()


def clashing(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns))


def negatives(rows, positives=5, k=10):
    """Of (vec_id, components, label), by all pairs."""
    fine = [(i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v, _ in fine)
    size = max(sizes, key=lambda n: (sizes[n], n), default=0)
    fine = [r for r in fine if len(r[1]) == size]
    out = []
    for n, (a, q, label) in enumerate(fine):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for m, (i, v, l) in enumerate(fine) if m != n)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(i, s) for s, i, l in scored if l != label and 30 * -ps <= 100 * -s <= 90 * -ps][:k]
            out += [(a, p, r, i, -ps, -s) for r, (i, s) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **args):
    columns = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    return sorted(tuple(r) for r in hard_negatives.mine(df, **args).select(*columns).collect())


def vectors(n, size=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, size))
    v = centers[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, size))
    v *= rng.lognormal(0, 0.5, n)[:, None]
    return [(int(i), [float(x) for x in row], int(rng.integers(0, 10))) for i, row in zip(rng.permutation(3 * n)[:n] * 4, v)]


@pytest.mark.parametrize("block,asked,buckets", [(4096, 256, 512), (50, 3, 4), (40, 2, 1000)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, block, asked, buckets):
    for name, value in (("BLOCK", block), ("ASKED", asked), ("BUCKETS", buckets)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(700)
    rows += [(100 + i, rows[5][1], 3) for i in range(200)]  # a hot vector, and ids that come twice
    rows += [(9000, rows[6][1], 2), (9000, rows[6][1], 2), (9100, [0.0] * 8, 2), (9200, [-x for x in rows[7][1]], 1)]
    want = negatives(rows)
    assert len(want) > 100
    assert mined(spark.createDataFrame(rows, VECTORS)) == want


def test_pruning_skips_and_loses_nothing():
    rng = np.random.default_rng(3)
    v = np.floor(256 * (rng.standard_normal((500, 16)) * rng.lognormal(0, 1, 500)[:, None]))
    v = v[np.argsort(-hard_negatives.length(v))][:200]
    lists = np.argsort(hard_negatives.units(v).T, axis=1, kind="stable").astype(np.uint16)
    block = hard_negatives.Block(np.arange(200), np.arange(200), np.zeros(200), v.tobytes(), lists.tobytes(), float(hard_negatives.length(v).max()))
    looked = 0
    for q in v[:40]:
        scores = v @ q
        for least in np.percentile(scores, [1, 50, 90, 99]).astype(int).tolist() + [int(scores.max()) + 1, 10**9]:
            found = block.candidates(q, least)
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
            looked += len(found)
    assert looked < 0.9 * 40 * 6 * 200
    assert len(block.candidates(v[0], int(2 * (v[0] @ v[0])))) == 0


def test_anchors_are_not_copied_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 5)
    rows = [(25 * i, v, label) for i, v, label in vectors(600)]  # all are anchors: a copy of them for each block is over 10 MB
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        assert mined(spark.createDataFrame(rows, VECTORS)) == negatives(rows)
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)


@pytest.mark.parametrize("few,cells,pending,scale", [(0, 1 << 19, 1 << 17, 50), (16, 900, 30, 50), (10**6, 100, 30, 50), (16, 900, 30, 10**6), (16, 900, 30, 10**8)])
def test_blocks_that_meet_leave_the_best(monkeypatch, few, cells, pending, scale):
    """few: no range is too wide, some are, or all; scale: sums in single precision, in double and in Python's integers."""
    for name, value in (("FEW", few), ("CELLS", cells), ("PENDING", pending)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(8)
    v = np.repeat(rng.standard_normal((12, 6)), 30, 0) + 0.1 * rng.standard_normal((360, 6))
    v[40:60] = v[40]  # equal scores
    v = np.floor(scale * v[np.argsort(-np.abs(v).max(1))])
    ids, labels, exact = rng.permutation(360) // 2, rng.integers(0, 3, 360), [[int(x) for x in r] for r in v]
    score = [[sum(map(int.__mul__, a, b)) for b in exact] for a in exact]
    whose = sorted(range(0, 360, 6), key=lambda i: (labels[i], i))
    limits = [[(max(score[a]) * p // 10, max(score[a]) * q // 10) for p, q in ((3, 9), (5, 7), (9, 3))] for a in whose]
    for same in (True, False):
        least, most = (np.array([[x[i] for x in row] for row in limits]) for i in (0, 1))
        if same:
            least, most = np.full((60, 1), hard_negatives.LEAST), np.full((60, 1), hard_negatives.MOST)
        asked = hard_negatives.Asked(np.array(whose), labels[whose], v[whose].tobytes(), least, most, 4)
        for part in np.array_split(np.arange(360), 5):
            part = part[np.argsort(labels[part], kind="stable")]
            lists = np.argsort(hard_negatives.units(v[part]).T, axis=1, kind="stable").astype(np.uint16)
            block = hard_negatives.Block(part, ids[part], labels[part], v[part].tobytes(), lists.tobytes(), float(hard_negatives.length(v[part]).max()))
            hard_negatives.meet(block, asked, same)
        want = []
        for n, a in enumerate(whose):
            for place, (low, high) in enumerate([(None, None)] if same else limits[n]):
                fits = [b for b in range(360) if (labels[a] == labels[b]) == same and a != b and (same or low <= score[a][b] <= high)]
                fits = sorted(fits, key=lambda b: (-score[a][b], ids[b], b))[:4]
                want += [(n * (1 if same else 3) + place, score[a][b], ids[b], b) for b in fits]
        assert len(want) > 100 and [*zip(*asked.settle())] == want


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, None, 1), (200, [nan, 1.0], 1), (300, [1.0, inf], 1), (400, [None, 1.0], 1), (500, [1.0], 1), (None, [1.0, 1.0], 1),
            (600, [1.0, 1.0], None), (2, [2.0, 0.5], 2), (3, [0.5, 0.25], 3), (4, [0.9, 0.1], 3), (5, [-1.0, -1.0], 2), (7, [2.0, 1.0], 1), (700, [0.0, 0.0], 4)]
    df = spark.createDataFrame(rows, VECTORS)
    want = negatives(rows)
    assert want and mined(clashing(df)) == want
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id IS NULL")) == []
    assert mined(spark.createDataFrame([(0, [], 1), (100, [], 1), (3, [], 2)], VECTORS)) == negatives([(0, [], 1), (100, [], 1), (3, [], 2)])
    big = [(0, [2.0**23, 1.0], 1), (1, [2.0**22, 3.0], 1), (2, [2.0**21, 5.0], 2)]
    assert mined(spark.createDataFrame(big, VECTORS)) == negatives(big)  # beyond the integers of a double


def water(sizes):
    """Targets by {source: words}, by sharing again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in above}
        rest -= sum(target[s] for s in above)
        open_ -= above
    return target


def texts(n, seed=5):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), rng.choice(["a"] * 9 + ["b", "c", "d", "é", "z", None, ""])) for i in range(n)]


def test_mix_meets_its_targets(spark):
    rows = texts(4000)
    rows += [(10_000 + i, "same text here", "b") for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = source_mix.mix(clashing(docs)).collect()
    sizes, taken, docs_of = Counter(), Counter(), defaultdict(list)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        docs_of[r.source].append(r)
    target = water(sizes)
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(len(t.split()) for _, t, _ in rows)
    for s, of in docs_of.items():
        assert {r.source_size for r in of} == {sizes[s]} and all(abs(r.target - target[s]) < 1e-6 * target[s] for r in of)
        assert abs(taken[s] - target[s]) <= max(r.size for r in of)
        assert all(r.taken == r.copies * r.size <= 2 * r.size for r in of)
        assert all(abs(r.copies - r.rate) < 1 + 0.05 for r in of if r.size)  # rounded to a neighbour, but for the shift
        # the rates meet the constraint, and are tilted by the size: the logarithm is proportional to it
        assert abs(sum(r.size * r.rate for r in of) - target[s]) <= 1e-6 * target[s]
        slopes = [math.log(r.rate) / r.size for r in of if r.size and 0 < r.rate < 2]
        assert not slopes or max(slopes) - min(slopes) < 1e-9
    again = source_mix.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", None), (None, "x y z", None), (4, "w " * 50_000, "b"), (5, " \t\n", "c"), (6, "one", "d"), (6, "one", "d")]
    got = source_mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == sorted(
        [("1", 0, 0), ("2", 0, 0), ("None", 3, 6), ("None", 3, 6), ("4", 50_000, 50_000), ("5", 0, 0), ("6", 1, 2), ("6", 1, 2)])
    assert all(r.taken <= 2 * r.size for r in got)
    want = water({"a": 0, None: 6, "b": 50_000, "c": 0, "d": 2})
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert source_mix.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in source_mix.mix(spark.createDataFrame([(1, None, None)], DOCS)).collect()] == [0]


def played(rows):
    """Each order played through, from (part, mask, good, toxic)."""
    out = []
    for part in {r[0] for r in rows}:
        of = [r[1:] for r in rows if r[0] == part]
        steps, total = [], Counter()
        for order in itertools.permutations(range(5)):
            left = of
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0] >> f & 1]
                failed = sum(r[0] >> f & 1 for r in of)
                left = [r for r in left if not r[0] >> f & 1]
                total[f] += len(gone)
                steps.append((f, ("".join("ABCDE"[i] for i in order), step, len(left), len(gone), failed - len(gone),
                                  sum(r[0] == 1 << f for r in of), sum(r[1] for r in gone), sum(r[2] for r in gone))))
        out += [(part, *row, total[f]) for f, row in steps]
    return sorted(out)


def test_orders_of_the_audit(spark):
    assert len({tuple(o) for o in [_orders_seen(n) for n in (5,)][0]}) == 120
    rng = random.Random(4)
    rows = [(rng.choice(["", "p", "q"]), rng.choice([0, 1, 3, 8, 16, 31, rng.randrange(32)]), rng.random() < 0.5, rng.random() < 0.1) for _ in range(400)]
    counts = filter_audit.counted(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"))
    assert sorted(tuple(r) for r in filter_audit.audit(counts).collect()) == played(rows)


def _orders_seen(n):
    order, seen = [*range(n)], []
    seen.append([*order])
    for k in filter_audit.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append([*order])
    return seen


def test_swaps_keep_the_diagram_small():
    weights = {0: (9, 1, 0), 31: (9, 1, 0)}
    d = filter_audit.Diagram(weights, 5)
    sizes = [len(level) for level in d.levels]
    for k in (0, 1, 2, 3, 3, 2, 1, 0):
        d.swap(k)
    assert [len(level) for level in d.levels] == sizes and d.order == [*range(5)] and d.weights[0] == [(18, 2, 0)]


def test_audit_of_odd_rows(spark):
    long = "A$ b " * 30_000
    rows = [(1, None, "s"), (2, "", "s"), (None, "", None), (None, "", None), (4, long, ""), (5, long, "t"), (5, long, "t"), (6, "Abc " * 300, None), (7, "AB", "s")]
    labels = [(1, 1, 0), (1, 1, None), (2, None, 1), (None, 1, 1), (5, 0, 1), (5, 1, 0), (99, 1, 1)]
    docs, said = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = sorted(tuple(r) for r in filter_audit.report(clashing(docs), clashing(said)).collect())
    flags = lambda d: (d in (1, 5), d in (2, 5))
    masks = [("s", 1, *flags(1)), ("s", 1 | 16, *flags(2)), ("", 1, False, False), ("", 1, False, False), ("", 2 | 4 | 8, *flags(4)),
             ("t", 2 | 4 | 8 | 16, *flags(5)), ("t", 2 | 4 | 8 | 16, *flags(5)), ("", 2 | 4, *flags(6)), ("s", 1 | 4, *flags(7))]
    assert got == played(masks)
    assert filter_audit.report(docs.limit(0), said).count() == 0
    assert filter_audit.report(docs, said.limit(0)).count() == 3 * 600
