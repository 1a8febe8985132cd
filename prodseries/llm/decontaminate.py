"""Benchmark decontamination by word n-grams, on DataFrame functions only.

The windows of the test items (n consecutive words, or a shorter item's words as a whole) become a hash set that travels
with the plan to every task. A document's word windows are hashed in one scan of its words; what hits the hash set is
compared word by word, as whole strings, before it counts. Nothing of a document is shuffled for that.

The set travels with the plan only up to MOST_WINDOWS windows and MOST_CHARS characters, which is checked first with one
small job. A larger benchmark takes the other way: the windows of documents and items meet in a shuffled join.

Words: A-Z is lower-cased, then maximal runs of digits, a-z and characters outside ASCII. Cases: null or empty text and
text without words have no words and no hit; items without words have no windows; a null item_id names no item in
n_items, but its windows count as hits; equal items each count by their id. A null doc_id is kept. Repeated rows give a
row each. Empty tables give no rows, or no hits. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a word is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
#: What the hash set of the plan may hold.
MOST_WINDOWS, MOST_CHARS = 50_000, 8_000_000
PLACES = "array<struct<n:int,start:int,gram:string>>"


def lower_ascii(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column | str) -> Column:
    """Split at what is no word: regexp_extract_all() would copy the text for every match."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def window(tokens: Column, start: Column, n: int) -> Column:
    """n words from position start (1 is the first). Word by word: slice() would copy the whole array each time."""
    return F.concat_ws(" ", *(F.get(tokens, start + (k - 1)) for k in range(n)))


def fingerprint(n: int, start: str) -> str:
    """SQL for the hash of a window of `tokens`: of every fourth word, since equal windows are compared as a whole later."""
    return f"xxhash64({', '.join(f'get(tokens, {start} + {k - 1})' for k in range(0, n, 4))})"


def starts(tokens: Column, n: int) -> Column:
    """1, 2, ... for each window of n words."""
    return F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, n, gram): the different windows of each item and their number of words."""
    tokens = items.select("item_id", words("text").alias("tokens")).where(F.size("tokens") > 0)
    whole = F.array(F.struct(F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("gram")))
    each = F.transform(starts(F.col("tokens"), size), lambda i: F.struct(F.lit(size).alias("n"), window(F.col("tokens"), i, size).alias("gram")))
    grams = F.when(F.size("tokens") < size, whole).otherwise(each)
    return tokens.select("item_id", F.explode(grams).alias("w")).select("item_id", "w.n", "w.gram").distinct()


def _placed(tokens: Column, at: Column, n: int) -> Column:
    """The windows of n words that start at the positions of `at`."""
    return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.alias("start"), window(tokens, i, n).alias("gram")))


def _found(n: int, own: list[tuple[int, str]]) -> Column:
    """The windows of n words of `tokens` that are among `own` (hash, window): by hash first, then as whole strings.

    From 11 constants on Spark keeps those of IN in a hash set, so a short list is filled up.
    """
    own = [*own, *own[:1] * (11 - len(own))]
    hashes = ", ".join(f"{h}L" for h, _ in own)
    grams = ", ".join(f"'{g}'" for _, g in own)  # words hold no quotes and no backslashes
    starts = f"CASE WHEN size(tokens) >= {n} THEN sequence(1, size(tokens) - {n - 1}) ELSE CAST(array() AS array<int>) END"
    near = f"filter({starts}, i -> {fingerprint(n, 'i')} IN ({hashes}))"
    gram = f"concat_ws(' ', {', '.join(f'get(tokens, i + {k - 1})' for k in range(n))})"
    placed = f"transform({near}, i -> struct({n} AS n, i AS start, {gram} AS gram))"
    return F.expr(f"filter({placed}, w -> w.gram IN ({grams}))")


def _short(items: DataFrame, size: int) -> tuple[list[int], list[tuple[int, int, str]] | None]:
    """The window sizes, and (n, hash, window) for all windows if there are few enough to travel with the plan."""
    grams = item_windows(items, size).select("n", "gram").distinct()
    sizes = grams.groupBy("n").agg(F.count("*").alias("k"), F.sum(F.length("gram")).alias("chars")).collect()  # size rows at most
    few = sum(r.k for r in sizes) <= MOST_WINDOWS and sum(r.chars for r in sizes) <= MOST_CHARS
    tokens = grams.select("n", F.split("gram", " ").alias("tokens"), "gram")
    hashed = [tokens.where(f"n = {r.n}").select("n", F.expr(fingerprint(r.n, "1")), "gram") for r in sizes]
    return sorted(r.n for r in sizes), [tuple(r) for h in hashed for r in h.sort("gram").collect()] if few else None


def _covered(hits: Column) -> Column:
    """How many words the (n, start) of hits cover, in order of their starts."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, hit: Column) -> Column:
        end = hit["start"] + hit["n"]
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["sum"] + F.greatest(F.lit(0), end - F.greatest(s["end"], hit["start"]))).alias("sum"))

    by_start = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["n"].alias("n"))))
    return F.when(F.size(hits) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(by_start, state, step)["sum"])


def _hit() -> Column:
    places = F.transform("found", lambda w: F.struct(w["n"].alias("n"), w["start"].alias("start")))
    grams = F.array_distinct(F.transform("found", lambda w: w["gram"]))
    return F.struct("n_words", _covered(F.col("found")).alias("n_hit"), places.alias("hits"), grams.alias("grams"))


def hit_words(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with one more column `hit`: n_words, n_hit, hits (n, start) in word positions from 1, grams (the windows)."""
    sizes, grams = _short(items, size)
    if grams is None:
        return _hit_words_joined(docs, items, sizes, size)
    row = docs.select(F.struct("*").alias("row"), words("text").alias("tokens"))
    found = [_found(n, [g for k, *g in grams if k == n]) for n in sizes]
    none = F.array().cast(PLACES)
    scanned = row.select("row", F.size("tokens").cast("long").alias("n_words"), F.concat(none, *found).alias("found"))
    return scanned.select("row.*", _hit().alias("hit"))


def _hit_words_joined(docs: DataFrame, items: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """The same for a benchmark of any size: all windows are shuffled; a hot window is split by the skew join."""
    grams = item_windows(items, size).select("gram").distinct()
    key = F.struct(F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    texts = docs.select(key.alias("key"), words("text").alias("tokens"))
    tokens = F.col("tokens")
    each = [_placed(tokens, starts(tokens, n), n) for n in sizes]
    windows = texts.select("key", F.explode(F.concat(*each)).alias("w")).select("key", "w.*")
    found = windows.join(grams, "gram").groupBy("key").agg(F.collect_set(F.struct("n", "start", "gram")).alias("found"))
    none = F.array().cast(PLACES)
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.size(words("text")).cast("long").alias("n_words"))
    scanned = rows.join(found, "key", "left").select("row", "n_words", F.sort_array(F.coalesce("found", none)).alias("found"))
    return scanned.select("row.*", _hit().alias("hit"))


def contaminated(hit: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (hit["n_hit"] > 0) & (20 * hit["n_hit"] >= hit["n_words"])


def removed(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without the contaminated ones; columns and other rows stay as they are.

    inline() of no row, not where(): a filter would be pushed down with the whole scan copied into it, many times over.
    """
    found = hit_words(docs.select(F.struct("*").alias("row"), "text", "doc_id"), items, size)
    return found.select(F.inline(F.when(~contaminated(F.col("hit")), F.array("row"))))


def spans_removed(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text): the words of every document that are not hit, lower-cased and joined by a blank."""
    found = hit_words(docs.select("doc_id", "text"), items, size)
    kept = F.filter(words("text"), lambda w, i: ~F.exists("hit.hits", lambda h: (h["start"] <= i + 1) & (i + 1 < h["start"] + h["n"])))
    return found.select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(kept, " ")).alias("text"))


def report(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = hit_words(docs.select("doc_id", "text"), items, size)
    key = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    flat = found.select(key.alias("key"), "hit.n_words", "hit.n_hit", contaminated(F.col("hit")).alias("contaminated"), F.posexplode_outer("hit.grams").alias("at", "gram"))
    names = item_windows(items, size).groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]  # windows repeat each word up to `size` times
    named = flat.join(F.broadcast(names) if chars * size <= 4 * MOST_CHARS else names, "gram", "left")
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    rows = F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0))
    each = named.groupBy("key", "n_words", "n_hit", "contaminated").agg(ids.alias("ids"), rows.cast("int").alias("rows"))
    return each.select(
        F.col("key.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), "contaminated", F.explode(F.sequence(F.lit(1), "rows")).alias("copy"),
    ).drop("copy")


# The same for DuckDB, over views documents and benchmark.
SQL = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS t
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS t
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, n, array_to_string(t[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, t, least(len(t), {SIZE}) AS n, unnest(range(1, len(t) - least(len(t), {SIZE}) + 2)) AS i FROM b WHERE len(t) > 0)),
h AS (
  SELECT w.rid, p.n, p.i, g.item_id
  FROM (SELECT rid, n, i, array_to_string(t[i:i + n - 1], ' ') AS gram
        FROM (SELECT rid, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM g) WHERE len(t) >= n)) p
  JOIN g USING (gram, n) JOIN w USING (rid)),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
d AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT w.doc_id, len(w.t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.t) AS contaminated
FROM w LEFT JOIN c USING (rid) LEFT JOIN d USING (rid)
"""
