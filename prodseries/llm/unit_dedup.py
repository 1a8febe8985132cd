"""Repeated lines: units of text are normalised and hashed, digests are grouped globally, the earliest occurrence stays.

A unit is a line, or a sentence of it, so that a passage put into the middle of a line is met too; `ends` takes another
pattern, such as a blank line for paragraphs. Units are equal if their words are, without regard to case, blanks and
punctuation. Occurrences are ranked by doc_id and offset; all but the first of a digest are removed, and reported with
their offsets in the original text.

repeats() takes every line that is not blank as a whole, whatever its length (a line without words is compared by its
characters), and besides the sentences of a line from LEAST_CHARS characters on; sentence ends without blanks, as in
Chinese, count too. For passages that coincide with neither, it also takes windows of PASSAGE words over the whole text,
across sentences and lines: of every SPREAD windows in a row the one with the smallest hash, so that two copies choose
alike. A run of PASSAGE + SPREAD - 1 equal words thus has a window in common, and loses all but at most SPREAD - 1 words
at each end. In scripts without blanks a character counts as a word, and a window has twice as many. A window that
overlaps the first occurrence of its own digest is left, as that would cut into what is kept. Windows that overlap, in
the text and in the one text that keeps them, are one span. The column `unit` tells lines, sentences and windows apart; spans
of different units may nest and overlap, and cleaned() cuts what any of them covers, once. removed() takes each piece
between `ends` once, without windows, and leaves those of fewer than `least` words alone.

The words of a text are found and hashed once, by array operations; the hash of a unit is that of a range of words, a
difference of two running sums, in two lanes of 64 bits. The first pass only counts digests, before the shuffle, so that a
line in a third of all documents is a few rows by then. The second pass joins the occurrences with the digests that
occur twice or more; both sides are plain inputs of the join, so that Spark splits the partition of a hot digest.

Cases: null and empty texts have no units; a row with a null doc_id ranks after all others; rows with one doc_id and one
text are one occurrence, and each is reported once (n_copies counts the rows); different texts under one doc_id, or
without one, are told apart by text_id, a hash of the text, and rank by it; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodseries.llm.licenses import TO_WORDS
from prodseries.llm.storage import dropped, stored

#: Where units end, and the fewest words of a unit that is compared.
ENDS, LEAST_WORDS = r"\n+|(?<=[.!?])[ \t\r]+", 8
#: Sentence marks after which no blank is needed; they are no part of a word.
MARKS = "。！？｡।॥؟۔"
#: The fewest characters of a sentence in a line: no eight words take less.
LEAST_CHARS = 15

#: Words of a window, and how many windows in a row one is chosen from.
PASSAGE, SPREAD = 16, 12
#: Scripts without blanks between words: Thai to Myanmar, Khmer, kana to Han, Han beyond the first plane.
NO_BLANKS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿\U00020000-\U0003FFFF]")
WORD = np.append(np.frombuffer(TO_WORDS, dtype=np.uint8)[:128] != 0x20, True)
# by code point, 128 standing for all above: blanks at sentence ends, ends that need them, and characters that are not seen
BLANK, END, SPACE = (np.isin(np.arange(129), [ord(c) for c in chars]) for chars in (" \t\r", ".!?", "\t\n\v\f\r\x1c\x1d\x1e\x1f "))
SPACES = np.array([c for c in range(128, 0x3001) if chr(c).isspace()], dtype=np.uint32)
MARK_POINTS = np.array([ord(c) for c in MARKS], dtype=np.uint32)
KINDS = ("line", "sentence", "window")
LINE, SENTENCE, WINDOW = range(3)
#: Characters of the texts that are looked at in one go, and words whose hashes a task remembers.
STEP, REMEMBERED = 1 << 21, 1 << 18
#: Odd factors of the two lanes, and their inverses modulo 2^64.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(f, -1, 1 << 64) for f in FACTORS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """A number for each different word, and the two hashes of each."""

    def __init__(self):
        from xxhash import xxh3_128_digest

        self.digest, self.digests = xxh3_128_digest, []

    def __missing__(self, word: bytes) -> int:
        self.digests.append(self.digest(word))
        self[word] = at = len(self)
        return at

    def hashes(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.digests), dtype=np.uint64).reshape(-1, 2)


def _lower(text: str) -> str:
    """In lower case, character by character, so that places stay, and with blanks for MARKS."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low if low.isascii() else re.sub(f"[{MARKS}]", " ", low)


def _places(low: str, apart: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a lower-cased text and where they start and end; with apart, each character of NO_BLANKS is a word."""
    points = np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)
    inside = np.concatenate([[False], WORD[np.minimum(points, 128)], [False]])
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    if not apart:
        return low.encode().translate(TO_WORDS).split(), np.flatnonzero(begins), np.flatnonzero(ends)
    for m in NO_BLANKS.finditer(low):
        begins[m.start()] = ends[m.end()] = True
        begins[m.end()] |= inside[m.end() + 1]
        ends[m.start()] |= inside[m.start()]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return [low[a:b].encode().translate(TO_WORDS) for a, b in zip(starts.tolist(), stops.tolist())], starts, stops


def _between(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    """The (start, end) between the matches of ends."""
    start = 0
    for m in ends.finditer(text):
        yield start, m.start()
        start = m.end()
    yield start, len(text)


def _lines(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the lines that are not blank, and of the sentences of those that have several pieces."""
    points = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), dtype=np.uint32)
    low = np.minimum(points, 128)
    visible = ~SPACE[low]
    seen = np.cumsum(visible if text.isascii() else visible & ~np.isin(points, SPACES))
    newline, blank, mark = points == 0x0A, BLANK[low], END[low]
    after = np.zeros(len(points), dtype=bool)  # between pieces without a blank
    if not text.isascii():
        after[1:] = np.isin(points, MARK_POINTS)[:-1]
    # blanks are between sentences if what stands before their run ends one
    run = blank & ~np.concatenate([[False], blank[:-1]])
    ends = np.concatenate([[False], mark[:-1]]) | after
    between = newline | (blank & (np.concatenate([[False], ends[run]])[np.cumsum(run)]))

    def runs(cut: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~cut
        begins = np.flatnonzero(inside[1:] & (cut[:-1] | at[1:])) + 1
        stops = np.flatnonzero(inside[:-1] & (cut[1:] | at[1:])) + 1
        full = seen[stops - 1] > seen[begins - 1]
        return begins[full], stops[full]

    start, stop = runs(newline, np.zeros(len(points), dtype=bool))
    a, b = runs(between, after)
    line = np.searchsorted(start, a, side="right") - 1
    several = (np.bincount(line, minlength=len(start)) > 1)[line] & (b - a >= LEAST_CHARS)
    a, b = a[several], b[several]
    kind = np.concatenate([np.full(len(start), LINE), np.full(len(a), SENTENCE)])
    return np.concatenate([start, a]) - 1, np.concatenate([stop, b]) - 1, kind


def _chosen(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the windows first[i] ... first[i] + n[i] - 1 of each text those with the smallest hash of SPREAD in a row."""
    found = []
    for a, k in zip(first[(n > 0) & (n < SPREAD)].tolist(), n[(n > 0) & (n < SPREAD)].tolist()):
        found.append(a + int(hashes[a : a + k].argmin()))
    long = n >= SPREAD
    own = np.repeat(first[long] - np.concatenate([[0], np.cumsum(n[long] - SPREAD + 1)])[:-1], n[long] - SPREAD + 1)
    rows = np.arange(len(own)) + own
    if len(rows):
        at = np.lib.stride_tricks.sliding_window_view(hashes, SPREAD)[rows].argmin(1) + rows
        found = np.concatenate([np.array(found, dtype=np.int64), at])
    at = np.unique(np.array(found, dtype=np.int64))
    if not len(at):
        return at
    # in a run of one word all windows are equal: each SPREAD-th is enough
    text = np.searchsorted(first, at, side="right") - 1
    new = np.concatenate([[True], (hashes[at[1:]] != hashes[at[:-1]]) | (text[1:] != text[:-1])])
    return at[new | ((at - first[text]) % SPREAD == 0)]


class _Ranges:
    """Hashes of ranges of the words of several texts, one after the other."""

    def __init__(self, words: np.ndarray, hashes: np.ndarray):
        def powers(factor: int) -> np.ndarray:
            each = np.full(len(words) + 1, factor, dtype=np.uint64)
            each[0] = 1
            return np.cumprod(each, dtype=np.uint64)

        self.sums, self.back = [], [powers(f) for f in INVERSES]
        for lane, factor in enumerate(FACTORS):
            sums = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(hashes[words, lane] * powers(factor)[:-1], dtype=np.uint64, out=sums[1:])
            self.sums.append(sums)

    def of(self, first: np.ndarray, last: np.ndarray, lane: int, seed: int = 0) -> np.ndarray:
        sums = (self.sums[lane][last] - self.sums[lane][first]) * self.back[lane][first]
        return _mix(sums + (last - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))


def _group(texts: list[str], known: _Words, cut: re.Pattern | None) -> tuple[np.ndarray, ...]:
    """(text, start, end, n_words, first word, kind, and the two lanes of the digest) of each unit of the texts.

    The texts are looked at as one, with line ends between them, which nothing crosses.
    """
    joined = "\n".join(texts)
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    low = _lower(joined)
    if cut is None:
        begin, stop, kind = _lines(joined)
    else:
        begin, stop = np.array([(a + at, b + at) for t, at in zip(texts, base.tolist()) for a, b in _between(t, cut)], dtype=np.int64).reshape(-1, 2).T
        kind = np.full(len(begin), LINE)
    parts = []
    for apart, size in ((False, PASSAGE), (True, 2 * PASSAGE)):
        if apart and (cut is not None or not NO_BLANKS.search(low)):
            continue
        words, starts, ends = _places(low, apart)
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ranges = _Ranges(number, known.hashes())
        first = np.searchsorted(starts, base)  # of each text, and after the last
        if not apart:
            text = np.searchsorted(base, begin, side="right") - 1
            a, b = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
            lanes = [ranges.of(a, b, lane) for lane in (0, 1)]
            for k in np.flatnonzero(a == b).tolist():  # without words: its characters
                lanes[0][k], lanes[1][k] = _characters(joined[begin[k] : stop[k]].strip())
            parts.append((text, begin, stop, b - a, a - first[text], kind, *lanes))
        if cut is None:
            at = np.arange(max(0, len(words) - size + 1))
            hashes = ranges.of(at, at + size, 0, 2 + apart)
            count = np.diff(first)
            if apart:  # only where such characters are
                count = np.where([NO_BLANKS.search(t) is not None for t in texts], count, 0)
            at = _chosen(hashes, first[:-1], np.maximum(count - size + 1, 0))
            text = np.searchsorted(base, starts[at], side="right") - 1
            parts.append((
                text, starts[at], ends[at + size - 1], np.full(len(at), size), at - first[text], np.full(len(at), WINDOW),
                hashes[at], ranges.of(at, at + size, 1, 2 + apart)))
    text, begin, stop, *rest = (np.concatenate(c) for c in zip(*parts))
    return text, begin - base[text], stop - base[text], *rest


def _characters(text: str) -> tuple[np.uint64, np.uint64]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(b"\0" + text.encode()), dtype=np.uint64))


def units(docs: DataFrame, ends: str | None = None, least: int = LEAST_WORDS, only_digests: bool = False) -> DataFrame:
    """(h1, h2, doc_id, text_id, start, end, n_words, word, kind) of each unit; h1, h2 are its digest, word the place of its
    first word; offsets in code points, the end exclusive.

    The lines, sentences and windows of repeats(); with ends, the pieces between its matches that have `least` words.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["h1", "h2"] if only_digests else ["h1", "h2", "doc_id", "text_id", "start", "end", "n_words", "word", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = _Words(), ends and re.compile(ends)
        for batch in batches:
            texts, start, size = [], 0, 0
            for i, text in enumerate(batch.column(0)):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size < STEP and i + 1 < len(batch):
                    continue
                own, begin, stop, n, word, kind, one, two = _group(texts, known, cut)
                if ends is not None:
                    own, begin, stop, n, word, kind, one, two = (x[n >= least] for x in (own, begin, stop, n, word, kind, one, two))
                columns = [pa.array(x.view(np.int64)) for x in (one, two)]
                if not only_digests:
                    at = pa.array(own + start)
                    columns += [batch.column(1).take(at), batch.column(2).take(at)]
                    columns += [pa.array(x.astype(np.int32)) for x in (begin, stop, n, word, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                texts, start, size = [], i + 1, 0
                if len(known) > REMEMBERED:
                    known = _Words()

    texts = docs.where("text IS NOT NULL")
    texts = texts.select("text") if only_digests else texts.select("text", "doc_id", F.xxhash64("text").alias("text_id"))
    more = "" if only_digests else f", doc_id {key}, text_id bigint, start int, end int, n_words int, word int, kind int"
    return texts.mapInArrow(run, f"h1 bigint, h2 bigint{more}")


def removed(docs: DataFrame, ends: str = ENDS, least: int = LEAST_WORDS) -> DataFrame:
    """The pieces to remove: doc_id, start, end, n_words, kept_doc_id, kept_start, n_copies, text_id, unit."""
    return _later(docs, ends, least)


def repeats(docs: DataFrame) -> DataFrame:
    """The same over all lines, whatever their length, the sentences in them, and windows for other passages."""
    return _later(docs)


def _later(docs: DataFrame, ends: str | None = None, least: int = LEAST_WORDS) -> DataFrame:
    counts = units(docs, ends, least, only_digests=True).groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1")
    counts = stored(counts, "repeated")
    found = units(docs, ends, least).join(counts.hint("merge"), ["h1", "h2"])
    found = stored(found, "occurrences")
    dropped(counts)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id", "start", "end")
    kept = stored(found.groupBy("h1", "h2").agg(F.min(rank).alias("kept")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_id") == F.col("kept.text_id"))
    into = same & (F.col("start") < F.col("kept.end"))  # itself, or over it
    joined = found.join(kept.hint("merge"), ["h1", "h2"]).where(~into)
    kept_columns = [F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("doc_id", "text_id", "start", "end")]
    joined = joined.select("doc_id", "text_id", "start", "end", "n_words", "word", "kind", "copies", *kept_columns).distinct()
    single = joined.where(F.col("kind") != WINDOW).unionByName(_joined(joined.where(F.col("kind") == WINDOW)))
    return single.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n_words").cast("long").alias("n_words"),
        "kept_doc_id", F.col("kept_start").cast("long").alias("kept_start"), F.col("copies").alias("n_copies"), "text_id",
        F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("unit"))


def _joined(windows: DataFrame) -> DataFrame:
    """Windows that overlap the one before, here and in the text that keeps them, as one span; copies: the most of any."""
    whose = ["doc_id", "text_id", "kept_doc_id", "kept_text_id"]  # one text's windows that one other text keeps
    order = Window.partitionBy(*whose).orderBy("start", "end", "kept_start", "copies")
    before = lambda c: F.lag(c).over(order)
    on = (F.col("start") <= before("end")) & (F.col("kept_start") >= before("kept_start")) & (F.col("kept_start") <= before("kept_end"))
    run = F.sum(F.when(on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return windows.withColumn("run", run).groupBy(*whose, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.col("word") + F.col("n_words")).alias("stop"), F.min("word").alias("word"),
        F.max("copies").alias("copies"), F.min("kept_start").alias("kept_start"), F.max("kept_end").alias("kept_end"),
    ).withColumn("n_words", F.col("stop") - F.col("word")).withColumn("kind", F.lit(WINDOW)).drop("run", "stop")


def cleaned(docs: DataFrame, ends: str | None = None, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, removed): each document without what repeats() reports, or with ends what removed() does; removed
    holds the cuts as original (start, end), spans that overlap or touch as one."""
    spans = _later(docs, ends, least).groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    same = texts["doc_id"].eqNullSafe(spans["doc_id"]) & (F.col("own") == F.col("text_id"))
    both = texts.join(spans, same, "left").select(texts["doc_id"], "text", "spans")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, cuts = batch.column(1).to_pylist(), []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                merged = []
                for s in spans or []:
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                if merged:
                    edges = [0, *chain.from_iterable((m["start"], m["end"]) for m in merged), len(texts[i])]
                    texts[i] = "".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2]))
                cuts.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(cuts, cuts_type)], names=["doc_id", "text", "removed"])

    return both.mapInArrow(run, f"doc_id {key}, text string, removed array<struct<start: bigint, end: bigint>>")
