"""Language identification by error-correcting output codes.

Every language gets a codeword. One binary classifier a bit, a naive Bayes over hashed byte n-grams of the lower-cased
letters, says which half of the languages a text looks like; the language whose codeword is nearest to these answers
wins. Decoding is loss-weighted: a bit counts for a language as much as its classifier was right on that language's
training texts, and a wrong bit costs more the surer it was. A text whose two nearest codewords are about equally near
is flagged ambiguous.

Training counts n-grams over all training rows with sums per task, so its size is languages x buckets whatever the
corpus; nothing is sampled. Rows to learn from and rows to predict are the caller's choice.

Cases: null text, empty text and text without a letter are `und` with score 0; so is everything when no row is labelled;
with one language all other texts get it. Rows with a null lang are not learned from. A null doc_id is kept (and counts
as held out: it has no remainder). Repeated rows get equal results, ties go to the first language in string order, an
empty table gives an empty result, other columns are not looked at. A long text is read in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-grams, their lengths in bytes, and the most languages one model takes.
BUCKETS, GRAMS, MOST_LANGUAGES = 1 << 15, (1, 2, 3, 4), 512
#: Bytes looked at in one go, and rows, so that a task's memory is bounded.
STEP, ROWS = 1 << 19, 512
#: Nearest codewords with loss ratios above this are too close to tell apart.
AMBIGUOUS = 0.98
#: The most that one n-gram says, so that the language of most of a mixed text wins and not its oddest letters.
MOST_WEIGHT = 1.5
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)
# ASCII letters become lower-case; other ASCII becomes a blank; bytes of other characters stay
LETTERS = np.array([b | 0x20 if chr(b).isalpha() else 0x20 for b in range(128)] + [*range(128, 256)], dtype=np.uint8)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to six languages: all different splits; more: splits drawn to lie far apart."""
    if k < 2:
        return np.ones((k, 0), dtype=np.int8)
    if k <= 6:
        return np.array([[1 if i == 0 or j >> (i - 1) & 1 else -1 for j in range(2 ** (k - 1) - 1)] for i in range(k)], dtype=np.int8)
    bits, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(k), (-1, None)
    for _ in range(200):
        code = np.where(rng.random((k, bits)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(0, dtype=int)) < k]
        agree = code.astype(int) @ code.T
        np.fill_diagonal(agree, -bits)
        if (apart := (code.shape[1] - agree.max()) // 2) > best[0]:
            best = (apart, code)
    return best[1]


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each n-gram, bucket of each n-gram), in steps of about STEP bytes; n-grams do not cross rows or steps."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", dtype=np.uint8)
    if not len(lower) or offsets[-1] == offsets[0]:
        return
    for start in range(int(offsets[0]), int(offsets[-1]), STEP):
        end = min(start + STEP, int(offsets[-1]))
        code = LETTERS[data[start:end]].astype(np.uint32)
        first, last = np.searchsorted(offsets, [start, end - 1], side="right") - 1
        edges = np.clip(offsets[first : last + 2] - start, 0, end - start)
        row = np.repeat(np.arange(first, last + 1), np.diff(edges))
        blank = code == 0x20
        mixed = np.zeros(len(code), dtype=np.uint32)
        for n in range(1, max(GRAMS) + 1):
            size = len(code) - n + 1
            if size <= 0:
                break
            mixed = mixed[:size] + code[n - 1 :] * MULTIPLIERS[n - 1]
            if n in GRAMS:
                own = row[:size]
                use = (own == row[n - 1 :]) & ~(blank[:size] & blank[n - 1 :])
                hashed = (mixed ^ (mixed >> 15)) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)
                yield own[use], ((hashed ^ (hashed >> 13)) & np.uint32(BUCKETS - 1))[use]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what is made from them is a multiple of their size."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits

    def answers(self, texts: pa.Array) -> np.ndarray:
        """Each row's bits as numbers from -1 to 1."""
        sums, seen = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for row, bucket in pieces(texts):
            if len(row):
                seen += np.bincount(row, minlength=len(texts))
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                for bit in range(self.code.shape[1]):
                    sums[row[starts], bit] += np.add.reduceat(self.weights[bit].take(bucket), starts)
        # the evidence of all n-grams, damped by their number: they are not independent
        return np.tanh(sums / np.sqrt(np.maximum(seen, 1))[:, None])

    def decode(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each row."""
        loss = sum(
            (np.exp(-answers[:, bit, None] * self.code[None, :, bit]) * self.trust[None, :, bit] for bit in range(self.code.shape[1])),
            np.zeros((len(answers), len(self.languages))),
        )
        nearest = loss.argmin(1)
        rows = np.arange(len(loss))
        near = np.exp(-4 * (loss - loss[rows, nearest, None]))
        if len(self.languages) < 2:
            return nearest, np.ones(len(loss)), np.zeros(len(loss), dtype=bool)
        order = np.sort(loss, axis=1)
        return nearest, 1 / near.sum(1), order[:, 0] >= AMBIGUOUS * order[:, 1]


def _counts(train: DataFrame, languages: list[str]) -> np.ndarray:
    """Languages x buckets: how often each n-gram occurs, exactly."""
    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in sliced(batches):
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for row, bucket in pieces(batch.column(1)):
                total += np.bincount(lang[row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[at, bucket])], names=["at", "bucket", "n"])

    out = np.zeros((len(languages), BUCKETS), dtype=np.int64)
    summed = train.mapInArrow(run, "at int, bucket int, n bigint").groupBy("at", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()  # languages x buckets at most
    out[rows["at"], rows["bucket"]] = rows["n"]
    return out


def fit(docs: DataFrame) -> Model:
    """Learn from all rows of docs (text, lang) with a lang and a letter."""
    train = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    found = [r[0] for r in train.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: one model is not meant for that")
    languages = sorted(found)
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(tuple(languages), code, np.zeros((0, BUCKETS), dtype=np.float32), np.ones(code.shape))
    counts = _counts(train, languages) + 0.5
    shares = counts / counts.sum(1, keepdims=True)
    weights = np.array([np.log(shares[c > 0].mean(0) / shares[c < 0].mean(0)) for c in code.T], dtype=np.float32)
    weights = weights.clip(-MOST_WEIGHT, MOST_WEIGHT)
    model = Model(tuple(languages), code, weights, np.ones(code.shape))
    return Model(tuple(languages), code, weights, _trust(train, model))


def _trust(train: DataFrame, model: Model) -> np.ndarray:
    """How often each bit was right on each language's training rows, each language's row scaled to mean 1."""
    sent, place, bits = _sent(train, model), {lang: i for i, lang in enumerate(model.languages)}, model.code.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        right = np.zeros((len(place), bits + 1), dtype=np.int64)
        for batch in sliced(batches):
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            np.add.at(right, (lang, bits), 1)
            np.add.at(right[:, :bits], lang, model.answers(batch.column(1)) * model.code[lang] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(place), dtype=np.int32)), pa.array(list(right), pa.list_(pa.int64()))], names=["at", "n"])

    sums = [F.sum(F.col("n")[i]) for i in range(bits + 1)]
    out = np.ones((len(place), bits))
    for at, *n in train.mapInArrow(run, "at int, n array<bigint>").groupBy("at").agg(*sums).collect():  # a row a language
        out[at] = (np.array(n[:bits]) + 1) / (n[bits] + 2)
    return out / out.mean(1, keepdims=True)


def _sent(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast(model)  # 4 x BUCKETS bytes a bit


def predict(docs: DataFrame, model: Model, *keep: str, within: str | None = None) -> DataFrame:
    """The columns keep of docs (text, ...), then lang_pred, score, ambiguous.

    within: one of keep, a struct whose field `text` is read instead, so that the text goes to the workers once.
    """
    sent, n = _sent(docs, model), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in sliced(batches):
            texts = pc.struct_field(batch.column(keep.index(within)), "text") if within else batch.column(n)
            known = has_letter(texts)
            at, score, ambiguous = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            if model.languages and known.any():
                at[known], score[known], ambiguous[known] = model.decode(model.answers(texts.filter(pa.array(known))))
            columns = [*batch.columns[:n], pa.array(names[at], pa.string()), pa.array(score), pa.array(ambiguous)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n], "lang_pred", "score", "ambiguous"])

    kept = docs.select(*keep) if within else docs.select(*keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:n]]
    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, ambiguous boolean"]))


def held_out() -> F.Column:
    """The fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each document; learns from the documents not held out."""
    model = fit(docs.where(~held_out()))
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(marked, model, "doc_id", "held_out")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told: neither `und` nor ambiguous. Their columns stay as they are."""
    model = fit(docs.where(~held_out()))
    row = docs.select(F.struct("*").alias("row"))
    return predict(row, model, "row", within="row").where("lang_pred <> 'und' AND NOT ambiguous").select("row.*")
