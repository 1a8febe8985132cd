"""BPE encoding and decoding of whole texts.

Encoding keeps the symbols of a piece in a doubly linked list and their mergeable neighbours in a priority queue of
(rank, position); an entry whose symbols have changed meanwhile is stale and skipped. That is O(n log n), so one piece
of a million letters is as safe as a short word. Decoding concatenates the vocabulary strings of the ids.

The tokenizer file is a JSON of the `tokenizers` library with a BPE model and byte-level splitting. It is read once on
the driver and sent to the tasks (a fixed file of a few MB); no task opens it.

Cases: a null text counts as empty and gets no ids; a null doc_id is kept; repeated rows give repeated results; an empty
table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to this many characters are remembered, and twice so many of them while a task runs.
CACHED_CHARS, CACHED_PIECES = 32, 150_000
#: Rows and characters of one Arrow batch that a task sends back.
BATCH_ROWS, BATCH_CHARS = 512, 2_000_000


def default_path() -> str:
    """The 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def latin_pattern() -> str:
    """PATTERN with its classes written out for the characters below 256, which `re` scans much faster."""
    chars = [chr(i) for i in range(256)]
    letters, numbers = ("".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k) for k in "LN")
    space = "".join(re.escape(c) for c in chars if c.isspace() and c not in "\x1c\x1d\x1e\x1f")
    rest = f"{space}{letters}{numbers}"
    return rf" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{rest}]+|[{space}]+(?![^{space}])|[{space}]+"


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"only plain byte-level BPE is supported, not {odd or pre}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they stand")
        import regex

        vocab = model["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = [vocab[c] for c in chars]
        # a pair is one number, and so are its rank and what it becomes; the lower rank is the smaller number
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for piece, i in chain(vocab.items(), self.added.items()):
            whole = all(c in byte_of for c in piece)
            self.strings[i] = bytes(byte_of[c] for c in piece) if whole else piece.encode()
        self.find, self.find_latin = regex.compile(PATTERN).findall, re.compile(latin_pattern()).findall
        added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.split, self.found = added.split, added.findall
        self.decimal = [str(i) for i in range(len(self.strings))]
        self.known = _Pieces(self.merge)

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        merges = self.merges.get
        symbols = [self.first[b] for b in piece.encode()]
        n = len(symbols)
        queue = [(m, i) for i in range(n - 1) if (m := merges(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not queue:
            return tuple(symbols)
        heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            m, i = heappop(queue)
            left, j = symbols[i], after[i]
            if j < 0 or left < 0 or merges(left << 32 | symbols[j]) != m:
                continue  # stale: one of the two has been merged meanwhile
            symbols[i], symbols[j] = m & 0xFFFFFFFF, -1
            merged = symbols[i]
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := merges(merged << 32 | symbols[k])) is not None:
                    heappush(queue, (m, i))
            h = before[i]
            if h >= 0 and (m := merges(symbols[h] << 32 | merged)) is not None:
                heappush(queue, (m, h))
        return tuple([s for s in symbols if s >= 0])

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def encode(self, text: str) -> list[int]:
        known = self.known.__getitem__
        parts = self.split(text)
        ids = list(chain.from_iterable(map(known, self.pieces(parts[0]))))
        if len(parts) > 1:
            for found, part in zip(self.found(text), parts[1:]):
                ids.append(self.added[found])
                ids += chain.from_iterable(map(known, self.pieces(part)))
        return ids

    def forget(self) -> None:
        """Drop the remembered pieces: a Python worker outlives its tasks, and what it holds is missing elsewhere."""
        self.known = _Pieces(self.merge)

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no valid UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Ids by piece. When full it becomes the older half and starts anew, so its size is bounded and what is used stays."""

    def __init__(self, merge):
        self.merge, self.older = merge, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.merge(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec_of(text: str) -> Codec:
    """The tokenizer file's codec; a Python worker keeps the tables of the last one for its next task."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(text)
    return _codecs[key]


def _spec(docs: DataFrame, path: str | None):
    with open(path or default_path(), encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _mapped(df: DataFrame, spec, schema: str, row) -> DataFrame:
    """row: (codec, value) -> the new columns after doc_id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = codec_of(spec.value)
        names, kinds = zip(*(c.split() for c in schema.split(", ")))
        types = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "bigint": pa.int64()}
        for batch in batches:
            keys, values, rows, size, start = batch.column(0), batch.column(1), [], 0, 0
            for i, value in enumerate(values):
                value = value.as_py()
                rows.append(row(codec, value))
                size += len(value)
                if size >= BATCH_CHARS or len(rows) >= BATCH_ROWS or i + 1 == len(values):
                    columns = [pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds[1:])]
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(rows)), *columns], names=list(names))
                    rows, size, start = [], 0, i + 1
        codec.forget()

    return df.mapInArrow(run, schema.replace("KEY", df.schema["doc_id"].dataType.simpleString()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text); added tokens in a text become their ids."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _mapped(texts, _spec(docs, path), "doc_id KEY, ids array<int>", lambda codec, text: (codec.encode(text),))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for each row of encoded (doc_id, ids); null ids count as none."""
    ids = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return _mapped(ids, _spec(encoded, path), "doc_id KEY, text string", lambda codec, ids: (codec.decode(ids),))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): encoded, and decoded again from those ids, in one pass."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def both(codec: Codec, text: str):
        ids = codec.encode(text)
        return ids, codec.decode(ids)

    return _mapped(texts, _spec(docs, path), "doc_id KEY, ids array<int>, text string", both)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what round_trip() gives, taken where it is made."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        listed = ",".join(map(codec.decimal.__getitem__, ids))
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, codec.decode(ids))]
        return len(ids), *digest

    return _mapped(texts, _spec(docs, path), "doc_id KEY, n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
