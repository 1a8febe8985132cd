"""License scans by template-markup matching.

A template is the wording of a license or notice with two kinds of regions in SPDX's markup: what stands between
<<beginOptional>> and <<endOptional>> may be missing, and <<var;name=...;max=n>> stands for up to n words of any kind.
It is compiled into an automaton over words; a text matches where the automaton accepts, so all mandatory wording must
stand there exactly, in order: the whole text of a license, or the whole of its notice, so that a license with a clause
added, changed or left out is not one. A text that lacks a mandatory word of a template, or its longest mandatory run, is
not looked at for it. The wording is in license_texts.py.

Words: A-Z is lower-cased, then maximal runs of digits, a-z and characters outside ASCII. Cases: a null or empty text
has no words and no match; a null doc_id is kept; repeated rows give equal results; an empty table gives an empty
result; other columns are not looked at. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodseries.llm.license_texts import templates

# Phrases and labels of the base.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
TO_WORDS = bytes(b | 0x20 if chr(b).isalpha() else b if chr(b).isdigit() else 0x20 for b in range(128)) + bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


@dataclass
class Automaton:
    """States 0, 1, ...; from each a word or any word leads on, and some follow for free. The last one accepts."""

    label: str
    base: bool = False
    step: list[tuple[bytes | None, int] | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    anchor: bytes = b""
    must: frozenset[bytes] = frozenset()
    least: int = 0

    def state(self) -> int:
        self.step.append(None)
        self.free.append([])
        return len(self.step) - 1

    def close(self, states: set[int]) -> set[int]:
        todo, found = [*states], set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def match(self, tokens: list[bytes], start: int) -> int | None:
        """The longest end of a match from start on."""
        states, last, end = self.start, len(self.step) - 1, None
        for at in range(start, len(tokens)):
            token = tokens[at]
            after = {t[1] for s in states if (t := self.step[s]) and (t[0] is None or t[0] == token)}
            if not after:
                break
            states = self.close(after)
            if last in states:
                end = at + 1
        return end

    def find(self, tokens: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, end) of every place where a match starts."""
        for start, token in enumerate(tokens):
            if token in self.first and (end := self.match(tokens, start)):
                yield start, end


def compiled(label: str, template: str, base: bool = False) -> Automaton:
    """The automaton of a template. It has to begin with a word, mandatory or optional."""
    a = Automaton(label, base)
    here, opened, runs = a.state(), [], [[]]
    for i, part in enumerate(MARKUP.split(template)):
        if i % 2 == 0:
            for word in words(part):
                a.step[here] = (word, len(a.step))
                here = a.state()
                if not opened:
                    runs[-1].append(word)
        elif part.startswith("var"):
            runs.append([])
            most, enter = int(re.search(r"max=(\d+)", part)[1]), []
            for _ in range(most):
                enter.append(here)
                a.step[here] = (None, len(a.step))
                here = a.state()
            for s in enter:
                a.free[s].append(here)
        elif part == "beginOptional":
            runs.append([])
            opened.append(here)
            s = a.state()
            a.free[here].append(s)
            here = s
        else:
            s = a.state()
            a.free[here].append(s)
            a.free[opened.pop()].append(s)
            here = s
            runs.append([])
    s = a.state()  # the accepting state is the last
    a.free[here].append(s)
    a.start = a.close({0})
    a.first = {a.step[s][0] for s in a.start if a.step[s]}
    if None in a.first or len(a.step) - 1 in a.start:
        raise ValueError(f"{label}: a template has to begin with a word and must not be empty")
    a.anchor = b" " + b" ".join(max(runs, key=len)) + b" "
    a.must, a.least = frozenset(w for r in runs for w in r), sum(map(len, runs))
    return a


def automata() -> list[Automaton]:
    return [compiled(v, k, True) for k, v in PHRASES.items()] + [compiled(label, t) for label, t in templates()]


def scan(text: str | None, of: list[Automaton]) -> tuple[int, list[tuple[Automaton, int, int]]]:
    """The number of words, and all matches (automaton, first word, word after the last)."""
    tokens = words(text)
    there = set(tokens)
    some = [a for a in of if a.must <= there]
    if not some:
        return len(tokens), []
    joined = b" %b " % b" ".join(tokens)
    return len(tokens), [(a, start, end) for a in some if a.anchor in joined for start, end in a.find(tokens)]


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, label, base, start, end) for each match, in words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = automata()
        for batch in batches:
            found = [(i, *m) for i, t in enumerate(batch.column(1)) for m in scan(t.as_py(), of)[1]]
            at, a, start, end = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at, pa.int64())), pa.array([x.label for x in a], pa.string()),
                pa.array([x.base for x in a], pa.bool_()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
            ], names=["doc_id", "label", "base", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, label string, base boolean, start bigint, end bigint")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document.

    score: 0 without a match, else 1 - 1 / (1 + the mandatory words of the longest match).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def row(text: str | None, of: list[Automaton]) -> tuple:
        n, found = scan(text, of)
        base = [start for a, start, _ in found if a.base]
        labels = [",".join(sorted({a.label for a, _, _ in found if a.base or not only})) for only in (True, False)]
        return n, len(base), min(base, default=None), max(base, default=None), *labels, 1 - 1 / (1 + max((a.least for a, _, _ in found), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = automata()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = [row(t.as_py(), of) for t in batch.column(1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")
