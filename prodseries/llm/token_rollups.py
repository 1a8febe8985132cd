"""Token counts as rollups that are kept by deltas.

A batch of changes becomes signed sums by source, language and tokenizer version: an insert adds a document and its
tokens, a delete takes them away, a revision adds the difference, and one that moves a document between groups takes it
from the old and adds it to the new. Only these sums are stored; totals are the sums over all committed batches.

A commit writes the sums into a folder of its own and then adds an entry (batch, folder) to a log of numbered files, each
created only if its number is free. Who loses a number to another writer looks at the log again: a batch that is in it
by now is not added twice, so a commit that is repeated, retried after a lost executor or raced by another one changes
nothing. compact() folds the batches so far into one, under a name made from theirs, and enters the log in the same way,
but only while none of them has been replaced; of two compactions that overlap, the second to arrive is void.

Changes: op ('insert', 'delete', 'revise'), source, lang, tokenizer, n_tokens, and for a revision old_n_tokens, with
old_source, old_lang, old_tokenizer if these differ (null: as before). Cases: null counts are 0; null source, lang or
tokenizer are groups of their own; an unknown op is an error; repeated rows each count, as two inserts would; a batch
without rows is committed and adds nothing; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodseries.llm.storage import new_folder
from prodseries.sources.versions import VersionLog

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def deltas(changes: DataFrame) -> DataFrame:
    """The signed sums of a batch by source, lang, tokenizer."""
    have = set(changes.columns)
    old = {k: F.coalesce(F.col(f"old_{k}"), F.col(k)) if f"old_{k}" in have else F.col(k) for k in KEYS}
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    before = F.coalesce(F.col("old_n_tokens").cast("long"), F.lit(0)) if "old_n_tokens" in have else F.lit(0).cast("long")

    def signed(keys: dict, docs: int, tokens: F.Column) -> F.Column:
        return F.struct(*(keys[k].cast("string").alias(k) for k in KEYS), F.lit(docs).cast("long").alias("n_docs"), tokens.alias("n_tokens"))

    new = {k: F.col(k) for k in KEYS}
    wrong = F.raise_error(F.concat(F.lit("not an op: "), F.coalesce("op", F.lit("null"))))
    rows = (
        F.when(F.col("op") == "insert", F.array(signed(new, 1, n)))
        .when(F.col("op") == "delete", F.array(signed(new, -1, -n)))
        .when(F.col("op") == "revise", F.array(signed(old, -1, -before), signed(new, 1, n)))
        .otherwise(wrong)
    )
    each = changes.select(F.explode(rows).alias("r")).select("r.*")
    sums = each.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 OR n_tokens <> 0")


class Rollup:
    """Totals in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "rollup")
        self._log = VersionLog(spark, f"{self.folder}/log")

    @staticmethod
    def _live(entries: list[tuple[int, dict]]) -> dict[str, str]:
        """{batch: folder} of what counts: all batches but those that a compaction replaced."""
        gone = {name for _, e in entries for name in e["replaces"]}
        return {e["batch"]: e["folder"] for _, e in entries if e["batch"] not in gone}

    def live(self) -> dict[str, str]:
        return self._live(self._log.entries())

    def seen(self, batch: str) -> bool:
        return any(e["batch"] == batch for _, e in self._log.entries())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before, or by another writer meanwhile."""
        return not self.seen(batch) and self.publish(batch, self.prepare(deltas(changes)))

    def prepare(self, sums: DataFrame) -> str:
        """Write sums into a new folder. Nothing counts them until publish()."""
        folder = f"{self.folder}/sums-{uuid.uuid4().hex}"
        sums.write.parquet(folder)
        return folder

    def publish(self, batch: str, folder: str, replaces: tuple[str, ...] = ()) -> bool:
        """Enter the prepared folder as the batch; False, and nothing changes, if the log has the batch or lacks one that it replaces."""
        def entry(seen: list[tuple[int, dict]]) -> dict | None:
            if any(e["batch"] == batch for _, e in seen) or not set(replaces) <= set(self._live(seen)):
                return None
            return {"batch": batch, "folder": folder, "replaces": list(replaces)}

        return self._log.append(entry) is not None

    def _sums(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens after all committed batches; groups that came to nothing are left out."""
        return self._sums(sorted(self.live().values()))  # a folder a batch

    def fold(self) -> tuple[str, str, tuple[str, ...]] | None:
        """Write the sum of the batches so far: (name, folder, batches), to be published; None where there is nothing to fold."""
        parts = self.live()
        if len(parts) < 2:
            return None
        names = tuple(sorted(parts))
        digest = hashlib.sha256("\0".join(names).encode()).hexdigest()
        return f"compaction-{digest}", self.prepare(self._sums([parts[n] for n in names])), names

    def compact(self) -> bool:
        """Fold the batches so far into one. Their names stay in the log, so none of them can be committed again."""
        folded = self.fold()
        return folded is not None and self.publish(*folded)


def feed(docs: DataFrame, labels: DataFrame, rollup: Rollup) -> None:
    """The documents as three batches: inserted with counts by blanks and estimates from their length, the estimates
    revised to counts of words, and the documents labelled toxic deleted. The second batch comes twice."""
    text = F.coalesce("text", F.lit(""))
    blanks = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    words = F.size(F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")).cast("long")
    estimate = F.ceil(F.coalesce("n_chars", F.lit(0)) / 5).cast("long")
    keep = ["doc_id", "source", "lang"]

    def batch(rows: DataFrame, op: str, **counts: F.Column) -> DataFrame:
        """counts: tokenizer=(count, count before)."""
        each = F.array(*(F.struct(F.lit(k).alias("tokenizer"), n.alias("n_tokens"), old.alias("old_n_tokens")) for k, (n, old) in counts.items()))
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.explode(each).alias("c")).select("op", "source", "lang", "c.*")

    none = F.lit(None).cast("long")
    rollup.commit("inserted", batch(docs.select(*keep, blanks.alias("b"), estimate.alias("e")), "insert", blanks_1=(F.col("b"), none), words_1=(F.col("e"), none)))
    revised = batch(docs.select(*keep, estimate.alias("e"), words.alias("w")), "revise", words_1=(F.col("w"), F.col("e")))
    rollup.commit("revised", revised)
    rollup.commit("revised", revised)
    toxic = labels.where("toxic = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    counted = docs.select(*keep, blanks.alias("b"), words.alias("w")).join(toxic, "doc_id", "left_semi")
    rollup.commit("deleted", batch(counted, "delete", blanks_1=(F.col("b"), none), words_1=(F.col("w"), none)))


# The totals, counted directly.
SQL = r"""
WITH d AS (
  SELECT source, lang, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS b,
         len(list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, 'blanks_1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(b)::BIGINT AS n_tokens FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words_1', count(*)::BIGINT, sum(w)::BIGINT FROM d GROUP BY source, lang
"""
