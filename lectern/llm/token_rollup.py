"""Token counts as a rollup that is maintained by signed deltas.

Totals by source, language, tokenizer and version are additive, so a batch of changes - inserts, deletes and revised counts -
needs only its own signed sums: an insert adds a document and its tokens, a delete takes them off, a revision adds the
difference.  A batch is aggregated (combined before the shuffle, so a hot source is no hot task), written to a staging folder
and committed by renaming that to the batch's own folder.  The rename fails where a batch of the id was committed before, so a batch
that is sent again, or whose driver was lost between the two steps, counts once.

``compact`` folds the committed batches into a snapshot - their totals and the list of their ids - which is committed by a rename too,
before the folded batches go; so totals read one snapshot and the batches since, however many there were.  A batch that a snapshot lists
is not counted again, whether its folder is still there or not.  What lost drivers have left in the staging folder is deleted when it
is ``STAGING_HOURS`` old.

The folder must be in a store whose rename is atomic, such as HDFS or a shared POSIX folder.

Defined results: texts of any length are read whole, a null text is an empty one; other columns, whatever their names, are ignored;
a null or unknown ``op`` changes nothing; null sources, languages and versions are groups of their own; a null count is 0; groups whose
documents and tokens are both 0 again aren't returned; repeated rows count each; an empty batch commits as such.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import slices
from lectern.llm.packing import word_ids
from lectern.llm.piece_bpe import encoder

KEYS = ["source", "lang", "tokenizer", "version"]
SCHEMA = "source string, lang string, tokenizer string, version string, documents bigint, tokens bigint"


def token_counts(docs: DataFrame, words_path: str, pieces_path: str) -> DataFrame:
    """``doc_id, source, lang`` and a row's number of ids with either tokenizer: ``word_tokens, piece_tokens``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces = word_ids(words_path, "pieces"), encoder(pieces_path, "words")
        for part in slices(batches):
            texts = part.column("text")
            sizes = np.array([len(x) for x in pieces.encode(texts)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(words.counts(texts)), pa.array(sizes)],
                names=["doc_id", "source", "lang", "word_tokens", "piece_tokens"],
            )

    schema = "doc_id bigint, source string, lang string, word_tokens bigint, piece_tokens bigint"
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, schema)


#: Staged folders that are older are nobody's.
STAGING_HOURS = 24


class Rollup:
    """A rollup in a folder; ``apply`` commits batches, ``compact`` folds them, ``totals`` reads them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _listed(self, name: str) -> dict[str, int]:
        """The folders in one of this rollup's folders, with when they were last changed, in milliseconds."""
        files, path = self._path(name)
        return {x.getPath().getName(): x.getModificationTime() for x in files.listStatus(path)} if files.exists(path) else {}

    @staticmethod
    def _delta(batch: str) -> str:
        return f"deltas/batch-{quote(batch, safe='')}"

    def _commit(self, staged: str, name: str) -> bool:
        """Rename a staged folder; False, and the staged one is gone, if another was first."""
        files, source = self._path(staged)
        _, target = self._path(name)
        files.mkdirs(target.getParent())
        if files.exists(target) or not files.rename(source, target):
            files.delete(source, True)
            return False
        inside = self._jvm.org.apache.hadoop.fs.Path(target, source.getName())
        if files.exists(inside):  # the rename moved this one into the other's folder
            files.delete(inside, True)
            return False
        return True

    def _folded(self) -> DataFrame | None:
        """``batch``: the ids that the newest snapshot holds."""
        found = self._listed("snapshots")
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/snapshots/{max(found)}/batches") if found else None

    def committed(self, batch: str) -> bool:
        files, path = self._path(self._delta(batch))
        if files.exists(path):  # first of the two: a folded batch's folder goes when its snapshot is there
            return True
        folded = self._folded()
        return folded is not None and not folded.filter(F.col("batch") == batch).isEmpty()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it was committed before.

        ``changes`` has ``op`` ('insert', 'delete' or 'revise'), the keys, ``tokens`` and, for a revision, ``old_tokens``.
        """
        if self.committed(batch):
            return False
        tokens, old = (F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("tokens", "old_tokens"))
        signed = changes.select(
            *KEYS,
            F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).alias("d"),
            F.when(F.col("op") == "insert", tokens)
            .when(F.col("op") == "delete", -tokens)
            .when(F.col("op") == "revise", tokens - old)
            .otherwise(0)
            .alias("t"),
        )
        delta = signed.groupBy(*KEYS).agg(
            F.sum("d").cast("bigint").alias("documents"), F.sum("t").cast("bigint").alias("tokens")
        )
        staged = f"staging/{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.folder}/{staged}")
        return not self.committed(batch) and self._commit(staged, self._delta(batch))

    def _open(self) -> tuple[DataFrame, list[str]]:
        """All signed sums that make the totals, and the ids of the batches that no snapshot holds."""
        snapshots = self._listed("snapshots")
        since = [unquote(x.removeprefix("batch-")) for x in self._listed("deltas")]
        if since and snapshots:
            here = self.spark.createDataFrame([(b,) for b in since], "batch string")
            since = [r["batch"] for r in here.join(self._folded(), "batch", "left_anti").collect()]
        paths = [f"{self.folder}/{self._delta(b)}" for b in since]
        paths += [f"{self.folder}/snapshots/{max(snapshots)}/totals"] if snapshots else []
        read = self.spark.read.schema(SCHEMA)
        return (read.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)), since

    def totals(self) -> DataFrame:
        """The keys with ``documents`` and ``tokens`` over all committed batches."""
        return self._sums(self._open()[0])

    @staticmethod
    def _sums(deltas: DataFrame) -> DataFrame:
        summed = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self) -> bool:
        """Fold the committed batches into a new snapshot; False if there is none, or another compaction was first."""
        self.clean()
        snapshots = self._listed("snapshots")
        deltas, since = self._open()
        done = False
        if since:
            staged = f"staging/{uuid.uuid4().hex}"
            ids = self.spark.createDataFrame([(b,) for b in since], "batch string")
            before = self._folded()
            self._sums(deltas).write.parquet(f"{self.folder}/{staged}/totals")
            (ids if before is None else ids.unionByName(before)).write.parquet(f"{self.folder}/{staged}/batches")
            done = self._commit(staged, f"snapshots/{int(max(snapshots, default=0)) + 1:012d}")
        # what a snapshot holds goes, also what a lost compaction left; the snapshot before stays for those who read it
        still = set(self._open()[1])
        gone = [x for x in self._listed("deltas") if unquote(x.removeprefix("batch-")) not in still]
        old = sorted(self._listed("snapshots"))[:-2]
        for name in [f"deltas/{x}" for x in gone] + [f"snapshots/{x}" for x in old]:
            files, path = self._path(name)
            files.delete(path, True)
        return done

    def clean(self, hours: float = STAGING_HOURS) -> None:
        """Delete staged folders that have not changed for so long."""
        for name, changed in self._listed("staging").items():
            if changed <= time.time() * 1000 - hours * 3_600_000:
                files, path = self._path(f"staging/{name}")
                files.delete(path, True)

    def drop(self) -> None:
        files, path = self._path("")
        files.delete(path, True)
