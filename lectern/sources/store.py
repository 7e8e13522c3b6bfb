"""Keyed tables in a folder, changed a few buckets at a time, in commits over any number of tables.

A table's rows are dealt by the hash of its key into ``BUCKETS`` buckets; a bucket is a list of immutable Parquet folders.  A change
reads and rewrites the buckets of the keys it touches and leaves all others as they are; an append adds folders.  What folders make up
each table is one small manifest for the whole store, and a commit is the rename of the next manifest to its number, so readers see
all of a commit's tables or none, a change that was lost half way leaves the store as it was, and of two writers of one
version the second fails.  ``vacuum`` deletes folders that no kept version lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import dml

BUCKETS = 32
#: Folders of one bucket that a change of its keys or an append folds into one.
MOST_PARTS = 16
#: The column that a table's rows are dealt by.
KEY = {"addresses": "segment_id", "aliases": "alias", "source_files": "source_path", "source_metadata": "source_path", "work_relations": "source_id",
       "metadata_overlays": "match_value", "metadata_attributions": "match_value", "source_witnesses": "canonical_text_id", "author_classifications": "author_id",
       "contained_works": "parent_work_id", "translations": "translation_id"}

Manifest = dict[str, dict[str, list[str]]]


def key_of(table: str) -> str:
    return KEY.get(table, "work_id")


#: The columns of tables that name a work.
WORK_COLUMNS = {
    "works": ["work_id"], "editions": ["work_id"], "artifacts": ["work_id"], "segments": ["work_id"], "work_classifications": ["work_id"], "aliases": ["target"],
    "citation_references": ["work_id"], "work_map_nodes": ["work_id"], "division_metadata": ["work_id"], "citation_maps": ["work_id"], "source_witnesses": ["work_id"],
    "contained_works": ["parent_work_id", "contained_work_id"], "work_relations": ["source_id", "target_id"],
}


class TableStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._path(folder)
        return [str(s.getPath().getName()) for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names("_versions") if n.startswith("v=") and n[2:].isdigit())

    def version(self) -> int:
        """The current version of the store; 0 if there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        """Table -> bucket -> its folders."""
        now = self.version() if version is None else version
        if not now:
            return {}
        text = self.spark.read.text(f"{self.folder}/_versions/v={now}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, changed: Callable[[Manifest], Manifest], base: int) -> int:
        """Write the manifest after ``base`` as the next version."""
        staged = f"_versions/.staging-{uuid.uuid4().hex}"
        text = json.dumps(changed(self.manifest(base)), separators=(",", ":"))
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/{staged}")
        files, source = self._path(staged)
        _, target = self._path(f"_versions/v={base + 1}")
        if files.exists(target) or not files.rename(source, target):
            files.delete(source, True)
            raise RuntimeError(f"version {base + 1} was written meanwhile")
        return base + 1

    @staticmethod
    def _bucket(key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")

    def _write(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows as new folders; bucket -> folder."""
        part = f"{table}/{uuid.uuid4().hex}"
        own = schemas.conform(rows, table).withColumn("bucket", self._bucket(key_of(table)))
        # a large bucket is written by several tasks, small ones by one
        own.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.folder}/{part}")
        return {n[7:]: [f"{part}/{n}"] for n in self._names(part) if n.startswith("bucket=")}

    def _read(self, table: str, parts: list[str]) -> DataFrame:
        if not parts:
            return schemas.empty(self.spark, table)
        return schemas.conform(self.spark.read.schema(schemas.schema(table)).parquet(*(f"{self.folder}/{p}" for p in parts)), table)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as it is, or was at a version, in its schema; columns that an old part lacks are null."""
        return self._read(table, [p for ps in self.manifest(version).get(table, {}).values() for p in ps])

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def change(self, edits: dict[str, Callable[[Manifest], dict[str, list[str]]]]) -> int:
        """One commit over several tables: for each a function from the store's manifest to the table's new buckets."""
        base = self.version()
        before = self.manifest(base)
        after = {t: edit(before) for t, edit in edits.items()}
        return self._commit(lambda m: m | after, base)

    def _touched(self, table: str, ids: DataFrame, keys: list[str], before: dict[str, list[str]]) -> list[str]:
        """The buckets that rows with the given keys can be in."""
        if key_of(table) not in keys:
            return list(before)
        own = ids.select(self._bucket(key_of(table)).alias("b")).distinct().collect()  # at most BUCKETS rows
        return [str(r["b"]) for r in own if str(r["b"]) in before]

    def replaced(self, table: str, rows: DataFrame) -> Callable[[Manifest], dict[str, list[str]]]:
        return lambda m: self._write(table, rows)

    def appended(self, table: str, rows: DataFrame) -> Callable[[Manifest], dict[str, list[str]]]:
        def edit(m: Manifest) -> dict[str, list[str]]:
            before, new = m.get(table, {}), self._write(table, rows)
            full = [b for b, ps in before.items() if len(ps) >= MOST_PARTS and b in new]
            if full:  # fold what has grown into many folders
                folded = self._write(table, self._read(table, [p for b in full for p in before[b] + new[b]]))
                return before | {b: before.get(b, []) + ps for b, ps in new.items()} | folded
            return before | {b: before.get(b, []) + ps for b, ps in new.items()}

        return edit

    def upserted(self, table: str, rows: DataFrame, keys: list[str]) -> Callable[[Manifest], dict[str, list[str]]]:
        def edit(m: Manifest) -> dict[str, list[str]]:
            before = m.get(table, {})
            touched = self._touched(table, rows, keys, before)
            old = self._read(table, [p for b in touched for p in before[b]])
            new = self._write(table, dml.replace_by_key(old, schemas.conform(rows, table), keys))
            return {b: ps for b, ps in before.items() if b not in touched} | new

        return edit

    def deleted(self, table: str, ids: DataFrame, keys: list[str]) -> Callable[[Manifest], dict[str, list[str]]]:
        def edit(m: Manifest) -> dict[str, list[str]]:
            before = m.get(table, {})
            touched = self._touched(table, ids, keys, before)
            if not touched:
                return before
            old = self._read(table, [p for b in touched for p in before[b]])
            new = self._write(table, old.join(ids.select(*keys).distinct(), keys, "left_anti"))
            return {b: ps for b, ps in before.items() if b not in touched} | new

        return edit

    def replace(self, table: str, rows: DataFrame) -> int:
        return self.change({table: self.replaced(table, rows)})

    def append(self, table: str, rows: DataFrame) -> int:
        return self.change({table: self.appended(table, rows)})

    def replace_keys(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        return self.change({table: self.upserted(table, rows, keys)})

    def delete_keys(self, table: str, ids: DataFrame, keys: list[str]) -> int:
        return self.change({table: self.deleted(table, ids, keys)})

    def vacuum(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep`` and the folders that only they list; how many folders went."""
        versions = self.versions()
        used = {p for v in versions[-keep:] for t in self.manifest(v).values() for ps in t.values() for p in ps}
        gone = 0
        for table in (n for n in self._names("") if not n.startswith(("_", "."))):
            for part in self._names(table):
                inside = [f"{table}/{part}/{b}" for b in self._names(f"{table}/{part}") if b.startswith("bucket=")]
                for name in [f"{table}/{part}"] if not used.intersection(inside) else [x for x in inside if x not in used]:
                    files, path = self._path(name)
                    files.delete(path, True)
                    gone += 1
        for v in versions[:-keep]:
            files, path = self._path(f"_versions/v={v}")
            files.delete(path, True)
        return gone

    def deleted_by(self, table: str, ids: DataFrame, columns: list[str]) -> Callable[[Manifest], dict[str, list[str]]]:
        """Rows go that have an id (the one column of ``ids``) in any of the columns."""
        if len(columns) == 1:
            return self.deleted(table, ids.toDF(columns[0]), columns)

        def edit(m: Manifest) -> dict[str, list[str]]:
            left = self._read(table, [p for ps in m.get(table, {}).values() for p in ps])
            for c in columns:
                left = left.join(ids.toDF(c).distinct(), c, "left_anti")
            return self._write(table, left)

        return edit

    def delete_works(self, ids: DataFrame, tables: dict[str, list[str]] | None = None) -> None:
        """Works (``work_id``) go with all that belongs to them, in one commit: rows of every table of ``WORK_COLUMNS`` that is there, and
        what only their segments have."""
        here = self.manifest()
        chosen = {t: c for t, c in (WORK_COLUMNS if tables is None else tables).items() if t in here}
        ids = ids.select("work_id")
        edits = {t: self.deleted_by(t, ids, c) for t, c in chosen.items()}
        if "addresses" in here and "segments" in here and "addresses" not in chosen:
            gone = self.read("segments").join(ids.distinct(), "work_id", "left_semi").select("segment_id")
            edits["addresses"] = self.deleted_by("addresses", gone, ["segment_id"])
        self.change(edits)

    def register_works(self, works: DataFrame, artifacts: DataFrame, order: str | None = None) -> None:
        """Incoming works and artifacts replace those of the same ids, in one commit; of several incoming rows of an id the last in
        ``order`` wins."""
        if order:
            works = dml.keep_latest(works, ["work_id"], [order])
        self.change({"works": self.upserted("works", works, ["work_id"]), "artifacts": self.upserted("artifacts", artifacts, ["work_id"])})

    def apply_overlays(self, field: str, dry_run: bool = False) -> DataFrame:
        """Accepted overlays of a field by work id: the changes; unless ``dry_run`` they are made."""
        own = self.read("metadata_overlays").filter((F.col("status") == "accepted") & (F.col("field") == field) & (F.col("match_field") == "work_id"))
        keyed = own.select(F.col("match_value").alias("work_id"), "value", F.coalesce("evidence_retrieved_at", F.lit("")).alias("ord"))
        return self._overlaid(keyed, field, dry_run)

    def repair_languages(self, hits: DataFrame, least: int, dry_run: bool = False, told: DataFrame | None = None) -> DataFrame:
        """Works that are in another language than is told: changes, and made unless ``dry_run``, in editions and aliases too.

        What the sources say of a work or its author (``told``: ``work_id, language, rank``, the smallest rank first) goes before what most of
        its words are (``hits``: ``work_id, language, hits``).
        """
        best = hits.groupBy("work_id").agg(F.max_by(F.struct("language", "hits"), F.struct("hits", "language")).alias("b"))
        found = best.filter(F.col("b.hits") >= least).select("work_id", F.col("b.language").alias("value"), F.lit("").alias("ord"))
        if told is not None:
            first = told.filter("language IS NOT NULL").groupBy("work_id").agg(F.min_by("language", F.struct("rank", "language")).alias("value"))
            found = first.withColumn("ord", F.lit("")).unionByName(found.join(first, "work_id", "left_anti"))
        return self._overlaid(found, "language", dry_run)

    def _overlaid(self, overlays: DataFrame, field: str, dry_run: bool) -> DataFrame:
        """The changes that overlays make; they are read from the version before, which stays until it is vacuumed."""
        works = self.read("works")
        changes = dml.overlay_changes(works, overlays, "work_id", field)
        if not dry_run:
            rows = dml.apply_overlays(works.join(changes.select("work_id").distinct(), "work_id", "left_semi"), overlays, "work_id", field)
            edits = {"works": self.upserted("works", rows, ["work_id"])}
            if field == "language":  # what a work is called and printed as speaks its language too
                last = overlays.join(changes.select("work_id").distinct(), "work_id", "left_semi")
                edits |= {t: self._spoken(t, column, last) for t, column in (("editions", "work_id"), ("aliases", "target")) if t in self.manifest()}
            self.change(edits)
        return changes

    def _spoken(self, table: str, column: str, overlays: DataFrame) -> Callable[[Manifest], dict[str, list[str]]]:
        """The table with the works' new languages."""
        own = self.read(table)
        return self.replaced(table, dml.apply_overlays(own, overlays.withColumnRenamed("work_id", column), column, "language"))
