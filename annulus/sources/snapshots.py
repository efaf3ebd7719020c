"""Versioned snapshots of clinical assertions: a folder for each, and a state that names the active one.

    store/snapshots/<id>/data        the assertions as Parquet
    store/snapshots/<id>/manifest    what was staged, when, from what
    store/state.json                 active and previous snapshot

Everything goes through Hadoop's file systems, so a store may lie anywhere. A
snapshot appears by one rename and never changes; only the state does.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.errors import AnalysisError

# The columns of an assertion table, in order.
COLUMNS = (
    "position ref alt gene consequence protein residue structure_id structure_chain structure_residue structure_complex "
    "source assertion_id allele_id disease clinical_significance review_status assertion_date source_url references "
    "resource_version retrieved_at"
).split()
SCHEMA = ", ".join(f"`{c}` string" for c in COLUMNS)
DAY = 24 * 60 * 60
CLOCK_SKEW = 300


class Store:
    def __init__(self, spark: SparkSession, root: str, now=time.time):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now

    def stage(self, source: str, snapshot: str, license_id: str, source_policy: str, activate: bool = False) -> dict:
        """Copy a TSV of assertions into the store under a new name."""
        self._named(snapshot)
        for label in (license_id, source_policy):
            if not label or not label.strip() or not label.isprintable():
                raise AnalysisError("E1001", "licence and source policy must be given")
        if self._exists(self._folder(snapshot)):
            raise AnalysisError("E1302", f"snapshot {snapshot} exists")
        rows = read_assertions(self.spark, source)
        staging = f"{self.root}/snapshots/.{snapshot}.{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{staging}/data")
            kept = self.spark.read.schema(SCHEMA).parquet(f"{staging}/data")
            manifest = {
                "schema_version": "1.0",
                "snapshot_id": snapshot,
                "status": "staged",
                "source": source,
                "digest": digest(kept),
                "staged_at_unix": int(self.now()),
                "license_id": license_id,
                "source_policy": source_policy,
                "summary": summary(kept),
            }
            if manifest["digest"] != digest(rows):
                raise AnalysisError("E1302", "the assertions changed while they were staged")
            self._write(f"{staging}/manifest.json", manifest)
            if not self._rename(staging, self._folder(snapshot)):
                raise AnalysisError("E1302", f"snapshot {snapshot} can't be published")
        finally:
            self._delete(staging)
        return self.activate(snapshot) if activate else manifest

    def verify(self, snapshot: str, max_age_days: int | None = None) -> dict:
        """The manifest, if the data still are what it says and not too old."""
        self._named(snapshot)
        manifest = self._read(f"{self._folder(snapshot)}/manifest.json")
        if manifest is None or manifest.get("schema_version") != "1.0" or manifest.get("snapshot_id") != snapshot or manifest.get("status") != "staged":
            raise AnalysisError("E1302", f"snapshot {snapshot} has no sound manifest")
        rows = self.data(snapshot)
        if digest(rows) != manifest["digest"] or summary(rows) != manifest["summary"]:
            raise AnalysisError("E1302", f"snapshot {snapshot} isn't what was staged")
        age = int(self.now()) - manifest["staged_at_unix"]
        if age < -CLOCK_SKEW:
            raise AnalysisError("E1302", f"snapshot {snapshot} was staged in the future")
        if max_age_days is not None and age > max_age_days * DAY:
            raise AnalysisError("E1302", f"snapshot {snapshot} is stale: {age} seconds")
        return manifest

    def activate(self, snapshot: str, max_age_days: int | None = None) -> dict:
        self.verify(snapshot, max_age_days)
        state = self._state() or {}
        active = state.get("active_snapshot")
        return self._set(snapshot, active if active and active != snapshot else state.get("previous_snapshot"))

    def rollback(self, max_age_days: int | None = None) -> dict:
        """Make the previous snapshot active and the active one previous."""
        state = self._state() or {}
        previous = state.get("previous_snapshot")
        if not previous:
            raise AnalysisError("E1302", "there is no previous snapshot")
        self.verify(previous, max_age_days)
        return self._set(previous, state["active_snapshot"])

    def status(self, max_age_days: int | None = None) -> dict:
        active = (self._state() or {}).get("active_snapshot")
        if active:
            self.verify(active, max_age_days)
        return {"active_snapshot": active, "verified": bool(active)}

    def data(self, snapshot: str | None = None) -> DataFrame:
        """A snapshot's assertions; the active one's by default."""
        name = snapshot or (self._state() or {}).get("active_snapshot")
        if not name:
            raise AnalysisError("E1301", "no snapshot is active")
        return self.spark.read.schema(SCHEMA).parquet(f"{self._folder(name)}/data")

    def _set(self, active: str, previous: str | None) -> dict:
        state = {"schema_version": "1.0", "active_snapshot": active, "previous_snapshot": previous, "updated_at_unix": int(self.now())}
        path = f"{self.root}/state.json"
        self._write(f"{path}.{uuid.uuid4().hex}", state, then=path)
        return state

    def _state(self) -> dict | None:
        state = self._read(f"{self.root}/state.json")
        if state is not None and state.get("schema_version") != "1.0":
            raise AnalysisError("E1302", "unknown version of the store's state")
        return state

    def _folder(self, snapshot: str) -> str:
        return f"{self.root}/snapshots/{snapshot}"

    @staticmethod
    def _named(snapshot: str) -> None:
        if not re.fullmatch("[A-Za-z0-9][A-Za-z0-9._-]{0,127}", snapshot):
            raise AnalysisError("E1001", f"{snapshot!r} can't name a snapshot")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._hadoop(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._hadoop(path)
        fs.delete(p, True)

    def _rename(self, a: str, b: str) -> bool:
        fs, p = self._hadoop(a)
        return fs.rename(p, self._hadoop(b)[1])

    def _read(self, path: str) -> dict | None:
        if not self._exists(path):
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first().value)

    def _write(self, path: str, value: dict, then: str | None = None) -> None:
        fs, p = self._hadoop(path)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value, indent=2).encode()))
        out.close()
        if then:
            context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.OVERWRITE
            context.rename(p, self._hadoop(then)[1], options)


def read_assertions(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of assertions, whose header must be the fixed one."""
    lines = spark.read.text(path)
    head = lines.where(F.trim("value") != "").first()
    if head is None or head.value.rstrip("\r").split("\t") != COLUMNS:
        raise AnalysisError("E1302", f"{path} doesn't have the header of an assertion table")
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = lines.where((F.trim("value") != "") & (F.regexp_replace("value", "\r$", "") != "\t".join(COLUMNS))).select(fields.alias("f"))
    sound = F.when(F.size("f") == len(COLUMNS), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("E1302: an assertion has other than 22 fields: "), F.array_join("f", "|"))))
    return rows.select(sound.alias("f")).select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)))


def summary(rows: DataFrame) -> dict:
    """assertion_count, variant_count, sources."""
    found = rows.agg(F.count("*").alias("n"), F.countDistinct("position", "ref", "alt").alias("v"), F.array_sort(F.collect_set("source")).alias("s")).first()
    return {"assertion_count": found.n, "variant_count": found.v, "sources": list(found.s)}


def digest(rows: DataFrame) -> str:
    """Of the rows as a bag, whatever their order and files: the SHA-256 over sums of the rows' SHA-256 in four parts."""
    sha = F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns))), 256)
    parts = [F.sum(F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(8)]
    found = rows.agg(F.count("*").cast("string").alias("n"), *parts)
    return found.select(F.sha2(F.concat_ws(":", *found.columns), 256).alias("d")).first().d
