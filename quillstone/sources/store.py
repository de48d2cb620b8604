"""A store of named tables in versions: every commit writes new folders and then one pointer file, so readers see all of a commit or nothing.

Layout: ``tables/<name>/<commit>`` holds the Parquet of a version, ``commits/<number>.json`` says which folder each table has; the highest number is
current. A transaction stages folders first; publishing creates the next pointer with ``create`` without overwriting, so of two writers one
fails. A crash leaves staged folders without a pointer: ``recover`` removes those whose lease has ended.
Every file call goes through Hadoop's file system, so any shared storage will do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("blocks", "edges", "operations", "embeddings")
# How a write that carries a receipt ended.
APPLIED, PENDING, UNKNOWN = "applied", "pending", "unknown"
#: Seconds that a transaction may stay open.
LEASE = 3600.0


class Conflict(RuntimeError):
    """Another writer published first."""


class Files:
    """The few calls on files that a store needs."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _at(self, path: str):  # noqa: ANN202
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}")
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> dict:
        rows = self.spark.read.text(f"{self.base}/{path}", wholetext=True).collect()  # one small file
        return json.loads(rows[0][0])

    def create(self, path: str, value: dict) -> None:
        """Writes a file that must not exist yet."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001 - the file system's own error
            raise Conflict(path) from e
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


@dataclass
class Transaction:
    """Staged tables; nothing is visible before ``publish``."""

    store: Store
    based_on: int
    name: str
    receipt: str | None = None
    staged: dict[str, str] = field(default_factory=dict)
    hooks: list[Callable[[Transaction], None]] = field(default_factory=list)

    def stage(self, table: str, rows: DataFrame) -> None:
        """The table as it shall be after the commit."""
        path = f"tables/{table}/{self.name}"
        rows.write.mode("overwrite").parquet(f"{self.store.files.base}/{path}")
        self.staged[table] = path

    def table(self, name: str) -> DataFrame:
        """What this transaction sees: its own staged rows, else the version it began with."""
        path = self.staged.get(name) or self.store._manifest(self.based_on)["tables"].get(name)
        if path is None:
            raise KeyError(name)
        return self.store.files.spark.read.parquet(f"{self.store.files.base}/{path}")

    def publish(self) -> int:
        """The commit point: one pointer file. The number of the new version."""
        before = self.store._manifest(self.based_on)
        receipts = before.get("receipts", [])
        if self.receipt is not None:
            receipts = [*receipts, self.receipt][-self.store.receipts_kept :]
        number = self.based_on + 1
        self.store.files.create(f"commits/{number:012d}.json", {"tables": before["tables"] | self.staged, "receipts": receipts, "at": time.time(), "properties": before.get("properties", {})})
        self.store.files.remove(f"open/{self.name}.json")
        for hook in self.hooks:
            try:
                hook(self)
            except Exception:  # noqa: BLE001 - a hook must not undo a commit
                pass
        return number

    def abort(self) -> None:
        for path in self.staged.values():
            self.store.files.remove(path)
        self.store.files.remove(f"open/{self.name}.json")
        self.staged = {}


class Store:
    """``tables`` by name, in versions. ``receipts_kept`` bounds the receipts that a replay can meet."""

    def __init__(self, spark: SparkSession, base: str, receipts_kept: int = 10_000) -> None:
        self.files, self.receipts_kept = Files(spark, base), receipts_kept

    def version(self) -> int:
        """The current version; 0 for an empty store."""
        found = self.files.names("commits")
        return int(found[-1].split(".")[0]) if found else 0

    def _manifest(self, number: int) -> dict:
        return self.files.read(f"commits/{number:012d}.json") if number else {"tables": {}, "receipts": [], "properties": {}}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        path = self._manifest(self.version() if version is None else version)["tables"].get(name)
        if path is None:
            raise KeyError(name)
        return self.files.spark.read.parquet(f"{self.files.base}/{path}")

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        number = self.version() if version is None else version
        return {n: self.table(n, number) for n in self._manifest(number)["tables"]}

    def begin(self, receipt: str | None = None, lease: float = LEASE) -> Transaction:
        t = Transaction(self, self.version(), uuid.uuid4().hex, receipt)
        self.files.create(f"open/{t.name}.json", {"until": time.time() + lease, "based_on": t.based_on, "receipt": receipt})
        return t

    def status(self, receipt: str) -> str:
        """Whether a write with this receipt was applied, is being made, or is unknown."""
        if receipt in self._manifest(self.version()).get("receipts", []):
            return APPLIED
        opened = [self.files.read(f"open/{n}") for n in self.files.names("open")]
        return PENDING if any(o["receipt"] == receipt and o["until"] > time.time() for o in opened) else UNKNOWN

    def write(self, change: Callable[[Transaction], None], receipt: str | None = None, attempts: int = 5) -> int:
        """Applies a change in a transaction, again on a newer version if another writer was first; once per receipt."""
        for _ in range(attempts):
            if receipt is not None and self.status(receipt) == APPLIED:
                return self.version()
            t = self.begin(receipt)
            try:
                change(t)
                return t.publish()
            except Conflict:
                t.abort()
            except BaseException:
                t.abort()
                raise
        raise Conflict(f"{attempts} attempts")

    def recover(self) -> list[str]:
        """Ends transactions whose lease is over and removes what they staged; their names."""
        ended = []
        for n in self.files.names("open"):
            name = n.removesuffix(".json")
            if self.files.read(f"open/{n}")["until"] > time.time():
                continue
            published = {p for v in self.files.names("commits") for p in self.files.read(f"commits/{v}")["tables"].values()}
            for table in self.files.names("tables"):
                if f"tables/{table}/{name}" not in published:
                    self.files.remove(f"tables/{table}/{name}")
            self.files.remove(f"open/{n}")
            ended.append(name)
        return ended

    def identity(self, model: str | None = None, mismatch: str = "error") -> str | None:
        """The embedding model that the vectors are of; sets it where there is none. ``mismatch`` is error, warn or ignore."""
        known = self._manifest(self.version()).get("properties", {}).get("embedding_model")
        if model is None or known == model:
            return known
        if known is None:
            number = self.version()
            m = self._manifest(number)
            self.files.create(f"commits/{number + 1:012d}.json", m | {"properties": m.get("properties", {}) | {"embedding_model": model}, "at": time.time()})
            return model
        if mismatch == "error":
            raise ValueError(f"the vectors are of {known}, not of {model}")
        if mismatch == "warn":
            import warnings

            warnings.warn(f"the vectors are of {known}, not of {model}", stacklevel=2)
        return known

    def fork(self, base: str) -> Store:
        """A new store with the current tables; ``base`` must hold none."""
        other = Store(self.files.spark, base, self.receipts_kept)
        if other.version():
            raise ValueError("the store is not empty")
        t = other.begin()
        for name, rows in self.tables().items():
            t.stage(name, rows)
        t.publish()
        return other


def introspect(blocks: DataFrame, user_id: str, include_deleted: bool = False, limit: int | None = None) -> DataFrame:
    """All records of a user, newest first."""
    rows = blocks.where(F.col("user_id") == user_id)
    rows = rows if include_deleted else rows.where(~F.coalesce("deleted", F.lit(False)))
    rows = rows.orderBy(F.desc_nulls_last("created_at"), "id")
    return rows if limit is None else rows.limit(limit)


def by_ids(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of given ``id``, deleted ones too."""
    return blocks.join(ids.select("id").distinct(), "id", "left_semi")


def by_hashes(blocks: DataFrame, hashes: DataFrame) -> DataFrame:
    """The oldest live record of every ``content_hash`` asked for."""
    live = blocks.where(~F.coalesce("deleted", F.lit(False))).join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
    first = live.groupBy("content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
    return live.join(first, ["content_hash", "id"], "left_semi").select(blocks.columns)


def live_embeddings(embeddings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Vectors of live records."""
    return embeddings.join(blocks.where(~F.coalesce("deleted", F.lit(False))).select(F.col("id").alias("block_id")).distinct(), "block_id", "left_semi").select(embeddings.columns)


def json_lines(rows: DataFrame) -> DataFrame:
    """Every row as one JSON text ``value``; nulls stay in it."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def hidden(blocks: DataFrame, internal_tags: list[str]) -> DataFrame:
    """Without records of the store's own: tagged as internal, or staged by a transaction (deleted, with ``_txn`` in their metadata)."""
    inner = F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in internal_tags])), F.lit(False)) if internal_tags else F.lit(False)
    staged = F.coalesce("deleted", F.lit(False)) & F.get_json_object("custom_metadata", "$._txn").isNotNull()
    return blocks.where(~inner & ~staged)
