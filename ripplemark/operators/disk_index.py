"""What the working tree adds to the tables, written once for a state of both and read by every query until one changes."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators.store import Store

TABLES = ("test_units", "static_test_imports", "file_hashes", "code_units")
KEPT_SECONDS = 3600


def fingerprint(listing: DataFrame, untracked: DataFrame) -> DataFrame:
    """One row for the state of a tree: its paths with time and size, no file opened, and which of them are untracked."""
    one = lambda df, *c: df.select(F.xxhash64(*c).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"))
    return one(listing, "file_path", "mtime", "size").union(one(untracked, "file_path")).agg(F.sort_array(F.collect_list(F.concat_ws(":", "n", "h"))).alias("state"))


class DiskIndex:
    """Folders beside the tables, each named after the versions of the tables and the state of the tree that it is of."""

    def __init__(self, store: Store):
        self.store, self.folder, self.built = store, f"{store.folder}/disk_index", 0

    def _key(self, state: list[str]) -> str:
        versions = [f"{t}={self.store._pointer(t)}" for t in TABLES]
        return hashlib.sha256("\n".join([*versions, *state]).encode()).hexdigest()

    def _names(self, folder: str) -> list[str]:
        fs, p = self.store._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def get(self, listing: DataFrame, untracked: DataFrame, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of ``build()``, from disk if they are there.  Of two builders the first to end is read by both."""
        folder = f"{self.folder}/{self._key(fingerprint(listing, untracked).first().state)}"
        if not (ready := [n for n in self._names(folder) if n.startswith("_ready-")]):
            self.drop(KEPT_SECONDS)
            own = uuid.uuid4().hex
            for name, rows in build().items():
                rows.write.parquet(f"{folder}/{own}/{name}")
            self.store._create(f"{folder}/_ready-{own}")
            self.built += 1
            ready = [n for n in self._names(folder) if n.startswith("_ready-")]
        at = f"{folder}/{ready[0].removeprefix('_ready-')}"
        return {n: self.store.spark.read.parquet(f"{at}/{n}") for n in self._names(at)}

    def drop(self, older_than: float = 0) -> int:
        """Removes the folders of at least that age in seconds; bytes freed.  Queries are over long before ``KEPT_SECONDS``."""
        fs, p = self.store._fs(self.folder)
        freed = 0
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if time.time() * 1000 - s.getModificationTime() >= older_than * 1000:
                freed += fs.getContentSummary(s.getPath()).getLength()
                fs.delete(s.getPath(), True)
        return freed
