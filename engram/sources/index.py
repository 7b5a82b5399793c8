"""A clustered vector index beside a store.

Centres are fitted on a bounded sample.  Each file of memories has files of (id, embedding) by cell; a refresh writes them for
files that are new, forgets those that are gone and leaves the rest alone.  Memories that are not indexed yet are searched
exactly, so a stale index misses nothing that an exact search of the new rows would find.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators import retrieval
from engram.schema import TABLES, StorageError
from engram.sources.store import Store

LEAST_ROWS = 256


class CellIndex:
    def __init__(self, store: Store, cells: int | None = None, sample_rows: int = 50_000):
        """cells: the square root of the number of rows, if not given."""
        self.store, self.cells, self.sample_rows = store, cells, sample_rows
        self._log = Store(store.spark, f"{store.path}/index")

    def state(self) -> dict | None:
        """centres, probes and the index files of each file of memories; None before the first build."""
        version = self._log.version()
        return self._log.manifest(version) if version else None

    def _files(self, version: int | None = None) -> list[str]:
        return sorted(p for parts in self.store.manifest(version)["tables"].get("memories", {}).values() for p in parts)

    def _memories(self, files: list[str]) -> DataFrame:
        spark = self.store.spark
        rows = spark.read.schema(TABLES["memories"]).parquet(*[f"{self.store.path}/{p}" for p in files]) if files else spark.createDataFrame([], TABLES["memories"])
        return rows.select("id", "embedding").filter("embedding is not null")

    def refresh(self, rebuild: bool = False) -> bool:
        """Brings the index up to the newest version; builds it once there are LEAST_ROWS rows.  False if nothing was to do.

        Of two refreshes at a time the later one gives way.
        """
        base, files = self._log.version(), self._files()
        old = None if rebuild else self.state()
        if old and sorted(old["parts"]) == files:
            return False
        if old:
            centres, probes = np.array(old["centres"]), old["probes"]
        else:
            rows = self._memories(files)
            n = rows.count()
            if n < LEAST_ROWS:
                return False
            centres = retrieval.cell_model(rows, self.cells or max(2, int(n**0.5)), self.sample_rows)
            probes = retrieval.calibrated_probes(rows, centres)
        parts = {p: x for p, x in (old["parts"] if old else {}).items() if p in files}
        new = [p for p in files if p not in parts]
        for p in new:
            at = f"files/part=p{uuid.uuid4().hex}"
            retrieval.with_cells(self._memories([p]), centres).write.partitionBy("cell").parquet(f"{self._log.path}/{at}")
            parts[p] = at
        try:
            self._log._publish({"centres": centres.tolist(), "probes": probes, "parts": parts}, base)
        except StorageError:
            return False
        return True

    def nearest(self, query: list[float], k: int, probes: int | None = None, version: int | None = None) -> DataFrame:
        """id, score of the k nearest memories of a version: by cells where files are indexed, else exact."""
        state, files = self.state(), self._files(version)
        known = [p for p in files if state and p in state["parts"]]
        rest = retrieval.nearest(self._memories([p for p in files if p not in known]), query, k)
        if not known:
            return rest
        centres = np.array(state["centres"])
        celled = self.store.spark.read.schema("id string, embedding array<float>, cell int").option("basePath", f"{self._log.path}/files").parquet(*[f"{self._log.path}/{state['parts'][p]}" for p in known])
        return retrieval.top_k_cells(celled, centres, query, k, probes or state["probes"]).unionByName(rest).orderBy(F.desc("score"), "id").limit(k)

    def __len__(self) -> int:
        state = self.state()
        return len(state["parts"]) if state else 0
