"""A keyed table in shared storage that several streams write: rows by hash of their key in parts, of which a batch rewrites only those it touches.

A version is a small JSON file that names the folder of each part and the last batch of each writer. A
writer works on the newest version and makes the next one by creating its file, which only one writer can do: the
others begin again on the version that won. A batch that a version has is skipped, so a replay changes nothing.
Readers keep the version that they began with until `vacuum` removes it. The file system must refuse to
rename onto an existing file (HDFS does, and the local one within a driver).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.operators.shared import Files, stored

class PartedTable:
    """See the module. key: the column that identifies a row; parts: fixed when the table is begun."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.files = Files(spark, path)

    def _newest(self) -> tuple[int, dict]:
        versions = [int(n.removesuffix(".json")) for n, _, _ in self.files.names("versions") if n.endswith(".json")]
        if not versions:
            return 0, {"batches": {}, "parts": {}, "of": self.parts}
        state = json.loads(self.files.text(f"versions/{max(versions):012d}.json"))
        self.parts = state["of"]
        return max(versions), state

    def _frame(self, state: dict, parts: list[int] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/{folder}/part={k}" for k, folder in state["parts"].items() if parts is None or int(k) in parts]
        if "schema" not in state:
            return None
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The newest version, None before the first."""
        return self._frame(self._newest()[1])

    def version(self) -> int:
        return self._newest()[0]

    def commit(self, writer: str, batch: int, change: Callable[[DataFrame | None], DataFrame], attempts: int = 50) -> bool:
        """Puts in the rows that change(table) gives, new and replaced ones, whole; False if the batch is in already."""
        for _ in range(attempts):
            version, state = self._newest()
            if state["batches"].get(writer, -1) >= batch:
                return False
            rows = stored(change(self._frame(state)))
            part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
            touched = sorted(r[0] for r in rows.select(part.alias("part")).distinct().collect())  # at most `parts`
            now, folder = dict(state["parts"]), f"data/{uuid.uuid4().hex}"
            if touched:
                old = self._frame(state, touched)
                if old is not None:
                    rows = old.join(rows.select(self.key), self.key, "left_anti").select(*rows.columns).unionByName(rows)
                rows.withColumn("part", part).repartition(len(touched), "part").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{folder}")
                now |= {str(k): folder for k in touched}
            after = {"batches": state["batches"] | {writer: batch}, "parts": now, "of": self.parts, "schema": state.get("schema") or json.loads(rows.schema.json())}
            if self.files.create(f"versions/{version + 1:012d}.json", json.dumps(after)):
                return True
        raise RuntimeError(f"{attempts} other commits came first")

    def vacuum(self, keep: int = 10, least_age: float = 86400) -> int:
        """Removes all versions but the last `keep`, and the data that these don't use and that is older than least_age seconds."""
        versions = sorted(n for n, _, _ in self.files.names("versions") if n.endswith(".json"))
        used = {f"{folder}/part={k}" for n in versions[-keep:] for k, folder in json.loads(self.files.text(f"versions/{n}"))["parts"].items()}
        for n in versions[:-keep]:
            self.files.delete(f"versions/{n}")
        gone = 0
        for folder, age, _ in self.files.names("data"):
            parts = [n for n, _, _ in self.files.names(f"data/{folder}") if n.startswith("part=")]
            idle = [n for n in parts if f"data/{folder}/{n}" not in used]
            if age >= least_age and idle:
                for n in [f"/{n}" for n in idle] if len(idle) < len(parts) else [""]:
                    self.files.delete(f"data/{folder}{n}")
                gone += len(idle)
        return gone
