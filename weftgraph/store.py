"""A keyed table in hash buckets of which a batch rewrites only those it touches.

Below the table's folder, ``data/v=k/bucket=b`` has the rows of bucket b as version k wrote them, and ``versions/k.json`` says for each
bucket which version wrote it last, and the last batch of each kind. The file that names a version is made at once by a rename after all its data are
written: a run that dies in between leaves the version before, and its data are overwritten when the batch comes again. Readers keep
to one version. Old files stay until ``drop_old``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketStore:
    """A table with rows of distinct ``keys``, in ``buckets`` parts by a hash of the keys; the number stays as it was first.

    One writer at a time. An empty table has no columns until something is stored.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.buckets = (self._version() or {"buckets": buckets})["buckets"]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _version(self) -> dict | None:
        """The newest version's file, or None."""
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        ks = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not ks:
            return None
        fs, p = self._fs(f"{self.path}/versions/{max(ks)}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        fs, draft = self._fs(f"{self.path}/versions/{state['version']}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(draft, self._fs(f"{self.path}/versions/{state['version']}.json")[1]):
            raise RuntimeError(f"version {state['version']} of {self.path} is there already: two writers?")

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that rows with these keys fall into: no more numbers than there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame | None:
        """The rows of some buckets (all of them by default); None before anything is stored."""
        state = state or self._version()
        if not state:
            return None
        some = [f"{self.path}/data/v={v}/bucket={b}" for b, v in state["held"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def _store(self, state: dict | None, kind: str, n: int, rows: DataFrame, buckets: list[int]) -> int:
        """Version k + 1: these buckets as ``rows`` has them, all others as they were."""
        k = state["version"] + 1 if state else 0
        if buckets:
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={k}")
        fs, p = self._fs(f"{self.path}/data/v={k}")
        there = {f.getPath().getName() for f in fs.listStatus(p)} if buckets else set()
        held = dict(state["held"]) if state else {}
        for b in buckets:
            held.pop(str(b), None)
            if f"bucket={b}" in there:
                held[str(b)] = k
        batches = (state or {}).get("batches", {}) | {kind: n}
        schema = rows.drop("bucket").schema.jsonValue() if buckets or not state else state["schema"]
        self._publish({"version": k, "buckets": self.buckets, "held": held, "batches": batches, "schema": schema})
        return len(buckets)

    def upsert(self, n: int, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], kind: str = "upsert", order: str = "seq") -> int:
        """Batch ``n``: ``merge(stored, new)`` over the buckets of the new keys; how many buckets were written.

        Stored rows come with ``order`` -1. A batch whose number is not above the last of its kind writes nothing.
        """
        state = self._version()
        if state and n <= state["batches"].get(kind, -1):
            return 0
        buckets = self.touched(new)
        stored = self.read(buckets, state) if state else None
        stored = new.limit(0) if stored is None else stored.withColumn(order, F.lit(-1).cast("long"))
        return self._store(state, kind, n, merge(stored, new), buckets)

    def rewrite(self, n: int, targets: DataFrame, change: Callable[[DataFrame], DataFrame], kind: str = "rewrite") -> int:
        """Batch ``n``: ``change(rows)`` over the buckets that hold rows with the values of ``targets``; how many buckets were written.

        ``change`` keeps the rows of other targets. Rows whose keys it changes move to other buckets, which are written too.
        """
        state = self._version()
        if not state or n <= state["batches"].get(kind, -1):
            return 0
        wanted = targets.distinct()
        buckets, before = self.touched(self.read(state=state).join(wanted, wanted.columns, "left_semi")), None
        while buckets != before:  # once more where rows move to buckets that are not among them
            before, rows = buckets, change(self.read(buckets, state))
            buckets = sorted({*buckets, *self.touched(rows.join(wanted, wanted.columns, "left_semi"))}) if buckets else buckets
        return self._store(state, kind, n, rows, buckets) if buckets else self._store(state, kind, n, self.read([], state), [])

    def drop_old(self) -> int:
        """Delete data and version files that the newest version does not need, once no reader of an older one is left; how many folders went."""
        state = self._version()
        if not state:
            return 0
        keep, gone = {(str(v), b) for b, v in state["held"].items()}, 0
        fs, p = self._fs(f"{self.path}/data")
        for version in fs.listStatus(p) if fs.exists(p) else []:
            for part in fs.listStatus(version.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and (version.getPath().getName()[2:], name[7:]) not in keep:
                    gone += bool(fs.delete(part.getPath(), True))
        fs, p = self._fs(f"{self.path}/versions")
        for f in fs.listStatus(p):
            if f.getPath().getName() != f"{state['version']}.json":
                fs.delete(f.getPath(), False)
        return gone
