"""Sharding: a table kept as immutable shards under a versioned manifest, with size-tiered compaction.

``<root>/data/<id>`` holds a shard's Parquet files, ``<root>/manifest/v%012d.json`` a version: the live shards with rows
and bytes. A version is written under another name and renamed to its own, which fails if another writer was first
(the change is then worked out again on top of the newer version), so readers see a version whole or not at all. Shards
are never changed: an executor that is lost costs a task, a driver that is lost leaves files that no manifest names.
A shard under way has a file ``<root>/intents/<id>`` from before its first byte until after its commit; ``vacuum`` leaves it alone.

Compaction puts shards into tiers by size (powers of ``fan_in``); ``fan_in`` shards of a tier make one merged run, cut into
files of about ``target_bytes``. Rows aren't looked at, so nulls, repeated rows, empty texts and extra columns pass
unchanged; an empty batch commits no shard. All batches must have the schema of the first.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from spreadrank.llm.common import file_system, remove


class Taken(Exception):
    """Another compaction has taken the shards."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in

    def versions(self) -> list[int]:
        fs, path = file_system(self.spark, f"{self.root}/manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's content, the newest if none is named: version, schema, shards."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        fs, path = file_system(self.spark, f"{self.root}/manifest/v{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change) -> dict:
        jvm = self.spark.sparkContext._jvm
        tries = 0
        while True:  # each turn that is lost is another writer's commit
            old = self.manifest()
            new = {**change(old), "version": old["version"] + 1}
            fs, draft = file_system(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
            stream = fs.create(draft, False)
            stream.write(json.dumps(new).encode())
            stream.close()
            final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{new['version']:012d}.json")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            try:
                context.rename(draft, final, options)
                return new
            except Exception as e:
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise
                tries += 1
                time.sleep(random.random() * min(5, 0.05 * 2 ** min(tries, 10)))

    def _intent(self, shard: str) -> str:
        return f"{self.root}/intents/{shard}"

    def _write(self, df: DataFrame) -> dict | None:
        name = uuid.uuid4().hex
        path = f"{self.root}/data/{name}"
        fs, intent = file_system(self.spark, self._intent(name))
        fs.create(intent, False).close()
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        if not rows:
            remove(self.spark, path)
            remove(self.spark, self._intent(name))
            return None
        fs, p = file_system(self.spark, path)
        return {"id": name, "rows": rows, "bytes": fs.getContentSummary(p).getLength()}

    def append(self, df: DataFrame) -> dict:
        """Write a batch as a new small shard and commit it."""
        shard, schema = self._write(df), df.schema.json()

        def change(old: dict) -> dict:
            if old["schema"] and [(f["name"], f["type"]) for f in json.loads(old["schema"])["fields"]] != [(f["name"], f["type"]) for f in json.loads(schema)["fields"]]:
                raise ValueError("the batch has another schema than the table")
            return {"schema": old["schema"] or schema, "shards": old["shards"] + ([shard] if shard else [])}

        new = self._commit(change)
        if shard:
            remove(self.spark, self._intent(shard["id"]))
        return new

    def tier(self, size: int) -> int:
        """0 for the smallest shards; each tier's shards are up to ``fan_in`` times as large as the last one's."""
        return max(0, int(math.log(max(size, 1), self.fan_in)) - 5)

    def plan(self) -> list[list[dict]]:
        """Groups of ``fan_in`` shards of one tier, oldest first. What is left of a tier, under ``fan_in`` shards, stays."""
        tiers: dict[int, list[dict]] = {}
        for shard in self.manifest()["shards"]:
            tiers.setdefault(self.tier(shard["bytes"]), []).append(shard)
        return [group[i : i + self.fan_in] for _, group in sorted(tiers.items()) for i in range(0, len(group) - self.fan_in + 1, self.fan_in)]

    def compact(self) -> int:
        """Merge until no tier holds ``fan_in`` shards; returns how many merges were committed.

        Shards that another compaction has taken meanwhile are left to it, and what was merged of them goes.
        """
        from pyspark.sql import types as T

        merges = 0
        while groups := self.plan():
            for group in groups:
                schema = T.StructType.fromJson(json.loads(self.manifest()["schema"]))
                files = max(1, math.ceil(sum(s["bytes"] for s in group) / self.target_bytes))
                df = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{s['id']}" for s in group])
                merged, ids = self._write(df.coalesce(files)), {s["id"] for s in group}

                def change(old: dict) -> dict:
                    if not ids <= {s["id"] for s in old["shards"]}:
                        raise Taken
                    return {"schema": old["schema"], "shards": [s for s in old["shards"] if s["id"] not in ids] + [merged]}

                try:
                    self._commit(change)
                    merges += 1
                except Taken:
                    remove(self.spark, f"{self.root}/data/{merged['id']}")
                remove(self.spark, self._intent(merged["id"]))
        return merges

    def vacuum(self, keep: int = 1, abandoned: float = 86_400) -> int:
        """Delete the shards that none of the newest ``keep`` versions names; returns how many.

        Shards under way stay, unless they began over ``abandoned`` seconds ago (their writer is taken for lost). Readers of
        older versions than the newest ``keep`` lose their files.
        """
        fs, path = file_system(self.spark, f"{self.root}/data")
        there = {s.getPath().getName(): s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else [])}
        _, intents = file_system(self.spark, f"{self.root}/intents")
        begun = {s.getPath().getName(): s.getModificationTime() / 1000 for s in (fs.listStatus(intents) if fs.exists(intents) else [])}
        # The manifest comes last: what was committed before is named, what began later isn't listed.
        live = {s["id"] for v in self.versions()[-keep:] for s in self.manifest(v)["shards"]}
        live |= {i for i, t in begun.items() if t > time.time() - abandoned}
        for name in there.keys() - live:
            fs.delete(there[name], True)
            remove(self.spark, self._intent(name))
        return len(there.keys() - live)

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql import types as T

        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError(f"{self.root} has no version yet")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{s['id']}" for s in m["shards"]])
