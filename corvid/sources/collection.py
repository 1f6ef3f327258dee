"""A collection kept as a log: data files that are only added, files of deleted keys, and numbered manifests that list both.

- A change writes its own rows and then the next manifest; readers take the newest manifest, so they see a change whole or
  not at all. A file system never replaces a manifest that is there, so of two writers with one number the later one
  reads what the other did, drops what it has added in the meantime, and tries the next number.
- A delete writes the keys; it covers the data of smaller versions.
- Data files keep Bloom filters of their keys. Up to ``KEYS`` keys of a small change are pushed to the scan, which skips
  the row groups that can't have them; larger changes are joined.
- A manifest remembers the last change of each named source (``source``, ``batch``), so that a replay changes nothing.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvid.operators.ingest import chunks, faq_id, first_wins, single_faq_id, skip_existing, stored_chunks, valid_pairs

#: So many keys at most are collected and pushed to a scan.
KEYS = 1000
EMPTY = {"version": 0, "adds": [], "deletes": [], "batches": {}}


class Collection:
    """Append, delete, clear, compact and scan, by any number of writers at once."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), StructType.fromDDL(schema), key
        self.columns = self.schema.names
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _hadoop(self, name: str):
        path = self._fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, root = self._hadoop("log")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What is in the collection: the newest manifest, or that of a version."""
        found = self.versions()
        if not found:
            return dict(EMPTY)
        fs, path = self._hadoop(f"log/{(found[-1] if version is None else version):012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Write the manifest under its number; false if that is taken."""
        name, spare = f"log/{manifest['version']:012d}.json", f"log/.{uuid.uuid4().hex}"
        fs, temporary = self._hadoop(spare)
        _, target = self._hadoop(name)
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local rename replaces what is there, a link doesn't
                local = urlparse(self.path).path
                os.link(f"{local}/{spare}", f"{local}/{name}")
            else:
                context = self._fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(fs.makeQualified(temporary), fs.makeQualified(target), self.spark._sc._gateway.new_array(self._fs.Options.Rename, 0))
        except Exception:
            if not fs.exists(target):
                raise
            return False
        finally:
            fs.delete(temporary, False)
        return True

    def _write(self, rows: DataFrame, kind: str) -> tuple[str, int]:
        """A new folder of files with ``rows``, and how many there are."""
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/{name}")
        return name, self._read([name], rows.schema).count()

    def _read(self, names: list[str], schema: StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _rows(self, manifest: dict, adds: list[dict]) -> DataFrame:
        """The rows of ``adds`` that no later delete covers."""
        data = self._read([a["name"] for a in adds])
        gone = [d for d in manifest["deletes"] if any(d["version"] > a["version"] for a in adds)]
        if not gone:
            return data
        of = lambda listed: F.create_map(*[F.lit(v) for x in listed for v in (x["name"], x["version"])])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        deleted = self._read([d["name"] for d in gone], StructType([self.schema[self.key]])).select(F.col(self.key).alias("__k"), of(gone)[folder].alias("__d")).groupBy("__k").agg(F.max("__d").alias("__d"))
        data = data.select("*", of(adds)[folder].alias("__v"))
        return data.join(deleted, (F.col(self.key) == F.col("__k")) & (F.col("__d") > F.col("__v")), "left_anti").drop("__v")

    def scan(self, version: int | None = None) -> DataFrame:
        """All rows, as of now or of a version."""
        m = self.manifest(version)
        return self._rows(m, m["adds"])

    def _without(self, rows: DataFrame, manifest: dict, adds: list[dict]) -> DataFrame:
        """``rows`` whose key is not among those of ``adds``."""
        if not adds:
            return rows
        few = [r[0] for r in rows.select(self.key).filter(F.col(self.key).isNotNull()).distinct().limit(KEYS + 1).collect()]
        there = self._rows(manifest, adds)
        return skip_existing(rows, there.filter(F.col(self.key).isin(few)) if len(few) <= KEYS else there, self.key)

    def _change(self, build, source: str | None, batch: int | None) -> int | None:
        """Commit what ``build`` makes of the newest manifest, again and again until no other writer was faster; null if there is nothing to do."""
        while True:
            now = self.manifest()
            if source is not None and now["batches"].get(source, -1) >= batch:
                return None
            new = build(now)
            if new is None:
                return None
            new = {**now, **new, "version": now["version"] + 1}
            if source is not None:
                new["batches"] = {**now["batches"], source: batch}
            if self._commit(new):
                return new["version"]
            time.sleep(0.01)

    def add(self, rows: DataFrame, order: str, source: str | None = None, batch: int | None = None, own: bool = False) -> int | None:
        """New rows only: the first of each key, and none whose key is there. Returns the version, or null if nothing was new.

        ``source`` and ``batch`` name the change, so that it happens once. ``own`` says that the source itself never gives
        a key twice, so that only what others added is looked through.
        """
        picked = first_wins(rows, self.key, order)
        picked = picked.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in picked.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        state = {"seen": set(), "name": None, "rows": None}

        def build(now: dict) -> dict | None:
            other = [a for a in now["adds"] if a["name"] not in state["seen"] and not (own and a.get("source") == source)]
            if state["name"] is None or other:
                fresh = self._without(picked if state["name"] is None else self._read([state["name"]]), now, other)
                state["name"], state["rows"] = self._write(fresh, "data")
            state["seen"] |= {a["name"] for a in now["adds"]}
            if not state["rows"]:
                return {} if source is not None else None
            return {"adds": [*now["adds"], {"name": state["name"], "version": now["version"] + 1, "rows": state["rows"], "source": source}]}

        return self._change(build, source, batch)

    def add_pairs(self, rows: DataFrame, order: str, **named) -> int | None:
        """Question-answer pairs in bulk: those that lack a text go, ids are of their texts."""
        return self.add(valid_pairs(rows, "question", "answer").withColumn("id", faq_id(F.col("question"), F.col("answer"))), order, **named)

    def add_pair(self, question: str, answer: str, created_at: str, given_id: str | None = None, **columns) -> str:
        """One pair by itself; its id is of the question and the time unless it is given. Returns the id."""
        row = self.spark.range(1).select(F.lit(question).alias("question"), F.lit(answer).alias("answer"), F.lit(created_at).alias("created_at"), *[F.lit(v).alias(k) for k, v in columns.items()], F.lit(0).alias("__pos"))
        row = row.withColumn("id", F.lit(given_id) if given_id else single_faq_id(F.col("question"), F.col("created_at")))
        self.add(row, "__pos")
        return row.first()["id"]

    def add_documents(self, docs: DataFrame, document: str, text: str, given: str | None = None, order: str | None = None, **named) -> int | None:
        """Documents as chunks, each once, with contents as a collection stores them; ``order`` is the documents' input order."""
        x = docs.withColumn("__doc", F.col(order) if order else F.struct(F.input_file_name(), F.monotonically_increasing_id()))
        x = stored_chunks(chunks(x, document, text, given)).withColumnRenamed("chunk_id", "id").withColumn("document_title", F.col(document))
        return self.add(x.withColumn("__pos", F.struct("__doc", F.monotonically_increasing_id().alias("__n"))), "__pos", **named)

    def delete(self, ids: DataFrame) -> int | None:
        """Rows of these keys go; keys that aren't there are written all the same, and change nothing."""
        name, n = self._write(ids.select(F.col(self.key).cast(self.schema[self.key].dataType)).filter(F.col(self.key).isNotNull()).distinct(), "gone")
        return self._change(lambda now: {"deletes": [*now["deletes"], {"name": name, "version": now["version"] + 1, "rows": n}]} if n and now["adds"] else None, None, None)

    def clear(self) -> int | None:
        return self._change(lambda now: {"adds": [], "deletes": []}, None, None)

    def compact(self) -> int | None:
        """All rows in one folder, without files of deleted keys; changes that happen in the meantime stay."""
        before = self.manifest()
        name, n = self._write(self._rows(before, before["adds"]), "data")
        olds = {a["name"] for a in before["adds"]}

        def build(now: dict) -> dict | None:
            if not olds <= {a["name"] for a in now["adds"]}:
                return None
            rest = [a for a in now["adds"] if a["name"] not in olds]
            kept = [d for d in now["deletes"] if d["version"] > before["version"]]
            return {"adds": [{"name": name, "version": before["version"], "rows": n, "source": None}, *rest], "deletes": kept}

        return self._change(build, None, None) if before["adds"] else None

    def count(self) -> int:
        return self.scan().count()
