"""Lines that many documents hold are dropped from all of them; what is known of lines lies in levelled sorted runs.

A line's key is the line without the six ASCII blanks at its ends and with A-Z in lower case. A run is a table (h1, h2, n): the 128-bit
hash of a key and the number of documents that hold it, bucketed and sorted by the hash, so that runs merge and meet batches bucket by
bucket without being shuffled again. A new batch of documents is counted, merge-anti-joined with the run of keys that have already
reached the limit, and added as a run of level 0. When a level has two runs they are compacted into one run of the next level by a full
merge join: counts are summed, and keys that reach the limit move to the run of full keys, which no later batch counts again. So a key's count
lies in few rows, every pair of document and key is counted once, and a corpus that grows pays for its new documents and a logarithm of
compactions. Runs stay in a folder; ``Runs`` opened there again goes on from them.

Dropping needs the full keys beside the texts. Up to ``most`` of them (16 bytes each) are sent to all tasks, and each document is cut in place; if there
are more, the places of full keys are found by a shuffled join of (text, place, key) hashes, and texts meet their places in a second one. Both
give the same rows.

Defined cases: a null or empty text is one empty line; keys shorter than ``least`` code points are never dropped; documents are rows, so repeated rows
count as often as they stand there, and repeats of a line within a document count once; a text that loses all its lines is empty; an empty table gives
an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terraloom.llm.common import forget, parts, shared_dir, written

KEY = ["h1", "h2"]


def _hashed(text: bytes | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys' 16-byte hashes, None for keys that are too short."""
    lines = (text or b"").split(b"\n")
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()  # on bytes: ASCII blanks and letters only
        short = len(key) < least or least > 1 and len(key.decode("utf-8", "replace")) < least
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return lines, out


def _longs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)


def line_keys(docs: DataFrame, text_col: str = "text", least: int = 1, batches: int = 1) -> DataFrame:
    """A row (batch, h1, h2) per document and distinct key; documents are dealt to batches in turn."""

    def keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found: list[bytes] = []
            owner: list[int] = []
            for k, text in enumerate(batch.column(0).to_pylist()):
                own = {h for h in _hashed(text, least)[1] if h is not None}
                found.extend(own)
                owner.extend([k % batches] * len(own))
            pairs = _longs(found)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["batch", "h1", "h2"])

    return docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(keys, "batch int, h1 long, h2 long")


class Runs:
    """The runs of one folder. ``limit``: documents at which a key is full; ``buckets`` stays what it was when the folder was made."""

    def __init__(self, spark: SparkSession, folder: str, limit: int = 10, buckets: int | None = None):
        self.spark, self.folder, self.limit = spark, folder.rstrip("/"), limit
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in self.files.listStatus(path)] if self.files.exists(path) else []
        held = [n.split("-") for n in names if n.startswith("run-")]
        self.buckets = int(held[0][1]) if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, tuple[int, str]] = {}
        self.full: list[str] = []
        for name in sorted("-".join(n) for n in held):
            self._open(name)

    def _open(self, name: str) -> str:
        """Names the table of a run's files; its level is in the name, full runs have the level ``full``."""
        table = f"terraloom_{name.replace('-', '_')}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        level = name.split("-")[2]
        if level == "full":
            self.full.append(table)
        else:
            self.runs[table] = (int(level), name)
        return table

    def _write(self, rows: DataFrame, level: str) -> None:
        name = f"run-{self.buckets}-{level}-{uuid.uuid4().hex}"
        dealt = rows.select(*KEY, "n").repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(f"terraloom_{name.replace('-', '_')}")
        self._open(name)

    def _drop(self, table: str) -> None:
        _, name = self.runs.pop(table)
        self.spark.sql(f"DROP TABLE {table}")
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)

    def _merged(self, tables: list[str]) -> DataFrame:
        """The runs as one, counts summed. Two are merged bucket by bucket, as both are dealt and sorted alike."""
        out = self.spark.table(tables[0])
        for t in tables[1:]:
            other = self.spark.table(t).withColumnRenamed("n", "m")
            out = out.join(other, KEY, "full_outer").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: rows (h1, h2), one per document and key. Keys that are full already are left out by a merge-anti-join."""
        counts = keys.groupBy(*KEY).agg(F.count("*").alias("n"))
        for table in self.full:
            counts = counts.join(self.spark.table(table).select(*KEY), KEY, "left_anti")
        self._write(counts, "0")
        level = 0
        while len(now := [t for t, (k, _) in self.runs.items() if k == level]) >= 2:
            self._compact(now, level + 1)
            level += 1

    def _compact(self, tables: list[str], level: int) -> None:
        """One run of the next level instead of these; keys that reach the limit go to a run of full keys."""
        merged = written(self._merged(tables), "merged")
        full = merged.where(F.col("n") >= self.limit)
        if not full.isEmpty():
            self._write(full, "full")
        self._write(merged.where(F.col("n") < self.limit), str(level))
        forget(merged)
        for t in tables:
            self._drop(t)

    def frequent(self) -> DataFrame:
        """(h1, h2) of all keys that ``limit`` documents or more hold, as of now: the full ones and those whose runs add up to it."""
        tables = list(self.runs)
        out = self.spark.createDataFrame([], "h1 long, h2 long")
        if tables:
            out = self._merged(tables).where(F.col("n") >= self.limit).select(*KEY)
        for t in self.full:
            # An older run can hold a part of the count of a key that has become full since.
            out = out.join(self.spark.table(t).select(*KEY, F.lit(True).alias("full")), KEY, "full_outer").select(*KEY)
        return out

    def remove(self) -> None:
        """Deletes all runs."""
        for t in [*self.runs, *self.full]:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder), True)


def _cut(keep_id: StructField, least: int, held=None):
    """Arrow batches (id, text, places or null) -> (id, text, n_lines, n_dropped); ``held``: the broadcast keys, else places say what goes."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goes = held.value if held is not None else None
        for batch in rows:
            texts, sizes, gone = [], [], []
            places = batch.column(2).to_pylist() if goes is None else None
            for k, text in enumerate(batch.column(1).to_pylist()):
                if goes is not None:
                    lines, hashes = _hashed(text, least)
                    left = [x for x, h in zip(lines, hashes) if h not in goes]
                else:
                    lines, out = (text or b"").split(b"\n"), set(places[k] or ())
                    left = [x for i, x in enumerate(lines) if i not in out]
                texts.append(b"\n".join(left))
                sizes.append(len(lines))
                gone.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], [keep_id.name, "text", "n_lines", "n_dropped"])

    return cut


def _places(docs: DataFrame, frequent: DataFrame, text_col: str, least: int) -> DataFrame:
    """(t1, t2, places): for each text, by its hash, the lines whose keys are frequent; texts without any have no row."""

    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own, at, found = [], [], []
            for text in set(batch.column(0).to_pylist()):
                name = xxhash.xxh3_128_digest(text or b"")
                for i, h in enumerate(_hashed(text, least)[1]):
                    if h is not None:
                        own.append(name)
                        at.append(i)
                        found.append(h)
            t, h = _longs(own), _longs(found)
            yield pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in (t[:, 0], t[:, 1], np.array(at, np.int32), h[:, 0], h[:, 1])], ["t1", "t2", "at", "h1", "h2"])

    lines = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(spread, "t1 long, t2 long, at int, h1 long, h2 long")
    return lines.join(frequent, KEY, "left_semi").groupBy("t1", "t2").agg(F.collect_set("at").alias("places"))


def _named(docs: DataFrame, id_field: StructField, text_col: str) -> DataFrame:
    """docs as (id, t, t1, t2): the text with its hash."""

    def name(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            t = _longs([xxhash.xxh3_128_digest(x or b"") for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t[:, 0].copy()), pa.array(t[:, 1].copy())], [id_field.name, "t", "t1", "t2"])

    schema = StructType([id_field]).add("t", "binary").add("t1", "long").add("t2", "long")
    return docs.select(id_field.name, F.col(text_col).cast("binary").alias("t")).mapInArrow(name, schema)


def drop_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 500_000) -> DataFrame:
    """(id, text, n_lines, n_dropped): every document without its lines of frequent keys."""
    spark = docs.sparkSession
    id_field = docs.schema[id_col]
    schema = StructType([id_field]).add("text", "binary").add("n_lines", "long").add("n_dropped", "long")
    if frequent.count() <= most:
        keys = {np.array([r.h1, r.h2], "<i8").tobytes() for r in frequent.toLocalIterator()}
        read = docs.select(id_col, F.col(text_col).cast("binary").alias("t"))
        out = read.mapInArrow(_cut(id_field, least, spark.sparkContext.broadcast(keys)), schema)
    else:
        met = _named(docs, id_field, text_col).join(_places(docs, frequent, text_col, least), ["t1", "t2"], "left")
        out = met.select(id_col, "t", "places").mapInArrow(_cut(id_field, least), schema)
    return out.withColumn("text", F.col("text").cast("string"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, limit: int = 10, batches: int = 4, most: int = 500_000) -> DataFrame:
    """The whole job over one table: its documents come as batches into fresh runs, then all lose the lines that ``limit`` documents hold."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    line_keys(docs, text_col, least, batches).write.option("compression", "zstd").partitionBy("batch").parquet(f"{base}/keys")
    keys = spark.read.schema("h1 long, h2 long, batch int").parquet(f"{base}/keys")
    runs = Runs(spark, f"{base}/runs", limit, parts(docs))
    for k in range(batches):
        runs.add(keys.where(F.col("batch") == k).select(*KEY))
    frequent = written(runs.frequent(), "frequent")
    runs.remove()
    forget(keys)
    return drop_lines(docs, frequent, id_col, text_col, least, most)
