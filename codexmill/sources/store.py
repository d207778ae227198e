"""The store: documents and chunks as immutable Parquet below one path, published by manifests.

A run writes its chunks to a folder of its own and the documents of the buckets that it touches to
another, and nothing that is already there changes. Then one file, the next manifest, is renamed
into place: it names the folders that make up both tables, so a reader sees either version whole,
whenever a run stops. What a stopped run has left behind is named by no manifest; ``vacuum``
removes it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import shuffles_dropped
from ..operators import postings
from ..schemas import CHUNK, DOCUMENT

#: Documents are dealt by filename into so many folders; a run writes those of its own files anew.
BUCKETS = 64
#: Times that a run whose version was taken meanwhile merges its documents again.
ATTEMPTS = 5
_DOCUMENT, _CHUNK, _ISSUE = (StructType([*fields, StructField("run", StringType())]) for fields in (DOCUMENT.fields, CHUNK.fields, [StructField("filename", StringType()), StructField("said", StringType())]))


_POSTING = "term string, chunk_id long, document_id long, places array<struct<pos:int,weight:double>>, bucket int, run string"


#: Chunks of a document that are dealt to one task together.
TOGETHER = 1000


class VersionTaken(RuntimeError):
    """Another run has published this version."""


class Files:
    """The few file operations that a manifest needs, on any store that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def rename(self, source: str, target: str) -> None:
        """Fails with VersionTaken if the target is there."""
        (a, fs), (b, _) = self._at(source), self._at(target)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(a, b, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.toString()):
                raise VersionTaken(target) from e
            raise

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


class Store:
    """Documents, chunks and their postings below ``path``; a run replaces whole files, all of them or none.

    Chunks are merged on read: each carries its run's id and shows only under a document of that run,
    so replacing a file writes its new chunks and no others. Folders of runs that no document is left
    of drop out of the next manifest; ``compact`` writes all chunks that show into one. Two runs at a
    time are safe: the one that publishes second merges its documents with the first one's version.
    Needs a file system whose rename does not replace a file, such as HDFS or a local one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.files = spark, path.rstrip("/"), buckets, Files(spark)

    # versions

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/_manifest") if n.endswith(".json") and not n.startswith("_")]

    def manifest(self, version: int | None = None) -> dict:
        """What version holds: the newest, unless told otherwise; an empty one before the first run."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return {"version": -1, "buckets": self.buckets, "documents": {}, "chunks": [], "issues": [], "batches": {}}
        return json.loads(self.files.read(self._manifest(version)))

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_manifest/{version:012d}.json"

    def _publish(self, manifest: dict) -> None:
        """One rename shows both tables' new version."""
        staged = f"{self.path}/_manifest/_{uuid.uuid4().hex}.tmp"
        self.files.write(staged, json.dumps(manifest))
        try:
            self.files.rename(staged, self._manifest(manifest["version"]))
        finally:
            self.files.delete(staged)

    def init(self) -> None:
        """Publish an empty version where there is none; safe to repeat."""
        if not self.versions():
            try:
                self._publish(self.manifest() | {"version": 0})
            except VersionTaken:
                pass

    # reading

    def _documents(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/documents/{run}/bucket={b}" for b, run in m["documents"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(_DOCUMENT).parquet(*paths) if paths else self.spark.createDataFrame([], _DOCUMENT)

    def _runs(self, kind: str, schema: StructType | str, runs: list[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/run={r}" for r in runs]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self, version: int | None = None) -> DataFrame:
        return self._documents(self.manifest(version)).drop("run")

    def _shown(self, m: dict, rows: DataFrame) -> DataFrame:
        """The rows of the documents' own runs."""
        held = self._documents(m).select(F.col("document_id").alias("_id"), F.col("run").alias("_run"))
        return rows.join(held, (F.col("document_id") == F.col("_id")) & (F.col("run") == F.col("_run")), "left_semi")

    def chunks(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._shown(m, self._runs("chunks", _CHUNK, m["chunks"])).select(*CHUNK.fieldNames())

    def postings(self, version: int | None = None) -> DataFrame:
        """(term, chunk_id, places) of the chunks' lexemes, in folders by term (see operators.postings)."""
        m = self.manifest(version)
        return self._shown(m, self._runs("postings", _POSTING, m["chunks"])).select("term", "chunk_id", "places")

    def issues(self) -> DataFrame:
        """(run, filename, said) of all runs: what lines were skipped and why."""
        return self._runs("issues", _ISSUE, self.manifest()["issues"]).select("run", "filename", "said")

    # writing

    def _write(self, rows: DataFrame, path: str, by: str | None = None) -> None:
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        with shuffles_dropped(rows.sparkSession):
            (writer.partitionBy(by) if by else writer).parquet(path)

    def _put(self, chunks: DataFrame, run: str, dealt: bool = False) -> None:
        """A run's chunks, and their postings as written chunks have them."""
        if not dealt:
            # dealt by hash: a range would be sampled, and making the chunks is the dear part
            chunks = chunks.repartition("document_id", F.floor(F.col("chunk_index") / TOGETHER)).sortWithinPartitions("document_id", "chunk_index")
        self._write(chunks, f"{self.path}/chunks/run={run}")
        written = self.spark.read.schema(CHUNK).parquet(f"{self.path}/chunks/run={run}")
        self._write(postings.folders(written, also=("document_id",)), f"{self.path}/postings/run={run}", "bucket")

    def replace(self, documents: DataFrame, chunks: DataFrame, issues: DataFrame | None = None, batch: tuple[str, int] | None = None, run: str | None = None, dealt: bool = False) -> int:
        """Put these files in place of earlier versions, in one step; others stay. Returns the version.

        ``documents`` has one row a filename. A ``batch`` (stream, number) that has been published
        before, or one older, changes nothing, so a stream may repeat it. Chunks are shuffled into the order
        of their documents, unless ``dealt`` says that they come in it.
        """
        m = self.manifest()
        if self._seen(m, batch):
            return m["version"]
        run = run or uuid.uuid4().hex
        self._put(chunks.select(*CHUNK.fieldNames()), run, dealt)
        if issues is not None:
            self._write(issues.select("filename", "said"), f"{self.path}/issues/run={run}")
        for attempt in range(ATTEMPTS):
            try:
                return self._merge(documents, m, f"{run}-{attempt}", run, batch, issues is not None)
            except VersionTaken:
                m = self.manifest()
                if self._seen(m, batch):
                    return m["version"]
        raise VersionTaken(f"{ATTEMPTS} versions were taken by other runs")

    @staticmethod
    def _seen(m: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and m["batches"].get(batch[0], -1) >= batch[1]

    def _merge(self, documents: DataFrame, m: dict, folder: str, run: str, batch: tuple[str, int] | None, issues: bool) -> int:
        bucket = F.pmod(F.xxhash64("filename"), F.lit(m["buckets"])).cast("int")
        named = documents.select(*DOCUMENT.fieldNames()).withColumn("run", F.lit(run))
        touched = [r["b"] for r in named.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets
        kept = self._documents(m, touched).join(named.select("filename"), "filename", "left_anti").select(*_DOCUMENT.fieldNames())
        merged = kept.unionByName(named).withColumn("bucket", bucket)
        if touched:
            self._write(merged.repartition("bucket"), f"{self.path}/documents/{folder}", "bucket")
        new = m | {"version": m["version"] + 1, "documents": m["documents"] | {str(b): folder for b in touched}}
        live = {r["run"] for r in self._documents(new).select("run").distinct().collect()}  # a short name a run
        new |= {"chunks": [r for r in [*m["chunks"], run] if r in live], "issues": [*m["issues"], *([run] if issues else [])]}
        if batch:
            new["batches"] = m["batches"] | {batch[0]: batch[1]}
        self._publish(new)
        return new["version"]

    def compact(self) -> int:
        """Write the chunks that show, and only they, as one run of the next version."""
        m, run = self.manifest(), uuid.uuid4().hex
        self._put(self.chunks(m["version"]), run)
        bucket = F.pmod(F.xxhash64("filename"), F.lit(m["buckets"])).cast("int")
        self._write(self._documents(m).withColumn("run", F.lit(run)).withColumn("bucket", bucket).repartition("bucket"), f"{self.path}/documents/{run}", "bucket")
        self._publish(m | {"version": m["version"] + 1, "documents": dict.fromkeys(m["documents"], run), "chunks": [run]})
        return m["version"] + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what the newest ``keep`` versions do not name; not while another run writes."""
        kept = self.versions()[-keep:] if keep else []
        named = [self.manifest(v) for v in kept]
        used = {f"documents/{r}" for m in named for r in m["documents"].values()} | {f"{kind}/run={r}" for m in named for kind, named_as in (("chunks", "chunks"), ("postings", "chunks"), ("issues", "issues")) for r in m[named_as]}
        gone = [f"{kind}/{n}" for kind in ("documents", "chunks", "postings", "issues") for n in self.files.names(f"{self.path}/{kind}") if f"{kind}/{n}" not in used]
        gone += [f"_manifest/{v:012d}.json" for v in self.versions() if v not in kept]
        for name in gone:
            self.files.delete(f"{self.path}/{name}")
        return gone
