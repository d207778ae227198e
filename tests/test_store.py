"""The store's versions, and readers of files of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codexmill.operators.chunking import split_legal
from codexmill.plans import service
from codexmill.schemas import CHUNK, DOCUMENT
from codexmill.sources import files
from codexmill.sources.store import Store, VersionTaken


def _null(schema, **made):
    return [F.lit(made[f.name]).cast(f.dataType).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]


def docs(spark, *ids):
    out = [spark.range(1).select(*_null(DOCUMENT, document_id=i, filename=str(i))) for i in ids]
    first = out[0]
    for more in out[1:]:
        first = first.union(more)
    return first


def chunk(spark, i, said):
    return spark.range(1).select(*_null(CHUNK, chunk_id=i, document_id=i, chunk_index=0, content=said, filename=str(i)))


def shown(store):
    return {r["filename"] for r in store.documents().collect()}, {r["content"] for r in store.chunks().collect()}


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    store.init()
    store.replace(docs(spark, 1, 2), chunk(spark, 1, "old").union(chunk(spark, 2, "stays")))
    return store


OLD, NEW = ({"1", "2"}, {"old", "stays"}), ({"1", "2"}, {"new", "stays"})


@pytest.mark.parametrize("stop", ["before chunks", "within chunks", "before documents", "within documents", "before manifest", "within manifest"])
def test_a_run_stopped_anywhere_shows_the_old_version_whole(spark, store, monkeypatch, stop):
    when, what = stop.split()
    write, manifest = Store._write, store.files.write

    def stopped(*_):
        raise RuntimeError("lost")

    def stop_write(self, rows, path, by=None):
        if f"/{what}/" in path:
            if when == "within":  # some files are there, the job did not end
                write(self, rows.limit(1), path, by)
            stopped()
        write(self, rows, path, by)

    monkeypatch.setattr(Store, "_write", stop_write)
    if what == "manifest":
        monkeypatch.setattr(store.files, "write", stopped if when == "before" else lambda path, text: (manifest(path, text[: len(text) // 2]), stopped()))
    with pytest.raises(RuntimeError):
        store.replace(docs(spark, 1), chunk(spark, 1, "new"))
    monkeypatch.undo()
    assert shown(store) == OLD and shown(Store(spark, store.path)) == OLD
    store.replace(docs(spark, 1), chunk(spark, 1, "new"))
    assert shown(store) == NEW


def test_old_versions_stay_readable_until_vacuum(spark, store):
    old = store.chunks()
    store.replace(docs(spark, 1), chunk(spark, 1, "new"))
    assert {r["content"] for r in old.collect()} == OLD[1] == {r["content"] for r in store.chunks(1).collect()}
    assert len(store.manifest()["chunks"]) == 2
    store.replace(docs(spark, 2), chunk(spark, 2, "more"))
    assert len(store.manifest()["chunks"]) == 2  # the first run has no document left
    store.compact()
    assert shown(store) == ({"1", "2"}, {"new", "more"}) and len(store.manifest()["chunks"]) == 1
    assert store.vacuum(1) and shown(store) == ({"1", "2"}, {"new", "more"}) and store.versions() == [4]
    assert store.vacuum(1) == []


def test_two_runs_at_a_time_lose_nothing(spark, store, monkeypatch):
    publish, calls = Store._publish, []

    def raced(self, manifest):
        if not calls:  # another run publishes first
            calls.append(1)
            Store(spark, store.path).replace(docs(spark, 3), chunk(spark, 3, "raced"))
        publish(self, manifest)

    monkeypatch.setattr(Store, "_publish", raced)
    store.replace(docs(spark, 1), chunk(spark, 1, "new"))
    assert shown(store) == ({"1", "2", "3"}, {"new", "stays", "raced"})
    with pytest.raises(VersionTaken):
        publish(store, store.manifest())


def test_a_repeated_batch_changes_nothing(spark, store):
    v = store.replace(docs(spark, 1), chunk(spark, 1, "new"), batch=("s", 0))
    assert store.replace(docs(spark, 1), chunk(spark, 1, "again"), batch=("s", 0)) == v and shown(store) == NEW
    assert store.replace(docs(spark, 1), chunk(spark, 1, "old"), batch=("t", 0)) == v + 1 and shown(store) == OLD
    assert store.replace(docs(spark, 1).limit(0), chunk(spark, 1, "x").limit(0)) == v + 2 and shown(store) == OLD


def lines_of(rng, n):
    return [rng.choice([json.dumps({"text": f"t{i}", "document_title": f"T{i % 7}"}), "", "[1]", '{"text": " "}', "{oops", "  "]) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, end):
    rng = random.Random(2)
    every = {"big.jsonl": lines_of(rng, 3000), "Small one+%41.JSONL": lines_of(rng, 5), "none.jsonl": []}
    for name, lines in every.items():
        (tmp_path / name).write_bytes(end.join(lines).encode())
    (tmp_path / "x.txt").write_text("no")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = files.read_lines(spark, str(tmp_path), ".jsonl")
        assert lines.select("part").distinct().count() > 5
        got = {(r["filename"], r["n"]): r["line"] for r in lines.collect()}
        want = {(name, i + 1): x for name, all_of in every.items() for i, x in enumerate(end.join(all_of).replace(end, "\n").split("\n")) if not (x == "" and i + 1 == len(all_of))}
        assert {k: v for k, v in got.items() if v or k in want} == want or {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        rows = files.read_jsonl(spark, str(tmp_path))
        said = {(r["filename"], r["n"]) for r in rows.filter("said is not null").collect()}
        assert said == {k for k, v in want.items() if v in ("[1]", '{"text": " "}', "{oops")}
        chunks = [(r["filename"], r["chunk_index"], r["item"]["content"]) for r in files.indexed(rows).collect()]
        assert sorted(chunks) == sorted((name, i, x) for name in every for i, x in enumerate(json.loads(v)["text"] for (f, n), v in sorted(want.items()) if f == name and v.startswith('{"text": "t')))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_text_files_split_by_article_as_whole_texts_do(spark, tmp_path):
    rng = random.Random(5)
    parts = ["Статья 1. О труде", "статья 2", "  Статья 3.1. Длинное название о\n", "слова и дела " * 20 + ".", "", "", "ГЛАВА 2", "продолжение строки\x0cещё", "﻿текст"]
    whole = {f"f{k}.txt": "\n".join(rng.choice(parts) for _ in range(rng.randrange(60))) for k in range(12)}
    for name, text in whole.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = files.indexed(files.read_texts(spark, str(tmp_path), 120, 0))
    got = sorted((r["filename"], r["chunk_index"], r["item"]["content"], r["item"]["article_number"], r["item"]["article_title"]) for r in rows.collect())
    plain = spark.createDataFrame(list(whole.items()), "filename string, text string").select("filename", F.posexplode(split_legal(F.col("text"), 120)).alias("i", "c"))
    assert got == sorted((r["filename"], r["i"], *r["c"]) for r in plain.collect())


def test_ingest_keeps_its_issues_and_no_staging(spark, tmp_path):
    src = tmp_path / "d"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(["{bad"] * 30 + ['{"text": "x"}']))
    store = Store(spark, str(tmp_path / "s"), 2)
    stats = service.ingest(spark, str(src), store)
    assert stats["issues_count"] == 30 and len(stats["issues"]) == service.ISSUES_SHOWN and store.issues().count() == 30
    assert not list((tmp_path / "s").glob("_staging*"))
    (src / "a.jsonl").write_bytes(b'\xff\xfe\n{"text": "y"}')
    assert service.ingest(spark, str(src), store)["issues_count"] == 1 and shown(store)[1] == {"y"}


class Batches:
    """An embedder that refuses more texts at a time than a worker should hold."""

    def __call__(self, texts):
        if len(texts) > 256:
            raise ValueError(f"{len(texts)} texts at once")
        return [[1.0] for _ in texts]


def test_ingest_holds_few_texts_at_a_time(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_text("\n".join('{"text": "x%d"}' % i for i in range(700)))
    assert service.ingest(spark, str(tmp_path / "d"), Store(spark, str(tmp_path / "s"), 2), model=Batches)["chunks_created"] == 700


def test_ingest_shuffles_texts_once_and_what_is_made_of_them_never(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    for name in "abc":
        (tmp_path / "d" / f"{name}.jsonl").write_text("\n".join(json.dumps({"text": f"{name} {i}", "document_title": name}) for i in range(9)))
    plans, write = {}, Store._write

    def watched(self, rows, path, by=None):
        plans[path.split("/")[-2]] = rows._jdf.queryExecution().executedPlan()
        write(self, rows, path, by)

    def exchanged(node):
        """Names of the columns that each exchange of a plan shuffles."""
        own = [[a.name() for a in _all(node.output())]] if node.nodeName() == "Exchange" else []
        return own + [x for c in _all(node.children()) for x in exchanged(c)]

    def _all(seq):
        return [seq.apply(i) for i in range(seq.size())]

    monkeypatch.setattr(Store, "_write", watched)
    service.ingest(spark, str(tmp_path / "d"), Store(spark, str(tmp_path / "s"), 2))
    columns = exchanged(plans["chunks"].initialPlan())
    assert not [c for c in columns if {"embedding", "lexemes"} & set(c)]
    assert len([c for c in columns if {"item", "content"} & set(c)]) == 1
    assert not [c for c in exchanged(plans["postings"].initialPlan()) if "places" in c]


def test_shuffles_of_a_run_do_not_stay(spark, store):
    def held():
        ids = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keysIterator()
        found = set()
        while ids.hasNext():
            found.add(ids.next())
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b.name() for b in (blocks.apply(i) for i in range(blocks.size())) if b.isShuffle()}

    before = held()
    store._put(spark.range(40).select(*[F.col("id").alias(f.name) if f.name in ("chunk_id", "document_id") else F.lit("x" if f.name in ("content", "filename") else None).cast(f.dataType).alias(f.name) if f.name != "chunk_index" else F.lit(0).alias(f.name) for f in CHUNK.fields]), "r")
    assert held() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
