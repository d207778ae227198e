"""Splitting and structure of long texts, files by document, saved history, the stream into the store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codexmill import flows
from codexmill.operators import chunking, history, structure
from codexmill.plans import service
from codexmill.sources import jsonl_files, sinks
from codexmill.sources.store import Store
from codexmill.streaming.history import save_history, saved_history
from codexmill.streaming.ingest import publish, stream_jsonl


def texts(seed, n=80):
    rng = random.Random(seed)
    parts = ["слово ", "a", ".", "; ", "! ", "\n", "\n\n", "\n\n\n", " ", "длинноеслово" * 4, " ", "\x0c", " ", "?", "Статья 2. Х\n", "Статья 3\n\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(n)] + [None, "", " ", "x" * 500]


@pytest.mark.parametrize(("size", "over"), [(40, 0), (40, 15), (7, 3), (1, 0)])
def test_jumps_equal_folds(spark, size, over):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(size))], "i int, t string")
    cols = {"text": (chunking.split_text, (size, over)), "long": (chunking.split_long, (size,))}
    parts = chunking.paragraphs(chunking.normalize_text(F.coalesce("t", F.lit(""))))
    got = df.select("i", *[f(F.col("t"), *a).alias(n) for n, (f, a) in cols.items()], chunking.pack(parts, size).alias("pack"), chunking.overlap(parts, over).alias("overlap"))
    want = df.select("i", chunking.split_text_fold(F.col("t"), size, over).alias("text"), chunking.split_long_fold(F.col("t"), size).alias("long"), chunking.pack_fold(parts, size).alias("pack"), chunking.overlap_fold(parts, over).alias("overlap"))
    assert got.orderBy("i").collect() == want.orderBy("i").collect()


def test_legal_rows_equal_folds(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(9))], "doc_id int, text string")
    got = chunking.legal_rows(df.withColumn("also", F.lit("x")), "text", 40)
    want = df.select("doc_id", F.posexplode(chunking.split_legal(F.col("text"), 40)).alias("k", "c")).select("doc_id", F.lit("x"), "k", "c.*")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_normalising_in_batches_equals_columns(spark):
    rng = random.Random(7)
    parts = ["a", "é", " ", "  ", "\n", "\r\n", "\r", "\t", "\f", "\x0b", "\x85", "\u2028", "\u2029", "\ufeff", "\u00a0", "\u3000", "\x1c"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, t string").select("i", chunking.normalize_text(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: chunking.normalized(t) for i, t in enumerate(some)}


@pytest.mark.parametrize("segment", [1, 2, 5, 7])
def test_records_in_segments_equal_records_of_whole_documents(spark, segment):
    rng = random.Random(segment)
    lines = ["Раздел I. A", "Подраздел 1. B", "Глава 1. C", "§ 1. D", "Статья 1. T", "статья 2", "текст", "см. статью 5", ""]
    rows = [(f"d{d}", n, rng.choice(lines)) for d in range(6) for n in range(rng.randrange(90))]
    df = spark.createDataFrame(rows, "doc string, n long, line string").repartition(5)
    assert sorted(structure.extract_records(df, segment=segment).collect(), key=str) == sorted(structure.extract_records(df, segment=10**9).collect(), key=str)


def test_a_giant_document_is_spread_over_tasks(spark):
    df = spark.range(60_000).select(F.lit("d").alias("doc"), F.col("id").alias("n"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("Глава "), "id")).when(F.col("id") % 10 == 1, F.concat(F.lit("Статья "), "id")).otherwise("x").alias("line"))
    out = structure.extract_records(df, segment=1000)
    assert out.count() == 6000
    assert out.filter(F.col("chapter_title") != F.concat(F.lit("Глава "), (F.floor(F.col("n") / 1000) * 1000).cast("string"))).isEmpty()


def test_one_file_a_document_and_clashes(spark, tmp_path):
    page = lambda n: f"<p>Статья {n}. Х</p><p>текст</p>"
    for name, body in {"Трудовой кодекс.html": page(1), "a trudov.html": page(2), "Прочее № 1.htm": page(3), "trudov пусто.html": "<p>нет</p>"}.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    out = tmp_path / "out"
    out.mkdir()
    (out / "other.jsonl").write_text("{}")
    rep = service.convert(spark, str(tmp_path), str(out)).collect()
    assert [(r["source_filename"], r["status"], r["records"], r["output_filename"]) for r in rep] == [
        ("a trudov.html", "overwritten", 1, "tk_rf.jsonl"), ("trudov пусто.html", "failed", 0, "tk_rf.jsonl"), ("Прочее № 1.htm", "ok", 1, "prochee_1.jsonl"), ("Трудовой кодекс.html", "ok", 1, "tk_rf.jsonl"),
    ]
    assert sorted(p.name for p in out.iterdir()) == ["other.jsonl", "prochee_1.jsonl", "tk_rf.jsonl"]
    (record,) = map(json.loads, (out / "tk_rf.jsonl").read_text(encoding="utf-8").splitlines())
    assert record["article_number"] == "1" and record["section_title"] is None and list(record)[0] == "document_id" and "n" not in record


def test_docx_names_and_order(spark, tmp_path):
    for name, law in {"Семейный кодекс.docx": 4, "Иной акт.docx": 7}.items():
        sinks.write_docx(["Глава 1", *[f"Статья {law}.{i}. Х" for i in range(1, 30)]], tmp_path / name)
    rep = {r["source_filename"]: r for r in service.convert(spark, str(tmp_path), str(tmp_path / "o"), "docx").collect()}
    assert rep["Семейный кодекс.docx"]["output_filename"] == "semeynyy_kodeks_rf.jsonl" and rep["Семейный кодекс.docx"]["recognised"]
    assert rep["Иной акт.docx"]["output_filename"] == "inoy_akt.jsonl" and not rep["Иной акт.docx"]["recognised"]
    numbers = [json.loads(x)["article_number"] for x in (tmp_path / "o" / "inoy_akt.jsonl").read_text(encoding="utf-8").splitlines()]
    assert numbers == [f"7.{i}" for i in range(1, 30)]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("a.jsonl", 1, "x"), (None, 2, "y")], "name string, n int, text string")
    with pytest.raises(Exception, match="name|None"):
        jsonl_files.write_files(rows, str(tmp_path / "o"), "name", ["n"])
    assert not (tmp_path / "o").exists() or list((tmp_path / "o").iterdir()) == []


def test_new_messages(spark):
    rows = spark.createDataFrame([("assistant", None, [{"filename": "f", "x": "y"}, {"x": "y"}], "hybrid"), ("robot", "hi", [{"filename": "f"}], "hybrid"), ("assistant", "a", None, "fuzzy")], "role string, content string, sources array<map<string,string>>, retrievalMode string")
    at = F.lit("2024-05-06 07:08:09.123").cast("timestamp_ntz")
    got = history.create_messages(rows, at, F.lit("i")).collect()
    assert [(r["role"], r["content"], r["sources"], r["retrievalMode"]) for r in got] == [("assistant", "", [{"filename": "f"}], "hybrid"), ("user", "hi", [], None), ("assistant", "a", [], None)]
    assert {r["createdAt"] for r in got} == {"2024-05-06T07:08:09.123Z"} and len({r["id"] for r in history.create_messages(rows, at).collect()}) == 3


def test_history_of_a_stream_equals_that_of_a_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["x", "y", None])) for c in range(5) for t in range(rng.randrange(30))] + [(None, 1, "user", "no key"), (1, None, "user", "no turn")]
    src = tmp_path / "src"
    for k in range(4):  # in any order, over several batches
        part = rows[k::4]
        spark.createDataFrame(part, "conv_id long, turn long, role string, content string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("conv_id long, turn long, role string, content string").option("maxFilesPerTrigger", 1).parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        save_history(stream, str(tmp_path / "out"), str(tmp_path / "ck"), limit=7).awaitTermination(120)
    got = sorted((r["conv_id"], r["turn"], r["role"], r["content"], r["n"]) for r in saved_history(spark, str(tmp_path / "out")).collect())
    batch = history.normalize_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string").filter("conv_id is not null and turn is not null"))
    assert got == sorted((r["conv_id"], r["turn"], r["role"], r["content"], r["n"]) for r in history.last_messages(batch, ["turn"], ["conv_id"], 7).collect())


def test_a_replayed_batch_of_the_ingest_stream_changes_nothing(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    store, batches = Store(spark, str(tmp_path / "s"), 2), []
    put = publish(store, "docs")

    def keep(batch, number):
        rows = batch.collect()
        batches.append((spark.createDataFrame(rows, batch.schema), number))
        put(batch, number)

    def run():
        stream_jsonl(spark, str(src), str(tmp_path / "ck"), keep).awaitTermination(120)

    (src / "a.jsonl").write_text('{"text": "one", "document_title": "T"}\nbad\n{"text": "two"}\n')
    run()
    (src / "b.jsonl").write_text('{"text": "three"}\n')
    run()
    shown = sorted((r["filename"], r["chunk_index"], r["content"]) for r in store.chunks().collect())
    assert shown == [("a.jsonl", 0, "one"), ("a.jsonl", 1, "two"), ("b.jsonl", 0, "three")]
    assert {r["filename"]: r["title"] for r in store.documents().collect()} == {"a.jsonl": "T", "b.jsonl": "b"}
    before = store.versions()
    for batch, number in batches:  # as a restart would repeat them
        put(batch, number)
    assert store.versions() == before and sorted((r["filename"], r["chunk_index"], r["content"]) for r in store.chunks().collect()) == shown


def test_cases_must_be_an_array(spark, tmp_path):
    from codexmill.sources.files import read_cases

    case = {"id": "1", "question": "q", "case_type": "out_of_scope", "expected_behavior": "no_answer"}
    for name, value in {"object.json": case, "text.json": "x", "array.json": [case]}.items():
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    assert read_cases(spark, str(tmp_path / "array.json")).count() == 1
    for name in ("object.json", "text.json"):
        with pytest.raises(ValueError, match="array"):
            read_cases(spark, str(tmp_path / name))


def test_numbered_lines_get_more_files_as_the_table_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "LINES_FILE", 2000, raising=False)
    spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    read, files_read = flows.files.read_lines, []

    def counted(spark, path, suffix):
        lines = read(spark, path, suffix)
        files_read.append(lines.select("path").distinct().count())
        return lines

    monkeypatch.setattr(flows.files, "read_lines", counted)
    rows = flows.jsonl_numbered(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(200)) and all(r["numbered"] for r in rows)
    assert files_read[0] >= 8


def test_files_are_written_some_at_a_time_and_not_kept(spark, tmp_path, monkeypatch):
    rows = [(i, f"слово {i}" if i % 3 else None, "a", "b", 1) for i in range(2600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(flows, "_scratch", lambda spark, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    whole = sorted(map(tuple, flows.ingested_files(spark, str(tmp_path)).collect()), key=str)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("files")] == []
    most, ingest = [], service.ingest
    monkeypatch.setattr(service, "ingest", lambda spark, folder, *a, **b: (most.append(len(list((tmp_path / folder).glob("*.jsonl")))), ingest(spark, folder, *a, **b)))
    monkeypatch.setattr(flows, "FILES_TEXT", 10_000)
    assert sorted(map(tuple, flows.ingested_files(spark, str(tmp_path)).collect()), key=str) == whole
    assert sum(most) == len(whole) == 6 and max(most) < 6


@pytest.mark.parametrize("times", [1, 2, 8])
def test_ranges_hold_every_row_once(spark, monkeypatch, times):
    monkeypatch.setattr(flows, "FILES_TEXT", 1)
    monkeypatch.setattr(flows, "FILES_TIMES", times)
    ids = [None, None, -7, 0, 9, 10, 11, 500, 10**6, *range(40, 60)]
    table = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    parts = [[r["doc_id"] for r in table.filter(some).collect()] for some in flows._ranges(table, 10)]
    assert sorted(map(str, sum(parts, []))) == sorted(map(str, ids)) and 1 <= len(parts) <= times
    groups = [{i // 10 for i in part if i is not None} for part in parts]
    assert sum(map(len, groups)) == len(set().union(*groups))
    assert all(len(list(flows._ranges(table.filter("doc_id is null" if n else "false"), 10))) == 1 for n in (0, 1))
