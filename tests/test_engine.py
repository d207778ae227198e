"""Retrieval engine: functions and operators on small inputs."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from codexmill.config import Settings, load_settings
from codexmill.functions import embed, fulltext, references, text
from codexmill.operators import chunking, evaluation, history, inspection, retrieval, structure
from codexmill.plans import answer, report, service
from codexmill.schemas import CHUNK, DOCUMENT
from codexmill.sources import files, sinks
from codexmill.sources.sinks import Store


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nCHUNK_SIZE='900'\n\nbad line\nRETRIEVAL_MODE=semantic\n")
    s = load_settings({"RETRIEVAL_MODE": "hybrid"}, env)
    assert (s.chunk_size, s.retrieval_mode, s.chunk_overlap) == (900, "hybrid", 200)
    with pytest.raises(ValueError, match="CHUNK_SIZE must be an integer"):
        load_settings({"CHUNK_SIZE": "x"}, env)


def test_normalize(spark):
    assert one(spark, "﻿a  b\r\nc\x0cd e\n\n\n\nf \n g ", text.normalize_text) == "a b\nc\nd\n\ne\n\nf\ng"
    assert one(spark, "  x  ", text.strip) == "x"
    assert one(spark, "Щука № 5 — Ёж", text.slugify) == "schuka_5_ezh"
    assert one(spark, "«»", text.slugify) == "document"
    assert one(spark, "Трудовой Кодекс-РФ 1", text.identity) == "трудовойкодексрф1"
    assert one(spark, "a.b.html", text.stem_of) == "a.b" and one(spark, ".env", text.stem_of) == ".env"


@pytest.mark.parametrize(
    ("given", "own", "want"),
    [
        ("согласно статье 81 настоящего Кодекса", None, ["81"]),
        ("часть 5 статьи 80 и пункт 3 статьи 77", None, ["77", "80"]),
        ("статьями 10, 5.27 и 5.3", None, ["5.3", "5.27", "10"]),
        ("статьи 80-82 и статьи 5", "5", ["80", "82"]),
        ("статей 7", None, []),
        ("СТАТЬЯ 9", None, ["9"]),
        (None, None, []),
    ],
)
def test_references(spark, given, own, want):
    row = spark.createDataFrame([(given, own)], "t string, o string").select(references.referenced_articles(F.col("t"), F.col("o")).alias("r")).first()
    assert row["r"] == want


def test_questions(spark):
    assert one(spark, "часть 5, по ст. 10.1", references.question_article) == "10.1"
    assert one(spark, "мост 5", references.question_article) is None
    assert one(spark, "статьёй 7", references.question_article) is None
    assert one(spark, "трудовой договор", references.law_hint) == "gk_rf"
    assert one(spark, "грабёж", references.law_hint) == "uk_rf"
    assert one(spark, "погода", references.law_hint) is None
    assert one(spark, "Трудовой кодекс РФ", lambda c: references.matches_law_hint(c, "tk_rf"))
    for name, hit in (("tk-rf", True), ("tk rf", True), ("tkrf", False)):
        assert one(spark, name, lambda c: references.alias_like(c, F.array(F.lit("tk_rf")))) is hit


def plain_split_long(p, size):
    out, p = [], p.strip()
    while p:
        end = len(p)
        if end > size:
            w = p[:size]
            stop, gap = max(w.rfind(c) for c in ".!?;"), w.rfind(" ")
            end = stop + 1 if stop > size // 2 else gap if gap > size // 2 else size
        out, p = [*out, p[:end].strip()], p[end:]
    return [x for x in out if x]


def test_split_long_agrees_with_plain(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab .;!c") for _ in range(rng.randrange(90))), rng.choice([1, 2, 7, 20])) for _ in range(300)]
    for size in (1, 2, 7, 20):
        mine = [r for r in rows if r[1] == size]
        got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(mine)], "i int, x string").select("i", chunking.split_long(F.col("x"), size).alias("y")).collect()
        for g in got:
            assert g["y"] == plain_split_long(mine[g["i"]][0], size)


def test_split_text(spark):
    for size, over in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            chunking.split_text(F.lit("x"), size, over)
    body = "\n\n".join(f"paragraph {i} " + "x" * 30 for i in range(6))
    chunks = one(spark, body, lambda c: chunking.split_text(c, 100, 0))
    assert all(len(c) <= 100 for c in chunks) and "".join("".join(chunks).split()) == "".join(body.split())
    lapped = one(spark, body, lambda c: chunking.split_text(c, 100, 10))
    assert lapped[0] == chunks[0] and lapped[1].startswith(chunks[0][-10:].strip() + "\n\n")
    assert one(spark, None, lambda c: chunking.split_text(c, 100, 10)) == []
    assert one(spark, " \n ", lambda c: chunking.split_text(c, 100, 10)) == []


def test_split_legal(spark):
    law = "вступление\n\nСтатья 1. Предмет\nтекст один\f\nСтатья 2.1. Порядок и условия заключения договоров о предоставлении услуг и\nвыполнении работ\nтекст\n\nСтатья 3\nбез точки.\nещё"
    got = [(c["article_number"], c["article_title"]) for c in one(spark, law, chunking.split_legal)]
    assert got == [(None, None), ("1", "Предмет"), ("2.1", "Порядок и условия заключения договоров о предоставлении услуг и выполнении работ"), ("3", None)]
    assert all("\f" not in c["content"] for c in one(spark, law, chunking.split_legal))
    assert one(spark, "Статья 5. Х\n\nтело", chunking.split_legal)[0]["content"] == "Статья 5. Х\nтело"
    long = "Статья 7. Т\n" + "слово. " * 80
    parts = one(spark, long, lambda c: chunking.split_legal(c, 120))
    assert len(parts) > 3 and {(p["article_number"], p["article_title"]) for p in parts} == {("7", "Т")}
    assert [c["article_number"] for c in one(spark, "нет статей", chunking.split_legal)] == [None]
    assert one(spark, "", chunking.split_legal) == []


def test_structure_keeps_golden_shape(spark):
    lines = ["preamble", "Раздел I. A", "Глава 1. B", "Статья 1. T1", "body 1", "body 2 статьи 2", "Раздел II. C", "dropped line", "Статья 2", "b", "Глава 2. D", "Статья 3.1. X", "z"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, n int, line string")
    got = structure.extract_records(df).orderBy("n").collect()
    assert [(r["article_number"], r["section_title"], r["chapter_title"], r["referenced_articles"]) for r in got] == [("1", "Раздел I. A", "Глава 1. B", ["2"]), ("2", "Раздел II. C", None, []), ("3.1", "Раздел II. C", "Глава 2. D", [])]
    assert got[0]["text"] == "Статья 1. T1\n\nbody 1\nbody 2 статьи 2" and got[1]["article_title"] is None


def docx(path, paragraphs):
    sinks.write_docx(paragraphs, path)


def test_converters(spark, tmp_path):
    page = "<html><head><title>t</title><script>Статья 9</script><style>x</style></head><body><p>Раздел I. Общее</p><p>Глава 1. Начало</p><p>лишнее</p><p>Статья 1. Первая</p><p>см. статью 2 &amp; <b>далее</b></p><p>Статья 2</p></body></html>"
    (tmp_path / "Трудовой кодекс.html").write_text(page, encoding="utf-8")
    (tmp_path / "Прочее.htm").write_bytes("<p>Статья 3. Х</p>".encode("cp1251"))
    (tmp_path / "пусто.html").write_text("<p>ничего</p>", encoding="utf-8")
    rep = {r["source_filename"]: (r["status"], r["records"]) for r in service.convert(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert rep == {"Трудовой кодекс.html": ("ok", 2), "Прочее.htm": ("ok", 1), "пусто.html": ("failed", 0)}
    rows = [json.loads(x) for f in (tmp_path / "out").glob("*.jsonl") for x in f.read_text(encoding="utf-8").splitlines()]
    first = next(r for r in rows if r["article_number"] == "1")
    assert (first["document_id"], first["section_title"], first["chapter_title"], first["referenced_articles"], first["source_url"]) == ("tk_rf", "Раздел I. Общее", "Глава 1. Начало", ["2"], None)
    assert first["text"] == "Статья 1. Первая\n\nсм. статью 2 &\nдалее"
    docx(tmp_path / "Семейный кодекс.docx", ["Глава 1. Б", "Статья 4. Брак", "  текст  статьи 5 "])
    (tmp_path / "bad.docx").write_bytes(b"no")
    lines = files.read_docx(spark, str(tmp_path))
    recs = structure.to_records(lines.filter("line is not null"), "docx")
    r = recs.first()
    assert (r["document_id"], r["document_title"], r["chapter_title"], r["text"], r["referenced_articles"]) == ("sk_rf", "Семейный кодекс Российской Федерации", "Глава 1. Б", "Статья 4. Брак\n\nтекст статьи 5", ["5"])
    assert {x["source_filename"]: x["status"] for x in sinks.convert_report(lines, recs).collect()} == {"Семейный кодекс.docx": "ok", "bad.docx": "failed"}
    assert zipfile.is_zipfile(tmp_path / "Семейный кодекс.docx")


def test_html_native_and_parser_agree(spark):
    page = "<!-- x --><p>a&nbsp; b<br>c</p><script>if (1 < 2) {}</script><div>d &lt; e</div>"
    got = spark.createDataFrame([(page,), (None,)], "h string").select(files.html_lines_native(F.col("h")).alias("n"), files.html_lines_udf("h").alias("p")).collect()
    assert got[0]["n"] == got[0]["p"] == ["a b", "c", "d < e"] and got[1]["n"] == got[1]["p"] == []


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "b.txt").write_text("Статья 1. Труд\nработник и договор. см. статью 5\n\nСтатья 2. Отпуск\nотпуск работника", encoding="utf-8")
    lines = ['{"text": "брак супругов", "article_number": 10, "document_title": "Семейный кодекс", "referenced_articles": []}', "", "[1]", '{"text": " "}', "{oops", '{"text": "алименты детям", "article_title": "А", "filename": "f.html", "referenced_articles": ["3", " "]}']
    (d / "A.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (d / "empty.txt").write_text(" \n", encoding="utf-8")
    return d


def test_ingest_search_answer(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    stats = service.ingest(spark, str(folder), store)
    assert (stats["documents_created"], stats["chunks_created"], stats["processed"], stats["skipped"]) == (2, 4, ["A.jsonl", "b.txt"], ["empty.txt"])
    assert [i.split(" skipped, ")[0] for i in stats["issues"]] == ["A.jsonl: line 3", "A.jsonl: line 4", "A.jsonl: line 5"]
    docs = service.list_documents(store.documents(), store.chunks()).collect()
    assert {d["filename"]: (d["title"], d["chunks_count"]) for d in docs} == {"A.jsonl": ("Семейный кодекс", 2), "b.txt": ("b", 2)}
    ident = next(d["document_id"] for d in docs if d["filename"] == "A.jsonl")
    chunks = service.document_chunks(store.documents(), store.chunks(), ident).collect()
    assert [(c["chunk_index"], c["article_number"], c["referenced_articles"], c["source_filename"]) for c in chunks] == [(0, "10", [], None), (1, None, ["3"], "f.html")]
    with pytest.raises(LookupError):
        service.document_chunks(store.documents(), store.chunks(), 1)
    # a changed file replaces its version; files that are gone or now empty keep theirs
    (folder / "A.jsonl").write_text('{"text": "новый текст"}', encoding="utf-8")
    (folder / "b.txt").write_text("", encoding="utf-8")
    service.ingest(spark, str(folder), store)
    assert sorted(r["content"] for r in store.chunks().filter("filename = 'A.jsonl'").collect()) == ["новый текст"]
    assert store.chunks().filter("filename = 'b.txt'").count() == 2
    stops = service.stop_words(spark)
    table = service.corpus(store.documents(), store.chunks(), stops).cache()
    got = service.search(spark, table, ["отпуск работника", "ст. 1 про труд"], 2, "hybrid", stops=stops).collect()
    assert got[0]["article_number"] == "2" and got[0]["keyword_score"] > 0
    assert next(r for r in got if r["query_id"] == 1)["article_number"] == "1" and len(got[0]) == 24
    sem = service.search(spark, table, ["новый текст"], 1, "semantic", stops=stops).first()
    assert sem["content"] == "новый текст" and sem["hybrid_score"] == sem["similarity"] and sem["keyword_score"] == 0
    for bad in (lambda: service.search(spark, table, [" "], 2), lambda: service.search(spark, table, ["x"], 21), lambda: service.search(spark, table, ["x"], 2, "fuzzy")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(answer.LLMConfigurationError):
        service.answer(spark, table, "отпуск")
    seen = []
    out = service.answer(spark, table, "отпуск", 1, lambda s, u: seen.append((s, u)) or "ответ", "P", stops=stops)
    assert out["answer"] == "ответ" and "проекта P." in seen[0][0] and "[Источник 1]" in seen[0][1] and len(out["sources"][0]) == 12
    empty = service.corpus(store.documents().limit(0), store.chunks().limit(0), stops)
    assert service.search_one(spark, empty, "x")["note"] and service.health(spark)["engine"]
    none = tmp_path / "none"
    assert service.ingest(spark, str(none), store)["message"] == service.NO_FILES  # a missing folder
    none.mkdir()
    assert service.ingest(spark, str(none), store)["message"] == service.NO_FILES
    assert "lexemes" in store.chunks().columns and not list((tmp_path / "store").glob("_staging*"))


def test_json_scalars_read_as_their_text(spark):
    lines = [('{"text": true, "article_number": 80}',), ('{"text": "x", "article_number": 1.5, "section_title": false, "chapter_title": null, "article_title": " y "}',)]
    got = [r["item"] for r in files.parse_jsonl(spark.createDataFrame([("f", i, x) for i, (x,) in enumerate(lines)], "filename string, n long, line string")).orderBy("n").collect()]
    assert (got[0]["content"], got[0]["article_number"]) == ("True", "80")
    assert (got[1]["article_number"], got[1]["section_title"], got[1]["chapter_title"], got[1]["article_title"]) == ("1.5", "False", None, "y")


def test_hybrid_with_semantic_weight_alone_is_semantic(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], None, "n") for i in range(40)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, article_number string, names string").withColumn("lexemes", F.array().cast(fulltext.LEXEMES))
    q = table.filter("chunk_id in (0, 7)").select(F.col("chunk_id").alias("query_id"), "embedding", F.array().cast("array<string>").alias("terms"), "article_number", F.lit(None).cast("string").alias("law_hint"))
    hybrid = retrieval.hybrid(table, q, 5, (1.0, 0.0, 0.0)).select("query_id", "rank", "chunk_id")
    near = retrieval.nearest_batch(table, q, 5).select("query_id", "rank", "chunk_id")
    assert sorted(hybrid.collect()) == sorted(near.collect())
    single = [r["chunk_id"] for r in retrieval.nearest(table, rows[7][1], 5).collect()]
    assert single == [r["chunk_id"] for r in near.filter("query_id = 7").orderBy("rank").collect()]


def test_nearest_ties_nulls_and_zero(spark):
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, None)]
    t = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["chunk_id"] for r in retrieval.nearest_batch(t, q, 3).orderBy("rank").collect()] == [1, 3]
    assert retrieval.nearest_batch(t, q.limit(0), 3).count() == 0


def test_nearest_among_many_zero_vectors(spark):
    rows = [(i, [0.0, 0.0]) for i in range(100)] + [(200, [1.0, 1.0]), (201, [1.0, 0.0])]
    t = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["chunk_id"] for r in retrieval.nearest_batch(t, q, 5).orderBy("rank").collect()] == [201, 200]


def test_stemmer():
    for word, want in (("работника", "работник"), ("работников", "работник"), ("важнейшие", "важн"), ("договорам", "договор"), ("стала", "стал"), ("word", "word"), ("", "")):
        assert fulltext.stem(word) == want, word


def test_embedder():
    v = embed.embed_texts(["один два", "два один", "три"])
    assert v[0] == v[1] != v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-6
    assert embed.embed_texts([]) == []
    with pytest.raises(ValueError):
        embed.embed_texts(["a", " "])


CASE_COLUMNS = "id string, law string, question string, question_type string, case_type string, expected_behavior string, expected_document_id string, expected_document_title string, expected_article_numbers array<string>, expected_sources array<struct<document_id:string,article_number:string,relevance:string,reason:string>>"


def case(i, sources=None, numbers=None, doc=None, title=None, kind=None, law="L"):
    return (i, law, "q", None, kind, "no_answer" if kind else None, doc, title, numbers, sources)


def test_evaluation(spark):
    s = lambda d, a, r: (d, a, r, None)
    cases = spark.createDataFrame([case("a", [s("tk_rf", "81", "primary"), s("tk_rf", "77", "acceptable")]), case("b", numbers=["5"], title="Семейный кодекс Российской Федерации"), case("c", [s("tk_rf", "1", " Secondary ")]), case("o", kind="out_of_scope")], CASE_COLUMNS)
    res = [("a", 1, "77", "Трудовой кодекс РФ", .9), ("a", 2, "81", "x", .8), ("a", 3, "ст. 81", "trudovoy_kodeks_rf.jsonl", .7), ("b", 1, "5", "semeynyy_kodeks_rf", .6), ("c", 1, "1", "Уголовный кодекс Российской Федерации", .5), ("o", 1, "1", "x", .4)]
    results = spark.createDataFrame([(c, r, a, d, None, None, None, v) for c, r, a, d, v in res], "case_id string, rank int, article_number string, document_title string, filename string, source_filename string, document_id long, similarity double")
    judged = evaluation.judge(results, cases)
    assert {(r["case_id"], r["rank"]): r["relevance"] for r in judged.collect()} == {("a", 1): None, ("a", 2): None, ("a", 3): "primary", ("b", 1): "primary", ("c", 1): None, ("o", 1): None}
    m = {r["id"]: r for r in evaluation.case_metrics(judged, cases).collect()}
    assert (m["a"]["rank"], m["a"]["hit_top_1"], m["a"]["hit_top_3"]) == (3, False, True) and abs(m["a"]["reciprocal_rank"] - 1 / 3) < 1e-9
    assert (m["b"]["rank"], m["b"]["wrong_document_at_1"]) == (1, False) and (m["c"]["rank"], m["c"]["wrong_document_at_1"], m["c"]["reciprocal_rank"]) == (None, True, 0.0)
    assert m["o"]["rank"] is None and m["o"]["hit_top_1"] is None and m["o"]["not_evaluated"]
    shallow = evaluation.case_metrics(judged, cases, 3).filter("id = 'a'").first()
    assert shallow["hit_top_3"] is True and shallow["hit_top_5"] is None and shallow["document_hit_top_5"] is None
    with pytest.raises(ValueError):
        evaluation.case_metrics(judged, cases, 0)
    total = evaluation.summarize(evaluation.case_metrics(judged, cases)).filter("level = 'all'").first()
    assert (total["questions_count"], total["out_of_scope_count"], total["mean_rank"]) == (3, 1, 2.0) and abs(total["mrr"] - (1 / 3 + 1) / 3) < 1e-9


def test_best_and_worst_with_ties(spark):
    g = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.5), ("d", None)], "name string, top_5_accuracy double")
    assert sorted((r["kind"], r["name"]) for r in evaluation.extremes(g).collect()) == [("best", "a"), ("best", "b"), ("weakest", "c")]


def test_report(tmp_path):
    m = {"questions_count": 2, "mrr": 0.5, "mean_rank": None, "document_recall_at_5": 1.0, "wrong_document_at_1": 0.5, **{f"top_{d}_accuracy": 0.5 if d < 20 else None for d in (1, 3, 5, 10, 20)}}
    out = report.markdown(m, {"a|b": m}, {"t": m}, [{"id": "x", "hit_top_5": None}, {"id": "y", "hit_top_5": True}], {"top_k": 10})
    assert "| Recall@20 | не рассчитывалось |" in out and "a\\|b" in out and "| x |" in out and "| y |" not in out and "Wrong Document@1 = 50.0%" in out
    assert sinks.write_docx(out.splitlines(), tmp_path / "r.docx") and files.docx_paragraphs((tmp_path / "r.docx").read_bytes())[0].startswith("# Отчёт")
    sinks.write_json({"а": 1}, tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"а": 1}


def test_cases_file(spark, tmp_path):
    good = [{"id": "1", "question": "q", "expected_article_numbers": ["5"]}, {"id": "2", "question": "q", "case_type": "out_of_scope", "expected_behavior": "no_answer"}]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good))
    assert files.read_cases(spark, str(path)).count() == 2
    for extra in ({"id": "1", "question": "q", "expected_article_numbers": ["5"]}, {"id": "3", "question": " ", "expected_article_numbers": ["5"]}, {"id": "4", "question": "q"}, {"id": "5", "question": "q", "expected_sources": [{"document_id": "d", "article_number": "1", "relevance": "Primary"}]}, {"id": "6", "question": "q", "case_type": "out_of_scope"}):
        path.write_text(json.dumps([*good, extra]))
        with pytest.raises(ValueError):
            files.read_cases(spark, str(path))


def test_history(spark, tmp_path):
    rows = [(f"m{i}", "assistant" if i % 2 else "user", f"t{i}", "hybrid" if i % 4 == 1 else "odd", [{"filename": "f", "x": "y"}, {"x": "y"}], i) for i in range(120)] + [("bad", "system", "s", None, None, 500), ("none", "user", None, None, None, 501)]
    df = spark.createDataFrame(rows, "id string, role string, content string, retrievalMode string, sources array<map<string,string>>, at int")
    got = history.last_messages(history.normalize_messages(df), ["at"]).orderBy("n").collect()
    assert len(got) == 100 and got[0]["id"] == "m119" and got[-1]["id"] == "m20"
    assert got[0]["sources"] == [{"filename": "f"}] and got[1]["sources"] == [] and got[0]["retrievalMode"] is None
    assert one(spark, 0.5, history.format_number, "double") == "0.5" and one(spark, 2.0, history.format_number, "double") == "2"
    (tmp_path / "h.json").write_text("{corrupt")
    assert files.read_history(spark, str(tmp_path / "h.json")).count() == 0


def test_inspection(spark):
    rows = [(0, "1", "T", "Статья 2 по статье 7"), (1, None, None, "a\fb"), (2, "3", None, "Статья 3")]
    df = spark.createDataFrame(rows, "chunk_index int, article_number string, article_title string, content string")
    r = inspection.chunk_stats(df).first()
    assert (r["chunks"], r["with_article"], r["with_form_feed"], r["with_references"], r["suspicious"], r["median_length"]) == (3, 2, 1, 1, 1, 8.0)
    assert inspection.chunk_stats(df.limit(0)).first()["max_length"] == 0
    assert inspection.chunk_rows(df).orderBy("chunk_index").first()["referenced_articles"] == "2;7"


def test_prompt_without_context(spark):
    q = spark.createDataFrame([(0, "вопрос")], "query_id long, query string")
    chunks = spark.createDataFrame([], "query_id long, rank int, content string, article_number string, article_title string, document_title string, section_title string, subsection_title string, chapter_title string, paragraph_title string, referenced_articles array<string>")
    assert answer.prompts(chunks, q).first()["prompt"].endswith("Контекст:\n\n" + answer.NO_CONTEXT)


def test_stream(spark, tmp_path):
    from codexmill.streaming.ingest import stream_jsonl

    src = tmp_path / "s"
    src.mkdir()
    (src / "a.jsonl").write_text('{"text": "x"}\nbad\n')
    got = []
    q = stream_jsonl(spark, str(src), str(tmp_path / "ck"), lambda df, n: got.extend(r["class"] for r in df.collect()))
    q.awaitTermination(60)
    assert sorted(got) == ["invalid", "ok"]


def test_defaults():
    assert Settings().chunk_size == 1200 and len(retrieval.MODES) == 2


def test_command_line(spark, folder, tmp_path, capsys):
    from codexmill.__main__ import main

    store = str(tmp_path / "s")
    assert main(["ingest", store, "--folder", str(folder)]) == 0
    assert json.loads(capsys.readouterr().out)["documents_created"] == 2
    assert main(["search", store, "отпуск работника", "--top-k", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["article_number"] == "2"
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"id": "1", "law": "b", "question": "отпуск работника", "expected_sources": [{"document_id": "b", "article_number": "2", "relevance": "primary"}]}, {"id": "2", "question": "погода", "case_type": "out_of_scope", "expected_behavior": "no_answer"}], ensure_ascii=False), encoding="utf-8")
    assert main(["evaluate", store, str(cases), "--out", str(tmp_path / "r"), "--top-k", "5", "--mode", "hybrid"]) == 0
    assert json.loads(capsys.readouterr().out)["mrr"] == 1.0
    head, first, second = (tmp_path / "r" / "retrieval_report.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(head.split(",")) == 29 and "b — ст. 2 (primary)" in first and first.startswith("1,retrieval")
    data = json.loads((tmp_path / "r" / "retrieval_report.json").read_text(encoding="utf-8"))
    assert data["summary"]["out_of_scope_count"] == 1 and data["cases"][1]["rank"] is None and data["metrics_by_law"]["b"]["questions_count"] == 1
    assert "Recall@20 | не рассчитывалось" in (tmp_path / "r" / "retrieval_report.md").read_text(encoding="utf-8") and (tmp_path / "r" / "retrieval_report.docx").exists()
    assert main(["inspect", str(folder), str(tmp_path / "i")]) == 0
    assert (tmp_path / "i" / "b_chunks.csv").read_text(encoding="utf-8").startswith("chunk_index,")
    assert main(["convert-html", str(folder), str(tmp_path / "c")]) == 1
    capsys.readouterr()


def test_display_values(spark):
    rows = spark.createDataFrame([(None, "x.html", "trudovoy.html", "5", "T"), ("D", None, None, None, None), (None, "a", None, "", "T")], "t string, f string, s string, n string, a string")
    got = rows.select(history.source_title(F.col("t"), F.col("f"), F.col("s")).alias("d"), history.article_label(F.col("n"), F.col("a")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("Трудовой кодекс Российской Федерации", "Статья 5. T"), ("D", None), ("Нормативный документ", "T")]
