"""Answer assembly: prompt, sources, and a language model given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed wording of the prompts; {project} is the caller's name for the service.
SYSTEM_PROMPT = """Ты юридический RAG-ассистент для проекта {project}.
Отвечай на русском языке только по предоставленному контексту из загруженных документов.
Не используй сведения вне контекста и не додумывай отсутствующие нормы.
Если в контексте нет ответа, скажи: "В загруженных документах недостаточно информации для ответа."
Не называй ответ юридической консультацией.
Формулируй ответ понятным языком.
Не перечисляй технические источники, названия файлов, chunk_index или служебные идентификаторы.
Источники будут показаны отдельно интерфейсом."""
RULES = (
    "Правила ответа:",
    "- Отвечай только по контексту ниже.",
    "- Не используй сведения вне контекста.",
    "- Если ответа нет в контексте, скажи, что в загруженных документах недостаточно информации.",
    "- Ответ должен быть на русском языке.",
    "- Не называй ответ юридической консультацией.",
    "- Не добавляй технический список источников в текст ответа.",
)
LABELS = (("Документ", "document_title"), ("Раздел", "section_title"), ("Подраздел", "subsection_title"), ("Глава", "chapter_title"), ("Параграф", "paragraph_title"))
NO_CONTEXT = "Контекст не найден."
SOURCE_COLUMNS = ("document_title", "filename", "article_number", "article_title", "section_title", "subsection_title", "chapter_title", "paragraph_title", "source_format", "source_filename", "chunk_index", "referenced_articles")

LLM = Callable[[str, str], str]


class LLMConfigurationError(RuntimeError):
    """No language model was given."""


def no_llm(system: str, user: str) -> str:
    raise LLMConfigurationError("no language model is configured")


def context_block(n: Column) -> Column:
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    refs = F.when(F.coalesce(F.size("referenced_articles"), F.lit(0)) > 0, F.array_join("referenced_articles", ", ")).otherwise("нет")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Источник "), n.cast("string"), F.lit("]")),
        *[F.concat(F.lit(f"{label}: "), filled(c)) for label, c in LABELS],
        F.concat(F.lit("Статья: "), F.coalesce(filled("article_number"), F.lit("не указана"))),
        F.concat(F.lit("Название статьи: "), F.coalesce(filled("article_title"), F.lit("не указано"))),
        F.concat(F.lit("Ссылки на статьи: "), refs),
        F.lit("Текст:"),
        F.coalesce("content", F.lit("")),
    )


def prompts(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt) of queries (query_id, query) and their ranked chunks (query_id, rank, ...)."""
    blocks = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", context_block(F.col("rank")).alias("b")))).alias("blocks"))
    context = F.coalesce(F.array_join(F.transform("blocks", lambda s: s["b"]), "\n\n---\n\n"), F.lit(NO_CONTEXT))
    parts = [*[F.lit(x) for x in RULES], F.lit(""), F.concat(F.lit("Вопрос: "), F.col("query")), F.lit(""), F.lit("Контекст:"), context]
    return queries.join(blocks, "query_id", "left").select("query_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def sources(chunks: DataFrame) -> DataFrame:
    """The shown fields of ranked chunks; missing references as an empty list."""
    names = [c for c in ("query_id", "rank") if c in chunks.columns]
    return chunks.select(*names, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "referenced_articles" else F.col(c) for c in SOURCE_COLUMNS])


def source_lists(chunks: DataFrame) -> DataFrame:
    """(query_id, sources): the shown fields of each query's ranked chunks, in order."""
    fields = [F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "referenced_articles" else F.col(c) for c in SOURCE_COLUMNS]
    listed = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("s"))))
    return chunks.groupBy("query_id").agg(F.transform(listed, lambda x: x["s"]).alias("sources"))


def generate(prompts: DataFrame, llm: Callable[[], LLM], project: str = "", tries: int = 3) -> DataFrame:
    """Add (answer, error, attempts) to rows (query_id, prompt, ...); the prompt itself goes.

    Calls run within tasks, one at a time in each; a row whose calls all raise keeps the last error.
    """
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    rest = [f for f in prompts.schema.fields if f.name not in ("query_id", "prompt")]
    schema = StructType([prompts.schema["query_id"], StructField("answer", StringType()), StructField("error", StringType()), StructField("attempts", IntegerType()), *rest])
    system = SYSTEM_PROMPT.replace("{project}", project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = llm()
        for b in batches:
            told: tuple[list, list, list] = ([], [], [])
            for prompt in b.column("prompt").to_pylist():
                answer = error = None
                for attempt in range(1, tries + 1):  # noqa: B007
                    try:
                        answer, error = model(system, prompt), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                for column, value in zip(told, (answer, error, attempt), strict=True):
                    column.append(value)
            made = [pa.array(c, t) for c, t in zip(told, (pa.string(), pa.string(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), *made, *(b.column(f.name) for f in rest)], schema.names)

    return prompts.mapInArrow(run, schema)
