"""Sinks: JSONL, CSV, JSON and DOCX reports; the store is in store.py."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store as Store


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark reaches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out, letters not escaped."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def convert_report(lines: DataFrame, records: DataFrame) -> DataFrame:
    """(source_filename, status, records): unreadable files and files without records fail."""
    files = lines.groupBy("source_filename").agg(F.count("line").alias("lines"))
    counts = records.groupBy("source_filename").agg(F.count(F.lit(1)).alias("records"))
    n = F.coalesce("records", F.lit(0))
    return files.join(counts, "source_filename", "left").select("source_filename", F.when(n > 0, "ok").otherwise("failed").alias("status"), n.alias("records"))


def write_csv(df: DataFrame, path: str | Path, bom: bool = False) -> None:
    """A small report as one CSV file, with a byte order mark where asked for."""
    import csv

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def write_json(value: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def write_docx(lines: list[str], path: str | Path) -> bool:
    """A report's lines as paragraphs of a minimal DOCX file."""
    import zipfile
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    parts = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return True


