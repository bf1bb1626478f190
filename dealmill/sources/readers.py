"""Readers for archived vendor records: XML, JSON pages, filing indexes, submissions, raw archives."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = "cik string, company string, form string, filed string, path string"


def element_dict(element: ET.Element):
    """Nested dict of an element: @attributes, @text, children by local name, repeated children as a list."""
    out: dict = {}
    if element.attrib:
        out["@attributes"] = dict(element.attrib)
    for child in element:
        name, value = child.tag.rpartition("}")[2], element_dict(child)
        if name in out:
            out[name] = [*out[name], value] if isinstance(out[name], list) else [out[name], value]
        else:
            out[name] = value
    text = (element.text or "").strip()
    if text:
        if not out:
            return text
        out["@text"] = text
    return out


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_json_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Archived API pages, one JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_master_index(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-delimited filing index; heading lines, which have no numeric first field, are left out."""
    rows = spark.read.schema(INDEX_SCHEMA).option("sep", "|").option("mode", "PERMISSIVE").csv(path)
    return rows.where(F.col("cik").rlike(r"^\d+$") & F.col("path").isNotNull()).withColumn("filed", F.try_to_timestamp("filed", F.lit("yyyy-MM-dd")).cast("date"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def submission_documents(submissions: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each <DOCUMENT> block: key, position, type, filename, content."""
    block = F.regexp_extract_all(text, F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), 1)
    rows = submissions.select(key, F.posexplode(block).alias("position", "block"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"<{name}>([^\n<]*)", 1)), F.lit(""))
    body = F.regexp_extract("block", r"(?s)<TEXT>(.*?)(?:</TEXT>|$)", 1)
    return rows.select(key, "position", field("TYPE").alias("type"), field("FILENAME").alias("filename"), body.alias("content"))


def item_sections(filings: DataFrame, key: str, text: str) -> DataFrame:
    """Sections that open with "Item n.nn"; a filing without any is one section."""
    starts = F.split(F.col(text), r"(?im)(?=^\s*item\s+\d{1,2}\.\d{2}\b)")
    rows = filings.select(key, F.posexplode(F.filter(starts, lambda s: F.trim(s) != "")).alias("position", "content"))
    return rows.withColumn("item", F.nullif(F.regexp_extract("content", r"(?i)^\s*item\s+(\d{1,2}\.\d{2})", 1), F.lit("")))


def append_archive(responses: DataFrame, archive: str) -> None:
    """Appends raw responses (source, id, body, fetched_at) whose content the archive does not hold yet."""
    spark = responses.sparkSession
    rows = responses.withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256)).dropDuplicates(["source", "id", "sha256"])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(rows.schema).parquet(archive).select("source", "id", "sha256").distinct()
        rows = rows.join(known, ["source", "id", "sha256"], "left_anti")
    rows.write.mode("append").parquet(archive)


_CITED = re.compile(r"\bNCT\d{8}\b")


def trial_citations(documents: DataFrame, key: str, text: str, around: int = 240) -> DataFrame:
    """key, nct_id, start, excerpt: every cited trial with its place and what stands around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                (k, m[0], m.start(), t[max(0, m.start() - around) : m.end() + around])
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in _CITED.finditer(t or "")
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))], [key, "nct_id", "start", "excerpt"]
            )

    return documents.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, nct_id string, start long, excerpt string")
