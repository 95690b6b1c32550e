"""Queries that run the real path: files are made from documents, parsed and rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pdf, synthetic
from . import compress as api


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.pdf_per_row(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pdf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text shown by the pages of the rewritten files."""
    done = api.compress(_pdfs(spark, sf_dir)).select("doc_id", F.col("output").alias("content"))

    def shown(x):  # an operand is (text) or <hexadecimal digits>
        t = F.get(x["operands"], F.size(x["operands"]) - 1)
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        return F.when(F.startswith(t, F.lit("<")), inner).otherwise(F.hex(F.encode(inner, "ISO-8859-1")))

    files = pdf.per_document(done, {"content_ops": ["op", "operands"]})
    parts = F.transform(F.filter("content_ops", lambda x: x["op"] == "Tj"), shown)
    text = F.decode(F.unhex(F.array_join(parts, "")), "UTF-8")
    return files.select("doc_id", F.length(text).cast("long").alias("len"), F.md5(F.encode(text, "UTF-8")).alias("md5"))


def pdf_dedup_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct content streams of files with up to 50 documents each, after merging copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("part", F.expr("doc_id div 50"))
    files = synthetic.pdf_per_group(docs, "part")
    objects = pdf.table(files, "objects", ["obj", "ord", "kind", "stream_len", "raw", "filter", "decode_parms"])
    copies = api.duplicate_streams(objects)
    left = objects.where("kind = 'stream'").select("doc_id", "obj").join(copies, ["doc_id", "obj"], "left_anti")
    return left.groupBy(F.col("doc_id").alias("part")).agg(F.count("*").alias("streams"))


def pdf_strip_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files have an /Info reference before and after."""
    before = _pdfs(spark, sf_dir)
    done = api.compress(before).select("doc_id", F.col("output").alias("content"))
    has = F.exists("edges", lambda x: (x["src_obj"] == 0) & (F.get(x["path"], 0) == "/Info"))
    info = lambda df, name: pdf.per_document(df, {"edges": ["src_obj", "path"]}).select("doc_id", has.alias(name))
    return info(before, "had_info").join(info(done, "has_info"), "doc_id")


def pdf_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that a file's trailer doesn't reach, found where the file is read."""
    found = pdf.per_document(_pdfs(spark, sf_dir), {"unreferenced": ["obj"]}).where(F.size("unreferenced") > 0)
    return found.select("doc_id", F.size("unreferenced").cast("long").alias("n"), F.array_max(F.transform("unreferenced", lambda x: x["obj"])).alias("obj"))


def pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.report(api.compress(_pdfs(spark, sf_dir)))


def queries():
    return {f.__name__: f for f in (pdf_roundtrip, pdf_dedup_objects, pdf_strip_metadata, pdf_unreferenced, pass_report)}


def oracle_sql():
    return {
        "pdf_roundtrip": "SELECT doc_id, length(coalesce(text, '')) AS len, md5(coalesce(text, '')) AS md5 FROM documents",
        "pdf_dedup_objects": "SELECT doc_id // 50 AS part, count(DISTINCT text) AS streams FROM documents GROUP BY ALL",
        "pdf_strip_metadata": "SELECT doc_id, doc_id % 2 = 0 AS had_info, false AS has_info FROM documents",
        "pdf_unreferenced": "SELECT doc_id, 1 AS n, 6::INT AS obj FROM documents",
    }
