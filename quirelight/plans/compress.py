"""Documents in, smaller documents out; and the same analyses as relations over tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cos.passes import Options, compress as compress_one
from ..operators import relational as op
from ..sources import pdf


def compress(pdfs: DataFrame, options: Options = Options()) -> DataFrame:
    """pdfs: (doc_id, content). Returns doc_id, status, bytes_before, bytes_after, edits
    (map of pass to count), output.

    One narrow pass: a task takes documents a few at a time, and nothing is shuffled.
    Status: ok, repaired, encrypted, empty, not_pdf or failed; without an output but for
    the first two. A document never fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (b.slice(i, pdf.BATCH) for b in batches for i in range(0, b.num_rows, pdf.BATCH)):
            files = x.column(1).to_pylist()
            got = [compress_one(f or b"", options) for f in files]
            columns = [
                x.column(0),
                pa.array([s for _, s, _ in got], pa.string()),
                pa.array([len(f or b"") for f in files], pa.int64()),
                pa.array([None if out is None else len(out) for out, _, _ in got], pa.int64()),
                pa.array([list(e.items()) for _, _, e in got], pa.map_(pa.string(), pa.int32())),
                pa.array([out for out, _, _ in got], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "status", "bytes_before", "bytes_after", "edits", "output"])

    kind = pdfs.schema["doc_id"].dataType.simpleString()
    return pdfs.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, status string, bytes_before long, bytes_after long, edits map<string,int>, output binary")


def report(done: DataFrame) -> DataFrame:
    """Of a result of ``compress``: documents that each pass changed or failed on, and edits."""
    each = done.select("doc_id", F.explode("edits").alias("pass", "n"))
    return each.groupBy("pass").agg(
        F.count_if(F.col("n") > 0).alias("documents"), F.count_if(F.col("n") < 0).alias("failed"), F.sum(F.greatest("n", F.lit(0))).cast("long").alias("edits")
    )


def write_files(done: DataFrame, path: str) -> None:
    """Outputs as Parquet rows (doc_id, output); files of their own would be too many."""
    done.where("output IS NOT NULL").select("doc_id", "output").write.parquet(path)


def write_pdfs(done: DataFrame, path: str) -> DataFrame:
    """A file ``<doc_id>.pdf`` for each output, in a folder that all executors reach (a path, or
    a URI that Arrow knows). Returns doc_id, path, bytes, error (null if it was written; also
    said for documents without output). A file is written under another name first, so that a
    repeated task replaces it whole. Raises if the path is empty."""
    if not path:
        raise ValueError("a path is asked for")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for x in (b.slice(i, pdf.BATCH) for b in batches for i in range(0, b.num_rows, pdf.BATCH)):
            names, sizes, errors = [], [], []
            for doc_id, status, data in zip(*(x.column(i).to_pylist() for i in range(3))):
                name, error = f"{folder.rstrip('/')}/{doc_id}.pdf", None if data is not None else status
                if data is not None:
                    try:
                        files.create_dir(folder, recursive=True)
                        part = f"{name}.{uuid.uuid4().hex}.part"
                        with files.open_output_stream(part) as out:
                            out.write(data)
                        files.move(part, name)
                    except OSError as e:
                        error = str(e)
                names.append(None if error else name)
                sizes.append(0 if error else len(data))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["doc_id", "path", "bytes", "error"])

    kind = done.schema["doc_id"].dataType.simpleString()
    return done.select("doc_id", "status", "output").mapInArrow(run, f"doc_id {kind}, path string, bytes long, error string")


def concurrency(spark: SparkSession, n: int | None = None) -> int:
    """The number of partitions that shuffles use; sets it if given, 0 for all cores."""
    if n is not None:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise TypeError("concurrency is a whole number, 0 or more")
        spark.conf.set("spark.sql.shuffle.partitions", n or spark.sparkContext.defaultParallelism)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- relations over tables of all documents


def duplicate_streams(objects: DataFrame) -> DataFrame:
    """(doc_id, obj, canon): streams whose bytes, filter and parameters equal an earlier
    one's of their document. Only digests of payloads are shuffled, and their lengths."""
    streams = objects.where("kind = 'stream' AND stream_len > 0").select("doc_id", "obj", "ord", "stream_len", F.sha2("raw", 256).alias("digest"), "filter", "decode_parms")
    found = op.canonical(streams, ["digest", "stream_len", "filter", "decode_parms"], "ord", ["doc_id"])
    firsts = found.where("ord = canon").select("doc_id", F.col("ord").alias("canon"), F.col("obj").alias("to"))
    return found.where("ord <> canon").join(firsts, ["doc_id", "canon"]).select("doc_id", "obj", F.col("to").alias("canon"))


def rewritten_edges(edges: DataFrame, duplicates: DataFrame) -> DataFrame:
    """References at the first level of a dictionary point to canonical streams."""
    d = duplicates.select(F.col("doc_id").alias("_d"), F.col("obj").alias("_o"), "canon")
    joined = edges.join(d, (edges["doc_id"] == d["_d"]) & (edges["dst_obj"] == d["_o"]) & (edges["depth"] == 1), "left")
    return joined.withColumn("dst_obj", F.coalesce("canon", "dst_obj")).drop("_d", "_o", "canon")


def unreferenced(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, obj) that the trailer doesn't reach."""
    step = edges.select("doc_id", F.col("src_obj").alias("src"), F.col("dst_obj").alias("dst"))
    seeds = edges.where("src_obj = 0").select("doc_id", F.col("dst_obj").alias("node"))
    seen = op.closure(seeds, step, ["doc_id"])
    return objects.select("doc_id", "obj").join(seen.withColumnRenamed("node", "obj"), ["doc_id", "obj"], "left_anti")


def unused_resources(resources: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc_id, page_no, category, name) of resources that no operator of the page names."""
    last: Column = F.element_at("operands", -1)
    naming = ops.where(F.col("op").isin("Do", "gs", "sh", "cs", "CS", "scn", "SCN", "BDC") & (F.size("operands") > 0)).select("doc_id", "page_no", last.alias("name"))
    fonts = ops.where((F.col("op") == "Tf") & (F.size("operands") > 1)).select("doc_id", "page_no", F.element_at("operands", -2).alias("name"))
    return op.unused(resources.select("doc_id", "page_no", "category", "name"), naming.unionByName(fonts), ["doc_id", "page_no", "name"])


def image_resolution(images: DataFrame, resources: DataFrame, drawn: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, name, obj, dpi, new_w, new_h) for each use of an image."""
    from ..functions.images import target_size

    uses = resources.where("category = '/XObject'").select("doc_id", "page_no", "name", F.col("dst_obj").alias("obj")).join(images.select("doc_id", "obj", "width", "height"), ["doc_id", "obj"])
    box = pages.select("doc_id", "page_no", (F.get("media_box", 2) - F.get("media_box", 0)).alias("bw"), (F.get("media_box", 3) - F.get("media_box", 1)).alias("bh"))
    sized = uses.join(drawn.select("doc_id", "page_no", "name", F.col("width").alias("dw"), F.col("height").alias("dh")), ["doc_id", "page_no", "name"], "left").join(box, ["doc_id", "page_no"], "left")
    dpi, w, h = target_size(F.col("width"), F.col("height"), F.coalesce("dw", "bw"), F.coalesce("dh", "bh"))
    return sized.select("doc_id", "page_no", "name", "obj", dpi.alias("dpi"), w.alias("new_w"), h.alias("new_h"))
