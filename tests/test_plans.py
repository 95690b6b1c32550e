"""Tables, relations over them, and the interface."""

import pytest
from quirelight.cos.document import Document
from quirelight.cos.objects import Name, Ref
from quirelight.cos.passes import Options
from quirelight.plans import compress as api
from quirelight.sources import pdf
from quirelight.sources.synthetic import of_texts
from quirelight.streaming import compress_stream

from test_cos import image, one_page, with_images


@pytest.fixture(scope="module")
def pdfs(spark):
    rows = [
        (1, of_texts(["a b", "a b", "c"], True, False)),
        (2, with_images([image(200, 200, Name("/DeviceRGB"), bytes(i * i // 99 % 251 for i in range(120000)))])),
        (3, b"not a PDF"),
        (4, None),
        (5, one_page({Name("/Resources"): {Name("/ExtGState"): {Name("/G"): {}, Name("/H"): {}}}}, b"/G gs")),
    ]
    return spark.createDataFrame(rows, "doc_id long, content binary")


def test_tables(pdfs):
    counts = {t: pdf.table(pdfs, t).where("doc_id = 1").count() for t in pdf.TABLES}
    assert counts == {"objects": 11, "edges": 13, "pages": 3, "page_resources": 1 * 3 + 0, "images": 0, "pixels": 0, "glyphs": 0, "fonts": 1, "annots": 0, "content_ops": 12, "drawn": 0, "unreferenced": 1, "status": 1}
    got = {r["doc_id"]: r["status"] for r in pdf.table(pdfs, "status").collect()}
    assert got == {1: "ok", 2: "ok", 3: "not_pdf", 4: "not_pdf", 5: "ok"}


def test_several_tables_from_one_reading(pdfs):
    asked = {"objects": ["obj", "kind"], "content_ops": ["op"], "status": ["status"]}
    got = {r["doc_id"]: r for r in pdf.per_document(pdfs, asked).collect()}
    assert {k: r["status"][0]["status"] for k, r in got.items()} == {1: "ok", 2: "ok", 3: "not_pdf", 4: "not_pdf", 5: "ok"}
    for name, columns in asked.items():
        rows = sorted(tuple(r) for r in pdf.table(pdfs, name, columns).collect())
        assert rows == sorted((k, *x) for k, r in got.items() for x in r[name])
    assert pdf.per_document(pdfs.limit(0), asked).count() == 0


def test_relations(pdfs):
    objects, edges = pdf.table(pdfs, "objects"), pdf.table(pdfs, "edges")
    copies = api.duplicate_streams(objects)
    assert [(r["doc_id"], r["obj"], r["canon"]) for r in copies.collect()] == [(1, 7, 5)]
    moved = api.rewritten_edges(edges, copies)
    assert moved.where("doc_id = 1 AND dst_obj = 7").count() == 0 and moved.count() == edges.count()
    lost = api.unreferenced(objects, edges).where("doc_id = 1").collect()
    assert [r["obj"] for r in lost] == [10]
    unused = api.unused_resources(pdf.table(pdfs, "page_resources"), pdf.table(pdfs, "content_ops")).where("category = '/ExtGState'").collect()
    assert [(r["doc_id"], r["name"]) for r in unused] == [(5, "/H")]
    dpi = api.image_resolution(*(pdf.table(pdfs, t) for t in ("images", "page_resources", "drawn", "pages"))).collect()
    assert [(r["dpi"], r["new_w"], r["new_h"]) for r in dpi] == [(288.0, 50, 50)]


def test_compress_and_report(spark, pdfs, tmp_path):
    done = api.compress(pdfs, Options(lossy=True))
    got = {r["doc_id"]: r for r in done.collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "ok", 3: "not_pdf", 4: "empty", 5: "ok"}
    assert all((r["output"] is None) == (r["bytes_after"] is None) for r in got.values())
    assert Document.read(bytes(got[2]["output"])).pages()
    rows = {r["pass"]: r["documents"] for r in api.report(done).collect()}
    assert rows["strip_metadata"] == 1 and rows["dedup_streams"] == 1 and rows["downscale_images"] == 1
    api.write_files(done, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(of_texts(["x"], False, False))
    (tmp_path / "b.txt").write_bytes(b"no")
    files = pdf.read_pdfs(spark, str(tmp_path))
    assert files.count() == 1 and api.compress(files).first()["status"] == "ok"
    with pytest.raises(TypeError):
        pdf.from_table(spark.createDataFrame([(1, "x")], "doc_id long, content string"), "content")
    query = compress_stream.start(compress_stream.incoming(spark, str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_concurrency(spark):
    before = api.concurrency(spark)
    assert api.concurrency(spark, 3) == 3 and api.concurrency(spark, 0) == spark.sparkContext.defaultParallelism
    api.concurrency(spark, before)
    for bad in (-1, 1.5, "2", True):
        with pytest.raises(TypeError):
            api.concurrency(spark, bad)


def test_write_pdfs(spark, tmp_path):
    rows = [(1, "ok", b"%PDF one"), (2, "not_pdf", None), (None, "ok", b"%PDF two")]
    done = spark.createDataFrame(rows, "doc_id long, status string, output binary")
    for _ in range(2):  # a task that runs again
        got = {r["doc_id"]: (r["bytes"], r["error"]) for r in api.write_pdfs(done, f"{tmp_path}/out").collect()}
    assert got == {1: (8, None), 2: (0, "not_pdf"), None: (8, None)}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"1.pdf": b"%PDF one", "None.pdf": b"%PDF two"}
    (tmp_path / "file").write_text("x")
    assert [r["error"] is not None for r in api.write_pdfs(done.where("doc_id = 1"), f"{tmp_path}/file").collect()] == [True]
    with pytest.raises(ValueError):
        api.write_pdfs(done, "")


def test_paths_of_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        pdf.read_pdfs(spark, "")
    with pytest.raises(FileNotFoundError):
        pdf.read_pdfs(spark, f"{tmp_path}/nowhere")
