"""What rewriting costs: how rows are dealt to tasks, and what is done once."""

import numpy as np
from pyspark.sql import functions as F
from quirelight.cos import jpeg
from quirelight.cos.objects import parse
from quirelight.cos.passes import Options, compress
from quirelight.plans.rewrites import _for_lossy, _large, queries
from quirelight.sources.synthetic import made, one_page


def test_rows_of_one_small_file_go_to_all_cores(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/t")
    files = made(spark.read.parquet(f"{tmp_path}/t"), lambda k: one_page(b"%d" % k), "id")
    each = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 4000 and len(each) >= spark.sparkContext.defaultParallelism and max(each) < 4000 / 8


def test_a_jpeg_is_read_once(monkeypatch):
    seen, read = [], jpeg.read
    monkeypatch.setattr(jpeg, "read", lambda data: seen.append(data) or read(data))
    for key, times in ((0, 1), (2, 1), (3, 1), (4, 0), (5, 0)):  # JPEG of several qualities; raw pixels, which need no reading back
        seen.clear()
        assert compress(_for_lossy(key), Options(lossy=True))[1] == "ok" and len(seen) == times
    seen.clear()
    compress(_large(4), Options(lossy=True))  # encoded at full size, then scaled down
    assert not seen


def test_long_runs_of_empty_blocks():
    for w, h, filled in ((2400, 1800, []), (2400, 1800, [40, 40000, 66000]), (40, 40, [0, 24])):  # over 32,767 blocks end at once
        image = jpeg.Image(w, h, [jpeg.Component(1, 1, 1, 0)], {0: np.full(64, 3)}, [])
        flat = image.comps[0].blocks.reshape(-1, 64)
        flat[filled, 1:64:21] = [5, -300, 1]
        for progressive in (False, True):
            again = jpeg.read(jpeg.write(image, progressive))
            assert (again.comps[0].blocks == image.comps[0].blocks).all()


def test_names_are_kept_and_values_stay():
    assert parse(b"/Type")[0] is parse(b" %x\n/Type ")[0] and parse(b"/A#42")[0] == "/AB"
    value, end = parse(b"<</A 12 0 R/B[1 2 R +3 0 R 4-5 -.5 12x(a\\)b)<414>]/C null/D<</E true>>>>x")
    assert (end, value["/A"], value["/D"]) == (72, (12, 0), {"/E": True}) and "/C" not in value
    assert value["/B"] == [(1, 2), (3, 0), "4-5", "-.5", b"a)b", b"A@"] and parse(b"12 0 R", refs=False) == (12, 2)


def test_files_of_unused_names_are_read_once(spark):
    df = queries()["unused_names"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in df._jdf.queryExecution().toString()  # read before, into one table; four times otherwise
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
