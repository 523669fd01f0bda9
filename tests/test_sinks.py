import os

import pytest
from pyspark.sql import functions as F

from gridloom import streaming
from gridloom.operators.raster import image
from gridloom.plans import raster
from gridloom.sources import netpbm


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def pictures(spark, n, level=7):
    return spark.range(n).repartition(3).select(F.concat(F.lit("a/p"), F.col("id").cast("string")).alias("name"), F.lit(2).alias("w"), F.lit(1).alias("h"), F.array(F.lit(level), F.col("id").cast("int")).cast("array<smallint>").alias("v"))


@pytest.fixture
def save(spark, tmp_path):
    spark.dataSource.register(netpbm.Netpbm)
    return lambda rows, mode="append": rows.write.format("netpbm").mode(mode).save(str(tmp_path / "out"))


def test_all_files_or_none(spark, tmp_path, save):
    """A task that fails half-way leaves the files of the load before, and none of its own."""
    save(pictures(spark, 3))
    before = files(tmp_path / "out")
    assert before == ["a/p0.pgm", "a/p1.pgm", "a/p2.pgm"]
    broken = pictures(spark, 40).withColumn("name", F.when(F.col("name") == "a/p39", F.raise_error(F.lit("half-way"))).otherwise(F.concat(F.lit("b"), "name")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="half-way"):
            save(broken, mode)
        assert files(tmp_path / "out") == before
    with pytest.raises(Exception, match="leaves the folder"):
        save(pictures(spark, 1).withColumn("name", F.lit("../../x")))
    assert files(tmp_path / "out") == before


def test_overwrite_and_append(spark, tmp_path, save):
    save(pictures(spark, 3))
    save(pictures(spark, 2, 9), "overwrite")
    assert files(tmp_path / "out") == ["a/p0.pgm", "a/p1.pgm"]
    save(pictures(spark, 4, 5))
    rows = spark.read.format("netpbm").load(str(tmp_path / "out")).collect()
    assert sorted((os.path.basename(r.path), r.w, r.h, list(r.v)) for r in rows) == [(f"p{i}.pgm", 2, 1, [5, i]) for i in range(4)]


def test_colour_files(spark, tmp_path, save):
    row = ("c", 1, 2, [1, 2], [3, 4], [250, 255])
    save(spark.createDataFrame([row], "name string, w int, h int, r array<smallint>, g array<smallint>, b array<smallint>"))
    assert (tmp_path / "out" / "c.ppm").read_bytes() == b"P6\n1 2\n255\n" + bytes([1, 3, 250, 2, 4, 255])


def test_no_rows(spark, tmp_path, save):
    save(pictures(spark, 0))
    assert files(tmp_path / "out") == []


def test_every_result_of_a_group_is_a_file(spark):
    """The levels read from the files are those of the results."""
    from gridloom.plans import files as plans

    sf = "/root/testdata/sf0.001"
    want = raster.summary(raster.run_course(image.from_embeddings(spark, sf), "grp_c03"))
    key = lambda df: sorted(tuple(r) for r in df.select("op_name", "lo", "hi", "mean").collect())
    assert key(plans.QUERIES["snk_batch"](spark, sf)) == key(want)


def test_csv_files_with_one_header(spark, tmp_path):
    folder, mark, source = (str(tmp_path / n) for n in ("csv", "mark", "in"))
    for batch in ([(1, "a,b")], [(2, None), (3, 'q"')]):
        spark.createDataFrame(batch, "n long, s string").write.mode("append").parquet(source)
        for _ in range(2):
            streaming.append_csv(spark.readStream.schema("n long, s string").parquet(source), folder, mark)
    assert sorted(tuple(r) for r in spark.read.schema("n long, s string").csv(folder, escape="\\").collect()) == [(1, "a,b"), (2, None), (3, 'q"')]
    lines = [line for f in sorted(os.listdir(folder)) if f.endswith(".csv") for line in open(os.path.join(folder, f))]
    assert lines[0] == "n,s\n" and len(lines) == 4


def test_tasks_list_their_files_themselves(spark, tmp_path, save, monkeypatch):
    """A partition's description does not grow with the number of files; each file is read once, in folders too."""
    monkeypatch.setattr(netpbm, "FILES", 10)
    save(pictures(spark, 95))
    save(pictures(spark, 7).withColumn("name", F.concat(F.lit("b/"), "name")))
    reader = netpbm._Files({"path": str(tmp_path / "out")})
    parts = reader.partitions()
    assert len(parts) == 11 and all(len(str(p.value)) < len(str(tmp_path)) + 30 for p in parts)
    found = [os.path.relpath(r[0], tmp_path / "out") for p in parts for r in reader.read(p)]
    assert sorted(found) == files(tmp_path / "out") and len(found) == 102
