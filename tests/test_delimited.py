from gridloom.sources import delimited

COLUMNS = ["date", "x", "y"]


def test_files_by_lines_equal_whole_files(spark, tmp_path):
    """Odd files, in one task and in parts of 40 bytes: what reading each of them whole gives."""
    body = "".join(f"2024-01-{i:02d},{i},\n" for i in range(1, 29))
    odd = {
        "headed.csv": "date,x,y\n" + body, "bare.csv": body, "again.csv": "date,x,y\ndate,x,y\n2024-02-01,1,2\n", "other.csv": body, "empty.csv": "", "blank.csv": "\n2024-01-01,1,2\n",
        "wide.csv": "date,x,y,z\n2024-01-01,1,2\n", "ragged.csv": "2024-03-01,1\n", "mixed.csv": "2024-03-01,1,2\n2024-03-02,1\n\n2024-03-03,1,2,3\n2024-03-04,5,6", "dos.csv": "date,x,y\r\n2024-04-01,7,8\r\n",
        "quoted.csv": 'date,x,y\n2024-05-01,"a,b\n2024-05-02,c","d ""e"""\n' + body + "2024-05-03,ab\"c,1\n", "bytes.csv": b"2024-06-01,\xff\xe9t,1\n", "note.txt": body,
    }
    for name, text in odd.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    values = lambda df: sorted((r.path.rsplit("/", 1)[1], *[r[c] or "" for c in COLUMNS]) for r in df.collect())
    for size in ("128m", "40b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b" if size == "40b" else "4m")
        found = delimited.sniffed_files(spark, str(tmp_path), COLUMNS, "*.csv", exclude="OTHER")
        parts = found.rdd.getNumPartitions()
        want = values(delimited.sniffed(delimited.binary(spark, str(tmp_path), "*.csv", exclude="OTHER"), COLUMNS))
        assert values(found) == want and len(want) > 80
        assert size == "128m" or parts > 30
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
