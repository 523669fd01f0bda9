"""Sources, sinks, tables and streams, on scratch copies of the driver's tables."""

from __future__ import annotations

import io
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import streaming
from gridloom.operators import loads
from gridloom.operators.raster import image
from gridloom.operators.sales import sales
from gridloom.operators.series import measurements
from gridloom.plans import series as series_plans
from gridloom.plans import sqltext as q
from gridloom.plans import warehouse as w
from gridloom.sources import database, delimited, netpbm, probe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; for local sessions without one, a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{base.rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"


M_SQL = lambda s: f"WITH {series_plans.M} {s}"
S_SQL = lambda s: f"WITH {w.SALES} {s}"
MEASURES = "event_id, download, upload, total"

# --- delimited files ------------------------------------------------------------------------------------------------


@query("src_csv", M_SQL(f"SELECT {MEASURES} FROM m"))
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    measurements(spark, d).select(*MEASURES.split(", ")).write.option("header", "true").csv(path)
    return delimited.contract(spark, path, "event_id long, download double, upload double, total double")


QUERIES["snk_csv"], ORACLES["snk_csv"] = src_csv, ORACLES["src_csv"]


def measurement_files(spark: SparkSession, d: str, count: int, header: bool, name: str) -> str:
    """Files of measurements under the ten columns of the contract, every value as text."""
    path = scratch(spark, name)
    m = streaming.enrich(measurements(spark, d), "download", "upload")
    rows = m.selectExpr("day", "time", "weekday", "part", "status", "'1'", "cast(download as string)", "cast(upload as string)", "cast(total as string)", "session_id").toDF(*delimited.MEASUREMENT)
    rows.coalesce(count).write.option("header", str(header).lower()).csv(path)
    return path


CLEAN = M_SQL("SELECT session_id, count(*) AS n, round(sum(total), 4) AS total FROM m GROUP BY session_id")
NUMBERS = ["duree_minutes", "download_Mo", "upload_Mo", "total_Mo"]
summed = lambda rows: delimited.cleaned(rows.drop("path"), NUMBERS).groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.sum("total_Mo"), 4).alias("total"))


@query("src_csv_headerless", CLEAN)
def src_csv_headerless(spark: SparkSession, d: str) -> DataFrame:
    path = measurement_files(spark, d, 2, False, "bare")
    return summed(delimited.sniffed_files(spark, path, delimited.MEASUREMENT, "*.csv"))


@query("src_glob", CLEAN)
def src_glob(spark: SparkSession, d: str) -> DataFrame:
    path = measurement_files(spark, d, 1, True, "glob")
    return summed(delimited.sniffed_files(spark, path, delimited.MEASUREMENT, "*.csv", exclude="other"))


@query("flt_colcount", M_SQL("SELECT 10::INTEGER AS columns, count(*) AS n FROM m"))
def flt_colcount(spark: SparkSession, d: str) -> DataFrame:
    """Files of ten columns stay, one of three goes."""
    path = measurement_files(spark, d, 1, True, "width")
    measurements(spark, d).select("event_id", "ts", "total").limit(5).write.mode("append").option("header", "true").csv(path)
    rows = delimited.sniffed_files(spark, path, delimited.MEASUREMENT, "*.csv")
    return rows.agg(F.lit(len(delimited.MEASUREMENT)).alias("columns"), F.count("*").alias("n"))


REGIONS = "SELECT r_name AS code, r_regionkey::DOUBLE * 1.5 AS value FROM region"


def preamble_text(spark: SparkSession, d: str) -> str:
    rows = spark.read.parquet(f"{d}/region.parquet").orderBy("r_regionkey").collect()  # five rows
    return "\n".join(["Data Source,x", "", "Last Updated,y", "", "Indicator Code,2022,2023", *[f"{r['r_name']},0,{r['r_regionkey'] * 1.5}" for r in rows]])


def as_files(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame(files, "path string, content binary")


read_2023 = lambda files: delimited.after_preamble(files, ["Indicator Code", "2023"]).select(F.col("Indicator Code").alias("code"), F.expr("try_cast(`2023` as double)").alias("value"))
query("src_csv_skip", REGIONS)(lambda spark, d: read_2023(as_files(spark, [("API_X.csv", preamble_text(spark, d).encode())])))


@query("src_archive", REGIONS)
def src_archive(spark: SparkSession, d: str) -> DataFrame:
    """The same file from a zip and a tar.gz beside a broken archive."""
    data, z, t = preamble_text(spark, d).encode(), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as a:
        a.writestr("API_A.csv", data)
    with tarfile.open(fileobj=t, mode="w:gz") as a:
        info = tarfile.TarInfo("API_B.csv")
        info.size = len(data)
        a.addfile(info, io.BytesIO(data))
    files = delimited.archived(as_files(spark, [("a.zip", z.getvalue()), ("b.tar.gz", t.getvalue()), ("c.zip", b"broken")]))
    return read_2023(files).distinct()


@query("src_mnist", "SELECT vec_id, label, 64::INTEGER AS pixels FROM embeddings")
def src_mnist(spark: SparkSession, d: str) -> DataFrame:
    """A wide file of a label and 64 pixels, read back into an array."""
    path = scratch(spark, "wide")
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    rows.select("vec_id", "label", *[F.col("embedding")[i].alias(f"p{i}") for i in range(64)]).write.option("header", "true").csv(path)
    wide = delimited.contract(spark, path, "vec_id long, label int, " + ", ".join(f"p{i} double" for i in range(64)))
    return wide.select("vec_id", "label", F.size(F.array(*[f"p{i}" for i in range(64)])).alias("pixels"))


JDBC_QUERY = "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"


def database_of(spark: SparkSession) -> str:
    """The JDBC address that the session names; a local session has Derby, which comes with Spark, in its own memory."""
    url = spark.sparkContext.getConf().get("spark.gridloom.jdbc.url")
    if not url and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.gridloom.jdbc.url to a database that the driver and all executors reach")
    return url or f"jdbc:derby:memory:gridloom{uuid.uuid4().hex[:8]};create=true"


@query("src_jdbc_query", JDBC_QUERY)
def src_jdbc_query(spark: SparkSession, d: str) -> DataFrame:
    """Tables appended to a database, and a query that the database answers."""
    url, mark = database_of(spark), uuid.uuid4().hex[:8]
    for t in ("region", "nation"):
        database.append(spark.read.parquet(f"{d}/{t}.parquet"), url, f"gl_{t}_{mark}", createTableColumnTypes=f"{t[0]}_name VARCHAR(64)")
    text = f"SELECT \"r_name\", count(*) AS \"n\" FROM gl_region_{mark} JOIN gl_nation_{mark} ON \"n_regionkey\" = \"r_regionkey\" GROUP BY \"r_name\""
    return database.read(spark, url, text).select("r_name", F.col("n").cast("long").alias("n"))


@query("src_jdbc_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def src_jdbc_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders written to a database in batches and scanned by ranges of their key; the filter goes to the database."""
    url, table = database_of(spark), f"gl_orders_{uuid.uuid4().hex[:8]}"
    database.append(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority"), url, table, createTableColumnTypes="o_orderpriority VARCHAR(32)")
    rows = database.read(spark, url, f'SELECT * FROM {table}', '"o_orderkey"', rows=5_000)
    return rows.where("o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey")


query("src_max_id", "SELECT coalesce(max(o_orderkey), 0) AS max_id, 0::BIGINT AS empty_id FROM orders")(
    lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("max_id"), F.coalesce(F.max(F.when(F.lit(False), F.col("o_orderkey"))), F.lit(0)).alias("empty_id"))
)
query("src_lookup", S_SQL("SELECT region_id, region, count(*) AS n FROM sales JOIN (SELECT row_number() OVER (ORDER BY region)::INTEGER AS region_id, region FROM (SELECT DISTINCT region FROM sales)) USING (region) GROUP BY ALL"))(
    lambda spark, d: sales(spark, d, "region").join(w.QUERIES["dim_region"](spark, d), "region").groupBy("region_id", "region").agg(F.count("*").alias("n"))
)
@query("src_probe", "SELECT event_id, event_type <> 'error' AS connected FROM events")
def src_probe(spark: SparkSession, d: str) -> DataFrame:
    """Connections tried for the address of each event: the driver's own port, which listens, or for errors port 1 of the
    same host, which nothing serves."""
    conf = spark.sparkContext.getConf()
    port = F.when(F.col("event_type") != "error", F.lit(int(conf.get("spark.driver.port")))).otherwise(F.when(F.col("event_type") == "error", F.lit(1)))
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.lit(conf.get("spark.driver.host")).alias("host"), port.alias("port"))
    return probe.probe(events).select("event_id", "connected")

# --- rasters --------------------------------------------------------------------------------------------------------


def picture_files(spark: SparkSession, d: str, colour: bool) -> DataFrame:
    """(path, content) of the images as encoded files, made where the rows are."""
    import pandas as pd

    rows = image.colour_from_embeddings(spark, d) if colour else image.from_embeddings(spark, d)
    planes = list("rgb") if colour else ["v"]

    def write(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["image_id"].astype(str), "content": [netpbm.encode(r.w, r.h, [getattr(r, p) for p in planes]) for r in b.itertuples()]})

    return rows.mapInPandas(write, "path string, content binary")


back = lambda rows: image.listed(rows.withColumn("image_id", F.col("path").cast("long")))
query("src_pgm", q.listed("v"))(lambda spark, d: back(netpbm.images(picture_files(spark, d, False))))
RGB = "rgb AS (SELECT id // 3 AS id, x, y, max(v) FILTER (id % 3 = 0) AS r, max(v) FILTER (id % 3 = 1) AS g, max(v) FILTER (id % 3 = 2) AS b FROM px GROUP BY ALL HAVING count(*) = 3)"
query("src_ppm", q.listed("b", "rgb", RGB))(lambda spark, d: back(netpbm.images(picture_files(spark, d, True), "colour").withColumn("v", F.col("b"))))
query("src_image_any", q.listed(q.store("0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"), "rgb", RGB))(lambda spark, d: back(netpbm.images(picture_files(spark, d, True), "grey")))
query("src_detect", "SELECT 'pgm' AS kind, count(*) AS n FROM embeddings UNION ALL SELECT 'unknown', 1")(
    lambda spark, d: picture_files(spark, d, False).select("content").union(spark.createDataFrame([(b"GIF8",)], "content binary"))
    .select(F.when(F.substring("content", 1, 2) == F.lit(b"P5"), "pgm").when(F.substring("content", 1, 2) == F.lit(b"P6"), "ppm").otherwise("unknown").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
)


def written(spark: SparkSession, rows: DataFrame, colour: bool = False) -> DataFrame:
    """Rows (name, w, h, planes) written as files by format("netpbm") and read again, with the name of each file; in a folder
    that this session's processes share."""
    spark.dataSource.register(netpbm.Netpbm)
    path = scratch(spark, "netpbm").removeprefix("file://").removeprefix("file:")
    rows.write.format("netpbm").option("mode", "colour" if colour else "grey").mode("append").save(path)
    found = spark.read.format("netpbm").option("mode", "colour" if colour else "grey").load(path)
    return found.withColumn("name", F.regexp_extract("path", r"([^/]*)\.p[gp]m$", 1))


@query("snk_pgm", q.listed("v"))
def snk_pgm(spark: SparkSession, d: str) -> DataFrame:
    rows = written(spark, image.from_embeddings(spark, d).select(F.col("image_id").cast("string").alias("name"), "w", "h", "v"))
    return image.listed(rows.withColumn("image_id", F.col("name").cast("long")))


@query("snk_ppm", q.listed("b", "rgb", RGB))
def snk_ppm(spark: SparkSession, d: str) -> DataFrame:
    rows = written(spark, image.colour_from_embeddings(spark, d).select(F.col("image_id").cast("string").alias("name"), "w", "h", "r", "g", "b"), True)
    return image.listed(rows.withColumn("image_id", F.col("name").cast("long")).withColumn("v", F.col("b")))


@query("snk_batch")
def snk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every result of a group of presets in a file of its own, result/result_image.pgm, all from one pass; levels are those
    of the files."""
    from gridloom.plans import raster

    found = raster.run_course(image.from_embeddings(spark, d), "grp_c03")
    name = F.concat("op_name", F.lit("/"), "op_name", F.lit("_"), F.col("image_id").cast("string"))
    rows = written(spark, found.select(name.alias("name"), "w", "h", "v"))
    return raster.summary(rows.withColumn("op_name", F.regexp_extract("name", r"^(.*)_\d+$", 1)))


# --- tables ---------------------------------------------------------------------------------------------------------


def stored(spark: SparkSession, name: str, schema: str) -> str:
    """A new empty table in its own folder, under a name of its own."""
    table = f"gl_{name}_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet LOCATION '{scratch(spark, name)}'")
    return table


@query("ddl_create", "SELECT unnest(['region_id', 'region']) AS col_name, unnest(['int', 'string']) AS data_type")
def ddl_create(spark: SparkSession, d: str) -> DataFrame:
    del d
    table = stored(spark, "ddl", "region_id INT, region STRING")
    return spark.sql(f"DESCRIBE TABLE {table}").select("col_name", "data_type")


REGION_ROWS = S_SQL("SELECT DISTINCT region FROM sales")


@query("dml_insert_select", REGION_ROWS)
def dml_insert_select(spark: SparkSession, d: str) -> DataFrame:
    table = stored(spark, "insert", "region STRING")
    sales(spark, d, "region").createOrReplaceTempView("gl_dml_sales")
    spark.sql(f"INSERT INTO {table} SELECT DISTINCT region FROM gl_dml_sales")
    return spark.table(table)


def rerun(spark: SparkSession, d: str) -> DataFrame:
    """Loaded twice by overwriting: a second run leaves the same rows, where appending would double them."""
    table = stored(spark, "rerun", "region STRING")
    for _ in range(2):
        sales(spark, d, "region").distinct().write.insertInto(table, overwrite=True)
    return spark.table(table)


query("dml_truncate", REGION_ROWS)(rerun)


def store_of(spark: SparkSession, name: str, schema: str) -> loads.Store:
    return loads.Store(spark, f"gl_{name}_{uuid.uuid4().hex[:8]}", schema, scratch(spark, name))


@query("dml_append_rerun", "SELECT o_orderkey AS ticket, any_value(o_custkey) AS client FROM orders GROUP BY o_orderkey")
def dml_append_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of orders, of which the second is loaded twice: a batch that is run again doubles nothing."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ticket"), F.col("o_custkey").alias("client"))
    store = store_of(spark, "rerun", "ticket BIGINT, client BIGINT")
    for batch in (0, 1, 1, 2):
        store.append(orders.where(F.pmod("ticket", F.lit(3)) == batch), ["ticket"], loads.unique("ticket"))
    return store.rows()


@query("txn", REGION_ROWS)
def txn(spark: SparkSession, d: str) -> DataFrame:
    """Loads that fail, half-way in a task or by a check, leave the rows of the load before."""
    store, regions = store_of(spark, "txn", "region STRING"), sales(spark, d, "region").distinct()
    store.replace(regions, loads.unique("region"), loads.not_null("region"))
    fails = regions.withColumn("region", F.when(F.col("region") > "B", F.raise_error(F.lit("half-way"))).otherwise(F.col("region")))
    for rows in (fails, regions.union(regions), regions.union(spark.createDataFrame([(None,)], "region string"))):
        try:
            store.replace(rows, loads.unique("region"), loads.not_null("region"))
        except Exception:  # noqa: S110  each of them must fail
            continue
        raise AssertionError("a load that fails was taken")
    return store.rows()


@query("key_incremental", "SELECT CAST(row_number() OVER (ORDER BY batch, o_clerk NULLS FIRST) AS BIGINT) AS clerk_id, o_clerk AS clerk FROM (SELECT o_clerk, min(o_orderkey % 3) AS batch FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority || o_custkey END AS o_clerk FROM orders) GROUP BY o_clerk)")
def key_incremental(spark: SparkSession, d: str) -> DataFrame:
    """A stored map of labels to keys, extended by three batches, the second of them twice: old labels keep their keys, new
    ones are numbered after the largest."""
    label = F.when(F.col("o_orderkey") % 7 != 0, F.concat("o_orderpriority", F.col("o_custkey").cast("string")))
    orders, store = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", label.alias("clerk")), store_of(spark, "keys", "clerk_id BIGINT, clerk STRING")
    for batch in (0, 1, 1, 2):
        store.replace(loads.extended(store.rows(), orders.where(F.col("o_orderkey") % 3 == batch), "clerk", "clerk_id"), loads.unique("clerk_id"), loads.unique("clerk"))
    return store.rows()


@query("snk_sql_append", S_SQL("SELECT region, 2::BIGINT AS n FROM (SELECT DISTINCT region FROM sales)"))
def snk_sql_append(spark: SparkSession, d: str) -> DataFrame:
    table = stored(spark, "append", "region STRING")
    for _ in range(2):
        sales(spark, d, "region").distinct().write.insertInto(table)
    return spark.table(table).groupBy("region").agg(F.count("*").alias("n"))


@query("snk_model")
def snk_model(spark: SparkSession, d: str) -> DataFrame:
    """Pair models stored as rows and read again."""
    from gridloom.plans.models import pair_models

    path = scratch(spark, "model")
    pair_models(spark, d, [0, 1, 2]).write.parquet(path)
    return spark.read.parquet(path).select("c1", "c2", F.size("coef").alias("support_vectors"))


QUERIES["snk_plot"], ORACLES["snk_plot"] = w.QUERIES["dash_comm_channel"], w.ORACLES["dash_comm_channel"]


@query("snk_copy", "SELECT vec_id AS image_id, 64::BIGINT AS bytes FROM embeddings")
def snk_copy(spark: SparkSession, d: str) -> DataFrame:
    """Encoded images stored as they are; the bytes after the header."""
    path = scratch(spark, "copy")
    picture_files(spark, d, False).write.parquet(path)
    return spark.read.parquet(path).select(F.col("path").cast("long").alias("image_id"), (F.length("content") - len(b"P5\n8 8\n255\n")).cast("long").alias("bytes"))


# --- streams --------------------------------------------------------------------------------------------------------


def recorded(spark: SparkSession, d: str, rows: Callable[[DataFrame], DataFrame] = lambda m: m) -> str:
    """Four files of measurements in the order of time, as a collector leaves them."""
    path = scratch(spark, "recorded")
    rows(measurements(spark, d)).repartitionByRange(4, "ts").write.parquet(path)
    return path


@query("st_enrich", M_SQL(f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS time, {series_plans.DAY_LIST}[isodow(ts)] AS weekday, {series_plans.P7} AS part, status, round(download + upload, 4) AS total, session_id FROM m"))
def st_enrich(spark: SparkSession, d: str) -> DataFrame:
    sink, mark = scratch(spark, "sink"), scratch(spark, "mark")
    streaming.drain(streaming.enrich(streaming.replay(spark, recorded(spark, d))), sink, mark)
    return spark.read.parquet(sink)


@query("st_append_sink", "SELECT event_id FROM events")
def st_append_sink(spark: SparkSession, d: str) -> DataFrame:
    """Started twice over the same files and checkpoint: every row arrives once."""
    path, sink, mark = recorded(spark, d), scratch(spark, "sink"), scratch(spark, "mark")
    for _ in range(2):
        streaming.drain(streaming.replay(spark, path).select("event_id"), sink, mark)
    return spark.read.parquet(sink)


@query("snk_csv_append", M_SQL(f"SELECT {MEASURES} FROM m"))
def snk_csv_append(spark: SparkSession, d: str) -> DataFrame:
    """Started twice over the same files and checkpoint: one header, every row once."""
    path, sink, mark = recorded(spark, d), scratch(spark, "csv"), scratch(spark, "mark")
    for _ in range(2):
        streaming.append_csv(streaming.replay(spark, path).select(*MEASURES.split(", ")), sink, mark)
    return spark.read.schema("event_id long, download double, upload double, total double").csv(sink)


@query("st_poll", "SELECT count(*) AS n FROM events")
def st_poll(spark: SparkSession, d: str) -> DataFrame:
    """Batch by batch, a file at each trigger; in production the trigger is processingTime='60 seconds'."""
    sink, mark = scratch(spark, "sink"), scratch(spark, "mark")
    streaming.drain(streaming.replay(spark, recorded(spark, d), 1), sink, mark)
    return spark.read.parquet(sink).agg(F.count("*").alias("n"))


BINS = "SELECT time_bucket(INTERVAL {0} MINUTES, ts, TIMESTAMP '1970-01-01') AS start, round(sum(total), 4) AS sum FROM m{1} GROUP BY 1"
MOVED = "event_id % 10 = 0 AND ts < start + (stop - start) / 4 - INTERVAL 1 DAY"  # the rows of a collector that was cut off


def arrivals(spark: SparkSession, d: str, moved: str, parts: int) -> Iterator[DataFrame]:
    """Measurements as they arrive: so many parts in the order of time, the last with those that are moved and with a beat, a row
    without values whose time closes all windows before it."""
    m = measurements(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    ends = m.agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    stop = ends.first()["stop"]
    length = F.unix_micros("stop") - F.unix_micros("start")
    part = F.least(F.lit(parts - 1), F.floor(F.try_divide(parts * (F.unix_micros("ts") - F.unix_micros("start")), length)))
    rows = m.crossJoin(F.broadcast(ends)).withColumn("part", F.when(F.expr(moved), parts - 1).otherwise(F.coalesce(part, F.lit(parts - 1))))
    beat = spark.createDataFrame([((stop or datetime(2000, 1, 1)) + timedelta(days=3),)], "ts timestamp")
    beat = beat.select(*[F.col(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in m.dtypes])
    for n in range(parts):
        some = rows.where(F.col("part") == n).select(*m.columns)
        yield some.union(beat) if n == parts - 1 else some


def final(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], moved: str = "false", parts: int = 2) -> DataFrame:
    """What an aggregating stream has appended to its files, started anew for each part that arrives."""
    path, sink, mark = scratch(spark, "arrived"), scratch(spark, "sink"), scratch(spark, "mark")
    for rows in arrivals(spark, d, moved, parts):
        rows.write.mode("append").parquet(path)
        streaming.drain(build(streaming.replay(spark, path, None)), sink, mark)
    return spark.read.parquet(sink)


for minutes in (15, 30, 45, 60):
    query("st_tumbling" if minutes == 15 else f"st_tumbling_{minutes}", M_SQL(BINS.format(minutes, "")))(lambda spark, d, minutes=minutes: final(spark, d, lambda rows: streaming.tumbling(rows, minutes)))
# rows that come weeks late find their windows final
query("st_late", M_SQL(BINS.format(60, f", (SELECT min(ts) AS start, max(ts) AS stop FROM m) WHERE NOT ({MOVED})")).replace("time_bucket(INTERVAL 60 MINUTES, ts", "time_bucket(INTERVAL 60 MINUTES, m.ts"))(
    lambda spark, d: final(spark, d, lambda rows: streaming.tumbling(rows, 60), MOVED, 4)
)
query("st_session_summary", M_SQL("SELECT session_id, count(*) AS n, round(sum(download), 4) AS download, round(sum(upload), 4) AS upload, round(sum(total), 4) AS total FROM m GROUP BY session_id"))(
    lambda spark, d: final(spark, d, streaming.session_summary)
)
query(
    "st_session_window",
    M_SQL("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS end, count(*) AS n, round(sum(total), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM m)) GROUP BY user_id, s"),
)(lambda spark, d: final(spark, d, lambda rows: streaming.sessions(rows, "6 hours")))


@query("st_delta_state", series_plans.ORACLES["win_lag_delta"].replace("SELECT event_id, CASE WHEN row", "SELECT user_id, event_id, CASE WHEN row"))
def st_delta_state(spark: SparkSession, d: str) -> DataFrame:
    path, sink, mark = recorded(spark, d, lambda m: series_plans.counter(m)), scratch(spark, "sink"), scratch(spark, "mark")
    rows = spark.readStream.schema("user_id long, event_id long, ts timestamp, counter long").option("maxFilesPerTrigger", 4).parquet(path)
    streaming.drain(streaming.delta(rows), sink, mark)
    return spark.read.parquet(sink)


@query("src_counters")
def src_counters(spark: SparkSession, d: str) -> DataFrame:
    """One sample of the live counters."""
    del d
    spark.dataSource.register(streaming.Counters)
    name = f"gl_counters_{uuid.uuid4().hex[:8]}"
    live = spark.readStream.format("net_counters").load()
    run = live.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch(spark, "mark")).trigger(once=True).start()
    run.awaitTermination()
    return spark.table(name)


# --- nonce search ---------------------------------------------------------------------------------------------------


def mine(spark: SparkSession, data: str, zeros: int, limit: int) -> DataFrame:
    """The least nonce below the limit whose text after the data begins with so many zeros; null if there is none."""
    hit = F.concat(F.lit(data), F.col("id").cast("string")).startswith("0" * zeros)
    return spark.range(limit).where(hit).agg(F.min("id").alias("nonce"))


MINED = [("00", 3, 1000), ("", 1, 1000), ("block", 1, 1000)]
query("misc_mine", " UNION ALL ".join(f"SELECT '{s}' AS data, (SELECT min(n) FROM range({limit}) t(n) WHERE starts_with('{s}' || n, '{'0' * z}')) AS nonce" for s, z, limit in MINED))(
    lambda spark, d: mine(spark, *MINED[0]).withColumn("data", F.lit(MINED[0][0])).unionByName(mine(spark, *MINED[1]).withColumn("data", F.lit(MINED[1][0]))).unionByName(mine(spark, *MINED[2]).withColumn("data", F.lit(MINED[2][0]))).select("data", "nonce")
)
