"""Sales warehouse: dimensions, facts, joins, KPIs and dashboards."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import keys
from gridloom.operators.sales import KEYS, members, sales

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SALES = """sales AS (
    SELECT l_orderkey AS ticket, l_linenumber AS line, l_partkey AS part_key, l_suppkey AS supp_key, cast(l_extendedprice AS DECIMAL(15,2)) AS price, cast(l_quantity AS INTEGER) AS qty,
        cast(cast(l_discount AS DECIMAL(5,2)) * 100 AS DECIMAL(5,2)) AS rate, CASE WHEN l_discount > 0 THEN 'Oui' ELSE 'Non' END AS promo,
        CASE WHEN l_discount > 0 THEN 'Promo-' || cast(cast(l_discount AS DECIMAL(5,2)) AS VARCHAR) ELSE 'Aucune' END AS promo_name, cast(o_orderdate AS DATE) AS sale_date,
        o_orderpriority AS channel, c_name AS client, c_mktsegment AS client_type, p_name AS product, p_type AS category, cast(p_retailprice AS DECIMAL(15,2)) AS cost,
        s_name AS store, n_name AS city, r_name AS region
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
AMOUNT, MARGIN = "price * qty", "(price - cost) * qty"
REVENUE, PROFIT = f"cast(sum({AMOUNT}) as double)", f"cast(sum({MARGIN}) as double)"


def query(name: str, sql: str | None = None):
    """Register a query; sql is its oracle, with the sales view before it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {SALES} {sql}" if "sales" in sql else sql
        return f

    return keep


def grouped(name: str, by: str, values: str, extra: str = "") -> None:
    """Aggregates of the sales view by columns or expressions; the same text serves both engines."""
    needed = [c for c in ("ticket", "price", "qty", "rate", "promo", "promo_name", "sale_date", "channel", "client", "client_type", "product", "category", "cost", "store", "city", "region") if _mentions(f"{by} {values} {extra}", c)]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = sales(spark, d, *needed)
        rows.createOrReplaceTempView(f"gl_{name}")
        return spark.sql(f"SELECT {by}{', ' if by else ''}{values} FROM gl_{name} {extra} {'GROUP BY ALL' if by else ''}")

    query(name, f"SELECT {by}{', ' if by else ''}{values} FROM sales {extra} {'GROUP BY ALL' if by else ''}")(run)


def _mentions(text: str, word: str) -> bool:
    return re.search(rf"\b{word}\b", text) is not None


# --- dimensions -----------------------------------------------------------------------------------------------------

#: The key of the sales view that a label depends on; others stand for themselves.
SOURCE = {"product": "part_key", "category": "part_key", "client": "cust_key", "client_type": "cust_key", "store": "supp_key", "city": "supp_key", "region": "supp_key"}


def sold(spark: SparkSession, d: str, labels: list[str]) -> tuple[list[str], DataFrame, Column | None]:
    """The keys of the sales view behind labels, their values that were sold with the labels (products with their cost),
    and blocks in the order of the labels, bounded by what the tables of the keys hold. Lines meet no label here."""
    source, block = list(dict.fromkeys(SOURCE.get(c, c) for c in labels)), None
    rows = sales(spark, d, *source).distinct()
    for own in [s for s in source if s in KEYS]:
        mine = [c for c in labels if SOURCE.get(c) == own]
        known = members(spark, d, own, *mine, *(["cost"] if own == "part_key" else []))
        rows, block = rows.join(known, own), keys.blocks(known, mine)
    return source, rows, block


LABELS = {"dim_region": ("region", "region_id"), "dim_categorie": ("category", "category_id"), "dim_typeclient": ("client_type", "type_id"), "dim_canal": ("channel", "channel_id")}
for name, (label, key) in LABELS.items():
    query(name, f"SELECT CAST(row_number() OVER (ORDER BY {label}) AS INTEGER) AS {key}, {label} FROM (SELECT DISTINCT {label} FROM sales)")(
        lambda spark, d, label=label, key=key: keys.dimension(sales(spark, d, label), [label], key)
    )
CHILDREN = {
    "dim_promotion": (["promo_name", "promo"], "promo_id"),
    "dim_promotion_b": (["promo_name", "rate"], "promo_id"),
    "dim_client_flat": (["client", "client_type"], "client_id"),
}
for name, (columns, key) in CHILDREN.items():
    heads = [f"cast({c} as double) AS {c}" if c == "rate" else c for c in columns]
    query(name, f"SELECT row_number() OVER (ORDER BY {', '.join(columns)}) AS {key}, {', '.join(heads)} FROM (SELECT DISTINCT {', '.join(columns)} FROM sales)")(
        lambda spark, d, columns=columns, key=key, heads=heads: keys.sequence(sales(spark, d, *columns).distinct(), columns, key).selectExpr(key, *heads)
    )


def child(name: str, label: str, parent: str, key: str, parent_key: str) -> None:
    """A snowflake child: distinct labels with the key of their parent's label, of which there are few."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        _, rows, block = sold(spark, d, [label, parent])
        rows = rows.select(label, parent).distinct()
        above = keys.dimension(rows, [parent], parent_key).withColumn(parent_key, F.col(parent_key).cast("long"))
        return keys.ranked(rows.join(above, parent), [label, parent], key, block).select(key, label, parent_key)

    query(
        name,
        f"SELECT row_number() OVER (ORDER BY {label}, {parent}) AS {key}, {label}, {parent_key} FROM (SELECT DISTINCT {label}, {parent} FROM sales)"
        f" JOIN (SELECT row_number() OVER (ORDER BY {parent}) AS {parent_key}, {parent} FROM (SELECT DISTINCT {parent} FROM sales)) USING ({parent})",
    )(run)


child("dim_ville", "city", "region", "city_id", "region_id")
child("dim_pointvente", "store", "city", "store_id", "city_id")
child("dim_produit", "product", "category", "product_id", "category_id")
child("dim_client", "client", "client_type", "client_id", "type_id")


@query(
    "dim_lieu",
    "SELECT row_number() OVER (ORDER BY store, city, channel) AS place_id, store, city_id, channel FROM (SELECT DISTINCT store, city, channel FROM sales)"
    " JOIN (SELECT row_number() OVER (ORDER BY city) AS city_id, city FROM (SELECT DISTINCT city FROM sales)) USING (city)",
)
def dim_lieu(spark: SparkSession, d: str) -> DataFrame:
    _, rows, block = sold(spark, d, ["store", "city", "channel"])
    rows = rows.select("store", "city", "channel").distinct()
    cities = keys.dimension(rows, ["city"], "city_id").withColumn("city_id", F.col("city_id").cast("long"))
    return keys.ranked(rows.join(cities, "city"), ["store", "city", "channel"], "place_id", block).select("place_id", "store", "city_id", "channel")


DATES = "(SELECT DISTINCT sale_date FROM sales)"


def dates(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d, "sale_date").distinct()


query("dim_temps", f"SELECT sale_date, year(sale_date)::INTEGER AS year, month(sale_date)::INTEGER AS month, monthname(sale_date) AS month_name, quarter(sale_date)::INTEGER AS quarter FROM {DATES}")(
    lambda spark, d: dates(spark, d).selectExpr("sale_date", "year(sale_date) AS year", "month(sale_date) AS month", "date_format(sale_date, 'MMMM') AS month_name", "quarter(sale_date) AS quarter")
)
query("dim_annee", f"SELECT DISTINCT year(sale_date)::INTEGER AS year_id FROM {DATES}")(lambda spark, d: dates(spark, d).selectExpr("year(sale_date) AS year_id").distinct())
query("dim_trimestre", f"SELECT DISTINCT (year(sale_date) * 10 + quarter(sale_date))::INTEGER AS quarter_id, quarter(sale_date)::INTEGER AS quarter, year(sale_date)::INTEGER AS year_id FROM {DATES}")(
    lambda spark, d: dates(spark, d).selectExpr("year(sale_date) * 10 + quarter(sale_date) AS quarter_id", "quarter(sale_date) AS quarter", "year(sale_date) AS year_id").distinct()
)
query("dim_mois", f"SELECT DISTINCT (year(sale_date) * 100 + month(sale_date))::INTEGER AS month_id, monthname(sale_date) AS month_name, (year(sale_date) * 10 + quarter(sale_date))::INTEGER AS quarter_id FROM {DATES}")(
    lambda spark, d: dates(spark, d).selectExpr("year(sale_date) * 100 + month(sale_date) AS month_id", "date_format(sale_date, 'MMMM') AS month_name", "year(sale_date) * 10 + quarter(sale_date) AS quarter_id").distinct()
)
query("dim_temps4", f"SELECT strftime(sale_date, '%Y%m%d')::INTEGER AS day_id, sale_date, day(sale_date)::INTEGER AS day, (year(sale_date) * 100 + month(sale_date))::INTEGER AS month_id FROM {DATES}")(
    lambda spark, d: dates(spark, d).selectExpr("cast(date_format(sale_date, 'yyyyMMdd') as int) AS day_id", "sale_date", "day(sale_date) AS day", "year(sale_date) * 100 + month(sale_date) AS month_id")
)

# --- facts and joins ------------------------------------------------------------------------------------------------

FACT_A_KEYS = {"store_id": ["store", "city"], "product_id": ["product", "category"], "client_id": ["client", "client_type"], "channel_id": ["channel"], "promo_id": ["promo_name", "promo"]}
FACT_B_KEYS = {"place_id": ["store", "city", "channel"], "product_id": ["product", "category"], "client_id": ["client", "client_type"], "promo_id": ["promo_name", "rate"]}


def key_map(spark: SparkSession, d: str, natural: list[str], key: str, strict: bool = True) -> tuple[list[str], DataFrame]:
    """The keys of the sales view behind a dimension, and a row for each of their values that was sold with the
    dimension's key. The dimension is the distinct natural keys; strict=False gives, as a join by label would, the keys
    of all that share the first of them. Products bring their cost."""
    source, rows, block = sold(spark, d, natural)
    numbered = keys.ranked(rows.dropna(subset=natural), natural, key, block)
    if not strict:
        numbered = numbered.drop(key).join(numbered.select(natural[0], key).distinct(), natural[0])
    return source, numbered.drop(*[c for c in natural if c not in source])


def fact(spark: SparkSession, d: str, dims: dict[str, list[str]], strict: bool = True) -> DataFrame:
    """Sales lines with the keys of their dimensions. Lines carry the numbers of products, clients and stores, and meet the
    maps from these to the dimensions' keys; labels are compared only where the dimensions are made."""
    maps = [key_map(spark, d, natural, key, strict) for key, natural in dims.items()]
    rows = sales(spark, d, *dict.fromkeys(["ticket", "qty", "price", "rate", "sale_date", *[c for source, _ in maps for c in source]]))
    for source, known in maps:
        rows = rows.join(known, source)
    return rows


def fact_sql(dims: dict[str, list[str]], measures: str, strict: bool = True) -> str:
    joins = []
    for key, natural in dims.items():
        on = natural if strict else natural[:1]
        joins.append(f"JOIN (SELECT row_number() OVER (ORDER BY {', '.join(natural)}) AS {key}, {', '.join(natural)} FROM (SELECT DISTINCT {', '.join(natural)} FROM sales)) d_{key} ON {' AND '.join(f's.{c} = d_{key}.{c}' for c in on)}")
    return f"SELECT {measures} FROM sales s {' '.join(joins)}"


GROSS = "cast({p}price * {p}qty as double) AS amount, cast(({p}price - {p}cost) * {p}qty as double) AS margin"
NET = "cast({p}cost * {p}qty as double) AS total_cost, cast({p}price * {p}qty * (100 - {p}rate) as double) / 100 AS net, cast({p}price * {p}qty * (100 - {p}rate) - 100 * {p}cost * {p}qty as double) / 100 AS margin, 1 AS n_transactions"
A_KEYS, B_KEYS = ", ".join(FACT_A_KEYS), ", ".join(FACT_B_KEYS)


@query("fact_ventes_A", fact_sql(FACT_A_KEYS, f"cast(s.ticket AS VARCHAR) AS source_ticket, s.sale_date, {A_KEYS}, s.qty, {GROSS.format(p='s.')}"))
def fact_a(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d, FACT_A_KEYS).selectExpr("cast(ticket as string) AS source_ticket", "sale_date", *FACT_A_KEYS, "qty", *GROSS.format(p="").split(", "))


@query("fact_vente_B", fact_sql(FACT_B_KEYS, f"strftime(s.sale_date, '%Y%m%d')::INTEGER AS day_id, {B_KEYS}, s.qty, {NET.format(p='s.')}"))
def fact_b(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d, FACT_B_KEYS).selectExpr("cast(date_format(sale_date, 'yyyyMMdd') as int) AS day_id", *FACT_B_KEYS, "qty", *NET.format(p="").split(", "))


for name, dims, strict in (("jn_star5", FACT_A_KEYS, True), ("jn_star5_parity", FACT_A_KEYS, False), ("jn_composite", FACT_B_KEYS, True)):
    query(name, fact_sql(dims, f"count(*) AS n_rows, {REVENUE.replace('price', 's.price').replace('qty', 's.qty')} AS revenue, count(DISTINCT ticket) AS tickets", strict))(
        lambda spark, d, dims=dims, strict=strict: fact(spark, d, dims, strict).agg(F.expr("count(*)").alias("n_rows"), F.expr(REVENUE).alias("revenue"), F.countDistinct("ticket").alias("tickets"))
    )


@query("jn_inner_dim", f"SELECT region, category, channel, client_type, count(*) AS n, {REVENUE} AS revenue FROM sales GROUP BY ALL")
def jn_inner_dim(spark: SparkSession, d: str) -> DataFrame:
    rows = sales(spark, d, "region", "category", "channel", "client_type", "price", "qty")
    for label, key in LABELS.values():
        rows = rows.join(keys.dimension(sales(spark, d, label), [label], key), label)
    return rows.groupBy("region", "category", "channel", "client_type").agg(F.count("*").alias("n"), F.expr(REVENUE).alias("revenue"))


@query("jn_left_merge", "SELECT promo_name, CASE WHEN promo_name = 'Aucune' THEN NULL ELSE 1 END AS found, count(*) AS n FROM sales GROUP BY ALL")
def jn_left_merge(spark: SparkSession, d: str) -> DataFrame:
    """Left join in which null meets null: only promotions with a name have a row in the dimension."""
    rows = sales(spark, d, "promo_name")
    dim = rows.where("promo_name <> 'Aucune'").distinct().select(F.col("promo_name").alias("name"), F.lit(1).alias("found"))
    return rows.join(dim, rows.promo_name.eqNullSafe(dim.name), "left").groupBy("promo_name", "found").agg(F.count("*").alias("n"))


grouped("jn_snowflake", "region, city, store", f"{REVENUE} AS revenue")


@query("jn_left_outer", f"SELECT r.name AS promo_name, count(*) AS n, {REVENUE} AS revenue FROM sales LEFT JOIN (SELECT DISTINCT promo_name AS name FROM sales WHERE promo = 'Oui') r ON promo_name = name GROUP BY ALL")
def jn_left_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = sales(spark, d, "promo_name", "price", "qty")
    dim = sales(spark, d, "promo", "promo_name").where("promo = 'Oui'").select(F.col("promo_name").alias("name")).distinct()
    return rows.join(dim, rows.promo_name == dim.name, "left").groupBy(F.col("name").alias("promo_name")).agg(F.count("*").alias("n"), F.expr(REVENUE).alias("revenue"))


@query("jn_index_align", "SELECT ticket, line, part_key, supp_key, qty FROM sales WHERE ticket % 5 = 0")
def jn_index_align(spark: SparkSession, d: str) -> DataFrame:
    rows = sales(spark, d, "ticket", "line", "part_key", "supp_key", "qty")
    labels = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("ticket"))
    return rows.join(labels, "ticket", "left_semi")


@query("fanout_check", "SELECT product, count(DISTINCT category) AS n_rows FROM sales GROUP BY product HAVING count(DISTINCT category) > 1")
def fanout_check(spark: SparkSession, d: str) -> DataFrame:
    return keys.fan_out(sales(spark, d, "product", "category").distinct(), "product")


query("chk_unique", "SELECT ticket, line, count(*) AS n_rows FROM sales GROUP BY ALL HAVING count(*) > 1")(lambda spark, d: keys.duplicates(sales(spark, d, "ticket", "line"), ["ticket", "line"]))
query("chk_fk", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")(
    lambda spark, d: keys.orphans(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), spark.read.parquet(f"{d}/lineitem.parquet"), "o_orderkey", "l_orderkey")
)
LINE_ORDER = ["ticket", "line", "part_key", "supp_key", "qty"]
SEQUENCE = f"SELECT 1000 + row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS sale_id, {', '.join(LINE_ORDER)} FROM sales"
query("key_sequence", SEQUENCE)(lambda spark, d: keys.sequence(sales(spark, d, *LINE_ORDER), LINE_ORDER, "sale_id", after=1000))
query("key_autoinc", "SELECT row_number() OVER (ORDER BY store) AS store_id, store FROM (SELECT DISTINCT store FROM sales)")(lambda spark, d: keys.sequence(sales(spark, d, "store").distinct(), ["store"], "store_id"))

# --- projections and conditions -------------------------------------------------------------------------------------

query("prj_columns", "SELECT ticket AS sale, channel AS mode, qty FROM sales")(lambda spark, d: sales(spark, d, "ticket", "qty", "channel").withColumnsRenamed({"ticket": "sale", "channel": "mode"}).select("sale", "mode", "qty"))
query("prj_measures_gross", f"SELECT ticket, line, part_key, qty, {GROSS.format(p='')} FROM sales")(lambda spark, d: sales(spark, d, "ticket", "line", "part_key", "qty", "price", "cost").selectExpr("ticket", "line", "part_key", "qty", *GROSS.format(p="").split(", ")))
query("prj_measures_net", f"SELECT ticket, line, part_key, qty, {NET.format(p='')} FROM sales")(lambda spark, d: sales(spark, d, "ticket", "line", "part_key", "qty", "price", "cost", "rate").selectExpr("ticket", "line", "part_key", "qty", *NET.format(p="").split(", ")))
grouped("flt_promo", "promo_name", "count(*) AS n", "WHERE rate > 0")
STATUS, STATUS2 = "CASE WHEN rate > 0 THEN 'En Promotion' ELSE 'Prix Standard' END", "CASE WHEN promo = 'Oui' OR rate > 0 THEN 'En Promotion' ELSE 'Hors Promotion' END"
grouped("flt_status", "promo_name", f"{REVENUE} AS revenue", f"WHERE {STATUS2} = 'En Promotion'")
grouped("cse_promo", f"{STATUS} AS status", "count(*) AS n")
grouped("cse_promo2", f"{STATUS2} AS status", "count(*) AS n")
query("cse_safe_div", f"SELECT region, CASE WHEN sum({AMOUNT}) FILTER (rate > 9) <> 0 THEN round({PROFIT} / {REVENUE} * 100, 6) ELSE 0 END AS rate FROM sales GROUP BY region")(
    lambda spark, d: sales(spark, d, "region", "price", "qty", "cost", "rate").groupBy("region").agg(F.when(F.sum(F.expr(f"CASE WHEN rate > 9 THEN {AMOUNT} END")) != 0, F.round(F.coalesce(F.try_divide(F.expr(PROFIT), F.expr(REVENUE)), F.lit(0.0)) * 100, 6)).otherwise(F.lit(0.0)).alias("rate"))
)

# --- KPIs -----------------------------------------------------------------------------------------------------------

grouped("kpi1_global", "", f"{REVENUE} AS revenue, {PROFIT} AS margin, round({PROFIT} / {REVENUE} * 100, 6) AS margin_rate")
grouped("kpi2_trend", "cast(year(sale_date) as int) AS year, cast(quarter(sale_date) as int) AS quarter", f"{REVENUE} AS revenue, {PROFIT} AS margin")


def top(name: str, n: int, by: list[str], value: str, alias: str, more: str = "", descending: bool = True) -> None:
    """The n groups of largest value, ties by label."""
    labels = ", ".join(by)

    def run(spark: SparkSession, d: str) -> DataFrame:
        needed = [c for c in ("qty", "price", "cost") if _mentions(value + more, c)]
        rows = sales(spark, d, *by, *needed).groupBy(*by).agg(*[F.expr(x) for x in [f"{value} AS {alias}", *filter(None, more.split("; "))]])
        return rows.orderBy(F.col(alias).desc(), *by).limit(n)

    query(name, f"SELECT {labels}, {value} AS {alias}{''.join(', ' + x for x in filter(None, more.split('; ')))} FROM sales GROUP BY ALL ORDER BY {alias} DESC, {labels} LIMIT {n}")(run)


VOLUME = "cast(sum(qty) as bigint)"
top("kpi3_top_regions", 3, ["region"], REVENUE, "revenue")
grouped("kpi4_basket", "", f"round(cast(sum({AMOUNT}) as double) / count(*), 6) AS basket")
grouped("kpi5_channel", "channel", f"count(DISTINCT ticket) AS tickets, {REVENUE} AS revenue, round({REVENUE} / count(*), 6) AS basket")
top("kpi6_top_products", 5, ["product", "category"], VOLUME, "volume")
grouped("kpi7_promo_split", f"{STATUS} AS status", f"count(DISTINCT ticket) AS tickets, {REVENUE} AS revenue, {PROFIT} AS margin")
KPI8 = f"{VOLUME} AS volume, {PROFIT} AS margin"
query("kpi8_promo_rate", f"SELECT concat(cast(rate as varchar), '%') AS promo_rate, volume, margin FROM (SELECT rate, {KPI8} FROM sales WHERE rate > 0 GROUP BY rate)")(
    lambda spark, d: sales(spark, d, "rate", "qty", "price", "cost").where("rate > 0").groupBy("rate").agg(*[F.expr(x) for x in KPI8.split(", ")]).orderBy("rate").select(F.concat(F.col("rate").cast("string"), F.lit("%")).alias("promo_rate"), "volume", "margin")
)

# --- aggregates by their kind ---------------------------------------------------------------------------------------

grouped("agg_global", "", f"{REVENUE} AS revenue, {PROFIT} AS margin, round({PROFIT} / {REVENUE} * 100, 6) AS margin_rate")
grouped("agg_avg", "", f"round({REVENUE} / count(*), 6) AS mean_amount")
grouped("agg_group1", "city", f"{REVENUE} AS revenue")
grouped("agg_groupN", "cast(year(sale_date) as int) AS year, cast(month(sale_date) as int) AS month, category", f"{REVENUE} AS revenue")
grouped("agg_count_distinct", "channel", "count(DISTINCT ticket) AS tickets, count(DISTINCT client) AS clients")
grouped("agg_ratio_basket", "", f"round({REVENUE} / count(DISTINCT ticket), 6) AS basket")
grouped("agg_groupby_alias", f"{STATUS} AS status", f"{REVENUE} AS revenue")
query("agg_group_hidden", f"SELECT concat(cast(rate as varchar), '%') AS promo_rate, volume FROM (SELECT rate, {VOLUME} AS volume FROM sales GROUP BY rate)")(
    lambda spark, d: sales(spark, d, "rate", "qty").groupBy("rate").agg(F.expr(VOLUME).alias("volume")).select(F.concat(F.col("rate").cast("string"), F.lit("%")).alias("promo_rate"), "volume")
)


@query("agg_rollup", f"SELECT region, city, {REVENUE} AS revenue FROM sales GROUP BY ROLLUP (region, city)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d, "region", "city", "price", "qty").rollup("region", "city").agg(F.expr(REVENUE).alias("revenue"))


# --- dashboards -----------------------------------------------------------------------------------------------------

EXTRACT = {
    "dash_comm_extract": ["ticket", "product", "channel", "store", "city", "qty"],
    "dash_dg_extract": ["sale_date", "product", "city", "region", "qty"],
}
for name, columns in EXTRACT.items():
    query(name, f"SELECT {', '.join(columns)}, cast({AMOUNT} as double) AS amount FROM sales")(lambda spark, d, columns=columns: sales(spark, d, *dict.fromkeys([*columns, "price", "qty"])).selectExpr(*columns, f"cast({AMOUNT} as double) AS amount"))
query("dash_mkt_extract", f"SELECT ticket, promo_name, cast(rate as double) AS rate, cast({AMOUNT} as double) AS amount, {STATUS2} AS status FROM sales")(
    lambda spark, d: sales(spark, d, "ticket", "promo_name", "promo", "rate", "price", "qty").selectExpr("ticket", "promo_name", "cast(rate as double) AS rate", f"cast({AMOUNT} as double) AS amount", f"{STATUS2} AS status")
)
grouped("dash_comm_basket", "", f"round({REVENUE} / count(DISTINCT ticket), 6) AS basket")
grouped("dash_comm_volume", "", f"{VOLUME} AS volume")


def share(spark: SparkSession, d: str) -> DataFrame:
    rows = sales(spark, d, "channel", "price", "qty").groupBy("channel").agg(F.expr(REVENUE).alias("revenue"), F.sum(F.expr(AMOUNT)).alias("exact"))
    whole = F.sum("exact").over(Window.partitionBy(F.lit(1))).cast("double")
    return rows.select("channel", "revenue", F.round(F.col("revenue") / whole, 6).alias("share"))


query("dash_comm_channel", f"SELECT channel, {REVENUE} AS revenue, round({REVENUE} / cast(sum(sum({AMOUNT})) OVER () as double), 6) AS share FROM sales GROUP BY channel")(share)
top("dash_comm_top10", 10, ["product"], REVENUE, "revenue")
grouped("dash_comm_city", "city", f"{REVENUE} AS revenue")


@query("dash_comm_best", " UNION ALL ".join(f"(SELECT '{c}' AS kind, {c} AS label FROM sales GROUP BY {c} ORDER BY sum({AMOUNT}) DESC, {c} LIMIT 1)" for c in ("city", "channel", "product")))
def best(spark: SparkSession, d: str) -> DataFrame:
    """The label of largest revenue among cities, channels and products, the first in order among equals."""
    out = None
    for c in ("city", "channel", "product"):
        rows = sales(spark, d, c, "price", "qty").groupBy(c).agg(F.sum(F.expr(AMOUNT)).alias("revenue"))
        one = rows.orderBy(F.col("revenue").desc(), c).limit(1).select(F.lit(c).alias("kind"), F.col(c).alias("label"))
        out = one if out is None else out.union(one)
    return out


grouped("dash_dg_kpi", "", f"{REVENUE} AS revenue, {PROFIT} AS margin, CASE WHEN sum({AMOUNT}) <> 0 THEN round({PROFIT} / {REVENUE} * 100, 6) ELSE 0 END AS margin_rate")
query("dash_dg_monthly", f"SELECT cast(year(sale_date) as varchar) AS year, month(sale_date)::INTEGER AS month, monthname(sale_date) AS month_name, {REVENUE} AS revenue FROM sales GROUP BY ALL")(
    lambda spark, d: sales(spark, d, "sale_date", "price", "qty").groupBy(F.year("sale_date").cast("string").alias("year"), F.month("sale_date").alias("month"), F.date_format("sale_date", "MMMM").alias("month_name")).agg(F.expr(REVENUE).alias("revenue")).orderBy("year", "month")
)
grouped("dash_dg_regions", "region", f"{REVENUE} AS revenue")
top("dash_dg_top10", 10, ["product"], REVENUE, "revenue", f"{PROFIT} AS margin")
grouped("dash_mkt_split", f"{STATUS2} AS status", f"{REVENUE} AS revenue")
query("dash_mkt_ols", f"SELECT round(regr_slope(a, r), 4) AS slope, round(regr_intercept(a, r), 2) AS intercept, round(regr_r2(a, r), 6) AS r2 FROM (SELECT cast({AMOUNT} as double) AS a, cast(rate as double) AS r FROM sales WHERE rate > 0)")(
    lambda spark, d: sales(spark, d, "rate", "price", "qty").where("rate > 0").selectExpr(f"cast({AMOUNT} as double) AS a", "cast(rate as double) AS r").selectExpr("round(regr_slope(a, r), 4) AS slope", "round(regr_intercept(a, r), 2) AS intercept", "round(regr_r2(a, r), 6) AS r2")
)
grouped("dash_mkt_campaign", "promo_name", f"{PROFIT} AS margin, {REVENUE} AS revenue", f"WHERE {STATUS2} = 'En Promotion'")
grouped("dash_mkt_totals", "", f"{REVENUE} AS revenue, {PROFIT} AS margin", f"WHERE {STATUS2} = 'En Promotion'")

# --- sorting, top-k, windows ----------------------------------------------------------------------------------------

grouped("srt_multi", "cast(year(sale_date) as int) AS year, cast(quarter(sale_date) as int) AS quarter, channel", f"{REVENUE} AS revenue")
top("topk_limit", 5, ["store"], REVENUE, "revenue")
query("win_share", "SELECT client_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 6) AS share FROM sales GROUP BY client_type")(
    lambda spark, d: sales(spark, d, "client_type").groupBy("client_type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) * 100, 6))
)
query("win_argmax", f"SELECT region, first(city ORDER BY total DESC, city) AS best_city FROM (SELECT region, city, sum({AMOUNT}) AS total FROM sales GROUP BY ALL) GROUP BY region")(
    lambda spark, d: sales(spark, d, "region", "city", "price", "qty").groupBy("region", "city").agg(F.sum(F.expr(AMOUNT)).alias("total")).withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy(F.col("total").desc(), "city"))).where("r = 1").select("region", F.col("city").alias("best_city"))
)
query("set_distinct", "SELECT DISTINCT promo_name, promo FROM sales")(lambda spark, d: sales(spark, d, "promo_name", "promo").distinct())
query("lit_const", "SELECT ticket, line, part_key, qty, 1 AS n_transactions FROM sales")(lambda spark, d: sales(spark, d, "ticket", "line", "part_key", "qty").withColumn("n_transactions", F.lit(1)))
