"""The sales view over the order tables: only the tables that the asked columns need are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Column -> (table, expression).
COLUMNS = {
    "ticket": ("lineitem", "l_orderkey"),
    "line": ("lineitem", "l_linenumber"),
    "part_key": ("lineitem", "l_partkey"),
    "supp_key": ("lineitem", "l_suppkey"),
    "cust_key": ("orders", "o_custkey"),
    "price": ("lineitem", "cast(l_extendedprice as decimal(15,2))"),
    "qty": ("lineitem", "cast(l_quantity as int)"),
    "rate": ("lineitem", "cast(cast(l_discount as decimal(5,2)) * 100 as decimal(5,2))"),
    "promo": ("lineitem", "case when l_discount > 0 then 'Oui' else 'Non' end"),
    "promo_name": ("lineitem", "case when l_discount > 0 then concat('Promo-', cast(cast(l_discount as decimal(5,2)) as string)) else 'Aucune' end"),
    "sale_date": ("orders", "cast(o_orderdate as date)"),
    "channel": ("orders", "o_orderpriority"),
    "client": ("customer", "c_name"),
    "client_type": ("customer", "c_mktsegment"),
    "product": ("part", "p_name"),
    "category": ("part", "p_type"),
    "cost": ("part", "cast(p_retailprice as decimal(15,2))"),
    "store": ("supplier", "s_name"),
    "city": ("nation", "n_name"),
    "region": ("region", "r_name"),
}
#: Table -> (the table that it hangs on, key there, own key).
JOINS = {
    "orders": ("lineitem", "l_orderkey", "o_orderkey"),
    "customer": ("orders", "o_custkey", "c_custkey"),
    "part": ("lineitem", "l_partkey", "p_partkey"),
    "supplier": ("lineitem", "l_suppkey", "s_suppkey"),
    "nation": ("supplier", "s_nationkey", "n_nationkey"),
    "region": ("nation", "n_regionkey", "r_regionkey"),
}


#: Keys of the view that a table of their own describes.
KEYS = {"part_key": "part", "cust_key": "customer", "supp_key": "supplier"}


def _view(spark: SparkSession, sf_dir: str, root: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns, each a (table, expression), of a table with those that hang on it."""
    needed: list[str] = []
    for at, _ in columns.values():
        path = []
        while at != root:
            path.append(at)
            at = JOINS[at][0]
        needed += [t for t in reversed(path) if t not in needed]
    out = spark.read.parquet(f"{sf_dir}/{root}.parquet")
    for name in needed:
        _, left, right = JOINS[name]
        own = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out = out.join(own, out[left] == own[right])
    return out.selectExpr(*[f"{e} as {c}" for c, (_, e) in columns.items()])


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """A row per order line with the columns (all by default); joins are inner, on the keys of the tables."""
    return _view(spark, sf_dir, "lineitem", {c: COLUMNS[c] for c in columns or COLUMNS})


def members(spark: SparkSession, sf_dir: str, key: str, *columns: str) -> DataFrame:
    """A row per value of one of KEYS, sold or not, with columns that depend on it."""
    table = KEYS[key]
    return _view(spark, sf_dir, table, {key: (table, JOINS[table][2])} | {c: COLUMNS[c] for c in columns})
