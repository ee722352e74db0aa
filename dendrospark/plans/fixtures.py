"""Views over the driver's tables that stand in for neurons, views, metadata, logs, ids and pixels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
NODES = f"""SELECT l_orderkey AS neuron_id, CAST(rn AS INT) AS idx, CAST(CASE WHEN rn = 1 THEN -1 ELSE floor(rn / 2) END AS INT) AS parent,
 l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_extendedprice / 10000 AS radius, CAST(CASE WHEN rn = 1 THEN 1 ELSE 2 + CAST(l_linenumber AS INT) % 3 END AS INT) AS type_id
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) rn FROM lineitem)"""
# Trees that go deep, with several roots, orphans, self-loops, cycles, and neurons without a soma or a root.
ODD = """SELECT k AS neuron_id, CAST(rn AS INT) AS idx, CAST(CASE WHEN k = 7 THEN CASE WHEN rn = 1 THEN 2 ELSE rn - 1 END WHEN rn = 1 OR rn % 61 = 0 THEN -1 WHEN rn % 53 = 0 THEN 1000000 WHEN rn % 47 = 0 THEN rn
 WHEN rn % 43 = 0 THEN rn + 1 WHEN rn % 7 = 0 THEN rn - 3 ELSE rn - 1 END AS INT) AS parent, x, y, z, radius, CAST(CASE WHEN k % 4 = 0 THEN 2 + rn % 3 WHEN rn = 5 THEN 1 ELSE 2 + rn % 3 END AS INT) AS type_id
 FROM (SELECT o_orderkey % 11 AS k, row_number() OVER (PARTITION BY o_orderkey % 11 ORDER BY o_orderkey) AS rn, CAST(o_custkey % 101 AS DOUBLE) AS x, CAST(o_orderkey % 89 AS DOUBLE) AS y, CAST(o_custkey % 13 AS DOUBLE) AS z, 0.5 + CAST(o_custkey % 7 AS DOUBLE) AS radius FROM orders)"""
VIEWS = "SELECT vec_id AS view_id, CAST(floor(vec_id / 4) AS BIGINT) AS neuron_id, label, embedding AS vec FROM embeddings"
META = "SELECT d.doc_id AS neuron_id, d.source AS archive, d.lang AS species, d.text, CAST(d.n_chars AS DOUBLE) AS length, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
LOG = "SELECT event_id, event_id % 1000 AS neuron_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'fail' WHEN 'view' THEN 'exists' ELSE 'ok' END AS status FROM events"
_NAME = "concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS VARCHAR(20)))"
_FULL = f"concat(CAST(p_partkey AS VARCHAR(20)), '_', {_NAME}, '.CNG')"
IDS = f"SELECT p_partkey, {_FULL} AS manifest_id, CASE p_partkey % 4 WHEN 0 THEN {_FULL} WHEN 1 THEN {_NAME} WHEN 2 THEN CAST(p_partkey AS VARCHAR(20)) ELSE concat('x', CAST(p_partkey AS VARCHAR(20))) END AS meta_id FROM part"
PIXELS = "SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS view_id, CAST(floor((o_orderkey % 64) / 8) AS INT) AS r, CAST(o_orderkey % 8 AS INT) AS c, CAST(o_custkey % 6 AS INT) AS val FROM orders"
DEPTHS = "SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS view_id, CAST(floor((o_orderkey % 64) / 8) AS INT) AS r, CAST(o_orderkey % 8 AS INT) AS c, CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE CAST(o_custkey % 997 AS DOUBLE) / 1000 END AS val FROM orders"

# Metadata with lists, by part: cell types, regions and species in all the forms they take.
CELL_TYPES = (("Basket cell", "x"), ("neuron", "foo"), ("principal cell",), ("Pyramidal", "interneuron"), (), ("Unknown",), ("VIP", "odd"), ("Purkinje neuron", "Stellate"))
REGIONS = (("left olfactory bulb",), ("Neocortex", "Layer 2/3"), (), ("",), ("Frontal Lobe", "layer 5"), ("hip", "retina"))
SPECIES = ("Mouse", "unknown", "", "African elephant", None, "Not Reported")


def _sql_list(items) -> str:
    return "CAST([" + ", ".join(f"'{i}'" for i in items) + "] AS VARCHAR[])"


TAGS = "SELECT p_partkey, " + ", ".join(
    f"CASE {key} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else _sql_list(v) if isinstance(v, tuple) else repr(v)}" for k, v in enumerate(values)) + f" END AS {name}"
    for name, key, values in (("cell_types", "p_partkey % 8", CELL_TYPES), ("regions", "CAST(floor(p_partkey / 8) AS INT) % 6", REGIONS), ("species", "CAST(floor(p_partkey / 48) AS INT) % 6", SPECIES))
) + " FROM part"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``TAGS``."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = []
    for name, step, values in (("cell_types", 1, CELL_TYPES), ("regions", 8, REGIONS), ("species", 48, SPECIES)):
        lits = [F.lit(v) if not isinstance(v, tuple) else F.array(*map(F.lit, v)).cast("array<string>") for v in values]
        rows.append(F.get(F.array(*lits), (F.floor(F.col("p_partkey") / step) % len(values)).cast("int")).alias(name))
    return p.select("p_partkey", *rows)


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A query over the named tables of a data folder."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(_placed(sql.replace("VARCHAR(20)", "STRING"), tables), **frames)


def _placed(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def nodes(spark, sf_dir):
    return view(spark, sf_dir, NODES, "lineitem")


def odd(spark, sf_dir):
    return view(spark, sf_dir, ODD, "orders")


def views(spark, sf_dir):
    return view(spark, sf_dir, VIEWS, "embeddings")


def meta(spark, sf_dir):
    return view(spark, sf_dir, META, "documents", "labels")


def log(spark, sf_dir):
    return view(spark, sf_dir, LOG, "events")


def ids(spark, sf_dir):
    return view(spark, sf_dir, IDS, "part")


def pixels(spark, sf_dir):
    return view(spark, sf_dir, PIXELS, "orders")


def depths(spark, sf_dir):
    return view(spark, sf_dir, DEPTHS, "orders")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded alike in every engine: a nudge keeps decimal ties from falling on either side."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + nudge(places), places) for c in columns})


def rounded_plainly(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """``rounded`` without Spark's way over decimal texts, which costs tables of many rows more than what they compute; the same but for exact ties after the nudge. No zero is negative."""
    return df.withColumns({c: F.rint((F.col(c).cast("double") + nudge(places)) * 10.0**places) / 10.0**places + 0.0 for c in columns})


def nudge(places: int) -> float:
    return 3.3 * 10.0 ** -(places + 2)
