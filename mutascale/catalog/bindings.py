"""The driver tables in the roles of the library's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascale.operators.burden import attach_burden, burden_flag
from mutascale.operators.intervals import overlap_join, panel_length
from mutascale.operators.qc import QcRules
from mutascale.operators.sampling import hash_split

# Which variant class stands for which part type and line status.
CLASS_OF = {
    ("STANDARD", "F"): "Frame_Shift_Del",
    ("STANDARD", "O"): "Frame_Shift_Ins",
    ("SMALL", "F"): "In_Frame_Del",
    ("SMALL", "O"): "In_Frame_Ins",
    ("MEDIUM", "F"): "Missense_Mutation",
    ("MEDIUM", "O"): "Nonsense_Mutation",
    ("LARGE", "F"): "Nonstop_Mutation",
    ("LARGE", "O"): "Synonymous_Mutation",
    ("ECONOMY", "F"): "Silent",
    ("ECONOMY", "O"): "Splice_Site",
    ("PROMO", "F"): "Translation_Start_Site",
    ("PROMO", "O"): "Intron",
}
STUDIES = [f"NATION_{i}" for i in range(15)]
ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

# Thresholds that select on this data; columns under the view's names.
RULES = QcRules(
    sample="sample", study="study", label="label", variant_class="type", depth="t_depth", alt_count="t_alt",
    vaf="vaf", studies=STUDIES, artefact_labels=["RF", "AF"], min_max_vaf=0.49, max_failed=0.4, exome_mb=0.7,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str, sample: bool = True, kind: bool = True) -> DataFrame:
    """Line items as variant calls; ``sample`` needs the orders and ``kind`` the parts, so each can be left out."""
    rows = table(spark, sf_dir, "lineitem").drop("l_shipdate")
    if sample:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample"))
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey).drop("o_orderkey")
    if kind:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        rows = rows.join(parts, rows.l_partkey == parts.p_partkey).drop("p_partkey")
        chain = F
        for (part_type, status), name in CLASS_OF.items():
            chain = chain.when((F.col("p_type") == part_type) & (F.col("l_linestatus") == status), F.lit(name))
        rows = rows.withColumn("type", chain).drop("p_type")
    tagged = (F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1)
    rows = rows.withColumns({
        "chr": F.col("l_linenumber"),
        "start": F.col("l_partkey"),
        "end": F.col("l_partkey") + 1,
        "label": F.concat("l_returnflag", "l_linestatus", F.when(tagged, F.lit("-wga")).otherwise(F.lit(""))),
        "t_depth": F.col("l_quantity").cast("int"),
        "t_alt": F.floor(F.col("l_quantity") * F.col("l_discount") * 5).cast("int"),
        "hot": F.col("l_tax") >= 0.07,
    })
    return rows.withColumn("vaf", F.try_divide(F.col("t_alt").cast("double"), F.col("t_depth").cast("double")))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their nation as samples and studies."""
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    named = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return named.select(F.col("c_custkey").alias("sample"), F.col("n_name").alias("study"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as panel intervals, brands as panels."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("panel"),
        (F.col("p_size") % 7 + 1).alias("chr"),
        F.col("p_partkey").alias("istart"),
        (F.col("p_partkey") + F.col("p_size")).alias("iend"),
    )


def panel_variants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Variants inside each panel with exome burden and train/test mark, and the panel lengths."""
    called = variants(spark, sf_dir).select("sample", "chr", "start", "end", "type", "vaf", "hot")
    rated = attach_burden(called, RULES).withColumn("rate", burden_flag(F.col("wesTMB"), RULES))
    panels = intervals(spark, sf_dir)
    placed = overlap_join(hash_split(rated, ["sample"]), panels)
    return placed.drop("chr", "start", "end", "istart", "iend"), panel_length(panels)


def _sql_list(items: list[str]) -> str:
    return ", ".join(f"'{item}'" for item in items)


_CLASS_SQL = " ".join(
    f"WHEN p_type = '{part_type}' AND l_linestatus = '{status}' THEN '{name}'"
    for (part_type, status), name in CLASS_OF.items()
)

# Common table expressions; each is a list item so that a query can chain what it needs.
V = f"""
v AS (
  SELECT l.* EXCLUDE (l_shipdate), o_custkey AS sample, CASE {_CLASS_SQL} END AS type,
    l_linenumber AS chr, l_partkey AS start, l_partkey + 1 AS "end",
    l_returnflag || l_linestatus || CASE WHEN l_quantity = 50 AND l_discount = 0.1 THEN '-wga' ELSE '' END AS label,
    CAST(l_quantity AS INTEGER) AS t_depth,
    CAST(floor(l_quantity * l_discount * 5) AS INTEGER) AS t_alt,
    l_tax >= 0.07 AS hot,
    CAST(CAST(floor(l_quantity * l_discount * 5) AS INTEGER) AS DOUBLE) / CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS vaf
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""
CLINICAL = """
clinical AS (SELECT c_custkey AS sample, n_name AS study FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
STUDIED = f"""
studied AS (SELECT v.*, study FROM v JOIN clinical USING (sample) WHERE study IN ({_sql_list(STUDIES)}))"""
INTERVALS = """
iv AS (
  SELECT p_brand AS panel, p_size % 7 + 1 AS chr, p_partkey AS istart, p_partkey + p_size AS iend FROM part
)"""
LENGTHS = """
lengths AS (SELECT panel, CAST(sum(iend - istart) AS DOUBLE) / 1e6 AS panel_mb FROM iv GROUP BY panel)"""
BURDEN_TEST = f"(vaf >= 0.05 AND type IN ({_sql_list(RULES.burden_classes)}))"
SITE_TEST = f"(type IN ({_sql_list(RULES.site_classes)}) AND t_depth >= 25 AND t_alt >= 3)"


def draw(seed: str, *keys: str) -> str:
    """SQL twin of ``uniform_hash``."""
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 8) AS BIGINT)"


RATED = f"""
burden AS (
  SELECT sample, CASE WHEN count(*) FILTER (WHERE {BURDEN_TEST}) > 0
    THEN count(*) FILTER (WHERE {BURDEN_TEST}) / 0.7::DOUBLE END AS wesTMB
  FROM v GROUP BY sample
),
rated AS (
  SELECT v.*, wesTMB, wesTMB IS NULL OR wesTMB >= 10 AS rate, {draw('41', 'sample')} < 858993459 AS is_test
  FROM v JOIN burden USING (sample)
)"""
PLACED = """
placed AS (
  SELECT iv.panel, rated.* FROM rated JOIN iv
  ON rated.chr = iv.chr AND rated.start < iv.iend AND rated."end" > iv.istart
)"""


def with_(*tables: str) -> str:
    return "WITH " + ",".join(tables) + "\n"
