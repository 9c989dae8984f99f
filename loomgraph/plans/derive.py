"""Graphs derived from the star-schema tables. ``*_SQL`` are the same derivations for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph

KIND = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions to orders as nodes; belonging, membership, calls and implementations as edges."""
    t = lambda n: table(spark, sf_dir, n)
    i = lambda k, c: (F.lit(k * KIND) + F.col(c).cast("long"))

    def nodes(df: DataFrame, k: int, key: str, label: str, name, complexity=None, file=None) -> DataFrame:
        return df.select(i(k, key).alias("id"), F.lit(label).alias("label"), name.alias("name"), (complexity if complexity is not None else F.lit(None)).cast("int").alias("complexity"), (file if file is not None else F.lit(None)).cast("string").alias("file_path"))

    all_nodes = (
        nodes(t("region"), 1, "r_regionkey", "Project", F.col("r_name"))
        .unionByName(nodes(t("nation"), 2, "n_nationkey", "Package", F.col("n_name")))
        .unionByName(nodes(t("customer"), 3, "c_custkey", "Class", F.col("c_name"), file=F.col("c_mktsegment")))
        .unionByName(nodes(t("supplier"), 4, "s_suppkey", "Interface", F.col("s_name")))
        .unionByName(nodes(t("part"), 5, "p_partkey", "Function", F.col("p_name"), F.col("p_size"), F.col("p_brand")))
        .unionByName(nodes(t("orders"), 6, "o_orderkey", "Method", F.concat(F.lit("order#"), F.col("o_orderkey")), file=F.col("o_orderpriority")))
    )

    def edges(df: DataFrame, src, dst, kind: str, weight=None) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"))

    lines = t("lineitem")
    all_edges = (
        edges(t("nation"), i(2, "n_nationkey"), i(1, "n_regionkey"), "BELONGS_TO")
        .unionByName(edges(t("customer"), i(3, "c_custkey"), i(2, "c_nationkey"), "BELONGS_TO"))
        .unionByName(edges(t("supplier"), i(4, "s_suppkey"), i(2, "s_nationkey"), "BELONGS_TO"))
        .unionByName(edges(t("orders"), i(6, "o_orderkey"), i(3, "o_custkey"), "MEMBER_OF"))
        .unionByName(edges(lines.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q")), i(6, "l_orderkey"), i(5, "l_partkey"), "CALLS", F.col("q")))
        .unionByName(edges(lines.select("l_partkey", "l_suppkey").distinct(), i(5, "l_partkey"), i(4, "l_suppkey"), "IMPLEMENTS"))
    )
    return PropertyGraph(all_nodes, all_edges)


SUPPLY_SQL = """
nodes as (
  select 1000000000 + cast(r_regionkey as bigint) as id, 'Project' as label, r_name as name, cast(null as integer) as complexity, cast(null as varchar) as file_path from region
  union all select 2000000000 + cast(n_nationkey as bigint), 'Package', n_name, null, null from nation
  union all select 3000000000 + c_custkey, 'Class', c_name, null, c_mktsegment from customer
  union all select 4000000000 + s_suppkey, 'Interface', s_name, null, null from supplier
  union all select 5000000000 + p_partkey, 'Function', p_name, p_size, p_brand from part
  union all select 6000000000 + o_orderkey, 'Method', 'order#' || cast(o_orderkey as varchar), null, o_orderpriority from orders),
edges as (
  select 2000000000 + cast(n_nationkey as bigint) as src, 1000000000 + cast(n_regionkey as bigint) as dst, 'BELONGS_TO' as type, cast(1 as double) as weight from nation
  union all select 3000000000 + c_custkey, 2000000000 + c_nationkey, 'BELONGS_TO', 1 from customer
  union all select 4000000000 + s_suppkey, 2000000000 + s_nationkey, 'BELONGS_TO', 1 from supplier
  union all select 6000000000 + o_orderkey, 3000000000 + o_custkey, 'MEMBER_OF', 1 from orders
  union all select 6000000000 + l_orderkey, 5000000000 + l_partkey, 'CALLS', sum(l_quantity) from lineitem group by l_orderkey, l_partkey
  union all select distinct 5000000000 + l_partkey, 4000000000 + l_suppkey, 'IMPLEMENTS', cast(1 as double) from lineitem)
"""


def copart(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts; each calls the part of the next line of the same order, weighted by how often."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst")
    edges = steps.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).select("src", "dst", F.lit("CALLS").alias("type"), "weight")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("Function").alias("label"), F.col("p_name").alias("name"), F.col("p_size").alias("complexity"), F.col("p_brand").alias("file_path"))
    return PropertyGraph(nodes, edges)


def copart2(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Of the same graph the two heaviest successors of each part."""
    g = copart(spark, sf_dir)
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return PropertyGraph(g.nodes, g.edges.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r"))


COPART_SQL = """
copart as (
  select s as src, t as dst, 'CALLS' as type, cast(count(*) as double) as weight
  from (select l_partkey as s, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as t from lineitem)
  where t is not null and s <> t group by s, t)
"""
COPART2_SQL = COPART_SQL + """,
copart2 as (select src, dst, type, weight from (select *, row_number() over (partition by src order by weight desc, dst) as r from copart) where r <= 2)
"""


def repos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, repo_of): orders of customers of one nation that use suppliers of another; a nation is a repo."""
    t = lambda n: table(spark, sf_dir, n)
    edges = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select((F.lit(3 * KIND) + F.col("o_custkey")).alias("src"), (F.lit(4 * KIND) + F.col("l_suppkey")).alias("dst"), F.lit("USES").alias("type"))
    repo_of = t("customer").select((F.lit(3 * KIND) + F.col("c_custkey")).alias("id"), F.col("c_nationkey").alias("repo")).unionByName(t("supplier").select((F.lit(4 * KIND) + F.col("s_suppkey")).alias("id"), F.col("s_nationkey").alias("repo")))
    return edges, repo_of


CROSS_SQL = """
cross_repo as (
  select c_nationkey as src_repo, s_nationkey as dst_repo, 'USES' as type, count(*) as n
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
  where c_nationkey <> s_nationkey group by 1, 2)
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, package, version: a nation's suppliers give a part type in versions made of the part's size."""
    t = lambda n: table(spark, sf_dir, n)
    used = t("lineitem").select("l_partkey", "l_suppkey").distinct().join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    size = F.max("p_size")
    return used.groupBy(F.col("s_nationkey").cast("string").alias("repo"), F.concat("p_brand", F.lit("/"), "p_type").alias("package")).agg(F.concat(F.floor(size / 20).cast("string"), F.lit("."), F.floor(size % 20 / 5).cast("string"), F.lit("."), (size % 5).cast("string")).alias("version"))


VERSIONS_SQL = """
uses as (
  select cast(s_nationkey as varchar) as repo, p_brand || '/' || p_type as package,
    cast(max(p_size) // 20 as varchar) || '.' || cast((max(p_size) % 20) // 5 as varchar) || '.' || cast(max(p_size) % 5 as varchar) as version
  from (select distinct l_partkey, l_suppkey from lineitem) join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2)
"""
