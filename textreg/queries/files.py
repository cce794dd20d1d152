"""Sources and sinks: each query writes what it derives from the tables, then reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textreg.functions.text import category_from_filename as file_category
from textreg.plans.stage import stage_path
from textreg.queries.registry import query
from textreg.sources import files as IO
from textreg.streaming.incremental import read_partitioned, upsert_partition


@query("scan_csv_dialect", """
    select cast(c_custkey as varchar) as id, 'Imóvel nº ' || c_custkey || '; ' || c_mktsegment as title,
      replace(cast(c_acctbal as varchar), '.', ',') as price from customer""")
def scan_csv_dialect(t):
    path = stage_path(t.spark, "ads-csv")
    t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("Imóvel nº "), "c_custkey", F.lit("; "), "c_mktsegment").alias("title"),
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("price"),
    ).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return IO.read_csv_dialect(t.spark, path, "id string, title string, price string")


@query("scan_csv_union_filename", """
    select p_partkey, p_brand || ', "' || p_name || '"' as title, p_type as origin from part""")
def scan_csv_union_filename(t):
    path = stage_path(t.spark, "search-csv")
    t.part.select("p_partkey", F.concat("p_brand", F.lit(', "'), "p_name", F.lit('"')).alias("title"), "p_type").write.partitionBy(
        "p_type").option("header", True).option("escape", '"').csv(path)
    tagged = IO.read_csv_files(t.spark, f"{path}/p_type=*", "p_partkey bigint, title string")
    return tagged.select("p_partkey", "title", F.regexp_extract("filename", "p_type=([^/]+)/", 1).alias("origin"))


@query("category_from_filename", """
    select page_id, replace(split_part(url || '_results_' || (page_id % 7) || '.csv', '_', -1), '.csv', '') as category from pages""")
def category_from_filename(t):
    name = F.concat("url", F.lit("_results_"), F.col("page_id") % 7, F.lit(".csv"))
    return t.pages.select("page_id", file_category(name).alias("category"))


@query("scan_parquet_glob_projected", "select o_totalprice from orders")
def scan_parquet_glob_projected(t):
    return IO.read_columns(t.spark, f"{t.folder}/order*.parquet", "o_totalprice", sort_by="o_orderkey")


@query("scan_json_categories", "select distinct p_brand as category, p_name as search_string from part")
def scan_json_categories(t):
    path = stage_path(t.spark, "categories-json")
    strings = t.part.select("p_brand", "p_name").distinct().groupBy("p_brand").agg(F.array_sort(F.collect_list("p_name")).alias("s"))
    entry = F.struct(F.col("p_brand").alias("category"), F.col("s").alias("search_strings"))
    strings.select("p_brand", F.to_json(F.array(entry)).alias("value")).write.partitionBy("p_brand").text(path)
    return IO.read_search_strings(t.spark, path)


ENUMERATED = """
    with numbered as (select row_number() over (order by o_orderdate, o_orderkey) as i, o_totalprice from orders)"""


@query("scan_enumerated_text", ENUMERATED + " select i - 1 as row_index, o_totalprice as target from numbered")
def scan_enumerated_text(t):
    path = stage_path(t.spark, "targets")
    IO.write_enumerated_text(t.orders.select("o_orderdate", "o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderdate", "o_orderkey"], path)
    return IO.read_enumerated_text(t.spark, path)


@query("read_sql_tables", "select * from customer")
def read_sql_tables(t):
    return t.spark.sql("SELECT * FROM {customer}", customer=t.customer)


@query("write_parquet", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def write_parquet(t):
    path = stage_path(t.spark, "abt")
    IO.write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return t.spark.read.parquet(path)


@query("write_enumerated_text", ENUMERATED + " select i || '. ' || o_totalprice as line from numbered")
def write_enumerated_text(t):
    path = stage_path(t.spark, "targets")
    IO.write_enumerated_text(t.orders.select("o_orderdate", "o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderdate", "o_orderkey"], path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("write_csv_skip_empty", "select cast(event_id as varchar) as event_id, event_type, 0 as empty_written from events")
def write_csv_skip_empty(t):
    rows = t.events.select("event_id", "event_type")
    path, no_path = stage_path(t.spark, "events-csv"), stage_path(t.spark, "none-csv")
    IO.write_csv_unless_empty(rows, path)
    wrote = IO.write_csv_unless_empty(rows.filter("event_type = 'no such type'"), no_path)
    return t.spark.read.option("header", True).csv(path).withColumn("empty_written", F.lit(int(wrote)))


@query("upsert_partition", """
    select doc_id, case when source in ('src0', 'src1') then n_chars + 1 else n_chars end as n_chars, source from documents""")
def upsert_partition_query(t):
    path = stage_path(t.spark, "songs")
    docs = t.documents.select("doc_id", "n_chars", "source")
    upsert_partition(docs, path, "source")
    redone = docs.filter(F.col("source").isin("src0", "src1")).withColumn("n_chars", F.col("n_chars") + 1)
    upsert_partition(redone, path, "source")
    upsert_partition(redone, path, "source")
    return read_partitioned(t.spark, path, "doc_id bigint, n_chars bigint, source string")
