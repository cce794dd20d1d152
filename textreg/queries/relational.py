"""Joins, aggregations, reshaping, ordering, set operations, splits and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textreg.functions import numeric as N
from textreg.functions import text as T
from textreg.functions.stopwords import ENGLISH
from textreg.operators import aggregates as A
from textreg.operators import lemmas as LM
from textreg.operators import quality as Q
from textreg.operators import reshape as R
from textreg.operators import shaping as S
from textreg.operators import splits as SP
from textreg.operators.sets import difference_counts, venn_regions
from textreg.plans.ordering import add_row_index, page_ranks, running_count, shift_features, top_per_group
from textreg.plans.skew import lookup_join
from textreg.plans.stage import write_stage
from textreg.queries.registry import query
from textreg.streaming.incremental import new_keys

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# The distinct two-word names split into a word list; stands in for multi-valued text.
LISTED = "replace(p_name, ' ', ' , ')"


# ---- joins ----

@query("left_join_fill_zero", """
    with flags as (select user_id as c_custkey, max(1) as seen, sum(value) as spent from events where event_type = 'purchase' group by 1)
    select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment, coalesce(seen, 0) as seen, round(coalesce(spent, 0), 2) as spent
    from customer left join flags using (c_custkey)""")
def left_join_fill_zero(t):
    flags = t.events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.max(F.lit(1)).alias("seen"), F.sum("value").alias("spent")
    )
    base = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return S.left_join_fill_zero(base, flags, "c_custkey").withColumn("spent", F.round("spent", 2))


@query("left_join_on_date", """
    with daily as (select cast(ts - interval 26 year as date) as day, avg(value) as rate from events group by 1)
    select o_orderkey, round(rate, 6) as rate from orders left join daily on cast(o_orderdate as date) = day""")
def left_join_on_date(t):
    daily = t.events.groupBy((F.col("ts") - F.expr("interval 26 years")).cast("date").alias("day")).agg(F.avg("value").alias("rate"))
    dated = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return lookup_join(dated, daily, "day", "left", spread_by="o_orderkey").select("o_orderkey", F.round("rate", 6).alias("rate"))


@query("inner_join_two_keys_suffix", """
    with songs as (select p_partkey, lower(strip_accents(replace(p_name, ' ', '_'))) as k1,
        case when p_partkey % 10 = 0 then null else lower(p_brand) end as k2, p_type as kind from part),
    other as (select lower(strip_accents(replace(p_name, ' ', '_'))) as k1, lower(p_brand) as k2, min(p_partkey) as song_id, max(p_type) as kind
      from part group by 1, 2)
    select songs.k1 as key_title, songs.k2 as key_artist, p_partkey, songs.kind, song_id, other.kind as kind_spotify
    from songs join other on songs.k1 = other.k1 and songs.k2 = other.k2""")
def inner_join_two_keys_suffix(t):
    keys = {"key_title": T.title_key("p_name"), "key_artist": T.title_key("p_brand")}
    songs = t.part.select("p_partkey", F.col("p_type").alias("kind"), keys["key_title"].alias("key_title"),
                          F.when(F.col("p_partkey") % 10 != 0, keys["key_artist"]).alias("key_artist"))
    other = t.part.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(
        F.min("p_partkey").alias("song_id"), F.max("p_type").alias("kind")
    )
    return S.inner_join_on_keys(songs, other, ["key_title", "key_artist"], "_spotify")


# The monthly history of a song is the order history of a customer.
STREAMS_SQL = """
    WITH history AS (
      SELECT DISTINCT o_custkey AS song_id, CAST({month} AS date) AS month, CAST(floor(o_totalprice) AS bigint) AS streams FROM orders),
    cutoff AS (
      SELECT song_id, CAST({plus_six} AS date) AS cutoff FROM history WHERE streams > 0 GROUP BY song_id)
    SELECT c.c_custkey AS song_id, c.c_name AS title, h.streams
    FROM customer c LEFT JOIN history h ON c.c_custkey = h.song_id
    INNER JOIN cutoff d ON h.song_id = d.song_id AND h.month = d.cutoff"""


@query("left_then_inner_join", STREAMS_SQL.format(
    month="date_trunc('month', o_orderdate)", plus_six="min(month) + interval 6 month"))
def left_then_inner_join(t):
    text = STREAMS_SQL.format(month="date_trunc('MONTH', o_orderdate)", plus_six="add_months(min(month), 6)")
    text = text.replace("FROM customer c", "FROM {customer} c").replace("orders", "{orders}")
    return t.spark.sql(text, customer=t.customer, orders=t.orders)


@query("semi_join_title_in_both", """
    with t as (select doc_id, source, md5(lower(text)) as title from documents)
    select doc_id, title from t where source = 'src0' and title in (select title from t where source <> 'src0')""")
def semi_join_title_in_both(t):
    titles = t.documents.select("doc_id", "source", F.md5(F.lower("text")).alias("title"))
    others = titles.filter("source <> 'src0'").select("title").distinct()
    return lookup_join(titles.filter("source = 'src0'"), others, "title", "left_semi", spread_by="doc_id").select("doc_id", "title")


@query("anti_join_new_keys", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti_join_new_keys(t):
    return new_keys(t.documents.select("doc_id", "lang"), t.labels, "doc_id", spread_by="doc_id")


@query("positional_column_attach", """
    select d.i as row_index, d.doc_id, cast(l.toxic as bigint) as toxic
    from (select row_number() over (order by doc_id) - 1 as i, doc_id from documents) d
    left join (select row_number() over (order by doc_id) - 1 as i, toxic from labels) l on d.i = l.i""")
def positional_column_attach(t):
    rows = add_row_index(t.documents.select("doc_id"), "doc_id")
    screening = add_row_index(t.labels.select("doc_id", F.col("toxic").cast("bigint").alias("toxic")), "doc_id").drop("doc_id")
    return rows.join(screening, "row_index", "left")


# ---- aggregations ----

@query("value_counts_desc", 'select event_type, count(*) as "count" from events group by 1')
def value_counts_desc(t):
    return A.value_counts(t.events, "event_type")


@query("value_counts_two_keys", 'select l_returnflag, l_linestatus, count(*) as "count" from lineitem group by 1, 2')
def value_counts_two_keys(t):
    return A.value_counts(t.lineitem, "l_returnflag", "l_linestatus")


@query("group_len_pairs", """
    with a as (select p_partkey, unnest(string_split(p_name, ' ')) as x, p_brand, p_type from part),
    b as (select x, unnest([p_brand, p_type]) as y from a)
    select x, y, count(*) as len from b group by 1, 2""")
def group_len_pairs(t):
    doubled = R.split_explode(t.part, "p_name", "x", " ").select("x", F.explode(F.array("p_brand", "p_type")).alias("y"))
    return R.pair_counts(doubled, "x", "y")


@query("group_count_distinct_id", "select o_orderstatus, count(distinct o_custkey) as len from orders group by 1")
def group_count_distinct_id(t):
    return A.distinct_counts(t.orders, "o_custkey", "o_orderstatus")


@query("group_count_distinct_pair", """
    select l_returnflag, cast(l_quantity as bigint) as quantity, count(distinct l_orderkey) as len from lineitem group by 1, 2""")
def group_count_distinct_pair(t):
    rows = t.lineitem.select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("quantity"))
    return A.distinct_counts(rows, "l_orderkey", "l_returnflag", "quantity")


@query("group_mean_dedup_fanout", """
    select o_custkey, o_orderpriority, round(avg(o_totalprice), 5) as o_totalprice from orders group by 1, 2""")
def group_mean_dedup_fanout(t):
    copies = t.orders.select("o_custkey", "o_orderpriority", "o_totalprice", F.explode(F.array(F.lit(1), F.lit(2))))
    return A.mean_per(copies, ["o_custkey", "o_orderpriority"], "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 5))


@query("group_median_order", """
    select nullif(l_suppkey, 1) as l_suppkey, round(median(l_extendedprice), 4) as median from lineitem group by 1""")
def group_median_order(t):
    lines = t.lineitem.withColumn("l_suppkey", F.nullif("l_suppkey", F.lit(1)))
    return A.median_order(lines, "l_suppkey", "l_extendedprice").withColumn("median", F.round("median", 4))


@query("boxplot_summary", """
    with l as (select nullif(l_returnflag, 'R') as l_returnflag, l_extendedprice from lineitem),
    q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as median,
        quantile_cont(l_extendedprice, 0.75) as q3 from l group by 1),
    f as (select l.l_returnflag, q1, median, q3, l_extendedprice as x,
        l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
        from l join q on l.l_returnflag is not distinct from q.l_returnflag)
    select l_returnflag, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3,
      min(x) filter (inside) as whisker_low, max(x) filter (inside) as whisker_high, count(*) filter (not inside) as n_outliers
    from f group by f.l_returnflag, f.q1, f.median, f.q3""")
def boxplot_summary(t):
    lines = t.lineitem.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    box = A.boxplot_summary(lines, "l_returnflag", "l_extendedprice")
    return box.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("scaled_percent_round", """
    select l_returnflag, l_linestatus, round(avg(l_discount) * 100, 2) as gain_pct from lineitem group by 1, 2""")
def scaled_percent_round(t):
    means = A.mean_per(t.lineitem, ["l_returnflag", "l_linestatus"], "l_discount")
    return means.select("l_returnflag", "l_linestatus", N.percent("l_discount").alias("gain_pct"))


@query("relative_efficiency", """
    with a as (select l_orderkey, l_returnflag, avg(l_discount) as gain, avg(ln(l_quantity)) as log_size from lineitem group by 1, 2)
    select l_returnflag, round(avg(gain / exp(log_size)) * 100, 2) as relative_efficiency from a group by 1""")
def relative_efficiency(t):
    sized = t.lineitem.withColumn("log_size", F.log("l_quantity"))
    return A.relative_efficiency(sized, "l_orderkey", "l_returnflag", "l_discount", "log_size")


@query("row_sum_order", """
    select l_suppkey, cast(count(distinct (l_returnflag, l_orderkey)) as bigint) as total from lineitem group by 1""")
def row_sum_order(t):
    table = R.crosstab_distinct(t.lineitem, "l_orderkey", "l_suppkey", "l_returnflag")
    return R.row_sum_order(table, "l_suppkey")


@query("min_per_group_plus_interval", """
    select o_custkey, strftime(min(o_orderdate) + interval 6 month, '%Y-%m-%d') as cutoff from orders where o_totalprice > 1000 group by 1""")
def min_per_group_plus_interval(t):
    first = t.orders.filter("o_totalprice > 1000").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return first.select("o_custkey", F.date_format(F.add_months("first", 6), "yyyy-MM-dd").alias("cutoff"))


@query("collect_list_group_all_but_one", """
    with counted as (select md5(text) as title, lang, source, count(*) as n from documents group by 1, 2, 3)
    select title, lang, string_agg(source || ':' || n, '|' order by source) as categories, cast(sum(n) as bigint) as n from counted group by 1, 2""")
def collect_list_group_all_but_one(t):
    grouped = A.collect_categories(t.documents.select(F.md5("text").alias("title"), "lang", "source"), "source")
    shown = F.transform("categories", lambda e: F.concat_ws(":", e["category"], e["n"]))
    total = F.aggregate("categories", F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])
    return grouped.select("title", "lang", F.array_join(shown, "|").alias("categories"), total.alias("n"))


@query("ordered_concat_transform", """
    select conv_id, md5(string_agg(text, chr(10) || chr(10) order by turn)) as lyrics_md5 from conversations group by 1""")
def ordered_concat_transform(t):
    return A.ordered_concat(t.conversations, ["conv_id"], "turn", "text").select("conv_id", F.md5("text").alias("lyrics_md5"))


@query("or_join_strings", """
    select p_brand, string_agg('(' || p_name || ')', ' OR ' order by p_partkey) as query from part group by 1""")
def or_join_strings(t):
    return A.or_joined(t.part, "p_brand", "p_name", "p_partkey")


@query("cv_summary", """
    select l_returnflag as dataset_name, l_linestatus as embedding_strategy, cast(l_linenumber as varchar) as model_name,
      round(avg(l_quantity), 6) as rmse_mean, round(stddev_samp(l_quantity), 6) as rmse_std,
      round(avg(l_discount), 6) as r2_mean, round(stddev_samp(l_discount), 6) as r2_std from lineitem group by 1, 2, 3""")
def cv_summary(t):
    scores = t.lineitem.select(
        F.col("l_returnflag").alias("dataset_name"), F.col("l_linestatus").alias("embedding_strategy"),
        F.col("l_linenumber").cast("string").alias("model_name"), F.col("l_quantity").alias("rmse"), F.col("l_discount").alias("r2"),
    )
    return A.cv_summary(scores).withColumns({c: F.round(c, 6) for c in ("rmse_mean", "rmse_std", "r2_mean", "r2_std")})


@query("rmse_r2", """
    with p as (select o_orderstatus, o_totalprice as y, o_totalprice * 0.9 + o_custkey as z from orders)
    select o_orderstatus, round(sqrt(avg((y - z) * (y - z))), 4) as rmse, round(1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 6) as r2 from p group by 1""")
def rmse_r2(t):
    p = t.orders.select("o_orderstatus", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("z"))
    scores = A.regression_scores(p, "y", "z", "o_orderstatus")
    return scores.select("o_orderstatus", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


STOPS_SQL = ", ".join(f"'{w}'" for w in ENGLISH)
TOKEN_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"


@query("term_frequencies_top_n", rf"""
    with tok as (select regexp_replace(unnest({TOKEN_SQL}), '[^a-z]', '', 'g') as w from documents),
    words as (select w, count(*) as n from tok where w <> '' and w not in ({STOPS_SQL}) group by 1),
    based as (select coalesce(b.w, a.w) as term, a.n from words a left join words b on a.w = b.w || 's')
    select term, cast(sum(n) as bigint) as "count" from based group by 1 having sum(n) > 1 order by 2 desc, 1 limit 150""")
def term_frequencies_top_n(t):
    counts = write_stage(A.word_counts(t.documents, "text", ENGLISH), "word-counts")
    plurals = counts.select(F.concat("word", F.lit("s")).alias("word"), F.col("word").alias("base"))
    return A.term_frequencies(counts, plurals)


# Irregular forms of the registered query; a job passes its own table.
IRREGULAR = [("men", "man"), ("children", "child"), ("thes", "the"), ("mice", "mouse")]
_RULES = "(values " + ", ".join(f"({k + 1}, '{a}', '{b}')" for k, (a, b) in enumerate(LM.DETACHMENTS)) + ") as r(rule, old, new)"


@query("term_frequencies_lemmas", rf"""
    with tok as (select regexp_replace(unnest({TOKEN_SQL}), '[^a-z]', '', 'g') as w from documents),
    words as (select w, count(*) as n from tok where w <> '' and w not in ({STOPS_SQL}) group by 1),
    candidates as (select w, 0 as rule, w as base from words
      union all select w, rule, left(w, length(w) - length(old)) || new from words, {_RULES} where ends_with(w, old)),
    best as (select c.w, arg_min(c.base, length(c.base) * 100 + c.rule) as base from candidates c join (select w from words where n > 1) l on l.w = c.base group by 1),
    irregular as (select * from (values {", ".join(str(x) for x in IRREGULAR)}) as i(w, base)),
    based as (select coalesce(i.base, b.base, a.w) as term, n from words a left join best b using (w) left join irregular i using (w))
    select term, cast(sum(n) as bigint) as "count" from based group by 1 having sum(n) > 1 order by 2 desc, 1 limit 150""")
def term_frequencies_lemmas(t):
    """The most frequent base forms; words that occur more than once serve as the lexicon."""
    counts = write_stage(A.word_counts(t.documents, "text", ENGLISH), "word-counts")
    irregular = t.spark.createDataFrame(IRREGULAR, "word string, base string")
    return A.term_frequencies(counts, LM.base_forms(counts, counts.filter("count > 1"), irregular))


@query("funnel_counts", """
    select 0 as step, 'input' as stage, count(*) as n from lineitem
    union all select 1, 'recent', count(*) from lineitem where l_shipdate >= timestamp '1998-01-01'
    union all select 2, 'cited', count(*) from lineitem where l_shipdate >= timestamp '1998-01-01' and l_quantity > 10
    union all select 3, 'kept', count(*) from lineitem where l_shipdate >= timestamp '1998-01-01' and l_quantity > 10 and l_returnflag <> 'R'""")
def funnel_counts(t):
    return A.funnel_counts(t.lineitem, {
        "recent": F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"),
        "cited": F.col("l_quantity") > 10, "kept": F.col("l_returnflag") != "R",
    })


@query("max_list_length", "select max(len(embedding)) :: integer as max_length from embeddings")
def max_list_length(t):
    return A.max_list_length(t.embeddings, "embedding")


# ---- reshape ----

@query("split_explode_trim", """
    select p_partkey, trim(unnest(string_split(coalesce(nullif(replace(p_name, ' ', ' , '), 'red , bolt'), ''), ','))) as word
    from part where p_name <> 'red bolt' union all select p_partkey, null from part where p_name = 'red bolt'""")
def split_explode_trim(t):
    listed = t.part.select("p_partkey", F.nullif(F.expr(LISTED), F.lit("red , bolt")).alias("words"))
    return R.split_explode(listed, "words", "word").select("p_partkey", "word")


@query("explode_list_with_null", """
    with l as (select conv_id, turn, case when turn = 0 then [] else string_split(text, '. ') end as s from conversations)
    select conv_id, turn, cast(i - 1 as integer) as pos, s[i] as sentence from (select conv_id, turn, s, unnest(range(1, len(s) + 1)) as i from l)
    union all select conv_id, turn, null, null from l where len(s) = 0""")
def explode_list_with_null(t):
    lists = t.conversations.select("conv_id", "turn", F.when(F.col("turn") == 0, F.array().cast("array<string>")).otherwise(
        F.split("text", r"\. ")).alias("sentence"))
    return R.explode_paragraphs(lists, "sentence")


@query("double_explode_cross", """
    with a as (select p_partkey, unnest(string_split(p_name, ' ')) as word, p_brand, p_type from part)
    select p_partkey, word, unnest([p_brand, p_type]) as tag from a""")
def double_explode_cross(t):
    words = R.split_explode(t.part.select("p_partkey", "p_name", F.concat_ws(",", "p_brand", "p_type").alias("tags")), "p_name", "word", " ")
    return R.split_explode(words, "tags", "tag").select("p_partkey", "word", "tag")


@query("protect_then_split", """
    with s as (select p_partkey, unnest(string_split(replace(p_brand || ', Deep (A, B, & C), ' || p_type || ' & more & so', '(A, B, & C)', '(A & B & C)'), ',')) as part_text from part)
    select p_partkey, trim(regexp_replace(part_text, ' & ', ', ')) as class from s""")
def protect_then_split(t):
    listed = t.part.select("p_partkey", F.concat("p_brand", F.lit(", Deep (A, B, & C), "), "p_type", F.lit(" & more & so")).alias("classes"))
    return R.protect_then_split(listed, "classes", "(A, B, & C)", "class").select("p_partkey", "class")


@query("pivot_flag_max_fill", "select user_id, " + ", ".join(
    f"cast(max(case when event_type = '{v}' then 1 else 0 end) as integer) as {v}" for v in EVENT_TYPES) + " from events group by 1")
def pivot_flag_max_fill(t):
    return R.pivot_flags(t.events, "user_id", "event_type")


@query("pivot_sum_crosstab", "select l_suppkey, " + ", ".join(
    f"count(distinct l_orderkey) filter (l_returnflag = '{v}') as {v}" for v in "ANR") + " from lineitem group by 1")
def pivot_sum_crosstab(t):
    return R.crosstab_distinct(t.lineitem, "l_orderkey", "l_suppkey", "l_returnflag")


# Orders outnumber the columns that a table can have.
@query("pivot_sum_crosstab_sparse", """
    with c as (select l_orderkey, row_number() over (order by l_orderkey) - 1 as i from (select distinct l_orderkey from lineitem)),
    e as (select l_suppkey, l_orderkey, count(*) as n from lineitem group by 1, 2)
    select l_suppkey, string_agg(i || ':' || n, ',' order by i) as entries, (select count(*) from c) as n_columns from e join c using (l_orderkey) group by 1""")
def pivot_sum_crosstab_sparse(t):
    rows = R.sparse_crosstab(t.lineitem, "l_suppkey", "l_orderkey", F.lit(1)).rows
    pairs = F.zip_with("column_indices", "column_values", lambda i, v: F.concat_ws(":", i, v))
    return rows.select("l_suppkey", F.array_join(pairs, ",").alias("entries"), "n_columns")


@query("pivot_mean_crosstab", """
    with a as (select l_orderkey, l_linenumber, l_linestatus, round(avg(l_extendedprice / 7e5) / exp(avg(ln(l_quantity + 0.3))) * 100, 2) as e from lineitem group by 1, 2, 3)
    select l_linenumber, round(coalesce(avg(e) filter (l_linestatus = 'F'), 0), 4) as F, round(coalesce(avg(e) filter (l_linestatus = 'O'), 0), 4) as O from a group by 1""")
def pivot_mean_crosstab(t):
    sized = t.lineitem.withColumns({"gain": F.col("l_extendedprice") / 7e5, "log_size": F.log(F.col("l_quantity") + 0.3)})
    cells = A.relative_efficiency_pairs(sized, "l_orderkey", "l_linenumber", "l_linestatus", "gain", "log_size")
    table = R.crosstab(cells, "l_linenumber", "l_linestatus", "relative_efficiency", "mean")
    return table.withColumns({c: F.round(c, 4) for c in table.columns if c != "l_linenumber"})


@query("dense_list_to_columns", "select vec_id, " + ", ".join(
    f"cast(embedding[{i}] as double) as emb_{i}" for i in range(1, 65)) + " from embeddings")
def dense_list_to_columns(t):
    wide = R.dense_to_columns(t.embeddings.drop("label"))
    return wide.select("vec_id", *[F.col(c).cast("double").alias(c) for c in wide.columns if c != "vec_id"])


@query("attach_embedding_payload", """
    select vec_id as row_index, label, round(cast(embedding[1] as double), 6) as first, cast(len(embedding) as integer) as n,
      'Word2Vec' as embedding_method, 'dense' as embedding_storage from embeddings""")
def attach_embedding_payload(t):
    base = t.embeddings.select(F.col("vec_id").alias("row_index"), "label")
    payload = t.embeddings.select(F.col("vec_id").alias("row_index"), "embedding")
    full = R.attach_payload(base, payload, "Word2Vec", "dense")
    return full.select("row_index", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"),
                       F.size("embedding").alias("n"), "embedding_method", "embedding_storage")


# ---- ordering ----

SERIES = "select event_id, value, row_number() over (order by ts, event_id) - 1 as row_index from events"


def _series(t):
    return add_row_index(t.events.select("ts", "event_id", "value"), ["ts", "event_id"]).drop("ts")


@query("lead_next_value", f"with s as ({SERIES}) select *, lead(value) over (order by row_index) as next_value from s")
def lead_next_value(t):
    return shift_features(_series(t), {"next_value": ("value", 1)})


@query("next_minus_current", f"""
    with s as ({SERIES}), n as (select *, lead(value) over (order by row_index) as nx from s)
    select event_id, round(nx - value, 6) as next_var from n where nx is not null""")
def next_minus_current(t):
    moved = shift_features(_series(t), {"nx": ("value", 1)}).dropna(subset=["nx"])
    return moved.select("event_id", F.round(F.col("nx") - F.col("value"), 6).alias("next_var"))


@query("lag_features", f"with s as ({SERIES}) select event_id, " + ", ".join(
    f"lag(value, {k}) over (order by row_index) as lag_{k}, round(value - lag(value, {k}) over (order by row_index), 6) as var_lag_{k}"
    for k in range(1, 7)) + " from s")
def lag_features(t):
    lagged = shift_features(_series(t), {f"lag_{k}": ("value", -k) for k in range(1, 7)})
    changes = [F.round(F.col("value") - F.col(f"lag_{k}"), 6).alias(f"var_lag_{k}") for k in range(1, 7)]
    return lagged.select("event_id", *[f"lag_{k}" for k in range(1, 7)], *changes)


@query("running_count_non_null", """
    select conv_id, turn, count(nullif(role, 'system')) over (partition by conv_id order by turn rows unbounded preceding) as paragraph from conversations""")
def running_count_non_null(t):
    rows = t.conversations.select("conv_id", "turn", F.nullif("role", F.lit("system")).alias("role"))
    return running_count(rows, "conv_id", "turn", "role", "paragraph").drop("role")


@query("sequence_id", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as sequencia from orders")
def sequence_id(t):
    return add_row_index(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "sequencia").drop("o_orderdate")


@query("sort_multi", "select o_orderkey, o_orderpriority, o_totalprice from orders")
def sort_multi(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_orderpriority"), "o_totalprice", "o_orderkey")


@query("top_n_per_genre", """
    select o_orderpriority, o_orderkey, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as integer) as rank
    from orders qualify rank <= 50""")
def top_n_per_genre(t):
    ranked = top_per_group(t.orders, "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 50)
    return ranked.select("o_orderpriority", "o_orderkey", "rank")


@query("page_rank_offset", """
    with r as (select event_type, event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)
    select event_type, event_id, i // 10 + 1 as nr_page, (i // 10) * 10 + i % 10 + 1 as nr_order from r""")
def page_rank_offset(t):
    hits = page_ranks(t.events.select("event_type", "event_id", "ts"), "event_type", ["ts", "event_id"], "event_id")
    return hits.select("event_type", "event_id", "nr_page", "nr_order")


@query("drop_duplicates", "select distinct l_suppkey, l_returnflag, l_quantity from lineitem")
def drop_duplicates(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_quantity").dropDuplicates()


# ---- sets ----

@query("union_all_by_name", """
    select c_name as title, c_mktsegment as segment, c_acctbal as balance from customer
    union all select s_name, null, s_acctbal from supplier""")
def union_all_by_name(t):
    first = t.customer.select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    second = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("title"))
    return first.unionByName(second, allowMissingColumns=True)


TITLES = "(select md5(lower(trim(text))) as title, source in ('src0', 'src1', 'src2') as a from documents)"


def _titles(t, first: bool):
    mine = F.col("source").isin("src0", "src1", "src2")
    return t.documents.filter(mine if first else ~mine).select(F.md5(T.strip_lower("text")).alias("title"))


@query("set_difference_count", f"""
    select (select count(*) from (select title from {TITLES} where a except select title from {TITLES} where not a)) as only_first,
      (select count(*) from (select title from {TITLES} where not a except select title from {TITLES} where a)) as only_second""")
def set_difference_count(t):
    return difference_counts(_titles(t, True), _titles(t, False), ["title"])


@query("set_intersection_count", f"select title from {TITLES} where a intersect select title from {TITLES} where not a")
def set_intersection_count(t):
    return _titles(t, True).intersect(_titles(t, False))


@query("venn_regions", f"""
    with per as (select title, bool_or(a) as ina, bool_or(not a) as inb from {TITLES} group by 1)
    select count(*) filter (ina and not inb) as only_first, count(*) filter (inb and not ina) as only_second, count(*) filter (ina and inb) as both from per""")
def venn(t):
    mine = F.col("source").isin("src0", "src1", "src2")
    return venn_regions(t.documents, "text", mine, ~mine)


# ---- splits ----

@query("split_sorted", """
    with n as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as row_index from orders)
    select o_orderkey, row_index, case when row_index < cast(floor((select count(*) from orders) * 0.8) as bigint) then 'train' else 'test' end as set from n""")
def split_sorted(t):
    return SP.split_sorted(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("split_shuffled", """
    with n as (select doc_id, row_number() over (order by md5('42:' || doc_id)) - 1 as r from documents)
    select doc_id, case when r < cast(floor((select count(*) from documents) * 0.8) as bigint) then 'train' else 'test' end as set from n""")
def split_shuffled(t):
    return SP.split_shuffled(t.documents.select("doc_id"), "doc_id")


@query("repeated_kfold", """
    with c as (select count(*) as n from documents), r as (select doc_id, repeat, row_number() over (partition by repeat order by md5('42:' || repeat || ':' || doc_id)) - 1 as i
      from documents, (select unnest([0, 1, 2]) as repeat))
    select doc_id, cast(repeat as integer) as repeat, cast(case when i < (n % 5) * (n // 5 + 1) then i // (n // 5 + 1) else n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) end as integer) as fold from r, c""")
def repeated_kfold(t):
    return SP.repeated_kfold(t.documents.select("doc_id"), "doc_id")


# ---- checks ----

@query("assert_alignment", """
    select count(*) as base_rows, count(toxic) as result_rows, count(*) - count(toxic) as unmatched,
      count(*) - count(*) filter (toxic = 0) as target_differs, cast(0 as bigint) as index_gaps from documents left join labels using (doc_id)""")
def assert_alignment(t):
    base = t.documents.select(F.col("doc_id").alias("row_index"), F.col("n_chars").alias("y"))
    coded = t.labels.select(F.col("doc_id").alias("row_index"), "toxic")
    result = base.join(coded, "row_index").select("row_index", (F.col("y") + F.col("toxic")).alias("y"))
    return Q.alignment_violations(base, result, "y")


@query("assert_row_count", """
    select (select count(*) from documents) as source_rows, (select count(*) from labels) as feature_rows,
      cast((select count(*) from documents) = (select count(*) from labels) as integer) as equal""")
def assert_row_count(t):
    return Q.row_count_check(t.documents, t.labels)


@query("find_error_rows", "select event_id, 'bad value' as erro from events where event_type = 'error'")
def find_error_rows(t):
    erro = F.when(F.col("event_type") == "error", F.lit("bad value"))
    return t.events.select("event_id", erro.alias("erro")).filter(F.col("erro").isNotNull())
