"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textreg.functions import numeric as N
from textreg.functions import text as T
from textreg.functions.html import extract_html
from textreg.operators import shaping as S
from textreg.operators.reshape import explode_paragraphs
from textreg.queries.registry import query

NUMBER_TEXT = "if(event_id % 5 = 0, 'n/a', get_json_object(props, '$.k'))"


@query("cast_fill_numeric", """
    select event_id,
      coalesce(try_cast(case when event_id % 5 = 0 then 'n/a' else json_extract_string(props, '$.k') end as bigint), 0) as k
    from events""")
def cast_fill_numeric(t):
    return t.events.select("event_id", N.cast_fill(F.expr(NUMBER_TEXT)).alias("k"))


@query("decimal_comma_to_double", """
    select o_orderkey, coalesce(try_cast(case when o_orderkey % 7 = 0
        then '1.' || replace(cast(o_totalprice as varchar), '.', '.') else cast(o_totalprice as varchar) end as double), 0) as price
    from orders""")
def decimal_comma_to_double(t):
    comma = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("1."), comma)).otherwise(comma)
    return t.orders.select("o_orderkey", N.decimal_comma_to_double(text).alias("price"))


@query("select_drop_renamed", """
    select c_custkey as id_customer, c_acctbal as vl_balance, c_name as nm_name from customer""")
def select_drop_renamed(t):
    named = t.customer.withColumns(
        {"id_customer": F.col("c_custkey"), "vl_balance": F.col("c_acctbal"), "nm_name": F.col("c_name")}
    )
    return named.drop(*t.customer.columns, "c_not_there")


@query("concat_text_columns", """
    select p_partkey, trim(concat_ws(' ', coalesce(p_name, ''), coalesce(nullif(p_brand, 'Brand#2'), ''),
      coalesce(nullif(p_type, 'PROMO'), ''))) as source_text from part""")
def concat_text_columns(t):
    gaps = t.part.withColumns(
        {"p_brand": F.nullif("p_brand", F.lit("Brand#2")), "p_type": F.nullif("p_type", F.lit("PROMO"))}
    )
    return gaps.select("p_partkey", T.concat_text("p_name", "p_brand", "p_type").alias("source_text"))


@query("rename_columns", """
    select doc_id as sequencia, lang as idioma, n_chars as tamanho from documents""")
def rename_columns(t):
    names = {"doc_id": "sequencia", "lang": "idioma", "n_chars": "tamanho"}
    return t.documents.select(*names).withColumnsRenamed(names)


@query("tag_constant", """
    select c_custkey, c_name, 'customer' as origin, cast(1 as bigint) as value, 'BoW' as embedding_method from customer""")
def tag_constant(t):
    return t.customer.select("c_custkey", "c_name").withColumns(
        {"origin": F.lit("customer"), "value": F.lit(1).cast("bigint"), "embedding_method": F.lit("BoW")}
    )


@query("filter_not_null", """
    select doc_id, cast(quality as bigint) as quality from documents left join labels using (doc_id)
    where quality is not null""")
def filter_not_null(t):
    coded = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return coded.filter(F.col("quality").isNotNull()).withColumn("quality", F.col("quality").cast("bigint"))


@query("filter_year_min", """
    select o_orderkey, cast(year(o_orderdate) as bigint) as year from orders
    where case when o_orderkey % 11 = 0 then null else year(o_orderdate) end >= 1999""")
def filter_year_min(t):
    year = F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate"))
    return t.orders.filter(year >= 1999).select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))


@query("filter_compound", """
    select c_custkey, c_acctbal from customer where c_acctbal > 0 and nullif(c_mktsegment, 'BUILDING') is not null""")
def filter_compound(t):
    link = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t.customer.filter((F.col("c_acctbal") > 0) & link.isNotNull()).select("c_custkey", "c_acctbal")


@query("filter_ne", "select p_partkey, p_type from part where p_type <> 'PROMO'")
def filter_ne(t):
    return t.part.filter(F.col("p_type") != "PROMO").select("p_partkey", "p_type")


@query("filter_isin", """
    select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 49)""")
def filter_isin(t):
    wanted = t.lineitem.filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_name").join(wanted.distinct(), "p_partkey", "left_semi")


@query("filter_ge_scalar_subquery", """
    select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_date from orders
    where o_orderdate >= (select min(ts) - interval 26 year from events)""")
def filter_ge_scalar_subquery(t):
    first = F.col("ts") - F.expr("interval 26 years")
    kept = S.at_or_after_first(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", t.events, first)
    return kept.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date"))


@query("drop_any_null", """
    select doc_id, lang, cast(quality as bigint) as quality from documents join labels using (doc_id)
    where quality is not null and nullif(lang, 'fr') is not null""")
def drop_any_null(t):
    wide = t.documents.select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang")).join(
        t.labels.select("doc_id", F.col("quality").cast("bigint").alias("quality")), "doc_id", "left"
    )
    return wide.dropna("any")


# Flags that stand in for screening criteria.
INCLUDE = {"IC I": "l_quantity > 5", "IC II": "l_discount > 0.01"}
EXCLUDE = {"EC I": "l_returnflag = 'R'", "EC II": "l_tax > 0.06", "EC III": "l_linestatus = 'F'"}


@query("boolean_all_criteria", """
    select l_orderkey, l_partkey, l_linenumber, l_extendedprice,
      cast(l_quantity > 5 and l_discount > 0.01 and not (l_returnflag = 'R') and not (l_tax > 0.06)
        and not (l_linestatus = 'F') as integer) as included
    from lineitem""")
def boolean_all_criteria(t):
    verdict = S.all_criteria([F.expr(c) for c in INCLUDE.values()], [F.expr(c) for c in EXCLUDE.values()])
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
                             verdict.cast("int").alias("included"))


@query("first_failing_step", """
    select l_orderkey, l_partkey, l_linenumber, l_extendedprice,
      case when not (l_quantity > 5) then 'IC I' when not (l_discount > 0.01) then 'IC II'
           when l_returnflag = 'R' then 'EC I' when l_tax > 0.06 then 'EC II' when l_linestatus = 'F' then 'EC III'
           else 'Included' end as step
    from lineitem""")
def first_failing_step(t):
    step = S.first_failing_step(
        [(F.expr(c), k) for k, c in INCLUDE.items()], [(F.expr(c), k) for k, c in EXCLUDE.items()]
    )
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", step.alias("step"))


@query("set_label_train_test", """
    select doc_id, case when doc_id in (select doc_id from labels where quality = 1) then 'train'
      when doc_id in (select doc_id from labels where quality = 0) then 'test' else 'unknown' end as set
    from documents""")
def set_label_train_test(t):
    return S.label_sets(
        t.documents.select("doc_id"), t.labels.filter("quality = 1"), t.labels.filter("quality = 0"), "doc_id"
    )


TYPE_CLASSES = {
    "Cheap": ["ECONOMY", "STANDARD"],
    "Sized": ["SMALL", "MEDIUM", "STANDARD"],
}


@query("map_lookup_class", """
    select p_partkey, case when p_type in ('ECONOMY', 'STANDARD') then 'Cheap'
      when p_type in ('SMALL', 'MEDIUM', 'STANDARD') then 'Sized' end as class from part""")
def map_lookup_class(t):
    return t.part.select("p_partkey", S.class_of("p_type", TYPE_CLASSES).alias("class"))


@query("standardize_union_schema", """
    select c_name as title, 2000 + c_nationkey as year, cast(c_custkey % 100 as integer) as citations, c_mktsegment as link,
      'pdf/' || c_custkey as pdf_link, 'c' || (c_custkey % 5) as category, 'customers' as source from customer
    union all
    select s_name, 2000 + s_nationkey, -1, 'supplier/' || s_suppkey, null, 's' || (s_suppkey % 5), 'suppliers' from supplier""")
def standardize_union_schema(t):
    first = S.to_article_layout(t.customer, {
        "title": "c_name", "year": 2000 + F.col("c_nationkey"), "citations": F.col("c_custkey") % 100,
        "link": "c_mktsegment", "pdf_link": F.concat(F.lit("pdf/"), F.col("c_custkey")),
        "category": F.concat(F.lit("c"), F.col("c_custkey") % 5),
    }, "customers")
    second = S.to_article_layout(t.supplier, {
        "title": "s_name", "year": 2000 + F.col("s_nationkey"),
        "link": F.concat(F.lit("supplier/"), F.col("s_suppkey")),
        "category": F.concat(F.lit("s"), F.col("s_suppkey") % 5),
    }, "suppliers")
    return S.union_article_sources(first, second)


@query("sanitize_target", """
    select c_custkey, case when c_custkey % 11 = 0 or c_custkey % 13 = 0 then 0.0 else greatest(c_acctbal, 0) end as y
    from customer""")
def sanitize_target(t):
    odd = (
        F.when(F.col("c_custkey") % 11 == 0, F.lit(float("nan")))
        .when(F.col("c_custkey") % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    )
    return t.customer.select("c_custkey", N.sanitize_target(odd).alias("y"))


@query("log1p_target", """
    select o_orderkey, round(ln(1 + o_totalprice), 6) as y_log, o_totalprice as y_plain from orders""")
def log1p_target(t):
    return t.orders.select(
        "o_orderkey", F.round(N.model_target("o_totalprice", "realty"), 6).alias("y_log"),
        N.model_target("o_totalprice", "minutes").alias("y_plain"),
    )


@query("method_slug", """
    select p_partkey, regexp_replace(regexp_replace(lower(' ' || p_brand || ' + ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'),
      '^_+|_+$', '', 'g') as slug from part""")
def method_slug(t):
    return t.part.select("p_partkey", T.method_slug(F.concat_ws("", F.lit(" "), "p_brand", F.lit(" + "), "p_name", F.lit("!"))).alias("slug"))


@query("normalize_feature_name", r"""
    select p_partkey, 'fg_has_' ||
      regexp_replace(trim(strip_accents(regexp_replace(lower('Área ' || p_name || ' (em m²) útil'), '\s*\([^()]*\)', '', 'g'))), '\s+', '_', 'g')
      || '_' || regexp_replace(trim(strip_accents(regexp_replace(lower(' ' || p_type || ' Ação  Já '), '\s*\([^()]*\)', '', 'g'))), '\s+', '_', 'g') as flag
    from part""")
def normalize_feature_name(t):
    name = F.concat(F.lit("Área "), "p_name", F.lit(" (em m²) útil"))
    word = F.concat(F.lit(" "), "p_type", F.lit(" Ação  Já "))
    return t.part.select("p_partkey", T.flag_name(name, word).alias("flag"))


@query("strip_accents", "select doc_id, md5(strip_accents(text)) as plain_md5, cast(length(strip_accents(text)) as bigint) as n from documents")
def strip_accents(t):
    plain = T.strip_accents("text")
    return t.documents.select("doc_id", F.md5(plain).alias("plain_md5"), F.length(plain).cast("bigint").alias("n"))


@query("title_key", r"""
    with titles as (select p_partkey, case p_partkey % 7 when 0 then p_name || ' - ' || p_brand || ' / x'
        when 1 then p_name || ' / ' || p_brand when 2 then p_name || ' \ ' || p_brand || ' | y'
        when 3 then p_name || ' | ' || p_brand when 4 then '' when 5 then null else 'Canção ' || p_name end as title from part),
    heads as (select p_partkey, title, case when title like '% - %' then split_part(title, ' - ', 1)
        when title like '% / %' then split_part(title, ' / ', 1) when contains(title, ' \ ') then split_part(title, ' \ ', 1)
        when title like '% | %' then split_part(title, ' | ', 1) else title end as head from titles)
    select p_partkey, case when length(title) > 0 then lower(replace(strip_accents(head), ' ', '_')) end as title_key from heads""")
def title_key(t):
    title = F.expr(r"""case p_partkey % 7 when 0 then p_name || ' - ' || p_brand || ' / x'
        when 1 then p_name || ' / ' || p_brand when 2 then p_name || ' \\ ' || p_brand || ' | y'
        when 3 then p_name || ' | ' || p_brand when 4 then '' when 5 then null else 'Canção ' || p_name end""")
    return t.part.select("p_partkey", T.title_key(title).alias("title_key"))


@query("strip_lower", r"""
    select doc_id, md5(lower(regexp_replace(chr(9) || text || chr(10), '^\s+|\s+$', '', 'g'))) as title_md5 from documents""")
def strip_lower(t):
    return t.documents.select("doc_id", F.md5(T.strip_lower(F.concat(F.lit("\t"), "text", F.lit("\n")))).alias("title_md5"))


@query("replace_first_regex", r"""
    select doc_id, md5(regexp_replace(text, 'and\s+', '')) as text_md5 from documents""")
def replace_first_regex(t):
    return t.documents.select("doc_id", F.md5(T.replace_first("text", r"and\s+", "")).alias("text_md5"))


@query("replace_first_literal", r"""
    select doc_id, md5(regexp_replace(text, '\. ', ';')) as text_md5 from documents""")
def replace_first_literal(t):
    return t.documents.select("doc_id", F.md5(T.replace_first("text", ". ", ";", literal=True)).alias("text_md5"))


@query("to_titlecase", r"""
    select p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || '-' || p_type || '''s 2nd'), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'),
      lambda x: upper(x[1]) || x[2:]), '') as title from part""")
def to_titlecase(t):
    return t.part.select("p_partkey", T.to_titlecase(F.concat("p_name", F.lit("-"), "p_type", F.lit("'s 2nd"))).alias("title"))


@query("extract_digits_number", r"""
    select c_custkey, try_cast(replace(regexp_replace(c_name || case when c_custkey % 9 = 0 then ' rows' else '"' end, '[^\d]+', ''), '"', '') as bigint) as n
    from customer""")
def extract_digits_number(t):
    text = F.concat("c_name", F.when(F.col("c_custkey") % 9 == 0, F.lit(" rows")).otherwise(F.lit('"')))
    return t.customer.select("c_custkey", T.extract_digits_number(text).alias("n"))


@query("strip_tag_prefix", r"""
    select doc_id, md5(regexp_replace('[PDF] ' || text, '^\[.*?\]\s*', '')) as text_md5 from documents""")
def strip_tag_prefix(t):
    return t.documents.select("doc_id", F.md5(T.strip_tag_prefix(F.concat(F.lit("[PDF] "), "text"))).alias("text_md5"))


@query("last_year_in_text", r"""
    with texts as (select event_id, case when event_id % 6 = 0 then 'no year 123456' else 'J. Doe, ' || (1990 + event_id % 40) || ' - seen '
        || strftime(ts, '%d.%m.%Y') || ' x21055' end as meta from events)
    select event_id, coalesce(regexp_extract_all(meta, '\b(?:19\d{2}|20\d{2})\b')[-1], '') as year from texts""")
def last_year_in_text(t):
    meta = F.when(F.col("event_id") % 6 == 0, F.lit("no year 123456")).otherwise(F.concat(
        F.lit("J. Doe, "), 1990 + F.col("event_id") % 40, F.lit(" - seen "), F.date_format("ts", "dd.MM.yyyy"), F.lit(" x21055")
    ))
    return t.events.select("event_id", T.last_year_in_text(meta).alias("year"))


@query("first_integer", r"""
    select page_id, coalesce(try_cast(regexp_extract(url, '(\d+)', 1) as bigint), 0) as n,
      coalesce(try_cast(replace(split_part(case when page_id % 4 = 0 then 'many views' else '1.' || (100 + page_id % 900) || ' views' end, ' ', 1), '.', '') as bigint), 0) as views
    from pages""")
def first_integer(t):
    views = F.when(F.col("page_id") % 4 == 0, F.lit("many views")).otherwise(
        F.concat(F.lit("1."), 100 + F.col("page_id") % 900, F.lit(" views"))
    )
    return t.pages.select("page_id", T.first_integer("url").alias("n"), T.view_count(views).alias("views"))


@query("parse_zoned_timestamp", """
    select event_id, strftime(ts - interval 3 hour, '%Y-%m-%d') as local_date from events""")
def parse_zoned_timestamp(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events.select("event_id", F.date_format(T.local_date(iso), "yyyy-MM-dd").alias("local_date"))


@query("parse_dayfirst_date", """
    select o_orderkey, case when o_orderkey % 10 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as o_date,
      case when o_orderkey % 8 = 0 then null else o_totalprice end as amount from orders""")
def parse_dayfirst_date(t):
    day = F.when(F.col("o_orderkey") % 10 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    amount = F.when(F.col("o_orderkey") % 8 == 0, F.lit("-")).otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", F.date_format(T.dayfirst_date(day), "yyyy-MM-dd").alias("o_date"),
                           amount.try_cast("double").alias("amount"))


@query("distinct_years", "select distinct cast(year(o_orderdate) as bigint) as year from orders")
def distinct_years(t):
    return t.orders.select(F.year("o_orderdate").cast("bigint").alias("year")).distinct()


@query("natural_log_positive", """
    select l_orderkey, l_partkey, l_linenumber, round(ln(l_quantity - 10), 6) as log_size from lineitem where l_quantity - 10 > 0""")
def natural_log_positive(t):
    size = F.col("l_quantity") - 10
    return t.lineitem.filter(size > 0).select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.log(size), 6).alias("log_size"))


@query("prepare_text_payload", r"""
    with flat as (select doc_id, regexp_replace(case when doc_id % 50 = 0 then '' else text end, '\s+', ' ', 'g') as text from documents),
    cut as (select doc_id, case when length(text) > 10000 then right(text, 5000) when text = '' then ' ' else text end as text from flat)
    select doc_id, md5(text) as text_md5, cast(length(text) as bigint) as n from cut""")
def prepare_text_payload(t):
    payload = T.encoder_payload(F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.col("text")))
    return t.documents.select("doc_id", payload.alias("text")).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n")
    )


ENTITIES = {"&lt;": "'<'", "&gt;": "'>'", "&quot;": "'\"'", "&#39;": "chr(39)", "&nbsp;": "chr(160)", "&copy;": "'©'", "&middot;": "'·'", "&amp;": "'&'"}


def _html_text(expression: str) -> str:
    """SQL for the decoded, stripped text of an HTML fragment."""
    for entity, plain in ENTITIES.items():
        expression = f"replace({expression}, '{entity}', {plain})"
    return rf"regexp_replace({expression}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"


SHOWN = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<x>', 'g')"
ANCHORS = "regexp_extract_all(nav, '(?s)<a [^>]*>.*?</a>')"
NO_TAGS = "regexp_replace({}, '<[^>]*>', '', 'g')"


@query("html_get_text", f"""
    select page_id, array_to_string(list_filter(list_transform(regexp_split_to_array({SHOWN}, '<[^>]*>'), lambda x: {_html_text('x')}), lambda x: x <> ''), ' ') as text
    from pages""")
def html_get_text(t):
    return extract_html(t.pages, "page_id", "html").select("page_id", "text")


@query("html_paragraphs", f"""
    with blocks as (select page_id, unnest(regexp_extract_all({SHOWN}, '(?s)<article.*?</article>')) as block from pages),
    opened as (select page_id, regexp_split_to_array(replace(block, '</article>', '</p>'), '<p>')[2:] as l from blocks),
    p as (select page_id, list_transform(l, lambda x: {_html_text(NO_TAGS.format("regexp_replace(split_part(x, '</p>', 1), '<br */?>', chr(10), 'g')"))}) as l from opened)
    select page_id, cast(i - 1 as integer) as pos, l[i] as paragraph from (select page_id, l, unnest(range(1, len(l) + 1)) as i from p)
    union all select page_id, null, null from p where len(l) = 0""")
def html_paragraphs(t):
    pages = extract_html(t.pages, "page_id", "html").select("page_id", "paragraphs")
    return explode_paragraphs(pages, "paragraphs").withColumnRenamed("paragraphs", "paragraph")


@query("html_links", f"""
    with navs as (select page_id, unnest(regexp_extract_all(html, '(?s)<nav.*?</nav>')) as nav from pages),
    a as (select page_id, unnest({ANCHORS}) as a, generate_subscripts({ANCHORS}, 1) as rank from navs)
    select page_id, cast(rank as integer) as rank, {_html_text("""regexp_extract(a, 'href="([^"]*)"', 1)""")} as href, {_html_text(NO_TAGS.format('a'))} as text from a""")
def html_links(t):
    return extract_html(t.pages, "page_id", "html").select("page_id", F.inline("links"))


VERDICT = """case event_id % 6
  when 0 then '{"results": {"IC I": true, "EC I": false, "EC II": ' || if(get_json_object(props, '$.k') > 50, 'true', 'false') || '}}'
  when 1 then '{"results": {"IC I": true, "EC I": 1, "EC II": false}}'
  when 2 then '{"results": {"IC I": true}}' when 3 then '{"verdicts": {}}' when 4 then 'sorry, no'
  else '{"results": {"IC I": false, "EC I": true, "EC II": false}}' end"""


@query("json_verdict_validate", """
    select event_id, case event_id % 6 when 0 then 'true' when 5 then 'false' end as ic_1,
      case event_id % 6 when 0 then case when cast(json_extract_string(props, '$.k') as bigint) > 50 then 'true' else 'false' end
        when 5 then 'false' end as ec_2,
      case event_id % 6 when 1 then 'not boolean' when 2 then 'wrong number of criteria' when 3 then 'missing results'
        when 4 then 'not valid JSON' end as error
    from events""")
def json_verdict_validate(t):
    judged = t.events.select("event_id", T.verdicts(F.expr(VERDICT), 3).alias("j"))
    given = F.col("j.verdicts")
    return judged.select("event_id", given["IC I"].cast("string").alias("ic_1"), given["EC II"].cast("string").alias("ec_2"), "j.error")


@query("explode_map_struct", """
    select event_id, cast(json_extract_string(props, '$.k') as bigint) as n_views, event_type as lyrics from events""")
def explode_map_struct(t):
    data = F.struct(F.array("event_type").alias("lyrics"), F.get_json_object("props", "$.k").cast("bigint").alias("n_views"))
    return t.events.select("event_id", data.alias("data")).select(
        "event_id", F.coalesce("data.n_views", F.lit(0).cast("bigint")).alias("n_views"), F.explode_outer("data.lyrics").alias("lyrics")
    )


# Words of other scripts and signs, one of them after every text.
FOREIGN = ["Привет, Мир Щука", "Γειά σου Κόσμε ψ", "カタカナ ひらがな が", "שלום €5 №7", "مرحبا ½ ×", "Ёлка Й ™"]
_SPELLED = ", ".join(f"('{a}', '{b}')" for a, b in T.spellings().items())


@query("transliterate", f"""
    with t as (select doc_id, coalesce(text, '') || ' ' || list_extract({FOREIGN}, cast(doc_id % {len(FOREIGN)} as integer) + 1) as text from documents),
    spelled as (select * from (values {_SPELLED}) as s(sign, letters)),
    chars as (select doc_id, unnest(string_split(text, '')) as sign, generate_subscripts(string_split(text, ''), 1) as pos from t)
    select doc_id, md5(string_agg(coalesce(letters, sign), '' order by pos)) as text_md5 from chars left join spelled using (sign) group by 1""")
def transliterate(t):
    sample = F.get(F.array(*map(F.lit, FOREIGN)), (F.col("doc_id") % len(FOREIGN)).cast("int"))
    return t.documents.select("doc_id", F.md5(T.transliterate(F.concat_ws(" ", F.coalesce("text", F.lit("")), sample))).alias("text_md5"))
