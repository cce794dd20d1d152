"""Tokens, fitted vocabularies, sparse and dense features."""

from __future__ import annotations

from pyspark.sql import functions as F

from textreg.functions import tokens as K
from textreg.functions.stopwords import ENGLISH
from textreg.operators import dense as D
from textreg.operators import sentences as E
from textreg.operators import subwords as W
from textreg.operators import vectorize as V
from textreg.operators.reshape import sparse_rows_to_triplets as rows_to_triplets
from textreg.operators.reshape import triplets_to_sparse_rows as triplets_to_rows
from textreg.plans.language import top_weighted_terms
from textreg.plans.ordering import add_row_index
from textreg.plans.skew import lookup_join
from textreg.plans.stage import stage_path, write_stage
from textreg.queries.registry import query
from textreg.sources.vectors import read_vectors, write_vectors

STOPS = "[" + ", ".join(f"'{w}'" for w in ENGLISH) + "]"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')"


def _kept(text: str) -> str:
    return f"list_filter({WORDS.format(text)}, lambda x: not list_contains({STOPS}, x))"


BIGRAMS = "list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])"
DOCS = f"docs as (select doc_id as row_index, {_kept('text')} as tokens from documents)"
OCC = "occ as (select row_index, unnest(tokens) as term, generate_subscripts(tokens, 1) as pos from docs)"
OCC2 = f"""wide as (select row_index, list_concat(tokens, {BIGRAMS}) as tokens from docs),
    occ as (select row_index, unnest(tokens) as term, generate_subscripts(tokens, 1) as pos from wide)"""
VOCAB = """vocab as (select term, row_number() over (order by row_first, pos_first) - 1 as term_index, df,
      ln((1.0 + (select count(*) from docs)) / (1 + df)) + 1.0 as idf
    from (select term, min(row_index) as row_first, arg_min(pos, row_index * 1000000 + pos) as pos_first, count(distinct row_index) as df from occ group by 1))"""
TERMS = "tf as (select row_index, term, count(*) as n from occ group by 1, 2)"
FITTED = f"with {DOCS}, {OCC}, {VOCAB}, {TERMS}"
FITTED2 = f"with {DOCS}, {OCC2}, {VOCAB}, {TERMS}"


def documents(t):
    """``row_index, y, tokens`` of all documents, with the log of their length as ``y``; tokenized and stored once per query."""
    rows = t.documents.select(F.col("doc_id").alias("row_index"), F.log1p("n_chars").alias("y"), "text")
    return t.once("documents", lambda: V.store_tokens(rows, keep=["y"]))


def benchmark(t):
    return t.once("benchmark", lambda: V.store_tokens(t.benchmark.select(F.col("item_id").alias("row_index"), "text")))


def _list_facts(name: str) -> list:
    return [F.size(name).alias("n"), F.md5(F.array_join(name, chr(1))).alias("list_md5")]


def _list_sql(expression: str) -> str:
    return f"select doc_id, cast(len(l) as integer) as n, md5(array_to_string(l, chr(1))) as list_md5 from (select doc_id, {expression} as l from documents)"


@query("tfidf_top_terms", f"""
    with docs as (select doc_id as row_index, lang, list_filter({_kept('text')}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}_]')) as tokens from documents),
    occ as (select row_index, lang, unnest(tokens) as term from docs),
    idf as (select term, ln((1.0 + (select count(*) from docs)) / (1 + count(distinct row_index))) + 1.0 as idf from occ group by 1),
    w as (select lang, term, round(count(*) * any_value(idf), 6) as weight from occ join idf using (term) group by 1, 2)
    select lang, term, weight, cast(row_number() over (partition by lang order by weight desc, term) as integer) as rank from w qualify rank <= 20""")
def tfidf_top_terms(t):
    words = F.filter("tokens", lambda w: w.rlike(r"[\p{L}\p{N}_]"))
    stored = V.store_tokens(t.documents, row="doc_id", keep=["lang"])
    return top_weighted_terms(stored.select("lang", words.alias("tokens")), "lang")


@query("tokenize_words", _list_sql(WORDS.format("text")))
def tokenize_words(t):
    return t.documents.select("doc_id", K.tokenize_words("text").alias("l")).select("doc_id", *_list_facts("l"))


@query("tokenize_sentences", _list_sql(
    r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: x <> '')"))
def tokenize_sentences(t):
    return t.documents.select("doc_id", K.tokenize_sentences("text").alias("l")).select("doc_id", *_list_facts("l"))


@query("tokenize_by_strategy", f"""
    select doc_id, md5(array_to_string(l, ' ')) as by_sentence, md5(array_to_string(l, ' ')) as by_document
    from (select doc_id, {_kept('text')} as l from documents)""")
def tokenize_by_strategy(t):
    def joined(strategy):
        return F.md5(F.array_join(K.tokenize_by_strategy("text", strategy), " "))

    return t.documents.select("doc_id", joined("sentence").alias("by_sentence"), joined("document").alias("by_document"))


@query("remove_stopwords", _list_sql(_kept("text")))
def remove_stopwords(t):
    return t.documents.select("doc_id", K.remove_stopwords(K.tokenize_words("text")).alias("l")).select("doc_id", *_list_facts("l"))


@query("ngrams", f"""
    with docs as (select doc_id, {_kept('text')} as tokens from documents), grams as (select doc_id, {BIGRAMS} as l from docs)
    select doc_id, cast(len(l) as integer) as n, md5(array_to_string(l, chr(1))) as list_md5 from grams""")
def ngrams(t):
    return t.documents.select("doc_id", K.ngrams(K.tokenize_by_strategy("text"), 2).alias("l")).select("doc_id", *_list_facts("l"))


@query("truncate_tokens", _list_sql(WORDS.format("text") + "[1:512]"))
def truncate_tokens(t):
    return t.documents.select("doc_id", K.truncate_tokens(K.tokenize_words("text")).alias("l")).select("doc_id", *_list_facts("l"))


# ---- vocabularies ----

@query("bow_fit", FITTED + " select term, term_index, df from vocab")
def bow_fit(t):
    return V.fit_vocabulary(documents(t), "BoW").terms.select("term", "term_index", "df")


@query("ngram_bow_fit", FITTED2 + " select term, term_index, df from vocab")
def ngram_bow_fit(t):
    return V.fit_vocabulary(documents(t), "n-gram+BoW").terms.select("term", "term_index", "df")


@query("tfidf_fit", FITTED + " select term, term_index, df, round(idf, 6) as idf from vocab")
def tfidf_fit(t):
    return V.fit_vocabulary(documents(t), "TF-IDF").terms.withColumn("idf", F.round("idf", 6))


@query("vocab_lookup_join", FITTED + f""", other as (select item_id, unnest({_kept('text')}) as term from benchmark)
    select item_id, term_index, count(*) as n from other join vocab using (term) group by 1, 2""")
def vocab_lookup_join(t):
    terms = V.fit_vocabulary(documents(t)).terms.select("term", "term_index")
    counts = V.term_counts(benchmark(t)).filter(F.col("term").isNotNull())
    known = lookup_join(counts, terms, "term", spread_by="row_index", stored=True)
    return known.select(F.col("row_index").alias("item_id"), "term_index", "n")


SPARSE_ROWS = """ select d.row_index, cast(count(term_index) as integer) as n,
      coalesce(string_agg(term_index || ':' || cast(n as bigint), ',' order by term_index), '') as entries,
      cast((select count(*) from vocab) as integer) as embedding_size
    from {base} d left join (select row_index, term_index, n from {tf} join vocab using (term)) k using (row_index) group by 1"""


def _shown(rows):
    pairs = F.zip_with("embedding_indices", "embedding_values", lambda i, v: F.concat_ws(":", i, v.cast("bigint")))
    return rows.select("row_index", F.size("embedding_indices").alias("n"), F.array_join(pairs, ",").alias("entries"), "embedding_size")


OTHER = f""", other as (select item_id as row_index, {_kept('text')} as tokens from benchmark),
    otf as (select row_index, term, count(*) as n from (select row_index, unnest(tokens) as term from other) group by 1, 2)"""
OTHER2 = f""", other as (select item_id as row_index, {_kept('text')} as tokens from benchmark),
    otf as (select row_index, term, count(*) as n from (select row_index, unnest(list_concat(tokens, {BIGRAMS})) as term from other) group by 1, 2)"""


@query("bow_transform", FITTED + OTHER + SPARSE_ROWS.format(base="other", tf="otf"))
def bow_transform(t):
    fitted = V.fit_vocabulary(documents(t), "BoW")
    return _shown(V.transform_documents(benchmark(t), fitted))


@query("ngram_bow_transform", FITTED2 + OTHER2 + SPARSE_ROWS.format(base="other", tf="otf"))
def ngram_bow_transform(t):
    fitted = V.fit_vocabulary(documents(t), "n-gram+BoW")
    return _shown(V.transform_documents(benchmark(t), fitted))


TFIDF_ENTRIES = " select row_index, term_index, round(cast(cast(n * idf as float) as double), 3) as value from tf join vocab using (term)"


@query("tfidf_transform", FITTED + TFIDF_ENTRIES)
def tfidf_transform(t):
    fitted = V.fit_vocabulary(documents(t), "TF-IDF")
    return rows_to_triplets(V.transform_documents(documents(t), fitted)).withColumn("value", F.round("value", 3))


@query("fit_transform_oneshot", f"""
    with docs as (select row_number() over (order by conv_id, turn) - 1 as row_index, {_kept('text')} as tokens from conversations), {OCC}, {VOCAB}, {TERMS}""" + TFIDF_ENTRIES)
def fit_transform_oneshot(t):
    turns = V.store_tokens(add_row_index(t.conversations, ["conv_id", "turn"]))
    return rows_to_triplets(V.fit_transform(turns, "tf idf")).withColumn("value", F.round("value", 3))


@query("sparse_rows_to_triplets", FITTED + " select row_index, term_index, cast(n as double) as value from tf join vocab using (term)")
def sparse_rows_to_triplets(t):
    return rows_to_triplets(V.fit_transform(documents(t), "BoW"))


@query("triplets_to_sparse_rows", FITTED + SPARSE_ROWS.format(base="docs", tf="tf"))
def triplets_to_sparse_rows(t):
    docs = documents(t)
    fitted = V.fit_vocabulary(docs, "BoW")
    entries = V.weighted_terms(docs, fitted).filter(F.col("term_index").isNotNull())
    return _shown(triplets_to_rows(entries, docs, fitted.size))


# ---- dense ----

def word_vectors(t):
    """The n-th term of the documents has the n-th stored vector."""
    terms = V.fit_vocabulary(documents(t)).terms.select("term", F.col("term_index").alias("vec_id"))
    return write_stage(t.embeddings.select("vec_id", F.col("embedding").alias("vec")).join(terms, "vec_id").select("term", "vec"), "word-vectors")


VECTORS = "vectors as (select term, embedding as vec from embeddings join vocab on vec_id = term_index)"


@query("vector_lookup_join", FITTED + f", {VECTORS} select row_index, term, n, round(cast(vec[1] as double), 6) as first from tf join vectors using (term)")
def vector_lookup_join(t):
    counts = V.term_counts(documents(t)).filter(F.col("term").isNotNull())
    # Only what is shown of a vector goes through the join.
    firsts = word_vectors(t).select("term", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))
    return lookup_join(counts, firsts, "term", spread_by="row_index", stored=True).select("row_index", "term", "n", "first")


@query("word_vector_mean", FITTED + f""", {VECTORS},
    entries as (select row_index, n, unnest(vec) as x, generate_subscripts(vec, 1) as dim from tf join vectors using (term)),
    means as (select row_index, dim, sum(cast(x as double) * n) / sum(n) as value from entries group by 1, 2)
    select d.row_index, cast(g.dim - 1 as integer) as dim, round(coalesce(value, 0), 3) + 0.0 as value
    from docs d cross join (select unnest(range(1, 65)) as dim) g left join means m on m.row_index = d.row_index and m.dim = g.dim""")
def word_vector_mean(t):
    pooled = D.word_vector_mean(documents(t), word_vectors(t))
    return pooled.select("row_index", F.posexplode_outer("embedding").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 3) + 0.0)


@query("masked_mean_pool", """
    with e as (select label, case when vec_id % 3 = 0 then 0 else 1 end as mask, unnest(embedding) as x, generate_subscripts(embedding, 1) as dim from embeddings)
    select label, cast(dim - 1 as integer) as dim, round(sum(cast(x as double) * mask) / greatest(sum(mask), 1e-9), 5) + 0.0 as value from e group by 1, 2""")
def masked_mean_pool(t):
    masked = t.embeddings.withColumn("mask", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1))
    pooled = D.masked_mean_pool(masked, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode_outer("embedding").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5) + 0.0)


HASHED = f"""
    with tok as (select doc_id, unnest({WORDS.format('text')}) as term from documents),
    slots as (select doc_id, cast(cast('0x' || substr(md5(term), 1, 16) as ubigint) % 32 as integer) as dim,
        case when substr(md5(term), 1, 1) >= '8' then 1 else -1 end as sign from tok),
    sums as (select doc_id, dim, sum(sign) as v from slots group by 1, 2),
    lens as (select doc_id, sqrt(sum(v * v)) as len from sums group by 1)
    select d.doc_id, g.dim, round(coalesce(v / case when len = 0 then 1 else len end, 0), 4) + 0.0 as value
    from documents d cross join (select cast(unnest(range(0, 32)) as integer) as dim) g left join sums s on s.doc_id = d.doc_id and s.dim = g.dim left join lens l on l.doc_id = d.doc_id"""


@query("batched_encoder", HASHED)
def batched_encoder(t):
    encoded = D.encode_texts(t.documents.select("doc_id", "text"), "text", D.hashing_encoder(32), 32)
    return encoded.select("doc_id", F.posexplode_outer("embedding").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4) + 0.0)


@query("hashed_vectors", HASHED)
def hashed_vectors(t):
    """The vectors of the encoder without Python."""
    words = V.store_tokens(t.documents.withColumn("row_index", F.col("doc_id")), stops=False)
    coded = D.hashed_vectors(words, 32)
    return coded.select(F.col("row_index").alias("doc_id"), F.posexplode_outer("embedding").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4) + 0.0)


# ---- trained sentence ends ----

# The same statistics and decisions in SQL: words with their neighbours, counts, scores, then the verdict on every dot.
SENTENCE_TOKENS = r"""
    pieces as (select doc_id as row_index, unnest(p) as piece, generate_subscripts(p, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '\S+\s*') as p from documents)),
    bares as (select *, regexp_replace(piece, '\s+$', '') as token, regexp_replace(regexp_replace(piece, '\s+$', ''), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$', '', 'g') as bare from pieces),
    marked as (select *, regexp_extract(token, '([.!?]+)["'')\]»”’]*$', 1) as marks, lower(regexp_replace(bare, '\.+$', '')) as low from bares),
    spelled as (select row_index, pos, piece, case when regexp_matches(low, '^[0-9][0-9.,]*$') then '#' else low end as word, ends_with(bare, '.') as dotted,
      case when regexp_matches(marks, '[!?]') then right(marks, 1) when regexp_matches(marks, '^\.\.+$') then '...' when marks = '.' then '.' else '' end as ends,
      case when regexp_matches(bare, '^\p{Lu}') then 'U' when regexp_matches(bare, '^\p{Ll}') then 'L' else '' end as first from marked),
    tok as (select *, lead(word) over w as next_word, lead(first) over w as next_first, lead(word) over w is null as last from spelled window w as (partition by row_index order by pos)),"""


def _fit(k: str, m: str, q: str) -> str:
    return f"({k} * ln(greatest({q}, 1e-300)) + ({m} - {k}) * ln(greatest(1 - {q}, 1e-300)))"


def _association(a: str, b: str, both: str, n: str) -> str:
    p, p1, p2 = f"({b} / {n})", f"({both} / {a})", f"(({b} - {both}) / greatest({n} - {a}, 1))"
    rest, others = f"({b} - {both})", f"({n} - {a})"
    return f"""-2 * ({_fit(both, a, p)} + {_fit(rest, others, p)} - case when {a} = {both} then 0.0 else {_fit(both, a, p1)} end
        - case when {b} = {both} then 0.0 else {_fit(rest, others, p2)} end)"""


SENTENCE_MODEL = f"""
    counts as (select word, cast(count(*) as double) as n, cast(count(*) filter (dotted) as double) as d from tok where word <> '' group by 1),
    whole as (select sum(n) as total, sum(d) as dots from counts),
    scored as (select word, n, d, case when d > 0 and regexp_matches(word, '\\p{{L}}') then -2 * ({_fit("d", "n", "(dots / total)")} - {_fit("d", "n", "0.99")})
        * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', '')), -(n - d)) else 0.0 end as score
      from counts, whole),
    known as (select t.*, coalesce(s.score >= 0.3, false) as abbreviation, t.ends in ('!', '?') or (t.ends = '.' and not coalesce(s.score >= 0.3, false)) as likely_end
      from tok t left join scored s using (word)),
    after_word as (select *, regexp_matches(word, '^\\p{{L}}$') as initial from known where not last and next_word <> ''),
    places as (select next_word as word, count(*) filter (not likely_end and next_first = 'U') as upper_inside,
      cast(count(*) filter (likely_end and not initial and word <> '#') as double) as starts from after_word group by 1),
    lows as (select word, count(*) filter (first = 'L') as lower_n from known group by 1),
    breaks as (select cast(count(*) as double) as b from known where likely_end),
    words as (select word, n, d, score, lower_n, coalesce(upper_inside, 0) as upper_inside, coalesce(starts, 0) as starts,
        case when coalesce(starts, 0) > 0 and regexp_matches(word, '^\\p{{L}}+$') and total / greatest(b, 1) > n / starts
          then {_association("b", "n", "starts", "total")} else 0.0 end as starter_score
      from scored join lows using (word) left join places using (word), whole, breaks),
    pairs as (select word, next_word, cast(count(*) as double) as k from after_word
      where ends = '.' and (abbreviation or initial or word = '#') group by 1, 2 having count(*) > 1),
    bound as (select p.word, p.next_word, k, case when total / s.n > f.n / k then {_association("s.n", "f.n", "k", "total")} else 0.0 end as score
      from pairs p join scored s on p.word = s.word join scored f on p.next_word = f.word, whole)"""


def _sentence_tokens(t, whole=True):
    rows = t.documents.select(F.col("doc_id").alias("row_index"), "text").repartition("row_index")
    tokens = E.sentence_tokens(rows)
    return t.once("sentence-tokens", lambda: write_stage(tokens if whole else E.telling(tokens), "sentence-tokens", "zstd"))


@query("sentence_parameters", "with " + SENTENCE_TOKENS + SENTENCE_MODEL + """
    select word, cast(n as bigint) as n, cast(d as bigint) as dotted, round(score, 4) + 0.0 as score, lower_n as lower, upper_inside, cast(starts as bigint) as starts,
      round(starter_score, 3) + 0.0 as starter_score from words""")
def sentence_parameters(t):
    """What the corpus says of every word: how likely an abbreviation, how often lower case, how often it starts sentences."""
    words = E.fit_sentences(_sentence_tokens(t, whole=False)).words
    return words.withColumns({"score": F.round("score", 4) + 0.0, "starter_score": F.round("starter_score", 3) + 0.0}).select(
        "word", "n", "dotted", "score", "lower", "upper_inside", "starts", "starter_score"
    )


@query("tokenize_sentences_trained", "with " + SENTENCE_TOKENS + SENTENCE_MODEL + r""",
    decided as (select t.row_index, t.pos, t.piece, case when t.ends in ('!', '?') then true when t.ends not in ('.', '...') or t.last then false
        when coalesce(b.score >= 7.88, false) then false
        when coalesce(h.score >= 0.3, false) or t.ends = '...' then coalesce(t.next_first = 'U' and (
          (coalesce(a.lower_n, 0) > 0 and coalesce(a.upper_inside, 0) = 0) or (not regexp_matches(t.word, '^\p{L}$') and coalesce(a.starter_score >= 30, false))), false)
        when regexp_matches(t.word, '^\p{L}$') or t.word = '#' then not (t.next_first = 'L' or (regexp_matches(t.word, '^\p{L}$') and t.next_first = 'U' and coalesce(a.lower_n, 0) = 0))
        else true end as is_end
      from tok t left join words h on h.word = t.word left join words a on a.word = t.next_word left join bound b on b.word = t.word and b.next_word = t.next_word),
    numbered as (select *, coalesce(sum(is_end::int) over (partition by row_index order by pos rows between unbounded preceding and 1 preceding), 0) as k from decided),
    sentences as (select row_index, k, regexp_replace(string_agg(piece, '' order by pos), '\s+$', '') as s from numbered group by 1, 2)
    select row_index as doc_id, cast(count(*) as integer) as n, md5(string_agg(s, chr(1) order by k)) as list_md5 from sentences group by 1""")
def tokenize_sentences_trained(t):
    tokens = _sentence_tokens(t)
    cut = E.split_sentences(tokens, E.fit_sentences(tokens))
    return cut.select(F.col("row_index").alias("doc_id"), F.size("sentences").alias("n"), F.md5(F.array_join("sentences", chr(1))).alias("list_md5"))


#: Byte-level vocabulary of the registered query; a job passes its own file.
SUBWORDS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("truncate_subwords")
def truncate_subwords(t):
    """At most 512 sub-words of every document, marks included."""
    coded = W.encode_subwords(t.documents, SUBWORDS, row="doc_id", max_length=512, begin=50256, end=50256)
    return coded.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",")).alias("list_md5"), "truncated")


@query("pretrained_vectors", "select 'term_' || vec_id as term, cast(len(embedding) as integer) as n, round(cast(embedding[1] as double), 6) as first from embeddings where vec_id % 5 = 0")
def pretrained_vectors(t):
    """Every fifth vector, read back from a vector file in byte ranges."""
    path = stage_path(t.spark, "vector-file")
    write_vectors(t.embeddings.select(F.concat(F.lit("term_"), "vec_id").alias("term"), F.col("embedding").alias("vec")), path)
    wanted = t.embeddings.filter("vec_id % 5 = 0").select(F.concat(F.lit("term_"), "vec_id").alias("term"))
    found = read_vectors(t.spark, path, range_bytes=64 << 10).join(wanted, "term", "left_semi")
    return found.select("term", F.size("vec").alias("n"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


# The rules one after another, each a pass over the text; a contraction after every text.
SPOKEN = ["I don't know, it's 3.5: we'll see...", "They cannot say (we're \"gonna\" -- go)!", "U.S. rules; he'd've gone."]


def _ruled() -> str:
    spoken = ", ".join("'" + s.replace("'", "''") + "'" for s in SPOKEN)
    out = f"' ' || lower(coalesce(text, '') || ' ' || list_extract([{spoken}], cast(doc_id % 3 as integer) + 1)) || ' '"
    steps = [
        (r"(\.{3,})", r" \1 "), (r"(--)", r" \1 "), (r"([;@#$%&?!\[\](){}<>\x22])", r" \1 "), (r"([,:])([^0-9])", r" \1 \2"), (r"([,:])([^0-9])", r" \1 \2"),
        (r"([^.])(\.)([\x22''\])}>»”’\s]*)$", r"\1 \2 \3"),
        (r"([^\p{L}\p{N}])(can)(not)([^\p{L}\p{N}])", r"\1\2 \3\4"), (r"([^\p{L}\p{N}])(gon|wan)(na)([^\p{L}\p{N}])", r"\1\2 \3\4"),
        (r"([^\p{L}\p{N}])(got)(ta)([^\p{L}\p{N}])", r"\1\2 \3\4"), (r"([^\p{L}\p{N}])(gim|lem)(me)([^\p{L}\p{N}])", r"\1\2 \3\4"),
        (r"(n''t|''s|''m|''d|''ll|''re|''ve)([^\p{L}\p{N}])", r" \1 \2"), (r"(n''t|''s|''m|''d|''ll|''re|''ve)([^\p{L}\p{N}])", r" \1 \2"),
    ]
    for pattern, into in steps:
        out = f"regexp_replace({out}, '{pattern}', '{into}', 'g')"
    return rf"list_filter(regexp_split_to_array({out}, '\s+'), lambda x: x <> '')"


@query("tokenize_by_rules", f"select doc_id, cast(len(l) as integer) as n, md5(array_to_string(l, chr(1))) as list_md5 from (select doc_id, {_ruled()} as l from documents)")
def tokenize_by_rules(t):
    sample = F.get(F.array(*map(F.lit, SPOKEN)), (F.col("doc_id") % 3).cast("int"))
    texts = t.documents.select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), sample).alias("text"))
    return texts.select("doc_id", K.tokenize_by_rules("text").alias("l")).select("doc_id", *_list_facts("l"))
