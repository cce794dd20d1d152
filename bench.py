"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder with the tables, ``BENCH_CPUS`` the local cores, and ``BENCH_QUERIES``
optionally a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import time

from textreg.queries.catalog import QUERIES
from textreg.session import local_session

HEADLINE = [
    "tfidf_top_terms", "tokenize_words", "bow_fit", "ngram_bow_fit", "tfidf_transform", "ngram_bow_transform",
    "word_vector_mean", "batched_encoder", "f_regression_scores", "select_k_best", "standard_scale",
    "term_frequencies_top_n", "split_shuffled", "repeated_kfold", "split_sorted", "sequence_id", "lead_next_value",
    "running_count_non_null", "left_join_fill_zero", "left_join_on_date", "left_then_inner_join",
    "group_count_distinct_pair", "boxplot_summary", "group_median_order", "pivot_sum_crosstab",
    "collect_list_group_all_but_one", "ordered_concat_transform", "venn_regions", "funnel_counts", "html_paragraphs",
    "json_verdict_validate", "title_key", "prepare_text_payload", "linear_regression", "ridge_regression",
    "lasso_regression", "elastic_net_cv_one_feature", "random_forest_group_means", "gradient_boosting_group_means",
    "elastic_net_cv", "gradient_boosting_ten_rounds", "exact_tree_splits", "sentence_parameters", "tokenize_sentences_trained", "tokenize_by_rules",
    "truncate_subwords", "pivot_sum_crosstab_sparse", "term_frequencies_lemmas",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores), memory="16g")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
