"""Building the three analytical tables from their raw inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.functions.numeric import cast_fill, decimal_comma_to_double
from textreg.functions.text import dayfirst_date, flag_name, local_date, title_key
from textreg.operators.aggregates import ordered_concat
from textreg.operators.reshape import explode_paragraphs, pivot_flags, sparse_flags
from textreg.operators.shaping import inner_join_on_keys, left_join_fill_zero
from textreg.plans.ordering import add_row_index, running_count, shift_features
from textreg.plans.skew import lookup_join

# Raw columns of the real-estate ads by type, and their table names.
REALTY_NUMBERS = {
    "price": "vl_price", "iptu": "vl_iptu", "condominium": "vl_condominium", "totalArea": "vl_total_area",
    "usefulArea": "vl_useable_area",
}
REALTY_COUNTS = {
    "pictures": "n_pictures", "bedroom": "n_bedrooms", "bathroom": "n_bathrooms", "garage": "n_garages", "years": "n_years",
}
REALTY_TEXTS = {"type": "nm_type", "title": "nm_title", "description": "nm_description", "address": "nm_address"}


def _realty_flags(features: DataFrame) -> DataFrame:
    flags = features.select(F.col("realty").try_cast("bigint").alias("id_realty"), flag_name("name", "word").alias("flag"))
    return flags.filter("id_realty is not null and flag is not null")


def _typed_ads(ads: DataFrame) -> DataFrame:
    return ads.select(
        F.col("id").try_cast("bigint").alias("id_realty"),
        *[decimal_comma_to_double(F.col(raw).cast("string")).alias(name) for raw, name in REALTY_NUMBERS.items()],
        *[cast_fill(raw).alias(name) for raw, name in REALTY_COUNTS.items()],
        *[F.col(raw).alias(name) for raw, name in REALTY_TEXTS.items()],
    )


def realty_table(ads: DataFrame, features: DataFrame) -> DataFrame:
    """Typed ads with one 0/1 ``fg_has_<name>_<word>`` column per feature; ads without features have 0s."""
    wide = pivot_flags(_realty_flags(features), "id_realty", "flag")
    return left_join_fill_zero(_typed_ads(ads), wide, "id_realty")


def realty_table_sparse(ads: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``realty_table`` for any number of features: typed ads with the numbers of their flags in ``flags``, and ``(column_index, flag)``."""
    found = sparse_flags(_realty_flags(features), "id_realty", "flag")
    numbers = found.rows.select("id_realty", F.col("column_indices").alias("flags"))
    ads = lookup_join(_typed_ads(ads), numbers, "id_realty", "left", spread_by="nm_title")
    return ads.withColumn("flags", F.coalesce("flags", F.array().cast("array<bigint>"))), found.columns


def minutes_table(minutes: DataFrame, rates: DataFrame, zone: str = "America/Sao_Paulo") -> DataFrame:
    """Minutes with the rate of their day, the rate at the next minutes and the change between them.

    ``minutes(DataReferencia, Titulo, Texto, ..)`` carries ISO UTC times, ``rates(data, valor)``
    day-first dates. Rows with any gap are dropped after the next value is taken.
    """
    daily = rates.select(dayfirst_date("data").alias("date"), F.col("valor").try_cast("double").alias("selic")).dropna()
    dated = minutes.select("DataReferencia", "Titulo", "Texto", local_date("DataReferencia", zone).alias("date"))
    first = daily.agg(F.min("date")).first()[0]
    joined = lookup_join(dated, daily, "date", "left", spread_by="DataReferencia").filter(
        F.to_date(F.substring("DataReferencia", 1, 10)) >= F.lit(first)
    )
    ordered = add_row_index(joined.drop("date"), ["DataReferencia", "Titulo"], "__i")
    moved = shift_features(ordered, {"selic_next": ("selic", 1)}, "__i")
    complete = moved.withColumn("selic_next_var", F.col("selic_next") - F.col("selic")).dropna("any")
    numbered = add_row_index(complete, "__i", "sequencia").drop("__i")
    return numbered.withColumnsRenamed({"Titulo": "titulo", "Texto": "texto", "selic": "selic_atual"})


def lyric_paragraphs(songs: DataFrame) -> DataFrame:
    """One row per paragraph of ``songs(genre, index, .., data struct<lyrics, n_views>)``, numbered from 1.

    A song without lyrics keeps one row with null lyrics and paragraph 0.
    """
    flat = songs.select(
        *[c for c in songs.columns if c != "data"],
        F.coalesce("data.n_views", F.lit(0).cast("bigint")).alias("n_views"), F.col("data.lyrics").alias("lyrics"),
    )
    exploded = explode_paragraphs(flat, "lyrics", "__pos")
    return running_count(exploded, ["genre", "index"], "__pos", "lyrics", "paragraph").drop("__pos")


def whole_lyrics(paragraphs: DataFrame) -> DataFrame:
    """One row per song with its paragraphs joined by blank lines, in order."""
    song = [c for c in paragraphs.columns if c not in ("paragraph", "lyrics")]
    return ordered_concat(paragraphs, song, "paragraph", "lyrics")


def song_streams(lyrics: DataFrame, history: DataFrame, months: int = 6) -> DataFrame:
    """Songs matched by title and artist key, with the streams ``months`` after their first streamed month.

    ``history(songstats_id, nome_musica, nome_artista, data_mensal, streams_total_min)``.
    """
    keyed = lyrics.withColumns({"_key_title": title_key("title"), "_key_artist": title_key("artist")})
    known = history.select("songstats_id", "nome_musica", "nome_artista").distinct()
    known = known.withColumns({"_key_title": title_key("nome_musica"), "_key_artist": title_key("nome_artista")})
    matched = inner_join_on_keys(keyed, known, ["_key_title", "_key_artist"], "_spotify")
    cutoff = history.filter("streams_total_min > 0").groupBy("songstats_id").agg(
        F.add_months(F.min("data_mensal"), months).alias("data_mensal")
    )
    at_cutoff = history.distinct().join(cutoff, ["songstats_id", "data_mensal"], "left_semi")
    return matched.join(at_cutoff.select("songstats_id", "streams_total_min"), "songstats_id")
