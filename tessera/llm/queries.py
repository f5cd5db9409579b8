"""Queries over the test tables; __spark_entry__ adds them if this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once, spread, table
from . import credentials, fmindex, levels, pairs, provenance, splitting, syntax, tokenizer, vptree


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "source_files").where(F.col("file_type") == "code")
    excluded = provenance.read_excluded(table(spark, sf, "app_settings"))
    return provenance.machine_made(spread(files.select("file_id", "file_path", "content")), excluded).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_reasons(spark, sf).select("file_id").distinct()


def _pieces(spark: SparkSession, sf: str, with_text: bool) -> DataFrame:
    files = table(spark, sf, "source_files")
    # pieces carry the text, which repeated rows would have to be taken out of
    files = spread(once(files, "file_id", "content", "language") if with_text else files.select("file_id", "content", "language"))
    settings = splitting.read_settings(table(spark, sf, "parser_settings"))
    return splitting.split_column(files, settings, "file_id", "content", "language", with_text)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    cuts = _pieces(spark, sf, False).groupBy("file_id").agg(F.max("forced").alias("forced"))
    return cuts.select("file_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, True)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    logs = table(spark, sf, "query_logs").where(F.col("generation_mode") == "service").select("id", "question", "answer")
    return pairs.broken_pairs(spread(logs), pairs.train(logs)).distinct()


def _judged(spark: SparkSession, sf: str, *carried: str) -> DataFrame:
    files = table(spark, sf, "source_files").where((F.col("file_type") == "code") & F.col("content").isNotNull())
    return syntax.unparsable(spread(files.select("file_id", "file_path", "content", *carried)), "file_id", "file_path", "content", *carried).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where(~F.col("valid")).select("file_id")


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of files that do not parse, per repository and language of the extension."""
    bad = (~F.col("valid")).cast("int")
    rates = _judged(spark, sf, "repository_identifier").groupBy("repository_identifier", "language")
    return rates.agg(F.count("*").alias("files"), F.sum(bad).alias("invalid"), F.round(F.avg(bad), 6).alias("share"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return vptree.neighbour_pairs(vptree.nearest(table(spark, sf, "chunk_embeddings")))


def p6_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return vptree.nearest(table(spark, sf, "chunk_embeddings")).withColumn("distance", F.round("distance", 6))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    files = spread(table(spark, sf, "source_files").select("file_id", "content"))
    return credentials.find_credentials(files).distinct()


def p7_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redact_credentials(spread(once(table(spark, sf, "source_files"), "file_id", "content")))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return tokenizer.encode_column(docs, "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return fmindex.find_leaks(docs, table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return fmindex.removal_spans(fmindex.find_leaks(docs, table(spark, sf, "eval_items")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where((F.col("lang") == "en") & F.col("doc_kind").isin("guide", "readme", "design"))
    ranker = levels.train(table(spark, sf, "graded_samples"))
    return levels.reading_levels(spread(docs.select("doc_id", "text")), ranker).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WINDOWS = "(select {k}, array_to_string(list_slice(w, i, i + 11), ' ') win from (select {k}, w, unnest(range(1, len(w) - 10)) i from (select {k}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') w from {t} where text is not null) where len(w) >= 12))"
_NEAR = """with v as (select vec_id, min(embedding) e from chunk_embeddings where len(embedding) = 64 group by vec_id),
p as (select a.vec_id a, b.vec_id b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) s from v a join v b on a.vec_id <> b.vec_id),
d as (select *, row_number() over (partition by a order by s, b) n from p)"""

ORACLE = {
    "p3_found": f"""with f as (select distinct file_id, content, coalesce(s.chunk_size, (select chunk_size from parser_settings where language is null)) size
  from source_files left join parser_settings s using (language) where content is not null),
r as (select file_id, size, list_transform(string_split_regex(content, '{_SPACE}'), lambda x: length(x)) l from f)
select file_id, case when list_max(l) > size then 'forced' else 'natural' end cut from r where list_sum(l) > size""",
    "p6_found": f"{_NEAR} select distinct least(a, b) vec_low, greatest(a, b) vec_high from d where n <= 5",
    "p6_nearest": f"{_NEAR} select a vec_id, b neighbour, round(sqrt(s), 6) distance, n::int rank from d where n <= 5",
    "p9_found": f"select distinct doc_id, item_id from {_WINDOWS.format(k='doc_id', t='documents')} join {_WINDOWS.format(k='item_id', t='eval_items')} using (win)",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
