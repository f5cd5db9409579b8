"""Lexical retrieval: inverted index, BM25 and the file-name boost, for one question or many.

Token sets make every term frequency 0 or 1 and a chunk's length its number of
distinct tokens.  The index is built once and kept; a search joins the tokens of
its questions with the postings on the token, and only chunks that share a token
come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import small

K1, B, EPSILON = 1.5, 0.75, 0.25
PATTERN_CHARS = 16_000_000
TOKENS = 200_000


@dataclass
class Index:
    postings: DataFrame  # (chunk, dl, token)
    lengths: DataFrame  # (chunk, dl)
    idf: DataFrame  # (token, df, idf): floored
    stats: dict[str, float]  # chunks, avgdl, mean_idf, terms
    kept: list[DataFrame]  # what stays in memory or on disk

    def clear(self) -> None:
        for df in self.kept:
            df.unpersist()


def build(chunks: DataFrame, chunk: str = "chunk_seq", content: str = "content", path: str = "file_path") -> Index:
    both = F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(path, F.lit("")))
    kept = chunks.select(F.col(chunk).alias("chunk"), text.tokens(both).alias("tokens")).persist(StorageLevel.MEMORY_AND_DISK)
    lengths = kept.select("chunk", F.size("tokens").alias("dl"))
    postings = kept.select("chunk", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    df = postings.groupBy("token").agg(F.count("*").alias("df")).persist(StorageLevel.MEMORY_AND_DISK)
    size = lengths.agg(F.count("*").alias("chunks"), F.avg("dl").alias("avgdl")).first()
    n = float(size["chunks"])
    raw = df.select("token", "df", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    terms = raw.agg(F.avg("raw").alias("mean_idf"), F.count("*").alias("terms")).first()
    floor = EPSILON * (terms["mean_idf"] or 0.0)
    idf = raw.select("token", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))
    stats = {"chunks": size["chunks"], "avgdl": size["avgdl"] or 0.0, "mean_idf": terms["mean_idf"] or 0.0, "terms": terms["terms"]}
    return Index(postings, lengths, idf, stats, [df, kept])


def question_tokens(questions: DataFrame, key: str, question: str) -> DataFrame:
    return questions.select(F.col(key).alias("q"), F.explode(text.tokens(F.col(question))).alias("token"))


def scores(index: Index, questions: DataFrame, key: str = "query_id", question: str = "question") -> DataFrame:
    """(q, chunk, bm25) of chunks that share a token with the question.

    The questions' tokens are broadcast up to ``TOKENS`` of them; postings then are neither shuffled nor sorted, only sums are.
    """
    wanted, few = small(question_tokens(questions, key, question), TOKENS)
    hint = F.broadcast if few else (lambda df: df)
    terms = index.idf.join(hint(wanted.select("token").distinct()), "token", "left_semi").select("token", "idf")
    # every posting belongs to a chunk with tokens, so the mean length is not 0
    part = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.lit(index.stats["avgdl"] or 1.0)))
    weighed = index.postings.join(hint(terms), "token").select("token", "chunk", part.alias("part"))
    return weighed.join(hint(wanted), "token").groupBy("q", "chunk").agg(F.sum("part").alias("bm25"))


def patterns(questions: DataFrame, key: str, question: str) -> DataFrame:
    """(q, pattern): every file name among the question's tokens, and its stem; repetitions stay."""
    names = question_tokens(questions, key, question).where(F.col("token").rlike(r"^[a-zA-Z0-9_-]+\.[a-zA-Z0-9]+$"))
    return names.select("q", F.explode(F.array("token", F.split_part("token", F.lit("."), F.lit(1)))).alias("pattern"))


def boost(chunks: DataFrame, questions: DataFrame, key: str = "query_id", question: str = "question", chunk: str = "chunk_seq", path: str = "file_path") -> DataFrame:
    """(q, chunk, bonus): 10 for an exact name, 5 within the name, 2 within the path, per pattern.

    All patterns are looked for in each path at once by an automaton; sets of
    patterns beyond ``PATTERN_CHARS`` are searched in parts.
    """
    wanted, _ = small(patterns(questions, key, question), TOKENS)
    distinct = wanted.select("pattern").distinct()
    chars = distinct.agg(F.sum(F.length("pattern"))).first()[0] or 0
    parts, found = chars // PATTERN_CHARS + 1, None
    paths = chunks.where(F.col(path) != "").select(F.col(chunk).alias("chunk"), F.lower(path).alias("path"))
    kind = paths.schema["chunk"].dataType.simpleString()
    for k in range(parts):
        some = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        words = paths.sparkSession.sparkContext.broadcast([r[0] for r in some.collect()])

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for w in words.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                if words.value:
                    for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        rows += [(c, p, w) for w in {w for _, w in automaton.iter(p)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema[0].type), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], ["chunk", "path", "pattern"])

        one = paths.mapInArrow(run, f"chunk {kind}, path string, pattern string")
        found = one if found is None else found.unionByName(one)
    name = F.element_at(F.split(F.col("path"), r"[/\\]"), -1)
    exact = (F.col("pattern") == name) | (F.col("pattern") == F.split_part(name, F.lit("."), F.lit(1)))
    points = F.when(exact, 10.0).when(F.contains(name, F.col("pattern")), 5.0).otherwise(0.0) + 2.0
    return found.withColumn("points", points).join(wanted, "pattern").groupBy("q", "chunk").agg(F.sum("points").alias("bonus"))


def top(index: Index, chunks: DataFrame, questions: DataFrame, k: int = 10, key: str = "query_id", question: str = "question", chunk: str = "chunk_seq", path: str = "file_path") -> DataFrame:
    """(q, chunk, score, rank): the k best chunks with a positive score; ties by chunk."""
    both = scores(index, questions, key, question).join(boost(chunks, questions, key, question, chunk, path), ["q", "chunk"], "full_outer")
    total = F.round(F.coalesce("bm25", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)), 6)
    return ranked(both.select("q", "chunk", total.alias("score")).where("score > 0"), F.col("score").desc(), k)


def ranked(rows: DataFrame, order: Column, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(order, "chunk"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
