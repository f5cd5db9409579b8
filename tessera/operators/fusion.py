"""Reciprocal-rank fusion of two ranked lists, hybrid search, context and prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from . import lexical, vector

RRF = 60


def rrf(vectors: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """(q, chunk, rrf, vector_rank, bm25_rank, rank) of both lists together, the k best per question."""
    both = vectors.select("q", "chunk", F.col("rank").alias("vector_rank")).join(words.select("q", "chunk", F.col("rank").alias("bm25_rank")), ["q", "chunk"], "full_outer")
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", share("vector_rank") + share("bm25_rank"))
    order = Window.partitionBy("q").orderBy(F.round("rrf", 12).desc(), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(chunks: DataFrame, questions: DataFrame, index: lexical.Index | None = None, vector_k: int = 10, bm25_k: int = 10, k: int = 10) -> DataFrame:
    """Vector and lexical top lists, each cut before they are fused.

    ``chunks``: chunk_seq, content, file_path, embedding; ``questions``:
    query_id, question, query_vector.
    """
    questions, _ = small(questions, vector.BLOCK)
    index = index or lexical.build(chunks)
    near = vector.top(chunks.where(F.col("embedding").isNotNull()), questions, vector_k, "chunk_seq")
    return rrf(near, lexical.top(index, chunks, questions, bm25_k), k)


def context(rank: Column, path: Column, content: Column, start_line: Column | None = None) -> Column:
    """An aggregate: the numbered passages in order of rank."""
    line = F.lit("") if start_line is None else F.when(F.coalesce(start_line, F.lit(0)) != 0, F.concat(F.lit(" (行 "), start_line.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    # The wording around each passage.
    passage = F.concat(F.lit("[文档 "), rank.cast("string"), F.lit("] 文件: "), path, line, F.lit("\n"), content, F.lit("\n"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), passage.alias("p")))), lambda x: x["p"]), "\n")


# The wording of the prompt.
PROMPT_HEAD = "你是一个专业的代码分析助手，请根据提供的代码仓库内容回答用户问题。\n\n上下文信息：\n"
PROMPT_QUESTION = "\n\n用户问题："
PROMPT_TAIL = "\n\n请根据上述上下文信息回答问题。如果上下文中没有相关信息，请明确说明。回答时请：\n1. 提供准确、具体的信息\n2. 引用相关的文件名和行号\n3. 解释代码的功能和逻辑\n4. 如果涉及多个文件，请说明它们之间的关系\n\n回答："


def prompt(question: Column, passages: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), passages, F.lit(PROMPT_QUESTION), question, F.lit(PROMPT_TAIL))
