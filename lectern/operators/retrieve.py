"""Retrieval of chunks: dense or sparse cosine, section bonus, top k; extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.text import filled, first_sentence, sparse_tokens, strip
from lectern.functions.vectors import cosine

#: Bonus of each section; others have none.
SECTION_BONUS = {"abstract": 0.18, "results": 0.16, "conclusion": 0.12, "discussion": 0.10, "limitations": 0.10, "methods": 0.08, "introduction": 0.06}


def bonus(section: Column) -> Column:
    out = F.lit(0.0)
    for name, value in SECTION_BONUS.items():
        out = F.when(section == name, F.lit(value)).otherwise(out)
    return out


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf)."""
    return rows.select(key, F.explode(sparse_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def sparse_cosine(queries: DataFrame, chunks: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(query key q, chunk key c, similarity) of pairs with a common token, from term counts (q, token, tf) and (c, token, tf).

    Tokens meet by an equi-join on token (and ``on``); tokens that no query has are dropped first.
    """
    keys = [*(on or []), "token"]
    length = lambda df, key: df.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("len"))
    q, c = queries.withColumnRenamed("tf", "qtf"), chunks.withColumnRenamed("tf", "ctf")
    dots = q.join(c, keys).groupBy("q", "c").agg(F.sum(F.col("qtf") * F.col("ctf")).alias("dot"))
    with_q = dots.join(length(queries, "q").withColumnRenamed("len", "ql"), "q")
    return with_q.join(length(chunks, "c").withColumnRenamed("len", "cl"), "c").select("q", "c", (F.col("dot") / (F.col("ql") * F.col("cl"))).alias("similarity"))


def top_k(rows: DataFrame, by: str, score: str, order: str, k: int) -> DataFrame:
    """The best ``k`` rows of each value of ``by``, with their ``rank``; ties keep ``order``."""
    best = Window.partitionBy(by).orderBy(F.col(score).desc(), order)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def term_map(x: Column) -> Column:
    """Map token -> count of a text's sparse tokens, from the runs of the sorted tokens."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        sizes = lambda at: F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i)
        pairs = let(starts, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), sizes(at)))
        return F.when(F.size(s) == 0, F.create_map().cast("map<string,int>")).otherwise(pairs)

    return let(F.sort_array(sparse_tokens(x)), counted)


def sparse_similarity(a: Column, b: Column) -> Column:
    """Cosine of two term maps; 0 where one is empty."""
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, n: s + n.cast("long") * n)
    dot = F.aggregate(F.map_entries(b), F.lit(0).cast("long"), lambda s, e: s + e["value"].cast("long") * F.coalesce(F.try_element_at(a, e["key"]), F.lit(0)))
    return F.coalesce(F.try_divide(dot, F.sqrt(square(a)) * F.sqrt(square(b))), F.lit(0.0))


def scored(chunks: DataFrame, questions: DataFrame, held: Column | None = None) -> DataFrame:
    """Chunks of each paper with the ``score`` for its question.

    ``chunks``: paper, c (orders ties), section, content, embedding.  ``questions``: paper, question, vector.
    A paper's chunks are compared by vectors only if all have one and the question has, too; one
    chunk without makes the whole paper's comparison sparse.  That flag is a sum by paper, without
    the texts; similarities are made in the row in which a chunk has met its question.  Where vectors are
    made on the way, ``held`` tells whether a chunk gets one, so that they are not made for the flag, too.
    """
    present = lambda v: F.coalesce(F.size(v) > 0, F.lit(False))
    whole = chunks.groupBy("paper").agg(F.bool_and(present(F.col("embedding")) if held is None else held).alias("_whole"))
    asked = questions.join(whole, "paper").withColumn("dense", F.col("_whole") & present(F.col("vector"))).drop("_whole")
    asked = asked.withColumn("_terms", F.when(~F.col("dense"), term_map(F.col("question"))))
    met = chunks.join(asked, "paper")
    similar = F.when(F.col("dense"), cosine(F.col("embedding"), F.col("vector"))).otherwise(let(term_map(F.col("content")), lambda m: sparse_similarity(m, F.col("_terms"))))
    return met.withColumn("similarity", similar).withColumn("score", F.col("similarity") + bonus(F.col("section"))).drop("vector", "_terms")


def retrieved(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` chunks of each paper, with their rank; arguments as for ``scored``."""
    return top_k(scored(chunks, questions), "paper", "score", "c", k)


#: The sentences of an answer.
LEAD = "Based on {title}, the clearest answer is that {sentence}"
LATER = "In the {section} section, the paper adds that {sentence}"
CLOSE = "This response is grounded in the paper sections most related to: {question}."
NOTHING = "The paper {title} does not have indexed chunks yet."


def answer(title: Column, chunks: Column, question: Column) -> Column:
    """Text from ordered ``chunks``, array<struct<section, content>>."""
    lead = filled(LEAD, title=title, sentence=first_sentence(F.get(chunks, F.lit(0))["content"]))
    later = F.transform(F.slice(chunks, 2, 1 << 30), lambda c: filled(LATER, section=c["section"], sentence=first_sentence(c["content"])))
    whole = F.concat_ws(" ", lead, F.array_join(later, " "), filled(CLOSE, question=strip(question)))
    return F.when(F.size(chunks) > 0, whole).otherwise(filled(NOTHING, title=title))
