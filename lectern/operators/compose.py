"""Grounding check, template scripts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import filled, first_sentence, words

VERIFIED_FROM = 0.3
#: Notes of the grounding check.
NOTES = {
    "verified": "Script language overlaps strongly with retrieved source chunks.",
    "flagged": "Script contains terms that may not be fully grounded in the retrieved context.",
}


def long_words(x: Column, over: int = 4) -> Column:
    return F.array_distinct(F.filter(words(F.lower(x)), lambda w: F.length(w) > over))


def overlap(script: Column, source: Column) -> Column:
    """Share of the script's distinct long words that the source has."""
    mine = long_words(script)
    return F.size(F.array_intersect(mine, long_words(source))) / F.greatest(F.size(mine), F.lit(1))


def grounded(scripts: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, overlap, qa_status, qa_notes) by semi-join of exploded words: for sources of any length."""
    mine = scripts.select(key, F.explode_outer(long_words(F.col("script"))).alias("w"))
    held = chunks.select(key, F.explode(long_words(F.col("content"))).alias("w")).distinct().withColumn("hit", F.lit(1))
    share = (F.count("hit") / F.greatest(F.count("w"), F.lit(1))).alias("overlap")
    found = mine.join(held, [key, "w"], "left").groupBy(key).agg(share)
    status = F.when(F.col("overlap") >= VERIFIED_FROM, "verified").otherwise("flagged")
    notes = F.when(F.col("overlap") >= VERIFIED_FROM, NOTES["verified"]).otherwise(NOTES["flagged"])
    return found.select(key, "overlap", status.alias("qa_status"), notes.alias("qa_notes"))


def section_pick(name: str, retrieved: Column, given: Column, abstract: Column) -> Column:
    """First sentence of a section: retrieved, else given, else of the abstract (maps label -> text)."""
    return first_sentence(F.coalesce(F.try_element_at(retrieved, F.lit(name)), F.try_element_at(given, F.lit(name)), abstract))


#: Fixed value: the template script.
SCRIPT = (
    "If you care about {focus}, today's paper is interesting because {hook} "
    "The paper, titled {title}, focuses on a practical bottleneck in modern AI systems. {introduction} "
    "The main takeaway is that {results} "
    "Under the hood, the authors use a relatively simple idea: {methods} "
    "What makes it worth watching next is the broader implication. {conclusion} "
    "For a daily podcast format, that means the work is both technically credible and easy to map to where the field may move next."
)
#: What stands for topics where there are none.
NO_FOCUS, NO_AUDIENCE = "your tracked research topics", "general AI research"


def script(title: Column, abstract: Column, retrieved: Column, given: Column, topics: Column) -> Column:
    picks = {name: section_pick(name, retrieved, given, abstract) for name in ("introduction", "results", "methods", "conclusion")}
    focus = F.when(F.size(topics) > 0, F.array_join(F.slice(topics, 1, 3), ", ")).otherwise(NO_FOCUS)
    return filled(SCRIPT, focus=focus, hook=first_sentence(abstract), title=title, **picks)


def last_content(chunks: DataFrame, key: str) -> DataFrame:
    """(key, retrieved map section -> content): the lowest-ranked chunk of a section wins."""
    each = chunks.groupBy(key, "section").agg(F.max_by("content", "rank").alias("content"))
    return each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", "content"))).alias("retrieved"))


#: Fixed value: the system prompt for a language model.
SYSTEM_PROMPT = (
    "You are a senior research analyst writing 6-9 minute audio briefs for a daily AI research "
    "podcast. Write conversational, technically accurate narration grounded ONLY in the provided "
    "paper content. Open with the single most surprising or counterintuitive result. Then explain: "
    "(1) the problem the paper addresses and why it matters, (2) the core method or mechanism — "
    "in plain language, but with specifics, no hand-waving, (3) the key quantitative results "
    "and how they were measured, (4) limitations the authors call out or that follow from the "
    "method, (5) what this means for the field — what becomes possible or what's now in question. "
    "Use 800–1200 words. No bullet points, no markdown, no headers — pure spoken prose, broken "
    "into 4-7 paragraphs. Do not invent results that aren't in the source material. Do not pad."
)
#: Fixed value: the prompt for a language model.
PROMPT = """PAPER: {title}
AUTHORS: {authors}
CATEGORIES: {categories}
AUDIENCE TOPICS: {topics}

PAPER ABSTRACT:
{abstract}

RETRIEVED PAPER SECTIONS:
{chunks}

Write the 6-9 minute narration now. 800-1200 words. Pure spoken prose."""


def prompt(title: Column, authors: Column, categories: Column, topics: Column, abstract: Column, chunks: Column) -> Column:
    """Prompt from at most five topics and fourteen ordered chunks (array<struct<section, content>>)."""
    line = F.when(F.size(topics) > 0, F.array_join(F.slice(topics, 1, 5), ", ")).otherwise(NO_AUDIENCE)
    body = F.array_join(F.transform(F.slice(chunks, 1, 14), lambda c: F.concat(F.lit("["), c["section"], F.lit("]\n"), c["content"])), "\n\n")
    return filled(PROMPT, title=title, authors=F.array_join(authors, ", "), categories=F.array_join(categories, ", "), topics=line, abstract=abstract, chunks=body)


#: Fixed value: the least number of characters of a question.
SHORTEST_QUESTION = 3


def asks(question: Column) -> Column:
    """Whether a trimmed question is long enough to be sent."""
    return F.length(F.trim(question)) >= SHORTEST_QUESTION


def patched_turns(turns: DataFrame, answers: DataFrame, keys: list[str], text: str, answer: str) -> DataFrame:
    """``turns`` with ``shown``: the answer that came for a turn, else its own trimmed text."""
    return turns.join(answers.select(*keys, F.col(answer).alias("_answer")), keys, "left").withColumn("shown", F.coalesce("_answer", F.trim(text))).drop("_answer")
