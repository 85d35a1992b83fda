"""Text functions as Spark columns: tokenisers, clips, slugs, escapes, displays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let

#: Section labels and the header lines that open them, in order of precedence.
SECTION_HEADERS = [
    ("abstract", r"(?i)^\s*abstract\s*$"),
    ("introduction", r"(?i)^\s*(1\.?\s*)?introduction\s*$"),
    ("background", r"(?i)^\s*(2\.?\s*)?(background|related work|prior work)\s*$"),
    ("methods", r"(?i)^\s*(\d+\.?\s*)?(method|methods|approach|methodology|model)\s*$"),
    ("experiments", r"(?i)^\s*(\d+\.?\s*)?(experiments?|setup|evaluation)\s*$"),
    ("results", r"(?i)^\s*(\d+\.?\s*)?(results?|findings?)\s*$"),
    ("discussion", r"(?i)^\s*(\d+\.?\s*)?(discussion|analysis)\s*$"),
    ("limitations", r"(?i)^\s*(\d+\.?\s*)?limitations?\s*$"),
    ("conclusion", r"(?i)^\s*(\d+\.?\s*)?(conclusion|conclusions?|summary)\s*$"),
]
#: Lines that end a section without opening another.
STOP_HEADERS = [r"(?i)^\s*references\s*$", r"(?i)^\s*acknowledgements?\s*$", r"(?i)^\s*bibliography\s*$", r"(?i)^\s*appendix\s*[A-Z]?\s*$"]
HEADER_LIMIT = 60


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def topic_terms(x: Column) -> Column:
    """Distinct lower-case ASCII runs of three characters or more, in order of first use."""
    return F.array_distinct(F.filter(F.split(F.lower(blank(x)), r"[^a-zA-Z0-9]+"), lambda t: F.length(t) >= 3))


def search_terms(x: Column) -> Column:
    """``topic_terms`` and the whole trimmed phrase."""
    phrase = strip(F.lower(blank(x)))
    return F.array_distinct(F.filter(F.concat(topic_terms(x), F.array(phrase)), lambda t: t != ""))


def embed_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank(x)), F.lit("[a-z0-9]+"), F.lit(0))


def sparse_tokens(x: Column) -> Column:
    """Letter and digit runs of any script, lower case, over two characters, with repeats."""
    return F.filter(F.split(F.lower(blank(x)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2)


def words(x: Column) -> Column:
    """Runs between white space, punctuation kept."""
    return F.filter(F.split(blank(x), r"(?U)\s+"), lambda w: w != "")


def first_sentence(x: Column) -> Column:
    """Up to the first full stop, trimmed, with one."""
    return F.concat(strip(F.substring_index(strip(blank(x)), ".", 1)), F.lit("."))


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def clip(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def excerpt(x: Column, n: int = 240) -> Column:
    return strip(clip(x, n))


def joined_lines(x: Column) -> Column:
    """Hyphens at line ends removed, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"-\s+", ""), r"\s+", " "))


def header_label(line: Column) -> Column:
    """Section that a line opens; ``''`` for a stop line; null for any other."""
    found = F.when(F.lit(False), F.lit(""))
    for pattern in STOP_HEADERS:
        found = found.when(line.rlike(pattern), F.lit(""))
    for label, pattern in SECTION_HEADERS:
        found = found.when((F.length(line) <= HEADER_LIMIT) & line.rlike(pattern), F.lit(label))
    return found


def xml_escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def description(x: Column, n: int = 40) -> Column:
    """First ``n`` words; ``...`` unless they end in a full stop."""
    text = F.array_join(F.slice(words(x), 1, n), " ")
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit("...")))


def duration_secs(x: Column, per_minute: int = 155, least: int = 60) -> Column:
    return F.greatest((F.size(words(x)) / F.lit(float(per_minute)) * 60).cast("int"), F.lit(least))


def authors_display(a: Column) -> Column:
    return F.concat(F.array_join(F.slice(a, 1, 3), ", "), F.when(F.size(a) > 3, " et al.").otherwise(""))


def slug(x: Column, default: str | None = None) -> Column:
    ends = F.regexp_replace(F.regexp_replace(F.lower(blank(x)), r"[^a-z0-9-]+", "-"), r"^-+|-+$", "")
    out = F.left(ends, F.lit(40))
    return out if default is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def title_clean(x: Column) -> Column:
    return F.regexp_replace(x, r"(?i): audio brief$", "")


def sentences(x: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(blank(x), r"\s+", " ")), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: s != "")


def paragraphs(script: Column) -> Column:
    """Blank-line paragraphs if there are several, else sentences in up to about four groups."""
    held = F.filter(F.transform(F.split(blank(script), r"\n{2,}"), strip), lambda p: p != "")

    def grouped(s: Column) -> Column:
        n = F.when(F.size(s) <= 4, F.greatest(F.size(s), F.lit(1))).otherwise(F.greatest(F.lit(3), F.ceil(F.size(s) / 4))).cast("int")
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / n).cast("int") - 1, F.lit(0))), lambda g: F.array_join(F.slice(s, g * n + 1, n), " "))
        return groups

    found = let(sentences(script), grouped)
    return F.when(blank(script) == "", F.array().cast("array<string>")).when(F.size(held) > 1, held).otherwise(found)


def parsed_list(x: Column) -> Column:
    """Comma list, trimmed, blanks dropped, order and repeats kept."""
    return F.filter(F.transform(F.split(blank(x), ","), lambda v: F.trim(v)), lambda v: v != "")


def cleaned_topics(a: Column) -> Column:
    return F.filter(F.transform(a, strip), lambda v: v != "")


def contains_fold(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def audio_url(base: Column, key: Column) -> Column:
    return F.concat(base, F.lit("/episodes/"), key.cast("string"), F.lit("/audio"))


def cache_key(provider: Column, script: Column) -> Column:
    return F.sha1(F.concat_ws(":", provider, F.lit("v2"), script))


def hash_bucket(token: Column, size: int = 48) -> Column:
    """First eight hex digits of SHA-256, modulo ``size``."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % size


def score_display(x: Column) -> Column:
    return F.format_string("%.3f", x)


def minutes(secs: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(secs / 60 + 0.5))


def topic_of(topics: Column, categories: Column, default: str = "general AI") -> Column:
    return F.coalesce(F.try_element_at(topics, F.lit(1)), F.try_element_at(categories, F.lit(1)), F.lit(default))


def pdf_link(links: Column, fallback: Column) -> Column:
    """href of the first link titled pdf, else the entry's own address."""
    return F.coalesce(F.get(F.filter(links, lambda x: x["title"] == "pdf"), F.lit(0))["href"], fallback)


def filled(template: str, **values: Column) -> Column:
    """``template`` with the names in braces replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
