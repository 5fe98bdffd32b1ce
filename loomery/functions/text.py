"""Scalar text functions as Columns, equal to their Python namesakes on all assigned code points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.errors import OVERFLOW_MARKERS

#: White space as str.isspace has it, for a regex class.
SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def overlap(query: Column, content: Column) -> Column:
    """Share of the query's distinct terms that the content has; 0 when either has none."""
    q, c = F.array_distinct(terms(query)), F.array_distinct(terms(content))
    return F.when((F.coalesce(F.size(q), F.lit(0)) <= 0) | (F.coalesce(F.size(c), F.lit(0)) <= 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.regexp_replace(strip(text), rf"[{SPACE}]+", " ")


def folded(text: Column) -> Column:
    """Case-folded with collapsed white space. Stays in the JVM for ASCII, where lower case is the same."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(t.casefold().split()), na_action="ignore")

    ascii_only = text.rlike(r"^\p{ASCII}*\z")
    return F.when(ascii_only, collapse(F.lower(text))).otherwise(fold(F.when(~ascii_only, text)))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def blend(relevance: Column, importance: Column) -> Column:
    """Both are brought into [0, 1] before they are weighed; without an importance the relevance counts alone."""
    return F.when(importance.isNull(), clamp(relevance)).otherwise(clamp(clamp(relevance) * 0.7 + clamp(importance) * 0.3))


def recency(created: Column, as_of_us: Column, rate: float = 0.01) -> Column:
    """exp(-rate * age in hours); the future counts as now."""
    return F.exp(F.lit(-rate) * F.greatest(F.lit(0.0), (as_of_us - F.unix_micros(created)) / F.lit(3.6e9)))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def cosine(a: Column, b: Column) -> Column:
    """In DOUBLE; 0 when a norm is 0; the dot product stops at the shorter vector, the norms don't."""

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def token_estimate(content: Column, tool_chars: Column | None = None, per_token: float = 4.0, overhead: int = 4) -> Column:
    size = F.coalesce(F.length(content), F.lit(0))
    if tool_chars is not None:
        size = size + F.coalesce(tool_chars, F.lit(0))
    return F.lit(overhead) + F.ceil(size / F.lit(per_token)).cast("int")


def truncated_result(content: Column, role: Column, most: int) -> Column:
    """Of a long tool result its head and tail around a note of what was left out."""
    head, tail = most // 2, most - most // 2
    right = F.regexp_replace(F.substring(content, 1, head), rf"[{SPACE}]+\z", "")
    left = F.regexp_replace(F.right(content, F.lit(tail)), rf"^[{SPACE}]+", "")
    note = F.concat(F.lit("\n...["), (F.length(content) - most).cast("string"), F.lit(" characters truncated]...\n"))
    return F.when((role == "tool") & (F.length(content) > most), F.concat(right, note, left)).otherwise(content)


def fences_stripped(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^`+(?:json)?|`+\z", ""), r"^json(?=\s*[{\[])", ""))


def json_object(text: Column) -> Column:
    """The text when it is JSON, else its part from the first { to the last }, else null; as VARIANT. In Python, for the
    JVM's parser ignores what follows a value."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        import json

        def one(t: str) -> str | None:
            for part in (t.strip(), t[max(0, t.find("{")) : t.rfind("}") + 1]):
                try:
                    return json.dumps(json.loads(part))
                except ValueError:
                    continue
            return None

        return texts.map(one, na_action="ignore")

    return F.try_parse_json(read(text))


def optional_float(text: Column) -> Column:
    return clamp(text.try_cast("double"))


def optional_text(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def searchable(namespace: Column, memory_type: Column, key: Column, content: Column, metadata: Column) -> Column:
    """Namespace, type, key, content and metadata values in one text, without blank parts."""
    parts = F.concat(F.array(F.array_join(namespace, " "), memory_type, key, content), F.coalesce(F.map_values(metadata), F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p.isNotNull() & (p != "")), " ")


def is_overflow(message: Column) -> Column:
    """Whether an error message says that a prompt is too long; null for null."""
    return F.exists(F.array(*map(F.lit, OVERFLOW_MARKERS)), lambda marker: F.contains(F.lower(message), marker))


def safe_name(session_id: Column) -> Column:
    """A session id as a file name."""
    return F.regexp_replace(session_id, r"[^\p{L}\p{N}\-_.]", "_")


def charset(content_type: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w-]+)", 1)), F.lit("")), F.lit("utf-8"))


def batches_of(texts: list[str], size: int) -> Iterator[list[str]]:
    for at in range(0, len(texts), size):
        yield texts[at : at + size]
