"""Long-term memory as an append-only log of entries with views, conflicts, links and searches.

An entry has ``id, memory_type, namespace ARRAY, key, content, created_at, expires_at, invalidated_at, importance,
related_ids ARRAY, metadata MAP, ord``. Time is always the parameter ``as_of``. Searches take a DataFrame of queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.errors import NamespaceAccessError
from loomery.functions import text as T
from loomery.operators import blocks, bm25
from loomery.operators.ranking import fuse, top_k
from loomery.session import checkpoint

#: The types of entries.
TYPES = ["semantic", "entity", "episodic", "procedural", "preference", "decision"]
MOST_LINKS = 3


def time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def accepted(entries: DataFrame) -> Column:
    """Non-empty namespace, non-blank key and content, importance in [0, 1] or null. The type is not checked."""
    blank = lambda c: F.coalesce(T.strip(F.col(c)) == "", F.lit(True))
    return (F.coalesce(F.size("namespace"), F.lit(0)) > 0) & ~blank("key") & ~blank("content") & (F.col("importance").isNull() | F.col("importance").between(0.0, 1.0))


def is_expired(as_of: str) -> Column:
    return F.col("expires_at").isNotNull() & (F.col("expires_at") <= time(as_of))


def is_active(as_of: str) -> Column:
    return F.col("invalidated_at").isNull() & ~is_expired(as_of)


def latest(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row for each key: one aggregate, combined map-side, however many rows a key has."""
    newest = F.max_by(F.struct(*log.columns), F.struct(*order)).alias("row")
    return log.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(newest).select("row.*")


def in_namespace(namespace: Column, prefix: Column) -> Column:
    """Whether ``prefix`` is the beginning of ``namespace``."""
    return F.slice(namespace, 1, F.size(prefix)) == prefix


@dataclass
class MetadataFilter:
    equals: dict[str, str] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)
    created_after: datetime | str | None = None
    created_before: datetime | str | None = None

    def condition(self) -> Column:
        """All of: equal values, all tags present (``tags`` in the metadata is a JSON array), created within both bounds, inclusive."""
        out = F.lit(True)
        for name, value in self.equals.items():
            out = out & F.coalesce(F.try_element_at("metadata", F.lit(name)) == value, F.lit(False))
        if self.tags:
            have = F.coalesce(F.from_json(F.try_element_at("metadata", F.lit("tags")), "array<string>"), F.array().cast("array<string>"))
            out = out & (F.size(F.array_except(F.array(*map(F.lit, self.tags)), have)) == 0)
        if self.created_after is not None:
            out = out & (F.col("created_at") >= F.lit(self.created_after).cast("timestamp"))
        if self.created_before is not None:
            out = out & (F.col("created_at") <= F.lit(self.created_before).cast("timestamp"))
        return out


@dataclass
class NamespacePolicy:
    """Access by the beginning of the namespace; an empty prefix allows all, None nothing."""

    prefix: list[str] | None = field(default_factory=list)
    reads: bool = True
    writes: bool = True

    def allows(self, write: bool = False) -> Column:
        if self.prefix is None or not (self.writes if write else self.reads):
            return F.lit(False)
        return in_namespace(F.col("namespace"), F.array(*map(F.lit, self.prefix))) if self.prefix else F.lit(True)

    def visible(self, entries: DataFrame) -> DataFrame:
        return entries.where(self.allows())

    def enforce(self, entries: DataFrame, write: bool = True) -> DataFrame:
        if not entries.where(~self.allows(write)).isEmpty():
            raise NamespaceAccessError("namespace outside the allowed prefix", prefix=self.prefix)
        return entries


def invalidate(log: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """Soft delete: the open entries of the (namespace, key) pairs get ``invalidated_at``."""
    hit = keys.select("namespace", "key").distinct().withColumn("__hit", F.lit(True))
    out = log.join(hit, ["namespace", "key"], "left").withColumn("invalidated_at", F.when(F.col("__hit") & F.col("invalidated_at").isNull(), time(as_of)).otherwise(F.col("invalidated_at")))
    return out.select(log.columns)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    return log.join(keys.select("namespace", "key"), ["namespace", "key"], "left_anti")


def subject(entries: DataFrame) -> Column:
    meta = lambda name: F.try_element_at("metadata", F.lit(name))
    return T.folded(F.coalesce(meta("subject"), meta("name")))


def conflicts(new: DataFrame, existing: DataFrame, as_of: str, normal=T.folded) -> DataFrame:
    """``new_id, old_id``: active entries of the same namespace and type, with other content, that have the same key, or,
    for preferences and entities, the same subject. Two equi-joins, one for each rule, so no namespace is compared with
    itself pair by pair."""
    cols = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), "namespace", "memory_type", "key", normal(F.col("content")).alias(f"{p}_text"), subject(df).alias("subject"))
    left, right = cols(new, "new"), cols(existing.where(is_active(as_of)), "old")
    differs = (F.col("new_id") != F.col("old_id")) & (F.col("new_text") != F.col("old_text"))
    by_key = left.drop("subject").join(right.drop("subject"), ["namespace", "memory_type", "key"]).where(differs)
    typed = F.col("memory_type").isin("preference", "entity")
    by_subject = left.drop("key").where(typed & F.col("subject").isNotNull()).join(right.drop("key"), ["namespace", "memory_type", "subject"]).where(differs)
    return by_key.select("new_id", "old_id").union(by_subject.select("new_id", "old_id")).distinct()


def related(entries: DataFrame, found: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """``id, related_ids``: own links first, then those ``found`` (id, other, rank), without repeats or itself."""
    lines = found.where("id <> other").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("more"))
    own = F.coalesce("related_ids", F.array().cast("array<string>"))
    joined = entries.join(lines, "id", "left")
    both = F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select("id", F.slice(F.filter(both, lambda x: x != F.col("id")), 1, most).alias("related_ids"))


def reverse_links(new: DataFrame, existing: DataFrame, as_of: str, most: int = MOST_LINKS) -> DataFrame:
    """``id, related_ids`` of the active entries of the same namespace that new entries link to: the new ids, newest
    first, before the old links, at most ``most``. A window keeps only what fits, however often an entry is linked."""
    links = new.select(F.col("id").alias("from_id"), "namespace", "ord", F.explode(F.array_distinct("related_ids")).alias("id")).where("from_id <> id")
    recent = Window.partitionBy("id", "namespace").orderBy(F.col("ord").desc(), "from_id")
    links = links.withColumn("__n", F.row_number().over(recent)).where(F.col("__n") <= most)
    firsts = links.groupBy("id", "namespace").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "from_id"))), lambda x: x["from_id"]).alias("before"))
    hit = existing.where(is_active(as_of)).join(firsts, ["id", "namespace"])
    old = F.coalesce("related_ids", F.array().cast("array<string>"))
    return hit.select("id", F.slice(F.array_distinct(F.concat("before", old)), 1, most).alias("related_ids"))


def matching(queries: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """Each query with the active entries under its namespace prefix and of its type (null: any).

    Joined on the prefix as an array: an entry is listed under each of its prefixes, and lists are short, so the join is
    an equi-join on (prefix).
    """
    asked = queries.select("query_id", F.col("namespace").alias("prefix"), F.col("memory_type").alias("asked_type"), "query", "limit")
    levels = F.transform(F.sequence(F.lit(0), F.size("namespace")), lambda n: F.slice("namespace", 1, n))
    listed = entries.where(is_active(as_of) & F.col("namespace").isNotNull()).select("*", F.explode(levels).alias("prefix"))
    hit = listed.join(asked, "prefix")
    return hit.where(F.col("asked_type").isNull() | (F.col("asked_type") == F.col("memory_type"))).drop("prefix", "asked_type")


def fallback_search(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Without retrievers: exact namespace, type and least importance; by importance, then age. The text of the query and
    expiry play no part."""
    asked = queries.select("query_id", "namespace", F.col("memory_type").alias("asked_type"), "limit", "min_importance")
    hit = entries.where("invalidated_at IS NULL").join(asked, "namespace")
    hit = hit.where((F.col("asked_type").isNull() | (F.col("asked_type") == F.col("memory_type"))) & (F.col("min_importance").isNull() | F.col("importance").isNull() | (F.col("importance") >= F.col("min_importance"))))
    return top_k(hit.withColumn("score", F.coalesce("importance", F.lit(0.0))), ["query_id"], "score", F.col("limit"), ["ord"])


def searched(entries: DataFrame, as_of: str) -> DataFrame:
    """The active entries with what is searched of them as ``searchable``, written once; as it is when it is one already."""
    if "searchable" in entries.columns:
        return entries
    text = T.searchable(F.col("namespace"), F.col("memory_type"), F.col("key"), F.col("content"), F.col("metadata"))
    rows = entries.where(is_active(as_of) & F.col("namespace").isNotNull())
    return checkpoint(rows.select("id", "ord", "namespace", "memory_type", "importance", "created_at", text.alias("searchable")))


def scope(prefix: str, memory_type: str) -> Column:
    """A namespace prefix and a type (null: any) as one text."""
    return F.to_json(F.struct(F.col(prefix).alias("prefix"), F.col(memory_type).alias("type")))


def in_scopes(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Each ``searched`` entry once for every ``scope`` of the queries that it is in, however many queries have that."""
    asked = queries.select(F.col("namespace").alias("prefix"), F.col("memory_type").alias("asked_type")).distinct()
    levels = F.transform(F.sequence(F.lit(0), F.size("namespace")), lambda n: F.slice("namespace", 1, n))
    hit = stored.select("*", F.explode(levels).alias("prefix")).join(bm25.small(asked), "prefix")
    hit = hit.where(F.col("asked_type").isNull() | (F.col("asked_type") == F.col("memory_type")))
    return hit.withColumn("scope", scope("prefix", "asked_type")).drop("prefix", "asked_type")


def lexical_search(queries: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """BM25 among the candidates of each query, with their own statistics; scores over the best one, blended with the
    importance after ranking. A query without a hit falls back to the overlap of words. Queries of one namespace and type
    have the same candidates, so these are indexed once for all of them."""
    hit = in_scopes(queries, searched(entries, as_of))
    index = bm25.build(hit, "id", "searchable", "ord", "scope", more=("importance",))
    asked = queries.select("query_id", scope("namespace", "memory_type").alias("scope"), "query", "limit")
    most = queries.agg(F.max("limit")).first()[0] or 0
    found = bm25.best(index, bm25.query_terms(asked, "query_id", "query", "scope"), most)
    ranked = checkpoint(found.join(asked.select("query_id", "limit"), "query_id").where(F.col("rank") <= F.col("limit")))
    best = F.max("score").over(Window.partitionBy("query_id"))
    without = asked.where(F.size(T.terms(F.col("query"))) > 0).join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    bare = hit.join(bm25.small(without), "scope").withColumn("score", T.overlap(F.col("query"), F.col("searchable"))).where("score > 0")
    bare = top_k(bare, ["query_id"], "score", F.col("limit"), ["ord"]).withColumn("relevance", F.col("score"))
    columns = ["query_id", "rank", "id", "ord", "relevance", "importance"]
    both = ranked.withColumn("relevance", F.col("score") / best).select(columns).unionByName(bare.select(columns))
    return both.withColumn("score", T.blend(F.col("relevance"), F.col("importance")))


def episodic_search(queries: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """Mean of word overlap and recency; the type is episodic unless the query names one.

    An entry with a word of the query is found by ``blocks``. Of those without one only the newest of their namespace and
    type can be among the best, for nothing else tells them apart."""
    asked = queries.withColumn("memory_type", F.coalesce("memory_type", F.lit("episodic")))
    terms = asked.select("query_id", scope("namespace", "memory_type").alias("group"), "query", "limit", F.array_distinct(T.terms(F.col("query"))).alias("terms"))
    most = queries.agg(F.max("limit")).first()[0] or 0
    hit = in_scopes(asked, searched(entries, as_of)).withColumnRenamed("scope", "group").withColumn("recent", T.recency(F.col("created_at"), F.unix_micros(time(as_of))))
    weights = terms.select("query_id", "group", F.lit(0.0).alias("mean"), F.size("terms").alias("scale"), F.explode("terms").alias("token"), F.lit(1.0).alias("w"))
    docs = hit.select("group", "id", "ord", "importance", "recent", F.array_distinct(T.terms(F.col("searchable"))).alias("tokens"))
    met = blocks.best(docs, weights, weights.count(), most, lambda tf, docs, doc, mean: tf, lambda sums, scale, docs, doc: (sums / scale + docs["recent"].to_numpy()[doc]) / 2, ["importance", "recent"])
    met = met.join(terms.select("query_id", "limit", F.size("terms").alias("size")), "query_id").withColumn("relevance", F.col("sum") / F.col("size"))
    newest = Window.partitionBy("group").orderBy(F.round(F.col("recent") / 2, 9).desc(), "ord")
    few = hit.select("group", "id", "ord", "importance", "recent", "searchable", F.row_number().over(newest).alias("n")).where(F.col("n") <= most)
    other = few.join(terms, "group").withColumn("relevance", T.overlap(F.col("query"), F.col("searchable"))).where("relevance = 0")
    columns = ["query_id", "id", "ord", "limit", "relevance", "recent", "importance"]
    both = met.select(columns).unionByName(other.select(columns)).withColumn("mean", (F.col("relevance") + F.col("recent")) / 2)
    ranked = top_k(both, ["query_id"], "mean", F.col("limit"), ["ord"])
    return ranked.withColumn("score", T.blend(F.col("mean"), F.col("importance"))).select("query_id", "rank", "id", "ord", "relevance", "recent", "importance", "score")


def semantic_search(queries: DataFrame, hits: DataFrame, entries: DataFrame, as_of: str, hop: float = 0.9) -> DataFrame:
    """Vector ``hits`` (query_id, rank, id, score: ten times the limit) that match the query, blended with importance,
    and one hop along all their links. A linked entry has ``hop`` times the relevance of the first hit that links to it,
    blended with its own importance; a hit is worth its own score even where one is linked before. Collecting stops with
    the hit at which the limit is reached. A query has at most ten times its limit of hits, so the windows are small."""
    match = matching(queries, entries, as_of).select("query_id", "id", "ord", "importance", "related_ids", "limit")
    direct = hits.where("score > 0").join(match, ["query_id", "id"]).select("query_id", "rank", "id", "ord", "limit", F.col("score").alias("relevance"), "importance", "related_ids", F.lit(0).alias("hop"))
    links = direct.select("query_id", "rank", (F.col("relevance") * hop).alias("relevance"), F.explode("related_ids").alias("id"))
    linked = links.join(match, ["query_id", "id"]).withColumn("hop", F.lit(1))
    columns = ["query_id", "rank", "id", "ord", "limit", "relevance", "importance", "hop"]
    both = direct.select(columns).unionByName(linked.select(columns))
    first = Window.partitionBy("query_id", "id").orderBy("rank", "hop")
    both = both.withColumn("seen", F.row_number().over(first))
    upto = Window.partitionBy("query_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    kept = both.withColumn("before", F.coalesce(F.sum((F.col("seen") == 1).cast("int")).over(upto), F.lit(0))).where(F.col("before") < F.col("limit"))
    value = F.min(F.struct("hop", "rank", "relevance", "importance")).alias("v")
    entry = kept.groupBy("query_id", "id", "ord", "limit").agg(value).withColumn("score", T.blend(F.col("v.relevance"), F.col("v.importance")))
    return top_k(entry, ["query_id"], "score", F.col("limit"), ["ord"]).select("query_id", "rank", "id", "ord", "score")


def hybrid_search(lists: list[DataFrame], queries: DataFrame, routes: dict[str, list[int]] | None = None) -> DataFrame:
    """Fusion of ranked lists. ``routes`` names the numbers of the lists for each memory type; types without a route, and
    queries without a type, use that of ``*`` or all."""
    union = None
    for i, ranked in enumerate(lists):
        part = ranked.select("query_id", F.lit(i).alias("list_no"), "rank", "id", "score")
        union = part if union is None else union.unionByName(part)
    asked = queries.select("query_id", "memory_type", "limit")
    if routes:
        rows = [(t, i) for t, numbers in routes.items() for i in numbers]
        table = F.create_map(*[x for t, numbers in routes.items() for x in (F.lit(t), F.array(*map(F.lit, numbers)))])
        default = F.coalesce(F.try_element_at(table, F.lit("*")), F.array(*map(F.lit, range(len(lists)))))
        route = F.coalesce(F.try_element_at(table, F.coalesce("memory_type", F.lit("*"))), default)
        union = union.join(asked.select("query_id", route.alias("route")), "query_id").where(F.array_contains("route", F.col("list_no"))).drop("route") if rows else union
    fused = fuse(union)
    return fused.join(asked.select("query_id", "limit"), "query_id").where(F.col("rank") <= F.col("limit")).drop("limit")


def with_filters(ranked: DataFrame, entries: DataFrame, queries: DataFrame, metadata: MetadataFilter | None = None) -> DataFrame:
    """After the cut: entries fetched, then those of too little importance (null passes) and other metadata dropped, so
    the result may be shorter than the limit."""
    hit = ranked.join(entries.drop("ord", "importance"), "id") if "importance" in ranked.columns else ranked.join(entries.drop("ord"), "id")
    hit = hit.join(queries.select("query_id", "min_importance"), "query_id")
    hit = hit.where(F.col("min_importance").isNull() | F.col("importance").isNull() | (F.col("importance") >= F.col("min_importance")))
    return hit if metadata is None else hit.where(metadata.condition())


def context_lines(hits: DataFrame) -> DataFrame:
    """``query_id, context``: ``- [type] key: content`` in the order of the ranks."""
    line = F.concat(F.lit("- ["), F.col("memory_type"), F.lit("] "), F.col("key"), F.lit(": "), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("context"))


def reflection_sources(entries: DataFrame, most: int = 20) -> DataFrame:
    """Of each namespace the active entries, no reflections, of the greatest importance, newest first."""
    own = F.coalesce(F.try_element_at("metadata", F.lit("source")), F.lit("")) != "reflection"
    chosen = entries.where(own & F.col("invalidated_at").isNull()).withColumn("weight", F.coalesce("importance", F.lit(0.0)))
    order = Window.partitionBy("namespace").orderBy(F.col("weight").desc(), F.col("created_at").desc(), "ord")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def reflection_points(entries: DataFrame, most_count: int = 10, most_importance: float = 3.0) -> DataFrame:
    """``namespace, ord, observed, importance_sum`` for each entry at which the number of entries or the sum of
    importances since the last point reaches its limit. Sequential in a namespace: rows are streamed in order, never a
    namespace as a whole."""
    rows = entries.select(F.array_join("namespace", "/").alias("namespace"), "created_at", "ord", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    ordered = rows.repartition("namespace").sortWithinPartitions("namespace", "created_at", "ord")

    def run(batches):
        import pandas as pd

        at, count, total = None, 0, 0.0
        for pdf in batches:
            out = []
            for ns, o, imp in zip(pdf["namespace"], pdf["ord"], pdf["importance"]):
                if ns != at:
                    at, count, total = ns, 0, 0.0
                count += 1
                total += imp
                if count >= most_count or total >= most_importance:
                    out.append((ns, o, count, total))
                    count, total = 0, 0.0
            yield pd.DataFrame(out, columns=["namespace", "ord", "observed", "importance_sum"])

    return ordered.mapInPandas(run, "namespace string, ord bigint, observed bigint, importance_sum double")


def every_nth(messages: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The rows at which an interval trigger fires: every ``n``-th of a group."""
    return messages.withColumn("seen", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("seen") % n == 0)


def at_least(messages: DataFrame, by: list[str], n: int) -> DataFrame:
    """The groups for which a least-messages trigger fires."""
    return messages.groupBy(*by).agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= n)


def extracted(replies: DataFrame, reply: str) -> tuple[DataFrame, DataFrame]:
    """(entries, invalidated): records of an extraction model's JSON replies. ``operation`` invalidate gives a key, all
    else an entry; unknown types become semantic, importance is clamped, records without key or content drop out."""
    record = "array<struct<operation:string,memory_type:string,key:string,content:string,importance:string,metadata:map<string,string>>>"
    found = F.from_json(F.to_json(F.try_variant_get(T.json_object(F.col(reply)), "$.records", "variant")), record)
    rows = replies.select("*", F.explode(found).alias("__r")).select(*replies.columns, "__r.*")
    gone = rows.where((F.col("operation") == "invalidate") & T.optional_text(F.col("key")).isNotNull()).select(*replies.columns, "key")
    kept = rows.where(~F.coalesce(F.col("operation") == "invalidate", F.lit(False)) & T.optional_text(F.col("key")).isNotNull() & T.optional_text(F.col("content")).isNotNull())
    kept = kept.withColumn("memory_type", F.when(F.lower("memory_type").isin(TYPES), F.lower("memory_type")).otherwise("semantic")).withColumn("importance", T.optional_float(F.col("importance")))
    return kept.drop("operation").withColumn("extracted_by", F.lit("llm")), gone
