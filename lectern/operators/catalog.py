"""Queries of a reading catalog: listings, audits, rollups, shelves.  Tables are DataFrames with ``lectern.schemas``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scripts import on_column, strip_marks
from lectern.functions.text import blank, project_citation, section_key, tag_list


def _last(c: str) -> list[Column]:
    """Nulls last, then larger values first."""
    return [F.col(c).isNull(), F.col(c).desc()]


#: Fixed value: how words of artifacts were counted.
WORD_COUNT_METHOD = "whitespace_tokens"


def work_metrics(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("work_id").agg(
        F.count("*").alias("artifact_count"),
        F.sum(F.coalesce("segment_count", F.lit(0))).cast("bigint").alias("segment_count"),
        F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("word_count"),
    )


def author_identity(prefix: str = "") -> Column:
    """What counts as one author: a non-blank id, else a known name, else nothing."""
    author_id, author = F.col(f"{prefix}author_id"), F.col(f"{prefix}author")
    known = ~blank(author) & (F.lower(F.trim(author)) != "unknown")
    return F.when(~blank(author_id), author_id).when(known, author)


def list_collections(works: DataFrame, artifacts: DataFrame) -> DataFrame:
    joined = works.join(work_metrics(artifacts), "work_id", "left")
    return joined.groupBy("collection_id").agg(
        F.count("*").alias("work_count"),
        F.coalesce(F.sum("segment_count"), F.lit(0)).alias("segment_count"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("word_count"),
        F.lit(WORD_COUNT_METHOD).alias("word_count_method"),
    )


SORTS = {
    "catalog": lambda: ["language", "author", "title", "work_id"],
    "popularity": lambda: [*_last("popularity_score"), "language", "author", "title", "work_id"],
    "global": lambda: [*_last("global_popularity_score"), *_last("popularity_score"), "language", "title", "work_id"],
    "group": lambda: [*_last("group_popularity_score"), *_last("popularity_score"), "language", "title", "work_id"],
}


def list_works(
    works: DataFrame,
    classifications: DataFrame | None = None,
    aliases: DataFrame | None = None,
    attributions: DataFrame | None = None,
    *,
    language: str | None = None,
    collection_id: str | None = None,
    author: str | None = None,
    author_id: str | None = None,
    attributed_to: str | None = None,
    scope: str | None = None,
    group: str | None = None,
    tag: str | None = None,
    query: str | None = None,
    sort: str = "catalog",
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Works that meet every given condition, sorted, then cut.

    ``author`` is a substring in any case and leaves out names that start with "pseudo-", unless it asks for them.
    ``attributed_to`` takes works of such an author, or with an accepted attribution to one.  ``query`` looks into title,
    author, ids and aliases.  ``group`` and ``tag`` are equal in any case, ``scope`` is a substring of scope or category.
    """
    out = works
    for column, value in (("language", language), ("collection_id", collection_id), ("author_id", author_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if author is not None:
        out = out.filter(_author_like(author))
    if attributed_to is not None:
        agreed = F.lower("agent").contains(attributed_to.lower()) & (F.col("status") == "accepted")
        ids = attributed_work_ids(works, attributions.filter(agreed)) if attributions is not None else None
        own = out.filter(_author_like(attributed_to))
        more = out.join(ids, "work_id", "left_semi") if ids is not None else own
        out = own.unionByName(more).dropDuplicates(["work_id"])
    if query is not None:
        q = query.lower()
        fields = ["title", "author", "work_id", "source_id", "canonical_text_id"]
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(f).contains(q), F.lit(False))
        if aliases is not None:
            named = aliases.filter(F.lower("alias").contains(q)).select(F.col("target").alias("work_id")).distinct()
            marked = out.join(named.withColumn("_named", F.lit(True)), "work_id", "left")
            out = marked.filter(hit | F.coalesce("_named", F.lit(False))).drop("_named")
        else:
            out = out.filter(hit)
    if classifications is not None:
        scores = [c for c in classifications.columns if c != "work_id"]
        wanted = classifications
        if scope is not None:
            like = F.lower(F.coalesce("scope", F.lit(""))).contains(scope.lower())
            wanted = wanted.filter(like | F.lower(F.coalesce("category", F.lit(""))).contains(scope.lower()))
        if group is not None:
            wanted = wanted.filter(F.lower("discovery_group_id") == group.lower())
        if tag is not None:
            wanted = wanted.filter(F.array_contains(F.transform(tag_list(F.col("discovery_tags")), F.lower), tag.lower()))
        needed = scope is not None or group is not None or tag is not None
        out = out.join(wanted.select("work_id", *scores), "work_id", "inner" if needed else "left")
    out = out.orderBy(*SORTS[sort]())
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def _author_like(text: str) -> Column:
    name = F.lower("author")
    like = name.contains(text.lower())
    return like if text.lower().startswith("pseudo") else like & ~name.startswith("pseudo-")


def attributed_work_ids(works: DataFrame, attributions: DataFrame) -> DataFrame:
    """Works that attributions match, by any of their fields: an equi-join on (collection, field, value) instead of an OR."""
    fields = {"work_id": "work_id", "source_id": "source_id", "cts_work_urn": "cts_work_urn", "author": "author"}
    keys = F.array(*(F.struct(F.lit(k).alias("match_field"), F.col(c).alias("match_value")) for k, c in fields.items()))
    keyed = works.select("work_id", "collection_id", F.inline(keys))
    return keyed.join(attributions, ["collection_id", "match_field", "match_value"], "left_semi").select("work_id").distinct()


def list_authors(works: DataFrame) -> DataFrame:
    return works.groupBy("author_id", "author", "language", "collection_id").agg(F.count("*").alias("work_count"))


def author_summaries(works: DataFrame, artifacts: DataFrame, classifications: DataFrame, titles: int = 8) -> DataFrame:
    """Works, words and up to ``titles`` titles of each author, the most popular first."""
    per_work = works.join(work_metrics(artifacts), "work_id", "left").join(
        classifications.select("work_id", "popularity_score", "global_popularity_score", "group_popularity_score"), "work_id", "left"
    )
    score = F.coalesce("global_popularity_score", "popularity_score", "group_popularity_score", F.lit(0))
    by_title = per_work.groupBy("author", "title").agg(
        F.max(score).alias("score"), F.max(F.coalesce("word_count", F.lit(0))).alias("words")
    )
    w = Window.partitionBy("author").orderBy(F.desc("score"), F.desc("words"), "title")
    top = by_title.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= titles)
    listed = top.groupBy("author").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "title"))), lambda x: x["title"]), " | ").alias("titles")
    )
    counts = per_work.groupBy("author").agg(
        F.countDistinct("work_id").alias("work_count"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("word_count")
    )
    return counts.join(listed, "author")


def author_sections(works: DataFrame) -> DataFrame:
    named = works.filter(~blank(F.col("author"))).select("author").distinct()
    return named.groupBy(section_key(F.col("author")).alias("section")).agg(F.count("*").alias("author_count"))


def _in_order(value: str) -> Column:
    """A group's values as an array, in the order of author, title and work."""
    listed = F.sort_array(F.collect_list(F.struct("author", "title", "work_id", F.col(value).alias("value"))))
    return F.transform(listed, lambda x: x["value"])


def duplicate_titles(works: DataFrame, language: str | None = None) -> DataFrame:
    """Titles that several works of a language share, in any case, with what to do about them."""
    own = works if language is None else works.filter(F.col("language") == language)
    found = own.filter(F.length(F.trim("title")) > 0).groupBy("language", F.lower(F.trim("title")).alias("duplicate_key")).agg(
        F.min(F.trim("title")).alias("display"),
        F.count("*").alias("work_count"),
        F.countDistinct(F.trim("author")).alias("author_count"),
        F.array_sort(F.collect_set(F.trim("title"))).alias("display_values"),
        _in_order("work_id").alias("work_ids"),
        _in_order("author").alias("authors"),
    )
    policy = F.when(F.col("author_count") > 1, "preserve_title_disambiguate_by_author").otherwise("review_possible_edition_or_import_duplicate")
    return found.filter(F.col("work_count") > 1).select(F.lit("title").alias("kind"), "*", policy.alias("suggested_policy"))


def duplicate_authors(works: DataFrame, language: str | None = None) -> DataFrame:
    """Author names of a language with more than one author id; null counts as an empty id."""
    own = works if language is None else works.filter(F.col("language") == language)
    ids = F.coalesce("author_id", F.lit(""))
    found = own.filter(F.length(F.trim("author")) > 0).groupBy("language", F.lower(F.trim("author")).alias("duplicate_key")).agg(
        F.min(F.trim("author")).alias("display"),
        F.count("*").alias("work_count"),
        F.countDistinct(ids).alias("authority_count"),
        F.array_sort(F.collect_set(F.trim("author"))).alias("display_values"),
        F.array_sort(F.collect_set(ids)).alias("author_ids"),
        _in_order("work_id").alias("work_ids"),
        _in_order("title").alias("titles"),
    )
    return found.filter(F.col("authority_count") > 1).select(
        F.lit("author").alias("kind"), "*", F.lit("review_authority_collision").alias("suggested_policy")
    )


def duplicate_canonical_ids(works: DataFrame) -> DataFrame:
    own = works.filter(~blank(F.col("canonical_text_id"))).withColumn("id", F.trim("canonical_text_id"))
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    found = own.groupBy("id").agg(
        F.countDistinct("work_id").alias("work_count"),
        joined("collection_id", ", ").alias("collections"),
        joined("title", " | ").alias("titles"),
        joined("work_id", " | ").alias("work_ids"),
    )
    return found.filter(F.col("work_count") > 1)


def discovery_groups(works: DataFrame, classifications: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Works, authors and the best score of each group; only groups of the taxonomy (``id, position``), if one is given."""
    joined = works.join(classifications, "work_id").filter(~blank(F.col("discovery_group_id")))
    found = joined.groupBy(F.col("discovery_group_id").alias("id")).agg(
        F.countDistinct("work_id").alias("work_count"),
        F.countDistinct(author_identity()).alias("author_count"),
        F.max("popularity_score").alias("max_score"),
    )
    return found if taxonomy is None else found.join(taxonomy, "id")


def discovery_tags(works: DataFrame, classifications: DataFrame) -> DataFrame:
    tagged = works.join(classifications, "work_id").withColumn("tag", F.explode(tag_list(F.col("discovery_tags"))))
    return tagged.groupBy("tag").agg(
        F.countDistinct("work_id").alias("work_count"),
        F.countDistinct(author_identity()).alias("author_count"),
        F.max("popularity_score").alias("max_score"),
    )


def coverage(works: DataFrame, artifacts: DataFrame, classifications: DataFrame) -> DataFrame:
    """Works, authors, words and how many works are classified, by language."""
    flags = classifications.select(
        "work_id", F.lit(1).alias("classified"), (~blank(F.col("discovery_group_id"))).cast("int").alias("discoverable")
    ).dropDuplicates(["work_id"])
    joined = works.join(work_metrics(artifacts), "work_id", "left").join(flags, "work_id", "left")
    found = joined.groupBy("language").agg(
        F.count("*").alias("work_count"),
        F.countDistinct(author_identity()).alias("author_count"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("word_count"),
        F.count("classified").alias("classified_count"),
        F.coalesce(F.sum("discoverable"), F.lit(0)).alias("discoverable_count"),
    )
    return found.withColumn("complete", F.col("classified_count") == F.col("work_count"))


def shelves(works: DataFrame, classifications: DataFrame, k: int) -> DataFrame:
    """The ``k`` best works of each group; works without a score come last."""
    joined = works.join(classifications, "work_id").filter(~blank(F.col("discovery_group_id")))
    order = [*_last("group_popularity_score"), *_last("popularity_score"), F.col("title"), F.col("work_id")]
    w = Window.partitionBy("discovery_group_id").orderBy(*order)
    return joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def source_index(works: DataFrame, editions: DataFrame, artifacts: DataFrame, source_files: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Works with their editions, artifact metrics, source files and witnesses."""
    metrics = artifacts.groupBy("work_id", "edition_id").agg(
        F.count("*").alias("artifact_count"),
        F.sum("token_count").cast("bigint").alias("word_count"),
        F.array_join(F.array_sort(F.collect_set("adapter")), ", ").alias("adapters"),
    )
    files = source_files.groupBy("source_id").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").cast("bigint").alias("size_bytes")
    )
    seen = witnesses.groupBy("work_id").agg(F.count("*").alias("witness_count"))
    return (
        works.join(editions, "work_id", "left")
        .join(metrics, ["work_id", "edition_id"], "left")
        .join(files, "source_id", "left")
        .join(seen, "work_id", "left")
        .select(
            "work_id",
            "edition_id",
            "source_id",
            F.coalesce("artifact_count", F.lit(0)).alias("artifact_count"),
            F.coalesce("word_count", F.lit(0)).alias("word_count"),
            "adapters",
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
            F.coalesce("witness_count", F.lit(0)).alias("witness_count"),
        )
    )


def summary(works: DataFrame, artifacts: DataFrame, aliases: DataFrame, source_files: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row of counts; each table is one aggregate, and the one-row results meet on a constant."""
    parts = [
        works.agg(F.countDistinct("collection_id").alias("collection_count"), F.count("*").alias("work_count")),
        artifacts.agg(
            F.count("*").alias("artifact_count"),
            F.coalesce(F.sum("segment_count"), F.lit(0)).cast("bigint").alias("segment_count"),
            F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("word_count"),
        ),
        aliases.agg(F.count("*").alias("alias_count")),
        source_files.agg(F.count("*").alias("source_file_count")),
        metadata.agg(F.count("*").alias("metadata_count")),
    ]
    out = None
    for part in parts:
        keyed = part.withColumn("_k", F.lit(0))
        out = keyed if out is None else out.join(keyed, "_k")
    return out.drop("_k").withColumn("word_count_method", F.lit(WORD_COUNT_METHOD))


def resolve_refs(refs: DataFrame, works: DataFrame, aliases: DataFrame) -> DataFrame:
    """``ref, work_id``: an alias first, then the work's own id, urn, source id or canonical id, in this order."""
    keys = F.array(
        *(
            F.struct(F.lit(i).alias("way"), F.col(c).alias("ref"))
            for i, c in enumerate(["work_id", "cts_work_urn", "source_id", "canonical_text_id"], 1)
        )
    )
    named = aliases.select(F.lit(0).alias("way"), F.col("alias").alias("ref"), F.col("target").alias("work_id"))
    known = works.select(F.inline(keys), "work_id").unionByName(named)
    best = F.min(F.struct("way", "work_id"))
    return refs.join(known, "ref").groupBy("ref").agg(best.alias("b")).select("ref", F.col("b.work_id").alias("work_id"))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    found = aliases.groupBy("language", "alias").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return found.filter(F.size("targets") > 1)


def unambiguous_aliases(aliases: DataFrame) -> DataFrame:
    only = aliases.groupBy("alias").agg(F.countDistinct("target").alias("n")).filter("n = 1")
    return aliases.join(only, "alias", "left_semi")


def alias_target_issues(aliases: DataFrame, works: DataFrame) -> DataFrame:
    """Aliases whose target is no work's id, urn or canonical id."""
    out = aliases
    for c in ("work_id", "cts_work_urn", "canonical_text_id"):
        out = out.join(works.filter(F.col(c).isNotNull()).select(F.col(c).alias("target")), "target", "left_anti")
    return out


def attribution_groups(attributions: DataFrame) -> DataFrame:
    """Each attribution once, with its smallest citation and the label that goes with it."""
    return attributions.groupBy("collection_id", "match_field", "match_value", "relation_type", "agent").agg(
        F.min("evidence_citation").alias("citation"),
        F.min_by("evidence_label", "evidence_citation").alias("label"),
        F.count("*").alias("evidence_count"),
    )


def list_rows(table: DataFrame, order: list[str], limit: int | None = None, **filters: str | None) -> DataFrame:
    """A table's rows by equal columns (those that aren't None), in order, at most ``limit``."""
    for column, value in filters.items():
        if value is not None:
            table = table.filter(F.col(column) == value)
    rows = table.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def source_witnesses(works: DataFrame, editions: DataFrame) -> DataFrame:
    """A witness for each registered work with a canonical text id: known by its urn, else its source's id, else its own."""
    filled = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    first = editions.groupBy("work_id").agg(F.min_by("source_path", "edition_id").alias("source_path"))
    own = works.filter(filled("canonical_text_id").isNotNull()).join(first, "work_id", "left")
    return own.select(
        "canonical_text_id",
        "work_id",
        "collection_id",
        "language",
        F.coalesce(filled("cts_work_urn"), filled("source_id"), "work_id").alias("witness_id"),
        "source_id",
        F.coalesce("cts_work_urn", F.lit("")).alias("source_urn"),
        "source_path",
        F.lit("accepted").alias("status"),
        F.lit("medium").alias("confidence"),
        F.lit("from the accepted source registration").alias("note"),
    )


def resolved_classifications(rows: DataFrame, works: DataFrame) -> DataFrame:
    """Classifications with the work id that their ``ref`` means: a work id, a source id or a urn, in this order; others go.

    A source id or a urn that several works have means the least of them.
    """
    ids = None
    for rank, column in enumerate(("work_id", "source_id", "cts_work_urn")):
        part = works.select(F.col(column).alias("ref"), "work_id", F.lit(rank).alias("rank")).filter(F.coalesce("ref", F.lit("")) != "")
        ids = part if ids is None else ids.unionByName(part)
    best = ids.groupBy("ref").agg(F.min_by("work_id", F.struct("rank", "work_id")).alias("work_id"))
    return rows.drop("work_id").join(best, "ref").drop("ref")


def known_authors(rows: DataFrame, works: DataFrame) -> DataFrame:
    """Author classifications whose author and language the catalog has."""
    return rows.join(works.select("author_id", "language").distinct(), ["author_id", "language"], "left_semi")


def projected_references(references: DataFrame, maps: DataFrame) -> DataFrame:
    """References with the citation that an accepted map of the work projects theirs to; as they are where there is none."""
    rule = maps.filter("status = 'accepted' AND rule = 'book.chapter.section>book.section'").select("work_id").distinct().withColumn("_mapped", F.lit(True))
    joined = references.join(rule, "work_id", "left")
    return joined.withColumn("citation", F.when(F.col("_mapped"), project_citation(F.col("citation"))).otherwise(F.col("citation"))).drop("_mapped")


def any_field_has(fields: list[str], spellings: list[str]) -> Column:
    """Whether any field holds any of the spellings, accents and case aside."""
    folded = F.array(*(on_column(strip_marks, F.lower(F.coalesce(F.col(c), F.lit("")))) for c in fields))
    wanted = [strip_marks(t.lower()) for t in spellings]
    return F.exists(folded, lambda x: _any_of(x, wanted))


def _any_of(x: Column, wanted: list[str]) -> Column:
    out = F.lit(False)
    for t in wanted:
        out = out | x.contains(t)
    return out


def any_prefix(c: Column, prefixes: list[str]) -> Column:
    """Whether a text begins with one of the prefixes, character by character."""
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def pruned(rows: DataFrame, among: dict[str, list], between: dict[str, tuple], *tests: Column) -> DataFrame:
    """Rows whose columns are among some values, within ranges (None is open), and that pass all tests."""
    for column, values in among.items():
        rows = rows.filter(F.col(column).isin(values))
    for column, (low, high) in between.items():
        rows = rows if low is None else rows.filter(F.col(column) >= low)
        rows = rows if high is None else rows.filter(F.col(column) <= high)
    for test in tests:
        rows = rows.filter(test)
    return rows


def author_index(works: DataFrame, section: str | None = None, query: str | None = None, fields: list[str] = ["author"]) -> DataFrame:  # noqa: B006
    """``author_id, language, works, author`` of the authors of a section that a text matches in any of some fields."""
    if section is not None:
        works = works.filter(section_key(F.col("author")) == section)
    if query is not None:
        works = works.filter(any_field_has(fields, [query]))
    return works.groupBy("author_id", "language").agg(F.count("*").alias("works"), F.min("author").alias("author"))


def set_differences(here: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """``key, side``: the keys that only one of two tables has."""
    one, two = here.select(key).distinct(), there.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("side", F.lit("only-here")).unionByName(
        two.join(one, key, "left_anti").withColumn("side", F.lit("only-there"))
    )
