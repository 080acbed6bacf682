"""Search by tags and by words: which objects, then everything about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartalog.functions import strings, tags
from cartalog.functions.curve import peano
from cartalog.operators.conditions import FieldConditions

#: Digits of the curve's number that are dropped, step by step, to look farther around a place; then no place at all.
LEVELS = (2, 3, 4, 6, 8)
PAGE = 10
#: Conditions whose bits one number holds.
WORD = 62


def matching_ids(osm: DataFrame, conditions: Sequence[FieldConditions]) -> DataFrame:
    """(objectid): the objects for which each condition holds on some tag row.

    One pass: a row's conditions are bits, an object's bits are OR-ed before the shuffle, and all must be set.
    """
    if not conditions:
        return osm.select("objectid").where("objectid is not null").distinct()
    # A number holds the bits of WORD conditions; more conditions take more numbers.
    groups = [conditions[k : k + WORD] for k in range(0, len(conditions), WORD)]
    bits = [reduce(add, [F.when(c.column(), F.lit(1 << k).cast("bigint")).otherwise(0) for k, c in enumerate(group)]).alias(f"_met{g}") for g, group in enumerate(groups)]
    names = [f"_met{g}" for g in range(len(groups))]
    met = osm.select("objectid", *bits).where(reduce(or_, [F.col(n) > 0 for n in names]))
    whole = reduce(and_, [F.col(n) == (1 << len(group)) - 1 for n, group in zip(names, groups, strict=True)])
    return met.groupBy("objectid").agg(*[F.bit_or(n).alias(n) for n in names]).where(whole).select("objectid")


def page(ids: DataFrame, offset: int = 0, limit: int = PAGE, column: str = "objectid") -> DataFrame:
    """A page of ids in their order: an ordered limit, which keeps no more than a page per partition."""
    ordered = ids.orderBy(column)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered.limit(limit)


def simple_search(osm: DataFrame, conditions: Sequence[FieldConditions], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """(objectid, tags): a page of objects with all their tags, sorted; ids first, tags for the page only."""
    found = page(matching_ids(osm, conditions), offset, limit)
    return collect_tags(osm.join(F.broadcast(found), "objectid", "left_semi"))


def collect_tags(osm: DataFrame) -> DataFrame:
    """(objectid, tags): the sorted distinct tags of each object as structs."""
    return osm.groupBy("objectid").agg(F.array_sort(F.collect_set(F.struct("key", "value"))).alias("tags"))


def tags_json(osm: DataFrame) -> DataFrame:
    """(objectid, json): one member per key, a list where a key has several values."""
    keys = osm.groupBy("objectid", "key").agg(F.array_sort(F.collect_set("value")).alias("vals"))
    member = F.concat(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(":"), F.when(F.size("vals") == 1, F.expr("substr(to_json(vals), 2, length(to_json(vals)) - 2)")).otherwise(F.to_json("vals")))
    listed = keys.select("objectid", F.struct("key", member.alias("m")).alias("km")).groupBy("objectid").agg(F.array_sort(F.collect_list("km")).alias("kms"))
    return listed.select("objectid", F.concat(F.lit("{"), F.array_join(F.transform("kms", lambda x: x["m"]), ","), F.lit("}")).alias("json"))


def tag_dictionary(pairs: DataFrame, column: str = "tag") -> DataFrame:
    """(tag, hash): q, a number in base 36, q for each distinct tag, numbered in the tags' order."""
    from cartalog.operators.query import dense_ids

    numbered = dense_ids(pairs, column, "number")
    return numbered.select(F.col(column).alias("tag"), F.concat(F.lit("q"), strings.base36(F.col("number")), F.lit("q")).alias("hash"))


def encode_keys(osm: DataFrame, dictionary: DataFrame) -> DataFrame:
    return osm.join(dictionary.withColumnRenamed("tag", "key"), "key").select("objectid", F.col("hash").alias("tag"), "value")


def decode_keys(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    return coded.withColumnRenamed("tag", "hash").join(dictionary, "hash").select("objectid", F.col("tag").alias("key"), "value")


def fixed_tags(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(objectid, key, value) of fixed tags, stored as the hash of key=value; kept where there are exactly two parts."""
    joined = coded.withColumnRenamed("tag", "hash").join(dictionary, "hash").withColumn("parts", F.split("tag", "="))
    return joined.where(F.size("parts") == 2).select("objectid", F.col("parts")[0].alias("key"), F.col("parts")[1].alias("value"))


def translate_ids(ids: DataFrame, mapping: DataFrame, from_column: str, to_column: str) -> DataFrame:
    """Each id with its other id, null where there is none."""
    return ids.join(mapping.select(from_column, to_column), from_column, "left").select(from_column, to_column)


def id_kind(osm_id: Column) -> Column:
    """node or way by an id's first letter; null for anything else."""
    return F.when(osm_id.startswith("n"), "node").when(osm_id.startswith("w"), "way")


def group_members(rel: DataFrame) -> DataFrame:
    """(groupid, objects): the members of each group in their order."""
    ordered = rel.groupBy("groupid").agg(F.array_sort(F.collect_list(F.struct("objectorder", "objectid"))).alias("m"))
    return ordered.select("groupid", F.transform("m", lambda x: x["objectid"]).alias("objects"))


def groups_of(rel: DataFrame) -> DataFrame:
    return rel.groupBy("objectid").agg(F.array_sort(F.collect_set("groupid")).alias("groups"))


def positional_points(wanted: DataFrame, points: DataFrame, ids: str = "ids", key: str = "verid") -> DataFrame:
    """Rows (.., pos, id, lat, lon, found) for arrays of ids, repeated ids kept, in place of those not there nulls."""
    others = [c for c in wanted.columns if c != ids]
    each = wanted.select(*others, F.posexplode(ids).alias("pos", "id"))
    return each.join(points.select(F.col(key).alias("id"), "lat", "lon"), "id", "left").select(*others, "pos", "id", "lat", "lon", F.col("lat").isNotNull().alias("found"))


def search_documents(osm: DataFrame, places: DataFrame, config: Mapping[str, Sequence[str]]) -> DataFrame:
    """(docid, tokens, curve): what each object can be found by; places: (objectid, lat, lon)."""
    key, value = strings.escape(F.col("key")), strings.escape(F.col("value"))
    rows = osm.select("objectid", key.alias("key"), value.alias("value"))
    k, v = F.col("key"), F.col("value")
    fits = tags.accept_tag(k, v, config) & tags.valid_value(k) & tags.valid_value(v) & tags.is_full_text_pair(k)
    rows = rows.where(fits)
    fixed = tags.allow_fixed(k, v, config) & tags.valid_fixed_value(v)
    canonical = tags.canonical(k, v)
    pairs = F.transform(tags.split_fixed(v), lambda part: F.concat(canonical["key"], F.lit("="), part))
    values = F.when(tags.is_meta_free(v), tags.split_fixed(canonical["value"])).otherwise(F.array().cast("array<string>"))
    keys = F.when(tags.is_full_text(k), F.array(canonical["key"])).otherwise(F.array().cast("array<string>"))
    entered = F.when(tags.user_entered(k) & tags.valid_user_pair(k, v), strings.search_words(v)).otherwise(F.array().cast("array<string>"))
    own = F.when(tags.writable(k, v), F.array(canonical["key"])).otherwise(F.array().cast("array<string>"))
    token = rows.select("objectid", F.explode(F.concat(F.when(fixed, F.concat(pairs, values, keys)).otherwise(entered), own)).alias("token")).where("token <> ''")
    listed = token.groupBy("objectid").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return listed.join(places, "objectid", "left").select(F.col("objectid").alias("docid"), "tokens", peano(F.col("lat"), F.col("lon")).alias("curve"))


def _has_word_beginning(begins: str) -> Column:
    return F.exists("tokens", lambda t: t.startswith(begins))


def fulltext_ids(docs: DataFrame, exact: Sequence[str] = (), begins: Sequence[str] = ()) -> DataFrame:
    """(docid): documents that have all exact words and, for each prefix, a word that begins so."""
    wanted = [F.array_contains("tokens", w) for w in exact] + [_has_word_beginning(p) for p in begins]
    for w in wanted:
        docs = docs.where(w)
    return docs.select("docid").distinct()


def token_index(docs: DataFrame) -> DataFrame:
    """(token, docid): the inverted table of documents (docid, tokens), in order of tokens, so that a stored copy is only read where the words are.

    Null and empty token lists have no row, repeated tokens of a document one.
    """
    rows = docs.select(F.explode("tokens").alias("token"), "docid").where("token is not null").distinct()
    return rows.repartitionByRange("token", "docid").sortWithinPartitions("token", "docid")


def indexed_ids(index: DataFrame, exact: Sequence[str] = (), begins: Sequence[str] = ()) -> DataFrame:
    """(docid): fulltext_ids() over a token_index(): plain comparisons of tokens, which reach the scan, then one aggregation.

    Without words it gives the documents that have any.
    """
    wanted = [F.col("token") == w for w in exact] + [F.col("token").startswith(p) for p in begins]
    if not wanted:
        return index.select("docid").distinct()
    hits = index.where(reduce(or_, wanted)).select("docid", F.explode(F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in enumerate(wanted)]))).alias("word"))
    return hits.groupBy("docid").agg(F.size(F.collect_set("word")).alias("n")).where(F.col("n") == len(wanted)).select("docid")


def fulltext_near(docs: DataFrame, curve: int, exact: Sequence[str] = (), begins: Sequence[str] = (), offset: int = 0, limit: int = PAGE) -> DataFrame:
    """(docid): a page of matches around a place, as far around as it takes to fill the page.

    The least level that a document is within is computed in one pass; the levels' counts tell which one fills the page.
    """
    text = str(curve)
    own = F.col("curve").cast("string")
    level = F.lit(99)
    for cut_off in reversed(LEVELS):
        level = F.when(own.startswith(text[: max(0, len(text) - cut_off)]), cut_off).otherwise(level)
    hits = docs
    for w in exact:
        hits = hits.where(F.array_contains("tokens", w))
    for p in begins:
        hits = hits.where(_has_word_beginning(p))
    hits = hits.select("docid", level.alias("level"))
    counts = hits.groupBy("level").count()  # one row per level
    so_far = counts.withColumn("sum", F.sum("count").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))
    enough = so_far.where(F.col("sum") - offset >= limit).agg(F.coalesce(F.min("level"), F.lit(99)).alias("enough"))
    return page(hits.join(F.broadcast(enough)).where("level <= enough").select("docid"), offset, limit, "docid")


def suggest(vocabulary: DataFrame, begins: str, column: str = "en") -> DataFrame:
    return vocabulary.where(F.col(column).startswith(begins)).select(column).distinct()


def eav_upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """A table of tags with new ones put in: equal rows are replaced, not doubled."""
    return table.join(new, ["objectid", "key", "value"], "left_anti").unionByName(new.distinct())


def store_tags(osm: DataFrame, config: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """(free tags, fixed tags) as stored: fixed ones as key=value; objects without free ones get a meta row."""
    k, v = F.col("key"), F.col("value")
    accepted = osm.where(tags.accept_tag(k, v, config))
    is_fixed = tags.allow_fixed(k, v, config) & tags.valid_fixed_value(v)
    fixed = accepted.where(is_fixed).select("objectid", F.explode(tags.split_fixed(v)).alias("value"), "key").select("objectid", F.concat("key", F.lit("="), "value").alias("tag"))
    free = accepted.where(~is_fixed).select("objectid", "key", F.lower("value").alias("value"))
    bare = accepted.select("objectid").distinct().join(free.select("objectid").distinct(), "objectid", "left_anti").select("objectid", F.lit("meta").alias("key"), F.lit("dummy").alias("value"))
    return free.unionByName(bare), fixed
