"""The queries of the text problems and the one of their SQL statements that can be given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartalog.llm.canonical import mapped_rows
from cartalog.llm.leakage import leaked
from cartalog.llm.residue import residue
from cartalog.llm.tokenizer import token_ids
from cartalog.llm.variants import same_entity_pairs
from cartalog.llm.visual import same_look_pairs
from cartalog.session import table

LABELS = ["label_en", "label_de", "label_fr"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for tab, key in (("addrdecoder_areas", "id"), ("osm_relation", "rel_id")):
        pairs = same_look_pairs(table(spark, sf_dir, tab), key, "name").select(F.lit(tab).alias("tab"), "key_a", "key_b")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, found = table(spark, sf_dir, "route_kinds"), None
    for tab, key, value in (("osm_relation", "rel_id", "route"), ("routes", "route_id", "route_type")):
        rows = mapped_rows(table(spark, sf_dir, tab), key, value, kinds, "kind_code", LABELS)
        rows = rows.select(F.lit(tab).alias("tab"), "row_id", F.col("code").alias("kind_code"))
        found = rows if found is None else found.unionByName(rows)
    return found


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An agency's name may end with a slash and its network, which does not count.
    agencies = table(spark, sf_dir, "agency").select(F.lit("agency").alias("tab"), F.col("agency_id").alias("id"), F.regexp_replace("agency_name", "/[^/]*$", "").alias("name"))
    relations = table(spark, sf_dir, "osm_relation").select(F.lit("osm_relation").alias("tab"), F.col("rel_id").alias("id"), F.col("operator").alias("name"))
    return same_entity_pairs(agencies.unionByName(relations), "agency").withColumnRenamed("base_id", "agency_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("doc", "doc_id")


QUERIES = {q.__name__: q for q in (p2_found, p3_found, p4_found, p8_ids, p9_found, p10_found)}
#: None of these can be said in SQL that runs on whole tables; tests hold them against brute force and other libraries.
SQL: dict[str, str] = {}
