"""Registered queries of the subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tablescout.llm import chat, divergence, language, licenses, lm, mixture, packing, quality, repair, simhash, suffixes, toxicity, vectors
from tablescout.llm.common import table

HELD_OUT = "crc32(cast(doc_id AS string)) % {} = {}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 400 bytes that start twice, cut out of every document."""
    return suffixes.repeat_report(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document statistics, fixed rules and the verdict of trees fitted to the quality labels."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), packing.WORD_BPE)


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and their components at 2 or fewer bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_context_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the mixed model and by unigrams; one document in seven is held out."""
    return lm.scores(table(spark, sf_dir, "documents"), HELD_OUT.format(7, 2))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; one in three is held out."""
    return language.identified(table(spark, sf_dir, "documents"), HELD_OUT.format(3, 1))


@query("op2_vector_dedup", """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, b FROM reach JOIN links ON r = a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach GROUP BY vec_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of one label, and their components."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_licenses", licenses.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences carried by documents, with the best match."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_preferences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in a pair of a chosen and a rejected one, formatted."""
    return chat.formatted(chat.preference_pairs(table(spark, sf_dir, "conversations")))


@query("op10_mixing", mixture.oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to smoothed source, language and topic margins."""
    taken = mixture.mixed(table(spark, sf_dir, "documents"))
    names = ("source", "lang", "topic")
    return taken.select("doc_id", *(taken[f"mix_{n}"].alias(n) for n in names), taken.mix_tokens.cast("long").alias("tokens"), taken.mix_probability.alias("probability"))


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores by the nearest labelled documents; one in three is held out."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), HELD_OUT.format(3, 1))


@query("op12_divergence", divergence.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark each source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repaired(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` one after another."""
    return corpus_pipeline.run(spark, sf_dir)
