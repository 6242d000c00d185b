"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import free_name, written

ROUNDS = 8
FILLS = 6
POWER = 0.7
SHARE = 0.8

# A document's topic is the first form that applies, by characters of its text.
_TOPIC = """CASE WHEN text IS NULL THEN 'none'
  WHEN (length(text) - length(replace(text, '|', ''))) * 50 > length(text) THEN 'table'
  WHEN (length(text) - length(replace(text, '?', ''))) * 200 > length(text) THEN 'dialogue'
  WHEN length(text) > 8000 THEN 'long' WHEN length(text) > 1000 THEN 'middle' ELSE 'short' END"""
_UNIFORM = "md5(coalesce(cast(doc_id AS {string}), text, ''))"


def _labelled(docs: DataFrame) -> DataFrame:
    """Margins without nulls, tokens (words) and a number from 0 to 1 given by the row."""
    names = {"mix_source": F.coalesce(F.col("source").cast("string"), F.lit("(none)")), "mix_lang": F.coalesce("lang", F.lit("(none)")), "mix_topic": F.expr(_TOPIC)}
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("double")
    number = F.conv(F.substring(F.expr(_UNIFORM.format(string="string")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return docs.withColumns({**names, "mix_tokens": tokens, "mix_number": number})


MARGINS = ["mix_source", "mix_lang", "mix_topic"]
ADDED = [*MARGINS, "mix_tokens", "mix_number", "mix_probability"]


def raked_probabilities(cells: DataFrame, power: float = POWER, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Probability per cell of ``cells(mix_source, mix_lang, mix_topic, w)`` that brings the margins to their targets, or towards them.

    The target of a value is its token share to the ``power``, normalised over the margin. Weights are scaled to the targets of
    one margin after another, ``rounds`` times over. Probabilities are proportional to raked over given weight; those that would pass 1 stay at 1 and
    the others rise, ``FILLS`` times, until ``share`` of all tokens is expected. The margins reach their targets only up to a share of one over the largest raked
    over given weight; beyond it the share comes first, and ``margins`` tells what is reached. Totals are aggregates, windows only go over the values of a margin.
    """
    cells = cells.where("w > 0")
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    cells = cells.withColumn("raked", F.col("w"))
    for m in MARGINS:
        part = F.pow(F.sum("w"), F.lit(power)).alias("part")
        whole = cells.groupBy(m).agg(part).agg(F.sum("part")).first()[0] or 1.0
        cells = cells.withColumn(f"to_{m}", F.pow(F.sum("w").over(Window.partitionBy(m)), F.lit(power)) / F.lit(whole) * F.lit(total))
    cells = written(cells)
    for _ in range(rounds):
        for m in MARGINS:
            now = F.sum("raked").over(Window.partitionBy(m))
            cells = cells.withColumn("raked", F.col("raked") * F.col(f"to_{m}") / now)
    cells = written(cells.select(*MARGINS, "w", (F.col("raked") / F.col("w")).alias("r")))
    s = float(share)
    for _ in range(FILLS):
        full = F.lit(s) * F.col("r") >= 1
        left, taken = cells.agg(F.sum(F.when(full, 0.0).otherwise(F.col("w") * F.col("r"))), F.sum(F.when(full, F.col("w")).otherwise(0.0))).first()
        if left:
            s = max(s, (share * total - taken) / left)
    return cells.select(*MARGINS, F.round(F.least(F.lit(1.0), F.lit(s) * F.col("r")), 9).alias("probability"))


def margins(docs: DataFrame, power: float = POWER, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Token shares of every value: ``margin, value, given, target, reached``, the last as expected of ``mixed`` with the same arguments."""
    cells = written(_labelled(docs).groupBy(*MARGINS).agg(F.sum("mix_tokens").alias("w")))
    cells = written(cells.join(raked_probabilities(cells, power, share, rounds), MARGINS))
    total, kept = cells.agg(F.sum("w"), F.sum(F.col("w") * F.col("probability"))).first()
    out = None
    for m in MARGINS:
        values = cells.groupBy(F.col(m).alias("value")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("probability")).alias("kept"))
        whole = values.agg(F.sum(F.pow("w", F.lit(power)))).first()[0]
        part = values.select(F.lit(m.removeprefix("mix_")).alias("margin"), "value", (F.col("w") / F.lit(total)).alias("given"),
                             (F.pow("w", F.lit(power)) / F.lit(whole)).alias("target"), (F.col("kept") / F.lit(kept)).alias("reached"))
        out = part if out is None else out.union(part)
    return out


def mixed(docs: DataFrame, power: float = POWER, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``docs`` sampled so that source, language and topic margins come to their targets, or as near as ``share`` lets them (``margins``); columns
    ``mix_source``, ``mix_lang``, ``mix_topic``, ``mix_tokens``, ``mix_number`` and ``mix_probability`` are added.

    ``docs`` needs ``doc_id, text, lang, source``. Tokens are words; the topic is a form of text (table, dialogue, or by length). Null sources and languages
    are values of their own. A row is taken if a number hashed from its id (its text where the id is null) is below the probability of its cell, so
    every run takes the same rows and repeated rows go together. Texts without a word weigh nothing and are always taken. Columns of ``docs`` that are called like an added
    one are kept as they are, and that one is not added.
    """
    own = {c: free_name(docs, f"{c}_") for c in docs.columns if c in ADDED}
    rows = _labelled(docs.withColumnsRenamed(own))
    cells = rows.groupBy(*MARGINS).agg(F.sum("mix_tokens").alias("w"))
    chances = raked_probabilities(written(cells), power, share, rounds)
    chances = written(chances.withColumnRenamed("probability", "mix_probability"))
    joined = rows.join(chances, MARGINS, "left")
    joined = joined.withColumn("mix_probability", F.when(F.col("mix_tokens") > 0, F.col("mix_probability")).otherwise(1.0))
    taken = joined.where("mix_number < mix_probability")
    return taken.select(*(taken[own.get(c, c)].alias(c) for c in docs.columns), *(c for c in ADDED if c not in own))


def oracle(power: float = POWER, share: float = SHARE, rounds: int = ROUNDS) -> str:
    """The same in SQL."""
    steps = [f"""rows_ AS (SELECT doc_id, coalesce(source, '(none)') AS mix_source, coalesce(lang, '(none)') AS mix_lang, {_TOPIC} AS mix_topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::DOUBLE AS mix_tokens,
  ('0x' || substr({_UNIFORM.format(string="VARCHAR")}, 1, 12))::UBIGINT::DOUBLE / {1 << 48} AS u FROM documents)""",
             """c0 AS (SELECT mix_source, mix_lang, mix_topic, sum(mix_tokens) AS w FROM rows_ GROUP BY ALL HAVING sum(mix_tokens) > 0)"""]
    for m in MARGINS:
        steps.append(f"""to_{m} AS (SELECT {m}, pow(sum(w), {power}) / sum(pow(sum(w), {power})) OVER () * sum(sum(w)) OVER () AS goal FROM c0 GROUP BY {m})""")
    steps.append("k0 AS (SELECT *, w AS raked FROM c0)")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            steps.append(f"""k{n + 1} AS (SELECT k.* REPLACE (raked * goal / sum(raked) OVER (PARTITION BY k.{m}) AS raked) FROM k{n} k JOIN to_{m} t ON k.{m} = t.{m})""")
            n += 1
    steps.append(f"f0 AS (SELECT *, raked / w AS r, {share}::DOUBLE AS s, sum(w) OVER () AS total FROM k{n})")
    for i in range(FILLS):
        steps.append(f"""f{i + 1} AS (SELECT * REPLACE (greatest(s, CASE WHEN sum(CASE WHEN s * r >= 1 THEN 0 ELSE w * r END) OVER () > 0 THEN
  ({share} * total - sum(CASE WHEN s * r >= 1 THEN w ELSE 0 END) OVER ()) / sum(CASE WHEN s * r >= 1 THEN 0 ELSE w * r END) OVER () ELSE s END) AS s) FROM f{i})""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, mix_source AS source, mix_lang AS lang, mix_topic AS topic, mix_tokens::BIGINT AS tokens, probability FROM (
  SELECT rows_.*, CASE WHEN mix_tokens > 0 THEN round(least(1.0, s * r), 9) ELSE 1.0 END AS probability FROM rows_ LEFT JOIN f{FILLS} USING (mix_source, mix_lang, mix_topic))
WHERE u < probability"""
