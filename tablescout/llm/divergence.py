"""How far the sources of a language are apart in their words, by frequent-pattern trees of term rows.

A term's row lists the sources it occurs in, in their order, each with the term's probability there. Terms with equal rows
are one row with a multiplicity, and rows that begin alike share a path in a tree. For a pair of sources the sum over
all kept terms is put together from three parts: every term as if it occurred in neither source, what changes if it
occurs in one (from the distinct probabilities of that source), and what changes beyond that if it occurs in both. The last
part is computed once for each node and each of its ancestors, times the number of terms below the node.

Rows are sorted, so a task meets a tree depth first: a node is open as long as the rows share its path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import byte_batches, removed, written

MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BATCH_TERMS = 200_000
BATCH_CELLS = 1 << 18

# Bytes of a term: ASCII letters in lower case and everything beyond ASCII; others are gaps.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, summed within a task as far as memory allows."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), counts in held.items():
            langs += [lang] * len(counts)
            sources += [source] * len(counts)
            terms += [t.decode() for t in counts]
            n += [c[0] for c in counts.values()]
            docs += [c[1] for c in counts.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([*map(pa.array, (langs, sources, terms)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                          names=["lang", "source", "term", "n", "docs"])

    for part, texts in byte_batches(batches):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts):
            counts = held.setdefault((lang, source), {})
            before, own = len(counts), {}
            for word in text.translate(_LETTERS).split():
                own[word] = own.get(word, 0) + 1
            for word, n in own.items():
                known = counts.get(word)
                if known is None:
                    counts[word] = [n, 1]
                else:
                    known[0] += n
                    known[1] += 1
            size += len(counts) - before
            if size >= BATCH_TERMS:
                yield rows()
                size = 0
    if size:
        yield rows()


def _probability(count: str, total: str, terms: str) -> Column:
    """p of the contract in whole numbers: 1 + floor(SCALE * (count + 1) / (total + terms))."""
    wide = "decimal(28,0)"
    return F.lit(1) + F.expr(f"({SCALE} * (cast({count} as {wide}) + 1)) div (cast({total} as {wide}) + {terms})")


def _gain(p: str, q: str) -> str:
    """floor((p - q)^2 / q); p and q stay below 2^31, so all of it fits a long."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


_PAIR_SUMS = "lang string, a long, b long, high long, low long"


def _gains(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of source pairs from sorted rows ``lang, path, n``, summed over nodes and their ancestors.

    ``path`` holds (source number, p, p of a term the source does not have). Sums come as two parts, ``high * 2^30 + low``.
    """
    for batch in batches:
        path = batch.column("path")
        sizes = np.asarray(pc.list_value_length(path))
        width = int(sizes.max(initial=0))
        step = max(1, BATCH_CELLS // max(1, width))
        for at in range(0, batch.num_rows, step):
            yield from _subtree(batch.slice(at, step))


def _subtree(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    path, langs = batch.column("path"), batch.column("lang")
    lengths = np.asarray(pc.list_value_length(path)).astype(np.int64)
    rows, width = batch.num_rows, int(lengths.max(initial=0))
    if width < 2:
        return
    items = path.flatten()
    row = np.repeat(np.arange(rows), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    source, p, zero = (np.full((rows, width), -1, np.int64) for _ in range(3))
    for array, name in ((source, "number"), (p, "p"), (zero, "zero")):
        array[row, place] = pc.struct_field(items, name).to_numpy(zero_copy_only=False)
    code = langs.dictionary_encode()
    lang = code.indices.to_numpy()
    # a node opens where a row leaves the path of the row before
    same = np.ones(rows, bool)
    same[0] = False
    same[1:] = lang[1:] == lang[:-1]
    total = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy())))
    keys, highs, lows = [], [], []
    sources = int(source.max()) + 1
    for d in range(width):
        same[1:] &= (source[1:, d] == source[:-1, d]) & (p[1:, d] == p[:-1, d])
        opened = np.flatnonzero(~same)
        ends = np.append(opened[1:], rows)
        real = source[opened, d] >= 0
        opened, times = opened[real], (total[ends] - total[opened])[real]
        own_p, own_zero, own = p[opened, d], zero[opened, d], source[opened, d]
        for j in range(d):
            up_p, up_zero, up = p[opened, j], zero[opened, j], source[opened, j]
            for first, second, value in (
                (up, own, _gains(up_p, own_p) - _gains(up_p, own_zero) - _gains(up_zero, own_p) + _gains(up_zero, own_zero)),
                (own, up, _gains(own_p, up_p) - _gains(own_p, up_zero) - _gains(own_zero, up_p) + _gains(own_zero, up_zero)),
            ):
                keys.append((lang[opened] * sources + first) * sources + second)
                highs.append((value >> 30) * times)
                lows.append((value & (1 << 30) - 1) * times)
    pairs, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    high, low = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    np.add.at(high, inverse, np.concatenate(highs))
    np.add.at(low, inverse, np.concatenate(lows))
    yield pa.RecordBatch.from_arrays(
        [code.dictionary.take(pa.array(pairs // sources // sources)), pa.array(pairs // sources % sources), pa.array(pairs % sources), pa.array(high), pa.array(low)],
        names=["lang", "a", "b", "high", "low"])


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """For every (language, source) of ``docs(text, lang, source)`` its distance to the other sources and its own terms.

    Nulls are empty strings. Terms are runs of ASCII letters, in lower case, and characters beyond ASCII; each
    language keeps those in at least ``min_documents`` of its rows (repeated rows count each). Returns ``lang, source, part, item, value, rank``. Part
    ``pair`` has each other source of the language with the sum of f over all kept terms, part ``term`` the
    ``top_terms`` kept terms the source has more often than its language; ranks go by value, ties by item. A language
    with one source has no pairs, one without kept terms has pairs of value 0; an empty table gives no rows. Texts are read whole, in one task each.

    Counts are summed before every shuffle and joined as one row for each (language, source, term); sums of pairs reach a
    shuffle as one row for each pair and batch. All numbers are whole, sums have 38 digits.
    """
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = given.mapInArrow(_term_counts, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_documents).drop("docs")
    have = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    removed(counts)

    terms = have.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    totals = have.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = given.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = written(groups.na.fill(0).select("lang", "source", number.cast("long").alias("number"), "total", "terms", "lang_total").withColumn(
        "zero", F.when(F.col("terms") > 0, _probability("0", "total", "terms"))))

    rated = have.join(groups, ["lang", "source"]).select(
        "lang", "source", "number", "term", "zero",
        _probability("n", "total", "terms").alias("p"), _probability("lang_n", "lang_total", "terms").alias("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    own = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gain("p", "q")).alias("value"))
    own = own.withColumn("rank", rank).where(F.col("rank") <= top_terms)

    paths = rated.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("number", "p", "zero"))).alias("path"))
    paths = paths.where("size(path) > 1").groupBy("lang", "path").agg(F.count("*").alias("n"))
    paths = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = paths.mapInArrow(_tree, _PAIR_SUMS).select("lang", "a", "b", F.expr("cast(high as decimal(38,0)) * 1073741824 + low").cast("decimal(38,0)").alias("value"))
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    distinct = rated.groupBy("lang", F.col("number").alias("x"), "p", F.col("zero").alias("x0")).agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("number").alias("y"), F.col("zero").alias("y0"))
    one = distinct.join(others, "lang").where("x <> y").select("lang", F.expr(f"""inline(array(
        named_struct('a', x, 'b', y, 'value', cast(n * cast(({_gain('p', 'y0')}) - ({_gain('x0', 'y0')}) as decimal(20,0)) as decimal(38,0))),
        named_struct('a', y, 'b', x, 'value', cast(n * cast(({_gain('y0', 'p')}) - ({_gain('y0', 'x0')}) as decimal(20,0)) as decimal(38,0)))))"""))
    one = one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    left = groups.select("lang", "source", F.col("number").alias("a"), F.col("zero").alias("a0"), "terms")
    right = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("zero").alias("b0"))
    pairs = left.join(right, "lang").where("a <> b")
    neither = F.expr(f"coalesce(cast(terms * cast({_gain('a0', 'b0')} as decimal(20,0)) as decimal(38,0)), cast(0 as decimal(38,0)))")
    pairs = pairs.select("lang", "source", "item", "a", "b", neither.alias("value"))
    changes = one.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("change"))
    pairs = pairs.join(changes, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.expr("cast(value + coalesce(change, 0) as long)").alias("value"))
    return pairs.withColumn("rank", rank).unionByName(own)


def oracle(min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
w AS (SELECT id, lang, source, translate(unnest(words), '{upper}', '{upper.lower()}') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {min_documents}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS p,
       1 + ({SCALE} * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(x.value, 0) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
QUALIFY part = 'pair' OR rank <= {top_terms}
"""
