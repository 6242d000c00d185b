"""Keys of any width that nobody declared, and references to them by groups of columns."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.session import small_frame
from tablescout.sources.catalog import FACTS, column_facts

SAMPLED = 500  # rows of each sample: pairs of rows are compared within one
BITS = 62  # columns in one word of an agree set
SHARE = 64  # composite references, and keys of large tables, are first tried on one in this many values
HELD = 1 << 22  # hashes that a task holds before it packs them
PART = 1 << 20  # hashes that are searched for repeats at once; tables of more rows are large

Group = tuple[str, tuple[str, ...]]  # table, columns


def known_facts(tables: dict[str, DataFrame], wanted: tuple[str, ...] = FACTS) -> dict[tuple[str, str], dict]:
    """Facts of every column on the driver: as many rows as the schemas have columns."""
    return {(r["table_name"], r["column_name"]): r.asDict() for r in column_facts(tables, wanted).collect()}


def _values(table: DataFrame, columns: tuple[str, ...] | list[str]) -> list:
    """Columns as JSON can tell their values apart: it cuts times to the millisecond."""
    out = []
    for name in columns:
        c, kind = F.col(f"`{name}`"), table.schema[name].dataType
        out.append((F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("string") if isinstance(kind, T.TimestampNTZType) else c).alias(name))
    return out


def _hashed(table: DataFrame, columns: tuple[str, ...]):
    return F.unhex(F.sha2(F.to_json(F.struct(*_values(table, columns))), 256))


def distinct_counts(tables: dict[str, DataFrame], wanted: list[Group]) -> dict[Group, int]:
    """Exact distinct counts of columns or column groups without NULLs: one scan of each table and one shuffle.

    Every row gives each group's values as a SHA-256, once per task and value; one row per group comes back.
    """
    parts, number = [], {g: i for i, g in enumerate(wanted)}
    for t in sorted({t for t, _ in wanted}):
        cells = [F.struct(F.lit(number[t, cols]).alias("number"), _hashed(tables[t], cols).alias("value")) for name, cols in wanted if name == t]
        parts.append(tables[t].select(F.inline(F.array(*cells))))
    if not parts:
        return {}
    counted = reduce(DataFrame.union, parts).distinct().groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["number"]: r["n"] for r in counted}
    return {g: found.get(i, 0) for g, i in number.items()}


def _largest(sets: set[frozenset[int]]) -> list[frozenset[int]]:
    """The sets that no other one holds."""
    kept: list[frozenset[int]] = []
    for s in sorted(sets, key=len, reverse=True):
        if not any(s < k for k in kept):
            kept.append(s)
    return kept


def _agreeing(sample: pa.Table) -> pa.Table:
    """The largest sets of columns in which two rows of one sample agree; an empty one if none do."""
    codes = sample.column("codes").combine_chunks()
    codes = np.asarray(codes.flatten().dictionary_encode().indices).reshape(sample.num_rows, -1)
    pair = np.triu_indices(len(codes), 1)
    words = np.zeros((len(pair[0]), -(-codes.shape[1] // BITS)), np.int64)
    for c, column in enumerate(codes.T):
        words[:, c // BITS] |= (column[pair[0]] == column[pair[1]]).astype(np.int64) << (c % BITS)
    agreed = np.unique(words[:, 0])[:, None] if words.shape[1] == 1 else np.unique(words, axis=0)
    bits = (agreed[:, :, None] >> np.arange(BITS)) & 1
    found = {frozenset(np.flatnonzero(row).tolist()) for row in bits.reshape(len(agreed), words.shape[1] * BITS)}
    sets = pa.array([sorted(s) for s in _largest(found | {frozenset()})], pa.list_(pa.int32()))
    same = {c: pa.repeat(sample.column(c)[0], len(sets)) for c in ("table_name", "number")}
    return pa.table({**same, "n_rows": pa.repeat(pa.scalar(sample.num_rows, pa.int32()), len(sets)), "agreeing": sets})


def _coded(table: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """A table's columns as c0, c1, ..., and the codes of a row's values, equal for equal values only."""
    # a filter that names all columns at once would make the planner's work grow exponentially with computed columns
    given = table.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    return given, F.array(*[F.md5(F.to_json(F.struct(v.alias("v")))) for v in _values(given, given.columns)])


def _compared(chosen: list[DataFrame], sampled: int) -> DataFrame:
    """Sets of columns in which two rows of a sample agree; of each sample only the first ``sampled`` rows by hash."""
    order = W.partitionBy("table_name", "number").orderBy("hash", F.xxhash64("codes"))
    samples = reduce(DataFrame.union, chosen).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sampled)
    return samples.groupBy("table_name", "number").applyInArrow(_agreeing, "table_name STRING, number INT, n_rows INT, agreeing ARRAY<INT>")


def agree_sets(tables: dict[str, DataFrame], columns: dict[str, list[str]], n_rows: dict[str, int], sampled: int = SAMPLED) -> dict[str, set[frozenset[str]]]:
    """Sets of columns in which two rows of a table were seen to agree, so that no part of them is a key.

    A table is sampled once for each of ``columns`` and once by whole rows: the rows whose value hashes lowest, so that rows with equal values
    come into a sample together whatever the size of the table. Samples have ``sampled`` rows at most and are cut down before they are
    shuffled; pairs are compared within a sample, where a row occurs once. One scan of each table.
    """
    parts = []
    for t, cols in columns.items():
        if not cols:
            continue
        given, codes = _coded(tables[t], cols)
        hashes = F.array(F.xxhash64(*given.columns), *[F.xxhash64(c) for c in given.columns])
        bound = -(1 << 63) + min((1 << 64) - 1, 2 * sampled * (1 << 64) // n_rows[t])
        chosen = given.select("*", F.posexplode(hashes).alias("number", "hash")).where(F.col("hash") <= bound)
        parts.append(chosen.select(F.lit(t).alias("table_name"), codes.alias("codes"), "number", "hash"))
    if not parts:
        return {}
    seen = _compared(parts, sampled).select("table_name", "agreeing").distinct().collect()
    out: dict[str, set[frozenset[str]]] = {t: set() for t in columns}
    for r in seen:  # sets of columns
        out[r["table_name"]].add(frozenset(columns[r["table_name"]][i] for i in r["agreeing"]))
    return out


def _pack(hashes: np.ndarray, shift: int):
    """Sorted hashes by part (what is left of the ``shift`` lowest bits): the first one, and the steps to the next in few bytes, byte by byte."""
    h = np.sort(hashes)
    h = h[np.concatenate([np.ones(min(2, len(h)), bool), h[2:] != h[:-2]])]  # of equal hashes two are enough
    for block in np.split(h, np.flatnonzero(np.diff(h >> shift)) + 1) if len(h) else []:
        steps = np.diff(block)
        width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
        yield int(block[0]) >> shift, int(block[0]), width, steps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(first: int, width: int, steps: bytes) -> np.ndarray:
    """The hashes of a block as ``_pack`` gives it."""
    wide = np.zeros((len(steps) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(steps, np.uint8).reshape(width, -1).T
    return first + np.concatenate([[0], np.cumsum(wide.view("<i8")[:, 0])])


PACKED = "number INT, part INT, first BIGINT, width INT, steps BINARY"


def packed_hashes(hashes: DataFrame, numbers: list[int], shifts: list[int]) -> DataFrame:
    """The hashes of each column (NULL: none) in blocks, of a few bytes for each hash, that can be searched part by part."""
    held = HELD // len(numbers)

    def blocks(kept):
        rows = [(n, *b) for n, shift, arrays in zip(numbers, shifts, zip(*kept)) for b in _pack(np.concatenate(arrays), shift)]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["number", "part", "first", "width", "steps"])

    def packed(batches):
        kept, n = [], 0
        for batch in batches:
            kept.append([c.drop_null().to_numpy() for c in batch.columns])
            n += max(map(len, kept[-1]))
            if n >= held:
                yield blocks(kept)
                kept, n = [], 0
        if kept:
            yield blocks(kept)

    return hashes.mapInArrow(packed, PACKED)


def repeated_hashes(blocks: DataFrame, most: int) -> DataFrame:
    """Hashes that occur more than once under a number, ``most`` of each number: the smallest ones."""

    def repeated(part: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([_unpack(*b) for b in zip(*(part.column(c).to_pylist() for c in ("first", "width", "steps")))]))
        again = np.unique(h[1:][h[1:] == h[:-1]])[:most]
        return pa.table({"number": pa.repeat(part.column("number")[0], len(again)), "hash": pa.array(again, pa.int64())})

    found = blocks.groupBy("number", "part").applyInArrow(repeated, "number INT, hash BIGINT")
    nth = F.row_number().over(W.partitionBy("number").orderBy("hash"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def _bits(n_rows: int) -> int:
    """Bits of a hash so that about 30 pairs of different values at most have the same one."""
    return max(16, min(63, 2 * n_rows.bit_length() - 6))


def repeats(
    tables: dict[str, DataFrame], columns: dict[str, list[str]], n_rows: dict[str, int], shares: dict[Group, int], sampled: int = SAMPLED
) -> dict[str, set[frozenset[str]]]:
    """Sets of columns in which two rows of a table agree. A group of columns without NULLs repeats if one of them holds it.

    ``shares`` has the groups, and the share of each one's values (one in so many, a power of two) to look at; of 1, no repeat is missed. Values
    are hashed to twice the bits that the row count has, and sent packed, in about as many bytes as the hash has beyond the rows of a task. The
    rows of hashes met twice, some of each group, are read in a second scan and compared, so two values with one hash do no harm. Should this
    not tell for all values of a group, its distinct values are counted.
    """
    groups, listed, blocks, hashed = list(shares), max(1, sampled // 4), [], {}
    for t in sorted({t for t, _ in groups}):
        given, codes = _coded(tables[t], columns[t])
        bits, hashes, shifts = _bits(n_rows[t]), {}, []
        for i, (name, cols) in enumerate(groups):
            if name == t:
                value = F.shiftrightunsigned(F.xxhash64(*[F.col(f"c{columns[t].index(c)}") for c in cols]), 64 - bits)
                top = bits - (shares[t, cols].bit_length() - 1)
                shifts.append(top - min(top, (n_rows[t] // shares[t, cols] // PART).bit_length()))
                hashes[i] = value if shares[t, cols] == 1 else F.when(value < 1 << top, value)
        hashed[t] = given, codes, hashes
        blocks.append(packed_hashes(given.select(*[h.alias(f"h{i}") for i, h in hashes.items()]), list(hashes), shifts))
    if not blocks:
        return {}
    found = repeated_hashes(reduce(DataFrame.union, blocks), listed + 1).collect()  # some of each group
    out: dict[str, set[frozenset[str]]] = {t: set() for t in hashed}
    if not found:
        return out
    n_found = Counter(r["number"] for r in found)
    picked = F.broadcast(small_frame(tables[groups[0][0]].sparkSession, found, "number INT, hash BIGINT"))
    chosen = []
    for t, (given, codes, hashes) in hashed.items():
        cells = [F.struct(F.lit(i).alias("number"), h.alias("hash")) for i, h in hashes.items() if i in n_found]
        if cells:
            rows = given.select("*", F.inline(F.array(*cells)).alias("number", "hash")).join(picked, ["number", "hash"])
            chosen.append(rows.select(F.lit(t).alias("table_name"), codes.alias("codes"), "number", "hash"))
    n_compared = {}
    for r in _compared(chosen, sampled).collect():  # sets of columns
        out[r["table_name"]].add(frozenset(columns[r["table_name"]][i] for i in r["agreeing"]))
        n_compared[r["number"]] = r["n_rows"]
    unknown = [
        (t, cols) for i, (t, cols) in enumerate(groups)
        if shares[t, cols] == 1 and (n_found[i] > listed or n_compared.get(i, 0) >= sampled) and not any(s.issuperset(cols) for s in out[t])
    ]
    for (t, cols), n in distinct_counts(tables, unknown).items():
        if n < n_rows[t]:
            out[t].add(frozenset(cols))
    return out


def smallest_hitting(sets: list[frozenset[str]], width: int | None = None) -> set[frozenset[str]]:
    """Smallest groups (of up to ``width`` members) that hold a member of every set."""
    hitting = {frozenset()}
    for s in sorted(sets, key=len):
        held = {h for h in hitting if h & s}
        for h in hitting - held:
            if width is None or len(h) < width:
                held |= {n for c in s for n in [h | {c}] if not any(k < n for k in held if c in k)}
        hitting = {h for h in held if not any(k < h for k in held if len(k) < len(h))}
    return hitting


def key_candidates(columns: list[str], agreed: set[frozenset[str]], width: int | None) -> set[tuple[str, ...]]:
    """Smallest groups of columns in which no two rows were seen to agree, in the order of the table."""
    differing = [frozenset(columns) - s for s in _largest(agreed | {frozenset()})]
    groups = smallest_hitting(differing, width) if columns and all(differing) else set()
    return {tuple(c for c in columns if c in g) for g in groups}


def candidate_keys(
    spark: SparkSession, tables: dict[str, DataFrame], max_width: int | None = 2, facts=None, sampled: int = SAMPLED, counted: list[Group] | None = None
) -> DataFrame:
    """Columns, and groups of up to ``max_width`` columns (None: any width) that hold no smaller key, that are unique and never NULL.

    Columns of numbers, text, dates and times can be part of a key. Two sampled rows that agree in some columns rule out every group of these
    (``agree_sets``); the smallest groups that no pair rules out are checked on all rows (``repeats``), those of large tables first on one in
    ``SHARE`` values. One that turns out to repeat is ruled out in turn, with the other columns its rows agree in, until all that are left have
    been checked in full. ``counted`` takes the groups that were; most columns of a large table are not among them. Empty tables have no keys.
    """
    facts = facts or known_facts(tables, ("nulls",))
    columns = {t: [c for name, c in facts if name == t and facts[t, c]["family"] and facts[t, c]["n_rows"] and not facts[t, c]["n_nulls"]] for t in tables}
    n_rows = {t: facts[t, cs[0]]["n_rows"] for t, cs in columns.items() if cs}
    agreed = agree_sets(tables, columns, n_rows, sampled)
    looked_at: dict[Group, int] = {}
    while True:
        groups = [(t, g) for t, cs in columns.items() if cs for g in sorted(key_candidates(cs, agreed[t], max_width))]
        new = {(t, g): SHARE if n_rows[t] > PART and (t, g) not in looked_at else 1 for t, g in groups if looked_at.get((t, g)) != 1}
        if not new:
            break
        looked_at.update(new)
        for t, sets in repeats(tables, columns, n_rows, new, sampled).items():
            agreed[t] |= sets
    if counted is not None:
        counted.extend(g for g, share in looked_at.items() if share == 1)
    found = [(t, ",".join(cols), len(cols), n_rows[t]) for t, cols in groups]
    return small_frame(spark, found, "table_name STRING, key_columns STRING, width INT, n_rows BIGINT")


def _comparable(column: str, kind: str):
    """A key value as text, equal for equal values of a kind whatever their types."""
    c = F.col(f"`{column}`")
    if kind == "number":
        return c.cast("decimal(38, 6)").cast("string")
    return c.cast("timestamp_ntz").cast("string") if kind == "time" else c.cast("string")


def _pairings(keys: DataFrame, included: DataFrame) -> DataFrame:
    """Groups of columns that may refer to a key of several: each is included in its key column, all are of one other table.

    Built key column by key column as joins of the single inclusions; a group takes no column twice.
    """
    wide = keys.where("width > 1").select(F.col("table_name").alias("ref_table"), F.split("key_columns", ",").alias("ref_columns"))
    single = included.select("dep_table", "ref_table", "dep_column", "ref_column").where("dep_table <> ref_table")
    widest = wide.agg(F.max(F.size("ref_columns"))).first()[0] or 0
    out, grown = None, None
    for i in range(widest):
        part = wide if grown is None else grown.where(F.size("ref_columns") > i)
        part = part.withColumn("ref_column", F.get("ref_columns", F.lit(i)))
        if grown is None:
            grown = part.join(single, ["ref_table", "ref_column"]).withColumn("dep_columns", F.array("dep_column"))
        else:
            grown = part.join(single, ["ref_table", "dep_table", "ref_column"]).where(~F.array_contains("dep_columns", F.col("dep_column")))
            grown = grown.withColumn("dep_columns", F.array_append("dep_columns", F.col("dep_column")))
        grown = grown.select("dep_table", "dep_columns", "ref_table", "ref_columns")
        done = grown.where(F.size("ref_columns") == i + 1)
        out = done if out is None else out.union(done)
    return out if out is not None else small_frame(
        keys.sparkSession, [], "dep_table STRING, dep_columns ARRAY<STRING>, ref_table STRING, ref_columns ARRAY<STRING>")


def composite_references(spark: SparkSession, tables: dict[str, DataFrame], keys: DataFrame, included: DataFrame, facts=None) -> DataFrame:
    """Groups of columns whose every combination of values, without NULLs, occurs in a key of several columns of another table.

    ``keys`` as from ``candidate_keys``; ``included``: single inclusions whose key columns are all columns of those keys, as from
    ``inclusion_dependencies``. Groups are joined from single inclusions, tried on the combinations whose hash is in one part of ``SHARE`` on
    both sides (one missing there refutes exactly), and the rest is counted on all. Groups with no combination refer to nothing.
    """
    facts = facts or known_facts(tables, ("nulls",))
    pairs = [(r["dep_table"], tuple(r["dep_columns"]), r["ref_table"], tuple(r["ref_columns"])) for r in _pairings(keys, included).collect()]  # names only
    pairs = sorted(pairs)

    def compared(chosen: list[int], share: int) -> dict[int, tuple[int, int, int]]:
        """Combinations of the group, of the key, and of both, by number of the pair."""
        sides: dict[str, list] = {}
        for i in chosen:
            dep_table, dep, ref_table, ref = pairs[i]
            for table, cols, side in ((dep_table, dep, 1), (ref_table, ref, 2)):
                values = [_comparable(c, facts[table, c]["family"]) for c in cols]
                value = F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), F.sha2(F.to_json(F.array(*values)), 256))
                sides.setdefault(table, []).append(F.struct(F.lit(i).alias("pair"), F.lit(side).alias("side"), F.unhex(value).alias("value")))
        if not sides:
            return {}
        rows = reduce(DataFrame.union, [tables[t].select(F.inline(F.array(*cells))) for t, cells in sorted(sides.items())]).where("value IS NOT NULL")
        if share > 1:
            rows = rows.where(F.pmod(F.xxhash64("value"), F.lit(share)) == 0)
        sets = rows.groupBy("pair", "value").agg(F.bit_or("side").alias("sides"))
        sums = sets.groupBy("pair").agg(F.count_if(F.col("sides") != 2).alias("dep"), F.count_if(F.col("sides") != 1).alias("ref"), F.count_if(F.col("sides") == 3).alias("both"))
        return {r["pair"]: (r["dep"], r["ref"], r["both"]) for r in sums.collect()}  # a row for each pair

    tried = compared(list(range(len(pairs))), SHARE)
    left = [i for i in range(len(pairs)) if tried.get(i, (0, 0, 0))[0] == tried.get(i, (0, 0, 0))[2]]
    out = [
        (*(",".join(p) if isinstance(p, tuple) else p for p in pairs[i]), dep, round(dep / ref, 6))
        for i, (dep, ref, both) in sorted(compared(left, 1).items()) if dep and dep == both
    ]
    return small_frame(spark, out, "dep_table STRING, dep_columns STRING, ref_table STRING, ref_columns STRING, n_values BIGINT, coverage DOUBLE")


def key_parts(keys: DataFrame) -> set[tuple[str, str]]:
    """Columns of the keys of several columns, as ``inclusion_dependencies`` takes them."""
    rows = keys.where("width > 1").select("table_name", F.explode(F.split("key_columns", ",")).alias("c")).distinct().collect()
    return {(r["table_name"], r["c"]) for r in rows}
