import itertools
import random

import numpy as np
import pytest
from helpers import rows

from tablescout.operators import keys as Y
from tablescout.operators import profile as P
from tablescout.sources import catalog as C


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    person = [(i, f"p{i % 40}", "x" * 70 + str(i)) for i in range(1, 101)]
    # one person holds a third of all debts; 7 debts point nowhere; one has no person
    debt = [(i, 5 if i % 3 == 0 else rng.randint(1, 100), i % 4, i // 4) for i in range(600)]
    debt += [(600 + i, 1000 + i % 2, 0, 200 + i) for i in range(7)] + [(607, None, 1, 300)]
    return {
        "person": spark.createDataFrame(person, "p_id INT, p_name STRING, p_note STRING"),
        "debt": spark.createDataFrame(debt, "d_no BIGINT, d_id INT, d_part INT, d_group INT"),
        "empty": spark.createDataFrame([], "e_id INT"),
    }


def test_row_counts_show_empty_as_unknown(tables):
    assert rows(P.table_row_counts(tables)) == [("debt", 608, 608), ("empty", None, 0), ("person", 100, 100)]


def test_candidate_keys_against_brute_force(spark, tables):
    got = {(r.table_name, r.key_columns) for r in P.candidate_keys(spark, tables).collect()}
    want = set()
    for name, df in tables.items():
        data = [r.asDict() for r in df.collect()]
        single = {
            c for c in df.columns
            if data and all(r[c] is not None for r in data) and len({r[c] for r in data}) == len(data)
        }
        want |= {(name, c) for c in single}
        for a, b in itertools.combinations([c for c in df.columns if c not in single], 2):
            cells = [(r[a], r[b]) for r in data]
            if data and all(None not in c for c in cells) and len(set(cells)) == len(cells):
                want.add((name, f"{a},{b}"))
    assert got == want
    assert ("person", "p_note") in got and ("debt", "d_part,d_group") in got


def test_keys_of_mixed_types_and_three_columns(spark):
    cells = [(f"k{a}", b, c, (a * 7 + b + c) % 5) for a in range(3) for b in range(4) for c in range(5)]
    t = spark.createDataFrame(cells, "name STRING, day INT, part INT, other INT").selectExpr("name", "DATE '2024-01-01' + day AS day", "part", "other")
    pair = t.where("part = 0")
    assert {r.key_columns for r in P.candidate_keys(spark, {"t": t}, max_width=3).collect()} >= {"name,day,part"}
    assert P.candidate_keys(spark, {"t": t}).count() == 0
    assert "name,day" in {r.key_columns for r in P.candidate_keys(spark, {"t": pair}).collect()}


def smallest_keys(data, columns):
    """Keys of any width by trying all groups."""
    found = []
    for width in range(1, len(columns) + 1):
        for group in itertools.combinations(range(len(columns)), width):
            if not any(set(f) <= set(group) for f in found) and len({tuple(r[i] for i in group) for r in data}) == len(data):
                found.append(group)
    return {",".join(columns[i] for i in g) for g in found}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sampled", [1, 20, 500])
def test_keys_of_any_width_against_brute_force(spark, seed, sampled):
    rng = random.Random(seed)
    columns = ["a", "b", "c", "d", "e"]
    data = list({tuple(rng.randrange(n) for n in (4, 9, 3, 12, 200)) for _ in range(300)})
    t = spark.createDataFrame(data, ", ".join(f"{c} INT" for c in columns))
    got = {r.key_columns for r in P.candidate_keys(spark, {"t": t}, max_width=None, sampled=sampled).collect()}
    assert got == smallest_keys(data, columns) and got
    narrow = {r.key_columns for r in P.candidate_keys(spark, {"t": t}, max_width=2, sampled=sampled).collect()}
    assert narrow == {g for g in got if g.count(",") < 2}


def test_repeated_rows_leave_no_key(spark):
    t = spark.createDataFrame([(i, i % 3) for i in range(50)] + [(7, 1)], "a INT, b INT")
    assert P.candidate_keys(spark, {"t": t}, max_width=None).isEmpty()
    assert P.candidate_keys(spark, {"t": t.where("a < 0"), "u": t.selectExpr("CAST(NULL AS INT) AS n")}, max_width=None).isEmpty()


def test_most_columns_are_never_counted(spark):
    """Twenty columns of repeating values, one id, and a hot value in a third of the rows."""
    repeating = [f"pmod(xxhash64(id, {i}), {50 + 400 * i}) AS c{i}" for i in range(20)]
    t = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id DIV 2 END AS hot", *repeating)
    counted = []
    found = {r.key_columns for r in P.candidate_keys(spark, {"t": t}, max_width=1, counted=counted).collect()}
    assert found == {"id"} and counted == [("t", ("id",))]


def test_keys_are_checked_by_few_bytes_a_row(spark, monkeypatch):
    """No group of columns is sent value by value: neither keys nor one whose two equal rows no sample has."""
    t = spark.range(200_000).selectExpr("id", "id DIV 500 AS a", "CASE WHEN id = 7 THEN 8 ELSE id % 500 END AS b", "id % 7 AS c")
    sent, count = [], Y.distinct_counts
    monkeypatch.setattr(Y, "distinct_counts", lambda tables, wanted: sent.extend(wanted) or count(tables, wanted))
    counted = []
    found = {r.key_columns for r in P.candidate_keys(spark, {"t": t}, max_width=3, counted=counted).collect()}
    assert found == {"id", "a,b,c"} and ("t", ("a", "b")) in counted and sent == []
    bits = Y._bits(200_000)
    hashes = t.coalesce(2).selectExpr(f"shiftrightunsigned(xxhash64(id), {64 - bits}) AS h0", f"shiftrightunsigned(xxhash64(a, b), {64 - bits}) AS h1")
    blocks = Y.packed_hashes(hashes, [0, 1], [bits - 2, bits - 2]).selectExpr("number", "part", "length(steps) + 20 AS n").collect()
    assert {(r.number, r.part) for r in blocks} == set(itertools.product((0, 1), range(4)))
    assert sum(r.n for r in blocks) < 4 * 400_000


def test_blocks_hold_their_hashes():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 20), (1, 16), (2, 16), (3, 63), (5000, 63), (5000, 24), (5000, 16)):
        h = np.concatenate([rng.integers(0, 1 << bits, n), np.full(min(n, 9), 3)])
        for shift in (bits, bits - 5):
            blocks = list(Y._pack(h, shift))
            got = [x for _, *b in blocks for x in Y._unpack(*b).tolist()]
            assert got == sorted(x for v in set(h.tolist()) for x in [v] * min(2, (h == v).sum()))
            assert [p for p, *_ in blocks] == sorted({x >> shift for x in got})


@pytest.mark.parametrize("bits", [2, 9, 40])
@pytest.mark.parametrize("part, held", [(1 << 20, 1 << 22), (20, 30)])
def test_values_of_one_hash_are_told_apart(spark, monkeypatch, bits, part, held):
    """Few bits give many different values the same hash; small parts make a table large, so that shares of its values are tried first."""
    monkeypatch.setattr(Y, "_bits", lambda n: max(bits, 8 if part < 100 else 2))
    monkeypatch.setattr(Y, "PART", part)
    monkeypatch.setattr(Y, "HELD", held)
    rng = random.Random(bits)
    columns = ["a", "b", "c", "d"]
    data = list({tuple(rng.randrange(n) for n in (40, 30, 25, 6)) for _ in range(700)})
    tables = {
        "t": spark.createDataFrame(data, "a INT, b INT, c INT, d INT"),
        "u": spark.createDataFrame([(i, "x" if i % 2 else "y", i // 2) for i in range(500)], "k INT, s STRING, h INT"),
        "one": spark.createDataFrame([(1,)], "o INT"),
    }
    got = {(r.table_name, r.key_columns, r.n_rows) for r in P.candidate_keys(spark, tables, max_width=None).collect()}
    assert got == {("t", k, len(data)) for k in smallest_keys(data, columns)} | {("u", "k", 500), ("u", "s,h", 500), ("one", "o", 1)}


def test_times_are_keys_to_the_microsecond(spark):
    times = spark.range(300).selectExpr("timestamp_micros(1700000000000000 + id * 10) AS z", "CAST(timestamp_micros(id) AS TIMESTAMP_NTZ) AS n", "id DIV 2 AS pair")
    assert {r.key_columns for r in P.candidate_keys(spark, {"t": times}).collect()} == {"z", "n"}
    twice = times.union(times.where("pair = 9"))
    assert P.candidate_keys(spark, {"t": twice}).isEmpty()
    assert Y.distinct_counts({"t": twice}, [("t", ("z",)), ("t", ("n", "pair"))]) == {("t", ("z",)): 300, ("t", ("n", "pair")): 300}


def test_references_by_groups_of_columns(spark, tables):
    parts = spark.createDataFrame([(g, p, g * 10 + p) for g in range(6) for p in range(4) if (g, p) != (5, 3)], "g INT, p BIGINT, v INT")
    good = spark.createDataFrame([(i % 5, i % 4, None if i % 7 else 3) for i in range(60)] + [(None, 9, 1)], "s_g INT, s_p INT, s_x INT")
    bad = good.selectExpr("CASE WHEN s_g = 4 THEN 5 ELSE s_g END AS b_g", "s_p AS b_p").where("b_p <> 9")
    given = {"parts": parts, "good": good, "bad": bad}
    keys = P.candidate_keys(spark, {"parts": parts}, max_width=2)
    assert {r.key_columns for r in keys.collect()} == {"v", "g,p"}
    included = P.inclusion_dependencies(spark, given, key_columns=Y.key_parts(keys))
    got = {(r.dep_table, r.dep_columns, r.ref_columns): (r.n_values, r.coverage) for r in Y.composite_references(spark, given, keys, included).collect()}
    values = {t: [tuple(r) for r in df.collect()] for t, df in given.items()}
    held = {(g, p) for g, p, _ in values["parts"]}
    want = {}
    for t in ("good", "bad"):
        for i, j in itertools.permutations(range(len(given[t].columns)), 2):
            pairs = {(r[i], r[j]) for r in values[t] if None not in (r[i], r[j])}
            columns = [{r[k] for r in values[t]} - {None} for k in (i, j)]
            if pairs and pairs <= held and all(c <= {h[k] for h in held} for k, c in enumerate(columns)):
                want[t, f"{given[t].columns[i]},{given[t].columns[j]}", "g,p"] = (len(pairs), round(len(pairs) / len(held), 6))
    assert got == want
    assert Y.composite_references(spark, given, keys.where("width > 9"), included).isEmpty()


def test_inclusion_dependencies_against_brute_force(spark, tables):
    tables = {**tables, "visit": tables["debt"].where("d_id <= 90").selectExpr("d_no % 50 AS v_no", "concat('x', d_id) AS note", "concat(repeat('x', 70), d_id) AS v_note")}
    got = {(r.dep_column, r.ref_column, r.coverage) for r in P.inclusion_dependencies(spark, tables).collect()}
    values = {(t, c): {r[0] for r in df.select(c).collect()} - {None} for t, df in tables.items() for c in df.columns}
    keys = [("person", "p_id"), ("debt", "d_no"), ("person", "p_note")]
    want = {
        (d[1], r[1], round(len(values[d]) / len(values[r]), 6))
        for d in values for r in keys if d != r and values[d] and values[d] <= values[r]
    }
    assert got == want and ("v_note", "p_note") in {g[:2] for g in got}


def test_names_that_refer(spark):
    bank = spark.createDataFrame([(i, f"b{i}") for i in range(1, 9)], "id INT, title STRING")
    debt = spark.createDataFrame([(100 + i, 1 + i % 8, 1 + i % 4) for i in range(60)], "debt_no INT, bank_id INT, amount INT")
    found = P.inclusion_dependencies(spark, {"bank": bank, "debt": debt})
    assert [tuple(r) for r in P.references(found).collect()] == [("debt", "bank_id", "bank", "id")]
    assert {(r.dep_column, r.same_suffix, r.named, r.coverage) for r in found.collect()} == {("bank_id", True, True, 1.0), ("amount", False, False, 0.5)}


def test_many_columns_need_several_words(spark):
    wide = spark.createDataFrame([tuple(range(i, i + 70)) for i in range(0, 30)], ", ".join(f"c{i} INT" for i in range(70)))
    got = P.inclusion_dependencies(spark, {"w": wide}).count()
    values = [set(range(i, i + 30)) for i in range(70)]
    assert got == sum(1 for a in range(70) for b in range(70) if a != b and values[a] <= values[b])


def test_orphans(tables):
    r = P.orphan_check(tables, [("debt", "d_id", "person", "p_id")]).first()
    assert (r.n_refs, r.n_orphan_rows, r.n_orphan_keys) == (607, 7, 2)


def test_schema_report(spark, tables):
    facts = P.known_facts(tables)
    cat = C.observed_catalog(C.catalog(spark, tables, notes={"p_name": "full name"}), C.column_facts(tables))
    clean = {**tables, "debt": tables["debt"].where("d_id <= 100")}
    keys = P.candidate_keys(spark, tables, 1, facts)
    refs = P.references(P.inclusion_dependencies(spark, clean))
    asked = spark.createDataFrame([("debt",), ("person",), ("nowhere",)], "table_name STRING")
    report = P.table_schema_report(cat, P.table_row_counts(tables), keys, refs, asked)
    got = {(r.table_name, r.column_name): r for r in report.collect()}
    assert got["debt", "d_no"].is_pk and not got["debt", "d_no"].is_fk
    assert got["debt", "d_id"].refers_to == "person.p_id" and got["debt", "d_id"].is_nullable
    assert got["person", "p_name"].type_text == "varchar(3)" and got["person", "p_name"].description == "full name"
    missing = got["nowhere", None]
    assert (missing.status, missing.message) == ("empty", "table 'nowhere' not found") and missing.is_pk is None


def test_declared_types_in_catalog(spark):
    df = spark.createDataFrame([], "a DECIMAL(18,2), b TIMESTAMP_NTZ, c STRING")
    cat = P.column_details(C.catalog(spark, {"t": df}))
    assert [r.type_text for r in cat.orderBy("column_id").collect()] == ["decimal(18,2)", "timestamp", "varchar"]
    assert [r.column_name for r in P.catalog_columns(cat, "t").orderBy("column_id").collect()] == ["a", "b", "c"]


def test_orphans_in_one_pass(spark):
    tables = {
        "child": spark.createDataFrame([(1, "x", 5), (1, "y", 9), (7, None, None), (None, "z", 9)], "a INT, b STRING, up SMALLINT"),
        "parent": spark.createDataFrame([(1, "x"), (1, "x"), (None, "q")], "k BIGINT, t STRING"),
        "empty": spark.createDataFrame([], "k INT"),
    }
    links = [("child", "a", "parent", "k"), ("child", "b", "parent", "t"), ("child", "up", "child", "a"), ("child", "a", "empty", "k"),
             ("empty", "k", "parent", "k"), ("child", "a", "parent", "t")]
    found = P.orphan_check(tables, links)
    got = {(r.child, r.parent): (r.n_refs, r.n_orphan_rows, r.n_orphan_keys) for r in found.collect()}
    assert got == {
        ("child.a", "parent.k"): (3, 1, 1), ("child.b", "parent.t"): (3, 2, 2), ("child.up", "child.a"): (3, 3, 2),
        ("child.a", "empty.k"): (3, 3, 2), ("empty.k", "parent.k"): (0, 0, 0), ("child.a", "parent.t"): (3, 3, 2),
    }
