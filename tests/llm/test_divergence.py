"""Source divergence against sums over every term one by one."""

import re
from collections import Counter, defaultdict

import pytest
from brute import frame, prose

from tablescout.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = [w.translate(UPPER) for w in TERM.findall(text)]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted((s for la, s in groups if la == lang), key=str.encode)

        def rates(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: rates(counts[lang, s]) for s in sources}
        q = rates(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, values, last in (("pair", pairs, None), ("term", terms, top)):
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(values[:last])]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def awkward():
    rows = []
    for i in range(240):
        lang = ["en", "de", None, "x"][i % 4]
        source = f"s{(i * 7) % (11 if lang == 'en' else 3)}" if i % 13 else None
        rows.append((i, prose(i % 17, 30 + i % 5 * 40) + " Straße ÉCOLE word_two x1y " + "rare" * (i % 3), lang, source))
    rows += [(900, None, "en", "s1"), (901, "", "en", "empty"), (902, "1 2 3 !", "en", "empty"), (903, "alone", "one", "only"), (904, "a b", "two", "l"), (905, "c", "two", "r")]
    return rows + [(5, "same text again", "de", "s1")] * 40 + [(6, "long " + prose(2, 60_000), "de", "s2")]


def test_every_pair_and_term(spark):
    rows = awkward()
    assert got(frame(spark, rows, SCHEMA)) == expected(rows)


def test_small_batches_and_top(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BATCH_CELLS", 40)
    monkeypatch.setattr(divergence, "BATCH_TERMS", 25)
    rows = awkward()
    assert got(frame(spark, rows, SCHEMA), min_documents=2, top_terms=7) == expected(rows, 2, 7)


def test_table_of_the_smallest_size(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(df) == expected([tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()])


def test_ties_go_by_bytes(spark):
    rows = [(i, "é z a", "l", s) for i in range(3) for s in ("é", "b", "a")] + [(9, "only here here", "l", "a")] * 3
    assert got(frame(spark, rows, SCHEMA)) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a", "l", "s"), (2, "a", "l", "t")]])
def test_empty_tables_and_languages_without_terms(spark, rows):
    assert got(frame(spark, rows, SCHEMA)) == expected(rows)


def test_clashing_columns(spark):
    rows = [(i, "one two " + "three " * (i % 2), "l", "st"[i % 2], 7, "x") for i in range(8)]
    df = frame(spark, rows, SCHEMA + ", term long, value string")
    assert got(df) == got(df.withColumnsRenamed({"term": "rank", "value": "path"})) == expected([r[:4] for r in rows])
