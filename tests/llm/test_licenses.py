import re

from brute import frame, prose

from tablescout.llm.licenses import TEMPLATES, scan


def pairs(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return set(zip(words, words[1:]))


def expected(rows, dice=0.8):
    out = {}
    for i, text in rows:
        for passage in {*(text or "").split("\n"), *re.split(r"\n\s*\n", text or ""), text or ""}:
            for name, notice in TEMPLATES:
                a, b = pairs(passage), pairs(notice)
                d = round(2 * len(a & b) / (len(a) + len(b)), 9) if a else 0
                if d >= dice:
                    out.setdefault((i, name), []).append((d, passage))
    return sorted(((i, n, len({p for _, p in found}), max(d for d, _ in found)) for (i, n), found in out.items()), key=repr)


def test_awkward_rows(spark):
    mit = TEMPLATES[5][1]
    rows = [
        (1, None), (2, ""), (3, prose(1, 200)), (4, "Released under the MIT License."), (5, "  released   UNDER the mit license!!\nmore text here"), (6, "Released under the"),
        (7, prose(2, 30) + "\n" + mit + "\n" + prose(3, 40)), (8, prose(2, 5) + "\n\n" + mit.replace("conditions", "terms").replace(", ", ",\n") + "\n \n" + prose(4, 5)),
        (9, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (10, "Licensed under the Apache License 2.0"),
        (11, mit + " " + prose(5, 4)), (12, mit + " " + prose(5, 60)), (None, "Released under the MIT License."), (13, "Released under the MIT License. " * 400), (14, "é ñ"),
        (9, "Released under the MIT License."),
    ]
    merged = {}
    for i, t in rows:
        merged[i] = t if i not in merged else merged[i] + "\n\n" + t
    docs = frame(spark, [(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((tuple(r) for r in scan(docs).collect()), key=repr)
    want = expected([(i, t) for i, t in rows if i != 9])
    assert [r for r in got if r[0] != 9] == want
    assert [r[:2] for r in got if r[0] == 9] == [(9, "Apache-2.0"), (9, "CC-BY-NC-4.0"), (9, "MIT")]
    assert scan(docs.limit(0)).collect() == []


def test_size_bounds_lose_nothing(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.where("lower(text) like '%licens%'").collect()]
    for dice in (0.5, 0.8):
        got = sorted((tuple(r) for r in scan(frame(spark, rows), dice=dice).collect()), key=repr)
        assert got == expected(rows, dice)
