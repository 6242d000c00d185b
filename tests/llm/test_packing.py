import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablescout.llm.packing import WordIds, differenced, packed, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, None), (2, ""), (3, "a"), (4, prose(1, 40)), (5, prose(2, 9000)), (6, prose(3, 700)), (6, prose(3, 700)), (None, prose(4, 200)), (None, None),
    (7, "<|endoftext|> x <|startoftext|>"), (8, "don't I'LL 12ab-3é!? ÀÉÎİΣ ΟΔΟΣ é \x1c!\x85?\xa0ﬁ 你好 ½²"), (9, "w " * 4095), (10, "w " * 4096),
]


def check_packing(spark, docs, rows, least_full):
    tokenizer = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    got = packed(docs, PATH).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for doc, texts in ids.items():
        assert sorted(p for s, n in pieces[doc] for p in range(s, s + n)) == sorted(p for x in texts for p in range(len(x)))
    lengths = []
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end = offset + length
        lengths.append(end)
    assert max(lengths) <= 4096
    assert sum(lengths) >= least_full * 4096 * len(lengths)


def test_awkward_rows(spark):
    check_packing(spark, frame(spark, ROWS), ROWS, 0.6)


def test_table_of_the_smallest_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packing(spark, docs, [(r.doc_id, r.text) for r in docs.collect()], 0.97)


def test_empty_table(spark):
    assert packed(frame(spark, []), PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("aB'ts1é ²!\x1c İΣÅ", max_size=30))
def test_words_give_the_ids_of_the_text(text):
    got = np.frombuffer(WordIds(PATH).text(text), "<u4").tolist()
    assert got == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ways", [1, 2, 7])
def test_differencing_takes_every_item_once_and_evens_out(ways):
    sizes = np.random.default_rng(ways).integers(1, 4096, 300).tolist()
    parts = differenced(sizes, ways)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 64


def test_differencing_by_hand():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in differenced([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_windows_rise_until_all_fit():
    assert sorted(map(sorted, windows([3000, 3000, 3000], 4096))) == [[0], [1], [2]]
    assert windows([], 4096) == []


def test_repeated_rows_are_spread_over_groups(spark):
    docs = frame(spark, [(1, prose(5, 30))] * 400)
    got = packed(docs, PATH, group=40).collect()
    groups = {r.sequence_id >> 32 for r in got}
    assert len(got) >= 400 and sum(r.length for r in got) == 400 * got[0].doc_tokens and len(groups) >= 8
