from brute import frame

from tablescout.llm.chat import conversations, formatted, preference_pairs

SCHEMA = "conv_id long, turn long, role string, text string"


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def learned(text, mask):
    return [text[m.start : m.end] for m in mask]


def turns(conv, *said):
    return [(conv, k, r, t) for k, (r, t) in enumerate(said)]


A = [("user", "hi"), ("assistant", "ho"), ("user", "well?"), ("assistant", "fine é")]
B = [("user", "hi"), ("assistant", "ho"), ("user", "well?"), ("assistant", "bad"), ("user", "oh")]
C = [("user", "hi"), ("assistant", "other")]
D = [("system", "s"), ("user", "alone"), ("assistant", "yes")]
E = [("user", "nobody answers")]


def test_pairs_and_their_texts(spark):
    rows = [r for i, c in enumerate((A, B, C, D, E), 1) for r in turns(i, *c)]
    got = {(r.chosen_id, r.rejected_id): r for r in formatted(preference_pairs(frame(spark, rows, SCHEMA))).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, None), (4, None), (5, None)}
    r = got[1, 2]
    assert (r.prefix_turns, r.prompt, r.chosen_completion, r.rejected_completion) == (3, rendered(A[:3]), rendered(A[3:]), rendered(B[3:]))
    assert learned(r.chosen_completion, r.chosen_mask) == ["fine é<|end|>"] and learned(r.rejected_completion, r.rejected_mask) == ["bad<|end|>"]
    r = got[1, 3]
    assert (r.prompt, r.chosen_completion, r.rejected_completion) == (rendered(A[:1]), rendered(A[1:]), rendered(C[1:]))
    assert learned(r.chosen_completion, r.chosen_mask) == ["ho<|end|>", "fine é<|end|>"]
    r = got[1, None]
    assert (r.prompt, r.chosen_completion, r.rejected_completion) == (rendered(A[:3]), rendered(A[3:]), rendered(A[1:2]))
    r = got[4, None]
    assert (r.prompt, r.chosen_completion, r.rejected_completion, r.rejected_mask) == (rendered(D[:2]), rendered(D[2:]), "", [])
    r = got[5, None]
    assert (r.prompt, r.chosen_completion, r.rejected_completion) == (rendered(E), "", "")


def test_awkward_turns(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "user", "b"), (1, None, "system", "first"), (None, 0, "user", "lost"), (2, 0, "assistant", ""), (2, 0, "assistant", "x")]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in conversations(frame(spark, rows, SCHEMA)).collect()}
    assert got == {1: [("system", "first"), ("", ""), ("user", "b")], 2: [("assistant", ""), ("assistant", "x")]}
    assert formatted(preference_pairs(frame(spark, [], SCHEMA))).collect() == []


def test_own_pairs_with_clashing_columns(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(A, A, "p", 1), (A, None, None, 2), (None, None, "q", 3), (A[:2], A, "r", 4)]
    pairs = frame(spark, rows, f"chosen {turn}, rejected {turn}, spans string, at int")
    got = {r.at: r for r in formatted(pairs).collect()}
    assert (got[1].prompt, got[1].chosen_completion, got[1].rejected_completion, got[1].spans) == (rendered(A), "", "", "p")
    assert (got[2].prompt, got[2].chosen_completion, got[2].rejected_completion) == ("", rendered(A), "")
    assert (got[3].prompt, got[3].chosen_completion, got[3].chosen_mask) == ("", "", [])
    assert (got[4].prompt, got[4].chosen_completion, got[4].rejected_completion) == (rendered(A[:2]), "", rendered(A[2:]))
