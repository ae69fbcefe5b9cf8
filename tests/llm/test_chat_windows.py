"""Chat windows against plain formatting of whole conversations, and exact round trips."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillscope.llm import chat_windows, encoding
from tillscope.llm.shared import stored, tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| < | <|"


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"), (2, 5, "user", ODD), (2, 7, "assistant", ODD), (2, 6, None, None)]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k} " + "and more words of it " * (k % 9)) for k in range(400)]
    rows += [(4, 0, "system", "The system turn stays in all windows.")] + [(4, 1 + k, ("user", "assistant")[k % 2], f"t{k} " * (1 + k % 40)) for k in range(300)]
    rows += [(5, 0, "system", "alone"), (6, 0, "assistant", "word " * 3000), (6, 1, "user", "x"), (6, 2, "assistant", "word " * 700), (6, 3, "assistant", "")]
    rows += [(None, None, "user", "no id"), (None, 1, "assistant", "none"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (7, 1, "role\n\\n<|", "a\nb")]
    rows += [(8, 0, "system", "s " * 2500), (8, 1, "assistant", "over the budget"), (8, 2, "system", "second"), (8, 3, "assistant", "z")]
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, chapter STRING, own INT, start DOUBLE"
    return stored(spark.createDataFrame([(*r, "clash", 1, 2.0) for r in rows], schema), "talk")


def plain(talk):
    """Turns of each conversation, in order; those that share a number are compared as multisets elsewhere."""
    found = defaultdict(list)
    for r in sorted(talk.collect(), key=lambda r: (r.turn is not None, r.turn or 0)):
        found[r.conv_id].append((r.role or "", r.text or ""))
    return found


WORDS = encoding.WordEncoder(tokenizer_path())


def cost(role, text):
    return sum(len(x) // 4 for x in WORDS.encode(chat_windows.escaped_role(role), chat_windows.escaped(text))) + chat_windows.FRAME


@pytest.mark.parametrize(("budget", "history", "chapter"), [(64, 20, 2), (2048, 512, 64), (300, 0, 1)])
def test_windows_hold_each_turn_once_and_fit(talk, budget, history, chapter):
    every = plain(talk)
    found = defaultdict(list)
    for r in chat_windows.windows(talk, tokenizer_path(), budget, history, chapter).collect():
        found[r.conv_id].append(r)
    assert {*found} == {*every}
    for conv_id, rows in found.items():
        turns, new = every[conv_id], []
        system = turns[0] if turns[0][0] == "system" else None
        for r in sorted(rows, key=lambda r: (r.chapter, r.window)):
            held = chat_windows.turns_of(r.text)
            assert "".join(chat_windows.rendered(*t) for t in held) == r.text
            assert r.n_tokens == sum(cost(*t) for t in held) and r.first_turn == len(new)
            assert len(held) == r.n_repeated + r.n_new and r.n_new > 0
            if system:
                assert held[0] == system
            before = held[bool(system and new) : r.n_repeated]
            if conv_id != 7:
                assert before == turns[len(new) - len(before) : len(new)]
            assert sum(cost(*t) for t in before) <= history
            if r.n_tokens > budget:  # one new turn, or the system turn and one
                assert r.n_new <= 1 + bool(system and not new) and not before
            targets = [chat_windows.unescaped(r.text[s["start"] : s["end"]]) for s in r.loss]
            assert targets == [t for role, t in held[r.n_repeated :] if role == "assistant"]
            new += held[r.n_repeated :]
        assert new == turns if conv_id != 7 else sorted(new) == sorted(turns)


def test_history_is_the_longest_that_fits(talk):
    rows = sorted((r for r in chat_windows.windows(talk, tokenizer_path(), 64, 20, 2).collect() if r.conv_id == 3), key=lambda r: r.first_turn)
    turns = plain(talk)[3]
    n = [cost(*t) for t in turns]
    assert len({r.chapter for r in rows}) > 20
    for r in rows:
        back = r.first_turn - r.n_repeated
        spare = max(0, min(20, 64 - n[r.first_turn]))
        assert sum(n[back : r.first_turn]) <= spare and (back == 0 or sum(n[back - 1 : r.first_turn]) > spare)
        after = r.first_turn + r.n_new
        # The next turn did not fit, or starts a chapter.
        assert after == len(n) or r.n_tokens + n[after] > 64 or sum(n[:after]) // 128 > r.chapter


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(every):
    return {
        i: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant")))
        for i, t in every.items()
    }


def told(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


@pytest.mark.parametrize("budget", [64, 2048])
def test_digests_equal_whole_conversations(talk, budget):
    got = told(chat_windows.digests(chat_windows.windows(talk, tokenizer_path(), budget, 20, 3)))
    want = wanted(plain(talk))
    assert {i: v for i, v in got.items() if i != 7} == {i: v for i, v in want.items() if i != 7}
    assert (got[7][0], got[7][2:]) == (want[7][0], want[7][2:])  # its turns share a number
    assert chat_windows.digests(chat_windows.windows(talk.where("false"), tokenizer_path())).count() == 0


def test_query_reads_back_every_conversation(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    want = wanted({**plain(spark.read.parquet(f"{SMALL}/conversations.parquet")), -1: [("user", odd), ("assistant", odd)]})
    assert told(chat_windows.op12_chat_windows(spark, SMALL)) == want


@settings(max_examples=300, deadline=None)
@given(st.text("<|\\\nn im_startend>", max_size=30), st.text("<|\\\nn im_startend>", max_size=30))
def test_escapes_are_reversible(role, text):
    assert chat_windows.turns_of(chat_windows.rendered(role, text) * 2) == [(role, text)] * 2
    assert "<|" not in chat_windows.escaped(text) and chat_windows.unescaped(chat_windows.escaped(text)) == text


def test_bad_limits_are_refused(talk):
    with pytest.raises(ValueError):
        chat_windows.windows(talk, tokenizer_path(), 64, 64)


def test_ranges_of_turns_change_nothing(spark, talk):
    """A conversation that several ranges share has the same windows as in one range."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    found = []
    for together in ("true", "false"):
        spark.conf.set(name, together)
        turns = stored(chat_windows.measured(talk, tokenizer_path()), "ranges")
        found.append((turns.where("conv_id = 3").select("pid").distinct().count(), sorted(map(repr, chat_windows.windows(talk, tokenizer_path(), 64, 20, 2).collect()))))
    spark.conf.set(name, "true")
    assert found[0][0] == 1 < found[1][0] and found[0][1] == found[1][1]
