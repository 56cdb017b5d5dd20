import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import chat

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|end|>"]), st.text(alphabet="ab <[\\|/>]s\n", max_size=40)), max_size=12)


def expected(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r)):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@given(st.text(alphabet="ab<[\\|/>]"))
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(x in chat.escape(text) for x in ("</s>", "[INST]", "[/INST]", "<|"))


@settings(max_examples=200, deadline=None)
@given(TURNS, st.integers(5, 60), st.integers(0, 30))
def test_windows(turns, budget, history):
    w = chat._Windows(budget, history)
    rows = [r for r in [w.add(*t) for t in turns] + [w.rest()] if r]
    new, loss = [], []
    for text, start, end, tokens, n in rows:
        parsed = chat.parse(text)
        assert sum(x[0] for x in parsed) == n
        assert tokens == sum(chat.turn_tokens(x[2]) for x in parsed)
        system = turns[0][0] == "system"
        floor = chat.turn_tokens(turns[0][1]) if system else 0
        assert tokens <= budget or n == 1 or floor > budget or (system and n == 2) or tokens <= floor + history + budget
        if system:
            assert parsed[0][1:] == turns[0]
        new += [x[1:] for x in parsed if x[0]]
        loss += [chat.unescape(text[a:b]) for a, b in zip(start, end)]
    assert new == turns
    assert loss == [t for r, t in turns if r == "assistant"]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (None, None, "system", "s"), (None, 2, "assistant", ""), (2, 5, "assistant", "w " * 90000), (2, 4, "user", "</s>[INST]")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(df, 20, 10)).collect()}
    assert got == expected(rows)
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    assert {r.conv_id: tuple(r)[1:5] for r in chat.op1_chat_format(spark, sf).collect()} == expected(rows)
