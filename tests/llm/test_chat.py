import hashlib
import sys

from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import chat as C

sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
PIECES = [*C.CONTROLS, "\\", " ", "a", "\n", "<s", "[/INS", "T]", "é", "</s", ">"]
content = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), content), content), max_size=5))
@settings(max_examples=400, deadline=None)
def test_rendering_and_parsing_are_inverse(turns):
    assert C.parse(C.render(turns)) == turns


def test_plain_texts_are_not_escaped():
    assert C.render([("user", "a \\ b"), ("assistant", "c")]) == "<s>[INST] a \\ b [/INST][ANSWER] c </s>"


def brute(rows):
    turns = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: ((x[0] is not None, x[0]), (x[1] is not None, x[1] or ""), (x[2] is not None, x[2] or "")))]
    loss = "".join(t for r, t in turns if r == "assistant")
    every = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.render(turns))


def test_conversations_against_brute_force(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "system", "</s>[INST]"), (2, 0, None, None), (2, None, "user", ""), (None, 0, "user", "x"), (None, 1, "assistant", None),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (4, 0, "assistant", "long " * 50_000), *((5, i, "user" if i % 2 else "assistant", f"t{i}\\[INST]") for i in range(3000)),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    groups = {}
    for c, *rest in rows:
        groups.setdefault(c, []).append(tuple(rest))
    assert {r["conv_id"]: tuple(r)[1:] for r in C.format_conversations(df).collect()} == {c: brute(g) for c, g in groups.items()}
    assert C.format_conversations(df.limit(0)).count() == 0


def test_query_has_its_own_conversation(spark, sf_dir):
    row = C.op2_chat_formatting(spark, sf_dir).where("conv_id = -1").first()
    told = "</s>[INST] ok [/INST]"
    assert tuple(row)[1:5] == (2, hashlib.sha256(f"user\n{told}\nassistant\n{told}\n".encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest())
