import random

from cutplan.llm import chat

PIECES = ["[INST]", "[/INST]", "</s>", "<s>", "[SEP]", "[ROLE]", "[BODY]", "[/ROLE]", "\\", "[", "<", "]", "/", "\n", "é", " ", "ok", "[\\INST]", "<\\\\/s>"]


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(7)))
            rows.append((c, t, rng.choice(["user", "user", "assistant", "assistant", "system", "[ROLE]x", ""]), text))
    return rows


def test_round_trip_of_any_text(spark):
    rows = conversations(1) + [(900, 0, None, None), (901, None, "user", "a"), (901, 0, "user", "b"), (901, 0, "user", "a"), (901, 0, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(frame)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in read[c].turns] == [x[1:] for x in turns]
        assert read[c].loss == "".join(x[2] for x in turns if x[1] == "assistant")


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "system", "d")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chats(frame).first().formatted == "[INST]a[SEP]b[/INST]c</s>[ROLE]system[BODY]d[/ROLE]"


def test_added_conversation_null_ids_and_empty_table(spark):
    rows = [(None, 0, "user", "x", 1), (None, 1, "assistant", "y", 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks int")
    got = {r.conv_id: r for r in chat.digest(frame).collect()}
    assert got[None].n_turns == 2 and got[-1].n_turns == 2 and got[-1].loss_chars == len("</s>[INST] ok [/INST]")
    assert chat.digest(frame.limit(0)).count() == 1


def test_long_conversation(spark):
    roles = ["user", "user", "assistant", "system", "assistant"]
    rows = [(1, i, roles[i % 5], f"t{i}") for i in range(20_000)]
    got = chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).first()
    assert [(t.role, t.text) for t in got.turns] == [(r[2], r[3]) for r in rows]
