import hashlib
import random
import re

from labelweave.llm.chat import TEMPLATE, format_chats, op6_chat, read_back

SCHEMA = "conv_id bigint, turn bigint, role string, text string, loss int, fault string"


def plain(rows):
    """{conv_id: (turns, digest, loss characters, loss digest)} from the rows themselves."""
    out = {}
    key = lambda x: (x is not None, x if x is not None else "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: tuple(map(key, r[1:4])))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out[c] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op6_chat(spark, small).collect()}
    assert found == plain(rows)


def test_escaping_is_reversible_and_leaves_no_control():
    rng = random.Random(4)
    bits = [*TEMPLATE.controls, "\\", "[", "/", "INST]", "<", "s>", " ", "\n", "é", "<<", "SYS", ">>"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        safe = TEMPLATE.escape(text)
        assert TEMPLATE.unescape(safe) == text and not any(c in safe for c in TEMPLATE.controls)


def test_odd_conversations(spark):
    rng = random.Random(8)
    roles, bits = ["user", "assistant", "system", "tool", None, "", "[ROLE] x [/ROLE]", "a\\b"], [*TEMPLATE.controls, "\\", " ", "\n", "ok", "é"]
    rows = [(rng.choice([*range(12), None]), rng.choice([*range(4), None]), rng.choice(roles), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(6))]), 1, "x") for _ in range(300)]
    rows += rows[:20] + [(99, k, "user" if k % 2 == 0 else "assistant", f"turn {k}", 0, "") for k in range(25_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in found.items()} == plain(rows)
    assert found[99].faults == 0 and found[99].complete
    assert read_back(format_chats(df.limit(0))).count() == 0


def test_order_and_text(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 0, "system", "be"), (2, 0, "assistant", "x"), (2, 1, "user", "y"), (2, 2, "user", "z")]
    segments = format_chats(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA))
    found = segments.collect()
    text = {c: "".join(s.text for s in found if s.conv_id == c) for c in (1, 2)}
    assert text == {1: "<s><<SYS>>\nbe\n<</SYS>>\n\n[INST] hi [/INST] yo </s>", 2: "<s> x </s>[INST] y [/INST][INST] z [/INST]"}
    assert [s.text for s in found if s.loss] == ["yo", "x"] or [s.text for s in found if s.loss] == ["x", "yo"]
    assert {s.fault for s in found if s.fault} == {"assistant after start", "user after user"}
    back = {r.conv_id: r for r in read_back(segments).collect()}
    assert (back[1].faults, back[1].complete, back[2].faults, back[2].complete) == (0, True, 2, False)
    assert back[1].formatted_chars == len(text[1]) and re.match("<s>", text[2])
