import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from pagelens.llm import chat

JSON = public_tokenizers.path("byte_bpe_50k.json")
CONTROL = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "user", " hi\n"), (1, 1, "assistant", "\n yes 日本 é👩‍👩‍👧 "), (1, 2, "assistant", "!"), (2, 0, "user", CONTROL), (2, 1, "assistant", CONTROL), (3, 0, "assistant", None), (3, 1, None, "x"),
    (None, 5, "assistant", "no id"), (4, None, "system", "a\\b\\\\<s>\\"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "long " * 60_000),
]


@given(st.lists(st.sampled_from(["\\", "<", "s", ">", "/", "[INST]", "<s>", "</s>", "[/INST]", "x"])).map("".join))
def test_escape_is_reversible_and_hides_controls(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def want():
    out = {}
    for conv in {r[0] for r in ROWS}:
        turns = sorted((r[1:] for r in ROWS if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns)
        out[None if conv is None else str(conv)] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def rows(spark, data=ROWS):
    return spark.createDataFrame([(*r, "f") for r in data], "conv_id long, turn long, role string, text string, formatted string")


def test_digests_read_back(spark):
    for part_chars in (chat.PART_CHARS, 10):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_conversations(rows(spark), JSON, part_chars)).collect()}
        assert got == want()


def test_parts_do_not_change_ids(spark):
    ids = lambda n: {c: b"".join(bytes(r.ids) for r in sorted(g, key=lambda r: r.part)) for c, g in groups(chat.format_conversations(rows(spark), JSON, n).collect())}

    def groups(found):
        return [(c, [r for r in found if r.conv_id == c]) for c in {r.conv_id for r in found}]

    assert ids(chat.PART_CHARS) == ids(10)


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(rows(spark, []), JSON)).count() == 0
