import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from stowage.llm import chat

TEXT = st.text(st.sampled_from("a#\\</turn>\n|: é🎉"), max_size=40)


@given(TEXT)
def test_escaping_is_reversible_and_hides_controls(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and chat.unescape(chat.escape_role(text)) == text


@given(st.text(st.sampled_from("ab:#\\\n</turn>"), max_size=12), st.lists(st.one_of(TEXT, st.sampled_from(["### user:\n", "</turn>\n", "\\### Assistant: </turn> ok"])), max_size=3))
def test_turns_parse_back(role, texts):
    formatted, start, end, _, _ = chat.format_turn(role, [{"type": "text", "text": t} for t in texts], chat.TokenCosts())
    assert chat.parse_turn(formatted) == (role, "".join(texts))
    assert (start is None) == (role != "assistant")


@pytest.mark.parametrize("n", range(1, 11))
def test_runs_of_number_signs_parse_back(n):
    for text in ("#" * n, "#" * n + " Heading", "a\\" + "#" * n):
        formatted, *_ = chat.format_turn(text, [{"type": "text", "text": text}], chat.TokenCosts())
        assert chat.parse_turn(formatted) == (text, text)


def test_controls_within_a_turn_are_refused():
    for inside in ("###", "a ### b", "</turn>", "\\\\###", "\\a###", "\\####\\\\###"):
        with pytest.raises(ValueError, match="no single turn"):
            chat.parse_turn(f"### user:\n{inside}</turn>\n")


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see <|"}, {"type": "image", "ref": "i.png", "amount": 784.0 * 10}, {"type": None, "text": " and "},
             {"type": "audio", "ref": "a.wav", "amount": 2.0}, {"type": "document", "ref": "d.pdf", "amount": 3.0}, {"type": "image"}]
    formatted, start, end, attached, tokens = chat.format_turn("assistant", parts, chat.TokenCosts())
    content = formatted[start:end]
    assert content == "see \\<|<|image:0|> and <|audio:1|><|document:2|><|image:3|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "i.png", 10), ("audio", "a.wav", 50), ("document", "d.pdf", 3072), ("image", None, 4)]
    assert all(content[a["place"] :].startswith(f"<|{a['kind']}:{i}|>") for i, a in enumerate(attached)) and tokens == 3136


def brute(rows):
    out = {}
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(conv_id, []).append((role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = []
    for conv_id, turns in out.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        found.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)))
    return sorted(found, key=repr)


def test_conversations(spark):
    rows = [(i, t, "assistant" if t % 2 else "user", f"text {i} é \\ ### {t}") for i in range(30) for t in range(4)]
    rows += [(99, t, "assistant" if t % 2 else "user", f"{t} </turn>\n") for t in range(2000)]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (50, 1, None, None), (51, None, "assistant", ""),
             (None, 1, "user", "a"), (None, 2, "assistant", "b" * 200_000), (52, 1, "x:\ny", "c")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    formatted = chat.format_turns(chat.text_parts(turns))
    found = chat.conversation_digests(formatted).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute(rows)
    total = formatted.selectExpr("sum(length(formatted))").first()[0]
    assert sum(r.formatted_chars for r in found) == total


def test_ties_and_empty(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a")]
    one, other = (chat.conversation_digests(chat.format_turns(chat.text_parts(spark.createDataFrame(r, schema)))).collect() for r in (rows, rows[::-1]))
    assert one == other and one[0].n_turns == 3
    assert chat.conversation_digests(chat.format_turns(chat.text_parts(spark.createDataFrame([], schema)))).count() == 0


def test_unknown_part(spark):
    turns = spark.sql("SELECT 1L AS conv_id, 1L AS turn, 'user' AS role, array(named_struct('type', 'hologram', 'text', 'x', 'ref', 'r', 'amount', 1.0D)) AS parts")
    with pytest.raises(PySparkException, match="hologram"):
        chat.format_turns(turns).collect()
