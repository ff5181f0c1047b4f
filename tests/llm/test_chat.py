import hashlib

import duckdb
import pytest
from fixtures import TALK, TALK_DDL
from hypothesis import given, settings
from hypothesis import strategies as st
from sievetext.llm import chat

PARTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é"]), max_size=12)


@settings(max_examples=500, deadline=None)
@given(PARTS.map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<s>", "[INST]"]), PARTS.map("".join)), max_size=6))
def test_turns_are_read_back(turns):
    render = chat.compile_template(chat.TEMPLATE)
    text, spans = render([{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_language():
    run = chat.compile_template(
        "{% for m in turns %}{% if m.role == 'a' and not m.text == '' %}A{{ m.text | trim | upper }}"
        "{% elif m.role != 'b' or false %}C{% else %}{{ 'x' + 1 + \"y\" | upper }}{% endif %};{% endfor %}")
    turns = [{"role": "a", "text": " q "}, {"role": "b", "text": ""}, {"role": "z", "text": ""}]
    assert run(turns)[0] == "AQ;x1Y;C;"


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ turns }}{% endif %}{{ '' }}"))
    assert tree == (chat.Output(chat.Const("abcd")),)
    body = chat.fold(chat.parse(chat.TEMPLATE))[0].body
    assert body[0] == chat.Output(chat.Const("<s>[INST]"))


@pytest.mark.parametrize("bad", [
    "{{ turns.__class__ }}", "{{ open('x') }}", "{{ x | eval }}", "{% import os %}", "{% for x in turns %}",
    "{{ 1 + }}", "{% if %}a{% endif %}", "{{ (a }}", "{{ a", "{% endfor %}", "{{ turn.role.format }}", "{{ a[0] }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def brute(rows):
    out = {}
    every = [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in every}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in every if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(),
                     sum(len(chat.escape(r)) + len(chat.escape(x)) + 20 for *_, r, x in turns))
    return out


def test_digests(spark):
    rows = chat.chat_digest(spark.createDataFrame(TALK, TALK_DDL)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == brute(TALK) and len(rows) == len(brute(TALK))


def test_long_conversations_have_parts(spark):
    talk = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <s> " * 20) for i in range(40)] + TALK
    df = spark.createDataFrame(talk, TALK_DDL)
    parts = chat.format_conversations(df, part_chars=1000).where("conv_id = 1").orderBy("part").collect()
    assert len(parts) > 3 and [p.part for p in parts] == list(range(len(parts)))
    turns = [t for p in parts for t in chat.read_turns(p.formatted)]
    got = sorted(x for c, _, _, x in talk if c == 1 and x)
    assert sorted(t[1] for t in turns) == got


def test_sql(spark):
    talk = [r for r in TALK if r[0] is not None and r[1] is not None]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", talk)
    want = {r[0]: r[1:] for r in con.execute(chat.ORACLE_SQL).fetchall()}
    got = {r.conv_id: tuple(r)[1:] for r in chat.chat_digest(spark.createDataFrame(talk, TALK_DDL)).collect()}
    assert got == want
