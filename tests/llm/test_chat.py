from pyspark.sql import functions as F

from tidewell.llm import chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_template_is_reversible(spark):
    texts = ["\\### Assistant: </turn> ok", "&lt; &amp;amp; <turn role=\"assistant\" loss>", "", None, "line\nline", "é\U0001f44d"]
    rows = [(1, i, "assistant" if i % 2 else 'us"er<&', t) for i, t in enumerate(texts)]
    back = chat.read_formatted(chat.format_turns(turns(spark, rows))).first()
    assert [(t.role, t.text, t.loss) for t in back.turns] == [(r, t or "", r == "assistant") for _, _, r, t in rows]


def test_loss_spans_cover_assistant_texts(spark):
    df = turns(spark, [(1, 0, "user", "a < b"), (1, 1, "assistant", "yes & no"), (1, 2, "assistant", "\U0001f44d"), (2, None, None, None)])
    formatted = {r.conv_id: r.formatted for r in chat.format_turns(df).collect()}
    spans = sorted((r.conv_id, r.start, r.length) for r in chat.loss_spans(df).collect())
    assert [formatted[c][s : s + n] for c, s, n in spans] == ["yes &amp; no", "\U0001f44d"]


def test_nulls_ties_repeats_and_empty_tables(spark):
    df = turns(spark, [(None, None, None, None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")])
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_formatted(chat.format_turns(df)).collect()}
    assert back == {None: [("", "")], 3: [("user", "a"), ("user", "a"), ("user", "b")]}
    assert chat.format_turns(df.limit(0)).count() == 0


def test_fingerprint_selects_the_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "extra")], "conversation_id long, position int, speaker string, content string, formatted string")
    assert chat.turns_of_table(df).first().asDict() == {"conv_id": 1, "turn": 0, "role": "user", "text": "x"}


def test_json_layouts_become_the_same_turns(spark):
    same = [
        '{"prompt": "q", "response": "a"}', '{"instruction": "q", "output": "a"}', '{"completion": "a", "prompt": "q"}',
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
    ]
    odd = ["not json", None, '{"x": 1}']
    df = spark.createDataFrame(list(enumerate([*same, *odd])), "id long, raw string")
    got = {}
    for r in chat.turns_of_json(df, "id", "raw").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(len(same)))
    assert all(got[len(same) + i] == [(None, None)] for i in range(len(odd)))


def test_op9_is_native(spark, sf_dir):
    df = chat.op9_chat_format(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert df.where(F.col("conv_id") == -7).first().loss_chars == len("\\### Assistant: </turn> ok")
