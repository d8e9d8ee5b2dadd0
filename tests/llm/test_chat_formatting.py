import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from postlens.llm import chat_formatting as chat
from postlens.llm.queries import ORACLES, QUERIES
from tools.check import TABLES, canon


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*columns).collect())
    cur = con.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == columns
    assert got == sorted(tuple(canon(r[have.index(c)]) for c in columns) for r in cur.fetchall())


CASES = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 3, "meta": {"x": [1]}}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q", "weight": 1}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "t"}]}, "from_value", [("user", "q"), ("assistant", "r"), ("tool", "t")]),
    ({"turns": [{"speaker": "user", "text": "q"}]}, "speaker_text", [("user", "q")]),
    ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r", "system": "s"}, "prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o", "source": "web"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": None, "system": None, "output": None}, "instruction", [("user", "i"), ("assistant", "")]),
    ({"question": "q", "answer": 42}, "question_answer", [("user", "q"), ("assistant", "42")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "prompt": "x", "input": 1}, "from_value", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"messages": [{"role": "user", "content": "q"}], "prompt": "p", "response": "r", "instruction": "i"}, "messages", [("user", "q")]),
    ({"system": None, "turns": [{"speaker": "user", "text": "q"}]}, "speaker_text", [("user", "q")]),
    ({"system": "s", "messages": []}, "messages", [("system", "s")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}, {"type": "text", "text": "b"}]}]}, "messages", [("user", "a\n\nb")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": "[{\"text\": \"r\"}]"}]}, "messages", [("user", "a"), ("assistant", "[{\"text\": \"r\"}]")]),
    ({"messages": [{"role": "user", "content": []}, {"role": "assistant", "content": ["r", "t"]}], "system": "s"}, "messages", [("system", "s"), ("user", ""), ("assistant", "r\n\nt")]),
    ({"messages": [{"role": "user", "content": "a"}], "conversations": [{"from": "human", "value": "q"}]}, None, None),
    ({"question": "q"}, None, None), ({"data": {"prompt": "p", "response": "r"}}, None, None), ({}, None, None), (None, None, None), ("no json", None, None),
]


def test_layouts(spark):
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x), "kept") for i, (x, _, _) in enumerate(CASES)]
    records = spark.createDataFrame(rows, "id long, record string, turns string")
    for r in chat.canonical_turns(records).collect():
        _, layout, turns = CASES[r.id]
        assert (r.layout, r.turns if r.turns is None else [tuple(t) for t in r.turns]) == (layout, turns), CASES[r.id]


def test_paths_and_fingerprints_ignore_order_and_other_fields(spark):
    a, b, c = '{"b": {"c d": [{"x": 1}, {"y": {}}]}, "a": [[1, 2]]}', '{"response": 1, "prompt": "x", "z": []}', '{"prompt": null, "response": "y"}'
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
    row = df.select(chat.field_paths(F.parse_json("a")).alias("p"), chat.fingerprint(F.parse_json("b")).alias("f"), chat.fingerprint(F.parse_json("c")).alias("g")).first()
    assert sorted(row.p) == ["a[][]", "b.c d[].x", "b.c d[].y"]
    assert row.f == row.g == hashlib.sha256(b"prompt|response").hexdigest()


TEXTS = [chat.PROBE, "", "\n", "</turn>", "\\</turn>\n", "\\\\<turn user>\n\n</turn>\n", "ends in \\", "a\n</turn>\n<turn assistant>\nb", "é🙂\r\n", "<tur", "\\" * 2000 + "</turn", "x" * 200_000]


def test_round_trip(spark):
    roles = ["user", "assistant", "odd role>\n</turn>\n", "", "a+b%20"]
    turns = [{"role": roles[i % 5], "content": t} for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame([(1, json.dumps({"messages": turns})), (2, '{"messages": []}')], "id long, record string")
    done = chat.format_turns(chat.canonical_turns(df))
    back, learned = chat.read_back(F.col("formatted"), F.col("loss_spans"))
    one, two = done.select("id", back.alias("b"), learned.alias("l"), "formatted").orderBy("id").collect()
    assert [tuple(t) for t in one.b] == [(t["role"], t["content"]) for t in turns]
    assert one.l == "".join(t["content"] for t in turns if t["role"] == "assistant")
    assert (two.b, two.l, two.formatted) == ([], "", "")


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "system", "first"), (None, 0, "user", "n"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("record", "layout", "turns", "t", "ts")})
    got = {r.conv_id: r for r in chat.formatted_conversations(df).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None, -7}
    assert got[1].turns_sha256 == digest(("user", ""), ("", "x")) and got[1].loss_chars == 0
    assert got[2].turns_sha256 == digest(("system", "first"), ("user", "a"), ("user", "a"))
    assert got[3].turns_sha256 == digest(("user", "a"), ("assistant", "b")) and got[3].layout == "prompt_response" and got[2].layout == "from_value"
    assert got[4].layout == "instruction" and got[4].loss_sha256 == hashlib.sha256(b"</turn>").hexdigest()
    assert got[-7].turns_sha256 == digest(("user", chat.PROBE), ("assistant", chat.PROBE)) and got[-7].loss_chars == len(chat.PROBE)
    only = chat.formatted_conversations(df.limit(0)).collect()
    assert [r.conv_id for r in only] == [-7]
