import hashlib
import json
import random

from pyspark.sql import functions as F

from aerolith.llm import chat_format as C


def records(spark, rows):
    df = spark.createDataFrame(rows, "id long, part long, json string")
    return df.select("id", "part", F.parse_json("json").alias("record"))


def test_layouts(spark):
    rows = [
        (1, 0, json.dumps({"messages": [{"role": "system", "content": "s"}, {"content": "q", "role": "user"}]})),
        (2, 0, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (3, 0, json.dumps({"prompt": "q", "response": "a"})),
        (4, 0, json.dumps({"instruction": "do", "input": "this", "output": "done"})),
        (5, 0, json.dumps({"instruction": "do", "input": "", "output": "done", "system": "s"})),
        (6, 0, json.dumps({"role": "user", "text": None})),
        (7, 0, json.dumps({"unknown": {"layout": 1}})),
        (8, 0, None),
        (9, 0, json.dumps({"prompt": "q", "completion": "a"})),
        (10, 0, json.dumps({"instruction": "do", "output": 5})),
    ]
    got = {r["id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in C.canonical_turns(records(spark, rows)).collect()}
    assert got == {
        1: [("system", "s"), ("user", "q")],
        2: [("user", "q"), ("assistant", "a")],
        3: [("user", "q"), ("assistant", "a")],
        4: [("user", "do\n\nthis"), ("assistant", "done")],
        5: [("system", "s"), ("user", "do"), ("assistant", "done")],
        6: [("user", "")],
        7: None,
        8: None,
        9: [("user", "q"), ("assistant", "a")],
        10: [("user", "do"), ("assistant", "5")],
    }


def test_layout_is_the_hash_of_all_paths(spark):
    rows = [(1, 0, '{"prompt": "q", "response": "a", "extra": 1}'), (2, 0, '{"response": 2, "prompt": 1.5}')]
    got = {r["id"]: r["turns"] for r in C.canonical_turns(records(spark, rows)).collect()}
    assert got[1] is None and got[2] is not None
    kind = spark.createDataFrame([], "a struct<c:int,b:array<struct<d:string>>>, e string").schema
    assert C.paths_of(kind) == ("a.b[].d", "a.c", "e")


def test_read_back_is_what_was_written(spark):
    rng = random.Random(4)
    bits = [*C.CONTROL, "<", "[", "\\", "|im_end|>", "s>", "INST]", "\n", "ü", "😀", " ", "x", "<\\s>", "<|im_end|>\n"]
    rows, want = [], {}
    for i in range(300):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 3))), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(rng.randint(1, 4))]
        if i % 3:
            turns = [(rng.choice(("user", "assistant")), c) for _, c in turns]
        want[i] = turns
        rows += [(i, k, r, t) for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    chats = C.formatted(C.canonical_turns(C.chat_rows(table)))
    for r in C.parsed(chats).collect():
        assert [tuple(t) for t in r["turns"]] == want[r["id"]]
        assert r["learned"] == "".join(t for role, t in want[r["id"]] if role == "assistant")
    for r in chats.collect():
        assert r["text"].count(C.START) == len(want[r["id"]])
        spans = [r["text"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        assert len(spans) == sum(role == "assistant" for role, _ in want[r["id"]])
        assert all(r["text"][s["start"] + s["length"] :].startswith(C.END) for s in r["loss"])


def test_odd_rows(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (None, 0, "assistant", "x"), (2, 0, "assistant", "")]
    table = spark.createDataFrame([(*r, 9, 9) for r in rows], "conv_id long, turn int, role string, text string, id int, part int")
    got = {r["conv_id"]: r for r in C.digests(C.formatted(C.canonical_turns(C.chat_rows(table)))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\na\n\n\n\n\n").hexdigest()
    assert got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0
    assert C.formatted(C.canonical_turns(C.chat_rows(table.limit(0)))).count() == 0
    none = C.formatted(C.canonical_turns(records(spark, [(5, 0, '{"x": 1}')]))).collect()
    assert [(r["id"], r["text"], r["loss"]) for r in none] == [(5, "", [])]
