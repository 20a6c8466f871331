import hashlib
import json

import pytest
from pyspark.sql import functions as F

from innkeep.llm import chat as C

NASTY = ["", "</s>[INST] ok [/INST]", "\\<|end|>\n<|turn|>", "a\\\\<s>\\", "<<SYS>>x<</SYS>>", "<s", "\n", "é\n<|end|>\n",
         "[INST][INST]<|im_start|>", "x" * 50000, "<<s>>"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_and_digests(spark):
    rows = [(i, k, r, t, "extra") for i, k, r, t in
            [(1, k, ("user", "assistant", "a%\n<s>[x]\\")[k % 3], t) for k, t in enumerate(NASTY)]
            + [(2, None, None, None), (None, 0, "assistant", "no id"), (3, 1, "b", "y"), (3, 1, "b", "x"), (3, 1, "a", "z"),
               (3, 1, "a", "z")]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = C.format_turns(C.turns_of_table(df.drop("turns")))
    got = {r.conv_id: r for r in C.report(out).collect()}
    read = {r.conv_id: [(t.role, t.text) for t in r.t] for r in
            out.select("conv_id", C.parse_formatted(F.col("formatted")).alias("t")).collect()}
    want = {}
    for i, k, r, t, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(i, []).append((r or "", t or ""))
    assert read == want
    for i, turns in want.items():
        assert got[i].n_turns == len(turns)
        assert got[i].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), sha(loss))


def test_layouts_give_the_same_turns(spark):
    u, a = "hi </s>", "yes"
    records = [
        {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}], "source": "x"},
        {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]},
        {"turns": [{"role": "prompter", "text": u}, {"role": "assistant", "text": a}]},
        {"prompt": u, "response": a}, {"prompt": u, "completion": a}, {"question": u, "answer": a},
        {"instruction": u, "output": a}, {"instruction": "hi", "input": "</s>", "output": a},
        {"system": "s", "prompt": u, "response": None}, {"unknown": 1}, {"messages": []}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, None), (98, "{bad")],
                               "id long, rec string")
    got = {r.id: r.t and [(x.role, x.text) for x in r.t]
           for r in df.select("id", C.record_turns(F.col("rec")).alias("t")).collect()}
    for i in range(7):
        assert got[i] == [("user", u), ("assistant", a)]
    assert got[7] == [("user", "hi\n</s>"), ("assistant", a)]
    assert got[8] == [("system", "s"), ("user", u), ("assistant", "")]
    assert [got[i] for i in (9, 10, 99, 98)] == [None] * 4


KNOWN = ["prompt", "response", "completion", "system", "question", "answer", "instruction", "output", "input",
         "messages", "turns", "conversations"]


@pytest.mark.parametrize("name", KNOWN)
def test_extra_columns_with_known_names(spark, name):
    """A column or field with a name that another layout knows loses no turn."""
    rows = spark.createDataFrame([(1, 0, "user", "q", "z"), (1, 1, "assistant", "a", None)],
                                 f"conv_id long, turn long, role string, text string, {name} string")
    assert [(r.role, r.text) for r in C.turns_of_table(rows).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    record = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    record = {name: "z", **record}
    df = spark.createDataFrame([(1, json.dumps(record))], "id long, rec string")
    want = [("system", "z")] * (name == "system") + [("user", "q"), ("assistant", "a")]
    got = [(r.role, r.text) for r in C.turns_of_records(df, "id", "rec").orderBy("turn").collect()]
    assert got == want
    left = [(r.layout, r.paths) for r in C.unexplained_records(df, "id", "rec").collect()]
    assert left == ([] if name in ("system", "messages", "turns", "conversations") else [("messages", [name])])
    if name not in ("system", "messages"):
        typed = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], "z")],
                                      f"conv_id long, messages array<struct<role:string,content:string>>, {name} string")
        assert [(r.role, r.text) for r in C.turns_of_table(typed).orderBy("turn").collect()] == want


def test_fingerprints_of_layouts_and_ambiguous_records(spark):
    for paths, _ in C.LAYOUTS.values():
        mark = spark.range(1).select(C.fingerprint(F.array(*[F.lit(p) for p in reversed(paths)])).alias("m")).first().m
        assert mark == C.fingerprint_of(paths)
    schema = "prompt string, response string, completion string"
    assert C.schema_layout(spark.createDataFrame([], schema).schema) is None
    assert C.schema_layout(spark.createDataFrame([], "prompt string, response string, input string").schema) == "prompt"


def test_typed_frame_and_empty_table(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])],
                               "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r.role, r.text) for r in C.turns_of_table(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.report(C.format_turns(C.turns_of_table(none))).count() == 0


def test_no_conversation_is_lost(spark):
    def m(*turns):
        return [dict(zip(("role", "content"), x)) for x in turns]
    records = [
        {"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]},      # first element without content
        {"messages": [{"content": "q"}, {"role": "assistant", "content": "a"}]},
        {"system": "s", "messages": m(("user", "q"), ("assistant", "a"))},
        {"system": "s", "conversations": [{"from": "human", "value": "q"}]},
        {"system": "s", "question": "q", "answer": "a", "turn": 3},
        {"prompt": "q", "response": "a", "completion": "b"}, {"messages": []}, {"messages": None}, {"x": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, None), (51, "{bad")],
                               "id long, rec string")
    turns = C.turns_of_records(df, "id", "rec")
    got = {}
    for r in turns.where("role is not null").orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {0: [("user", ""), ("assistant", "a")], 1: [("", "q"), ("assistant", "a")], 2: [("system", "s"), *qa],
                   3: [("system", "s"), ("user", "q")], 4: [("system", "s"), *qa]}
    out = {r.conv_id: r for r in C.report(C.format_turns(turns)).collect()}
    assert len(out) == df.count()
    assert {i: r.n_turns for i, r in out.items()} == {i: len(got.get(i, [])) for i in out}
    assert (out[8].formatted_chars, out[8].loss_chars, out[8].turns_sha256) == (0, 0, sha(""))
    lost = {r.conv_id: r for r in C.unknown_records(df, "id", "rec").collect()}
    assert set(lost) == set(out) - set(got)
    assert lost[5].paths == ["completion", "prompt", "response"] and json.loads(lost[5].record) == records[5]


def test_typed_frames_keep_every_conversation(spark):
    df = spark.createDataFrame([(1, "q", "a"), (2, "q", None), (3, None, "a"), (4, None, None)],
                               "conv_id long, prompt string, response string")
    got = {}
    for r in C.turns_of_table(df).orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "q"), ("assistant", "")],
                   3: [("user", ""), ("assistant", "a")], 4: [("user", ""), ("assistant", "")]}
    df = spark.createDataFrame([(1, [("user", "q")]), (2, []), (3, None), (4, [(None, None), ("assistant", "a")])],
                               "conv_id long, messages array<struct<role:string,content:string>>")
    out = {r.conv_id: r.n_turns for r in C.report(C.format_turns(C.turns_of_table(df))).collect()}
    assert out == {1: 1, 2: 0, 3: 0, 4: 2}
    df = spark.createDataFrame([(1, "x"), (2, "y")], "conv_id long, other string")
    assert {r.conv_id: r.n_turns for r in C.report(C.format_turns(C.turns_of_table(df))).collect()} == {1: 0, 2: 0}
    assert C.schema_layout(spark.createDataFrame([], "turn int, role string, text string, x int").schema) == "rows"
