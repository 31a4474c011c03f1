import sys
from pathlib import Path

from hypothesis import given
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
from helpers import empty, odd  # noqa: E402

from spanquarry.llm import chat  # noqa: E402

TEXT = st.lists(st.sampled_from([*"<|\\ab>_\n", "<|im_end|>", "<|im_start|>", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_render_is_reversible(messages):
    text, spans = chat.render(messages, tuple(r for r, _ in messages))
    assert chat.parse(text) == messages
    assert [chat.unguard(text[a:b]) for a, b in spans] == [t for _, t in messages]


def test_fold_deltas_edits_and_regenerations(spark):
    log = [(1, 1, "start", 0, "user", "hi"), (1, 2, "start", 1, "assistant", ""), (1, 3, "delta", 1, None, "he"), (1, 4, "delta", 1, None, "llo"), (1, 5, "start", 2, "user", "more"), (1, 6, "edit", 0, None, "hi!"), (1, 7, "regenerate", 1, None, None), (1, 8, "delta", 1, None, "new"), (None, 1, "delta", None, "user", None), (2, 1, "start", 0, "user", "x"), (2, 2, "delete", 0, None, None)]
    events = spark.createDataFrame(log[::-1], chat.EVENTS)
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(events).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "new")], None: [("user", "")], 2: []}
    assert chat.format_chats(events.limit(0)).count() == 0


def test_long_and_repeated_turns_come_back(spark):
    turns = [(1, 0, "user", "a" * 3000 + "<|x"), (1, 0, "user", "a" * 3000 + "<|x"), (1, None, None, None), (None, 1, "assistant", "é" * 1500)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(chat.as_events(rows)).collect()}
    assert got == {1: [("", ""), ("user", turns[0][3]), ("user", turns[0][3])], None: [("assistant", "é" * 1500)]}


def test_pipeline_stages_take_effect_and_survive_odd_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.count()
        assert k == 4 or sorted(docs.columns) == sorted(columns)
    assert seen["language_id"] >= seen["near_duplicates"] >= seen["decontamination"] > 0 and docs.agg({"slot": "max"}).first()[0] == seen["token_ids"] - 1
    for frame in (odd(spark), empty(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, sf)
            assert out.count() >= 0 and (k == 4 or sorted(out.columns) == sorted(frame.columns))
