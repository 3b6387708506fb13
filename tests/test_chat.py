from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldmill.functions.chat import (
    EOS_ID,
    IGNORE_INDEX,
    PAD_ID,
    build_messages,
    pad_id,
    render_chat,
    tokenize,
    tokenize_with,
)
from fieldmill.operators.batching import (
    assign_batches,
    concat_ragged,
    encode,
    pad_batches,
    prompt_len_lookup,
    prompt_lengths,
    ragged_offsets,
    supervision_report,
)

INSTRUCTION = "extract fields"


def samples(spark, *answers):
    return spark.createDataFrame([(i, 2, 2, a) for i, a in enumerate(answers)], "index long, width int, height int, target_json string")


def test_only_the_answer_is_supervised(spark):
    for answer, learned in (('{"a":"1"}', 1), ("b c d e", 4), ("", 0)):
        row = encode(samples(spark, answer), INSTRUCTION, max_len=128).first()
        supervised = [(x, y) for x, y in zip(row.input_ids, row.labels) if y != IGNORE_INDEX]
        assert len(supervised) == learned and all(x == y for x, y in supervised)
        assert row.labels[0] == IGNORE_INDEX
        assert row.input_ids[:4] == [900, 901, 902, 903] and row.mm_token_type_ids[:5] == [1, 1, 1, 1, 0]
        assert len(row.labels) == len(row.attention_mask) == len(row.mm_token_type_ids) == len(row.input_ids)
        assert set(row.attention_mask) == {1}


def test_prompt_is_a_prefix_and_cut_with_the_row(spark):
    messages = build_messages(INSTRUCTION, F.lit("answer"))
    df = spark.range(1).select(
        render_chat(messages).alias("full"),
        render_chat(build_messages(INSTRUCTION), add_generation_prompt=True).alias("prompt"),
        build_messages(INSTRUCTION, F.lit(None).cast("string")).alias("open"),
    )
    row = df.first()
    assert row.full == "<img> extract fields ASSISTANT: answer"
    assert row.full.startswith(row.prompt) and row.prompt == "<img> extract fields ASSISTANT:"
    assert len(row.open) == 1
    cut = encode(samples(spark, "a b c"), INSTRUCTION, max_len=5).first()
    assert len(cut.input_ids) == 5 and cut.prompt_len == 5 and set(cut.labels) == {IGNORE_INDEX}


def test_tokens_split_at_any_blank(spark):
    text = "a　b <img>\x1cc  \n"
    ids = spark.range(1).select(tokenize(F.lit(text), image_tokens=2)).first()[0]
    assert [t.kind for t in ids] == [0, 0, 1, 1, 0] and len(text.split()) == 4


def test_lookup_gives_the_same_rows(spark):
    rows = samples(spark, '{"a":"1"}', '{"b":"2 3"}', "x y z")
    direct = encode(rows, INSTRUCTION)
    known = prompt_len_lookup(rows, ["width", "height"], prompt_lengths(INSTRUCTION, max_len=2048))
    looked_up = encode(known, INSTRUCTION, prompt_len="prompt_len")
    cols = ["index", "input_ids", "labels", "mm_token_type_ids"]
    assert sorted(map(tuple, direct.select(cols).collect())) == sorted(map(tuple, looked_up.select(cols).collect()))


def test_padding(spark):
    batched = assign_batches(encode(samples(spark, "a", "b c d e", "f g"), INSTRUCTION), 2)
    for side in ("right", "left"):
        rows = pad_batches(batched, side).orderBy("index").collect()
        assert [r.batch for r in rows] == [0, 0, 1]
        assert len(rows[0].input_ids) == len(rows[1].input_ids) == 11 and len(rows[2].input_ids) == 9
        r = rows[0]
        at = [i for i, x in enumerate(r.input_ids) if x == PAD_ID]
        assert at == ([8, 9, 10] if side == "right" else [0, 1, 2])
        assert all(r.labels[i] == IGNORE_INDEX and r.attention_mask[i] == 0 and r.mm_token_type_ids[i] == 0 for i in at)
        assert sum(r.attention_mask) == 8
    with pytest.raises(ValueError):
        pad_batches(batched, "middle")


def test_ragged(spark):
    data = [(0, [[1.0], [2.0]]), (1, [[3.0]]), (2, []), (3, [[4.0]])]
    df = assign_batches(spark.createDataFrame(data, "index long, rows array<array<float>>"), 3)
    got = {r.batch: (r.rows, r.offsets) for r in concat_ragged(df, "rows").collect()}
    assert got == {0: ([[1.0], [2.0], [3.0]], [0, 2, 3]), 1: ([[4.0]], [0])}
    offsets = ragged_offsets(df, F.size("rows")).orderBy("index").collect()
    assert [r.offset for r in offsets] == [0, 2, 3, 0]


def test_supervision_report(spark):
    rows = encode(samples(spark, "a", "b c d e", ""), INSTRUCTION, max_len=8)
    r = supervision_report(rows, 8).first()
    assert (r.rows, r.tokens, r.supervised_tokens, r.truncated_rows, r.empty_rows) == (3, 23, 2, 1, 1)


def test_external_tokenizer(spark):
    def make():
        return lambda text: [ord(c) for c in text.strip()]

    rows = samples(spark, "ab", "c")
    encoded = encode(rows, "q", tokenizer=lambda t, n: tokenize_with(t, make, n)).orderBy("index").collect()
    first = encoded[0]
    assert first.input_ids[:4] == [900, 901, 902, 903] and first.mm_token_type_ids[:5] == [1, 1, 1, 1, 0]
    assert "".join(map(chr, first.input_ids[4:])) == "q ASSISTANT: ab"
    assert first.prompt_len == 4 + len("q ASSISTANT:")


def test_pad_id(spark):
    row = spark.range(1).select(pad_id(F.lit(0), F.lit(EOS_ID)), pad_id(F.lit(None).cast("int"), F.lit(EOS_ID)), pad_id(None, F.lit(EOS_ID)))
    assert tuple(row.first()) == (0, 2, 2)
