from __future__ import annotations

import json
import random

import pytest
import rules
from pyspark.sql import functions as F

from fieldmill.functions.receipt import ANNOTATED_SCHEMA, SYNTHETIC_SCHEMA
from fieldmill.functions.schema import (
    attach_schema_prompt,
    compile_schema,
    schema_prompt,
    schema_prompts,
    schema_rows,
    top_level_keys,
)
from fieldmill.functions.strict_json import extract_json, flatten_fields, parse_json
from fieldmill.functions.tables import register_sql


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def ask(spark, values, column):
    rows = texts(spark, values).select("i", column.alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_extract_json(spark):
    raws = [
        'here is {"a": 1} done', "no json here", "{broken json", '{"a":1} {"b":2}',
        '{"a":1,"a":2}', '{"a":NaN}', "[1]", None, 'x{"b":1,"a":"é"}y', "[{}]", "[1,{}",
    ]
    assert ask(spark, raws, extract_json(F.col("t"))) == [
        '{"a":1}', None, None, None, '{"a":2}', '{"a":NaN}', None, None,
        '{"b":1,"a":"é"}', "{}", "{}",
    ]


def test_flatten_is_a_set_without_positions(spark):
    doc = json.dumps(
        {"menu": [{"n": "A", "p": "1.0"}, {"n": "a ", "p": 1}], "x": None, "t": True, "e": [],
         "g": [[1, 2]], "big": 1e20, "o": {}, "": {"k": "v"}}
    )
    got = ask(spark, [doc], flatten_fields(F.col("t")))[0]
    assert {tuple(p) for p in got} == rules.flat(json.loads(doc))
    assert len(got) == len({tuple(p) for p in got})


def test_canonical_equals_object_equality(spark):
    values = [
        {"a": 1, "b": [1, 2]}, {"b": [1, 2], "a": 1.0}, {"a": True, "b": [1, 2]},
        {"a": 1, "b": [2, 1]}, {"a": "1", "b": [1, 2]}, {"a": 1200}, {"a": "1,200"},
        {"a": 2**53 + 1}, {"a": float(2**53)},
    ]
    keys = ask(spark, [json.dumps(v) for v in values], parse_json(F.col("t"), "canonical")["canonical"])
    for x, kx in zip(values, keys):
        for y, ky in zip(values, keys):
            assert (x == y) == (kx == ky)


def test_odd_texts_do_not_fail_the_job(spark):
    odd = ['{"a":"\\ud800"}', "[" * 100_000, "1" * 5000, '{"a":1e400}', '{"\\ud800":1}', ""]
    got = ask(spark, odd, parse_json(F.col("t"), "canonical", "minified", "pairs", "members"))
    assert [g.valid for g in got] == [True, False, True, True, True, False]
    assert json.loads(got[0].minified) == {"a": "\ud800"}
    assert got[3].pairs[0].value == "inf"


def test_deep_and_wide_texts_are_valid_as_far_as_the_parser_follows(spark):
    deep = ["[" * n + "]" * n for n in (300, 900, 5000, 50_000)]
    nested = '{"a":' * 900 + "1" + "}" * 900
    wide = json.dumps({"m": [{"x": [i]} for i in range(2000)]})
    got = ask(spark, [*deep, nested, wide], parse_json(F.col("t"), "canonical", "minified", "pairs"))
    assert [g.valid for g in got] == [True, True, True, False, True, True]
    assert len(got[5].pairs) == 2000


def test_members_keep_order_and_text(spark):
    got = ask(spark, ['{"b": [1, {"x": null}], "a": "é", "c": 1.50}', "[1]"],
              parse_json(F.col("t"), "members")["members"])
    assert [tuple(m) for m in got[0]] == [("b", '[1,{"x":null}]'), ("a", '"é"'), ("c", "1.5")]
    assert got[1] is None


def test_table_function(spark):
    register_sql(spark)
    texts(spark, ['{"a":{"b":"X "},"c":[1]}', "nope"]).createOrReplaceTempView("docs")
    rows = spark.sql("SELECT d.i, f.* FROM docs d, LATERAL flatten_json(d.t) f").collect()
    assert sorted(map(tuple, rows)) == [(0, "a.b", "x"), (0, "c[]", "1")]
    row = spark.sql("SELECT top_key('menu[].name'), json_block('x {1} y'), json_block('q'), field_f1(1, 1, 1)")
    assert tuple(row.first()) == ("menu", "{1}", None, 0.5)


GOOD = '{"menu":[{"name":"Coke","count":"1","price":"3"}],"subtotal":"3","tax":"0","total":"3"}'
RECEIPTS = [
    (GOOD, True),
    ('{"menu":"not-a-list"}', False),
    ('{"total":3}', False),
    (GOOD.replace('"3"}]', '3}]'), False),
    (GOOD.replace('"tax"', '"vat"'), False),
    (GOOD[:-1] + ',"more":"1"}', False),
    (GOOD.replace("[{", "[7,{"), False),
    ("[]", False),
]


def test_schema_valid(spark):
    column = parse_json(F.col("t"), schema=ANNOTATED_SCHEMA)["schema_valid"]
    assert ask(spark, [t for t, _ in RECEIPTS], column) == [ok for _, ok in RECEIPTS]


def test_no_schema_accepts_what_parses(spark):
    column = parse_json(F.col("t"))["schema_valid"]
    assert ask(spark, ['{"anything":1}', None, "nope"], column) == [True, False, False]


def test_schema_rules():
    date = SYNTHETIC_SCHEMA["properties"]["date"]
    check = compile_schema(date)
    assert check("2026-01-02") and check("2026-01-02\n") and not check("26-1-2") and not check(5)
    assert compile_schema({"type": "integer"})(2.0) and not compile_schema({"type": "number"})(True)
    assert compile_schema({"additionalProperties": {"type": "string"}})({"a": "x"})
    assert not compile_schema({"additionalProperties": {"type": "string"}})({"a": 1})
    for broken in ({"oneOf": []}, {"type": "strang"}, {"properties": {"a": {"format": "x"}}}):
        with pytest.raises(ValueError):
            compile_schema(broken)


def test_schema_prompt(spark):
    text = schema_prompt(ANNOTATED_SCHEMA)
    assert text.splitlines()[1] == "  - menu (array) - line items on the receipt"
    assert schema_prompt(None) == "" and schema_prompt({"type": "object"}) == ""
    assert top_level_keys(ANNOTATED_SCHEMA) == ["menu", "subtotal", "tax", "total"]
    schemas = {"a": ANNOTATED_SCHEMA, "s": SYNTHETIC_SCHEMA}
    rows = spark.createDataFrame(
        schema_rows(schemas) * 2, "domain string, pos int, key string, type string, description string"
    )
    got = {r.domain: r.prompt for r in schema_prompts(rows).collect()}
    assert got == {name: schema_prompt(s) for name, s in schemas.items()}
    df = spark.createDataFrame([("a",), ("s",), ("x",)], "domain string")
    got = {r.domain: r.schema_prompt for r in attach_schema_prompt(df, schemas).collect()}
    assert got == {"a": text, "s": schema_prompt(SYNTHETIC_SCHEMA), "x": ""}


def test_generated_texts_like_the_rules(spark):
    """10,000 model-like texts through the parse and through the row-by-row rules."""
    rng = random.Random(11)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.25:
            return {rng.choice("abcd.[") * rng.randint(1, 2): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and kind < 0.45:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(
            ["1,200.00", " Coke ", 3, 2.5, 1e20, True, None, "", "2026-01-02", "xé", -0.0, "12 pcs"]
        )

    raws = []
    for _ in range(10_000):
        body = json.dumps({k: value(2) for k in rng.sample("abcdef", rng.randint(0, 4))},
                          ensure_ascii=rng.random() < 0.5)
        kind = rng.random()
        if kind < 0.2:
            body = body[: rng.randint(0, len(body))]
        elif kind < 0.4:
            body = "Sure:\n" + body + rng.choice([" done", " }", "\n```"])
        raws.append(body)
    parsed = parse_json(F.col("t"), "pairs", "minified", block=True)
    for raw, got in zip(raws, ask(spark, raws, parsed)):
        want = rules.block(raw)
        assert got.valid == (want is not None), raw
        if want is not None:
            assert {tuple(p) for p in got.pairs} == rules.flat(want), raw
            assert json.loads(got.minified) == want, raw
