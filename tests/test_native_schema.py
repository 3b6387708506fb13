from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmill.functions.native_schema import native_conforms
from fieldmill.functions.receipt import ANNOTATED_SCHEMA, SYNTHETIC_SCHEMA
from fieldmill.functions.schema import compile_schema
from fieldmill.functions.strict_json import MISSING, TOO_DEEP, parse_text

TEXTS = [
    None, "", "null", "true", "false", "0", "1", "1.0", "-0.0", "1e2", "1.5", "-3", "1e400", "9007199254740993",
    "123456789012345678901234567890", '"x"', '"1"', '"true"', '"naïve 漢字"', '"2026-01-02"', '"a\\nb"', "[]", "[1]", "[1,1.0]",
    "[1,true]", '["a","b"]', '[{"a":1},{"a":1.0}]', '[{"a":1,"b":2},{"b":2,"a":1}]', "[[1],[1]]", "[null,null]", "{}",
    '{"a":1}', '{"a":"1"}', '{"a":null}', '{"a":1,"b":[1,2,{"c":"d"}]}', '{"b":{"a":{"b":{}}}}', '{"a":1} x', "1,2",
    '{"a":1}}', '1,"w":0} x', "[1,]", "{a:1}", "01", " 1 ", "\t[1]\n", '{"total":"3"}', '{"menu":"x"}',
    '{"menu":[{"name":"Coke","count":"1","price":"3"}],"subtotal":"3","tax":"0","total":"3"}',
    '{"menu":[{"name":"Coke","count":1,"price":"3"}],"subtotal":"3","tax":"0","total":"3"}',
]
SCHEMAS = [
    None, {}, {"type": "object"}, {"type": ["integer", "null"]}, {"type": "number"}, {"type": "string"}, {"type": "array"},
    {"type": "boolean"}, {"enum": [1, "x", None, [1], {"a": 1}, {"b": 2, "a": 1}]}, {"const": 1.0}, {"const": True}, {"const": [1, True]},
    {"const": 9007199254740993}, {"minimum": 1}, {"minimum": 1.5}, {"maximum": 1}, {"exclusiveMinimum": 0}, {"exclusiveMaximum": 1.5},
    {"exclusiveMaximum": 9007199254740993}, {"minimum": 1e40}, {"minLength": 2}, {"maxLength": 8}, {"pattern": r"^\d{4}-\d{2}-\d{2}$"},
    {"pattern": "a.b"}, {"pattern": r"^\w+$"}, {"minItems": 1}, {"maxItems": 1}, {"minProperties": 1}, {"maxProperties": 1},
    {"uniqueItems": True}, {"uniqueItems": False}, {"required": ["a"]}, {"properties": {"a": {"type": "integer"}}},
    {"properties": {"a": {}}, "additionalProperties": False}, {"additionalProperties": {"type": "array"}}, {"additionalProperties": False},
    {"items": {"type": "integer"}}, {"items": {"properties": {"a": {"const": 1}}, "required": ["a"]}}, {"allOf": [{"type": "number"}, {"minimum": 1}]},
    {"anyOf": [{"type": "string"}, {"minItems": 2}]}, {"oneOf": [{"type": "integer"}, {"minimum": 1}]}, {"not": {"type": "object"}},
    {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"b": {"$ref": "#/$defs/m"}}}, "m": {"type": "array"}}},
    {"properties": {"b": {"properties": {"a": {"properties": {"b": {"maxProperties": 0}}}}}}}, ANNOTATED_SCHEMA, SYNTHETIC_SCHEMA,
]


def strict(text, check):
    value = parse_text(text)
    return value is not MISSING and value is not TOO_DEEP and bool(check(value))


def compared(spark, texts, schemas):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for begin in range(0, len(schemas), 8):
        some = schemas[begin : begin + 8]
        rows = df.select("i", *[native_conforms(F.col("t"), s).alias(f"s{n}") for n, s in enumerate(some)]).collect()
        for row in rows:
            for n, schema in enumerate(some):
                assert row[f"s{n}"] == strict(texts[row.i], compile_schema(schema)), (texts[row.i], schema)


def test_both_lanes_agree(spark):
    compared(spark, TEXTS, SCHEMAS)


scalars = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 5), st.integers(-(10**37), 10**37), st.sampled_from([0.5, 1.0, -2.0, 1e30, 2.5]),
    st.sampled_from(["", "a", "ab", "1", "true", "é"]),
)
keys = st.sampled_from(["a", "b", "c"])
values = st.recursive(scalars, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(keys, v, max_size=3)), max_leaves=8)
simple = st.one_of(
    st.fixed_dictionaries({"type": st.sampled_from(["object", "array", "string", "boolean", "null", "number", "integer"])}),
    st.fixed_dictionaries({"enum": st.lists(values, min_size=1, max_size=3)}),
    st.fixed_dictionaries({"const": values}),
    st.fixed_dictionaries({"minimum": st.sampled_from([-1, 0.5, 2, 10**20])}),
    st.fixed_dictionaries({"exclusiveMaximum": st.sampled_from([-1, 0.5, 2, 10**20])}),
    st.fixed_dictionaries({"minLength": st.integers(0, 2)}), st.fixed_dictionaries({"uniqueItems": st.just(True)}),
    st.fixed_dictionaries({"required": st.lists(keys, max_size=2)}), st.fixed_dictionaries({"maxItems": st.integers(0, 2)}),
)
schemas = st.recursive(
    simple,
    lambda s: st.one_of(
        st.fixed_dictionaries({"properties": st.dictionaries(keys, s, max_size=2), "additionalProperties": st.one_of(st.booleans(), s)}),
        st.fixed_dictionaries({"items": s}), st.fixed_dictionaries({"not": s}),
        *[st.fixed_dictionaries({key: st.lists(s, min_size=1, max_size=2)}) for key in ("allOf", "anyOf", "oneOf")],
    ),
    max_leaves=4,
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(values, min_size=20, max_size=20), schemas)
def test_drawn_schemas_and_values(spark, drawn, schema):
    compared(spark, [json.dumps(value) for value in drawn], [schema])


def test_no_python_and_one_parse(spark):
    schema = {"properties": {"a": {"items": {"type": "integer", "minimum": 1}}}, "required": ["a"], "uniqueItems": True}
    plan = spark.range(3).select(native_conforms(F.col("id").cast("string"), schema))._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert "Python" not in plan.executedPlan().toString()
    assert text.count("try_parse_json") == 1


@pytest.mark.parametrize(
    "schema",
    [
        {"typ": "object"}, {"type": "date"}, {"$ref": "#"}, {"$ref": "other.json"}, {"pattern": "(?P<y>a)"},
        {"$ref": "#/$defs/n", "$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}}, {"anyOf": []},
    ],
)
def test_refused_schemas(spark, schema):
    with pytest.raises(ValueError):
        native_conforms(F.lit("{}"), schema)


def test_names_of_numbers_are_no_json(spark):
    df = spark.createDataFrame([("NaN",), ("[Infinity]",)], "t string")
    assert [r[0] for r in df.select(native_conforms(F.col("t"), None)).collect()] == [False, False]


def test_repeated_keys_follow_the_setting(spark):
    df = spark.createDataFrame([('{"a":1,"a":"x"}',)], "t string")
    schema = {"properties": {"a": {"type": "string"}}}
    assert df.select(native_conforms(F.col("t"), schema)).first()[0] is False
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert df.select(native_conforms(F.col("t"), schema)).first()[0] is True
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
