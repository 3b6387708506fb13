"""One row per keyword: schema, values that conform, values that do not."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from fieldmill.functions.schema import compile_schema
from fieldmill.functions.strict_json import parse_json

CASES = [
    ({"type": "integer"}, [1, 2.0], [True, 1.5, "1", None]),
    ({"type": ["string", "null"]}, ["", None], [0, []]),
    ({"enum": [1, "a", [True]]}, [1.0, "a", [True]], [True, "b", [1]]),
    ({"const": {"a": [1, 2]}}, [{"a": [1, 2.0]}], [{"a": [2, 1]}, {}]),
    ({"minimum": 2, "maximum": 3}, [2, 3.0, "1", True], [1.9, 4]),
    ({"exclusiveMinimum": 2, "exclusiveMaximum": 3}, [2.5, "x"], [2, 3]),
    ({"minLength": 1, "maxLength": 2}, ["a", "éé", []], ["", "abc"]),
    ({"minItems": 1, "maxItems": 2}, [[0], [0, 1], ""], [[], [1, 2, 3]]),
    ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}, []], [{}, {"a": 1, "b": 2}]),
    ({"uniqueItems": True}, [[1, True, "1"], [[1], [2]]], [[1, 1.0], [{"a": 1}, {"a": 1}]]),
    ({"pattern": "^a"}, ["ab", 5], ["ba"]),
    ({"required": ["a"]}, [{"a": None}, []], [{}]),
    ({"properties": {"a": {"type": "string"}}}, [{"a": "x", "b": 1}, {}, 3], [{"a": 1}]),
    ({"properties": {"a": {}}, "additionalProperties": False}, [{"a": 1}, {}], [{"b": 1}]),
    ({"additionalProperties": {"type": "null"}}, [{"b": None}], [{"b": 1}]),
    ({"items": {"type": "number"}}, [[1, 2.5], "x"], [[1, "x"]]),
    ({"allOf": [{"minimum": 1}, {"type": "number"}]}, [1], [0, "x"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 5], [4]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 4], [2]),
    ({"not": {"type": "string"}}, [1], ["x"]),
    (
        {"$ref": "#/$defs/tree", "$defs": {"tree": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}},
        [[], [[], [[]]]],
        [1, [[1]]],
    ),
    ({"properties": {"next": {"$ref": "#"}}, "required": ["v"]}, [{"v": 1, "next": {"v": 2}}], [{"v": 1, "next": {}}]),
]


@pytest.mark.parametrize("schema, good, bad", CASES, ids=lambda x: str(x)[:40])
def test_keyword(schema, good, bad):
    check = compile_schema(schema)
    assert all(map(check, good)) and not any(map(check, bad))


@pytest.mark.parametrize(
    "schema", [{"format": "date"}, {"type": "text"}, {"$ref": "other.json"}, {"$ref": "#/nowhere"}]
)
def test_unknown_schemas_fail_when_compiled(schema):
    with pytest.raises(ValueError):
        compile_schema(schema)


def test_in_a_job(spark):
    schema = {"type": "object", "properties": {"n": {"minimum": 2, "enum": [1, 2, 3]}}}
    rows = spark.createDataFrame([('{"n":2}',), ('{"n":1}',), ("[]",), ("{",), (None,)], "t string")
    got = rows.select(parse_json(F.col("t"), schema=schema)["schema_valid"]).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]
