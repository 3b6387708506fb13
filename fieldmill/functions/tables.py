"""SQL surface: the flatten table function and the scalar functions by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from fieldmill.functions.strict_json import is_value, leaves, parse_text, utf8


@udtf(returnType="path string, value string", useArrow=False)
class FlattenJson:
    """``SELECT t.id, f.* FROM t, LATERAL flatten_json(t.doc) f``"""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        document = parse_text(text)
        if is_value(document):
            for path, value in set(leaves(document)):
                yield utf8(path), value


# Scalar functions as native SQL expressions.
_SQL_FUNCTIONS = {
    "top_key(path STRING) RETURNS STRING": r"regexp_extract(path, r'^[^.\[]*', 0)",
    "json_block(raw STRING) RETURNS STRING": (
        r"nullif(regexp_extract(raw, r'(?s)\{.*\}', 0), '')"
    ),
    "field_f1(tp BIGINT, fp BIGINT, fn BIGINT) RETURNS DOUBLE": (
        "CASE WHEN tp > 0 THEN 2.0D * tp / (2 * tp + fp + fn) ELSE 0.0D END"
    ),
}


def register_sql(spark: SparkSession) -> None:
    """Makes ``flatten_json`` and the scalar functions known to SQL in this session."""
    spark.udtf.register("flatten_json", FlattenJson)
    for signature, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
