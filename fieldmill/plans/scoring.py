"""Registered queries: scoring raw answers against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions.draws import digest, draw
from fieldmill.functions.native_schema import native_conforms
from fieldmill.functions.receipt import ANNOTATED_SCHEMA, SYNTHETIC_SCHEMA, flatten_struct
from fieldmill.functions.schema import (
    attach_schema_prompt,
    native_schema_valid,
    schema_prompt,
    top_level_keys,
)
from fieldmill.functions.strict_json import extract_json, flatten_fields, parse_json
from fieldmill.functions.tables import register_sql
from fieldmill.functions.text import json_block, normalize_value, round4, top_key
from fieldmill.operators.comparison import MEASURES, POISSON, compare_paired
from fieldmill.operators.scoring import (
    compare_models,
    evaluate,
    f1_millionths,
    key_conformance,
    match_cells,
    per_field,
    report,
    score,
    summarize,
)
from fieldmill.operators.sweeps import metrics_long
from fieldmill.plans.base import (
    RECEIPTS,
    answers,
    answers_sql,
    fields_sql,
    hexnum,
    query,
    receipts,
    scored_sql,

    sql_normalized,
    sql_round4,
    table,
    with_answer,
    with_sql,
)
from fieldmill.session import work_folder
from fieldmill.sources.bucketed import write_bucketed, zip_bucketed
from fieldmill.sources.samples import spread

SUMMARY = """
  count(*) AS n, sum(json_valid::INT)::BIGINT AS n_json_valid,
  sum(schema_valid::INT)::BIGINT AS n_schema_valid, sum(exact_match::INT)::BIGINT AS n_exact_match,
  sum(f1_millionths)::BIGINT AS f1_millionths,
""" + ", ".join(
    f"{sql_round4(total + ' / count(*)')} AS {rate}"
    for rate, total in [
        ("json_valid_rate", "sum(json_valid::INT)"),
        ("schema_valid_rate", "sum(schema_valid::INT)"),
        ("field_f1", "sum(f1)"),
        ("exact_match", "sum(exact_match::INT)"),
    ]
)
SCORED = with_sql(RECEIPTS, answers_sql(), scored_sql())
PRF = """
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
"""
MICRO = f"""
SELECT field, tp, fp, fn, {sql_round4('p')} AS precision, {sql_round4('r')} AS recall,
  {sql_round4('CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END')} AS f1
FROM (SELECT *, {PRF} FROM (
  SELECT field, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn
  FROM matched GROUP BY field))
"""


def scored_answers(spark: SparkSession, sf_dir: str, salt: str = "0") -> DataFrame:
    return score(answers(spark, sf_dir, salt), schema=SYNTHETIC_SCHEMA)


@query("field_f1_summary", f"{SCORED} SELECT {SUMMARY} FROM scored")
def field_f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(scored_answers(spark, sf_dir))


@query(
    "field_f1_per_sample",
    f"""{SCORED} SELECT "index", json_valid, schema_valid, exact_match, tp, fp, fn, f1_millionths,
    {sql_round4('f1')} AS field_f1 FROM scored""",
)
def field_f1_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_answers(spark, sf_dir).select(
        "index",
        "json_valid",
        "schema_valid",
        "exact_match",
        *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")],
        "f1_millionths",
        round4(F.col("field_f1")).alias("field_f1"),
    )


@query("per_field_micro", f"{SCORED} {MICRO}")
def per_field_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_field(scored_answers(spark, sf_dir))


@query(
    "evaluation_report",
    f"""{SCORED} SELECT '*' AS field, count(*) AS n, sum(json_valid::INT)::BIGINT AS json_valid,
      sum(schema_valid::INT)::BIGINT AS schema_valid, sum(exact_match::INT)::BIGINT AS exact,
      sum(f1_millionths)::BIGINT AS millionths, 0::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn
    FROM scored UNION ALL SELECT field, 0, 0, 0, 0, 0, sum(tp)::BIGINT, sum(fp)::BIGINT,
      sum(fn)::BIGINT FROM matched GROUP BY field""",
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scored_answers(spark, sf_dir)).withColumn(
        "field", F.coalesce("field", F.lit("*"))
    )


@query("evaluate_zip", f"{SCORED} SELECT {SUMMARY} FROM scored")
def evaluate_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and golds as two tables, zipped one to one by index."""
    rows = answers(spark, sf_dir)
    return summarize(
        evaluate(rows.select("index", "raw"), rows.select("index", "gold"), SYNTHETIC_SCHEMA)
    )


@query("evaluate_zip_bucketed", f"{SCORED} SELECT {SUMMARY} FROM scored")
def evaluate_zip_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and golds written once as bucketed tables, then zipped without a shuffle."""
    rows = answers(spark, sf_dir)
    names = []
    for side in ("raw", "gold"):
        place = work_folder(spark, f"bucketed-{side}")
        names.append("bucketed_" + place.rsplit("/", 1)[1].replace("-", "_"))
        write_bucketed(rows.select("index", side), names[-1], path=place)
    return summarize(score(zip_bucketed(spark, *names), schema=SYNTHETIC_SCHEMA))


@query(
    "model_delta",
    with_sql(
        RECEIPTS,
        answers_sql("'base'", name="a0"),
        answers_sql("'tuned'", name="a1"),
        "both_models AS (SELECT 'baseline' AS model, \"index\", gold, raw FROM a0 UNION ALL "
        "SELECT 'adapter', \"index\", gold, CASE WHEN mood IN (3, 8) THEN gold ELSE raw END FROM a1)",
        scored_sql("both_models", 'model, "index"'),
        f"sums AS (SELECT model, {SUMMARY} FROM scored GROUP BY model)",
        "long AS (UNPIVOT (SELECT model, json_valid_rate, schema_valid_rate, field_f1, exact_match "
        "FROM sums) ON json_valid_rate, schema_valid_rate, field_f1, exact_match "
        "INTO NAME metric VALUE v)",
    )
    + """ SELECT metric, max(v) FILTER (model = 'baseline') AS baseline,
      max(v) FILTER (model = 'adapter') AS adapter,
      round(max(v) FILTER (model = 'adapter') - max(v) FILTER (model = 'baseline'), 6) AS delta
    FROM long GROUP BY metric""",
)
def model_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on the same rows; the tuned one always answers and never stops early."""
    sums = summarize(score(both_models(spark, sf_dir), schema=SYNTHETIC_SCHEMA), "model")
    return compare_models(metrics_long(sums)).withColumn("delta", F.round("delta", 6))


def tuned_answer(raw: Column) -> Column:
    """What the tuned model says where the moods that fail are gone."""
    mood = draw(digest("model", F.lit("tuned"), F.col("seed"), blocks=2).substr(33, 32), 1, 4, 10)
    return F.when(mood.isin(3, 8), F.col("target_json")).otherwise(raw)


def two_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``model, index, gold, raw`` of a baseline and of a tuned model."""
    rows = receipts(spark, sf_dir)
    cols = [F.col("seed").alias("index"), F.col("target_json").alias("gold")]
    base = with_answer(rows, "base").select(F.lit("baseline").alias("model"), *cols, "raw")
    tuned = with_answer(rows, "tuned").select(
        F.lit("adapter").alias("model"), *cols, tuned_answer(F.col("raw")).alias("raw")
    )
    return base, tuned


def both_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``two_models`` in one frame: a receipt is drawn once, and its two answers follow
    one another, so that the gold they share is parsed once."""
    asked = with_answer(receipts(spark, sf_dir), "base").withColumnRenamed("raw", "_base")
    asked = with_answer(asked, "tuned").withColumn("_tuned", tuned_answer(F.col("raw")))
    said = [
        F.struct(F.lit(model).alias("model"), F.col(column).alias("raw"))
        for model, column in (("baseline", "_base"), ("adapter", "_tuned"))
    ]
    return asked.select(
        F.col("seed").alias("index"), F.col("target_json").alias("gold"), F.inline(F.array(*said))
    ).select("model", "index", "gold", "raw")


REPLICATES = 40
_COUNTED = "json_valid::INT * 1000000", "schema_valid::INT * 1000000", "f1_millionths", "exact_match::INT * 1000000"
_CHANGES = " UNION ALL ".join(
    f"""SELECT replicate, '{metric}' AS metric, sum(w) AS n,
      sum(w * ({value})) FILTER (model = 'baseline') AS b, sum(w * ({value})) FILTER (model = 'adapter') AS a
    FROM weighted GROUP BY replicate"""
    for metric, value in zip(MEASURES, _COUNTED)
)
_WEIGHT = " + ".join(f"(drawn >= {bound})::INT" for bound in POISSON)


@query(
    "model_delta_paired",
    with_sql(
        RECEIPTS,
        answers_sql("'base'", name="a0"),
        answers_sql("'tuned'", name="a1"),
        "both_models AS (SELECT 'baseline' AS model, \"index\", gold, raw FROM a0 UNION ALL "
        "SELECT 'adapter', \"index\", gold, CASE WHEN mood IN (3, 8) THEN gold ELSE raw END FROM a1)",
        scored_sql("both_models", 'model, "index"'),
        f"""replicates AS (
          SELECT scored.*, r + 1 AS replicate,
            ('0x' || substr(md5('bootstrap-7|' || "index" || '|' || (r // 8) || '|0'), 1 + 4 * (r % 8), 4))::INT AS drawn
          FROM scored, range({REPLICATES}) t(r)),
        weighted AS (
          SELECT *, {_WEIGHT} AS w FROM replicates UNION ALL SELECT *, 0, 0, 1 FROM scored),
        changes AS (SELECT *, (a - b) / (n / 2) / 1000000 AS change FROM ({_CHANGES}))""",
    )
    + f""" SELECT metric, (max(n) FILTER (replicate = 0) / 2)::BIGINT AS n,
      round(max(b / (n / 2) / 1000000) FILTER (replicate = 0), 6) AS baseline,
      round(max(a / (n / 2) / 1000000) FILTER (replicate = 0), 6) AS adapter,
      round(max(change) FILTER (replicate = 0), 6) AS delta,
      round(list_sort(list(change) FILTER (replicate > 0))[2], 6) AS low,
      round(list_sort(list(change) FILTER (replicate > 0))[{REPLICATES - 1}], 6) AS high
    FROM changes GROUP BY metric""",
)
def model_delta_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two models row by row, with an interval for every difference."""
    base, tuned = two_models(spark, sf_dir)
    scored = [score(rows, schema=SYNTHETIC_SCHEMA) for rows in (base, tuned)]
    return compare_paired(*scored, replicates=REPLICATES, seed=7)


LINE_FIELDS = """
lines AS (
  SELECT l_orderkey AS "index", p_name, (l_quantity)::BIGINT AS qty,
    round(l_extendedprice * 100)::BIGINT AS cents,
    ('0x' || substr(md5('line|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|'
      || l_linenumber), 1, 6))::BIGINT AS d
  FROM lineitem JOIN part ON l_partkey = p_partkey
), gold AS (
  SELECT DISTINCT "index", unnest(['menu[].name', 'menu[].count', 'menu[].price']) AS path,
    unnest([lower(p_name), qty::VARCHAR, cents::VARCHAR]) AS value FROM lines
  UNION SELECT "index", 'total', sum(cents)::BIGINT::VARCHAR FROM lines GROUP BY ALL
), pred AS (
  SELECT DISTINCT "index", unnest(['menu[].name', 'menu[].count', 'menu[].price']) AS path,
    unnest([CASE WHEN d % 7 = 0 THEN lower(p_name) || ' xl' ELSE lower(p_name) END,
      (qty + CASE WHEN d % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR,
      (cents + d % 2)::VARCHAR]) AS value FROM lines WHERE d % 11 <> 0
  UNION SELECT "index", 'sum', sum(cents)::BIGINT::VARCHAR FROM lines WHERE d % 11 <> 0 GROUP BY ALL
), cells AS (
  SELECT "index", path, value, max(p) AS p, max(g) AS g FROM (
    SELECT *, 1 AS p, 0 AS g FROM pred UNION ALL SELECT *, 0, 1 FROM gold) GROUP BY ALL
), matched AS (
  SELECT "index", regexp_extract(path, '^[^.\\[]*') AS field, sum(p * g)::BIGINT AS tp,
    sum(p * (1 - g))::BIGINT AS fp, sum(g * (1 - p))::BIGINT AS fn
  FROM cells GROUP BY ALL
)"""


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as gold and predicted ``(index, path, value, p, g)`` cells.

    By draws, the prediction misses some lines and gets some names, counts and prices wrong; all
    lines are gold.  A line emits the cells of both sides at once; order totals come from one
    combined aggregate, no order's lines are ever gathered.
    """
    draws = F.md5(
        F.concat_ws("|", F.lit("line"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    )
    lines = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
        )
    ).select(
        F.col("l_orderkey").alias("index"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        draw(draws, 1, 6, 1 << 24).alias("d"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.lower("p_name").alias("name")
    )
    d, name, qty, cents = (F.col(c) for c in ("d", "name", "qty", "cents"))
    said = d % 11 != 0

    def cell(path: str, value: Column, p: int, g: int) -> Column:
        return F.struct(
            F.lit(path).alias("path"), value.cast("string").alias("value"),
            F.lit(p).alias("p"), F.lit(g).alias("g"),
        )

    sides = {
        "menu[].name": (name, F.when(d % 7 == 0, F.concat(name, F.lit(" xl"))).otherwise(name)),
        "menu[].count": (qty, qty + F.when(d % 5 == 0, 1).otherwise(0)),
        "menu[].price": (cents, cents + d % 2),
    }
    gold = F.array(*[cell(path, right, 0, 1) for path, (right, _) in sides.items()])
    pred = F.array(*[cell(path, guess, 1, 0) for path, (_, guess) in sides.items()])
    own = lines.join(parts, "part").select(
        "index", F.inline(F.when(said, F.concat(gold, pred)).otherwise(gold))
    )
    sums = lines.groupBy("index").agg(
        F.sum("cents").alias("total"), F.sum(F.when(said, cents)).alias("sum")
    )
    totals = F.array(cell("total", F.col("total"), 0, 1), cell("sum", F.col("sum"), 1, 0))
    return own.unionByName(sums.select("index", F.inline(totals)).where("value IS NOT NULL"))


@query(
    "match_fields",
    with_sql(LINE_FIELDS) + ' SELECT "index", field, tp, fp, fn FROM matched',
)
def match_fields_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_cells(line_cells(spark, sf_dir))


@query(
    "match_fields_f1",
    with_sql(
        LINE_FIELDS,
        'totals AS (SELECT "index", sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, '
        'sum(fn)::BIGINT AS fn FROM matched GROUP BY "index")',
    )
    + """ SELECT count(*) AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
      sum((2 * tp * 1000000) // (2 * tp + fp + fn))::BIGINT AS f1_millionths FROM totals""",
)
def match_fields_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of all orders, matched relationally."""
    totals = (
        match_cells(line_cells(spark, sf_dir))
        .groupBy("index")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    f1 = f1_millionths(F.col("tp"), F.col("fp"), F.col("fn"))
    return totals.agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.sum(f1).alias("f1_millionths"),
    )


# Texts with 5 decimals (ties included), thousands separators, words and signs.
_MONEY_SQL = f"""
money AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(l_extendedprice * 100)::BIGINT AS cents, l_quantity::BIGINT AS qty,
    {hexnum("md5('text|' || l_orderkey || '|' || l_partkey || '|' || l_linenumber)", 1, 4, 6)} AS style
  FROM lineitem
), texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE style
    WHEN 0 THEN '$' || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0')
    WHEN 1 THEN ' ' || (cents // 100000) || '.' || lpad((cents % 100000)::VARCHAR, 5, '0') || ' '
    WHEN 2 THEN (cents // 100000) || ',' || lpad(((cents // 100) % 1000)::VARCHAR, 3, '0') || '.00 EUR'
    WHEN 3 THEN qty || ' Pieces'
    WHEN 4 THEN '-' || (cents % 7) || '.' || (cents % 10) || '0'
    ELSE 'Order-' || qty || '-' || (cents % 9) END AS raw
  FROM money
)"""


@query(
    "normalize_value",
    with_sql(_MONEY_SQL)
    + f""" SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, raw, {sql_normalized('raw')} AS value
    FROM texts""",
)
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )
    rows = spread(rows)
    style = draw(
        F.md5(F.concat_ws("|", F.lit("text"), "l_orderkey", "l_partkey", "l_linenumber")), 1, 4, 6
    )

    def text(value: Column) -> Column:
        return value.cast("string")

    cents, qty = F.col("cents"), F.col("qty")
    units = F.floor(cents / 100)
    raw = (
        F.when(
            style == 0,
            F.concat(F.lit("$"), text(units), F.lit("."), F.lpad(text(cents % 100), 2, "0")),
        )
        .when(
            style == 1,
            F.concat(
                F.lit(" "), text(F.floor(cents / 100000)), F.lit("."),
                F.lpad(text(cents % 100000), 5, "0"), F.lit(" "),
            ),
        )
        .when(
            style == 2,
            F.concat(
                text(F.floor(cents / 100000)), F.lit(","), F.lpad(text(units % 1000), 3, "0"),
                F.lit(".00 EUR"),
            ),
        )
        .when(style == 3, F.concat(text(qty), F.lit(" Pieces")))
        .when(
            style == 4,
            F.concat(F.lit("-"), text(cents % 7), F.lit("."), text(cents % 10), F.lit("0")),
        )
        .otherwise(F.concat(F.lit("Order-"), text(qty), F.lit("-"), text(cents % 9)))
    )
    return rows.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        raw.alias("raw"),
        normalize_value(raw).alias("value"),
    )


# Event properties with noise around them; some broken, some with two objects.
_NOISY_SQL = """
noisy AS (
  SELECT event_id, event_id % 6 AS style, CASE event_id % 6
    WHEN 0 THEN props WHEN 1 THEN 'Here you go: ' || props || ' done'
    WHEN 2 THEN event_type WHEN 3 THEN replace(props, '}', '')
    WHEN 4 THEN props || ' ' || props
    ELSE 'a' || chr(10) || '{"type":"' || event_type || '",' || chr(10) || '"in":' || props || '} {' END AS raw
  FROM events
)"""


def noisy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.col("event_id") % 6
    props = F.col("props")
    raw = (
        F.when(style == 0, props)
        .when(style == 1, F.concat(F.lit("Here you go: "), props, F.lit(" done")))
        .when(style == 2, F.col("event_type"))
        .when(style == 3, F.replace(props, F.lit("}"), F.lit("")))
        .when(style == 4, F.concat_ws(" ", props, props))
        .otherwise(
            F.concat(
                F.lit('a\n{"type":"'), F.col("event_type"), F.lit('",\n"in":'), props, F.lit("} {"),
            )
        )
    )
    return spread(table(spark, sf_dir, "events").select("event_id", "event_type", "props")).select(
        "event_id", raw.alias("raw")
    )


@query(
    "extract_json",
    with_sql(
        _NOISY_SQL,
        "blocks AS (SELECT *, nullif(regexp_extract(raw, '\\{.*\\}', 0, 's'), '') AS block FROM noisy)",
    )
    + """ SELECT event_id, block, CASE WHEN json_valid(block) THEN json(block)::VARCHAR END AS object
    FROM blocks""",
)
def extract_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_events(spark, sf_dir).select(
        "event_id",
        json_block(F.col("raw")).alias("block"),
        extract_json(F.col("raw")).alias("object"),
    )


_FLAT_SQL = (
    with_sql(RECEIPTS, answers_sql(), 'docs AS (SELECT "index", gold FROM answers)',
             fields_sql("docs", "gold", "pairs"))
    + ' SELECT "index", path, value, regexp_extract(path, \'^[^.\\[]*\') AS top_key FROM pairs'
)


@query("flatten_fields", _FLAT_SQL)
def flatten_fields_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any JSON text flattened, parsed strictly."""
    rows = answers(spark, sf_dir).select("index", F.inline(flatten_fields(F.col("gold"))))
    return rows.withColumn("top_key", top_key(F.col("path")))


@query("flatten_struct", _FLAT_SQL)
def flatten_struct_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of known type flattened natively; same rows as the strict parse."""
    rows = receipts(spark, sf_dir)
    pairs = flatten_struct(F.col("receipt"), rows.schema["receipt"].dataType)
    return rows.select(F.col("seed").alias("index"), F.inline(pairs)).withColumn(
        "top_key", top_key(F.col("path"))
    )


@query("flatten_json", _FLAT_SQL)
def flatten_json_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL."""
    register_sql(spark)
    answers(spark, sf_dir).createOrReplaceTempView("fieldmill_answers")
    return spark.sql(
        "SELECT a.index, f.path, f.value, top_key(f.path) AS top_key "
        "FROM fieldmill_answers a, LATERAL flatten_json(a.gold) f"
    )


@query(
    "schema_valid",
    f"""{SCORED} SELECT json_valid, schema_valid, count(*) AS rows FROM scored GROUP BY ALL""",
)
def schema_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_json(F.col("raw"), schema=SYNTHETIC_SCHEMA, block=True)
    return (
        answers(spark, sf_dir)
        .select(parsed.alias("p"))
        .groupBy(F.col("p.valid").alias("json_valid"), F.col("p.schema_valid").alias("schema_valid"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    "schema_valid_native",
    with_sql(RECEIPTS)
    + """ SELECT split, count(*) AS rows, count(*) FILTER (regexp_matches("date",
      '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) AS valid FROM receipts GROUP BY split""",
)
def schema_valid_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = native_schema_valid(F.col("receipt"), "items", "date")
    return (
        receipts(spark, sf_dir)
        .groupBy("split")
        .agg(F.count("*").alias("rows"), F.count_if(ok).alias("valid"))
    )


PROPS_SCHEMA = {
    "type": "object",
    "required": ["k"],
    "properties": {"k": {"type": "integer", "minimum": 5, "exclusiveMaximum": 90, "not": {"enum": [13, 26.0, "40"]}}},
    "additionalProperties": False,
}
#: An event as one JSON record.
RECORD_SCHEMA = {
    "type": "object",
    "required": ["id", "kind", "value", "tags", "props"],
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "kind": {"enum": ["click", "view", "purchase"]},
        "value": {"anyOf": [{"type": "number", "minimum": 5}, {"type": "null"}]},
        "tags": {
            "type": "array",
            "minItems": 1,
            "uniqueItems": True,
            "items": {"oneOf": [{"type": "string", "maxLength": 3, "pattern": r"^\w+$"}, {"type": "integer"}]},
        },
        "props": {"$ref": "#/$defs/props"},
    },
    "additionalProperties": False,
    "$defs": {"props": PROPS_SCHEMA},
}
_PROPS_VALID = "k >= 5 AND k < 90 AND k NOT IN (13, 26)"
_EVENT_K = "(SELECT *, (props->>'k')::BIGINT AS k FROM events)"


@query("schema_valid_props", f"SELECT event_id, {_PROPS_VALID} AS valid FROM {_EVENT_K}")
def schema_valid_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties against a schema, without Python."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", native_conforms(F.col("props"), PROPS_SCHEMA).alias("valid"))


def event_records(rows: DataFrame) -> DataFrame:
    """``event_id, record``: events as JSON texts, seven of eight in some other shape."""
    shape, k = F.col("event_id") % 8, F.get_json_object("props", "$.k")
    letter = F.concat(F.lit('"'), F.substring("event_type", 1, 1), F.lit('"'))
    value = (
        F.when(shape == 1, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"')))
        .when(shape == 7, "null")
        .otherwise(F.col("value").cast("string"))
    )
    kind = F.when(shape == 2, "").otherwise(F.concat(F.lit('"kind":"'), F.col("event_type"), F.lit('",')))
    first = F.when(shape == 3, k).when(shape == 6, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(letter)
    record = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(","), kind, F.lit('"value":'), value,
        F.lit(',"tags":['), first, F.lit(", "), k, F.lit('],"props":'), F.col("props"),
        F.when(shape == 4, ',"more":[]').otherwise(""), F.when(shape == 5, "").otherwise("}"),
    )
    return rows.select("event_id", record.alias("record"))


@query(
    "schema_valid_records",
    f"""SELECT event_id, event_id % 8 NOT IN (1, 2, 3, 4, 5)
      AND event_type IN ('click', 'view', 'purchase') AND (event_id % 8 = 7 OR value >= 5)
      AND {_PROPS_VALID} AS valid FROM {_EVENT_K}""",
)
def schema_valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of mixed shapes, broken ones too, against a schema of nested parts."""
    rows = event_records(table(spark, sf_dir, "events"))
    return rows.select("event_id", native_conforms(F.col("record"), RECORD_SCHEMA).alias("valid"))


@query(
    "key_conformance",
    with_sql(
        RECEIPTS,
        answers_sql(),
        scored_sql(),
        "keys AS (SELECT unnest(json_keys(pred)) AS key FROM judged WHERE pred IS NOT NULL)",
        "declared AS (SELECT unnest(['menu', 'subtotal', 'tax', 'total']) AS key)",
    )
    + """ SELECT 'unknown' AS status, key, count(*) AS rows FROM keys
      WHERE key NOT IN (SELECT key FROM declared) GROUP BY key
    UNION ALL SELECT 'never', key, 0 FROM declared WHERE key NOT IN (SELECT key FROM keys)""",
)
def key_conformance_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic answers held against the other receipt schema."""
    members = parse_json(F.col("raw"), "members", block=True)["members"]
    keys = answers(spark, sf_dir).select(F.explode(members).alias("m")).select("m.key")
    return key_conformance(keys, top_level_keys(ANNOTATED_SCHEMA))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "schema_prompts",
    f"""SELECT o_orderkey AS "index", md5(CASE o_orderkey % 3
      WHEN 0 THEN {_sql_text(schema_prompt(ANNOTATED_SCHEMA))}
      WHEN 1 THEN {_sql_text(schema_prompt(SYNTHETIC_SCHEMA))} ELSE '' END) AS prompt_md5 FROM orders""",
)
def schema_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's prompt text by the domain it belongs to; one domain has no schema."""
    key = F.col("o_orderkey")
    domain = F.when(key % 3 == 0, "annotated").when(key % 3 == 1, "synthetic").otherwise("free")
    rows = table(spark, sf_dir, "orders").select(key.alias("index"), domain.alias("domain"))
    prompts = attach_schema_prompt(
        rows, {"annotated": ANNOTATED_SCHEMA, "synthetic": SYNTHETIC_SCHEMA}
    )
    return prompts.select("index", F.md5("schema_prompt").alias("prompt_md5"))


