"""Registered queries: perturbations and preference pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions.chat import RECEIPT_INSTRUCTION
from fieldmill.functions.perturb import (
    MODES,
    corrupt_digits,
    drop_key,
    join_members,
    key_digest,
    prose_wrap,
    rename_key,
    truncate_json,
)
from fieldmill.functions.receipt import SYNTHETIC_SCHEMA
from fieldmill.functions.text import round4
from fieldmill.operators.pairs import (
    pairs_from_gold,
    pairs_from_predictions,
    to_preference_rows,
)
from fieldmill.operators.scoring import score
from fieldmill.plans.base import (
    RECEIPTS,
    answers,
    answers_sql,
    query,
    receipts,
    scored_sql,
    sql_corrupt,
    sql_digest,
    sql_drop,
    sql_prose,
    sql_rename,
    sql_shuffled,
    sql_truncate,
    table,
    with_sql,
)
from fieldmill.session import work_folder
from fieldmill.sources.samples import read_pairs, spread, write_pairs

_DRAWS = sql_digest("perturb|3", "split || '|' || \"index\"", 2)
_DRAWN = f"drawn_receipts AS (SELECT *, {_DRAWS} AS hp FROM receipts)"


def _on_receipts(spark: SparkSession, sf_dir: str, change: Callable[..., Column]) -> DataFrame:
    rows = receipts(spark, sf_dir).withColumn("_h", key_digest(3, F.col("split"), F.col("index")))
    return rows.select("split", "index", change(F.col("_h")).alias("text"))


def _receipt_sql(text: str) -> str:
    return with_sql(RECEIPTS, _DRAWN) + f' SELECT split, "index", {text} AS text FROM drawn_receipts'


@query("perturb_digits", _receipt_sql(sql_corrupt("target_json", "hp")))
def perturb_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_receipts(spark, sf_dir, lambda h: corrupt_digits(F.col("target_json"), h))


@query("perturb_drop_key", _receipt_sql(sql_drop("members", "hp")))
def perturb_drop_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_receipts(spark, sf_dir, lambda h: join_members(drop_key(F.col("members"), h)))


@query("perturb_rename_key", _receipt_sql(sql_rename("members", "hp")))
def perturb_rename_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_receipts(spark, sf_dir, lambda h: join_members(rename_key(F.col("members"), h)))


_DOC = sql_digest("perturb|3", "lang || '|' || doc_id", 2)


def _on_documents(spark: SparkSession, sf_dir: str, change: Callable[..., Column]) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    drawn = rows.withColumn("_h", key_digest(3, F.col("lang"), F.col("doc_id")))
    return drawn.select("doc_id", F.md5(change(F.col("_h"))).alias("text_md5"))


def _document_sql(text: str) -> str:
    return f"SELECT doc_id, md5({text}) AS text_md5 FROM (SELECT *, {_DOC} AS hp FROM documents)"


@query("perturb_digits_text", _document_sql(sql_corrupt("text", "hp")))
def perturb_digits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with two digits changed; one without digits stays as it is."""
    return _on_documents(spark, sf_dir, lambda h: corrupt_digits(F.col("text"), h))


@query("perturb_prose", _document_sql(sql_prose("text", "hp")))
def perturb_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_documents(spark, sf_dir, lambda h: prose_wrap(F.col("text"), h))


@query("perturb_truncate", _document_sql(sql_truncate("text")))
def perturb_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_documents(spark, sf_dir, lambda h: truncate_json(F.col("text")))


_ORDER = sql_shuffled("substr(hp, 33, 32)", len(MODES))
_PAIRS = f"""
moded AS (
  SELECT *, ({sql_digest('perturb|3', "'train|' || \"index\"", 2)}) AS hp FROM receipts
  WHERE split = 'train'
), chosen_mode AS (
  SELECT *, {list(MODES)}[{_ORDER}[1] + 1] AS mode FROM moded
), pairs AS (
  SELECT split, "index", target_json AS chosen, mode, CASE mode
    WHEN 'digits' THEN {sql_corrupt('target_json', 'hp')}
    WHEN 'drop_key' THEN {sql_drop('members', 'hp')}
    WHEN 'rename_key' THEN {sql_rename('members', 'hp')}
    WHEN 'prose' THEN {sql_prose('target_json', 'hp')}
    ELSE {sql_truncate('target_json')} END AS rejected
  FROM chosen_mode
)"""


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_gold(receipts(spark, sf_dir), "train", seed=3)


@query(
    "pairs_from_gold",
    with_sql(RECEIPTS, _PAIRS) + ' SELECT split, "index", chosen, rejected, mode FROM pairs',
)
def pairs_from_gold_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the train split, top-level keys known from the receipt's type."""
    return gold_pairs(spark, sf_dir)


@query(
    "pairs_from_text",
    with_sql(RECEIPTS, _PAIRS) + ' SELECT split, "index", chosen, rejected, mode FROM pairs',
)
def pairs_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs from JSON text alone, keys found by a strict parse."""
    return pairs_from_gold(receipts(spark, sf_dir).drop("members"), "train", seed=3)


@query(
    "write_read_pairs",
    with_sql(RECEIPTS, _PAIRS) + ' SELECT split, "index", chosen, rejected FROM pairs',
)
def pairs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as JSON lines and read back."""
    place = work_folder(spark, "pairs")
    write_pairs(gold_pairs(spark, sf_dir), place)
    return read_pairs(spark, place)


@query(
    "hard_pairs",
    with_sql(RECEIPTS, answers_sql(), scored_sql())
    + """ SELECT 'validation' AS split, "index", gold AS chosen, raw AS rejected FROM scored
    WHERE NOT json_valid OR printf('%.4f', f1)::DOUBLE < 1""",
)
def hard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of real mistakes: not parseable or not every field right."""
    scored = score(answers(spark, sf_dir), schema=SYNTHETIC_SCHEMA)
    stored = scored.withColumn("field_f1", round4(F.col("field_f1")))
    return pairs_from_predictions(stored, "validation")




@query(
    "preference_rows",
    with_sql(RECEIPTS, _PAIRS)
    + f""" SELECT split, "index", CASE WHEN l_orderkey IS NOT NULL THEN 'receipt/' || "index" * 2 END
        AS image, 'user' AS prompt_role, '{RECEIPT_INSTRUCTION}' AS instruction, chosen, rejected,
      CASE WHEN l_orderkey IS NULL THEN 'no such sample' END AS bad_reason
    FROM pairs LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = "index" * 2""",
)
def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of all pairs; an order without lines has no sample and is named so."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seed")).distinct()
    samples = receipts(spark, sf_dir).join(lines, "seed", "left_semi")
    rows = to_preference_rows(gold_pairs(spark, sf_dir), samples, RECEIPT_INSTRUCTION)

    def body(messages: str, part: int) -> Column:
        return F.get(F.get(messages, F.lit(0))["content"], F.lit(part))["text"]

    return rows.select(
        "split",
        "index",
        F.get("images", F.lit(0)).alias("image"),
        F.get("prompt", F.lit(0))["role"].alias("prompt_role"),
        body("prompt", 1).alias("instruction"),
        body("chosen", 0).alias("chosen"),
        body("rejected", 0).alias("rejected"),
        "bad_reason",
    )
