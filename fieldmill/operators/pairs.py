"""Preference pairs: wrong answers from perturbed gold or from real mistakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.functions.chat import MESSAGE_TYPE, build_messages, message, text_part
from fieldmill.functions.perturb import choose_mode, key_digest, perturb
from fieldmill.functions.strict_json import parse_json
from fieldmill.operators.scoring import with_unique_check

PAIR_TYPE = "split string, index bigint, chosen string, rejected string"


def first_n(df: DataFrame, n: int | None, index: str = "index", by: str | None = None) -> DataFrame:
    """The first ``n`` rows by an index that may have gaps, of each ``by`` if given; None is all.

    Tasks keep their own first ``n`` rows before anything is shuffled: a top-k without ``by``, a
    window with a group limit with it.
    """
    if n is None:
        return df
    if by is None:
        return df.orderBy(index).limit(n)
    order = Window.partitionBy(by).orderBy(index)
    return df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def first_n_ordered(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` rows by a column that is no dense index: a top-k of size ``n``."""
    return df.orderBy(*by).limit(n)


def pairs_from_gold(
    samples: DataFrame, split: str = "train", n: int | None = None, seed: int = 0
) -> DataFrame:
    """Gold against a perturbed copy of it, for the first ``n`` rows of a split.

    A row without a target (its annotation was bad) gives no pair; ``without_target`` lists
    such rows.  Any split other than ``train`` reads the held-out rows.  If the samples carry
    ``members`` (top-level keys with their JSON text) no parse is needed.
    """
    stored = "train" if split == "train" else "validation"
    chosen = first_n(samples.where(F.col("split") == stored), n).where("target_json IS NOT NULL")
    if "members" not in samples.columns:
        chosen = chosen.withColumn("members", parse_json(F.col("target_json"), "members")["members"])
    text, members, draws = F.col("target_json"), F.col("members"), F.col("_draws")
    drawn = chosen.withColumn("_draws", key_digest(seed, F.lit(split), F.col("index"))).withColumn(
        "mode", choose_mode(text, members, draws)
    )
    return drawn.select(
        F.lit(split).alias("split"),
        F.col("index").cast("bigint").alias("index"),
        F.col("target_json").alias("chosen"),
        perturb(text, members, draws, F.col("mode")).alias("rejected"),
        "mode",
    )


def without_target(samples: DataFrame) -> DataFrame:
    """The rows that ``pairs_from_gold`` leaves out, with their reason if one is known."""
    return samples.where("target_json IS NULL")


def is_wrong(json_valid: Column, field_f1: Column) -> Column:
    """Not parseable or not every field right; a missing flag or score counts as wrong."""
    return ~F.coalesce(json_valid, F.lit(False)) | (F.coalesce(field_f1, F.lit(0.0)) < 1.0)


def pairs_from_predictions(preds: DataFrame, split: str) -> DataFrame:
    """Gold (minified text) against what the model said, where it was wrong.

    ``field_f1`` is the stored score, rounded to four decimals.  Rows without gold give no pair.
    """
    return preds.where("gold IS NOT NULL").where(is_wrong(F.col("json_valid"), F.col("field_f1"))).select(
        F.lit(split).alias("split"),
        F.col("index").cast("bigint").alias("index"),
        F.col("gold").alias("chosen"),
        F.col("raw").alias("rejected"),
    )


def attach_samples(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Pairs with their sample's columns; a pair without a sample keeps a reason.

    A NULL split means ``train``.  Samples must be unique per (split, index).  The
    join has no hint and two plain shuffles: a popular sample makes the left side
    skewed, and AQE splits it.
    """
    keyed = pairs.withColumn("split", F.coalesce("split", F.lit("train")))
    known = with_unique_check(samples, "split", "index").withColumn("_found", F.lit(True))
    return (
        keyed.join(known, ["split", "index"], "left")
        .withColumn("bad_reason", F.when(F.col("_found").isNull(), "no such sample"))
        .drop("_found")
    )


def to_preference_rows(
    pairs: DataFrame, samples: DataFrame, instruction: str, image: str = "image_ref"
) -> DataFrame:
    """Images, prompt, chosen and rejected as message arrays; ``bad_reason`` if unmatched."""
    joined = attach_samples(pairs, samples.select("split", "index", image))

    def answer(text: str) -> Column:
        return F.array(message("assistant", text_part(F.col(text))).cast(MESSAGE_TYPE))

    return joined.select(
        "split",
        "index",
        F.array(image).alias("images"),
        build_messages(instruction).alias("prompt"),
        answer("chosen").alias("chosen"),
        answer("rejected").alias("rejected"),
        "bad_reason",
    )
