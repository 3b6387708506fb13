"""Raw answers against gold: validity, field precision/recall/F1, micro scores per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.functions.strict_json import parse_pair
from fieldmill.functions.text import round4, top_key
from fieldmill.registry import register_metric

PARSED_COLUMNS = (
    "gold_valid", "json_valid", "schema_valid", "exact_match", "gold_fields", "pred_fields",
)
COUNTED_COLUMNS = ("tp", "fp", "fn", "precision", "recall", "field_f1", "f1_millionths")
RATES = ("json_valid_rate", "schema_valid_rate", "field_f1", "exact_match")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows; the job fails if a key comes twice.

    The window wants the rows partitioned and sorted by the key, just as the
    sort-merge join after it does, so the check adds no shuffle to that join.
    """
    order = Window.partitionBy(*keys).orderBy(*keys)
    shown = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return (
        df.withColumn("_copy", F.row_number().over(order))
        .where(
            F.when(
                F.col("_copy") > 1,
                F.raise_error(F.concat(F.lit("duplicate key: "), shown)).cast("boolean"),
            ).otherwise(F.lit(True))
        )
        .drop("_copy")
    )


def with_unique_check(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows; the job fails if a key comes twice.

    For the side of a join whose other side may be skewed: the check is a subquery
    over the keys alone, combined before its shuffle, and the join's own input stays
    a plain shuffle, which AQE can split.  ``require_unique`` saves that extra pass
    where both sides are unique.
    """
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    copies = twice.agg(F.count("*").alias("n")).scalar()
    return df.where(
        F.when(copies == 0, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"not unique: {', '.join(keys)}")).cast("boolean")
        )
    )


def zip_strict(preds: DataFrame, golds: DataFrame, on: str = "index") -> DataFrame:
    """One row per index with both sides; a missing or repeated index fails the job."""
    left = require_unique(preds, on).withColumn("_pred", F.lit(True))
    right = require_unique(golds, on).withColumn("_gold", F.lit(True))
    joined = left.join(right, on, "full_outer")
    return joined.where(
        F.when(F.col("_pred") & F.col("_gold"), F.lit(True)).otherwise(
            F.raise_error(
                F.concat(F.lit("only one side has index "), F.col(on).cast("string"))
            ).cast("boolean")
        )
    ).drop("_pred", "_gold")


@register_metric("field_prf")
def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 of counts; 0 where a denominator is 0."""
    zero = F.lit(0.0)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero)
    f1 = F.when(
        precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)
    ).otherwise(zero)
    return {"precision": precision, "recall": recall, "f1": f1}


def f1_millionths(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 in whole parts per million, 2tp / (2tp + fp + fn): sums of it are exact."""
    spread = 2 * tp + fp + fn
    return F.when(spread > 0, F.floor(2 * tp * 1_000_000 / spread)).otherwise(F.lit(0)).cast("bigint")


def score(
    df: DataFrame, gold: str = "gold", raw: str = "raw", schema: dict | None = None
) -> DataFrame:
    """Adds flags, field counts and scores to rows that hold gold text and raw answer.

    ``gold_fields`` and ``pred_fields`` stay in the row for the per-key scores.  An
    answer without a parseable object scores 0 whatever the gold holds; two empty
    objects score 1.  Rows whose gold is not JSON get ``gold_valid = false``.  Scores the
    rows bring along are replaced.  Filters belong before: none passes below the parse.
    """
    parsed = df.withColumn("_parsed", parse_pair(F.col(gold), F.col(raw), schema))
    kept = [c for c in df.columns if c not in PARSED_COLUMNS + COUNTED_COLUMNS]
    flat = parsed.select(*kept, *[F.col(f"_parsed.{c}").alias(c) for c in PARSED_COLUMNS])
    return add_counts(flat)


def add_counts(flat: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 out of two field sets in the row."""
    counted = flat.withColumn("tp", F.size(F.array_intersect("gold_fields", "pred_fields"))).withColumns(
        {"fp": F.size("pred_fields") - F.col("tp"), "fn": F.size("gold_fields") - F.col("tp")}
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    empty = F.col("json_valid") & (tp + fp + fn == 0)
    scores = {name: F.when(empty, F.lit(1.0)).otherwise(c) for name, c in prf(tp, fp, fn).items()}
    return counted.withColumns(
        {
            "precision": scores["precision"],
            "recall": scores["recall"],
            "field_f1": scores["f1"],
            "f1_millionths": F.when(empty, F.lit(1_000_000)).otherwise(f1_millionths(tp, fp, fn)),
        }
    )


def token_key(token: Column) -> Column:
    """Top-level key of a ``length:path value`` field token."""
    size = F.substring_index(token, ":", 1)
    return top_key(F.substring(token, F.length(size) + 2, size.cast("int")))


def key_counts(scored: DataFrame, *keep: str) -> DataFrame:
    """One row per field with its key and a 1 under tp, fp or fn.

    The fields of a row stand in one list, by kind, and their places tell the kind: no lambda,
    so what is done for every field is compiled.
    """
    sets = scored.select(
        *keep,
        F.array_intersect("gold_fields", "pred_fields").alias("_both"),
        F.array_except("pred_fields", "gold_fields").alias("_invented"),
        F.array_except("gold_fields", "pred_fields").alias("_missed"),
    )
    fields = sets.select(
        *keep,
        F.size("_both").alias("_tp"),
        F.size("_invented").alias("_fp"),
        F.posexplode(F.concat("_both", "_invented", "_missed")).alias("_pos", "_token"),
    )
    right = F.col("_pos") < F.col("_tp")
    wrong = ~right & (F.col("_pos") < F.col("_tp") + F.col("_fp"))
    return fields.select(
        *keep,
        token_key(F.col("_token")).alias("field"),
        right.cast("int").alias("tp"),
        wrong.cast("int").alias("fp"),
        (~right & ~wrong).cast("int").alias("fn"),
    )


def per_field(scored: DataFrame, *by: str) -> DataFrame:
    """Micro counts and scores per top-level key, over the union of both sides' keys.

    Rows whose gold is no JSON are left out, as in ``summarize`` and ``report``.
    """
    usable = scored.where("gold_valid") if "gold_valid" in scored.columns else scored
    grouped = (
        key_counts(usable, *by)
        .groupBy(*by, "field")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    )
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return grouped.select(
        *by, "field", "tp", "fp", "fn", *[round4(c).alias(n) for n, c in scores.items()]
    )


def summary_aggregates() -> list[Column]:
    """The sums a summary needs; plain aggregates, so they fit batch and stream alike."""

    def count(flag: str) -> Column:
        return F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0)).alias(f"n_{flag}")

    return [
        F.count("*").alias("n"),
        count("json_valid"),
        count("schema_valid"),
        count("exact_match"),
        F.coalesce(F.sum("f1_millionths"), F.lit(0)).alias("f1_millionths"),
        F.sum("field_f1").alias("f1_sum"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """The four rates beside their counts, rounded to four decimals, 0 for no rows."""
    n = F.col("n")

    def rate(total: str) -> Column:
        return F.when(n > 0, round4(F.col(total) / n)).otherwise(F.lit(0.0))

    return counts.withColumns(
        {
            "json_valid_rate": rate("n_json_valid"),
            "schema_valid_rate": rate("n_schema_valid"),
            "field_f1": rate("f1_sum"),
            "exact_match": rate("n_exact_match"),
        }
    ).drop("f1_sum")


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """Counts and rates over all rows, or per group; macro F1 is the mean over rows."""
    usable = scored.where("gold_valid")
    grouped = usable.groupBy(*by) if by else usable
    return with_rates(grouped.agg(*summary_aggregates()))


def evaluate(
    preds: DataFrame,
    golds: DataFrame,
    schema: dict | None = None,
    limit: int | None = None,
    on: str = "index",
) -> DataFrame:
    """Predictions zipped with golds and scored; ``limit`` takes the first golds by index and the
    predictions up to the last of them."""
    if limit is not None:
        # the bound comes from the keys alone, so no gold is computed for it
        last = golds.select(on).orderBy(on).limit(limit).agg(F.max(on).alias("last")).scalar()
        golds = golds.orderBy(on).limit(limit)
        preds = preds.where(F.col(on) <= last)
    return score(zip_strict(preds, golds, on), schema=schema)


def report(scored: DataFrame) -> DataFrame:
    """Summary and per-key counts in one pass over the scored rows.

    Each row emits its own summary line (``field`` NULL) beside its field lines;
    one aggregation then yields both, so the parse runs once and nothing is cached.
    """
    none = F.lit(0)

    def entry(field: Column, **values: Column) -> Column:
        names = ["n", "json_valid", "schema_valid", "exact", "millionths", "tp", "fp", "fn"]
        return F.struct(
            field.alias("field"),
            *[values.get(name, none).cast("bigint").alias(name) for name in names],
        )

    own = entry(
        F.lit(None).cast("string"),
        n=F.lit(1),
        json_valid=F.col("json_valid"),
        schema_valid=F.col("schema_valid"),
        exact=F.col("exact_match"),
        millionths=F.col("f1_millionths"),
    )
    one = F.lit(1)
    lines = F.concat(
        F.array(own),
        F.transform(
            F.array_intersect("gold_fields", "pred_fields"), lambda t: entry(token_key(t), tp=one)
        ),
        F.transform(
            F.array_except("pred_fields", "gold_fields"), lambda t: entry(token_key(t), fp=one)
        ),
        F.transform(
            F.array_except("gold_fields", "pred_fields"), lambda t: entry(token_key(t), fn=one)
        ),
    )
    return (
        scored.where("gold_valid")
        .select(F.inline(lines))
        .groupBy("field")
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("n", "json_valid", "schema_valid", "exact", "millionths", "tp", "fp", "fn")
            ]
        )
    )


def match_fields(pred_fields: DataFrame, gold_fields: DataFrame, on: str = "index") -> DataFrame:
    """Relational twin of the in-row match: tp, fp, fn per ``(index, field)``.

    Both sides are ``(index, path, value)`` rows.  Copies collapse before the
    shuffle on all three columns, so neither a huge document nor a field value that
    fills a third of the rows ends up in one task.
    """

    def side(df: DataFrame, pred: int, gold: int) -> DataFrame:
        return df.select(on, "path", "value", F.lit(pred).alias("p"), F.lit(gold).alias("g"))

    return match_cells(side(pred_fields, 1, 0).unionByName(side(gold_fields, 0, 1)), on)


def match_cells(cells: DataFrame, on: str = "index") -> DataFrame:
    """``match_fields`` over one frame ``(index, path, value, p, g)``: p marks predicted cells, g
    gold ones.  For cells of both sides that come from the same rows."""
    distinct = cells.groupBy(on, "path", "value").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    p, g = F.col("p"), F.col("g")
    return (
        distinct.withColumn("field", top_key(F.col("path")))
        .groupBy(on, "field")
        .agg(
            F.sum(p * g).alias("tp"),
            F.sum(p * (1 - g)).alias("fp"),
            F.sum(g * (1 - p)).alias("fn"),
        )
    )


def key_conformance(pred_keys: DataFrame, schema_keys: list[str], key: str = "key") -> DataFrame:
    """Keys a schema does not know and schema keys nobody predicted, with row counts.

    The keys are counted once, combined before the shuffle; the join sees one row per
    distinct key.
    """
    declared = (
        pred_keys.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(k) for k in schema_keys])).alias(key))
        .withColumn("_declared", F.lit(True))
    )
    counts = pred_keys.groupBy(key).agg(F.count("*").alias("rows"))
    status = F.when(F.col("rows").isNull(), "never").when(F.col("_declared").isNull(), "unknown")
    return (
        counts.join(declared, key, "full_outer")
        .select(status.alias("status"), key, F.coalesce("rows", F.lit(0)).alias("rows"))
        .where(F.col("status").isNotNull())
    )


def compare_models(metrics: DataFrame) -> DataFrame:
    """Long ``(model, metric, value)`` rows -> baseline, adapter and their difference."""
    wide = metrics.groupBy("metric").pivot("model", ["baseline", "adapter"]).agg(F.max("value"))
    return wide.withColumn("delta", F.col("adapter") - F.col("baseline"))


def leakage(train: DataFrame, held_out: DataFrame, text: str) -> DataFrame:
    """Texts both sides hold, with their number of rows on each side; NULL is no text.

    Both sides go through one aggregation by content hash that is combined before
    the shuffle, so a text with very many copies costs no more than any other.
    """

    def side(df: DataFrame, train_row: int) -> DataFrame:
        return df.where(F.col(text).isNotNull()).select(
            F.unhex(F.sha2(F.col(text), 256)).alias("content"),
            F.lit(train_row).cast("bigint").alias("t"),
        )

    counts = (
        side(train, 1)
        .unionByName(side(held_out, 0))
        .groupBy("content")
        .agg(F.sum("t").alias("n_train"), F.sum(1 - F.col("t")).alias("n_eval"))
    )
    return counts.where((F.col("n_train") > 0) & (F.col("n_eval") > 0)).withColumn(
        "content", F.lower(F.hex("content"))
    )
