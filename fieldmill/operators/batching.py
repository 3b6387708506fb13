"""Training rows: encoded samples, fixed-size batches, padding, ragged rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.functions.chat import (
    IGNORE_INDEX,
    IMAGE_TOKENS,
    PAD_ID,
    ChatTemplate,
    attention_mask,
    build_messages,
    label_mask,
    render_chat,
    tokenize,
    truncate_tokens,
)
from fieldmill.session import work_folder


# (text, image tokens) -> array of (id, kind)
Tokenizer = Callable[[Column, "int | Column"], Column]


def dense_index(
    df: DataFrame, *by: str, name: str = "index", place: str | None = None
) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of ``by`` (unique), without a single-task window.

    The rows are range-sorted and written once to ``place`` (a new folder in the shared
    checkpoint folder by default), each with its task number and place in the task.  Only one row count per task is then
    summed up and joined back, so the second step moves no data.
    """
    spark = df.sparkSession
    place = place or work_folder(spark, "dense-index")
    mark = F.monotonically_increasing_id()
    df.orderBy(*by).withColumn("_mark", mark).write.parquet(place)
    stored = spark.read.schema(df.withColumn("_mark", mark).schema).parquet(place)
    placed = stored.withColumns(
        {
            "_part": F.shiftright("_mark", 33),
            "_at": F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    # One row per task of the sort: its size is bounded by the partition count.
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_part", "_start", "_at", "_mark")
    )


def assign_batches(df: DataFrame, size: int, index: str = "index") -> DataFrame:
    """Batch number of a dense index; the last batch may be short."""
    return df.withColumn("batch", F.floor(F.col(index) / size).cast("bigint"))


def prompt_lengths(
    instruction: str | Column,
    image_tokens: int | Column = IMAGE_TOKENS,
    template: ChatTemplate | None = None,
    max_len: int | None = None,
    tokenizer: Tokenizer = tokenize,
) -> Column:
    """Tokens of the prompt alone, cut at the sequence budget as the full text is."""
    prompt = render_chat(build_messages(instruction), template, add_generation_prompt=True)
    length = F.size(tokenizer(prompt, image_tokens))
    return length if max_len is None else F.least(length, F.lit(max_len))


def prompt_len_lookup(
    df: DataFrame, keys: list[str], length: Column, salts: int | None = None
) -> DataFrame:
    """Adds ``prompt_len``, computed once per distinct key instead of once per row.

    Worth it where ``length`` is dear (an external tokenizer).  The key table has no
    broadcast hint: AQE broadcasts it when its measured size allows.  Otherwise the
    rows of one key, however many, are dealt to ``salts`` tasks by a hash of the row (as many
    as the session has shuffle partitions), and the key table is repeated that often.  NULL
    keys are keys like any other: every row stays.
    """
    if salts is None:
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = (
        df.select(*keys)
        .distinct()
        .withColumn("prompt_len", length)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    known = table.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_salt", "prompt_len")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = salted.join(known, [*same, salted["_salt"] == known["_salt"]])
    return joined.select(*df.columns, "prompt_len")


def encode(
    df: DataFrame,
    instruction: str | Column,
    target: str = "target_json",
    max_len: int = 2048,
    image_tokens: int | Column = IMAGE_TOKENS,
    template: ChatTemplate | None = None,
    prompt_len: str | None = None,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """Adds ``input_ids, mm_token_type_ids, labels, attention_mask, prompt_len, n_tokens``.

    ``n_tokens`` counts the tokens before truncation.  The prompt's part of a row
    is never supervised; a row cut inside its prompt has nothing to learn.
    """
    full = render_chat(build_messages(instruction, F.col(target)), template)
    length = (
        F.col(prompt_len)
        if prompt_len
        else prompt_lengths(instruction, image_tokens, template, max_len, tokenizer)
    )
    tokens = df.withColumn("_tokens", tokenizer(full, image_tokens))
    cut = tokens.withColumns(
        {"n_tokens": F.size("_tokens"), "_kept": truncate_tokens(F.col("_tokens"), max_len)}
    )
    ids = cut.withColumns(
        {
            "input_ids": F.transform("_kept", lambda t: t["id"]),
            "mm_token_type_ids": F.transform("_kept", lambda t: t["kind"]),
            "prompt_len": F.least(length, F.size("_kept")),
        }
    ).drop("_tokens", "_kept")
    return ids.withColumns(
        {
            "labels": label_mask(F.col("input_ids"), F.col("prompt_len")),
            "attention_mask": attention_mask(F.col("input_ids")),
        }
    )


def fill_values(pad: int = PAD_ID) -> dict[str, int]:
    """What each per-token column is padded with."""
    return {
        "input_ids": pad,
        "labels": IGNORE_INDEX,
        "attention_mask": 0,
        "mm_token_type_ids": 0,
    }


def pad_batches(
    df: DataFrame,
    side: str = "right",
    fills: dict[str, int] | None = None,
    batch: str = "batch",
    length_of: str = "input_ids",
) -> DataFrame:
    """Pads each per-token column to the longest row of its batch.

    Training pads right, generation left.  A batch holds a fixed number of rows,
    so the window over it stays small whatever the table's size.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    fills = fill_values() if fills is None else fills
    longest = F.max(F.size(length_of)).over(Window.partitionBy(batch))
    sized = df.withColumn("_gap", longest - F.size(length_of))

    def padded(name: str, fill: int) -> Column:
        extra = F.array_repeat(F.lit(fill), F.col("_gap"))
        return F.concat(extra, F.col(name)) if side == "left" else F.concat(F.col(name), extra)

    return sized.withColumns({name: padded(name, fill) for name, fill in fills.items()}).drop("_gap")


def concat_ragged(
    df: DataFrame, rows: str, batch: str = "batch", index: str = "index"
) -> DataFrame:
    """All vision rows of a batch under one another, in index order, with sample offsets.

    Only a batch's own rows (a fixed number) come together.
    """
    entry = F.struct(F.col(index).alias("index"), F.col(rows).alias("rows"))
    gathered = df.groupBy(batch).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    sized = gathered.withColumn("_sizes", F.transform("_entries", lambda e: F.size(e["rows"])))
    return sized.select(
        batch,
        F.flatten(F.transform("_entries", lambda e: e["rows"])).alias(rows),
        F.transform(
            "_sizes",
            lambda s, i: F.aggregate(
                F.slice("_sizes", F.lit(1), i), F.lit(0), lambda total, x: total + x
            ),
        ).alias("offsets"),
    )


def ragged_offsets(
    df: DataFrame, size: Column, batch: str = "batch", index: str = "index"
) -> DataFrame:
    """Adds ``offset``: where each sample's rows start inside its batch."""
    earlier = (
        Window.partitionBy(batch).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn("offset", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("bigint"))


def supervision_report(encoded: DataFrame, max_len: int, *by: str) -> DataFrame:
    """Rows, tokens, supervised tokens, truncated rows and rows with nothing to learn."""
    learned = F.size(F.filter("labels", lambda x: x != IGNORE_INDEX))
    rows = encoded.select(
        *by,
        F.size("input_ids").alias("tokens"),
        learned.alias("learned"),
        (F.col("n_tokens") > max_len).cast("bigint").alias("truncated"),
    )
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("learned"), F.lit(0)).alias("supervised_tokens"),
        F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated_rows"),
        F.count_if(F.col("learned") == 0).alias("empty_rows"),
    )
