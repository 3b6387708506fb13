"""Registered queries: chat messages, chat text, encoding, batches, supervision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions.chat import (
    EOS_ID,
    IGNORE_INDEX,
    IMAGE_ID,
    MESSAGE_TYPE,
    PAD_ID,
    RECEIPT_INSTRUCTION,
    WORD_ID,
    build_messages,
    message,
    pad_id,
    render_chat,
    text_part,
    tokenize,
)
from fieldmill.functions.receipt import SYNTHETIC_SCHEMA
from fieldmill.functions.schema import schema_prompt
from fieldmill.operators.batching import (
    assign_batches,
    concat_ragged,
    dense_index,
    encode,
    fill_values,
    pad_batches,
    prompt_len_lookup,
    prompt_lengths,
    ragged_offsets,
    supervision_report,
)
from fieldmill.plans.base import RECEIPTS, query, receipts, table, with_sql
from fieldmill.sources.samples import spread

INSTRUCTION = "Answer the receipt question."
BUDGET = 256
BATCH = 8


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a dense index."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def image_tokens() -> Column:
    """One token per started 280 x 280 tile, as a stand-in for a model's image grid."""
    return (F.ceil(F.col("width") / 280) * F.ceil(F.col("height") / 280)).cast("int")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers to a fixed instruction, with image sizes drawn from their keys."""
    return turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.col("text").alias("target_json"),
        (F.lit(200) + (F.col("conv_id") % 5) * 150).alias("width"),
        (F.lit(250) + (F.col("turn") % 3) * 200).alias("height"),
    )


# Java's and RE2's \s differ on rare blanks; the tables hold these ones only.
_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


def sql_ids(text: str) -> str:
    return (
        f"list_transform({_WORDS.format(text)}, "
        f"lambda w: ({WORD_ID} + ('0x' || substr(md5(w), 1, 8))::BIGINT % 1000)::INT)"
    )


SAMPLES = f"""
sized AS (
  SELECT conv_id, turn, text, 200 + (conv_id % 5) * 150 AS width, 250 + (turn % 3) * 200 AS height
  FROM conversations
), tiled AS (
  SELECT *, (ceil(width / 280) * ceil(height / 280))::INT AS tiles FROM sized
), tokens AS (
  SELECT *, list_transform(range(tiles), lambda j: ({IMAGE_ID} + j)::INT)
      || {sql_ids(f"'{INSTRUCTION} ASSISTANT:'")} AS prompt_ids,
    {sql_ids('text')} AS answer_ids
  FROM tiled
), encoded AS (
  SELECT conv_id, turn, width, height, tiles, len(prompt_ids) + len(answer_ids) AS n_tokens,
    (prompt_ids || answer_ids)[1:{BUDGET}] AS input_ids,
    least(len(prompt_ids), {BUDGET}, len(prompt_ids) + len(answer_ids)) AS prompt_len
  FROM tokens
), labelled AS (
  SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN i <= prompt_len THEN {IGNORE_INDEX}
      ELSE x END) AS labels,
    list_transform(input_ids, lambda x, i: CASE WHEN i <= least(tiles, {BUDGET}) THEN 1 ELSE 0 END)
      AS mm_token_type_ids
  FROM encoded
)"""


def joined(name: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), " ")


def encoded(rows: DataFrame) -> DataFrame:
    return encode(rows, INSTRUCTION, max_len=BUDGET, image_tokens=image_tokens())


def encoded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spread(samples(spark, sf_dir)))




@query(
    "chat_messages",
    """SELECT o_orderkey AS seed, len(m) AS messages, m[1].role AS first_role, m[2].role AS last_role,
      m[1].parts AS first_parts, m[1].body AS first_text, md5(m[2].body) AS answer_md5 FROM (
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [{'role': 'user', 'parts': 'image,text',
          'body': 'Read order ' || o_orderkey}]
        ELSE [{'role': 'user', 'parts': 'image,text', 'body': 'Read order ' || o_orderkey},
          {'role': 'assistant', 'parts': 'text', 'body': o_orderpriority}] END AS m FROM orders)""",
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant messages; a third of the rows have no answer yet."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    target = F.when(key % 3 != 0, F.col("o_orderpriority"))
    instruction = F.concat(F.lit("Read order "), key.cast("string"))
    first, last = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    parts = F.array_join(F.transform(first["content"], lambda p: p["type"]), ",")
    return rows.withColumn("m", build_messages(instruction, target)).select(
        key.alias("seed"),
        F.size("m").cast("bigint").alias("messages"),
        first["role"].alias("first_role"),
        last["role"].alias("last_role"),
        parts.alias("first_parts"),
        F.get(first["content"], F.lit(1))["text"].alias("first_text"),
        F.md5(F.get(last["content"], F.lit(0))["text"]).alias("answer_md5"),
    )


@query(
    "chat_text",
    """SELECT conv_id, turn, md5(CASE role WHEN 'user' THEN text
        WHEN 'assistant' THEN 'ASSISTANT: ' || text ELSE 'SYSTEM: ' || text END) AS turn_md5,
      length(text) AS chars FROM conversations""",
)
def chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn rendered by its role."""
    one = F.array(message(F.col("role"), text_part(F.col("text"))).cast(MESSAGE_TYPE))
    return turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.md5(render_chat(one)).alias("turn_md5"),
        F.length("text").cast("bigint").alias("chars"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_FULL_INSTRUCTION = RECEIPT_INSTRUCTION + "\n" + schema_prompt(SYNTHETIC_SCHEMA)


@query(
    "prompt_prefix",
    with_sql(RECEIPTS)
    + f""" SELECT seed, md5('<img> ' || {_quoted(_FULL_INSTRUCTION)} || ' ASSISTANT: ' || target_json)
      AS full_md5, true AS is_prefix FROM receipts""",
)
def prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full chat text of every receipt; the generation prompt is a strict prefix of it."""
    full = render_chat(build_messages(_FULL_INSTRUCTION, F.col("target_json")))
    prompt = render_chat(build_messages(_FULL_INSTRUCTION), add_generation_prompt=True)
    strict = F.startswith(full, prompt) & (F.length(full) > F.length(prompt))
    return receipts(spark, sf_dir).select(
        "seed", F.md5(full).alias("full_md5"), strict.alias("is_prefix")
    )


@query(
    "tokenize",
    f"""SELECT doc_id, len(ids) AS tokens, md5(array_to_string(ids, ' ')) AS ids_md5
    FROM (SELECT doc_id, {sql_ids('text')} AS ids FROM documents)""",
)
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as whitespace tokens."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.transform(tokenize(F.col("text")), lambda t: t["id"])
    return rows.withColumn("ids", ids).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("tokens"),
        F.md5(joined("ids")).alias("ids_md5"),
    )


@query(
    "label_mask",
    with_sql(SAMPLES)
    + """ SELECT conv_id, turn, n_tokens, prompt_len, md5(array_to_string(input_ids, ' ')) AS ids_md5,
      md5(array_to_string(labels, ' ')) AS labels_md5,
      md5(array_to_string(mm_token_type_ids, ' ')) AS kinds_md5, len(input_ids) AS attended
    FROM labelled""",
)
def label_mask_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, truncation, token kinds, attention and loss mask per sample."""
    return encoded_samples(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("prompt_len").cast("bigint").alias("prompt_len"),
        F.md5(joined("input_ids")).alias("ids_md5"),
        F.md5(joined("labels")).alias("labels_md5"),
        F.md5(joined("mm_token_type_ids")).alias("kinds_md5"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attended"),
    )


@query(
    "prompt_lengths",
    with_sql(SAMPLES)
    + " SELECT width, height, prompt_len, count(*) AS rows FROM labelled GROUP BY ALL",
)
def prompt_lengths_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt length by image size, looked up once per size."""
    rows = samples(spark, sf_dir)
    length = prompt_lengths(INSTRUCTION, image_tokens(), max_len=BUDGET)
    return (
        prompt_len_lookup(rows, ["width", "height"], length)
        .groupBy("width", "height", F.col("prompt_len").cast("bigint").alias("prompt_len"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    "supervision_report",
    with_sql(SAMPLES)
    + f""" SELECT width, count(*) AS rows, sum(len(input_ids))::BIGINT AS tokens,
      sum(len(input_ids) - prompt_len)::BIGINT AS supervised_tokens,
      sum((n_tokens > {BUDGET})::INT)::BIGINT AS truncated_rows,
      count(*) FILTER (len(input_ids) = prompt_len) AS empty_rows FROM labelled GROUP BY width""",
)
def supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervision_report(encoded_samples(spark, sf_dir), BUDGET, "width")


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed first, while the rows are still plain text, then encoded."""
    rows = spread(dense_index(samples(spark, sf_dir), "conv_id", "turn"))
    return assign_batches(encoded(rows), BATCH)


_BATCHED = f"""
numbered AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS "index" FROM labelled
), grouped AS (
  SELECT *, "index" // {BATCH} AS batch FROM numbered
), padded AS (
  SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS longest FROM grouped
)"""


def _sql_pad(name: str, fill: int, side: str) -> str:
    extra = f"list_resize([]::INT[], longest - len(input_ids), {fill})"
    parts = f"{extra} || {name}" if side == "left" else f"{name} || {extra}"
    return f"md5(array_to_string({parts}, ' ')) AS {name}_md5"


def _padded_sql(side: str) -> str:
    ones = "list_resize([]::INT[], len(input_ids), 1)"
    cells = [
        _sql_pad("input_ids", PAD_ID, side),
        _sql_pad("labels", IGNORE_INDEX, side),
        _sql_pad("mm_token_type_ids", 0, side),
        _sql_pad("attention_mask", 0, side),
    ]
    return (
        with_sql(SAMPLES, _BATCHED)
        + f' SELECT "index", batch, longest AS length, {", ".join(cells)} '
        + f"FROM (SELECT *, {ones} AS attention_mask FROM padded)"
    )


def _padded(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    rows = pad_batches(batched(spark, sf_dir), side)
    return rows.select(
        "index",
        "batch",
        F.size("input_ids").cast("bigint").alias("length"),
        *[F.md5(joined(name)).alias(f"{name}_md5") for name in fill_values()],
    )


@query("pad_batches", _padded_sql("right"))
def pad_batches_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training batches, padded on the right."""
    return _padded(spark, sf_dir, "right")


@query("pad_batches_left", _padded_sql("left"))
def pad_batches_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation batches, padded on the left."""
    return _padded(spark, sf_dir, "left")


@query(
    "assign_batches",
    f"""SELECT o_orderkey // {BATCH} AS batch, count(*) AS rows, min(o_orderkey) AS first,
      max(o_orderkey) AS last FROM orders GROUP BY 1""",
)
def assign_batches_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    return (
        assign_batches(rows, BATCH)
        .groupBy("batch")
        .agg(
            F.count("*").alias("rows"),
            F.min("index").alias("first"),
            F.max("index").alias("last"),
        )
    )


def vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector cut into one to four patches: 4 numbers each, the last has all that is left."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("index"), "embedding"
    )
    patches = F.transform(
        F.sequence(F.lit(0), (F.col("index") % 4).cast("int")),
        lambda i: F.slice(
            "embedding", i * 4 + 1, F.when(i < F.col("index") % 4, 4).otherwise(F.size("embedding"))
        ),
    )
    return assign_batches(rows.withColumn("patches", patches), BATCH)


@query(
    "concat_ragged",
    f"""SELECT vec_id // {BATCH} AS batch, sum(1 + vec_id % 4)::BIGINT AS rows,
      string_agg(start::VARCHAR, ',' ORDER BY vec_id) AS offsets,
      round(sum(total), 3) AS checksum FROM (
      SELECT *, coalesce(sum(1 + vec_id % 4) OVER (PARTITION BY vec_id // {BATCH} ORDER BY vec_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total
      FROM embeddings) GROUP BY 1""",
)
def concat_ragged_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's vision rows under one another."""
    gathered = concat_ragged(vision(spark, sf_dir), "patches")
    total = F.aggregate(
        F.flatten("patches"), F.lit(0.0), lambda a, x: a + x.cast("double")
    )
    return gathered.select(
        "batch",
        F.size("patches").cast("bigint").alias("rows"),
        F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"),
        F.round(total, 3).alias("checksum"),
    )


@query(
    "ragged_offsets",
    f"""SELECT vec_id AS "index", vec_id // {BATCH} AS batch,
      coalesce(sum(1 + vec_id % 4) OVER (PARTITION BY vec_id // {BATCH} ORDER BY vec_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM embeddings""",
)
def ragged_offsets_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vision(spark, sf_dir)
    return ragged_offsets(rows, F.size("patches")).select("index", "batch", "offset")


@query(
    "pad_id",
    f"""SELECT event_type, sum(coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 5 END, {EOS_ID}))::BIGINT
      AS pad_sum FROM events GROUP BY event_type""",
)
def pad_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pad ids with the end-of-sequence id where there is none."""
    own = F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5)
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.sum(pad_id(own, F.lit(EOS_ID))).alias("pad_sum"))
    )


