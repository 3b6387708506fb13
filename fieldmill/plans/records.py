"""Registered queries: sources, annotation normalizing, synthetic receipts, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.functions.receipt import (
    EVAL_START,
    layout_lines,
    menu_items,
    merge_objects,
    minify_json,
    normalize_ground_truth,
)
from fieldmill.functions.schema import schema_prompts
from fieldmill.functions.tables import register_sql
from fieldmill.functions.text import plan_downscale, strip_thousands, top_key
from fieldmill.operators.batching import dense_index
from fieldmill.operators.leakage import canonical_leakage
from fieldmill.operators.pairs import first_n, first_n_ordered
from fieldmill.operators.predict import predict
from fieldmill.operators.scoring import leakage, score, summarize
from fieldmill.plans.base import (
    RECEIPTS,
    annotations,
    hexnum,
    query,
    receipts,
    sql_digest,
    table,
    with_sql,
)
from fieldmill.registry import get_metric
from fieldmill.session import work_folder
from fieldmill.sources.images import resize_images
from fieldmill.sources.samples import (
    generate_receipts,
    normalized,
    preview,
    read_samples,
    split_counts,
    spread,
    synthetic_splits,
    write_metrics,
)

# ---------------------------------------------------------------- annotations

_SHAPE = hexnum(sql_digest("annotation", "seed"), 1, 4, 8)
ANNOTATED = f"""
shaped AS (SELECT *, {_SHAPE} AS shape FROM receipts),
targets AS (
  SELECT seed AS "index", split, shape, CASE
      WHEN shape = 5 THEN []
      WHEN shape = 1 THEN items[1:1]
      WHEN shape = 7 THEN list_transform(items, lambda i: {{'name': i.name, 'count': i.count,
        'price': '1' || i.price}})
      ELSE items END AS menu,
    CASE WHEN shape = 5 THEN '' ELSE subtotal END AS subtotal,
    CASE WHEN shape = 5 THEN '' ELSE tax END AS tax,
    CASE WHEN shape IN (5, 6) THEN '' ELSE total END AS total
  FROM shaped
), rendered AS (
  SELECT *, '[' || array_to_string(list_transform(menu, lambda i: '{{"name":"' || i.name
    || '","count":"' || i.count || '","price":"' || i.price || '"}}'), ',') || ']' AS menu_json
  FROM targets
), normalized AS (
  SELECT *, '{{"menu":' || menu_json || ',"subtotal":"' || subtotal || '","tax":"' || tax
    || '","total":"' || total || '"}}' AS target_json FROM rendered
)"""
NORMALIZED = with_sql(RECEIPTS, ANNOTATED)


@query(
    "normalize_ground_truth",
    NORMALIZED + ' SELECT "index", split, target_json, NULL::VARCHAR AS bad_reason FROM normalized',
)
def normalize_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation text of all shapes, strictly parsed."""
    rows = annotations(spark, sf_dir).select("index", "split", "image_ref", "ground_truth")
    return normalized(rows).select("index", "split", "target_json", "bad_reason")


@query("minify_json", NORMALIZED + ' SELECT "index", target_json FROM normalized')
def normalize_annotations_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same targets without Python: typed struct, rendered minified."""
    target = normalize_ground_truth(F.col("ground_truth"))
    return annotations(spark, sf_dir).select("index", minify_json(target).alias("target_json"))


@query(
    "menu_items",
    NORMALIZED
    + """ SELECT "index", i.name, i.count, i.price FROM (
      SELECT "index", unnest(menu) AS i FROM normalized)""",
)
def menu_items_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.from_json("ground_truth", "gt_parse struct<menu:string>")["gt_parse"]["menu"]
    return annotations(spark, sf_dir).select("index", F.inline(menu_items(text)))


@query(
    "merge_objects",
    NORMALIZED
    + """ SELECT "index", key, value FROM (
      SELECT "index", unnest(['subtotal_price', 'tax_price']) AS key, unnest([subtotal, tax]) AS value,
        shape FROM normalized) WHERE shape <> 5""",
)
def merge_objects_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.from_json("ground_truth", "gt_parse struct<sub_total:string>")["gt_parse"]["sub_total"]
    return annotations(spark, sf_dir).select("index", F.explode(merge_objects(text)))


@query(
    "strip_thousands",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
      (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS amount
    FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)""",
)
def strip_thousands_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    amount = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    return rows.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        strip_thousands(F.concat(F.lit("  "), amount, F.lit(" \t"))).alias("amount"),
    )


# -------------------------------------------------------------------- sources


@query(
    "read_split",
    """SELECT doc_id AS "index", lang AS split, source AS image_ref, md5(text) AS text_md5
    FROM documents WHERE lang = 'en'""",
)
def read_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split of a sample source: split filter and column choice reach the scan."""
    rows = read_samples(
        spark,
        f"{sf_dir}/documents.parquet",
        split="en",
        columns={
            "index": "doc_id", "split": "lang", "image_ref": "source", "ground_truth": "text",
        },
    )
    return rows.select("index", "split", "image_ref", F.md5("ground_truth").alias("text_md5"))


@query(
    "first_n",
    with_sql(RECEIPTS) + ' SELECT split, "index", target_json FROM receipts WHERE "index" < 100',
)
def first_n_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows of each split, by dense index."""
    return first_n(receipts(spark, sf_dir), 100, by="split").select("split", "index", "target_json")


@query(
    "first_n_of_each",
    """SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r
      FROM documents) WHERE r <= 20""",
)
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each language, by an index that has gaps within a language."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return first_n(rows, 20, "doc_id", by="lang")


@query(
    "first_n_ordered",
    """SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 100""",
)
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows where there is no dense index."""
    rows = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    return first_n_ordered(rows, 100, "ts", "event_id").select("event_id", "user_id")


@query(
    "dense_index",
    """SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS "index"
    FROM conversations""",
)
def dense_index_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return dense_index(rows, "conv_id", "turn")


@query(
    "preview",
    with_sql(RECEIPTS)
    + """ SELECT split, "index", target_json, n AS rows, 'split,index,image_ref,target_json' AS columns
    FROM receipts JOIN (SELECT split, count(*) AS n FROM receipts GROUP BY split) USING (split)
    WHERE "index" < 3""",
)
def preview_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(
        receipts(spark, sf_dir).select("split", "index", "image_ref", "target_json"), 3
    )


@query("split_counts", "SELECT lang AS split, count(*) AS rows FROM documents GROUP BY lang")
def split_counts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"))
    return split_counts(rows)


# ---------------------------------------------------------- synthetic receipts


@query(
    "generate_receipts",
    with_sql(RECEIPTS) + ' SELECT seed, split, "index", target_json FROM receipts',
)
def generate_receipts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts(spark, sf_dir).select("seed", "split", "index", "target_json")


@query(
    "synthetic_splits",
    with_sql(
        RECEIPTS.replace(
            "FROM orders",
            "FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + 1000000 FROM orders)",
            1,
        )
    )
    + """ SELECT CASE WHEN seed < 1000000 THEN 'train' ELSE 'validation' END AS split, seed,
      md5(target_json) AS target_md5 FROM receipts""",
)
def synthetic_splits_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train seeds are the order keys, held-out seeds the same numbers from 1,000,000 on."""
    keys = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")))
    sides = F.array(
        F.struct(F.lit("train").alias("split"), F.col("key").alias("seed")),
        F.struct(F.lit("validation").alias("split"), (F.col("key") + 1_000_000).alias("seed")),
    )
    seeds = keys.select(F.inline(sides))
    return generate_receipts(seeds, "seed").select(
        "split", "seed", F.md5("target_json").alias("target_md5")
    )


@query(
    "synthetic_split_rows",
    with_sql(
        RECEIPTS.replace(
            "FROM orders",
            """FROM (SELECT range AS o_orderkey FROM range((SELECT count(*) FROM orders))
              UNION ALL SELECT 1000000 + range FROM range((SELECT count(*) FROM customer)))""",
            1,
        )
    )
    + """ SELECT CASE WHEN seed < 1000000 THEN 'train' ELSE 'validation' END AS split,
      seed % 1000000 AS "index", md5(target_json) AS target_md5 FROM receipts""",
)
def synthetic_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order and per customer: both splits from the operator, and the orders whose
    numbers reach the held-out seeds as the SQL has them, by their seed."""
    n_orders = table(spark, sf_dir, "orders").count()
    n_eval = table(spark, sf_dir, "customer").count()
    rows = synthetic_splits(spark, min(n_orders, EVAL_START), n_eval).select("split", "seed", "target_json")
    if n_orders > EVAL_START:
        beyond = spark.range(EVAL_START, n_orders).select(
            F.lit("validation").alias("split"), F.col("id").alias("seed")
        )
        rows = rows.unionByName(generate_receipts(beyond, "seed").select("split", "seed", "target_json"))
    index = (F.col("seed") % EVAL_START).alias("index")
    return rows.select("split", index, F.md5("target_json").alias("target_md5"))


@query(
    "schema_prompts_of_events",
    """WITH keys AS (SELECT DISTINCT event_type, unnest(json_keys(props)) AS k FROM events),
      placed AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k) AS pos FROM keys)
    SELECT event_type AS domain, 'The JSON must match this schema (keys and types):' || chr(10) ||
      string_agg('  - ' || k || ' (any)', chr(10) ORDER BY pos) AS prompt FROM placed GROUP BY 1""",
)
def event_schema_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per event type out of schema rows: the keys its properties have."""
    keys = (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("domain"), F.explode(F.json_object_keys("props")).alias("key"))
        .distinct()
    )
    # a domain's rows are the keys of one schema
    place = F.row_number().over(Window.partitionBy("domain").orderBy("key"))
    rows = keys.select(
        "domain", place.alias("pos"), "key", F.lit("any").alias("type"), F.lit("").alias("description")
    )
    return schema_prompts(rows)


@query(
    "write_metrics",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean,
      CASE WHEN count(*) < 0 THEN 1 END::DOUBLE AS missing FROM events GROUP BY event_type""",
)
def write_read_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written and read back, a NULL among them."""
    metrics = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")
    )
    place = work_folder(spark, "metrics")
    write_metrics(metrics.withColumn("missing", F.lit(None).cast("double")), place)
    return spark.read.schema("event_type string, n bigint, mean double, missing double").json(place)


@query(
    "sql_functions",
    """SELECT l_returnflag, l_linenumber, count(*) AS n,
      round(sum(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f1_sum,
      round(sum(CASE WHEN tp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END), 6) AS precision_sum,
      count(block) AS blocks, max(block) AS last_block
    FROM (SELECT *, l_orderkey % 5 AS tp, l_partkey % 7 AS fp, l_suppkey % 3 AS fn,
        CASE WHEN l_linenumber % 3 > 0 THEN '{"k":"' || l_returnflag || '"} {' || l_linenumber || '}' END
          AS block FROM lineitem)
    GROUP BY ALL""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions SQL knows by name, beside the registered metric of the same rule."""
    register_sql(spark)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linenumber", (F.col("l_orderkey") % 5).alias("tp"),
        (F.col("l_partkey") % 7).alias("fp"), (F.col("l_suppkey") % 3).alias("fn"),
        F.when(
            F.col("l_linenumber") % 3 > 0,
            F.format_string('so {"k":"%s"} {%d} ok', "l_returnflag", "l_linenumber"),
        ).alias("raw"),
    )
    scores = get_metric("field_prf")(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = lines.withColumns(
        {
            "f1": F.expr("field_f1(tp, fp, fn)"),
            "precision": scores["precision"],
            "block": F.expr("json_block(raw)"),
        }
    )
    return scored.groupBy("l_returnflag", "l_linenumber").agg(
        F.count("*").alias("n"),
        F.round(F.sum("f1"), 6).alias("f1_sum"),
        F.round(F.sum("precision"), 6).alias("precision_sum"),
        F.count("block").alias("blocks"),
        F.max("block").alias("last_block"),
    )


_LEFT = "{0} || repeat(' ', greatest(0, {1} - length({0})))"
_RIGHT = "repeat(' ', greatest(0, {1} - length({0}))) || {0}"
_PAGE = sql_digest("receipt|0|page", "seed", 2)


def _line(text: str, dy: int, dx: str = "0") -> str:
    return f"{{'text': {text}, 'dy': {dy}, 'dx': ({dx})::INT}}"


_RULE = _line("repeat('-', 34)", 22)
LAYOUT = f"""
paged AS (SELECT *, {_PAGE} AS pg FROM receipts),
lined AS (
  SELECT seed, 18 + {hexnum('pg', 1, 4, 23)} AS x0, 16 + {hexnum('pg', 5, 4, 21)} AS y0,
    [{_line('vendor', 28)}, {_line("'DATE: ' || \"date\"", 22)}, {_RULE}]
    || flatten(list_transform(items, lambda i, p: [
      {_line(_LEFT.format('substr(i.name, 1, 18)', 18) + " || ' x' || i.count", 22)},
      {_line(_RIGHT.format('i.price', 28), 20, hexnum('pg', '(p - 1) * 4 + 13', 4, 9))}]))
    || [{_RULE}, {_line("'SUBTOTAL' || " + _RIGHT.format('subtotal', 20), 22)},
      {_line("'TAX' || " + _RIGHT.format('tax', 25), 22)},
      {_line("'TOTAL' || " + _RIGHT.format('total', 23), 28)},
      {_line("'THANK YOU!'", 22, hexnum('pg', 9, 4, 61))}] AS lines
  FROM paged
), numbered AS (
  SELECT seed, x0, y0, lines, unnest(range(len(lines))) AS line_no FROM lined
)"""


@query(
    "receipt_layout",
    with_sql(RECEIPTS, LAYOUT)
    + """ SELECT seed, line_no, x0 + lines[line_no + 1].dx AS x,
      (y0 + coalesce(list_sum(list_transform(lines[1:line_no], lambda e: e.dy)), 0))::BIGINT AS y,
      lines[line_no + 1].text AS text FROM numbered""",
)
def receipt_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout_lines(receipts(spark, sf_dir), "seed")
    return lines.withColumns({c: F.col(c).cast("bigint") for c in ("line_no", "x", "y")})


@query(
    "leakage",
    with_sql(RECEIPTS)
    + """ , keyed AS (SELECT split, vendor || '|' || "date" AS line FROM receipts)
    SELECT sha256(line) AS content, count(*) FILTER (split = 'train') AS n_train,
      count(*) FILTER (split = 'validation') AS n_eval
    FROM keyed GROUP BY line HAVING n_train > 0 AND n_eval > 0""",
)
def leakage_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors and dates that receipts of both splits share."""
    rows = receipts(spark, sf_dir).select(
        "split", F.concat_ws("|", "receipt.vendor", "receipt.date").alias("line")
    )
    return leakage(
        rows.where(F.col("split") == "train"), rows.where(F.col("split") == "validation"), "line"
    )


@query(
    "leakage_documents",
    """SELECT sha256(text) AS content, count(*) FILTER (doc_id % 2 = 0) AS n_train,
      count(*) FILTER (doc_id % 2 = 1) AS n_eval
    FROM documents GROUP BY text HAVING n_train > 0 AND n_eval > 0""",
)
def leakage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents that occur under even and odd ids."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    even = F.col("doc_id") % 2 == 0
    return leakage(rows.where(even), rows.where(~even), "text")


@query(
    "leakage_canonical",
    """WITH keyed AS (SELECT event_id % 2 AS odd,
      'json:{"props":{"k":' || (props->>'$.k') || '},"user":' || user_id || '}' AS line FROM events)
    SELECT sha256(line) AS content, count(*) FILTER (odd = 0) AS n_train,
      count(*) FILTER (odd = 1) AS n_eval
    FROM keyed WHERE line IS NOT NULL GROUP BY line HAVING n_train > 0 AND n_eval > 0""",
)
def leakage_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and properties of events with even and odd ids; the odd ones come with their keys
    turned round, other blanks and the user as a decimal number."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "props")
    user, odd = F.col("user_id").cast("string"), F.col("event_id") % 2 != 0
    plain = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "user": '), user, F.lit("}"))
    turned = F.concat(F.lit('{"user":'), user, F.lit('.0,"props":'), F.col("props"), F.lit("}"))
    return canonical_leakage(
        rows.where(~odd).select(plain.alias("line")), rows.where(odd).select(turned.alias("line")), "line"
    )


# ----------------------------------------------------------------- image plans


@query(
    "plan_downscale",
    """SELECT p_partkey, CASE WHEN w * h <= 1048576 THEN w ELSE
        greatest(1, trunc(w * sqrt(1048576.0::DOUBLE / (w * h)))::BIGINT) END AS width,
      CASE WHEN w * h <= 1048576 THEN h ELSE
        greatest(1, trunc(h * sqrt(1048576.0::DOUBLE / (w * h)))::BIGINT) END AS height
    FROM (SELECT p_partkey, p_size * 97 + p_partkey % 31 AS w, p_size * 61 + p_partkey % 53 AS h
      FROM part)""",
)
def plan_downscale_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes stand in for image sizes."""
    key, size = F.col("p_partkey"), F.col("p_size")
    plan = plan_downscale(size * 97 + key % 31, size * 61 + key % 53, 1_048_576)
    return table(spark, sf_dir, "part").select("p_partkey", plan.alias("p")).select(
        "p_partkey",
        F.col("p.width").cast("bigint").alias("width"),
        F.col("p.height").cast("bigint").alias("height"),
    )


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as grey images of 32 columns, scaled down to 512 pixels."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    height = F.ceil(F.octet_length("text") / 32).cast("int")
    images = rows.where(F.octet_length("text") > 0).select(
        F.col("doc_id").cast("string").alias("image_ref"),
        F.lit(32).alias("width"),
        height.alias("height"),
        F.lit(1).alias("channels"),
        F.rpad(F.col("text").cast("binary"), height * 32, F.lit(b" ")).alias("pixels"),
    )
    return resize_images(images, 512)


@query("resize_images")
def resize_document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_images(spark, sf_dir).select(
        "image_ref", "width", "height", "channels", F.md5("pixels").alias("pixels_md5")
    )


@query(
    "resize_sizes",
    """SELECT doc_id::VARCHAR AS image_ref, w AS width, h AS height, w * h * 3 AS bytes FROM (
      SELECT doc_id, CASE WHEN 32 * rows <= 512 THEN 32 ELSE
          greatest(1, trunc(32 * sqrt(512.0::DOUBLE / (32 * rows)))::BIGINT) END AS w,
        CASE WHEN 32 * rows <= 512 THEN rows ELSE
          greatest(1, trunc(rows * sqrt(512.0::DOUBLE / (32 * rows)))::BIGINT) END AS h
      FROM (SELECT doc_id, (strlen(text) + 31) // 32 AS rows FROM documents WHERE text <> ''))""",
)
def resize_document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and byte counts of the same images after resizing."""
    return document_images(spark, sf_dir).select(
        "image_ref",
        F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"),
        F.length("pixels").cast("bigint").alias("bytes"),
    )


# ------------------------------------------------------------------ prediction


def receipt_reader():
    """A rule-based reader of receipt pages: printed text in, JSON out."""
    import json

    def read(page: str) -> str:
        lines = page.split("\n")
        at = [i for i, line in enumerate(lines) if line.startswith("---")]
        items = [
            {
                "name": lines[i].rsplit(" x", 1)[0].rstrip(),
                "count": lines[i].rsplit(" x", 1)[1],
                "price": lines[i + 1].strip(),
            }
            for i in range(at[0] + 1, at[1], 2)
        ]
        amounts = {
            key: line[len(key) :].strip()
            for line in lines[at[1] + 1 :]
            for key in ("SUBTOTAL", "TAX", "TOTAL")
            if line.startswith(key)
        }
        found = {
            "vendor": lines[0],
            "date": lines[1].removeprefix("DATE: "),
            "items": items,
            "subtotal": amounts["SUBTOTAL"],
            "tax": amounts["TAX"],
            "total": amounts["TOTAL"],
        }
        return json.dumps(found, separators=(",", ":"))

    return lambda rows: [read(page) for page in rows["page"]]


@query(
    "predict",
    """SELECT count(*) AS n, count(*) AS n_json_valid, count(*) AS n_exact_match,
      (count(*) * 1000000)::BIGINT AS f1_millionths FROM orders""",
)
def predict_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule-based predictor reads every printed receipt back without a mistake."""
    pages = layout_pages(receipts(spark, sf_dir))
    answered = predict(pages, receipt_reader, batch_size=64)
    return summarize(score(answered)).select("n", "n_json_valid", "n_exact_match", "f1_millionths")


def layout_pages(rows: DataFrame) -> DataFrame:
    """Receipt rows with their printed text; one receipt's lines stay in its own row."""
    r = F.col("receipt")

    def padded(name: str, value: str, width: int):
        return F.concat(F.lit(name), F.lpad(r[value], width, " "))

    lines = F.concat(
        F.array(r["vendor"], F.concat(F.lit("DATE: "), r["date"]), F.lit("-" * 34)),
        F.flatten(
            F.transform(
                r["items"],
                lambda i: F.array(
                    F.concat(F.rpad(i["name"], 18, " "), F.lit(" x"), i["count"]),
                    F.lpad(i["price"], 28, " "),
                ),
            )
        ),
        F.array(
            F.lit("-" * 34),
            padded("SUBTOTAL", "subtotal", 20),
            padded("TAX", "tax", 25),
            padded("TOTAL", "total", 23),
            F.lit("THANK YOU!"),
        ),
    )
    return rows.select(
        F.col("seed").alias("index"),
        F.col("target_json").alias("gold"),
        F.array_join(lines, "\n").alias("page"),
    )


@query(
    "top_key",
    """SELECT page_id, regexp_extract(path, '^[^.\\[]*') AS top_key
    FROM (SELECT page_id, replace(substr(url, 9), '/', '[') AS path FROM pages)""",
)
def top_key_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses cut at their first dot or bracket."""
    path = F.replace(F.expr("substring(url, 9)"), F.lit("/"), F.lit("["))
    return table(spark, sf_dir, "pages").select("page_id", top_key(path).alias("top_key"))
