"""Views over the driver's tables and the SQL that spells the same views for the oracle.

Receipts are drawn per order, answers are receipts gone wrong in ten ways, and
annotations are receipts in the raw, irregular shape.  All views are row-local.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions.binding import let
from fieldmill.functions.draws import digest, draw
from fieldmill.functions.perturb import (
    KEPT_SHARE,
    KEY_RENAMES,
    PROSE_PREFIXES,
    corrupt_digits,
    drop_key,
    join_members,
    prose_wrap,
    rename_key,
    truncate_json,
)
from fieldmill.functions.receipt import (
    DAYS,
    FEWEST_ITEMS,
    FIRST_YEAR,
    HIGHEST_CENTS,
    LOWEST_CENTS,
    MONTHS,
    MOST_COUNT,
    MOST_ITEMS,
    PRODUCTS,
    TAX_PERCENT,
    VENDORS,
    YEARS,
    minify_json,
    struct_members,
)
from fieldmill.sources.samples import generate_receipts, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REFUSAL = "I cannot read this receipt."


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its oracle."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Spark views


def receipts_of(orders: DataFrame) -> DataFrame:
    """One receipt per order row, batch or stream; other columns stay."""
    key = F.col("o_orderkey")
    seeds = orders.select(
        F.when(key % 2 == 0, "train").otherwise("validation").alias("split"),
        F.floor(key / 2).cast("bigint").alias("index"),
        key.alias("seed"),
        *[c for c in orders.columns if c != "o_orderkey"],
    )
    rows = generate_receipts(seeds, "seed")
    return rows.withColumns(
        {
            "members": struct_members(F.col("receipt"), rows.schema["receipt"].dataType),
            "image_ref": F.concat(F.lit("receipt/"), F.col("seed").cast("string")),
        }
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt per order: ``split, index, seed, receipt, target_json, members, ...``."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return receipts_of(spread(orders, orders.count()))


def with_answer(rows: DataFrame, salt: str | Column = "0") -> DataFrame:
    """Adds ``raw``: what a model of ten moods says about the receipt."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    drawn = rows.withColumn("_h", digest("model", salt, F.col("seed"), blocks=2)).withColumn(
        "_mood", draw(F.substring("_h", 33, 32), 1, 4, 10)
    )
    h, text, mood, r = F.col("_h"), F.col("target_json"), F.col("_mood"), F.col("receipt")
    # three moods of ten rewrite members, and only they build them
    members = struct_members(r, rows.schema["receipt"].dataType)
    loose = r.withField("vendor", F.concat(F.lit(" "), F.lower(r["vendor"]))).withField(
        "total", F.concat(F.lit("$"), r["total"], F.lit("0"))
    )
    typed = F.transform(
        members,
        lambda m: F.struct(
            m["key"].alias("key"),
            F.when(m["key"] == "total", r["total"]).otherwise(m["value"]).alias("value"),
        ),
    )
    raw = (
        F.when(mood <= 1, text)
        .when(mood == 2, prose_wrap(text, h))
        .when(mood == 3, truncate_json(text))
        .when(mood == 4, corrupt_digits(text, h))
        .when(mood == 5, let(lambda members, h: join_members(drop_key(members, h)), members=members, h=h))
        .when(mood == 6, let(lambda members, h: join_members(rename_key(members, h)), members=members, h=h))
        .when(mood == 7, minify_json(loose))
        .when(mood == 8, F.lit(REFUSAL))
        .otherwise(join_members(typed))
    )
    return drawn.withColumn("raw", raw).drop("_h", "_mood")


def answers(spark: SparkSession, sf_dir: str, salt: str = "0") -> DataFrame:
    """``index, gold, raw`` for every order."""
    return with_answer(receipts(spark, sf_dir), salt).select(
        F.col("seed").alias("index"), F.col("target_json").alias("gold"), "raw"
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as raw annotation text, in the irregular shapes annotators leave."""
    rows = receipts(spark, sf_dir).withColumn("_h", digest("annotation", F.col("seed")))
    r, shape = F.col("receipt"), draw(F.col("_h"), 1, 4, 8)

    def lines(price: Callable[[Column], Column]) -> Column:
        return F.transform(
            r["items"],
            lambda i: F.concat(
                F.lit('{"nm":"'), i["name"], F.lit('","cnt":"'), i["count"],
                F.lit('","price":"'), price(i["price"]), F.lit('"}'),
            ),
        )

    plain = lines(lambda p: p)
    menu = (
        F.when(shape == 1, F.get(plain, F.lit(0)))
        .when(shape == 4, F.concat(F.lit('["x",'), F.array_join(plain, ","), F.lit("]")))
        .when(
            shape == 7,
            F.concat(
                F.lit("["),
                F.array_join(lines(lambda p: F.concat(F.lit(" 1,"), p, F.lit(" "))), ","),
                F.lit("]"),
            ),
        )
        .otherwise(F.concat(F.lit("["), F.array_join(plain, ","), F.lit("]")))
    )
    sub = F.when(
        shape == 3,
        F.concat(
            F.lit('[{"subtotal_price":"0"},"x",{"subtotal_price":"'), r["subtotal"],
            F.lit('"},{"tax_price":"'), r["tax"], F.lit('"}]'),
        ),
    ).otherwise(
        F.concat(
            F.lit('{"subtotal_price":"'), r["subtotal"], F.lit('","tax_price":"'), r["tax"],
            F.lit('"}'),
        )
    )
    total = (
        F.when(
            shape == 2,
            F.concat(F.lit('[{"total_price":"0"},{"total_price":"'), r["total"], F.lit('"}]')),
        )
        .when(shape == 6, F.lit("{}"))
        .otherwise(F.concat(F.lit('{"total_price":"'), r["total"], F.lit('"}')))
    )
    text = F.concat(
        F.lit('{"gt_parse":{"menu":'), menu, F.lit(',"sub_total":'), sub, F.lit(',"total":'), total,
        F.lit("}}"),
    )
    return rows.select(
        F.col("seed").alias("index"),
        "split",
        "image_ref",
        F.when(shape == 5, F.lit("not an annotation")).otherwise(text).alias("ground_truth"),
        "receipt",
        shape.alias("shape"),
    )


# ------------------------------------------------------------------ SQL views


def sql_list(words: tuple) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" if isinstance(w, str) else str(w) for w in words) + "]"


def hexnum(text: str, start: int | str, width: int, bound: int | str) -> str:
    return f"(('0x' || substr({text}, {start}, {width}))::BIGINT % ({bound}))"


def sql_digest(salt: str, keys: str, blocks: int = 1) -> str:
    return " || ".join(f"md5('{salt}|' || {keys} || '|{b}')" for b in range(blocks))


def sql_money(cents: str) -> str:
    return f"(({cents}) // 100)::VARCHAR || '.' || lpad((({cents}) % 100)::VARCHAR, 2, '0')"


def sql_shuffled(text: str, size: int) -> str:
    """List of positions (0-based) in drawn order."""
    return (
        f"list_transform(list_sort(list_transform(range({size}), "
        f"lambda i: substr({text}, 1 + 6 * i, 6) || lpad(i::VARCHAR, 2, '0'))), "
        "lambda e: substr(e, 7, 2)::INT)"
    )


def sql_member(key: str, value: str) -> str:
    return f"{{'key': '{key}', 'value': {value}}}"


def sql_join(members: str) -> str:
    return (
        f"('{{' || array_to_string(list_transform({members}, "
        "lambda m: '\"' || m.key || '\":' || m.value), ',') || '}')"
    )


_HEAD = sql_digest("receipt|0", "seed")
RECEIPTS = f"""
seeds AS (
  SELECT o_orderkey AS seed, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'validation' END AS split,
         o_orderkey // 2 AS "index"
  FROM orders
), drawn AS (
  SELECT *, {_HEAD} AS h, {sql_digest('receipt|0|order', 'seed', 4)} AS ho,
         {sql_digest('receipt|0|lines', 'seed', 2)} AS hl
  FROM seeds
), picked AS (
  SELECT *, list_transform(
      range({FEWEST_ITEMS} + {hexnum('h', 19, 4, MOST_ITEMS - FEWEST_ITEMS + 1)}),
      lambda j: {{'name': {sql_list(PRODUCTS)}[{sql_shuffled('ho', len(PRODUCTS))}[j + 1] + 1],
        'count': 1 + {hexnum('hl', 'j * 10 + 1', 4, MOST_COUNT)},
        'unit': {LOWEST_CENTS} + {hexnum('hl', 'j * 10 + 5', 6, HIGHEST_CENTS - LOWEST_CENTS + 1)}}}) AS lines
  FROM drawn
), summed AS (
  SELECT *, list_sum(list_transform(lines, lambda x: x.count * x.unit))::BIGINT AS sub_cents,
    {sql_list(TAX_PERCENT)}[1 + {hexnum('h', 23, 4, len(TAX_PERCENT))}] AS rate
  FROM picked
), taxed AS (
  SELECT *, (sub_cents * rate * 2 + 100) // 200 AS tax_cents FROM summed
), printed AS (
  SELECT seed, split, "index",
    {sql_list(VENDORS)}[1 + {hexnum('h', 1, 6, len(VENDORS))}] AS vendor,
    ({FIRST_YEAR} + {hexnum('h', 7, 4, YEARS)})::VARCHAR || '-'
      || lpad((1 + {hexnum('h', 11, 4, MONTHS)})::VARCHAR, 2, '0') || '-'
      || lpad((1 + {hexnum('h', 15, 4, DAYS)})::VARCHAR, 2, '0') AS "date",
    list_transform(lines, lambda x: {{'name': x.name, 'count': x.count::VARCHAR,
        'price': {sql_money('x.count * x.unit')}}}) AS items,
    {sql_money('sub_cents')} AS subtotal, {sql_money('tax_cents')} AS tax,
    {sql_money('sub_cents + tax_cents')} AS total
  FROM taxed
), membered AS (
  SELECT *, '[' || array_to_string(list_transform(items, lambda i: '{{"name":"' || i.name
      || '","count":"' || i.count || '","price":"' || i.price || '"}}'), ',') || ']' AS items_json
  FROM printed
), listed AS (
  SELECT *, [{sql_member('vendor', "'\"' || vendor || '\"'")},
     {sql_member('date', "'\"' || date || '\"'")}, {sql_member('items', 'items_json')},
     {sql_member('subtotal', "'\"' || subtotal || '\"'")},
     {sql_member('tax', "'\"' || tax || '\"'")}, {sql_member('total', "'\"' || total || '\"'")}
    ] AS members
  FROM membered
), receipts AS MATERIALIZED (
  SELECT *, {sql_join('members')} AS target_json FROM listed
)"""


def sql_corrupt(text: str, h: str) -> str:
    """Two digits changed; digits are cut out and the text put together again.

    A one-element list binds the digits and the two places once per row.
    """
    digits = f"regexp_extract_all({text}, '[0-9]')"
    count = f"len({digits})"
    first = hexnum(h, 1, 6, f"greatest({count}, 1)")
    other = hexnum(h, 7, 6, f"greatest({count} - 1, 1)")

    def changed(d: str, start: int) -> str:
        fresh = hexnum("s.h", start, 4, 9)
        return f"(CASE WHEN {fresh} >= {d}::INT THEN {fresh} + 1 ELSE {fresh} END)::VARCHAR"

    replaced = (
        "list_transform(s.digits, lambda d, i: CASE WHEN i - 1 = s.first THEN "
        f"{changed('d', 13)} WHEN i - 1 = s.other + (s.other >= s.first)::INT THEN "
        f"{changed('d', 17)} ELSE d END)"
    )
    return (
        f"list_transform([{{'digits': {digits}, 'first': {first}, 'other': {other}, 'h': {h}, "
        f"'between': regexp_split_to_array({text}, '[0-9]')}}], lambda s: "
        f"array_to_string(list_transform(list_zip(s.between, {replaced}), "
        "lambda z: z[1] || coalesce(z[2], '')), ''))[1]"
    )


def sql_prose(text: str, h: str) -> str:
    return f"{sql_list(PROSE_PREFIXES)}[1 + {hexnum(h, 1, 6, len(PROSE_PREFIXES))}] || {text}"


def sql_truncate(text: str) -> str:
    return f"substr({text}, 1, greatest(2, trunc(length({text}) * {KEPT_SHARE}::DOUBLE)::BIGINT))"


def sql_drop(members: str, h: str) -> str:
    victim = (
        f"list_sort(list_transform({members}, lambda m: m.key))"
        f"[1 + {hexnum(h, 1, 6, f'len({members})')}]"
    )
    return sql_join(f"list_filter({members}, lambda m: m.key <> {victim})")


_RENAME_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in KEY_RENAMES.items()) + "}"


def sql_rename(members: str, h: str) -> str:
    """Receipts hold no key and its other name at once, so a rename never collides."""
    options = (
        f"list_filter(list_transform({members}, lambda m: m.key), "
        f"lambda k: list_contains(map_keys({_RENAME_MAP}), k))"
    )
    chosen = f"{options}[1 + {hexnum(h, 1, 6, f'len({options})')}]"
    return sql_join(
        f"list_transform({members}, lambda m: {{'key': CASE WHEN m.key = {chosen} "
        f"THEN {_RENAME_MAP}[m.key] ELSE m.key END, 'value': m.value}})"
    )


def answers_sql(salt: str = "'0'", source: str = "receipts", name: str = "answers") -> str:
    """CTE of answers per receipt; ``salt`` is an SQL expression."""
    loose = (
        "list_transform(members, lambda m: {'key': m.key, 'value': CASE "
        "WHEN m.key = 'vendor' THEN '\" ' || lower(vendor) || '\"' "
        "WHEN m.key = 'total' THEN '\"$' || total || '0\"' ELSE m.value END})"
    )
    typed = (
        "list_transform(members, lambda m: {'key': m.key, 'value': "
        "CASE WHEN m.key = 'total' THEN total ELSE m.value END})"
    )
    return f"""
{name}_drawn AS (
  SELECT *, {sql_digest('model', f"{salt} || '|' || seed", 2)} AS hm FROM {source}
), {name}_mood AS (
  SELECT *, {hexnum('hm', 33, 4, 10)} AS mood FROM {name}_drawn
), {name} AS (
  SELECT * EXCLUDE ("index"), seed AS "index", target_json AS gold, CASE
    WHEN mood <= 1 THEN target_json
    WHEN mood = 2 THEN {sql_prose('target_json', 'hm')}
    WHEN mood = 3 THEN {sql_truncate('target_json')}
    WHEN mood = 4 THEN {sql_corrupt('target_json', 'hm')}
    WHEN mood = 5 THEN {sql_drop('members', 'hm')}
    WHEN mood = 6 THEN {sql_rename('members', 'hm')}
    WHEN mood = 7 THEN {sql_join(loose)}
    WHEN mood = 8 THEN '{REFUSAL}'
    ELSE {sql_join(typed)} END AS raw
  FROM {name}_mood
)"""


def sql_normalized(text: str) -> str:
    """Canonical leaf text; texts of the views hold ASCII digits and blanks only."""
    cleaned = f"regexp_replace(trim({text}), '[^0-9.\\-]', '', 'g')"
    number = f"TRY_CAST({cleaned} AS DOUBLE)"
    return (
        f"CASE WHEN trim({text}) = '' THEN '' "
        f"WHEN {cleaned} NOT IN ('', '-', '.', '-.') AND {number} IS NOT NULL "
        f"THEN rtrim(rtrim(printf('%.4f', {number}), '0'), '.') ELSE lower(trim({text})) END"
    )


def fields_sql(source: str, text: str, name: str, keep: str = '"index"') -> str:
    """CTE: distinct ``(keep, path, value)`` of a JSON text column, list positions erased."""
    leaf = "coalesce(json_extract_string(x.atom, '$'), 'none')"
    return f"""
{name} AS (
  SELECT DISTINCT {keep}, regexp_replace(substr(x.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') AS path,
    {sql_normalized(leaf)} AS value
  FROM {source}, json_tree({source}.{text}) x
  WHERE {source}.{text} IS NOT NULL AND x.type NOT IN ('OBJECT', 'ARRAY')
)"""


def scored_sql(source: str = "answers", keep: str = '"index"') -> str:
    """CTEs from answers to ``matched`` (per index and key) and ``scored`` (per index)."""
    using = ", ".join(k.strip() for k in keep.split(","))
    prefixed = ", ".join(f"s.{k.strip()}" for k in keep.split(","))
    return f"""
blocks AS (
  SELECT *, nullif(regexp_extract(raw, '\\{{.*\\}}', 0, 's'), '') AS block FROM {source}
), judged AS MATERIALIZED (
  SELECT * EXCLUDE (block), CASE WHEN json_valid(block) THEN block END AS pred FROM blocks
), {fields_sql('judged', 'gold', 'gold_fields', keep)}, {fields_sql('judged', 'pred', 'pred_fields', keep)},
cells AS (
  SELECT {using}, path, value, a.one IS NOT NULL AS p, b.one IS NOT NULL AS g FROM (
    SELECT *, 1 AS one FROM pred_fields) a FULL JOIN (SELECT *, 1 AS one FROM gold_fields) b
    USING ({using}, path, value)
), matched AS (
  SELECT {using}, regexp_extract(path, '^[^.\\[]*') AS field,
    count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp,
    count(*) FILTER (g AND NOT p) AS fn
  FROM cells GROUP BY ALL
), counts AS (
  SELECT {using}, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn
  FROM matched GROUP BY ALL
), flags AS (
  SELECT *, pred IS NOT NULL AS json_valid,
    pred IS NOT NULL AND {SCHEMA_CHECK} AS schema_valid,
    pred IS NOT NULL AND {CANONICAL.format('pred')} = {CANONICAL.format('gold')} AS exact_match
  FROM judged
), scored AS (
  SELECT {prefixed}, s.gold, s.raw, s.pred, s.json_valid, s.schema_valid, s.exact_match, c.tp, c.fp, c.fn,
    (2 * c.tp * 1000000) // (2 * c.tp + c.fp + c.fn) AS f1_millionths,
    CASE WHEN c.tp = 0 THEN 0.0 ELSE
      2.0::DOUBLE * (c.tp / (c.tp + c.fp)) * (c.tp / (c.tp + c.fn))
      / ((c.tp / (c.tp + c.fp)) + (c.tp / (c.tp + c.fn))) END AS f1
  FROM flags s JOIN counts c USING ({using})
)"""


# Keys in sorted order with their raw JSON text: equal for equal objects of the views.
CANONICAL = (
    "list_sort(list_transform(json_keys({0}), "
    "lambda k: k || '=' || json_extract({0}, '$.' || k)::VARCHAR))"
)
SCHEMA_CHECK = (
    "coalesce(list_sort(json_keys(pred)) = ['date', 'items', 'subtotal', 'tax', 'total', 'vendor'] "
    "AND json_type(pred, '$.vendor') = 'VARCHAR' AND json_type(pred, '$.date') = 'VARCHAR' "
    "AND json_type(pred, '$.subtotal') = 'VARCHAR' AND json_type(pred, '$.tax') = 'VARCHAR' "
    "AND json_type(pred, '$.total') = 'VARCHAR' AND json_type(pred, '$.items') = 'ARRAY' "
    "AND regexp_matches(json_extract_string(pred, '$.date'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'), false)"
)


def sql_round4(value: str) -> str:
    return f"printf('%.4f', {value})::DOUBLE"


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)

