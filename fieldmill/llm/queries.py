"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fieldmill.llm import (
    context_tree,
    cross_polytope,
    decontaminate,
    language,
    merkle,
    packing,
    quality,
    resample,
    sharding,
    simhash,
    substring,
    toxicity,
    winnowing,
)
from fieldmill.llm.common import table

SHARDS = [f"shard-{number:02d}" for number in range(32)]
SLOTS = 4099


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


#: Fills the table turn by turn, then looks every document up.
OP1_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)),
orders AS (
  SELECT i, name, ('0x' || substr(md5(name), 1, 15))::BIGINT % {SLOTS} AS first,
    ('0x' || substr(md5(name), 16, 15))::BIGINT % {SLOTS - 1} + 1 AS step FROM shards),
lists AS (SELECT list(first ORDER BY i) AS firsts, list(step ORDER BY i) AS steps FROM orders),
filled(turn, taken, slot) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: false), -1::BIGINT
  UNION ALL
  SELECT turn + 1,
    list_concat(list_concat(taken[1:pick], [true]), taken[pick + 2:]), pick
  FROM (
    SELECT turn, taken, list_filter(
      list_transform(range({SLOTS}), lambda j:
        (firsts[turn % {len(SHARDS)} + 1] + j * steps[turn % {len(SHARDS)} + 1]) % {SLOTS}),
      lambda s: NOT taken[s + 1])[1] AS pick
    FROM filled, lists WHERE turn < {SLOTS}))
SELECT doc_id, slot::INTEGER AS slot, name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT
        % {SLOTS} AS slot FROM documents)
JOIN (SELECT slot, (turn - 1) % {len(SHARDS)} AS i FROM filled WHERE turn > 0) USING (slot)
JOIN shards USING (i)
"""

QUERIES: dict[str, Callable] = {
    "op1_sharding": op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": language.op4_language_id,
    "op5_fingerprints": winnowing.op5_fingerprints,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_context_tree": context_tree.op8_context_tree,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
    "op11_neighbours": cross_polytope.op11_neighbours,
    "op12_resample": resample.op12_resample,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES: dict[str, str] = {
    "op1_sharding": OP1_SQL,
    "op6_substring_dedup": substring.OP6_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
