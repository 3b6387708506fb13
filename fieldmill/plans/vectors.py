"""Registered queries: norms and spectra of vector groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.operators.spectrum import singular_spectrum
from fieldmill.operators.vectors import energy_spectrum, group_norms, norms_by_class, top_norms
from fieldmill.plans.base import query, table

_NAME_SQL = """'layer' || (vec_id % 40) || '.' || CASE label % 4 WHEN 0 THEN 'self_attn'
  WHEN 1 THEN 'mlp_attention' WHEN 2 THEN 'expert' ELSE 'norm' END"""
_NORMS_SQL = f"""
named AS (SELECT {_NAME_SQL} AS name, list_sum(list_transform(embedding,
    lambda x: x::DOUBLE * x::DOUBLE)) AS sq FROM embeddings),
norms AS (SELECT name, sqrt(sum(sq)) AS norm FROM named GROUP BY name)"""


def layer_name() -> Column:
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("self_attn", "mlp_attention", "expert", "norm")]),
        (F.col("label") % 4 + 1).cast("int"),
    )
    return F.concat(F.lit("layer"), (F.col("vec_id") % 40).cast("string"), F.lit("."), kind)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(layer_name().alias("name"), "embedding")


@query("group_norms", f"WITH {_NORMS_SQL} SELECT name, round(norm, 4) AS norm FROM norms")
def layer_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = group_norms(layers(spark, sf_dir), "name", "embedding")
    return norms.select("name", F.round("norm", 4).alias("norm"))


@query(
    "top_norms",
    f"""WITH {_NORMS_SQL} SELECT name, round(norm, 4) AS norm FROM norms
    ORDER BY norms.norm DESC, name DESC LIMIT 25""",
)
def top_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = top_norms(group_norms(layers(spark, sf_dir), "name", "embedding"), "name")
    return norms.select("name", F.round("norm", 4).alias("norm"))


@query(
    "norms_by_class",
    f"""WITH {_NORMS_SQL} SELECT CASE WHEN contains(name, 'attn') OR contains(name, 'attention')
        THEN 'attention' WHEN contains(name, 'mlp') OR contains(name, 'expert') THEN 'mlp/experts'
        ELSE 'other' END AS name_class, round(sum(norm), 3) AS norm FROM norms GROUP BY 1""",
)
def class_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = norms_by_class(group_norms(layers(spark, sf_dir), "name", "embedding"), "name")
    return sums.select("name_class", F.round("norm", 3).alias("norm"))


@query("energy_spectrum")
def label_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "embedding")
    return energy_spectrum(rows, "embedding", "label")


@query(
    "energy_norm",
    """SELECT label, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4)
      AS energy, 64::BIGINT AS components FROM embeddings GROUP BY label""",
)
def spectrum_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All energy of a spectrum: the sum of squares of the group's vectors."""
    spectrum = label_spectrum(spark, sf_dir)
    return spectrum.groupBy("label").agg(
        F.round(F.sum(F.col("sigma") * F.col("sigma")), 4).alias("energy"),
        F.count("*").alias("components"),
    )


_MOMENTS_SQL = """WITH cells AS (
      SELECT label, a.i AS i, b.i AS j, sum(a.x * b.x) AS cell FROM embeddings,
        LATERAL (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x) a,
        LATERAL (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x) b GROUP BY ALL)
    SELECT label, round(sum(CASE WHEN i = j THEN cell ELSE 0 END), 4) AS second,
      round(sum(cell * cell), 4) AS fourth FROM cells GROUP BY label"""


@query("spectrum_moments", _MOMENTS_SQL)
def spectrum_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the squares and fourth powers of a spectrum, which a Gram matrix holds as its
    trace and the sum of its squared cells."""
    return _moments(label_spectrum(spark, sf_dir))


@query("singular_moments", _MOMENTS_SQL)
def singular_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same moments of the spectrum that comes from QR factors instead of a Gram matrix."""
    rows = table(spark, sf_dir, "embeddings").select("label", "embedding")
    return _moments(singular_spectrum(rows, "embedding", "label"))


def _moments(spectrum: DataFrame) -> DataFrame:
    square = F.col("sigma") * F.col("sigma")
    return spectrum.groupBy("label").agg(
        F.round(F.sum(square), 4).alias("second"),
        F.round(F.sum(square * square), 4).alias("fourth"),
    )
