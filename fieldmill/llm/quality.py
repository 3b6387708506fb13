"""Quality by hierarchical empirical Bayes: what a text looks like, where it was found.

The text gives a likelihood ratio from a few binned measures (naive Bayes, tempered because the
measures overlap).  Its host's share of good documents is shrunk towards the share of all, its
path's towards the host's; how strongly is estimated from the spread between sites.  Prior odds
of the path times the ratio give the posterior.  Everything is grouped aggregation: only counts
per site and per bin leave a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import share_of, table, written

MARKS = "#$%&*!|<>{}[]=~^@_"
THRESHOLD = 0.5
#: Weight of each measure's logarithmic ratio.
TEMPER = 0.7
#: A site that holds more than one row in so many is looked up by broadcast.
HOT_SHARE = 1000


def measures() -> dict[str, Column]:
    """Bin numbers of a text in column ``text``; an empty text is in the first bins."""
    text = F.col("text")
    size = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    blanks = F.length(text) - F.length(F.translate(text, " \n\t\r", ""))
    stops = F.length(text) - F.length(F.translate(text, ".", ""))
    lines = F.split(text, "\n")
    sentences = F.split(text, r"\.\s")

    def bins(share: Column, scale: int, most: int) -> Column:
        return F.least(F.floor(share * scale), F.lit(most)).cast("int")

    return {
        "marks": bins(marks / size, 50, 15),
        "upper": bins(upper / size, 40, 15),
        "digits": bins(digits / size, 50, 10),
        "blanks": bins(blanks / size, 40, 15),
        "stops": bins(stops / size, 100, 10),
        "size": F.least(F.floor(F.log2(size)), F.lit(16)).cast("int"),
        "lines": bins(F.lit(1) - F.size(F.array_distinct(lines)) / F.size(lines), 10, 9),
        "sentences": bins(
            F.lit(1) - F.size(F.array_distinct(sentences)) / F.size(sentences), 10, 9
        ),
    }


def described(df: DataFrame, text: Column, host: Column, path: Column, *keep: str) -> DataFrame:
    """Bins, ``host`` and ``path`` per row, without the text; null sites are one site."""
    rows = df.select(
        *keep,
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )
    found = measures()
    return rows.select(*keep, "host", "path", *(c.alias(f"m_{name}") for name, c in found.items()))


@dataclass(frozen=True)
class Evidence:
    """Logarithmic ratios per measure and bin, for any number of documents a small table."""

    ratios: dict[str, dict[int, float]]
    share: float

    def column(self) -> Column:
        total = F.lit(0.0)
        for name, known in sorted(self.ratios.items()):
            if known:
                cells = [F.lit(cell) for pair in sorted(known.items()) for cell in pair]
                found = F.create_map(*cells)
                total = total + F.coalesce(F.element_at(found, F.col(f"m_{name}")), F.lit(0.0))
        return total * F.lit(TEMPER)


def evidence(labelled: DataFrame) -> Evidence:
    """Counts each bin among good and bad rows (column ``label``), all measures in one pass."""
    names = [c[2:] for c in labelled.columns if c.startswith("m_")]
    cells = F.explode(
        F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"m_{n}").alias("bin")) for n in names))
    )
    rows = (
        labelled.select("label", cells.alias("cell"))
        .groupBy("cell.name", "cell.bin")
        .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
        .collect()
    )
    ratios: dict[str, dict[int, float]] = {name: {} for name in names}
    good = sum(row.good for row in rows if row.name == names[0])
    bad = sum(row.bad for row in rows if row.name == names[0])
    for name in names:
        own = [row for row in rows if row.name == name]
        for row in own:
            ratios[name][row.bin] = math.log((row.good + 0.5) / (good + 0.5 * len(own))) - math.log(
                (row.bad + 0.5) / (bad + 0.5 * len(own))
            )
    return Evidence(ratios, (good + 0.5) / (good + bad + 1))


def _strength(groups: DataFrame, share: Column) -> float:
    """How many rows the parent's share is worth, by moments: the spread of the groups' shares
    beyond what chance explains.  Without any such spread the parent decides alone."""
    p = F.greatest(F.least(share, F.lit(1 - 1e-6)), F.lit(1e-6))
    row = groups.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * p, 2) - F.col("n") * p * (1 - p)).alias("beyond"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("most"),
    ).first()
    if not row.most or row.beyond is None or row.beyond <= 0:
        return 1e6
    correlation = min(max(row.beyond / row.most, 1e-6), 0.999)
    return 1 / correlation - 1


def sites(labelled: DataFrame, share: float) -> DataFrame:
    """(host, path, prior): every labelled path's share of good rows, shrunk to its host's, and
    under the path null the host's own, shrunk to the share of all."""
    paths = labelled.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("label").alias("good")
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    strong = _strength(hosts, F.lit(share))
    hosts = hosts.select(
        "host", ((F.col("good") + strong * share) / (F.col("n") + strong)).alias("host_prior")
    )
    both = paths.join(hosts, "host")
    strong = _strength(both, F.col("host_prior"))
    own = (F.col("good") + strong * F.col("host_prior")) / (F.col("n") + strong)
    return both.select("host", "path", own.alias("prior")).unionByName(
        hosts.select("host", F.lit(None).cast("string").alias("path"), F.col("host_prior").alias("prior"))
    )


def looked_up(rows: DataFrame, sites: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of ``sites`` (one row per ``keys``), null where there is none.

    A key of more than one row in HOT_SHARE is hot.  There are fewer than HOT_SHARE of those,
    whatever the input, so they are broadcast and their rows stay where they are; the other
    rows are shuffled, and no key among them is large.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(
        F.col("__n") * HOT_SHARE > rows.agg(F.count("*")).scalar()
    )
    hot = written(hot.select(*keys), "quality-hot")
    frequent = written(hot.join(sites, list(keys), "left"), "quality-hot-sites")
    often = rows.join(F.broadcast(frequent), list(keys))
    rest = rows.join(F.broadcast(hot), list(keys), "left_anti").join(sites, list(keys), "left")
    return often.unionByName(rest)


def judged(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows`` of ``described`` with ``prior``, ``evidence`` and ``score``, the posterior that a
    row is good.  ``labelled`` are such rows with ``label``; 1 is good, null labels teach nothing.

    A path without labels takes its host's prior, a host without labels that of all; without any
    label every prior is 0.5.  Priors are settled per site, then every row looks up its site's.
    """
    known = labelled.where(F.col("label").isNotNull())
    found = evidence(known)
    places = written(sites(known, found.share), "quality-sites")
    paths = places.where("path IS NOT NULL").withColumnRenamed("prior", "path_prior")
    hosts = places.where("path IS NULL").select("host", F.col("prior").alias("host_prior"))
    every = rows.select("host", "path").distinct().join(paths, ["host", "path"], "left")
    priors = looked_up(written(every, "quality-places"), hosts, "host").select(
        "host", "path", F.coalesce("path_prior", "host_prior", F.lit(found.share)).alias("prior")
    )
    held = looked_up(rows, written(priors, "quality-priors"), "host", "path")
    held = held.withColumn("evidence", found.column())
    odds = F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("evidence")
    return held.withColumn("score", 1 / (1 + F.exp(-odds)))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, prior, evidence, score and keep of every document.

    The source is the host, the language the path.  Labels are learned from documents whose
    crc32(doc_id) modulo 3 is not 1.
    """
    documents = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality").cast("int")).alias("label")
    )
    look = described(documents, F.col("text"), F.col("source"), F.col("lang"), "doc_id")
    look = written(look, "quality-bins")  # the texts are read once, for learning and judging
    labelled = look.where(share_of(F.col("doc_id"), 3) != 1).join(marks, "doc_id")
    rows = judged(look, labelled)
    return rows.select(
        "doc_id",
        (share_of(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.round("prior", 9).alias("prior"),
        F.round("evidence", 9).alias("evidence"),
        F.round("score", 9).alias("score"),
        (F.col("score") >= THRESHOLD).cast("int").alias("keep"),
    )
