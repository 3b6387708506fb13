"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into pieces of up to PIECE characters that never span white space; every run of
GRAM pieces is hashed.  Of each WINDOW consecutive hashes the least is kept, the rightmost of
equal ones, with its position: a passage of GRAM + WINDOW - 1 pieces that two texts share leaves
a common fingerprint in both if its pieces are cut alike.  The query takes grams of characters
instead, at every position, which needs no such luck.  Hash and position travel in one long, whose order is that rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import table, texts

PIECE = 4
GRAM = 3
WINDOW = 4
#: The query hashes grams of so many characters, at every one.
CHARACTERS = PIECE * GRAM
#: Consecutive documents that share a bucket, on average, and the most buckets.
BUCKET = 512
MOST_BUCKETS = 1 << 18

_PLACES = (1 << 31) - 1


def _pieces(piece: int, gram: int) -> str:
    one = rf"\S{{1,{piece}}}"
    return rf"(?=({one}(?:\s*{one}){{0,{gram - 1}}})){one}"


def winnowed(text: Column, piece: int = PIECE, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen (hash, position) pairs of a text, packed into longs, in order of position.

    Null and blank texts give an empty array; a text with fewer grams than a window gives its
    least.  The tail has shorter grams of its own, so every character counts.  ``window`` is a
    power of two.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    grams = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_pieces(piece, gram)), F.lit(1))
    return _chosen(grams, window)


def winnowed_characters(text: Column, gram: int = CHARACTERS, window: int = WINDOW) -> Column:
    """``winnowed`` with a gram of ``gram`` characters at every character that is not blank.

    A shared passage of ``gram + window - 1`` such characters leaves a common hash wherever it
    starts.  A text with fewer than ``gram`` of them is one gram.
    """
    text = F.coalesce(text, F.lit(""))
    whole = F.regexp_extract_all(text, F.lit(r"(\S(?:\s*\S)*)"), F.lit(1))
    return _bound(_full_grams(text, gram), lambda grams: _chosen(F.when(F.size(grams) > 0, grams).otherwise(whole), window))


def _values(grams: Column, offset: Column | int = 0) -> Column:
    """(hash, position) of every gram, packed; the first gram is at ``offset``."""
    return F.transform(
        grams,
        lambda g, i: F.shiftleft(F.xxhash64(g).bitwiseAND(0xFFFFFFFF), 31)
        + (F.lit(_PLACES) - i - F.lit(offset) if isinstance(offset, int) else F.lit(_PLACES) - i - offset),
    )


def _chosen(grams: Column, window: int) -> Column:
    """The packed (hash, position) pairs that the windows choose."""
    return F.array_distinct(_window_minima(_values(grams), window))


#: Characters whose grams and windows a change behind them reaches.
_REACH = CHARACTERS - 1 + WINDOW - 1


def _full_grams(text: Column, gram: int = CHARACTERS) -> Column:
    # written out, not counted: the pattern engine runs a plain sequence in less than 0.6 of the time
    rest = r"\s*\S" * (gram - 1)
    return F.regexp_extract_all(text, F.lit(rf"(?=(\S{rest}))\S"), F.lit(1))


_BLANKS = " \t\n\x0b\f\r"


def _dense_size(text: Column) -> Column:
    """Characters that are not blank."""
    for blank in _BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.length(text)


def reusable(text: Column, cut: Column) -> Column:
    """struct<chosen, kept_size, kept_chosen>: ``winnowed_characters`` of the text, and how much of
    it holds for any text that begins with all but the last ``cut`` characters: the number of
    characters that are not blank in that beginning, and of pairs whose windows end inside it."""
    text = F.coalesce(text, F.lit(""))
    beginning = _dense_size(F.substring(text, F.lit(1), F.length(text) - cut))
    whole = F.regexp_extract_all(text, F.lit(r"(\S(?:\s*\S)*)"), F.lit(1))

    def picked(minima: Column, size: Column) -> Column:
        chosen, windows = F.array_distinct(minima), size - _REACH
        last = F.when(windows > 0, F.element_at(minima, F.greatest(windows, F.lit(1))))
        return F.struct(
            chosen.alias("chosen"),
            size.alias("kept_size"),
            F.coalesce(F.array_position(chosen, last), F.lit(0)).cast("int").alias("kept_chosen"),
        )

    grams = _bound(_full_grams(text), lambda full: F.when(F.size(full) > 0, full).otherwise(whole))
    minima = _window_minima(_values(grams), WINDOW)
    return _bound(F.struct(minima.alias("minima"), beginning.alias("size")), lambda s: picked(s["minima"], s["size"]))


def changed_end(known: Column, beginning: Column, end: Column) -> Column:
    """``winnowed_characters`` of ``beginning`` + ``end`` where ``known`` is ``reusable`` of a text
    with that beginning: only grams that reach the end are hashed."""
    seam = F.reverse(F.regexp_extract(F.reverse(beginning), rf"^\s*((?:\S\s*){{{_REACH - 1}}}\S)", 1))
    blanks = F.substring(beginning, F.length(F.rtrim(beginning, F.lit(_BLANKS))) + 1, F.length(beginning))
    rest = _full_grams(F.concat(seam, blanks, end))
    values = _values(rest, known["kept_size"] - _REACH)
    least = _bound(
        values,
        lambda v: F.when(F.size(v) >= WINDOW, _window_minima(v, WINDOW)).otherwise(F.array().cast("array<bigint>")),
    )
    kept = F.slice(known["chosen"], 1, known["kept_chosen"])
    return F.when(
        known["kept_size"] > _REACH, F.array_distinct(F.concat(kept, least))
    ).otherwise(winnowed_characters(F.concat(beginning, end)))


def _window_minima(values: Column, window: int) -> Column:
    """Least of every ``window`` consecutive values, by doubling the reach of each."""
    reach, found = 1, values
    while reach < window:
        found = _bound(found, _least_of_two(reach))
        reach *= 2
    # the last windows would reach beyond the end
    return _bound(found, lambda a: F.slice(a, 1, F.greatest(F.size(a) - (window - 1), F.lit(1))))


def _bound(values: Column, use) -> Column:
    """``use(values)`` with the array computed once, however often it is named."""
    return F.transform(F.array(values), use)[0]


def _least_of_two(reach: int):
    def use(a: Column) -> Column:
        behind = F.slice(a, reach + 1, F.greatest(F.size(a), F.lit(1)))
        return F.zip_with(a, behind, lambda x, y: F.least(x, y))

    return use


def hashes(chosen: Column) -> Column:
    """The distinct hashes of packed pairs."""
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, 31)))


def positions(chosen: Column) -> Column:
    """The pieces at which the chosen grams start."""
    return F.transform(chosen, lambda v: (F.lit(_PLACES) - v.bitwiseAND(_PLACES)).cast("int"))


def digest(chosen: Column) -> Column:
    """32 hex digits that stand for all chosen hashes and positions."""
    return F.lower(
        F.concat(
            F.lpad(F.hex(F.xxhash64(chosen)), 16, "0"),
            F.lpad(F.hex(F.xxhash64(F.lit(7), chosen)), 16, "0"),
        )
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``fingerprint``: array<struct<hash: bigint, position: int>>."""
    chosen = winnowed(F.col(f"`{text_col}`"))
    pairs = F.transform(
        chosen,
        lambda v: F.struct(
            F.shiftright(v, 31).alias("hash"),
            (F.lit(_PLACES) - v.bitwiseAND(_PLACES)).cast("int").alias("position"),
        ),
    )
    return df.withColumn("fingerprint", pairs)


def _literal(values: list) -> Column:
    """A constant array, folded when the query is planned."""
    nested = bool(values) and isinstance(values[0], list)
    return F.from_json(F.lit(str(values)), f"array<{'array<bigint>' if nested else 'bigint'}>")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, known, chosen, next_text, next_chosen): every row of (doc_id, text) beside the
    next in ascending order, the last beside the first; ``known`` is ``reusable`` for ``edited``.

    Equal ids follow each other in order of their texts; null ids come first.  Ids are cut into
    buckets at quantiles; a bucket's first row also goes to the bucket before it, so each text
    is shuffled once (a bucket's first twice) and no task sees more than its buckets.  Texts are
    fingerprinted after the shuffle.  A null id counts as the least number.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.select("doc_id", "text", key.alias("k"))
    n = docs.count()
    count = int(min(MOST_BUCKETS, max(1, n // BUCKET)))
    shares = [i / count for i in range(1, count)]
    cuts = []
    if shares:
        accuracy = int(min(1 << 24, max(10_000, 20 * count)))
        found = keyed.agg(F.percentile_approx("k", shares, accuracy).alias("cuts")).first()
        cuts = sorted(set(found.cuts or []))
    # two levels: groups of cuts, then the cuts of one group
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[at : at + width] for at in range(0, len(cuts), width)] or [[-(1 << 63)]]
    heads = _literal([group[0] for group in groups])
    k = F.col("k")
    group = F.greatest(F.size(F.filter(heads, lambda h: h <= k)), F.lit(1))
    inside = F.size(F.filter(F.element_at(_literal(groups), group), lambda h: h <= k))
    bucketed = keyed.withColumn("bucket", (group - 1) * width + inside)
    firsts = bucketed.groupBy("bucket").agg(F.min("k").alias("first")).orderBy("bucket").collect()
    if not firsts:
        firsts_by, before_by = [0], [0]
    else:
        size = firsts[-1].bucket + 1
        firsts_by, before_by = [0] * size, [0] * size
        for at, row in enumerate(firsts):
            firsts_by[row.bucket] = row["first"]
            before_by[row.bucket] = firsts[at - 1].bucket
    at = F.col("bucket") + 1
    own = F.struct(F.col("bucket").cast("long").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(_literal(before_by), at).alias("bucket"), F.lit(True).alias("guest"))
    is_first = F.element_at(_literal(firsts_by), at) == k
    dealt = bucketed.withColumn("to", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    there = (
        dealt.select("doc_id", "text", "k", "to.bucket", "to.guest")
        .repartition("bucket")
        .withColumn("known", reusable(F.col("text"), _cut(F.col("text"))))
    )
    order = Window.partitionBy("bucket").orderBy("guest", "k", "text")
    return (
        there.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_chosen", F.lead("known.chosen").over(order))
        .where("NOT guest")
        .select("doc_id", "text", "known", F.col("known.chosen").alias("chosen"), "next_text", "next_chosen")
    )


def _cut(text: Column) -> Column:
    return (F.length(text) / 4).cast("int")


def edited(text: Column, following: Column) -> Column:
    """The text, its last quarter replaced by as many first characters of the following."""
    return F.concat(*edited_parts(text, following))


def edited_parts(text: Column, following: Column) -> tuple[Column, Column]:
    """What an edited text keeps, and what comes behind it."""
    cut = _cut(text)
    return F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Per document: n_chars, the edited text's hash, both fingerprints and the likenesses."""
    rows = with_next(texts(table(spark, sf_dir, "documents")))
    beginning, end = edited_parts(F.col("text"), F.col("next_text"))
    rows = rows.withColumns({"beginning": beginning, "end": end}).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.concat("beginning", "end").cast("binary"), 256).alias("edited_sha256"),
        F.col("known.chosen").alias("chosen"),
        changed_end(F.col("known"), F.col("beginning"), F.col("end")).alias("edited_chosen"),
        "next_chosen",
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("chosen")).alias("fingerprint"),
        digest(F.col("edited_chosen")).alias("edited_fingerprint"),
        hashes(F.col("chosen")).alias("own"),
        hashes(F.col("edited_chosen")).alias("changed"),
        hashes(F.col("next_chosen")).alias("following"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
