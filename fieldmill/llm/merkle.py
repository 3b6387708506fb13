"""Merkle manifest of a dataset: one digest for all rows, one proof for each.

Every row is a leaf.  Per source 16 consecutive nodes become one, level by level, until one is
left; the sources' last nodes become the root in the same way.  The built levels are tables of
nodes that name their parent.  A recursive query then climbs from every leaf to the root: each
step meets the parent, appends the siblings found there to the proof and folds the leaf's digest
into the parent's.  The leaves of one run share all siblings above it, so they climb in one row
of the query, with one digest for each value that their leaves fold to.

Digests are H, lowercase hexadecimal SHA-256; the tables hold them as 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import share_of, table, written
from fieldmill.operators.batching import dense_index
from fieldmill.session import work_folder

#: Children of a node.
WIDTH = 16
#: Climbers that meet in one copy of a node; nodes near the root are stored in more copies.
MEETING = 1024
#: The tree over the sources; source keys are empty (null) or begin with "=".
ROOT_TREE = "^"
#: Levels a climb may take: 16 ** 15 rows of one source and as many sources.
MOST_LEVELS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hashed(children: Column) -> Column:
    """H of binary digests, taken as hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(children)), 256))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """H of the five fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    fields = (doc_id, source, lang, n_chars, text)
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, offered): ``offered`` is the leaf of the tampered row where 5 divides
    the crc32 of the id (null ids count as the empty text), null elsewhere."""
    number = F.col("doc_id").cast("long")
    changed = share_of(number, 5) == 0
    rest = [F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    text = F.col("text")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        number.alias("doc_id"),
        leaf(number, *rest, text).alias("leaf"),
        F.when(changed, leaf(number, *rest, F.translate(text, _UPPER, _LOWER))).alias("offered"),
    )


def _joined(array: Column, field: str) -> Column:
    """The digests of an array of structs as one binary."""
    return F.aggregate(array, F.lit(b""), lambda held, node: F.concat(held, node[field]))


def _without(children: Column, place: Column) -> tuple[Column, Column]:
    """The digests before and behind one place, as binaries."""
    before = F.substring(children, F.lit(1), place * 32)
    return before, F.substring(children, place * 32 + 33, F.octet_length(children))


def runs(rows: DataFrame) -> DataFrame:
    """(tree, idx, total, members): the leaves of each tree in runs of 16, in the order of doc_id.

    Null ids come first, rows that share an id in the order of their leaves.  The rows are
    range-sorted into a table with their place in the task; counts per task and tree, one row
    each, give the place in the tree, so that a source of any size is dealt to many tasks.
    """
    mark = F.monotonically_increasing_id()
    stored = written(rows.orderBy("tree", "doc_id", "leaf").withColumn("mark", mark), "merkle-leaves")
    stored = stored.withColumns(
        {
            "part": F.shiftright("mark", 33),
            "at": F.col("mark").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    every = Window.partitionBy("tree")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("part", "tree")
        .agg(F.count("*").alias("n"), F.min("at").alias("first"))
        .select(
            "part",
            "tree",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"),
            F.sum("n").over(every).alias("total"),
        )
    )
    placed = stored.join(starts, ["part", "tree"]).withColumn("at", F.col("at") + F.col("start"))
    member = F.struct((F.col("at") % WIDTH).alias("place"), "doc_id", "leaf", "offered")
    return placed.groupBy("tree", F.floor(F.col("at") / WIDTH).alias("idx")).agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members")
    )


def _above(nodes: DataFrame) -> DataFrame:
    """The parents of the nodes of a level."""
    child = F.struct((F.col("idx") % WIDTH).alias("place"), "digest")
    found = nodes.groupBy("tree", F.floor(F.col("idx") / WIDTH).alias("idx")).agg(
        F.array_sort(F.collect_list(child)).alias("below"),
        F.ceil(F.first("n_level") / WIDTH).alias("n_level"),
        F.first("n_runs").alias("n_runs"),
        F.sum("climbers").alias("climbers"),
    )
    children = _joined(F.col("below"), "digest")
    return found.withColumn("children", children).withColumn("digest", _hashed(children)).drop("below")


def _levels(first: DataFrame, most: int, purpose: str) -> DataFrame:
    """All nodes above ``first``, whose largest tree has ``most`` nodes, with ``level`` from 2;
    every level is a table in the shared folder before the next one is built from it."""
    found, level, nodes = _above(first.where("false")).withColumn("level", F.lit(2)), 1, first
    while most > 1:
        level, most = level + 1, -(-most // WIDTH)
        nodes = written(_above(nodes.where("n_level > 1")), f"{purpose}-{level}")
        some = nodes.withColumn("level", F.lit(level))
        found = some if level == 2 else found.unionByName(some)
    return found


def _copies(climbers: Column) -> Column:
    return F.ceil(climbers / MEETING).cast("int")


def _linked(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of the sources' trees with their parent: its tree, level and number, the place
    among its children and the number of its copies.

    Within a tree the copies follow from the number of runs below the parent.  The last node of
    a tree finds its parent in ``tops``, one row per tree.
    """
    span = F.pow(F.lit(WIDTH), F.col("level")).cast("long")
    up = F.floor(F.col("idx") / WIDTH)
    inner = nodes.where("n_level > 1").withColumns(
        {
            "up_tree": F.col("tree"),
            "up_level": F.col("level") + 1,
            "up_idx": up,
            "place": (F.col("idx") % WIDTH).cast("int"),
            "copies": _copies(F.least((up + 1) * span, F.col("n_runs")) - up * span),
            "subroot": F.lit(None).cast("binary"),
        }
    )
    last = nodes.where("n_level = 1").join(tops, "tree").withColumn("subroot", F.col("digest"))
    return inner.unionByName(last.select(*inner.columns))


def _joins(upper: DataFrame, idx: Column, level: Column) -> DataFrame:
    """Where ``upper``, the tree over the sources, goes on above a node: keys and copies."""
    return upper.select(
        idx.alias("up_idx"),
        level.alias("level"),
        F.lit(ROOT_TREE).alias("up_tree"),
        F.col("level").alias("up_level"),
        _copies(F.col("climbers")).alias("copies"),
    )


def built(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The climbers, one row per run of leaves, and the nodes above them, both with the link to
    their parent.  ``rows`` come from ``leaves``."""
    found = runs(rows).withColumn("run", F.monotonically_increasing_id())
    found = written(found, "merkle-runs")
    children = _joined(F.col("members"), "leaf")
    level_size = F.ceil(F.col("total") / WIDTH)
    first = found.select(
        "tree",
        "idx",
        "run",
        "members",
        children.alias("children"),
        # a tree of one leaf has that leaf for its last node
        F.when(F.col("total") == 1, children).otherwise(_hashed(children)).alias("digest"),
        level_size.alias("n_level"),
        level_size.alias("n_runs"),
        F.lit(1).cast("long").alias("climbers"),
        F.lit(1).alias("level"),
        (F.col("total") == 1).alias("alone"),
    )
    plain = ["tree", "idx", "digest", "n_level", "n_runs", "climbers"]
    size = first.agg(F.max("n_level")).first()[0] or 1
    inner = _levels(first.select(*plain), size, "merkle-level")
    last = first.select(*plain).unionByName(inner.select(*plain)).where("n_level = 1")
    subroots = dense_index(last.drop("idx"), "tree", name="idx")
    sources = subroots.count()
    top = subroots.withColumns({"tree": F.lit(ROOT_TREE), "n_level": F.lit(sources).cast("long")})
    upper = _levels(top.select(*plain), sources, "merkle-root")

    up, place = F.floor(F.col("idx") / WIDTH).alias("up_idx"), (F.col("idx") % WIDTH).cast("int")
    roots = _joins(upper.where("level = 2"), F.col("idx"), F.lit(1)).drop("level")
    tops = subroots.select("tree", up, place.alias("place")).join(roots, "up_idx", "left")
    onward = _joins(upper, F.col("idx"), F.col("level") - 1)
    over = upper.select("*", up, place.alias("place")).join(onward, ["level", "up_idx"], "left")
    over = over.withColumn("subroot", F.lit(None).cast("binary"))
    nodes = _linked(inner, tops).unionByName(over)
    copies = F.sequence(F.lit(0), _copies(F.col("climbers")) - 1)
    return _linked(first, tops), nodes.withColumn("salt", F.explode(copies))


#: Each step joins the climbers with their parents and gives the siblings found there a row.
CLIMB_SQL = """
WITH RECURSIVE climb (run, step, folds, digest, subroot, siblings, up_tree, up_level, up_idx, place, copies) AS (
  SELECT run, 0, folds, digest, subroot, X'', up_tree, up_level, up_idx, place, copies
  FROM merkle_climbers
  UNION ALL
  SELECT run, step,
    transform(folds, fold -> unhex(sha2(lower(hex(concat(before, fold, behind))), 256))),
    digest, subroot, concat(before, behind), up_tree, up_level, up_idx, place, copies
  FROM (
    SELECT c.run, c.step + 1 AS step, c.folds, n.digest, coalesce(c.subroot, n.subroot) AS subroot,
      substring(n.children, 1, c.place * 32) AS before,
      substring(n.children, c.place * 32 + 33) AS behind,
      n.up_tree, n.up_level, n.up_idx, n.place, n.copies
    FROM climb c JOIN merkle_nodes n
    ON n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx
      AND n.salt = pmod(xxhash64(c.run), c.copies)))
SELECT run, max_by(folds, step) AS folds, max_by(digest, step) AS root, max(subroot) AS subroot,
  aggregate(array_sort(collect_list(named_struct('step', step, 'siblings', siblings))), X'',
    (held, at) -> concat(held, at.siblings)) AS proof
FROM climb GROUP BY run
"""


def _side_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings whose recursion may take as many rows as it needs; the
    caller's settings and views stay as they are."""
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            side.conf.set(key, value)
    side.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return side


def _first_fold(member: Column) -> Column:
    """What the leaf on offer makes of the run's node."""
    leaf_now = F.coalesce(member["offered"], member["leaf"])
    before, behind = _without(F.col("children"), member["place"].cast("int"))
    return F.when(F.col("alone"), leaf_now).otherwise(_hashed(F.concat(before, leaf_now, behind)))


def climbed(climbers: DataFrame, nodes: DataFrame) -> DataFrame:
    """``climbers`` (tables of ``built``) with ``folds``, the digests that their offered leaves
    come to at the root, each value once, ``way``, the place of every member's among them,
    ``root``, ``subroot`` and ``proof``, the siblings of the run's node and of all above it."""
    spark = climbers.sparkSession
    first = F.transform("members", _first_fold)
    start = climbers.withColumn("first", first).withColumn("folds", F.array_distinct("first"))
    way = F.transform("first", lambda fold: F.array_position("folds", fold).cast("int"))
    start = written(start.withColumn("way", way).drop("first"), "merkle-climbers")
    side, places = _side_session(spark), []
    for name, df in (("merkle_climbers", start.drop("members", "children", "way")), ("merkle_nodes", nodes)):
        places.append(work_folder(spark, name))
        df.write.parquet(places[-1])
        side.read.parquet(places[-1]).createOrReplaceTempView(name)
    done, place = side.sql(CLIMB_SQL), work_folder(spark, "merkle-climbed")
    done.write.parquet(place)
    done = spark.read.schema(done.schema).parquet(place)
    return start.select("run", "members", "children", "way").join(done, "run")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    Repeated rows are leaves of their own; null fields are hashed as ``-``, null sources form one
    source, which comes first, and null ids come first within theirs.  A table of one row has its
    leaf as root and the digest of nothing as proof; an empty one gives no rows.
    """
    each = climbed(*built(leaves(docs))).select("*", F.posexplode("members").alias("at", "member"))
    before, behind = _without(F.col("children"), F.col("at"))
    fold = F.element_at("folds", F.element_at("way", F.col("at") + 1))

    def text(digest: Column | str) -> Column:
        return F.lower(F.hex(digest))

    return each.select(
        F.col("member.doc_id").alias("doc_id"),
        text("member.leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text(F.concat(before, behind, "proof")), 256).alias("proof_sha256"),
        text(fold).alias("folded_root"),
        (fold == F.col("root")).alias("verified"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``manifest`` of all documents; where 5 divides the crc32 of the id, the text on offer is
    lower-cased and the row verifies only if that changed nothing."""
    return manifest(table(spark, sf_dir, "documents"))


#: Builds the trees as lists, then climbs row by row.
OP13_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
      || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS front,
    text,
    CASE WHEN xor(list_reduce(
        list_concat([4294967295::BIGINT], list_transform(
          range(1, length(coalesce(doc_id::VARCHAR, '')) + 1),
          lambda i: ord(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
        lambda state, byte: list_reduce(
          list_concat([xor(state, byte)], range(8)),
          lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      ELSE text END AS offered
  FROM documents),
hashed AS (
  SELECT doc_id, source,
    sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(strlen(offered) || ':' || offered, '-')) AS offered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    row_number() OVER () AS id
  FROM hashed),
tree(source, level, digests) AS (
  SELECT source, 0, list(leaf ORDER BY pos) FROM leaves GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, (len(digests) + 15) // 16),
    lambda i: sha256(array_to_string(digests[i * 16 + 1 : i * 16 + 16], '')))
  FROM tree WHERE len(digests) > 1),
subroots AS (
  SELECT source, level AS height, digests[1] AS subroot,
    row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS pos
  FROM tree WHERE len(digests) = 1),
top(level, digests) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(digests) + 15) // 16),
    lambda i: sha256(array_to_string(digests[i * 16 + 1 : i * 16 + 16], '')))
  FROM top WHERE len(digests) > 1),
steps AS (
  SELECT l.id, t.level AS step, t.digests, l.pos // (16 ** t.level)::BIGINT AS p
  FROM leaves l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source AND len(t.digests) > 1
  UNION ALL
  SELECT l.id, s.height + t.level, t.digests, s.pos // (16 ** t.level)::BIGINT
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  JOIN top t ON len(t.digests) > 1),
met AS (
  SELECT id, step,
    array_to_string(digests[p // 16 * 16 + 1 : p], '') AS before,
    array_to_string(digests[p + 2 : p // 16 * 16 + 16], '') AS behind
  FROM steps),
climb(id, step, fold, proof) AS (
  SELECT id, 0, offered, '' FROM leaves
  UNION ALL
  SELECT c.id, c.step + 1, sha256(before || fold || behind), proof || before || behind
  FROM climb c JOIN met m ON m.id = c.id AND m.step = c.step),
done AS (SELECT id, arg_max(fold, step) AS fold, arg_max(proof, step) AS proof FROM climb GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = root AS verified
FROM leaves l JOIN done USING (id)
JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source,
(SELECT digests[1] AS root FROM top WHERE len(digests) = 1)
"""
