"""Neighbours, resampling and the manifest beside brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import cross_polytope, merkle, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 --------------------------------------------------------------------------------------------


def cosines(rows):
    """All answers by comparing every query with every row."""
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows if fits(i, v)))
    found = collections.defaultdict(list)
    for q, a in rows:
        if q % 50 == 0:
            near = sorted(
                (
                    (-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12), i)
                    for i, b in rows
                    if (i, b) != (q, a) and len(a) == len(b)
                ),
            )[:5]
            found[q].append([(i, -s) for s, i in near])
    return found


def fits(i, v):
    return i is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def answers(rows):
    found = collections.defaultdict(dict)
    for row in rows.collect():
        found[row.query_id][row.rank] = (row.vec_id, row.score)
    return {q: [of[r] for r in sorted(of)] for q, of in found.items()}


def same(mine, theirs):
    assert [i for i, _ in mine] == [i for i, _ in theirs]
    assert [s for _, s in mine] == pytest.approx([s for _, s in theirs], abs=1e-9)


def test_hadamard_keeps_lengths():
    rows = np.random.default_rng(1).normal(size=(5, 16))
    turned = cross_polytope.hadamard(rows)
    assert np.allclose((turned**2).sum(1), (rows**2).sum(1))
    assert np.allclose(cross_polytope.hadamard(turned), rows)


@pytest.mark.parametrize("split", [1, 4])
def test_a_vector_probes_its_own_buckets(split):
    rows = cross_polytope._units(np.random.default_rng(2).normal(size=(40, 24)))
    hashes = cross_polytope.Hashes(tables=3, probes=2, split=split)
    own, probed = hashes.buckets(rows), hashes.probed(rows)
    assert own.max() < 2 * 32 * split
    assert (probed == own[:, :, None]).any(2).all()


def test_more_rows_mean_more_buckets():
    splits = [cross_polytope.hashes_for(rows, 64).split for rows in (10, 10**6, 10**7, 10**8, 10**12)]
    assert splits == sorted(splits) and splits[0] == 1 and splits[-1] == 128


def test_recall_and_scores(spark):
    draw = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(1500, 32)).astype(np.float32))]
    found, wanted = answers(cross_polytope.search(vectors(spark, rows), F.col("vec_id") % 50 == 0)), cosines(rows)
    hit = 0
    assert set(found) == set(wanted)
    for query, (near,) in wanted.items():
        assert len(found[query]) == 5
        hit += len({i for i, _ in near} & {i for i, _ in found[query]})
        by_id = dict(near)
        for i, score in found[query]:
            assert score == pytest.approx(by_id.get(i, score), abs=1e-9)
    assert hit >= 0.9 * 5 * len(wanted)


def test_second_hash_divides_buckets_and_finds(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(150, 32))
    rows = [
        (i, (centres[i % 150] + 0.2 * draw.normal(size=32)).astype(np.float32).tolist())
        for i in range(1500)
    ]
    df = vectors(spark, rows)
    given = answers(cross_polytope.search(df, F.col("vec_id") % 50 == 0, split=16))
    wanted = cosines(rows)
    hit = sum(len({i for i, _ in near} & {i for i, _ in given[q]}) for q, (near,) in wanted.items())
    assert hit >= 0.9 * 5 * len(wanted)


def test_copies_ties_and_odd_vectors(spark):
    common = [1.0, 2.0, 0.0, -1.0]
    rows = [(i, common) for i in range(0, 400)]
    rows += [(1000, [1.0, 0.0, 0.0, 0.0]), (1001, [3.0, 0.0, 0.0, 0.0]), (1002, [2.0, 0.0, 0.0, 0.0])]
    rows += [(1050, None), (1100, [0.0] * 4), (1150, [1.0, None, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(1200, [float("nan"), 1.0, 0.0, 0.0]), (1250, [float("inf"), 1.0, 0.0, 0.0]), (1300, [])]
    rows += [(1350, [1e30, 0.0, 0.0, 0.0]), (1400, [1.0, 5.0]), (1401, [1.0, 4.0])]
    rows += [(0, common), (50, [0.0, 0.0, 1.0, 0.0])]
    found = answers(cross_polytope.search(vectors(spark, rows), F.col("vec_id") % 50 == 0))
    wanted = cosines(rows)
    assert set(found) == set(wanted)
    for query, some in wanted.items():
        if query != 50:  # which is two rows
            same(found[query], some[0])
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in found[1400]] == [1401]


def test_no_vectors(spark):
    df = vectors(spark, [(1, [1.0, 2.0])]).where("false").withColumn("entry", F.lit(1)).withColumn("salt", F.lit(1))
    assert cross_polytope.search(df, F.col("vec_id") % 50 == 0).collect() == []
    assert cross_polytope.search(vectors(spark, [(50, [1.0, 2.0])]), F.col("vec_id") % 50 == 0).collect() == []


# 12 --------------------------------------------------------------------------------------------


def resampled(docs, target):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(run.encode()) % 10000 for run in runs]

    counted = [(i, *features(text)) for i, text in docs]
    source = collections.Counter(b for *_, some in counted for b in some)
    wanted = collections.Counter(b for text in target for b in features(text)[1])
    n, m = sum(source.values()), sum(wanted.values())
    gain = [
        math.floor(1000 * math.log((wanted[b] + 1) * (n + 10000) / ((source[b] + 1) * (m + 10000))))
        for b in range(10000)
    ]
    rows = []
    for i, words, some in counted:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in some)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(some), weight, score, None, words])
    able = sorted(
        (row for row in rows if row[5] >= 20),
        key=lambda row: (-row[3], row[0] is None, row[0] or 0, row[1]),
    )
    for rank, row in enumerate(able[: 5 * len(able) // 100]):
        row[4] = rank + 1
    return [tuple(row[:5]) for row in rows]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda row: [(cell is not None, cell or 0) for cell in row])


def test_crcs_of_joined_words():
    draw = random.Random(6)
    words = [bytes(draw.choices(range(97, 123), k=draw.choice([1, 2, 5, 63, 64, 65, 300]))) for _ in range(200)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(word) for word in words])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    crcs = resample.word_crcs(data, starts, sizes)
    assert crcs.tolist() == [zlib.crc32(word) for word in words]
    both = resample.joined_crc(crcs[:-1], crcs[1:], sizes[1:])
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_resample(spark):
    draw = random.Random(7)
    vocabulary = ["Ka", "lo", "mi9", "ten-sur", "va", "Straße", "漢字", "x" * 80, "!", "Ünder"]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(300)]
    rows += [(7, "ka " * 30), (7, "ka " * 30), (None, "lo " * 40), (400, None), (401, ""), (402, "lo mi9 " * 30000)]
    rows += [(500 + i, "va ka lo " * 10) for i in range(200)]
    target = ["ka lo mi9", None, "", "va ka lo va ka lo"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("score", F.lit("mine"))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert in_order(resample.resampled(docs, bench).collect()) == in_order(resampled(rows, target))


def test_resample_ties_are_cut_exactly(spark):
    rows = [(9, "the same twenty words " * 10)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([("the same",)], "text string")
    found = resample.resampled(docs, bench).collect()
    assert sorted(row["rank"] for row in found if row["rank"] is not None) == list(range(1, 11))
    assert len(found) == 200


@pytest.mark.parametrize("count", [1, 2, 7, 99, 100])
def test_cutoff_of_far_numbers(spark, count):
    numbers = [(-(2**63),), (2**63 - 1,), (0,)] + [(n,) for n in range(-40, 57)]
    rows = spark.createDataFrame(numbers, "k long")
    value, below = resample.smallest(rows, "k", count)
    ordered = sorted(n for (n,) in numbers)
    assert value == ordered[count - 1] and below == count - 1


def test_resample_nothing(spark):
    docs = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    none = docs.where("false")
    assert resample.resampled(none, docs).collect() == []
    assert [row["rank"] for row in resample.resampled(docs, none).collect()] == [None]


# 13 --------------------------------------------------------------------------------------------


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests):
    found = [digests]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([hashed("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return found


def manifest(rows):
    def leaf(doc_id, source, lang, n_chars, text):
        fields = (doc_id, source, lang, n_chars, text)
        return hashed("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    sources = collections.defaultdict(list)
    for row in rows:
        doc_id, text = row[0], row[4]
        if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0 and text is not None:
            text = text.translate(LOWER)
        sources[row[1]].append((doc_id is not None, doc_id or 0, leaf(*row), leaf(*row[:4], text)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf for *_, leaf, _ in sorted(sources[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    root, found = top[-1][0], []
    for number, source in enumerate(order):
        for at, (known, doc_id, own, fold) in enumerate(sorted(sources[source])):
            siblings = ""
            for tree, place in ((trees[source], at), (top, number)):
                for level in tree[:-1]:
                    run, here = level[place // 16 * 16 : place // 16 * 16 + 16], place % 16
                    siblings += "".join(run[:here] + run[here + 1 :])
                    fold = hashed("".join(run[:here] + [fold] + run[here + 1 :]))
                    place //= 16
            last = trees[source][-1][0]
            found.append((doc_id if known else None, own, last, root, hashed(siblings), fold, fold == root))
    return found


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, run long, leaf string"


def documents(draw, sources):
    rows = []
    for source, count in sources.items():
        for _ in range(count):
            text = draw.choice([None, "", "Ab c", "ÄÖ ab", "漢字 X", "lower case", "Long " * 3000])
            lang = draw.choice([None, "en"])
            doc_id = draw.choice([None, *range(10 * count)])
            rows.append((doc_id, source, lang, len(text or ""), text, 3, "mine"))
    return rows + rows[:3]


@pytest.mark.parametrize(
    "sources",
    [
        {"a": 1},
        {None: 1, "": 1, "a": 16, "b": 17, "é": 257, "Z": 40, "^": 2},
        {f"s{n}": 1 + n % 3 for n in range(40)},
        {"hot": 5000, None: 300},
    ],
)
def test_manifest(spark, sources):
    rows = documents(random.Random(8), sources)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = sorted(map(str, (tuple(row) for row in merkle.manifest(df).collect())))
    assert found == sorted(map(str, manifest([row[:5] for row in rows])))


def test_hot_nodes_are_met_in_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MEETING", 2)
    rows = documents(random.Random(9), {"hot": 700, "b": 40})
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, manifest([row[:5] for row in rows])))


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([(1, "a", None, 2, "Ab", 3, "mine")], SCHEMA)
    (row,) = merkle.manifest(one).collect()
    assert row.root == row.subroot == row.leaf and row.proof_sha256 == hashed("")
    assert merkle.manifest(one.where("false")).collect() == []


def test_the_session_keeps_its_settings(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    merkle.manifest(spark.createDataFrame([(1, "a", None, 2, "Ab", 3, "mine")], SCHEMA)).count()
    assert spark.conf.get(key) == before
    assert not spark.catalog.tableExists("merkle_nodes")
