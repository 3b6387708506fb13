"""The training-data operators beside brute force, and their odd inputs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldmill.llm import (
    context_tree,
    decontaminate,
    language,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    toxicity,
    winnowing,
)
from fieldmill.llm.common import texts

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "The cat sat on the mat and the dog sat on the log by the old mill stream today."),
    (6, "The cat sat on the mat and the dog sat on the log by the old mill stream today."),
    (7, "ÄÖÜ straße éèê — 漢字かな 🙂 \x00 end"),
    (8, LONG),
    (8, LONG),
    (9, "x" * 70_000),
    (None, "a row without an id"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators'."""
    names = "slot shard fp score spans sequence_id size rank bucket k guest chosen row label"
    rows = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for name in names.split():
        rows = rows.withColumn(name, F.lit("mine"))
    return rows.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def corpus(spark):
    """Random texts over few words, so that passages repeat, with exact copies."""
    draw = random.Random(5)
    vocabulary = ["ka", "lo", "mi", "ten", "sur", "va"]
    passages = [" ".join(draw.choices(vocabulary, k=20)) for _ in range(6)]
    rows = []
    for doc_id in range(120):
        parts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))]
        if draw.random() < 0.5:
            parts.insert(draw.randint(0, 1), draw.choice(passages))
        rows.append((doc_id * 7 % 120, "  ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + rows[:3]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


# 1 ---------------------------------------------------------------------------------------------


def test_lookup_table_is_filled_turn_by_turn():
    names = [f"s{i}" for i in range(5)]
    table = sharding.lookup_table(names, 31)
    left = set(range(31))
    for turn in range(31):
        name = names[turn % 5]
        digest = hashlib.md5(name.encode()).hexdigest()
        first, step = int(digest[:15], 16) % 31, int(digest[15:30], 16) % 30 + 1
        slot = next(s for s in ((first + j * step) % 31 for j in range(31)) if s in left)
        left.discard(slot)
        assert table[slot] == turn % 5


def test_removing_a_shard_moves_little():
    names = [f"s{i}" for i in range(16)]
    before, after = sharding.lookup_table(names, 4099), sharding.lookup_table(names[:-1], 4099)
    assert max(collections.Counter(before).values()) - min(collections.Counter(before).values()) <= 1
    moved = sum(a != b for a, b in zip(before, after) if a != 15)
    assert moved < 0.2 * 4099


@pytest.mark.parametrize("names, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b"], 1)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_place(odd, empty):
    found = sharding.place(odd, "doc_id", ["a", "b", "c"], 31)
    rows = found.collect()
    assert len(rows) == len(ODD) and found.columns.count("slot") == 1
    table = sharding.lookup_table(["a", "b", "c"], 31)
    for row in rows:
        key = "" if row.doc_id is None else str(row.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 31
        assert (row.slot, row.shard) == (slot, "abc"[table[slot]])
    assert sharding.place(empty, "doc_id", ["a"], 31).count() == 0


# 2 ---------------------------------------------------------------------------------------------


def whole_ids(text):
    tokenizer = packing._tokenizer(packing.tokenizer_path())
    return [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]


def test_encoder_equals_whole_texts():
    cases = [text or "" for _, text in ODD if text is not LONG] + [
        "a　b don't I'll 12,3. <|endoftext|> x<|startoftext|>",
        "ΟΔΟΣ Σίσυφος É é \x1c\x1dfoo\r\nbar,. baz.,",
        "word. word, Word. wörter, ... , .",
    ]
    encoder = packing.Encoder(packing.tokenizer_path())
    for text, found in zip(cases, encoder.encode(cases)):
        assert np.frombuffer(found, "<u4").tolist() == whole_ids(text)
    long = encoder.encode([LONG], stretch=1000)[0]
    assert np.frombuffer(long, "<u4").tolist() == whole_ids(LONG)


def test_letters_that_become_marks():
    odd = [c for c in map(chr, range(0x110000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()]
    assert len(odd) >= 60 and {"\u0130", "\u0958", "\u09dc"} <= set(odd)
    cases = ["T\u00dcRK\u0130YE and of the water"]
    cases += [f"above {c} and, a{c} of {c}b. the a{c}, water. z\u00fcrich a{c}b {c}." for c in odd]
    cases.append(" ".join(cases))
    found = packing.Encoder(packing.tokenizer_path()).encode(cases)
    for text, ids in zip(cases, found):
        assert np.frombuffer(ids, "<u4").tolist() == whole_ids(text)


def test_packing(odd, empty):
    rows = packing.packed(texts(odd)).collect()
    by_sequence = collections.defaultdict(list)
    for row in rows:
        by_sequence[row.sequence_id].append(row)
    for parts in by_sequence.values():
        at = 0
        for row in sorted(parts, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= packing.CAPACITY
    for doc_id, text in set(ODD):
        ids = whole_ids(text or "")
        copies = ODD.count((doc_id, text))
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids)
        for row in own:
            cut = np.array(ids[row.start : row.start + row.length], "<u4").tobytes()
            assert row.ids_crc32 == zlib.crc32(cut) and row.doc_tokens == len(ids)
    assert packing.packed(texts(empty)).count() == 0


def test_plan_holds_every_piece_and_wastes_little():
    draw = np.random.default_rng(3)
    counts = collections.Counter(np.minimum(draw.lognormal(3.6, 1, 20_000).astype(int) + 1, 256).tolist())
    plan = packing.plan(counts, 256)
    held = collections.Counter()
    for times, pattern in plan:
        assert sum(size * n for size, n in pattern.items()) <= 256
        for size, n in pattern.items():
            held[size] += times * n
    assert held == counts
    used = sum(times for times, _ in plan) * 256
    assert sum(size * n for size, n in counts.items()) > 0.99 * used


def test_linear_program_on_a_known_case():
    # rolls of 9: lengths 4 and 5 pair up, 3 fills alone
    found = packing.linear_program(np.array([3, 4, 5]), np.array([30.0, 10.0, 10.0]), 9)
    assert sum(amount for _, amount in found) == pytest.approx(20, rel=2e-3)


def test_ids_column(spark):
    rows = packing.pieces(frame(spark, [(1, "some words here")]), packing.tokenizer_path(), 4, True)
    ids = [i for row in sorted(rows.collect(), key=lambda r: r.start) for i in row.ids]
    assert ids == whole_ids("some words here")


# 3 ---------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    draw = random.Random(2)
    plain = ["river", "stone", "cloud", "paper", "green", "walk", "seven", "light"]
    rows = []
    for doc_id in range(400):
        words = draw.choices(plain, k=draw.randint(5, 60))
        label = int(draw.random() < 0.3)
        if label:
            words[draw.randrange(len(words))] = draw.choice(["moron", "scumbag"])
        rows.append((doc_id, " ".join(words), label))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(labelled)
    scores = {r.doc_id: r.score for r in toxicity.score(labelled, model).collect()}
    right = sum((scores[i] >= toxicity.THRESHOLD) == bool(label) for i, _, label in rows)
    assert right >= 0.98 * len(rows)
    found = toxicity.score(texts(odd), model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    left = toxicity.accepted(odd, model)
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert toxicity.score(texts(empty), model).count() == 0
    assert toxicity.fit(labelled.where("label = 0")).score("moron") < 0.5
    assert toxicity.fit(labelled.where("false")).score("") == pytest.approx(0.5)


def test_toxic_ratios_cover_all_labelled_rows(spark):
    # a word of 40 toxic texts in 400: a sample of 20 a class has too few of them
    rows = [(i, "zyxwv" if i < 40 else "plain river stone", int(i < 40 or i % 5 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(labelled, 20)
    found = toxicity.ratios(labelled.select("text", "label"), 112, 288).collect()
    assert toxicity.PER_CLASS == 4000
    assert set(np.flatnonzero(model.weights)) <= {r.gram for r in found}
    expected = np.log(41 / 114) - np.log(1 / 290)
    own = {int(g) for g in toxicity.features("zyxwv")} - {int(g) for g in toxicity.features("plain river stone")}
    ratio = {r.gram: r.ratio for r in found}
    assert all(ratio[g] == pytest.approx(expected) for g in own)
    assert all(model.weights[g] > 0 for g in own)


def test_toxic_features_are_sets():
    found = toxicity.features("Aa aa aa")
    assert len(set(found.tolist())) == found.size
    assert set(found.tolist()) == set(toxicity.features("aa AA  aa aa").tolist())
    assert toxicity.features(" \n").size == 0


# 4 ---------------------------------------------------------------------------------------------


def test_language(spark, odd, empty):
    known = language.prototypes(
        spark.createDataFrame(
            [
                ("the quick brown fox and the lazy dog went with them", "en"),
                ("der schnelle braune fuchs und der faule hund gingen mit ihnen", "de"),
                ("unlabelled", None),
            ],
            "text string, lang string",
        )
    )
    assert sorted(known) == ["de", "en"]
    codes = language.trigrams("der Hund")
    pairs, last = language._tables()
    brute = sum((pairs[c // 64] * last[c % 64]).astype(float) for c in codes)
    assert np.allclose(language.bundle(*np.unique(codes, return_counts=True)), brute)
    found = {r.doc_id: r for r in language.identify(texts(odd), known).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == "und"
    assert found[5].lang_pred == "en" and 0 < found[5].score <= 1
    assert found[5].score == found[6].score
    assert language.identify(texts(empty), known).count() == 0
    alone = language.identify(texts(odd), language.prototypes(odd.where("false").select("text", "lang")))
    assert {(r.lang_pred, r.score) for r in alone.collect()} == {("und", 0.0)}


def test_every_letter_has_its_own_vector(spark):
    # letters 37 code points apart, which a table of 37 classes cannot tell from each other
    here = "".join(chr(0x4E00 + at) for at in range(30))
    there = "".join(chr(ord(c) + 37) for c in here)
    rows = [(here, "one"), (there, "two")]
    known = language.prototypes(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, here[3:20]), (2, there[3:20]), (3, "ß é ñ")], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(docs, known).collect()}
    assert (found[1].lang_pred, found[2].lang_pred) == ("one", "two")
    assert found[1].score > 0.5

    def brute(text: str) -> np.ndarray:
        letters = [0, *[ord(c) for c in text], 0]
        return sum(
            np.roll(language.letter_vector(a), 2).astype(int)
            * np.roll(language.letter_vector(b), 1)
            * language.letter_vector(c)
            for a, b, c in zip(letters, letters[1:], letters[2:])
        )

    assert np.array_equal(known["one"], brute(here))
    vector = brute(here[3:20])
    cosine = vector @ known["one"] / np.linalg.norm(vector) / np.linalg.norm(known["one"])
    assert abs(found[1].score - cosine) < 1e-6
    many = language._Profile()
    many.MANY = 8  # adds up whenever eight are gathered
    for text in (here, there, "äöü und so", here):
        many.add(*language._counted(text))
    whole = sum(language.bundle(*language._counted(t)) for t in (here, there, "äöü und so", here))
    assert np.array_equal(many.vector(), whole)


# 5 ---------------------------------------------------------------------------------------------


def chosen(text):
    found = re.findall(r"(?=(\S{1,4}(?:\s*\S{1,4}){0,2}))\S{1,4}", text, re.ASCII)
    hashed = [(xxhash.xxh64_intdigest(g.encode(), 42) & 0xFFFFFFFF, -i) for i, g in enumerate(found)]
    windows = (hashed[i : i + 4] for i in range(max(1, len(hashed) - 3)))
    return {(h, -i) for h, i in (min(w) for w in windows if w)}


def test_winnowing(spark, odd, empty):
    rows = [(d, t or "") for d, t in ODD]
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1].encode()))
    got = winnowing.with_next(texts(odd)).collect()
    assert len(got) == len(rows)
    following = collections.Counter((r.doc_id, r.text, r.next_text) for r in got)
    expected = [(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])]
    assert following == collections.Counter(expected)
    prints = winnowing.fingerprints(odd).collect()
    for row in prints:
        # the brute force reads blanks as Java does
        assert {(p.hash, p.position) for p in row.fingerprint} == chosen(row.text or "")
    assert winnowing.with_next(texts(empty)).count() == 0


def test_next_over_many_buckets(spark):
    ids = random.Random(1).sample(range(10**12), 3000)
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(5)
    ids.sort()
    expected = dict(zip(ids, map(str, ids[1:] + ids[:1])))
    assert {r.doc_id: r.next_text for r in winnowing.with_next(rows).collect()} == expected


def test_shared_passages_share_a_fingerprint(spark):
    passage = "every shared passage of some length must leave a common mark"
    rows = frame(spark, [(1, "first text " + passage), (2, "another one " + passage + " tail")])
    a, b = (
        {p.hash for p in r.fingerprint} for r in winnowing.fingerprints(rows).orderBy("doc_id").collect()
    )
    assert a & b


@pytest.mark.parametrize("shift", [1, 2, 3, 4])
def test_unspaced_passages_share_a_fingerprint_at_any_place(spark, shift):
    passage = "\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a\u6587\u306f\u7a7a\u767d\u3092\u6301\u305f\u306a\u3044\u3002\u3060\u304b\u3089\u4f4d\u7f6e\u304c\u305a\u308c\u308b"
    rows = winnowing.with_next(frame(spark, [(1, passage), (2, "x" * shift + passage)]))
    likeness = winnowing.likeness(winnowing.hashes(F.col("chosen")), winnowing.hashes(F.col("next_chosen")))
    assert all(r[0] > 0.4 for r in rows.select(likeness).collect())


def test_grams_at_every_character(spark):
    rows = frame(spark, [(i, text or "") for i, (_, text) in enumerate(ODD) if text is not LONG])
    for row in rows.select("text", winnowing.winnowed_characters(F.col("text")).alias("c")).collect():
        found = re.findall(r"(?=(\S(?:\s*\S){11}))\S", row.text, re.ASCII)
        found = found or re.findall(r"\S(?:\s*\S)*", row.text, re.ASCII)
        hashed = [(xxhash.xxh64_intdigest(g.encode(), 42) & 0xFFFFFFFF, -i) for i, g in enumerate(found)]
        windows = (hashed[i : i + 4] for i in range(max(1, len(hashed) - 3)))
        best = {min(w) for w in windows if w}
        assert {(v >> 31, (v & (1 << 31) - 1) - (1 << 31) + 1) for v in row.c} == best


# 6 ---------------------------------------------------------------------------------------------


def removed(rows, window=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = collections.Counter()
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[(d, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


def digests(df):
    return collections.Counter(tuple(r) for r in substring.digests(df).collect())


def test_substring_dedup(spark, corpus, odd, empty, monkeypatch):
    assert digests(frame(spark, corpus)) == removed(corpus)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 500)
    monkeypatch.setattr(substring, "CHUNK", 300)
    assert digests(frame(spark, corpus)) == removed(corpus)
    last = [((1 << 63) - 1 if d is None else d, t) for d, t in ODD]
    expected = removed(last)
    got = digests(texts(odd))
    assert collections.Counter({(d or (1 << 63) - 1, *r): n for (d, *r), n in got.items()}) == expected
    assert digests(texts(empty)) == {}


def test_repeated_ids_with_other_texts(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(5, passage), (5, "x " + passage), (3, "y " + passage), (5, passage)]
    assert digests(frame(spark, rows)) == removed(rows)


def test_cut_texts_keep_their_blanks(spark, odd):
    passage = " ".join(f"w{i}" for i in range(13))
    rows = frame(spark, [(1, passage), (2, f"a\n{passage}  b\tc")])
    got = {r.doc_id: r for r in substring.cleaned(rows).collect()}
    assert got[1].text == passage and got[1].spans == []
    assert got[2].text == "a\nb\tc" and got[2].spans == [[1, 14]]
    out = substring.rewritten(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert out.where("doc_id = 1").first().text is None
    assert out.where("doc_id = 6").first().n_chars == 0


# 7 ---------------------------------------------------------------------------------------------


def edit_distance(item, text):
    previous = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        current = [i]
        for j, b in enumerate(text, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (a != b)))
        previous = current
    return min(previous)


def test_myers_distance():
    draw = random.Random(4)
    for _ in range(300):
        item = "".join(draw.choices("abc", k=draw.randint(1, 80)))
        text = "".join(draw.choices("abc", k=draw.randint(0, 60)))
        assert decontaminate.distance(item, text)[0] == edit_distance(item, text)


def test_decontamination_finds_all_within_the_budget(spark, odd, empty):
    draw = random.Random(9)
    letters = "abcdefghij "
    items = [(i, "".join(draw.choices(letters, k=draw.randint(40, 120)))) for i in range(12)]
    rows = []
    for doc_id in range(150):
        text = "".join(draw.choices(letters, k=draw.randint(0, 200)))
        if doc_id % 3:
            item = list(decontaminate.normalized(draw.choice(items)[1]))
            for _ in range(draw.randint(0, 9)):
                item[draw.randrange(len(item))] = draw.choice(["", "z", "ab"])
            text = text[:50] + " " + "".join(item).upper() + "\n" + text[50:]
        rows.append((doc_id, text))
    listed = spark.createDataFrame(items, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(frame(spark, rows), listed).collect()}
    for (doc_id, text), (item_id, item) in itertools.product(rows, items):
        item = decontaminate.normalized(item)
        edits = edit_distance(item, decontaminate.normalized(text))
        assert ((doc_id, item_id) in got) == (edits <= decontaminate.budget(item))
    left = decontaminate.clean(odd, listed)
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert decontaminate.matches(texts(empty), listed).count() == 0
    strange = spark.createDataFrame([(1, None), (2, ""), (3, " .. "), (None, "abc")], "doc_id long, text string")
    assert decontaminate.matches(texts(odd), texts(strange)).count() == 0
    assert decontaminate.matches(texts(odd), listed.where("false")).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} of the list") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (100,))
    docs = frame(spark, [(i, f"see item number {i} of the list now") for i in range(20)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).where("edits = 0").collect()}
    assert got == {(i, i) for i in range(20)}


# 8 ---------------------------------------------------------------------------------------------


def tree_logs(trained, depth):
    """The scores written out with dictionaries: nodes by (context, choices)."""
    counts = collections.defaultdict(lambda: [0, 0])
    for data in trained:
        for at in range(len(data)):
            for d in range(depth + 1):
                context = (bytes(depth) + data)[at + depth - d : at + depth]
                for level in range(8):
                    bit = data[at] >> (7 - level) & 1
                    counts[(context, 1 << level | data[at] >> (8 - level))][bit] += 1
    children = collections.defaultdict(list)
    for context, prefix in counts:
        if context:
            children[(context[1:], prefix)].append((context, prefix))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        own = kt(*counts[node])
        if len(node[0]) == depth:
            return own
        return float(np.logaddexp(own, sum(map(weighted, children[node])))) - math.log(2)

    stops = {node: math.exp(kt(*counts[node]) - math.log(2) - weighted(node)) for node in list(counts)}

    def chance(context, prefix, bit, d):
        node = (context[len(context) - d :], prefix)
        if node not in stops:
            return None if d else 0.5
        own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
        deeper = chance(context, prefix, bit, d + 1) if d < depth else None
        return own if deeper is None else stops[node] * own + (1 - stops[node]) * deeper

    def score(data):
        total = 0.0
        for at in range(len(data)):
            context = (bytes(depth) + data)[at : at + depth]
            for level in range(8):
                bit = data[at] >> (7 - level) & 1
                total += math.log10(chance(context, 1 << level | data[at] >> (8 - level), bit, 0))
        return total

    return score


@pytest.mark.parametrize("depth", [2, 4])
def test_context_tree_scores(spark, depth):
    draw = random.Random(3)
    rows = [
        (i, "  ".join(draw.choices(["Ab", "abc", "ca", "é"], k=draw.randint(0, 9))), i % 4 != 0)
        for i in range(24)
    ] + [(90, "unseen Zebra", False), (90, "unseen Zebra", False), (91, "", True)]
    data = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    got = context_tree.scored(data, depth).collect()
    assert len(got) == len(rows)
    coded = [context_tree.coded(context_tree.words_of(t)) for _, t, _ in rows]
    score = tree_logs([c for c, r in zip(coded, rows) if r[2]], depth)
    counts = collections.Counter()
    for _, text, learn in rows:
        if learn:
            counts.update([*text.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    expected = {}
    for (doc_id, text, learn), data_ in zip(rows, coded):
        words = [*text.encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        known = sum(counts[w] > 0 for w in words)
        expected[doc_id] = (not learn, len(words), known, n, base, score(data_))
    for row in got:
        held_out, n_tokens, n_known, total, base, model = expected[row.doc_id]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held_out, n_tokens, n_known, total)
        assert row.base_score == pytest.approx(base) and row.score == pytest.approx(model, rel=1e-5)


def test_context_tree_odd_inputs(odd, empty):
    learn = texts(odd).withColumn("learn", F.col("doc_id").isNotNull())
    got = context_tree.scored(learn).collect()
    assert len(got) == len(ODD) and all(r.score <= 0 for r in got)
    nothing = context_tree.scored(texts(odd).withColumn("learn", F.lit(False))).collect()
    one = next(r for r in nothing if r.doc_id == 4)
    assert one.score == pytest.approx(4 * 8 * math.log10(0.5)) and one.train_tokens == 0
    assert context_tree.scored(texts(empty).withColumn("learn", F.lit(True))).count() == 0


def test_model_blocks_add_up(spark, corpus):
    rows = frame(spark, corpus).withColumn("learn", F.lit(True))
    found = context_tree.model(context_tree.counted(rows, 5))
    whole = context_tree.tree_scores(rows, found)
    parts = context_tree.tree_scores(rows, found, block=400)
    a = sorted((r.doc_id, round(r.score, 3)) for r in whole.collect())
    assert a == sorted((r.doc_id, round(r.score, 3)) for r in parts.collect())


def test_lookup():
    draw = np.random.default_rng(0)
    keys = np.unique(draw.integers(0, 1 << 62, 5000).astype(np.uint64))
    keys = np.concatenate(([np.uint64(0)], keys))
    table = context_tree.Lookup(keys, np.arange(1, keys.size + 1))
    assert (table.get(keys) == np.arange(1, keys.size + 1)).all()
    assert (table.get(keys[1:] ^ np.uint64(1 << 63)) == 0).all()


# 9 ---------------------------------------------------------------------------------------------


def test_quality(spark, odd, empty):
    draw = random.Random(6)
    rows = []
    for i in range(300):
        host = f"h{i % 3}"
        good = draw.random() < (0.9 if host == "h0" else 0.4)
        text = "A plain line of words. Another line." if good else "BUY!! NOW!! $$$ ### BUY!!"
        rows.append((i, text, host, f"p{i % 2}", int(good) if i % 2 else None))
    data = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, label int")
    look = quality.described(data, F.col("text"), F.col("host"), F.col("path"), "doc_id", "label")
    found = {r.doc_id: r for r in quality.judged(look.drop("label"), look).collect()}
    assert all((found[r[0]].score >= 0.5) == r[1].startswith("A") for r in rows)
    known = [r for r in rows if r[4] is not None]
    share = (sum(r[4] for r in known) + 0.5) / (len(known) + 1)
    hosts = collections.defaultdict(list)
    for r in known:
        hosts[r[2]].append(r[4])
    beyond = sum((sum(v) - len(v) * share) ** 2 - len(v) * share * (1 - share) for v in hosts.values())
    most = sum(len(v) * (len(v) - 1) * share * (1 - share) for v in hosts.values())
    strong = 1 / (beyond / most) - 1
    sites = {(r.host, r.path): r.prior for r in quality.sites(look.where("label is not null"), share).collect()}
    for host, labels in hosts.items():
        assert sites[(host, None)] == pytest.approx((sum(labels) + strong * share) / (len(labels) + strong))
        low, high = sorted((share, sum(labels) / len(labels)))
        assert low <= sites[(host, None)] <= high
    strange = quality.described(odd, F.col("text"), F.lit(None), F.col("lang"), "doc_id")
    judged = quality.judged(strange, look).collect()
    assert len(judged) == len(ODD) and all(0 <= r.score <= 1 for r in judged)
    nothing = quality.judged(strange, look.where("false")).collect()
    assert {r.score for r in nothing} == {0.5}
    assert quality.judged(strange.where("false"), look).count() == 0


def _worth(groups):
    """Rows a parent's share is worth, from (good, n, share) of each group."""
    beyond = sum((g - n * p) ** 2 - n * p * (1 - p) for g, n, p in groups)
    most = sum(n * (n - 1) * p * (1 - p) for g, n, p in groups)
    return 1 / min(max(beyond / most, 1e-6), 0.999) - 1 if most and beyond > 0 else 1e6


@pytest.mark.parametrize("share_of_hot", [1000, 2, 1])
def test_quality_against_brute_force(spark, monkeypatch, share_of_hot):
    """Evidence, both shrinkages and posterior of every row; all, one or no site is hot."""
    monkeypatch.setattr(quality, "HOT_SHARE", share_of_hot)
    draw = random.Random(16)
    rows = []
    for i in range(400):
        host = "h0" if draw.random() < 0.6 else f"h{draw.randrange(1, 5)}"
        path = "p0" if host == "h0" else f"p{draw.randrange(4)}"
        good = draw.random() < {"h0": 0.8, "h1": 0.2}.get(host, 0.3 + 0.15 * int(path[1]))
        text = " ".join(draw.choice(["word", "Plain", "line.", "7", "$$", "END!"][3 * (not good and draw.random() < 0.7):]) for _ in range(draw.randint(0, 40)))
        label = int(good) if host != "h4" and draw.random() < 0.7 else None
        rows.append((i, text, host, path, label))
    data = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, label int")
    look = quality.described(data, F.col("text"), F.col("host"), F.col("path"), "doc_id", "label")
    bins = [r.asDict() for r in look.collect()]
    names = [c for c in look.columns if c.startswith("m_")]
    known = [r for r in bins if r["label"] is not None]
    n, n_good = len(known), sum(r["label"] for r in known)
    share = (n_good + 0.5) / (n + 1)

    def ratio(name, cell):
        cells = {r[name] for r in known}
        if cell not in cells:
            return 0.0
        good = sum(r["label"] for r in known if r[name] == cell)
        bad = sum(1 - r["label"] for r in known if r[name] == cell)
        half = 0.5 * len(cells)
        return math.log((good + 0.5) / (n_good + half)) - math.log((bad + 0.5) / (n - n_good + half))

    ratios = {(name, r[name]): ratio(name, r[name]) for name in names for r in bins}

    by_host, by_path = collections.defaultdict(list), collections.defaultdict(list)
    for r in known:
        by_host[r["host"]].append(r["label"])
        by_path[r["host"], r["path"]].append(r["label"])
    strong = _worth([(sum(v), len(v), share) for v in by_host.values()])
    host_prior = {h: (sum(v) + strong * share) / (len(v) + strong) for h, v in by_host.items()}
    strong = _worth([(sum(v), len(v), host_prior[h]) for (h, _), v in by_path.items()])
    path_prior = {k: (sum(v) + strong * host_prior[k[0]]) / (len(v) + strong) for k, v in by_path.items()}

    found = {r.doc_id: r for r in quality.judged(look.drop("label"), look).collect()}
    assert len(found) == len(rows)
    for r in bins:
        prior = path_prior.get((r["host"], r["path"]), host_prior.get(r["host"], share))
        evidence = quality.TEMPER * sum(ratios[name, r[name]] for name in names)
        posterior = 1 / (1 + (1 - prior) / prior * math.exp(-evidence))
        got = found[r["doc_id"]]
        assert got.prior == pytest.approx(prior) and got.evidence == pytest.approx(evidence)
        assert got.score == pytest.approx(posterior)


# 10 --------------------------------------------------------------------------------------------


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks(3, list(range(64)))
    draw = random.Random(8)
    for _ in range(3000):
        differing = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3)))
        assert any(mask & differing == 0 for mask in masks)
    assert len(masks) == 15 and min(m.bit_count() for m in masks) >= 32


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(pairs):
    fps = sorted(set(f for _, f in pairs))
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for doc_id, f in pairs:
        least[top(f)] = min(least.get(top(f), doc_id), doc_id)
    return {(doc_id, f): least[top(f)] for doc_id, f in pairs}


@pytest.mark.parametrize("hot, pairwise", [(4096, 8192), (3, 2)])
def test_links_and_components(spark, monkeypatch, hot, pairwise):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    draw = random.Random(11)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(10):
            fps.append(base)
            for bit in draw.sample(range(64), draw.randint(0, 3)):
                base ^= 1 << bit
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3))
    found = {r.node & (1 << 64) - 1: r.component for r in simhash.components(edges).collect()}
    expected = plain_components([(f, f) for f in set(fps)])
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for (_, f), top in expected.items():
        groups[top].add(f)
    for f in set(fps):
        mine[found.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash(spark, corpus, odd, empty):
    rows = [(d, t or "") for d, t in corpus]
    got = simhash.grouped(frame(spark, corpus)).collect()
    pairs = [(d, plain_fingerprint(t)) for d, t in rows]
    expected = plain_components(pairs)
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == sorted(pairs)
    assert all(expected[(r.doc_id, r.fp & (1 << 64) - 1)] == r.component_id for r in got)
    found = {r.doc_id: r for r in simhash.grouped(texts(odd)).collect()}
    assert found[1].fp == 0 and found[3].component_id == 1
    assert found[6].component_id == 5
    left = simhash.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 4, 5, 7, 8, 8, 9, None], key=str)
    assert simhash.grouped(texts(empty)).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_stage_keeps_one_of_each_component(spark, monkeypatch, hot):
    """Near copies at every distance: the stage is the operator's components, no more, no less."""
    monkeypatch.setattr(simhash, "HOT", hot)
    draw = random.Random(12)
    rows = []
    for _ in range(25):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(20, 400))]
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 80))):
                words[draw.randrange(len(words))] = f"w{draw.randrange(5000)}"
    rows += [(1000, ""), (1001, None), (1002, "few words"), (1003, "few  Words")]
    pairs = [(d, plain_fingerprint(t or "")) for d, t in rows]
    expected = {d: top for (d, _), top in plain_components(pairs).items()}
    different = {t for _, t in rows}
    assert len(set(expected.values())) < len(different)  # some links are between different texts
    assert len(set(expected.values())) > 25  # and some near copies are too far apart
    left = simhash.deduplicated(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in left) == sorted(set(expected.values()))


def test_every_row_is_judged_by_its_own_text(spark, tmp_path):
    """The query itself, with null and repeated ids, beside the stage's filter."""
    item = "what is the capital of the small island that lies north of the cape"
    rows = [(1, item), (None, f"some {item} here"), (3, "clean"), (4, None), (4, item.upper()), (None, "clean"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    other = "quite another question that nobody asks"
    spark.createDataFrame([(8, item), (9, None), (7, item), (6, other)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    found = decontaminate.op7_decontamination(spark, str(tmp_path))
    got = [(row.doc_id, row.leaked, row["items"], row.edits) for row in found.collect()]
    wanted = [(i, True, [7, 8], 0) if text and item in text.lower() else (i, False, [], None) for i, text in rows]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    kept = decontaminate.clean(docs, decontaminate.test_items(spark, str(tmp_path)))
    assert kept.count() == sum(not leaked for _, leaked, *_ in got)


def test_blocks_of_items_add_up(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "blocks", lambda items: iter([[(1, "first item text")], [(2, "second item text")]]))
    docs = spark.createDataFrame([(1, "the second item text and the first item text"), (2, "second itex text")], "doc_id long, text string")
    found = decontaminate.judged(docs, None, 0.1).orderBy("doc_id").collect()
    assert [(row["items"], row.edits) for row in found] == [([1, 2], 0), ([2], 1)]


def test_a_changed_end_gives_the_fingerprint_of_the_whole(spark):
    """Beginnings and ends around the lengths where grams and windows begin to reach over."""
    draw = random.Random(12)
    texts_, rows = ["", " ", "a", "abc def"], []
    for size in (*range(10, 40), 70, 300):
        texts_.append("".join(draw.choice(["a", "b", "ab ", "  ", "é", "漢", "\n"]) for _ in range(size)))
    for text in texts_:
        for following in ("", "x", " y ", "zz z" * 9, draw.choice(texts_)):
            rows.append((text, following))
    df = spark.createDataFrame(rows, "text string, following string").repartition(3)
    known = winnowing.reusable(F.col("text"), winnowing._cut(F.col("text")))
    parts = winnowing.edited_parts(F.col("text"), F.col("following"))
    found = df.withColumn("known", known).select(
        "text",
        "following",
        F.col("known.chosen").alias("chosen"),
        winnowing.winnowed_characters(F.col("text")).alias("plain"),
        winnowing.changed_end(F.col("known"), *parts).alias("changed"),
        winnowing.winnowed_characters(F.concat(*parts)).alias("whole"),
    )
    for row in found.collect():
        assert row.chosen == row.plain, row.text
        assert row.changed == row.whole, (row.text, row.following)
