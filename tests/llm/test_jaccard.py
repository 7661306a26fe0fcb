import random

import corpus_pipeline
import numpy as np

from passagekit.llm import jaccard


def plain_groups(texts):
    """Least id of each row's group, by all pairs."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def near_texts():
    """Chains of near copies around the bound, a common passage, short and empty texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 3000)}"
    common = " ".join(word() for _ in range(40))
    texts = [None, "", " ", "one two", "ONE  two", "one two three four five", "one two three four six"]
    for n in (12, 30, 80, 200):
        for _ in range(3):
            base = [word() for _ in range(n)]
            for edits in range(10):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 25))):
                    copy[rng.randrange(n)] = word()
                texts.append(" ".join(copy) + (" " + common if edits % 4 == 3 else ""))
    rng.shuffle(texts)
    return texts


def test_groups_against_all_pairs(spark):
    texts = near_texts()
    want = plain_groups(texts)
    assert len(set(want)) < len(want) - 20
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    assert got == dict(enumerate(want))
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(set(want))


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, place int"
    text = " ".join(map(str, range(50)))
    rows = [(None, text, 1), (4, text, 2), (4, "other words", 3), (2, text + " 50", 4), (None, "alone", 5), (9, None, 6), (8, " ", 7), (4, text, 2)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in jaccard.dedup(docs).collect() if r.doc_id is not None)
    assert got == [(2, text + " 50", 4), (4, "other words", 3), (8, " ", 7)]
    assert [r.text for r in jaccard.dedup(docs).filter("doc_id is null").collect()] == ["alone"]
    assert jaccard.dedup(docs).columns == docs.columns
    assert jaccard.near_groups(spark.createDataFrame([], schema)).count() == jaccard.dedup(spark.createDataFrame([], schema)).count() == 0


def test_cell_counts_never_bound_too_low():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-(1 << 63), 1 << 63, n)) for n in (1, 2, 30, 255, 256, 300, 2100)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(-(1 << 63), 1 << 63, len(s) // 8)])) for s in sets]
    cells = [jaccard.cell_counts(s) for s in sets]
    for i, x in enumerate(sets):
        most = jaccard.overlaps([cells[i]] * len(sets), cells)
        for j, y in enumerate(sets):
            assert most[j] >= len(np.intersect1d(x, y))
    far = jaccard.overlaps([cells[5]], [jaccard.cell_counts(np.unique(rng.integers(-(1 << 63), 1 << 63, 300)))])[0]
    assert 18 * far < 8 * 600  # sets with nothing in common end here
    assert jaccard.overlaps([None], [cells[0]])[0] > 1 << 30


def test_short_texts_differ_by_length():
    assert not np.intersect1d(jaccard.shingles("a b"), jaccard.shingles("a b c")).size


def test_unlike_copies_of_one_text_are_not_paired(spark, monkeypatch):
    """Copies of one text that are less alike than the bound share rare shingles, and end before they are rows."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(100):
        copy = list(base)
        for at in rng.sample(range(60), 5):  # 25 shingles or so: any two copies have under 0.8 in common
            copy[5 * at] = f"x{rng.randint(0, 1 << 40)}"
        texts.append(" ".join(copy))
    tested, test = [], jaccard._Test.__call__
    monkeypatch.setattr(jaccard._Test, "__call__", lambda self, pairs: tested.append(pairs.count()) or test(self, pairs))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    want = plain_groups(texts)
    assert got == dict(enumerate(want))
    assert sum(tested) < 5 * len(texts)


def test_bit_maps_never_tell_sets_too_far_apart():
    rng = np.random.default_rng(6)
    for n in (1, 64, 65, 400, 9000):
        one = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        other = np.unique(np.concatenate([one[: n * 9 // 10], rng.integers(-(1 << 63), 1 << 63, n // 10)]))
        for words in (jaccard.map_words(n), jaccard.map_words(n * 10 // 8)):
            x, y = (jaccard.bit_map(s, words).view(np.uint64) for s in (one, other))
            assert len(x) == words and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(one, other))
