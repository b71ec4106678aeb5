from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import near_dup
from tidemark.llm.components import lowest_linked
from tidemark.llm.tokens import WordTable, bare

from .conftest import words


def grams_of(text: str | None) -> set:
    own = [w for w in map(bare, (text or "").split()) if w]
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute(rows: list[tuple], threshold: float = 0.8):
    sets = [grams_of(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    classes: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        classes[find(i)] = min(doc_id, classes.get(find(i), doc_id))
    return {rows[i][0]: (classes[find(i)], links[i]) for i in range(len(rows))}


def near_copies(rng: random.Random, base: list[str], n: int, edits: int) -> list[str]:
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = "edit" + str(rng.random())
        out.append(" ".join(own))
    return out


def test_depth_reaches_the_target():
    depth = near_dup.matched_depth(24, 8, 0.8, 0.9999)
    assert near_dup.recall_at(depth, 24, 0.8) >= 0.9999 > near_dup.recall_at(depth + 1, 24, 0.8)
    with pytest.raises(ValueError):
        near_dup.matched_depth(1, 8, 0.5, 0.99)


def test_signatures_meet_as_often_as_they_should():
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(60):
        common = rng.integers(0, 1 << 62, 80).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 10).astype(np.uint64)])) for _ in "ab")
        s = near_dup.signatures([a, b], 24, 5)
        hits += (s[0] == s[1]).any()
    assert hits == 60


def test_common_prefixes_of_signatures():
    one = np.array([0x0102030405060708, 0x0102030405060708, 0x0102030405060708], np.uint64)
    other = np.array([0x0102030405060708, 0x0102FF0405060708, 0xFF02030405060708], np.uint64)
    depth, equal = near_dup.common_digits(one, other)
    assert depth.tolist() == [8, 2, 0] and equal.tolist() == [8, 7, 7]


def test_every_band_of_similarity_must_meet_the_target():
    easy = {(3, 8): 5000}
    assert near_dup.measured_depth(easy, 5, 0.9999) == 8
    assert near_dup.measured_depth({**easy, (0, 5): 900, (0, 6): 50, (0, 4): 3}, 5, 0.9999) == 5
    assert near_dup.measured_depth({**easy, (0, 6): 900, (0, 7): 2000}, 5, 0.9999) == 6
    assert near_dup.measured_depth({(3, 8): 20}, 5, 0.9999) == 5 == near_dup.measured_depth({}, 5, 0.9999)  # too few to tell
    assert near_dup.measured_depth({(1, 5): 400, (1, 6): 90, (3, 8): 200}, 5, 0.9999) == 5 and near_dup.measured_depth({**easy, (0, 5): 4}, 5, 0.9999) == 8
    assert near_dup.measured_depth({**easy, (-1, 0): 9999}, 5, 0.9999) == 8  # pairs below the threshold are no links


def nodes_of(spark, groups, edits, seed):
    """Trie nodes of groups of near copies: a text of 300 words and copies of it with so many words changed."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = words(rng, 300)
        for _ in range(6):
            own = list(base)
            for at in rng.sample(range(300), edits):
                own[at] = f"edit{rng.random()}"
            texts.append(" ".join(own))
    sets = near_dup.gram_hashes(texts, WordTable(near_dup._word_hashes))
    labels = near_dup.signatures(sets, 24, 8).view(np.int64)
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(labels)], "node long, labels array<long>")


def test_the_depth_follows_the_data(text_spark):
    """Close copies are all met by whole signatures; farther ones need shorter prefixes."""
    close = near_dup.descended_depth(nodes_of(text_spark, 90, 1, 1), 5, 0.9999)
    far = near_dup.descended_depth(nodes_of(text_spark, 90, 3, 2), 5, 0.9999)
    assert close == 8 and far < close
    assert near_dup.descended_depth(nodes_of(text_spark, 1, 1, 3).limit(1), 5, 0.9999) == 5


def test_easy_pairs_do_not_cost_a_harder_one_its_link(text_spark):
    """A pair at 0.816 that no whole signature matches, among many close ones: all links are found."""
    rng = random.Random(4)
    hard = []
    for g in range(5):
        base = [f"w{rng.randrange(20000)}" for _ in range(300)]
        own = list(base)
        for k in range(6):
            own[20 + 45 * k] = f"edit{g}x{k}"
        hard = [" ".join(base), " ".join(own)]
    texts = list(hard)
    for g in range(90):
        base = words(rng, 300)
        for c in range(6):
            own = list(base)
            own[rng.randrange(300)] = f"easy{g}x{c}"
            texts.append(" ".join(own))
    found = near_dup.near_duplicates(text_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.links for r in found if r.doc_id < 2} == {0: 1, 1: 1}
    assert all(r.links == 5 for r in found if r.doc_id >= 2)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_leave_by_marks(frame, odd_docs, most):
    docs = odd_docs
    kept = near_dup.drop_near_duplicates(docs, most=most)
    assert kept.columns == docs.columns
    got = near_dup.near_duplicates(docs)
    assert kept.count() == got.select("class_id").distinct().count() + got.filter("class_id IS NULL").count() - (1 if got.filter("class_id IS NULL").count() else 0)


@pytest.mark.parametrize("chunk_sets", [512, 8])
def test_against_all_pairs(frame, chunk_sets):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randint(5, 80))) for _ in range(60)]
    for _ in range(8):
        texts += near_copies(rng, words(rng, 80), rng.randint(2, 6), 2)
    texts += near_copies(rng, words(rng, 150), 40, 5)  # one large group
    texts += [texts[0]] * 7 + [texts[-1].upper()] * 5 + ["one two", "one, two!", "one", None, "", "..."]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dup.near_duplicates(frame(rows), chunk_sets=chunk_sets).collect()
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.links) for r in got} == want
    assert sum(n > 0 for _, n in want.values()) >= 50


def test_common_counts_both_ways():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 60, 6000).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 900), replace=False)) for _ in range(30)]
    pairs = np.array([(i, j) for i in range(30) for j in range(i)])
    by_matrix = near_dup.common_counts(sets, sets, pairs)
    assert by_matrix.tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
    assert near_dup.common_counts(sets, sets, pairs[:50]).tolist() == by_matrix[:50].tolist()


def test_components(text_spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    top: dict[int, int] = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in lowest_linked(text_spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(top)}
    assert lowest_linked(text_spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_class_stays(frame, odd_docs):
    rng = random.Random(5)
    base = words(rng, 50)
    docs = frame([(i, t) for i, t in enumerate(near_copies(rng, base, 9, 1))] + [(50, "quite another text of some words"), (51, None)])
    classes = {r.class_id for r in near_dup.near_duplicates(docs).collect()}
    kept = near_dup.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes) and kept.columns == docs.columns
    kept = near_dup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns


def test_odd_rows(odd_docs):
    got = near_dup.near_duplicates(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    seven = [r for r in rows if r.links == 3]
    assert len(seven) == 4 and {r.class_id for r in seven} == {1}
    assert near_dup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_a_word_table_that_overflows_changes_nothing():
    texts = [" ".join(words(random.Random(k), 40)) for k in range(30)]
    small, large = WordTable(near_dup._word_hashes, limit=5), WordTable(near_dup._word_hashes)
    for t in texts:
        assert near_dup.gram_hashes([t], small)[0].tolist() == near_dup.gram_hashes([t], large)[0].tolist()
