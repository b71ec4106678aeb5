from __future__ import annotations

import random
from itertools import combinations

import pytest

from tidemark.llm import licenses

from .conftest import words


def test_rising_is_longest():
    rng = random.Random(1)
    for _ in range(60):
        values = [rng.randrange(9) for _ in range(rng.randrange(9))]
        best = max((len(c) for n in range(len(values) + 1) for c in combinations(values, n) if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)
        got = [values[i] for i in licenses.rising(values)]
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:], strict=False))


def test_alignment_anchors_and_gaps():
    text, template = "x a b c q d e f z".split(), "a b c d e f".split()
    pairs = licenses.align(text, template)
    assert [template[j] for _, j in pairs] == template and all(text[i] == template[j] for i, j in pairs)
    moved = licenses.align("d e f a b c".split(), template)
    assert len(moved) == 3 and moved == sorted(moved)
    assert licenses.align([], template) == licenses.align(text, []) == []


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_found_wherever_it_stands(frame, name):
    rng = random.Random(len(name))
    notice = licenses.TEMPLATES[name].upper().split()
    for _ in range(len(notice) // 20):
        notice[rng.randrange(1, len(notice) - 1)] = "changed"
    rows = [(k, " ".join([*words(rng, before), *notice, *words(rng, after)])) for k, (before, after) in enumerate([(0, 0), (3, 200), (500, 7), (90, 90)])]
    got = licenses.scan_licenses(frame(rows)).filter(f"license = '{name}'").collect()
    assert {r.doc_id: r.first_word for r in got} == {0: 0, 1: 3, 2: 500, 3: 90}
    assert all(r.coverage >= 0.8 and r.last_word - r.first_word == len(notice) - 1 for r in got)


def test_all_occurrences_and_clean_texts(frame):
    rng = random.Random(2)
    line = licenses.TEMPLATES["mit-line"]
    rows = [(1, " ".join([line, *words(rng, 40), line, *words(rng, 9), line])), (2, " ".join(words(rng, 4000))), (3, "the the the of and license"), (4, f"{line} {line}")]
    got = licenses.scan_licenses(frame(rows)).collect()
    assert sorted((r.doc_id, r.first_word) for r in got) == [(1, 0), (1, 45), (1, 59), (4, 0), (4, 5)]


def test_odd_rows(odd_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0
    assert licenses.scan_licenses(odd_docs.limit(0)).count() == 0


LONG = [n for n, t in licenses.TEMPLATES.items() if len(t.split()) >= 50]


@pytest.mark.parametrize("gap", [0, 20, 60, 150, 500, 5000])
def test_interrupted_notices_are_found(frame, gap):
    """However much stands between the two halves of a notice."""
    rng = random.Random(gap)
    rows, where = [], {}
    for k in range(20):
        name = LONG[k % len(LONG)]
        notice = licenses.TEMPLATES[name].split()
        cut = rng.randrange(8, len(notice) - 8)
        before, after = words(rng, rng.randrange(40)), words(rng, rng.randrange(40))
        rows.append((k, " ".join([*before, *notice[:cut], *words(rng, gap), *notice[cut:], *after])))
        where[k] = (name, len(before), len(before) + len(notice) + gap - 1, max(cut, len(notice) - cut) / len(notice))
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(frame(rows)).collect()}
    for k, (name, first, last, half) in where.items():
        r = got[k, name]
        assert r.coverage >= 0.8 and first <= r.first_word < r.last_word <= last
        if half < 0.8 and gap >= 150:  # else a part alone, or a stretch, may be enough
            assert (r.coverage, r.first_word, r.last_word) == (1.0, first, last)


def test_pieces_against_alignment_of_the_whole_text():
    """Interrupted again and again, in prose that shares the template's common words: what the whole text aligns to is covered."""
    rng = random.Random(9)
    vocabulary: dict[str, int] = {}
    templates = {n: licenses.np.array([vocabulary.setdefault(licenses.bare(w), len(vocabulary) + 1) for w in t.split()]) for n, t in licenses.TEMPLATES.items()}
    common = [vocabulary[w] for w in ("the", "of", "and", "or", "to", "in", "this", "software")]
    for k in range(40):
        name = LONG[k % len(LONG)]
        wanted = templates[name].tolist()
        cuts = sorted(rng.sample(range(10, len(wanted) - 10), 2))
        prose = lambda: [rng.choice(common) if rng.random() < 0.3 else 0 for _ in range(rng.randrange(200))]  # noqa: B023, E731
        text = [*prose(), *wanted[: cuts[0]], *prose(), *wanted[cuts[0] : cuts[1]], *prose(), *wanted[cuts[1] :], *prose()]
        whole = len(licenses.align([x for x in text], wanted)) / len(wanted)
        found = [f for f in licenses.find_notices(licenses.np.array(text), templates, len(vocabulary), 0.8) if f[0] == name]
        short = min(cuts[0], cuts[1] - cuts[0], len(wanted) - cuts[1]) < licenses.RUN
        assert found or short or whole < 0.8
        assert all(f[1] >= 0.8 for f in found)


def test_two_interrupted_notices_and_stray_pieces(frame):
    rng = random.Random(6)
    notice = licenses.TEMPLATES["mit"].split()
    gap = lambda n: words(rng, n)
    twice = [*notice[:40], *gap(300), *notice[40:], *gap(30), *notice[:30], *gap(200), *notice[30:]]
    stray = [*notice[60:75], *gap(9), *notice[:40], *gap(50), *notice[10:20], *gap(50), *notice[40:]]
    half = [*notice[:45], *gap(20)]
    got = licenses.scan_licenses(frame([(1, " ".join(twice)), (2, " ".join(stray)), (3, " ".join(half)), (4, " ".join(notice[40:] + gap(200) + notice[:40]))])).collect()
    assert sorted((r.doc_id, r.first_word) for r in got if r.license == "mit") == [(1, 0), (1, len(notice) + 330), (2, 24)]


def test_templates_from_a_table(text_spark, frame):
    table = text_spark.createDataFrame([("own", "our very own words of notice"), ("own", "zzz"), ("none", None), (None, "x"), ("blank", "  ")], "license string, text string")
    templates = licenses.read_templates(table)
    assert templates == {"own": "our very own words of notice"}
    got = licenses.scan_licenses(frame([(1, "Here are OUR very own words, of notice."), (2, "nothing")]), templates).collect()
    assert [(r.doc_id, r.license, r.first_word) for r in got] == [(1, "own", 2)]
