from __future__ import annotations

import hashlib
import random

import pytest

from tidemark.llm import fill_middle


def expected(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text)


def key(row):
    return tuple(str(x) for x in row)


def run(docs, **options):
    return sorted((tuple(r) for r in fill_middle.fill_middle(docs, **options).collect()), key=key)


def test_odd_rows(odd_docs):
    want = [expected(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs) == sorted(want, key=key)


@pytest.mark.parametrize("seed", [1, 7])
def test_against_slicing(frame, seed):
    """Characters beyond the basic plane, joined emoji, line ends of all kinds, marks cut in half, and signs that mean something to a pattern or its replacement."""
    rng = random.Random(seed)
    alphabet = ["a", "é", "é", "𝒳", "👩‍👩‍👧", "\n", "\r\n", " ", "\x00", "$1", "\\", "{2}+", "<", "P>", "<S", ">", "<P", "M", "(", " "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(["<P>", "x<S>y", "<M", "<", "\n", "𝒳"])] + [(5, "again"), (5, "again")]
    rows += [(2000 + n, "𝒳y" * n + "z" * (n % 3)) for n in (511, 512, 513, 1024, 5000)]
    got = run(frame(rows), seed=seed)
    assert got == sorted((expected(i, t, seed) for i, t in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_very_long_text(frame):
    text = "word and 𝒳 word\n" * 200_000
    ids = [i for i in range(40) if expected(i, "x" * 10)[2] != "plain"][:2]
    assert run(frame([(i, text) for i in ids])) == sorted((expected(i, text) for i in ids), key=key)


def test_shares(frame):
    forms = [r[2] for r in run(frame([(i, "some text") for i in range(3000)]))]
    assert abs(forms.count("plain") / 3000 - 0.1) < 0.02 and abs(forms.count("spm") / 3000 - 0.18) < 0.025
    assert {r[2] for r in run(frame([(i, "some text") for i in range(50)]), plain_from=0)} == {"plain"}


def test_empty_table(frame):
    assert run(frame([])) == []
