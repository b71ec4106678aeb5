from __future__ import annotations

import random
import zlib

import numpy as np

from tidemark.llm import language

SYLLABLES = {
    "en": "the ing er on th and ly of", "de": "ung sch ein der ich zu ß ber", "nl": "ij oo een van het ui sch ge",
    "fr": "eau oi é eux ment qu le ç", "es": "ción ll ñ ado os el rr ue", "eu": "tx ak zu rra ko tz egi ba",
}


def texts(n: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        made = ["".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60))]
        out.append((i, " ".join(made), lang, "s"))
    return out


def test_held_out_accuracy(frame):
    rows = texts(600, 1)
    got = language.identify(frame(rows)).toPandas()
    truth = {i: lang for i, _, lang, _ in rows}
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_family_comes_first():
    profiles = np.array([language._profile(t.split()) for _, t, *_ in texts(200, 2)])
    model = language.fit(profiles, [lang for *_, lang, _ in texts(200, 2)])
    assert model.members == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "eu": ["eu"]} or set(model.members) == {"germanic", "romance", "eu"}
    assert len(model.families) == 3
    assert {f: len(p) for f, p in model.pairs.items()} == {"germanic": 3, "romance": 1, "eu": 0}
    names = list(model.members)
    margins = np.zeros(3 + 4)
    margins[names.index("eu")] = 5.0  # the pairs of other families have no say
    assert language.decide(model, margins)[0] == "eu"


def test_held_out_languages_change_nothing(frame):
    rows = texts(80, 3)
    turned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    one, two = (language.identify(frame(r)).orderBy("doc_id").collect() for r in (rows, turned))
    assert one == two


def test_odd_rows(odd_docs, frame):
    got = language.identify(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    und = got[got.lang_pred == "und"]
    assert sorted(und.doc_id.fillna(0)) == [0, 0, 3, 4, 5, 6] and (und.score == 0).all()
    assert language.identify(odd_docs.limit(0)).count() == 0
    nothing = language.identify(frame([(1, "some text", None, "s"), (None, "text", "en", "s")])).toPandas()
    assert (nothing.lang_pred == "und").all()
    alone = language.identify(frame([(i, "some text", "en", "s") for i in range(9)])).toPandas()
    assert (alone.lang_pred == "en").all()


def test_languages_of_few_ids_are_learned(frame):
    by = {lang: [t for _, t, other, _ in texts(300, 6) if other == lang][0] for lang in ("en", "fr")}
    rows = [(i, by[lang], lang, "s") for i, lang in enumerate(by) for _ in range(2000)]
    model = language.learn(frame(rows), rows=8)
    assert sorted(x for members in model.members.values() for x in members) == ["en", "fr"]
