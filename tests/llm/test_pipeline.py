from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pandas as pd
import pytest

from tidemark.llm import exact_dedup, mixing, near_dup, packing, toxicity

from .conftest import DOC_SCHEMA, words
from .test_near_dup import brute


@pytest.fixture(scope="module")
def folder(text_spark, tmp_path_factory):
    """Clean texts, toxic ones, exact and near copies."""
    rng = random.Random(11)
    clean = [" ".join(words(rng, rng.randint(20, 90))) for _ in range(260)]
    toxic = []
    for _ in range(120):
        own = words(rng, rng.randint(10, 60))
        for _ in range(4):
            own.insert(rng.randrange(len(own)), rng.choice(["gorpish", "vrenk", "zzulk"]))
        toxic.append(" ".join(own))
    copies = [clean[0].upper()] * 6 + [clean[1]] * 3
    near = [t + " and more" for t in clean[2:9]]
    texts = clean + toxic + copies + near + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(260 <= i < 380)) for i in range(380)]
    path = str(tmp_path_factory.mktemp("corpus"))
    text_spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{path}/documents.parquet")
    text_spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]


def test_each_stage_acts_on_what_the_one_before_kept(text_spark, folder):
    docs = text_spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(text_spark, docs, folder).write.parquet(path)
        docs = text_spark.read.parquet(path)
        assert docs.columns == columns
        seen.append(docs.toPandas())
    given, clean, single, apart, mixed = seen
    # Toxicity: nearly all toxic texts go, nearly all clean ones stay, and nothing is changed.
    gone = set(given.doc_id) - set(clean.doc_id)
    assert sum(260 <= i < 380 for i in gone) >= 110 and sum(not 260 <= i < 380 for i in gone) <= 5
    # Exact copies: the largest id of equal texts.
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    best: dict[str, int] = {}
    for r in clean.itertuples():
        best[low(r.text)] = max(r.doc_id, best.get(low(r.text), -1))
    assert sorted(single.doc_id) == sorted(best.values())
    # Near copies: one of each class, as brute force has them.
    rows = list(zip(single.doc_id, single.text, strict=True))
    assert sorted(apart.doc_id) == sorted({c for c, _ in brute(rows).values()})
    # Mixing: every row stays once, in the order of the mix.
    assert sorted(mixed.doc_id) == sorted(apart.doc_id)
    order = mixing.mixed(text_spark.createDataFrame(apart, DOC_SCHEMA), mixing.TARGETS).toPandas().sort_values(["slot", "start"])
    assert Counter(order.doc_id) == Counter(mixed.doc_id)
    assert pd.read_parquet(f"{folder}/mixing").doc_id.tolist() == order.doc_id.tolist()  # part files in their order
    packed = corpus_pipeline.STAGES[-1][1](text_spark, docs, folder).toPandas()
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(mixed.doc_id)
    whole = corpus_pipeline.run(text_spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, packed[key].values.tolist()))


def test_stages_call_the_operators():
    assert corpus_pipeline.exact_dedup is exact_dedup and corpus_pipeline.near_dup is near_dup
    assert corpus_pipeline.mixing is mixing and corpus_pipeline.packing is packing and corpus_pipeline.toxicity is toxicity


def test_odd_rows_pass_every_stage(text_spark, odd_docs, folder, tmp_path):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(text_spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = text_spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](text_spark, docs, folder).count() > 0


def test_empty_tables_pass_every_stage(text_spark, folder):
    docs = text_spark.createDataFrame([], DOC_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(text_spark, docs, folder).count() == 0


def test_the_mix_decides_the_order_of_the_sequences(text_spark, folder, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 40 if i % 3 else 80)), "en", f"s{i % 3}", 0) for i in range(12_000)]
    docs = text_spark.createDataFrame(rows, DOC_SCHEMA)
    for name, weights in (("first", {"s0": 8}), ("last", {"s1": 8, "s2": 8})):
        mixing.mix(docs, weights=weights, block_chars=20_000).write.option("maxRecordsPerFile", 700).parquet(f"{tmp_path}/{name}")
        packed = corpus_pipeline.pack_sequences(text_spark, text_spark.read.parquet(f"{tmp_path}/{name}"), folder).toPandas()
        packed = packed.sort_values("sequence_id")
        half = packed[packed.length.cumsum() < packed.length.sum() * 0.4]
        share = half.length[half.doc_id % 3 == 0].sum() / half.length.sum()
        assert abs(share - (0.8 if name == "first" else 1 / 17)) < 0.1
