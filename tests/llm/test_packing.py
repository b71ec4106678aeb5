from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import mixing, packing

from .conftest import words


def test_bins_hold_every_capacity():
    rng = np.random.default_rng(1)
    length = rng.integers(1, 300, 3000).astype(float)
    demand = np.stack([length, np.ones_like(length), length**2], axis=1)
    for rule in ("norm", "dot"):
        capacity = np.array([400.0, 6.0, 90_000.0])
        bins = packing.vector_best_fit(demand, capacity, np.array([1.0, 0.5, 0.5]), rule)
        for k in range(3):
            assert np.bincount(bins, demand[:, k]).max() <= capacity[k] + 1e-6
        assert sorted(set(bins)) == list(range(bins.max() + 1))
        assert bins.max() + 1 <= 1.15 * max(np.ceil(demand.sum(axis=0) / capacity))


def test_one_binding_capacity_packs_tightly():
    rng = np.random.default_rng(2)
    length = rng.integers(1, 4096, 2000).astype(float)
    demand = np.stack([length, np.ones_like(length), length**2], axis=1)
    bins = packing.vector_best_fit(demand, np.array([4096.0, 4096.0, 4096.0**2]), np.array([1.0, 0.05, 0.05]))
    big = (length > 2048).sum()
    assert bins.max() + 1 <= max(big, np.ceil(length.sum() / 4096)) * 1.02 + 1


def test_remembered_words_give_the_tokenizers_ids(tokenizer_path):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 200)) for _ in range(20)] + [
        "Don't STOP!!! it's, ok. a.b.c x2 9.5 (yes)", "<|endoftext|> between<|startoftext|>", "a\x1cB c d　e", "İstanbul ΣΑΣ. é x. Straße, ÉTÉ!", "", "  ", "?", "...", "ok?? no.",
    ]
    whole = Tokenizer.from_file(tokenizer_path)
    for limit in (10, 1_000_000):  # a memory that overflows changes nothing
        encode = packing._Encoder(tokenizer_path, limit=limit)
        for text in texts:
            want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert list(encode([text])) == [want]


def test_pieces_cover_the_ids_and_sequences_are_gapless(text_spark, frame, tokenizer_path):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.choice([0, 1, 5, 60, 400])))) for i in range(300)] + [(900, None)]
    got = packing.pack(frame(rows), tokenizer_path, tokens=128, group_pieces=200).toPandas()
    whole = Tokenizer.from_file(tokenizer_path)
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == doc_id].sort_values("piece")
        starts = list(range(0, len(ids), 128))
        assert own.piece.tolist() == list(range(len(starts))) and own.start.tolist() == starts
        assert own.length.tolist() == [len(ids[s : s + 128]) for s in starts]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 128].tobytes()) for s in starts]
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
        assert sequence.length.sum() <= 128
    least = max(np.ceil(got.length.sum() / 128), (got.length > 64).sum())  # two pieces of over half a sequence can't share one
    assert got.sequence_id.nunique() <= least * 1.02 + 4


def test_other_capacities_bind(frame, tokenizer_path):
    docs = frame([(i, "a few words") for i in range(50)])
    got = packing.pack(docs, tokenizer_path, documents=4).toPandas()
    assert got.groupby("sequence_id").size().max() == 4 and got.sequence_id.nunique() == 13
    got = packing.pack(docs, tokenizer_path, attention=33).toPandas()
    assert (got.length**2).groupby(got.sequence_id).sum().max() <= 33


def test_odd_rows(odd_docs, tokenizer_path):
    got = packing.pack(odd_docs, tokenizer_path).toPandas()
    assert len(got[got.piece == 0]) == odd_docs.count()
    assert got.doc_id.isna().sum() == 3
    assert packing.pack(odd_docs.limit(0), tokenizer_path).count() == 0


@pytest.mark.parametrize("rows", [0, 1])
def test_tiny_tables(frame, tokenizer_path, rows):
    assert packing.pack(frame([(1, "x")]).limit(rows), tokenizer_path).count() == rows


@pytest.mark.parametrize("group_pieces", [20_000, 150])
def test_sequences_follow_the_order_of_the_stored_rows(text_spark, frame, tokenizer_path, tmp_path, group_pieces):
    rng = random.Random(6)
    sizes = {"long": 90, "mid": 30, "short": 8}
    rows = [(i, " ".join(words(rng, rng.randint(n, 2 * n))), "en", s) for s, n in sizes.items() for i in range(400_000 // n, 400_000 // n + 24_000 // n)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    mixing.mix(frame(rows), weights={"long": 1, "mid": 2, "short": 1}, block_chars=1000).write.option("maxRecordsPerFile", 120).parquet(f"{tmp_path}/mix")
    docs = text_spark.read.parquet(f"{tmp_path}/mix")
    source = {i: s for i, _, _, s in rows}
    options = {"tokens": 512, "group_pieces": group_pieces, "run_rows": 100, "order": packing.stored_order(docs)}
    got = packing.pack(docs, tokenizer_path, **options).toPandas()
    assert sorted(got[got.piece == 0].doc_id) == list(range(len(rows)))
    shares = got.assign(source=got.doc_id.map(source)).pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).sort_index().cumsum()
    total = shares.iloc[-1].sum()
    # While all sources last (half of "mid" ends the first phase at two thirds of the whole or so), prefixes hold them by the weights.
    seen = shares[(shares.sum(axis=1) > 0.1 * total) & (shares.sum(axis=1) < 0.6 * total)]
    parts = seen.div(seen.sum(axis=1), axis=0)
    assert len(parts) > 20 and abs(parts["mid"] - 0.5).max() < 0.1 and abs(parts["long"] - 0.25).max() < 0.1


def test_stored_order_is_that_of_the_rows(text_spark, frame, tmp_path):
    docs = frame([(i, f"{i}") for i in range(500)])
    docs.repartition(1).sortWithinPartitions(F.desc("doc_id")).write.option("maxRecordsPerFile", 90).parquet(f"{tmp_path}/docs")
    for got in (text_spark.read.parquet(f"{tmp_path}/docs"), docs.orderBy(F.desc("doc_id"))):
        part, row = packing.stored_order(got)
        placed = got.select("doc_id", part.alias("p"), row.alias("r")).collect()
        assert [r.doc_id for r in sorted(placed, key=lambda r: (r.p, r.r))] == list(range(499, -1, -1))
