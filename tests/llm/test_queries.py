from __future__ import annotations

import sys
import zlib
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from check_oracle import compare, connect

import __spark_entry__ as entry
from tidemark.llm.queries import ORACLE, QUERIES

from .conftest import SF

TABLES = {2: "embeddings", 7: "pages", 9: "conversations", 11: "embeddings", 13: "embeddings"}


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(text_spark, name):
    ok, text = compare(text_spark, connect(SF), name, SF)
    assert ok, text


COLUMNS = {
    1: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    3: ["doc_id", "held_out", "score", "predicted"],
    4: ["doc_id", "class_id", "links"],
    6: ["doc_id", "held_out", "lang_pred", "score"],
    7: ["page_id", "url", "text", "n_chars"],
    8: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    11: ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    12: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


@pytest.mark.parametrize("number", [1, 3, 4, 6, 7, 8, 11, 12])
def test_one_row_for_each_input_row(text_spark, number):
    (name,) = [q for q in QUERIES if q.startswith(f"op{number}_")]
    got = QUERIES[name](text_spark, SF).toPandas()
    source = pd.read_parquet(f"{SF}/{TABLES.get(number, 'documents')}.parquet")
    key = source.columns[0]
    assert got.columns.tolist() == COLUMNS[number]
    rows = got[got.piece == 0] if number == 1 else got
    assert sorted(rows[key]) == sorted(source[key])
    if number in (3, 6):
        parts, which = {3: (5, 0), 6: (4, 2)}[number]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == which) for r in got.itertuples())


@pytest.mark.parametrize("number", [2, 5, 9, 10, 13])
def test_the_others_give_rows(text_spark, number):
    (name,) = [q for q in QUERIES if q.startswith(f"op{number}_")]
    assert QUERIES[name](text_spark, SF).count() > 0
