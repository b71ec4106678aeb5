from __future__ import annotations

import random
from collections import Counter

import pytest

from tidemark.llm import mixing


def filled(turns) -> dict[int, tuple[str, int]]:
    used = {}
    for t in turns:
        for b in range(t.first, t.last):
            q, r = divmod(b - t.first, len(t.slots))
            slot = t.start + q * t.period + t.slots[r]
            assert slot not in used
            used[slot] = (t.source, b)
    return used


@pytest.mark.parametrize("seed", range(25))
def test_less_than_a_block_from_the_target_at_every_slot(seed):
    rng = random.Random(seed)
    blocks = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 6))}
    weights = {s: rng.randint(1, 9) for s in blocks}
    turns = mixing.schedule(blocks, weights)
    used = filled(turns)
    assert sorted(used) == list(range(sum(blocks.values())))
    done: Counter = Counter()
    starts = sorted({t.start for t in turns})
    for start, end in zip(starts, [*starts[1:], len(used)], strict=True):
        active = {s for s in blocks if done[s] < blocks[s]}
        total, here = sum(weights[s] for s in active), Counter()
        for slot in range(start, end):
            here[used[slot][0]] += 1
            assert all(abs(here[s] - (slot - start + 1) * weights[s] / total) < 1 for s in active)
        done += here
    order: dict[str, list[int]] = {}
    for slot in sorted(used):
        order.setdefault(used[slot][0], []).append(used[slot][1])
    assert all(o == sorted(o) for o in order.values())


def test_whole_weights():
    assert mixing.whole_weights({"a": 4, "b": 2}) == {"a": 2, "b": 1}
    made = mixing.whole_weights({"a": 0.123, "b": 0.877})
    assert abs(made["a"] / sum(made.values()) - 0.123) < 1e-3


def test_rows_are_laid_out_whole(frame):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 5, 40, 300]), "en", rng.choice(["hot", "hot", "a", "b", None, ""])) for i in range(500)]
    docs = frame(rows)
    got = mixing.mixed(docs, {"hot": 3, "a": 2}, block_chars=1000, bucket_rows=20).toPandas()
    assert sorted(got.doc_id) == list(range(500))
    for _, own in got.groupby("source", dropna=False):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own["size"].cumsum().tolist()[:-1]]  # gapless within the source
        assert (own.block == own.start // 1000).all()
    assert got.groupby("slot")[["source", "block"]].nunique(dropna=False).max().max() == 1
    counts = {("n" if s is None else "s" + s): n for s, n in ((s, max(b) + 1) for s, b in blocks_of(got).items())}
    want = filled(mixing.schedule(counts, {s: {"shot": 3, "sa": 2}.get(s, 1) for s in counts}))
    names = {slot: name for slot, (name, _) in want.items()}
    assert all(names[r.slot] == ("n" if r.source is None or r.source != r.source else "s" + r.source) for r in got.itertuples())
    mixed = mixing.mix(docs, weights={"hot": 3, "a": 2}, block_chars=1000, bucket_rows=20)
    assert [r.doc_id for r in mixed.collect()] == got.sort_values(["slot", "start"]).doc_id.tolist()
    assert mixed.columns == docs.columns


def blocks_of(got) -> dict:
    out: dict = {}
    for r in got.itertuples():
        out.setdefault(None if r.source is None or r.source != r.source else r.source, set()).add(r.block)
    return out


def test_the_mix_does_not_depend_on_partitioning(frame):
    docs = frame([(i, f"text {i}" * 9, "en", f"s{i % 3}") for i in range(200)])
    one, two = (mixing.mixed(d, block_chars=500, bucket_rows=30).orderBy("doc_id").collect() for d in (docs, docs.repartition(7)))
    assert one == two


def test_odd_rows(odd_docs):
    got = mixing.mixed(odd_docs, block_chars=100).toPandas()
    assert got.copies.sum() == odd_docs.count() and len(got) == len(odd_docs.select("doc_id", "text", "source").distinct().collect())
    assert mixing.mix(odd_docs, block_chars=100).count() == odd_docs.count()
    assert mixing.mixed(odd_docs.limit(0)).count() == mixing.mix(odd_docs.limit(0)).count() == 0


def test_prefix_shares_follow_uneven_targets(frame):
    """While all sources last, every prefix of the mix holds them by their weights, to within a block each."""
    weights = {"a": 5, "b": 3, "c": 2, "d": 1}
    docs = frame([(i, "x" * 100, "en", "abcd"[i % 4]) for i in range(2000)])
    got = mixing.mixed(docs, weights, block_chars=200).toPandas().sort_values(["slot", "start"])
    blocks = got.drop_duplicates("slot")
    until = blocks[blocks.source == "a"].slot.max()  # the first to run out
    for n in range(11, until, 37):
        seen = blocks[blocks.slot < n].source.value_counts()
        assert all(abs(seen.get(s, 0) - n * w / 11) < 1 for s, w in weights.items())


def test_the_registered_target_is_uneven():
    assert len(set(mixing.TARGETS.values())) > 2
