import random
from fractions import Fraction

import pytest

from tests.llm.helpers import ODD, empty_docs, odd_docs
from turnwise.llm.mixing import exact_parts, mix_sources, placed_before, schedule


def simulated(slots, n_slots):
    """Earliest deadline first, one slot after the other, over all blocks that ever come."""
    period = sum(slots.values())
    names, done, order = list(slots), dict.fromkeys(slots, 0), []
    for slot in range(n_slots):
        ready = [(-(-(done[s] + 1) * period // slots[s]), n, s) for n, s in enumerate(names) if done[s] * period // slots[s] <= slot]
        _, _, s = min(ready)
        order.append((s, done[s]))
        done[s] += 1
    return order


WEIGHTS = [{"a": 5, "b": 3, "c": 2}, {"a": 1}, {"a": 70, "b": 29, None: 1}, {f"s{i:02d}": i + 1 for i in range(13)}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_schedule_is_earliest_deadline_first(weights):
    plan = list(schedule([(s, w, 200) for s, w in weights.items()]))
    order = simulated(weights, plan[-1][2] + 1)
    assert all(order[slot] == (s, block) for s, block, slot, *_ in plan)
    assert sorted((s or "", block) for s, block, *_ in plan) == sorted((s or "", i) for s in weights for i in range(200))


def random_parts(rnd):
    kind = rnd.randrange(3)
    n = rnd.randint(1, 12)
    return [rnd.randint(1, 10) if kind == 0 else rnd.randint(1, 10**12) if kind == 1 else 10 ** rnd.randint(0, 3) for _ in range(n)]


def test_what_was_placed_before_a_slot_needs_no_pass_over_the_slots():
    rnd = random.Random(8)
    for _ in range(150):
        parts = random_parts(rnd)
        done = [0] * len(parts)
        for slot, (n, *_) in zip(range(400), schedule([(f"{i:02d}", p, 10**6) for i, p in enumerate(parts)])):
            assert placed_before(parts, slot) == done
            done[int(n)] += 1


def test_segments_are_the_whole_schedule():
    rnd = random.Random(9)
    for _ in range(40):
        sources = [(f"{i:02d}", p, rnd.randint(0, 60)) for i, p in enumerate(random_parts(rnd))]
        if sum(blocks * sum(p for _, p, _ in sources) / part for _, part, blocks in sources) > 200_000:
            continue
        whole = list(schedule(sources))
        size = rnd.randint(1, 50)
        last = whole[-1][2] if whole else 0
        assert [row for at in range(0, last + 1, size) for row in schedule(sources, at, at + size)] == whole


def test_tasks_make_the_same_schedule_in_segments(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{min(i % 17, 6)}" if i % 5 else None) for i in range(3000)], "doc_id long, source string")
    whole = sorted(map(tuple, mix_sources(docs, block_rows=2).collect()))
    monkeypatch.setattr("turnwise.llm.mixing.SEGMENT_SLOTS", 40)
    assert sorted(map(tuple, mix_sources(docs, block_rows=2).collect())) == whole
    monkeypatch.setattr("turnwise.llm.mixing.MOST_SLOTS_BACK", 1)
    assert sorted(map(tuple, mix_sources(docs, block_rows=2).collect())) == whole


def test_rows_are_placed_once_and_in_order(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a"] * 6 + ["b"] * 3 + ["c"])) for i in range(900)]
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4).collect()
    assert sorted((r.doc_id, r.source) for r in found) == sorted(rows)
    order = simulated({"a": 5, "b": 3, "c": 2}, 2000)
    assert all(order[r.slot] == (r.source, r.block) and r.release <= r.slot < r.deadline for r in found)
    ranks = sorted((r.source, r.block, r.rank_in_block) for r in found)
    assert len(set(ranks)) == 900 and {r[2] for r in ranks} == {0, 1, 2, 3}
    sizes = {}
    for source, block, _ in ranks:
        sizes[source, block] = sizes.get((source, block), 0) + 1
    last = {s: max(b for x, b in sizes if x == s) for s in "abc"}
    assert all(n == 4 or b == last[s] for (s, b), n in sizes.items())


def test_hot_source_is_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr("turnwise.llm.mixing.BUCKET_ROWS", 50)
    rows = [(i, "hot" if i % 3 else "cold") for i in range(1000)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1).collect()
    for source in ("hot", "cold"):
        blocks = sorted(r.block for r in found if r.source == source)
        assert blocks == list(range(len(blocks)))


def test_odd_rows(spark):
    found = mix_sources(odd_docs(spark)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.source or "") for r in found) == sorted(((o[0] is None, o[0] or 0), o[3] or "") for o in ODD)
    assert mix_sources(empty_docs(spark)).count() == 0


def test_unknown_sources_and_weights_are_errors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    with pytest.raises(Exception, match="no target weight"):
        mix_sources(docs, {"a": 1.0}).collect()
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 0.0, "b": 1.0})


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 70, "b": 29, "c": 1}, {"hot": 136.76, **{f"s{i}": 44.38 for i in range(19)}}])
def test_prefixes_keep_to_the_callers_own_weights(weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    shares = {s: Fraction(str(w)) / total for s, w in weights.items()}
    done = dict.fromkeys(weights, 0)
    for s, block, slot, release, deadline in schedule([(s, p, 10**6) for s, p in exact_parts(weights).items()]):
        assert block == done[s] and release <= slot < deadline
        done[s] += 1
        assert all(abs(n - (slot + 1) * shares[x]) < 1 for x, n in done.items())
        if slot == 6000:
            break


def test_rows_follow_the_callers_own_weights(spark):
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(20_000)], "doc_id long, source string")
    found = mix_sources(docs, {"a": 0.9, "b": 0.1}, block_rows=1).collect()
    first = [r.source for r in found if r.slot < 10_000]
    assert len(found) == 20_000 and (first.count("a"), first.count("b")) == (9000, 1000)


def test_more_sources_than_a_thousand(spark):
    docs = spark.createDataFrame([(i, f"s{i % 1500}") for i in range(4000)], "doc_id long, source string")
    found = mix_sources(docs, block_rows=1).collect()
    assert sorted(r.doc_id for r in found) == list(range(4000))
    assert len({r.slot for r in found}) == 4000 and all(r.release <= r.slot < r.deadline for r in found)
