import random

import numpy as np
import pytest

from tests.llm.helpers import LONG, ODD, docs_of, empty_docs, odd_docs
from turnwise.llm.simhash import components, drop_near_copies, fingerprint, near_links, shingles, simhash_groups


def groups(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute_groups(prints, radius):
    values = np.array(prints, np.uint64)
    pairs = [(i, int(j) + i + 1) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= radius)]
    return groups(len(values), pairs)


def near_texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            copy = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 300))))
    return texts


def test_fingerprint_by_its_definition():
    import xxhash

    text = "A b\tc D  e\x0bÉ f"
    words = ["a", "b", "c", "d", "e", "É", "f"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(4)]
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)
    assert fingerprint(shingles(text, 4, False)) == bits
    assert fingerprint(shingles("a B", 4, False)) == xxhash.xxh64_intdigest(b"a b", 42)
    assert fingerprint([]) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    texts = near_texts(250, seed) + ["", None, "  "]
    rows = {r.doc_id: r for r in simhash_groups(docs_of(spark, texts)).collect()}
    prints = [fingerprint(shingles(t or "", 4, False)) for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == brute_groups(prints, 4)


@pytest.mark.parametrize("hot_rows", [3, 40, 8192])
def test_links_of_hot_buckets(spark, hot_rows):
    rnd = random.Random(7)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    prints = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(80)})
    signed = np.array(prints, np.uint64).astype(np.int64).tolist()
    nodes = spark.createDataFrame([(s,) for s in signed], "node long")
    links = near_links(nodes, 4, 6, hot_rows=hot_rows).collect()
    place = {s: i for i, s in enumerate(signed)}
    assert groups(len(prints), [(place[r.a], place[r.b]) for r in links]) == brute_groups(prints, 4)
    assert len(links) < len(prints) * 15


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300)]
    pairs += [(rnd.randint(400, 500), rnd.randint(400, 500)) for _ in range(60)]
    rnd.shuffle(pairs)
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = groups(501, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: expected[x] for x in touched}


def test_odd_rows(spark):
    rows = simhash_groups(odd_docs(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((o[0] is None, o[0] or 0) for o in ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == "0" * 16 and {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[8].fingerprint == f"{fingerprint(shingles(LONG, 4, False)):016x}"
    assert simhash_groups(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_stage_keeps_the_first_of_each_group(spark, seed):
    texts = near_texts(200, seed) + ["", None, "  "]
    expected = brute_groups([fingerprint(shingles(t or "", 4, False)) for t in texts], 4)
    kept = drop_near_copies(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))
    assert {r.text for r in kept.collect()} == {texts[i] for i in set(expected)}


def test_stage_keeps_columns_and_odd_rows(spark):
    kept = drop_near_copies(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    # Of null, empty and blank texts that of id 1 stays; a row without an id stays if it is alone in its group.
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8]
    assert drop_near_copies(empty_docs(spark)).count() == 0


def test_a_doc_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, c + " more"), (7, c + " more"), (None, "alone here"), (None, "alone here")]
    names = ["doc_id", "text", "_gone", "_again", "node", "first", "n", "text_key", "_spread", "_slices", "root", "lang"]
    df = spark.createDataFrame([(*r, *("x" * 10)) for r in rows], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = drop_near_copies(df)
    near = (fingerprint(shingles(c, 4, False)) ^ fingerprint(shingles(c + " more", 4, False))).bit_count() <= 4
    expected = [(1, a), (5, b), (7, c + " more"), (None, "alone here")] + ([] if near else [(None, c)])
    assert kept.columns == names
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)


def test_a_hub_of_very_many_links(spark, monkeypatch):
    from turnwise.operators import distribution

    monkeypatch.setattr(distribution, "HOT_ROWS", 20)
    pairs = [(0, i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(300)}, **{500 + i: 500 for i in range(10)}}


def test_the_table_is_shuffled_the_same_way_at_any_size(spark):
    kept = drop_near_copies(docs_of(spark, near_texts(40, 5)))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
