from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions.models import HashEmbedder
from turnwise.operators import index as index_module
from turnwise.operators import search
from turnwise.operators.index import (
    Index,
    build_index,
    check_dimension,
    create_or_sync,
    keyword_index,
    open_index,
    posting_rows,
    vector_norm,
)

DIM = 8
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts_of(n, seed, length=12):
    generator = np.random.default_rng(seed)
    # The first word is in most texts.
    weights = np.array([10.0] + [1.0] * (len(WORDS) - 1))
    return [
        " ".join(generator.choice(WORDS, size=generator.integers(1, length), p=weights / weights.sum()))
        for _ in range(n)
    ]


def top(scores, k):
    """(query, pk, score) best first; ties go to the smaller key."""
    best = []
    for query, found in scores.items():
        ordered = sorted(found.items(), key=lambda item: (-item[1], item[0]))[:k]
        best += [(query, pk, score, rank) for rank, (pk, score) in enumerate(ordered, 1)]
    return sorted(best)


def rows_of(hits):
    return sorted((r["query_id"], r["pk"], r["score"], r["rank"]) for r in hits.collect())


@pytest.fixture(scope="module")
def vectors():
    generator = np.random.default_rng(1)
    found = generator.integers(-2, 3, size=(500, DIM)).astype(np.float32)
    found[7] = 0
    found[8] = found[9]
    return found


def vector_table(spark, matrix, name, as_text=False):
    rows = [(f"k{n:04d}" if as_text else n, [float(x) for x in v]) for n, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} {'string' if as_text else 'bigint'}, embedding array<float>")


def best_cosines(rows, queries, k, key):
    scores = {}
    for q, wanted in enumerate(queries):
        if not wanted.any():
            continue
        scores[q] = {
            key(n): round(float(v @ wanted / np.linalg.norm(v) / np.linalg.norm(wanted)), 6) + 0.0
            for n, v in enumerate(rows.astype(float))
            if v.any()
        }
    return top(scores, k)


@pytest.mark.parametrize("block_queries", [4096, 3])
@pytest.mark.parametrize("as_text", [False, True])
def test_vector_search_equals_brute_force(spark, vectors, monkeypatch, block_queries, as_text):
    monkeypatch.setattr(search, "BLOCK_QUERIES", block_queries)
    monkeypatch.setattr(search, "CHUNK_ROWS", 20)
    queries = vectors[:10].copy()
    rows = vector_table(spark, vectors, "pk", as_text).withColumn("norm", vector_norm(F.col("embedding")))
    hits = search.search_vector(vector_table(spark, queries, "query_id"), Index(rows.repartition(5)), 9, tasks=3)
    key = (lambda n: f"k{n:04d}") if as_text else (lambda n: n)
    assert rows_of(hits) == best_cosines(vectors, queries.astype(float), 9, key)


def test_many_equal_scores(spark):
    rows = vector_table(spark, np.ones((3000, 2), dtype=np.float32), "pk")
    rows = rows.withColumn("norm", vector_norm(F.col("embedding"))).repartition(6)
    query = vector_table(spark, np.ones((1, 2)), "query_id")
    hits = search.search_vector(query, Index(rows), 4)
    assert [r[1] for r in rows_of(hits)] == [0, 1, 2, 3]


def tokens(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def best_bm25(documents, queries, k):
    counts = {pk: Counter(tokens(t)) for pk, t in documents.items()}
    lengths = {pk: sum(c.values()) for pk, c in counts.items()}
    average = sum(lengths.values()) / len(lengths)
    scores = {}
    for query, text in queries.items():
        found = {}
        for term in set(tokens(text)):
            df = sum(term in c for c in counts.values())
            idf = math.log(1 + (len(counts) - df + 0.5) / (df + 0.5))
            for pk, c in counts.items():
                if term in c:
                    norm = 1.2 * (0.25 + 0.75 * lengths[pk] / average)
                    found[pk] = found.get(pk, 0.0) + idf * c[term] * 2.2 / (c[term] + norm)
        if found:
            scores[query] = {pk: round(s, 6) for pk, s in found.items()}
    return top(scores, k)


@pytest.fixture(scope="module")
def documents():
    found = dict(enumerate(texts_of(300, 2)))
    found[300] = ""
    return found


@pytest.fixture(scope="module")
def index(spark, documents, tmp_path_factory):
    df = spark.createDataFrame(list(documents.items()), "id bigint, body string")
    folder = str(tmp_path_factory.mktemp("index"))
    return build_index(df, folder, "id", "body", DIM, model=HashEmbedder(DIM))


@pytest.mark.parametrize("tasks", [None, 1, 7])
def test_keyword_search_equals_brute_force(spark, index, documents, tasks):
    queries = dict(enumerate([*texts_of(6, 3), "Alpha ALPHA, kappa!", "unknown words", "", "..."]))
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    hits = search.search_keyword(asked, index, 7, tasks)
    assert rows_of(hits) == best_bm25(documents, queries, 7)


def jobs_of(spark, action):
    """How many jobs an action starts, adaptive execution aside."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_queries_take_no_more_jobs_than_few(spark, index, documents, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 5)
    found = []
    for n in (2, 40):
        queries = dict(enumerate(texts_of(n, 8)))
        asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string").coalesce(1)
        asked = search.embed_queries(asked, HashEmbedder(DIM)).coalesce(1)
        vector = jobs_of(spark, lambda: search.search_vector(asked, index, 3, 2).collect())
        keyword = jobs_of(spark, lambda: search.search_keyword(asked, index, 3, 2).collect())
        found.append((vector, keyword))
    assert found[0] == found[1]


def test_index_of_keywords_alone(spark, documents):
    df = spark.createDataFrame(list(documents.items()), "id bigint, body string")
    queries = dict(enumerate(texts_of(8, 5)))
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    hits = search.search_keyword(asked, keyword_index(df, "id", "body"), 3)
    assert rows_of(hits) == best_bm25(documents, queries, 3)
    nothing = search.search_keyword(asked, keyword_index(df.limit(0), "id", "body"), 3)
    assert nothing.count() == 0


def test_no_hits_keep_the_schema(spark, index):
    asked = spark.createDataFrame([(1, "nowhere")], "query_id bigint, text string")
    hits = search.search_keyword(asked, index)
    assert hits.columns == ["query_id", "pk", "score", "rank"] and hits.count() == 0
    nobody = search.search_keyword(asked.limit(0), index)
    assert nobody.columns == hits.columns and nobody.count() == 0
    empty = spark.createDataFrame([], "query_id bigint, embedding array<float>")
    assert search.search_vector(empty, index).count() == 0


def test_hybrid_fuses_both_ranks(spark, index, documents):
    queries = dict(enumerate(texts_of(3, 4)))
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    asked = search.embed_queries(asked, HashEmbedder(DIM))
    embed = HashEmbedder(DIM)()
    rows = np.array(embed(list(documents.values())), dtype=np.float32)
    wanted = np.array(embed(list(queries.values())), dtype=np.float32).astype(float)
    parts = {}
    for ranking in (best_cosines(rows, wanted, 50, int), best_bm25(documents, queries, 50)):
        for query, pk, _, rank in ranking:
            found = parts.setdefault(query, {})
            found[pk] = found.get(pk, 0.0) + 1 / (60 + rank)
    fused = {q: {pk: round(s, 6) for pk, s in found.items()} for q, found in parts.items()}
    hits = search.search_hybrid(asked, index, 10)
    assert rows_of(hits) == top(fused, 10)
    shown = search.with_columns(hits, index, ["content"])
    assert shown.columns == ["query_id", "pk", "rank", "score", "content"]
    assert all(r["content"] == documents[r["pk"]] for r in shown.collect())


def test_dimension_check(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "pk bigint, embedding array<float>"
    )
    good, bad = check_dimension(df, 2)
    assert [r["pk"] for r in good.collect()] == [1]
    assert sorted(r["pk"] for r in bad.collect()) == [2, 3]


def test_wrong_width_stops_the_write(spark, folder):
    df = spark.createDataFrame([(1, "a", [1.0])], "id bigint, body string, v array<float>")
    with pytest.raises(Exception, match="vector is not 2 wide"):
        create_or_sync(df, folder, "id", "body", 2, vector="v")
    with pytest.raises(FileNotFoundError):
        open_index(spark, folder)


class Counting:
    def __init__(self, log):
        self.log = log

    def __call__(self):
        embed = HashEmbedder(DIM)()

        def call(texts):
            with open(self.log, "a") as file:
                file.writelines(t + "\n" for t in texts)
            return embed(texts)

        return call


def state_of(index):
    docs = {r["pk"]: (r["content"], r["place"]) for r in index.docs.collect()}
    postings = sorted((r["term"], r["pk"], r["tf"], r["dl"]) for r in posting_rows(index).collect())
    vectors = sorted(r["pk"] for r in index.vectors.selectExpr("inline(rows)").collect())
    return docs, postings, vectors, [tuple(r) for r in index.totals.collect()]


def test_sync_follows_the_table(spark, folder):
    model = Counting(f"{folder}/log")
    schema = "id bigint, body string, place string"
    states = [
        [(1, "one", "a"), (2, "two two", "b"), (3, "three", "c")],
        [(1, "one", "a"), (2, "two again", "b"), (4, "four", "d")],
        [(1, "one", "z"), (2, "two again", "b"), (3, "three", "c")],
        [(2, "two again", "b")],
    ]
    for number, rows in enumerate(states):
        df = spark.createDataFrame(rows, schema)
        for _ in range(2):
            create_or_sync(df, f"{folder}/index", "id", "body", DIM, model=model)
        fresh = build_index(df, f"{folder}/fresh{number}", "id", "body", DIM, model=HashEmbedder(DIM))
        assert state_of(open_index(spark, f"{folder}/index")) == state_of(fresh)
        index = open_index(spark, f"{folder}/index")
        terms = sorted(map(tuple, index.terms.collect()))
        assert terms == sorted(map(tuple, open_index(spark, f"{folder}/fresh{number}").terms.collect()))
        assert index.totals.first()["n"] == len(rows)
    with open(f"{folder}/log") as file:
        sent = sorted(file.read().split("\n")[:-1])
    # Created: 3. Then two and four; then one (its place changed) and three; then nothing.
    assert sent == sorted(["one", "two two", "three", "two again", "four", "one", "three"])


def test_untouched_buckets_are_not_rewritten(spark, folder):
    rows = [(n, f"text {n}") for n in range(60)]
    df = spark.createDataFrame(rows, "id bigint, body string")
    create_or_sync(df, folder, "id", "body", DIM, model=HashEmbedder(DIM), buckets=8)
    before = {p: p.stat().st_mtime_ns for p in Path(folder, "docs").rglob("*.parquet")}
    changed = df.withColumn("body", F.when(F.col("id") == 5, "another").otherwise(F.col("body")))
    create_or_sync(changed, folder, "id", "body", DIM, model=HashEmbedder(DIM))
    after = {p: p.stat().st_mtime_ns for p in Path(folder, "docs").rglob("*.parquet")}
    same = {p.parent.name for p in before if after.get(p) == before[p]}
    assert len(same) == len({p.parent.name for p in before}) - 1


@pytest.fixture
def many_cells(monkeypatch):
    monkeypatch.setattr(index_module, "VECTORS_PER_CELL", 4)
    monkeypatch.setattr(index_module, "CHUNK_ROWS", 10)


def stored_vectors(spark, rows, folder, as_text=False):
    df = vector_table(spark, rows, "id", as_text).withColumn("body", F.lit("x"))
    return build_index(df, folder, "id", "body", rows.shape[1], vector="embedding", buckets=2)


@pytest.mark.parametrize("as_text", [False, True])
def test_search_over_cells_equals_brute_force(spark, vectors, folder, many_cells, as_text):
    index = stored_vectors(spark, vectors, folder, as_text)
    assert index.cells.count() == 62 and index.vectors.selectExpr("inline(rows)").count() == 499
    queries = vectors[:12].copy()
    hits = search.search_vector(vector_table(spark, queries, "query_id"), index, 9, probes=2)
    key = (lambda n: f"k{n:04d}") if as_text else (lambda n: n)
    assert rows_of(hits) == best_cosines(vectors, queries.astype(float), 9, key)


def clustered(n, dim=16, seed=3):
    generator = np.random.default_rng(seed)
    centres = generator.normal(size=(20, dim))
    return (centres[generator.integers(0, 20, n)] + 0.1 * generator.normal(size=(n, dim))).astype(np.float32)


def test_lists_that_cannot_hold_a_hit_are_not_read(spark, folder, many_cells):
    rows = clustered(1500)
    index = stored_vectors(spark, rows, folder)
    asked = vector_table(spark, rows[::50], "query_id")
    exact = best_cosines(rows, rows[::50].astype(float), 5, lambda n: n)
    assert rows_of(search.search_vector(asked, index, 5, probes=3)) == exact
    # The nearest cells alone find nine of ten, and leave few lists for which bounds have to be read.
    first = search.search_vector(asked, index, 5, exact=False)
    found = {(r["query_id"], r["pk"]) for r in first.collect()}
    assert len(found & {r[:2] for r in exact}) >= 0.9 * len(exact)
    near = search.cells_of_queries(asked, index.cells).filter(F.col("place") > search.PROBES)
    n_left = search.lists_left(near, first, index, 5).count()
    assert n_left < 0.2 * index.vectors.count() * asked.count()


def test_blocks_that_cannot_hold_a_hit_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(index_module, "BLOCK_DOCS", 8)
    generator = np.random.default_rng(4)
    texts = dict(enumerate(texts_of(900, 11) + [" ".join(generator.choice(WORDS, 200)) + f" rare{n % 7}" for n in range(100)]))
    df = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    index = keyword_index(df, "id", "body", buckets=4)
    questions = dict(enumerate(["alpha rare3", "gamma", "rare1 rare2 beta", "nothing known", "kappa iota theta"]))
    asked = spark.createDataFrame(list(questions.items()), "query_id bigint, text string")
    assert rows_of(search.search_keyword(asked, index, 5)) == best_bm25(texts, questions, 5)
    weighed, average = search.weighed_terms(asked, index)
    bounds = search.block_bounds(weighed, index, average)
    first = search.search_keyword(asked, index, 5)
    read = search.blocks_left(bounds, first, 5).count() + bounds.filter(F.col("place") <= search.SEED_BLOCKS).count()
    assert read < 0.5 * bounds.count()


class Stopped(Exception):
    pass


@pytest.mark.parametrize("at", [1, 2, 3, 4])
def test_a_sync_that_was_stopped_is_repeated(spark, folder, monkeypatch, at):
    """Stopped before the ``at``-th table is written, or (4) after all of them."""
    schema, model = "id bigint, body string, place string", HashEmbedder(DIM)
    old = spark.createDataFrame([(n, f"text {n}", "a") for n in range(20)], schema)
    new = spark.createDataFrame([(n, f"text {n}" if n % 3 else f"other {n}", "a") for n in range(3, 24)], schema)
    create_or_sync(old, f"{folder}/index", "id", "body", DIM, model=model, buckets=4)
    calls, write, remove = [], index_module._write_buckets, index_module.remove_folder

    def writes(*args):
        calls.append(args)
        if len(calls) == at:
            raise Stopped
        write(*args)

    def removes(spark, path):
        if path.endswith("/pending"):
            raise Stopped
        remove(spark, path)

    with monkeypatch.context() as patch, pytest.raises(Stopped):
        patch.setattr(index_module, "_write_buckets", writes)
        patch.setattr(index_module, "remove_folder", removes)
        create_or_sync(new, f"{folder}/index", "id", "body", DIM, model=model)
    with pytest.raises(RuntimeError):
        open_index(spark, f"{folder}/index")
    # A bucket that was being replaced can be gone altogether.
    remove(spark, f"{folder}/index/postings/bucket=1")
    create_or_sync(new, f"{folder}/index", "id", "body", DIM, model=model)
    fresh = build_index(new, f"{folder}/fresh", "id", "body", DIM, model=model, buckets=4)
    assert state_of(open_index(spark, f"{folder}/index")) == state_of(fresh)


def test_a_creation_that_was_stopped_is_begun_again(spark, folder, monkeypatch):
    df = spark.createDataFrame([(1, "one", "a"), (2, "two", "b")], "id bigint, body string, place string")

    def stop(*args):
        raise Stopped

    with monkeypatch.context() as patch, pytest.raises(Stopped):
        patch.setattr(index_module, "_term_counts", stop)
        create_or_sync(df, f"{folder}/index", "id", "body", DIM, model=HashEmbedder(DIM))
    with pytest.raises(FileNotFoundError):
        open_index(spark, f"{folder}/index")
    index = build_index(df, f"{folder}/index", "id", "body", DIM, model=HashEmbedder(DIM))
    assert index.docs.count() == 2


def test_an_empty_index(spark, folder):
    df = spark.createDataFrame([], "id bigint, body string, place string")
    index = build_index(df, folder, "id", "body", DIM, model=HashEmbedder(DIM))
    asked = spark.createDataFrame([(1, "one", [1.0] * DIM)], "query_id bigint, text string, embedding array<float>")
    assert search.search_vector(asked, index, 3).collect() == []


def written_rows(monkeypatch):
    """How many rows each call of ``stored`` wrote, by purpose."""
    counts, write = {}, search.stored

    def counted(df, purpose):
        out = write(df, purpose)
        counts[purpose] = max(counts.get(purpose, 0), out.count())
        return out

    monkeypatch.setattr(search, "stored", counted)
    return counts


@pytest.mark.parametrize("as_text", [False, True])
def test_many_queries_meet_slices_of_the_vectors(spark, vectors, folder, many_cells, monkeypatch, as_text):
    for name, value in (("MOST_PAIRS", 100), ("PART_QUERIES", 5), ("PASS_QUERIES", 2), ("PASS_ROWS", 7), ("HELD_HITS", 30), ("SLICE_ROWS", 90)):
        monkeypatch.setattr(search, name, value)
    index = stored_vectors(spark, vectors, folder, as_text)
    queries = vectors[:12].copy()
    counts = written_rows(monkeypatch)
    hits = search.search_vector(vector_table(spark, queries, "query_id"), index, 9, tasks=2)
    key = (lambda n: f"k{n:04d}") if as_text else (lambda n: n)
    assert rows_of(hits) == best_cosines(vectors, queries.astype(float), 9, key)
    assert max(counts.values()) <= 12  # not queries times cells


def test_many_queries_meet_slices_of_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(index_module, "BLOCK_DOCS", 8)
    for name, value in (("MOST_PAIRS", 1), ("PART_QUERIES", 3), ("PASS_QUERIES", 2), ("HELD_HITS", 20), ("SLICE_ROWS", 30)):
        monkeypatch.setattr(search, name, value)
    texts = dict(enumerate(texts_of(300, 11) + ["alpha rare1"] * 20 + ["", "gamma"]))
    df = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    index = keyword_index(df, "id", "body", buckets=4)
    questions = dict(enumerate(["alpha rare1", "gamma", "rare1 gamma beta", "nothing known", "kappa iota theta", "alpha alpha", ""]))
    asked = spark.createDataFrame([*questions.items(), (None, "gamma")], "query_id bigint, text string")
    counts = written_rows(monkeypatch)
    assert rows_of(search.search_keyword(asked, index, 5, 2)) == best_bm25(texts, questions, 5)
    assert "block-bounds" not in counts and "asked-lists" not in counts


def test_a_large_bucket_is_the_work_of_several_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(index_module, "BLOCK_DOCS", 8)
    monkeypatch.setattr(index_module, "PART_CHARS", 100)
    texts = dict(enumerate(texts_of(200, 2)))
    df = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    index = build_index(df, folder, "id", "body", DIM, model=HashEmbedder(DIM), buckets=2)
    for name in ("docs", "postings"):
        assert all(len(list(p.glob("*.parquet"))) > 3 for p in Path(folder, name).glob("bucket=*"))
    docs = index.postings.select("bucket", "block", F.explode("pks").alias("pk")).distinct()
    assert docs.count() == sum(1 for t in texts.values() if re.search(r"\w", t))
    sizes = docs.groupBy("bucket", "block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 8
    questions = {0: "alpha", 1: "gamma beta"}
    asked = spark.createDataFrame(list(questions.items()), "query_id bigint, text string")
    assert rows_of(search.search_keyword(asked, index, 5)) == best_bm25(texts, questions, 5)


ODD_TEXTS = [(n, text) for n, text in enumerate(texts_of(200, 21))]
ODD_TEXTS += [(7, "alpha rare1 rare1"), (7, "alpha rare1 gamma"), (8, ODD_TEXTS[8][1]), (300, None), (301, "...")]


@pytest.mark.parametrize("common", [0, 2, 256])
def test_slices_give_what_blocks_give(spark, monkeypatch, common):
    """Also where keys of documents and queries repeat, and whether terms stand in a matrix or in lists."""
    monkeypatch.setattr(index_module, "BLOCK_DOCS", 8)
    index = keyword_index(spark.createDataFrame(ODD_TEXTS, "id bigint, body string"), "id", "body", buckets=4)
    questions = [*enumerate(texts_of(9, 22)), (3, "rare1 alpha"), (20, "rare1"), (21, None), (22, "unknown")]
    asked = spark.createDataFrame(questions, "query_id bigint, text string")
    by_block = rows_with_nulls(search.search_keyword(asked, index, 12, 2))
    for name, value in (("MOST_PAIRS", 1), ("PART_QUERIES", 3), ("PASS_QUERIES", 2), ("SLICE_ROWS", 30), ("MOST_COMMON", common), ("COMMON_SHARE", 0.01), ("GROUPED", 2)):
        monkeypatch.setattr(search, name, value)
    assert rows_with_nulls(search.search_keyword(asked, index, 12, 2)) == by_block and len(by_block) > 50


def rows_with_nulls(hits):
    return sorted(tuple(map(str, r)) for r in hits.select("query_id", "pk", "score", "rank").collect())


def test_hits_of_a_slice_are_one_row_per_query(spark, monkeypatch):
    monkeypatch.setattr(index_module, "BLOCK_DOCS", 8)
    index = keyword_index(spark.createDataFrame(list(enumerate(texts_of(300, 11))), "id bigint, body string"), "id", "body", buckets=4)
    asked = spark.createDataFrame([(0, "alpha gamma"), (1, "kappa"), (2, "beta delta")], "query_id bigint, text string")
    weighed, average = search.weighed_terms(asked, index)
    schema = search._hit_schema(asked, index)
    assert search._block_slices(weighed, 3, index, 300, average, 20, 1, schema).count() <= 3 * 2  # queries times slices
    generator = np.random.default_rng(3)
    vectors = generator.normal(size=(300, DIM)).astype(np.float32)
    held = vector_table(spark, vectors, "pk").select(F.lit(0).alias("bucket"), (F.col("pk") % 7).cast("int").alias("cell"), F.lit(0).alias("chunk"), "pk", "embedding", vector_norm(F.col("embedding")).alias("norm"))
    lists = held.groupBy("bucket", "cell", "chunk").agg(F.collect_list(F.struct("pk", "embedding", "norm")).alias("rows"))
    found = search._vector_slices(vector_table(spark, vectors[:3], "query_id"), Index(held, vectors=lists), 3, 20, 1, schema)
    assert found.count() <= 3 * 2
    assert rows_of(search._best_of_lists(found, 20)) == best_cosines(vectors, vectors[:3].astype(float), 20, int)


def test_vectors_that_are_no_numbers_hide_no_others(spark, folder, monkeypatch):
    rows = np.random.default_rng(5).normal(size=(60, DIM)).astype(np.float32)
    asked = vector_table(spark, rows[:4], "query_id")
    rows[50], rows[51, 0] = np.nan, np.inf
    index = stored_vectors(spark, rows, folder)
    monkeypatch.setattr(search, "MOST_PAIRS", 1)
    good = {n: v for n, v in enumerate(rows) if np.isfinite(v).all()}
    assert rows_of(search.search_vector(asked, index, 5, 2)) == best_cosines(np.stack(list(good.values())), rows[:4].astype(float), 5, list(good).__getitem__)


def test_slices_go_to_tasks_of_their_own(spark):
    keys = search.keys_apart(spark, 13)
    placed = spark.createDataFrame([(k,) for k in keys], "k int").repartition(13, "k").select(F.spark_partition_id().alias("at"))
    assert placed.distinct().count() == 13


def test_texts_are_cut_into_tokens_once(spark, documents):
    rows = spark.createDataFrame(list(documents.items()), "pk bigint, content string").withColumn("bucket", F.lit(0))
    plan = index_module.posting_blocks(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_stand_in_vectors_of_any_text():
    generator, find = np.random.default_rng(6), __import__("regex").compile(r"[\p{L}\p{N}]+").findall
    texts = ["", "...", "\u00c4rger a_b 3\u00bd \u00b5", "\u0130stanbul \u212a \u03a3\u03b1\u03c2", "\u65e5\u672c 12 x"]
    texts += ["".join(chr(c) if c > 40 else " " for c in generator.integers(1, high, 80)) for high in (256, 3000) for _ in range(40)]
    for text, vector in zip(texts, HashEmbedder(DIM)()(texts)):
        counts = Counter(int(__import__("hashlib").md5(t.encode()).hexdigest()[:8], 16) % DIM for t in find(text.lower()))
        length = math.sqrt(sum(c * c for c in counts.values()))
        assert vector == [counts[b] / length if length else 0.0 for b in range(DIM)]
