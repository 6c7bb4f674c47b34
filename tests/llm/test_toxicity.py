import math
import random
import zlib
from dataclasses import replace

import numpy as np

from tests.llm.helpers import ODD, docs_of, empty_docs, odd_docs
from turnwise.llm.toxicity import Scorer, Settings, drop_toxic, fit_toxicity, score_toxicity, train

RUDE = ["horrible", "stupidity", "worthless", "disgusting", "pathetic"]
CALM = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter", "sa") for b in ("ran", "vel", "do", "ki") for c in ("", "s", "ta", "lin")]


def sample(n, seed):
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rnd.choice(CALM) for _ in range(rnd.randint(5, 60))]
        if i % 2:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(RUDE))
        texts.append(" ".join(words))
        labels.append(i % 2)
    return texts, labels


def test_held_out_and_misspelt_words():
    scorer = Scorer(train(*sample(600, 1), Settings()))
    texts, labels = sample(200, 2)
    assert np.mean([(scorer.score(t) >= 0.5) == y for t, y in zip(texts, labels)]) > 0.97
    assert scorer.score("baran melo horribble disgustingg terveltas") > scorer.score("baran melo teraned salmon terveltas")


def test_scores_match_plain_averages_over_strings(spark):
    settings = Settings()
    model = train(*sample(300, 6), settings)
    texts = [*sample(60, 7)[0], None, "", "123 !?", "Ärger_über Worthless-ness", "x" * 300 + " stupidity", "é"]

    def vector(word):
        marked = "<" + word + ">"
        bag = {marked} | {marked[i:j] for i in range(len(marked)) for j in range(i + 3, min(i + 5, len(marked)) + 1)}
        return sum(float(model.odds[zlib.crc32(g.encode()) % settings.buckets]) for g in bag) / len(bag)

    def plain(text):
        words, word = [], ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                words.append(word)
                word = ""
        windows = [words[i : i + settings.window] for i in range(0, len(words), settings.window)]
        odds = max((sum(map(vector, w)) / len(w) for w in windows), default=0.0) + model.bias
        return math.exp(odds) / (1 + math.exp(odds))

    rows = score_toxicity(docs_of(spark, texts), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in rows], [plain(t) for t in texts], rtol=0, atol=1e-6)


def test_equal_texts_get_equal_scores_and_training_repeats():
    data = sample(200, 3)
    a, b = (Scorer(train(*data, Settings())) for _ in range(2))
    assert [a.score(t) for t in data[0][:20]] == [b.score(t) for t in data[0][:20]]


def test_on_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    toxic, clean = scored[scored.toxic == 1].score.values, scored[scored.toxic == 0].score.values
    assert (toxic[:, None] > clean[None, :]).mean() > 0.9
    assert (clean >= 0.5).mean() < 0.03


def test_odd_rows_and_empty_tables(spark):
    model = train(*sample(200, 4), Settings())
    rows = score_toxicity(odd_docs(spark), model).collect()
    assert [r.doc_id for r in rows] == [r[0] for r in ODD]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {True}
    assert score_toxicity(empty_docs(spark), model).count() == 0
    assert drop_toxic(odd_docs(spark), model).columns == odd_docs(spark).columns
    assert drop_toxic(empty_docs(spark), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = docs_of(spark, ["some text", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert [r.predicted for r in rows] == [0, 0]


def test_held_out_rows_and_null_labels_are_not_learned(spark):
    docs = docs_of(spark, sample(40, 5)[0])
    labels = spark.createDataFrame([(i, 1, 1 if i % 2 else None) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, labels)
    assert not model.odds.any()


def test_null_texts_stay_and_repeated_rows_go_together(spark):
    model = replace(train(*sample(200, 4), Settings()), bias=100.0)
    assert Scorer(model).score("") >= 0.5
    docs = docs_of(spark, [None, "", "baran melo", "baran melo"])
    assert [r.doc_id for r in drop_toxic(docs, model).collect()] == [0]
