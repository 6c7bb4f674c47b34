import zlib

import numpy as np

from tests.llm.helpers import ODD, docs_of, empty_docs, odd_docs
from turnwise.llm.language import PIECE, Settings, compiled, fit_language, identify_language, letters_of, phrases, predict, suffix_automaton, train

SAMPLES = {
    "en": ["the cat sat on the mat and the dog ran to the house with a ball"],
    "de": ["der hund lief schnell nach haus und die katze schlief auf dem sofa"],
}


def brute(codes, sample):
    """Phrases of the whole text, each the longest stretch found in the sample."""
    text, i, n = "".join(map(chr, codes)), 0, 0
    while i < len(text):
        size = 0
        while i + size < len(text) and text[i : i + size + 1] in sample:
            size += 1
        i += max(size, 1)
        n += 1
    return n


def sample_text(texts):
    parts = [np.append(letters_of(t), 0) for t in texts]
    return "".join(map(chr, np.concatenate([*parts, np.array([0])])))


def test_phrases_are_longest_matches():
    model = train(SAMPLES)
    texts = ["the dog and the haus", "zzz qqq", "Katze! Hund? 12 x", "ünder the sofa " * 600, "cat" * 2000, "xa" * 1500, "", "lorem the dog ran " * 900]
    found = phrases(model, [letters_of(t) for t in texts])
    expected = [[brute(letters_of(t).tolist(), sample_text(SAMPLES[name])) for name in model.languages] for t in texts]
    assert found.tolist() == expected


def test_automaton_accepts_exactly_the_substrings():
    text = "abcbcab"
    moves = suffix_automaton([ord(c) for c in text])

    def accepts(word):
        state = 0
        for c in word:
            if ord(c) not in moves[state]:
                return False
            state = moves[state][ord(c)]
        return True

    words = {text[i:j] for i in range(8) for j in range(i, 8)}
    assert all(accepts(w) for w in words)
    assert not any(accepts(w) for w in ("abca", "cc", "bcabc", "ba", "d"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify_language(docs, fit_language(docs)).collect()
    real = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in real if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == real[r.doc_id] for r in held]) > 0.97


def test_odd_rows(spark):
    model = train(SAMPLES)
    rows = identify_language(odd_docs(spark), model).collect()
    assert [r.doc_id for r in rows] == [r[0] for r in ODD]
    assert [r.doc_id for r in rows if r.lang_pred == "und"] == [1, 2, 3, None, 7]
    assert all(0 <= r.score <= 1 for r in rows) and all(r.held_out for r in rows if r.doc_id is None)
    assert identify_language(empty_docs(spark), model).count() == 0


def test_nothing_to_learn(spark):
    docs = docs_of(spark, ["some text", None])
    model = fit_language(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang = 'x'"))
    assert [r.lang_pred for r in identify_language(docs, model).collect()] == ["und", "und"]
    assert predict(train({"en": SAMPLES["en"]}, Settings()), ["any text"]) == [("en", 1.0)]


def test_predictions_are_those_of_a_plain_parse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    bound = Settings(docs_per_language=5, chars_per_doc=400, chars_per_language=1500)
    model = fit_language(docs, bound)
    texts = [r.text for r in docs.select("text").collect()]
    codes = [letters_of(t or "") for t in texts]
    assert max(map(len, codes)) > 2048
    found = phrases(model, codes)
    learned = samples_of(docs, bound)
    expected = [[brute(c.tolist(), sample_text(learned[name])[:1500]) for name in model.languages] for c in codes]
    assert found.tolist() == expected
    for (language, score), row, code in zip(predict(model, texts), np.array(expected) * model.weights, codes):
        if not code.any():
            assert (language, score) == ("und", 0.0)
            continue
        best, second = np.sort(row)[:2]
        assert language == model.languages[int(np.argmin(row))] and score == 1 - best / second


def samples_of(docs, bound):
    kept = {}

    def keep(samples, settings):
        kept.update(samples)
        return train(samples, settings)

    from turnwise.llm import language

    own, language.train = language.train, keep
    try:
        fit_language(docs, bound)
    finally:
        language.train = own
    return kept


def test_long_texts_are_learned_from_start_to_end(spark):
    text = " ".join(f"w{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(10_000))
    docs = docs_of(spark, [text] * 3)
    pieces = samples_of(docs, Settings(docs_per_language=1, chars_per_doc=2_000))["en"]
    places = sorted(text.index(p) for p in pieces)
    assert len(places) == 10 and {len(p) for p in pieces} == {PIECE}
    assert places[0] == 0 and places[-1] == len(text) - PIECE


def test_many_symbols_take_little_memory():
    rnd = np.random.default_rng(5)
    sample = rnd.integers(2, 4000, 20_000).tolist()
    moves = suffix_automaton(sample)
    parser = compiled(moves, 4002)
    assert sum(a.nbytes for a in (parser.base, parser.owner, parser.to, parser.first)) < 3_000_000
    for state, row in enumerate(moves[1:], 1):
        for symbol, to in row.items():
            assert parser.owner[parser.base[state] + symbol] == state and parser.to[parser.base[state] + symbol] == to
