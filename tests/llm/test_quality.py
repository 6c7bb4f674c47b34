import random

from tests.llm.helpers import ODD, docs_of, empty_docs, odd_docs, ordered, sql_rows
from turnwise.llm.oracles import QUALITY
from turnwise.llm.quality import Threshold, score_quality

WORDS = ["the", "of", "Haus", "ÉTÉ", "###", "$$$", "a", "bb", "ccc", "\n", "\n", "\t", "😀x", "le"]


def sorted_columns(frame):
    return frame.select(sorted(frame.columns))


def test_random_texts_match_the_sql(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS[: rnd.randint(2, 14)]) for _ in range(rnd.randint(0, 120))) for _ in range(300)] + [None, ""]
    found = score_quality(docs_of(spark, texts))
    rows = sql_rows(QUALITY, documents=(["doc_id", "text"], list(enumerate(texts))))
    assert ordered(found.collect()) == ordered(rows)


def test_odd_rows_match_the_sql(spark):
    rows = sql_rows(QUALITY, documents=(["doc_id", "text"], [r[:2] for r in ODD]))
    found = [tuple(r) for r in score_quality(odd_docs(spark)).collect()]
    clean = [tuple(None if v != v else v for v in r) for r in rows]
    assert ordered(found) == ordered(clean)
    assert score_quality(empty_docs(spark)).count() == 0


def test_repeats_and_lines(spark):
    row = score_quality(docs_of(spark, ["a b c d a b c\nx y\nx y\n \n "])).first()
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines, row.kept) == (11, 6, 1, False)


def test_thresholds_decide(spark):
    text = " ".join(f"word{i} the" for i in range(60))
    kept = [score_quality(docs_of(spark, [text]), t).first().kept for t in ((), (Threshold("n_words", most=100),), (Threshold("stop_word_ratio", least=0.5),))]
    assert kept == [True, False, True]
