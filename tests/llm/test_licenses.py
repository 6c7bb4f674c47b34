import random

from tests.llm.helpers import ODD, docs_of, empty_docs, odd_docs, ordered, sql_rows
from turnwise.llm.licenses import TEMPLATES, scan_licenses
from turnwise.llm.oracles import LICENSES

PARTS = ["MIT License", "apache", "License", "GNU General Public License", "general", "public", "mit-license", "the", "of", "ÄMIT", "\n", "x"]


def texts_with_notices(n):
    rnd = random.Random(9)
    texts = []
    for _ in range(n):
        words = [rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))]
        if rnd.random() < 0.5:
            notice = rnd.choice(TEMPLATES).text.split()
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(notice))
                notice[at : at + rnd.randint(0, 1)] = ["changed"] * rnd.randint(0, 2)
            words.insert(rnd.randint(0, len(words)), " ".join(notice))
        texts.append(" ".join(words))
    return texts


def test_random_texts_match_the_sql(spark):
    texts = [*texts_with_notices(400), None, ""]
    found = scan_licenses(docs_of(spark, texts)).collect()
    rows = sql_rows(LICENSES, documents=(["doc_id", "text"], list(enumerate(texts))))
    clean = [tuple(None if v != v else v for v in r) for r in rows]
    assert ordered(found) == ordered(clean)


def test_base_places_are_all_found(spark):
    row = scan_licenses(docs_of(spark, ["MIT License, mit  license; general Public LICENSE apache license mit"])).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (10, 4, 0, 7)
    assert row.base_labels == "apache,gpl,mit" and row.score == 1.0


def test_a_notice_with_an_inserted_word_is_found(spark):
    text = TEMPLATES[3].text.replace("of charge", "of any charge")
    row = scan_licenses(docs_of(spark, [f"so {text} it"])).first()
    assert (row.labels, row.base_labels, row.n_base, row.first_word) == ("mit", "", 0, None)


def test_words_of_a_notice_out_of_order_do_not_count(spark):
    notice = next(t.text for t in TEMPLATES if t.label == "zlib").split()
    # Groups of three words change places two by two, so votes lie within three diagonals of the whole.
    groups = [notice[i : i + 3] for i in range(0, len(notice), 3)]
    turned = [w for i in range(0, len(groups) - 1, 2) for w in (*groups[i + 1], *groups[i])]
    rows = scan_licenses(docs_of(spark, [" ".join(notice), " ".join(turned)])).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in rows] == [("zlib", 1.0), ("", 0.0)]


def test_every_notice_is_found_whole_and_with_some_words_changed(spark):
    texts, labels = [], []
    for t in TEMPLATES:
        words = t.text.split()
        texts.append("so " + " ".join(words) + " it")
        labels.append(t.label)
        if len(words) > 20:
            words[len(words) // 2] = "changed"
            words.insert(len(words) // 4, "added")
            texts.append(" ".join(words))
            labels.append(t.label)
    rows = scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert all(label in r.labels.split(",") for r, label in zip(rows, labels, strict=True))
    assert len({t.label for t in TEMPLATES}) >= 20


def test_odd_rows(spark):
    rows = scan_licenses(odd_docs(spark)).collect()
    assert ordered((r.doc_id, r.n_base, r.first_word, r.labels, r.score) for r in rows) == ordered((o[0], 0, None, "", 0.0) for o in ODD)
    assert scan_licenses(empty_docs(spark)).count() == 0
