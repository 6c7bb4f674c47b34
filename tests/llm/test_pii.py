import random

from tests.llm.helpers import ODD, docs_of, empty_docs, odd_docs, ordered, sql_rows
from turnwise.llm.oracles import PERSONAL_DATA, PII_KEY
from turnwise.llm.pii import pseudonymise

PARTS = [
    "+1 (017) 555-7713", "a.b@m.example.com", " ", ", ", "4785380592391139", "4111 1111 1111 1111", "1.2.3.4", "255.255.255.256",
    "2024-02-29", "1900-02-29", "2000-02-29", "2023-02-30", "31/04/1999", "30/04/1999", "123-45-6789", "5", "12", "-", "/", ".",
    "é", "😀", "(555) 123-4567", "555-123-4567", "x", "\n", "12345678901234567890", "1234567890123", "+49 30 123 4567",
    "1699-12-31", "2100-01-01", "@", "00.01.02.003", "4785380592391138", "378282246310005", "000-12-3456", "666-12-3456",
    "912-12-3456", "123-00-4567", "123-45-0000", "b" * 70, "c" * 90 + "@mail.example", "@mail.example",
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10


def test_random_texts_match_the_sql(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 9))) for _ in range(500)] + [None]
    found = pseudonymise(docs_of(spark, texts), PII_KEY).collect()
    rows = sql_rows(PERSONAL_DATA, documents=(["doc_id", "text"], list(enumerate(texts))))
    assert ordered(found) == ordered(rows)


def test_odd_rows(spark):
    rows = pseudonymise(odd_docs(spark), "k").collect()
    assert ordered((r.doc_id, r.text, r.n_replaced) for r in rows) == ordered((o[0], o[1], 0) for o in ODD)
    assert pseudonymise(empty_docs(spark), "k").count() == 0


def test_permutation_within_the_format(spark):
    cards = [f"{n:015d}{-luhn(f'{n:015d}0') % 10}" for n in range(800)]
    dates = [f"2000-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    rows = pseudonymise(docs_of(spark, [*cards, *dates]), "k").orderBy("doc_id").collect()
    new_cards, new_dates = [r.text for r in rows[:800]], [r.text for r in rows[800:]]
    assert len(set(new_cards)) == 800 and all(len(c) == 16 and c.isdigit() for c in new_cards)
    assert not any(map(luhn, new_cards + cards))
    assert len(set(new_dates)) == len(dates) and all("1700-01-01" <= d <= "2099-12-31" for d in new_dates)


def test_equal_values_stay_linked_and_keys_differ(spark):
    texts = ["call +1 (017) 555-7713 now", "or +1 (017) 555-7713", "mail a@b.example.com", "A@b.example.com"]
    a, b, c, d = [r.text for r in pseudonymise(docs_of(spark, texts), "k").orderBy("doc_id").collect()]
    assert a[5:-4] == b[3:] and a[5:8] == "+1 " and a[5:22] != texts[1][3:]
    assert c[5:] == d and "example" not in d
    assert pseudonymise(docs_of(spark, texts), "other").orderBy("doc_id").first().text != a


def test_only_valid_numbers_are_replaced(spark):
    kept = ["at 1700000000123 ms", "4111 1111 1111 1112", "000-00-0000", "900-12-3456", "123-00-4567"]
    assert [r.text for r in pseudonymise(docs_of(spark, kept), "k").orderBy("doc_id").collect()] == kept
    gone = ["4111 1111 1111 1111", "4111-1111-1111-1111", "123-45-6789"]
    rows = pseudonymise(docs_of(spark, gone), "k").orderBy("doc_id").collect()
    assert [(r.n_card, r.n_ssn) for r in rows] == [(1, 0), (1, 0), (0, 1)]
    assert rows[0].text.replace(" ", "") == rows[1].text.replace("-", "") != "4111111111111111"


def test_long_user_names_go_whole(spark):
    texts = ["x " + "a" * 80 + "@x.com y", "+49 30 123 4567a.b@x.com", "a" * 200_000 + "@"]
    rows = [r.text for r in pseudonymise(docs_of(spark, texts), "k").orderBy("doc_id").collect()]
    assert rows[0][:3] == "x u" and len(rows[0]) == len("x u@mail.invalid y") + 12 and "aa@" not in rows[0]
    assert rows[1].endswith("@mail.invalid") and "a.b" not in rows[1] and rows[2] == texts[2]
