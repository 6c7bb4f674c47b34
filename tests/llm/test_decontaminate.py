import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, docs_of, empty_docs, odd_docs, ordered, sql_rows
from turnwise.llm.decontaminate import canonical_words, drop_contaminated, find_contaminated, raw_words
from turnwise.llm.oracles import CONTAMINATION

ITEM = "If Peter has 12 apples and gives 5 km to Anna, how many apples does Peter keep at home today"


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(docs, items):
    return sorted((r.doc_id, r.item_id, r.kind) for r in find_contaminated(docs, items).collect())


def test_words_pair_up_with_placeholders(spark):
    texts = [ITEM, "abc12def 3,5kg of Zürich. New day; Old Town", "İstanbul ½ x²", ""]
    docs = docs_of(spark, texts)
    for row in docs.select(canonical_words(docs.text).alias("a"), raw_words(docs.text).alias("b")).collect():
        assert len(row.a) == len(row.b)
    first = docs.select(canonical_words(docs.text).alias("a")).first().a
    assert first[:10] == ["1", "1", "has", "0", "apples", "and", "gives", "0", "2", "to"]


@pytest.mark.parametrize(
    "text,kind",
    [
        (f"he asked: {ITEM}.", "exact"),
        (ITEM.lower().replace("peter", "Peter").replace("anna", "Anna"), "exact"),
        (ITEM.replace("Peter", "Maria").replace("12", "70").replace("Anna", "Lena"), "template"),
        (ITEM.replace("12", "70").replace("Peter keep", "Anna keep"), None),
        (ITEM.replace("Peter", "Maria").replace("Anna", "Maria"), None),
        ("How many apples does Peter keep at home", None),
        # A variant that stands first does not hide the item itself, wherever it stands.
        ("If Maria has 12 apples and gives 5 km to Maria, how many apples does Maria keep at home today. " + ITEM, "exact"),
        # One word changed, left out or put in.
        (ITEM.replace("how many", "how few"), "exact"),
        (ITEM.replace("how many", "how very many"), "exact"),
        (ITEM.replace("how many", "how"), "exact"),
    ],
)
def test_values_have_to_map_one_to_one(spark, text, kind):
    expected = [] if kind is None else [(0, 0, kind)]
    assert found(docs_of(spark, [text, "nothing like it at all in this text"]), items_of(spark, [ITEM])) == expected


def test_names_at_sentence_starts(spark):
    item = "Alice and Bob share a flat. Alice pays 12 dollars per day. Bob pays 7 dollars per day. Carol pays nothing. How much do they pay together in a week?"
    other = item
    for old, new in (("Alice", "Dora"), ("Bob", "Emil"), ("Carol", "Frank"), ("12", "15"), ("7", "9")):
        other = other.replace(old, new)
    mixed = other.replace("Emil pays", "Dora pays")
    assert found(docs_of(spark, [other, mixed, "He said: " + other]), items_of(spark, [item])) == [(0, 0, "template"), (2, 0, "template")]


def test_parts_of_long_items_and_short_items(spark):
    long = " ".join(f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "su") for b in ("ban", "dor", "vel", "sin", "pom", "rit", "gal", "hen", "jud", "fer"))
    words = long.split()
    texts = [" ".join(words[20:33]), " ".join(words[20:32]), "Two words!", "two words more", "one", ""]
    items = items_of(spark, [long, "two words", "One.", ""])
    assert found(docs_of(spark, texts), items) == [(0, 0, "exact"), (2, 1, "exact"), (4, 2, "exact")]


def test_clashing_names(spark):
    docs = docs_of(spark, [ITEM, "clean"]).withColumnsRenamed({"lang": "_doc", "source": "_text"}).withColumn("text_key", F.lit(1))
    left = drop_contaminated(docs, items_of(spark, [ITEM]))
    assert [r.doc_id for r in left.collect()] == [1] and left.columns == docs.columns


def test_planted_items_match_brute_force(spark):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ban", "dor", "vel", "sin", "pom")]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 5, 7, 8, 20, 40]))) for _ in range(25)]
    texts = []
    for _ in range(150):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        item = rnd.choice(items).split()
        part = item[: rnd.choice([len(item), len(item) * 2 // 3, len(item) // 3])]
        at = rnd.randint(0, len(body))
        texts.append(" ".join(body[:at] + part + body[at:]))

    def runs(text, size):
        own = re.findall(r"\w+", text)
        return [tuple(own[i : i + size]) for i in range(len(own) - size + 1)]

    def reach(places):
        covered = sorted({i for p in places for i in range(p, p + 5)})
        longest = now = 0
        for i, c in enumerate(covered):
            now = now + 1 if i and c == covered[i - 1] + 1 else 1
            longest = max(longest, now)
        return len(covered), longest

    expected = set()
    for number, item in enumerate(items):
        windows, n = runs(item, 5), len(item.split())
        for doc, text in enumerate(texts):
            if n < 5 and re.findall(r"\w+", text) == item.split():
                expected.add((doc, number, "exact"))
            votes = {}
            for at, there in enumerate(runs(text, 5)):
                for item_at, w in enumerate(windows):
                    if w == there:
                        votes.setdefault(at - item_at, set()).add(item_at)
            group, last = set(), None
            for shift in [*sorted(votes), 10**9]:
                if last is not None and shift - last > 1:
                    covered, longest = reach(group)
                    if covered >= 0.5 * n or longest >= 13:
                        expected.add((doc, number, "exact"))
                    group = set()
                group |= votes.get(shift, set())
                last = shift
    assert found(docs_of(spark, texts), items_of(spark, items)) == sorted(expected)


def test_altered_items_match_the_sql(spark):
    rnd = random.Random(5)
    items = [
        ITEM,
        "A train of 3,5kg goes from Old Town to New York in 7 hours and back in 9 Hours; so what is it",
        "one two three four five six",
        "In Rome 4 men met 4 women, and Marco left with 4 euros at 5 min past noon",
    ]
    names = ["Peter", "Anna", "Rome", "Marco", "Lena", "York"]
    texts = []
    for _ in range(300):
        text = rnd.choice(items)
        for _ in range(rnd.randint(0, 4)):
            words = text.split(" ")
            kind = rnd.random()
            if kind < 0.5:
                text = text.replace(rnd.choice(names), rnd.choice(names))
            elif kind < 0.8:
                text = text.replace(rnd.choice("3457"), str(rnd.randint(1, 99)))
            else:
                words[rnd.randrange(len(words))] = rnd.choice(["the", "Men", "12", "\tAnna", ", Bob", "KM"])
                text = " ".join(words)
        texts.append(rnd.choice(["", "he said ", "so, ", "X "]) + text + rnd.choice([""," ok"]))
    documents = [*enumerate(texts), (None, ITEM), (900, None)]
    benchmark = [*enumerate(items), (9, None), (None, ITEM), (1, items[3])]
    rows = find_contaminated(
        spark.createDataFrame(documents, "doc_id long, text string"),
        spark.createDataFrame(benchmark, "item_id long, text string"),
    ).drop("text_key")
    tables = {"documents": (["doc_id", "text"], documents), "benchmark": (["item_id", "text"], benchmark)}
    expected = [tuple(None if v != v else int(v) if isinstance(v, float) and i < 2 else v for i, v in enumerate(r)) for r in sql_rows(CONTAMINATION, **tables)]
    found = ordered(rows.collect())
    assert found == ordered(expected) and {r[6] for r in found} == {"exact", "template"}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, ITEM), (3, "one two"), (4, ODD[6][1]), (4, ODD[6][1])], "item_id long, text string")
    assert found(odd_docs(spark), items) == [(5, 4, "exact")]
    left = drop_contaminated(odd_docs(spark), items)
    assert left.columns == odd_docs(spark).columns and left.count() == len(ODD) - 2
    assert found(empty_docs(spark), items) == []
    assert found(odd_docs(spark), items.limit(0)) == []
    assert drop_contaminated(odd_docs(spark), items.limit(0)).count() == len(ODD)
