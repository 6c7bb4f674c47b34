import random
from collections.abc import Sequence
from itertools import permutations

from tests.llm.helpers import empty_docs, odd_docs, ordered, sql_rows

from turnwise.llm import oracles
from turnwise.llm.filter_audit import audit_filters, audit_orders, backward_counts, failure_counts, forward_counts, lattice_edges

LABELS = "doc_id long, quality int, toxic int, text string, n int, mask string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_audit(rows: Sequence[tuple[str, int, int, int]], letters: str) -> list[tuple]:
    """The rows of ``audit_orders`` by going through all orders with every row (part, mask, good, toxic)."""
    result = []
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        found, sums = [], dict.fromkeys(letters, 0)
        for order in permutations(range(len(letters))):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1] >> f & 1]
                left = [r for r in left if not r[1] >> f & 1]
                failing = sum(r[1] >> f & 1 for r in own)
                sums[letters[f]] += len(gone)
                found.append(
                    (part, "".join(letters[g] for g in order), step, len(left), len(gone), failing - len(gone),
                     sum(r[1] == 1 << f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), letters[f])
                )
        result += [(*r[:-1], sums[r[-1]]) for r in found]
    return result


def mask_of(doc_id, text, docs):
    text = text or ""
    words = text.encode().split()
    capitals = sum("A" <= c <= "Z" for c in text)
    copied = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t in docs)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in text for c in "#$%&*|"), copied)
    return sum(f << i for i, f in enumerate(fails))


def random_docs(n):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(210))
    same = "one two three " * 80
    texts = ["", None, "Short", long, long.upper(), same, same + "#", long + " %", "A\x85B \x0b c\u2003d", long.replace("w", "W")]
    return [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(n)]


def test_against_all_orders(spark):
    docs = random_docs(120)
    labels = [(i, i % 3, i % 2) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    found = audit_filters(
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int"),
        spark.createDataFrame([(*r, "t", 1, "m") for r in labels], LABELS),
    )
    ids = [(d, t) for d, t, _ in docs]
    rows = [(lang or "", mask_of(d, t, ids), int(d in good), int(d in toxic)) for d, t, lang in docs]
    assert found.columns == COLUMNS
    assert ordered(found.collect()) == ordered(brute_audit(rows, "ABCDE"))

    sql = sql_rows(oracles.FILTER_AUDIT, documents=(["doc_id", "text", "lang"], docs), labels=(["doc_id", "quality", "toxic"], labels))
    assert ordered(sql) == ordered(found.select(*COLUMNS).collect())


def test_orders_of_three_filters(spark):
    rows = [("p", m, m % 2, m // 4) for m in (0, 1, 1, 3, 5, 7, 6, 4)] + [("q", 0, 1, 1)]
    counts = {}
    for part, mask, good, toxic in rows:
        n = counts.setdefault((part, mask), [0, 0, 0])
        counts[part, mask] = [n[0] + 1, n[1] + good, n[2] + toxic]
    table = spark.createDataFrame([(*k, *v) for k, v in counts.items()], "part string, mask int, n long, n_good long, n_toxic long")
    assert ordered(audit_orders(table, "XYZ").collect()) == ordered(brute_audit(rows, "XYZ"))


def test_path_counts():
    for n in range(1, 6):
        orders = [*permutations(range(n))]
        reach, leave = forward_counts(n), backward_counts(n)
        taken = {}
        for order in orders:
            state = 0
            for f in order:
                taken[state, f] = taken.get((state, f), 0) + 1
                state |= 1 << f
        assert reach[-1] == leave[0] == len(orders)
        assert {(e.state, e.step): e.weight for e in lattice_edges(n)} == taken


def test_odd_rows(spark):
    labels = spark.createDataFrame([(None, None, None, None, None, None), (5, 1, 1, "", 0, "")], LABELS)
    docs = odd_docs(spark)
    found = audit_filters(docs, labels)
    assert found.count() == 600 * len({(r.lang or "") for r in docs.collect()})
    whole = found.filter("step = 5").groupBy("part").agg({"kept": "max", "kept": "min"}).collect()
    assert len(whole) == 3
    # The two equal rows of id 5 do not make each other fail E; both are good and toxic.
    row = failure_counts(docs.filter("doc_id = 5"), labels).collect()
    assert [tuple(r) for r in row] == [("en", 1, 2, 2, 2)]
    assert audit_filters(empty_docs(spark), labels).collect() == []
    assert audit_filters(docs, labels.limit(0)).filter("good_lost > 0").count() == 0
