import hashlib
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from tests.llm.helpers import ordered, sql_rows

from turnwise.llm import oracles
from turnwise.llm.conversations import conversation_digests, damaged, faults_of, lightest, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, place long, edit string, fault string, piece long"
EMPTY = hashlib.sha256(b"").hexdigest()
EDITS = ["conv_id", "step", "turn", "role", "text", "edit", "fault", "role_before"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "e", "f", 1) for r in rows], SCHEMA)


def plainly_damaged(rows):
    result = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        result += [(conv_id, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return result


def cheapest(rows, faults):
    """(cost, audit, lines) by trying every edit with whole audits, two inserts in a row at most."""

    @cache
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        for role, after in (("user", "u"), ("assistant", "a")):
            legal = after == "u" if state in ("", "s", "a") else after == "a"
            if legal and inserts < 2:
                cost, audit, lines = best(i, after, inserts + 1)
                found.append((cost + 3, "I" + audit, (f"{role}:", *lines)))
            if legal and i < len(rows) and faults[i] not in ("blank", "duplicate"):
                cost, audit, lines = best(i + 1, after, 0)
                found.append((cost + 3 + 3 * (faults[i] == "truncated"), "R" + audit, (f"{role}:{rows[i][1]}", *lines)))
        if i < len(rows):
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, lines))
            initial = rows[i][0][:1]
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if initial and initial in legal and faults[i] not in ("blank", "duplicate"):
                cost, audit, lines = best(i + 1, initial, 0)
                found.append((cost + 3 * (faults[i] == "truncated"), "K" + audit, (":".join(rows[i]), *lines)))
        return min(found, default=(10**9, "", ()), key=lambda f: f[:2])

    return best(0, "", 0)


def plain_digest(conv_id, rows):
    own = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    pairs = [r[2:] for r in own]
    faults, seen = [], set()
    for role, text in pairs:
        if not re.search(r"[^\x20\x09-\x0d]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if re.search(r"[.!?][\x20\x09-\x0d]*\Z", text) else "truncated")
        seen.add((role, text))
    turns = {r[1] for r in own if r[1] is not None}
    cost, audit, lines = cheapest(tuple(pairs), tuple(faults))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made_rows(n_conversations, seed=1, most=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "USER", "u"]
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", None, "A line\nand one. ", "é…", "x." * 30]
    rows = []
    for conv_id in [None, *range(n_conversations)]:
        turn = 0
        for _ in range(rng.randrange(1, most)):
            turn += rng.choice([1, 1, 1, 2, 0])
            rows.append((conv_id, rng.choice([turn] * 9 + [None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_against_all_edits(spark):
    rows = made_rows(150)
    hurt = plainly_damaged(rows)
    expected = [plain_digest(c, hurt) for c in [None, *range(150)]]
    found = conversation_digests(damaged(table(spark, rows)), table(spark, rows))
    assert ordered(found.collect()) == ordered(expected)
    assert all({*"KRDI"} <= set("".join(r[7] for r in expected)) for _ in (0,)) and EMPTY in {r[8] for r in expected}
    names = ["conv_id", "turn", "role", "text"]
    sql = f"SELECT {', '.join(found.columns)} FROM ({oracles.CONVERSATIONS})"
    typed = f"(SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM given)"
    ours = sql_rows(sql.replace("FROM conversations", f"FROM {typed}"), given=(names, rows))
    assert ordered(ours) == ordered(expected)


def test_pieces_give_the_same_rows(spark):
    rows = [(0, *r[1:]) for r in made_rows(60, seed=2)] + made_rows(5, seed=3)
    rows = [(c, t and t + 10 * i if c == 0 else t, r, x and f"{x}{i % 7}." if c == 0 and i % 3 else x) for i, (c, t, r, x) in enumerate(rows)]
    df = table(spark, plainly_damaged(rows))
    whole = repair_conversations(df)
    pieces = repair_conversations(df, hot_rows=4, piece_rows=3)

    def in_order(result):
        found = {}
        for r in sorted(result.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place, r.step)):
            found.setdefault(r.conv_id, []).append(tuple(r[c] for c in EDITS if c != "step"))
        return found

    assert in_order(pieces) == in_order(whole)
    digests = [conversation_digests(df, df, hot_rows=n, piece_rows=3).collect() for n in (10**6, 4)]
    assert ordered(digests[0]) == ordered(digests[1])
    by_chars = conversation_digests(df, df, hot_chars=50, piece_rows=5).collect()
    assert ordered(by_chars) == ordered(digests[0])


def test_rows_without_deleted_ones_are_well_formed(spark):
    found = repair_conversations(table(spark, made_rows(80, seed=4))).filter("edit <> 'D'").orderBy("conv_id", "place", "step").collect()
    initials = {}
    for r in found:
        initials[r.conv_id] = initials.get(r.conv_id, "") + r.role[:1]
    assert initials and all(re.fullmatch("(s?(ua)+)?", i) for i in initials.values())


def test_items_are_superior_and_final():
    rng = random.Random(6)
    for _ in range(200):
        rows = [(rng.choice("suat "), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(0, 12))]
        found = lightest(rows)
        cost, audit, _ = cheapest(tuple((r, "x") for r, _ in rows), tuple(f for _, f in rows))
        assert (found.cost(0), "".join(e for e, _ in found.path(0))) == (cost, audit)


def test_a_long_conversation_in_linear_time():
    rows = [("u" if i % 2 == 0 else "a", "") for i in range(20_000)]
    assert lightest(rows).cost(0) == 0
    assert faults_of([("user", f"{i}.") for i in range(50_000)]).count("") == 50_000


def test_odd_rows(spark):
    nothing = table(spark, [])
    one = table(spark, [(1, None, None, None), (1, None, None, None), (None, 3, "user", "x" * 200_000 + "."), (2, 5, "assistant", "Done.")])
    assert conversation_digests(nothing, nothing).collect() == []
    assert repair_conversations(nothing).collect() == []
    absent = conversation_digests(nothing, one).collect()
    assert ordered(absent) == ordered((c, 0, 0, 0, 0, 0, 0, "", EMPTY) for c in (None, 1, 2))
    found = {r.conv_id: tuple(r)[1:8] for r in conversation_digests(one, one).collect()}
    assert found == {1: (0, 2, 0, 0, 1, 8, "DD"), None: (0, 0, 0, 0, 0, 3, "KI"), 2: (0, 0, 0, 0, 0, 3, "IK")}
    assert repair_conversations(one).filter(F.col("edit") == "I").count() == 2
