import datetime as dt
import random

from meterlark.llm import tickets

SCHEMA = "message_id long, ticket_id long, author_role string, reply_to long, body string, sent_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def turns(spark, rows):
    return sorted((r["ticket_id"], r["turn_no"], r["message_id"]) for r in tickets.turns(spark.createDataFrame(rows, SCHEMA)).collect())


def brute(rows):
    names = {"customer": "c", "cust": "c", "user": "c", "client": "c", "agent": "a", "support": "a", "staff": "a", "assistant": "a", "system": "s", "bot": "s", "auto": "s"}
    by, first = {}, {}
    for r in sorted(set(rows), key=lambda r: r[0]):
        if r[1] is not None:
            first[r[0]] = by.setdefault(r[1], {}).setdefault(r[1:], r[0])
    out = []
    for ticket, own in by.items():
        ids = {i for i in (r[0] for r in rows if r[1] == ticket)}
        m = {i: (names.get((k[1] or "").strip().lower()), k[2], k[3], k[4]) for k, i in own.items()}
        if any(r is None or s is None or (p is not None and p not in ids) for r, p, _, s in m.values()):
            continue
        depth, ok = {}, True
        for i in m:
            seen, x = [], i
            while m[x][1] is not None and m[first[m[x][1]]][3] == m[x][3]:
                seen.append(x)
                x = first[m[x][1]]
                if x in seen:
                    ok = False
                    break
            depth[i] = len(seen)
            seen, x = {i}, i
            while ok and m[x][1] is not None:  # a circle, across instants too
                x = first[m[x][1]]
                ok = x not in seen
                seen.add(x)
        if not ok:
            continue
        kept = sorted((i for i in m if m[i][2] and m[i][2].strip()), key=lambda i: (m[i][3], depth[i], i))
        spoken = [m[i][0] for i in kept if m[i][0] != "s"]
        if spoken and spoken[0] == "c" and spoken[-1] == "a":
            out += [(ticket, n, i) for n, i in enumerate(kept, 1)]
    return sorted(out)


def test_tables(spark, data):
    df = spark.read.parquet(f"{data}/support_message.parquet")
    rows = [tuple(r) for r in df.select("message_id", "ticket_id", "author_role", "reply_to", "body", "sent_at").collect()]
    assert sorted((r[0], r[1], r[2]) for r in tickets.turns(df).select("ticket_id", "turn_no", "message_id").collect()) == brute(rows)


def test_random(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        ticket = rng.randrange(120)
        others = [r[0] for r in rows if r[1] == ticket]
        rows.append((i, ticket, rng.choice(["customer", " Agent ", "bot", "USER", "staff", "cust"] + ["?"] * (i % 40 == 0)), rng.choice(others) if others and rng.random() < 0.6 else None, rng.choice(["x", "y", " ", None, "z"]), at(rng.randrange(4))))
    want = brute(rows)
    assert want and turns(spark, rows) == want


def test_rules(spark, monkeypatch):
    c, a, s = "customer", "agent", "system"
    rows = [
        (1, 1, c, None, "q", at(0)), (2, 1, a, 1, "r", at(0)), (3, 1, s, None, "closed", at(1)),  # a reply of the same instant
        (12, 2, a, 13, "r", at(0)), (13, 2, c, None, "q", at(0)),  # the reply has the lower id
        (21, 3, c, None, "q", None), (22, 3, a, 21, "r", at(1)),  # no time
        (31, 4, c, None, "q", at(0)), (32, 4, "boss", 31, "r", at(1)),  # no role
        (41, 5, c, None, "q", at(0)), (42, 5, a, 1, "r", at(1)),  # a reply to another ticket
        (51, 6, c, None, "q", at(0)), (52, 6, a, 51, " \n", at(1)),  # unanswered, as the answer is blank
        (61, 7, c, 62, "q", at(0)), (62, 7, a, 61, "r", at(0)),  # a circle
        (71, 8, c, 71, "q", at(0)), (72, 8, a, 71, "r", at(1)),  # a reply to itself
        (81, 9, c, None, "q", at(0)), (82, 9, c, None, "q", at(0)), (83, 9, "Supp", 82, "r", at(1)), (83, 9, "Supp", 82, "r", at(1)),  # repeated rows
        (91, 10, s, None, "opened", at(0)), (92, 10, c, None, "q", at(2)), (93, 10, "asst.", 92, "r", at(3000)),
        (95, None, c, None, "q", at(0)), (96, 11, c, None, None, at(0)),
        (101, 12, c, 102, "q", at(0)), (102, 12, a, None, "r", at(5)),  # replies to what comes later
        (111, 13, c, 112, "q", at(0)), (112, 13, a, 111, "r", at(5)), (113, 13, a, 112, "r", at(6)),  # a circle across instants
    ]
    want = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 13), (2, 2, 12), (9, 1, 81), (9, 2, 83), (10, 1, 91), (10, 2, 92), (10, 3, 93), (12, 1, 101), (12, 2, 102)]
    assert turns(spark, rows) == want
    monkeypatch.setattr(tickets, "PIECE", 1)  # all groups go by doubling
    assert turns(spark, rows) == want
    assert turns(spark, []) == []
    df = spark.createDataFrame([(*r, 1, "x") for r in rows[:3]], SCHEMA + ", layer int, role string")
    assert tickets.turns(df).count() == 3


def test_roles_in_turn(spark):
    day = 24 * 60
    rows = [(1, 1, "user", None, "q", at(0)), (2, 1, "bot", None, "b", at(1)), (3, 1, "user", None, "q", at(2)), (4, 1, "agent", 3, "r", at(2)), (5, 1, "bot", None, "b", at(day)), (6, 1, "staff", None, "r", at(day + 1)), (7, 1, "user", None, "q", at(3 * day)), (8, 1, "agent", None, "r", at(3 * day))]
    got = tickets.turns(spark.createDataFrame(rows, SCHEMA)).orderBy("turn_no").collect()
    assert [r["repeats"] for r in got] == [False, False, True, False, False, True, False, False]


def test_any_graph(spark):
    rng = random.Random(23)
    rows = []
    for ticket in range(150):
        n = rng.randint(2, 6)
        for i in range(n):
            k = ticket * 10 + i
            rows.append((k, ticket, "user" if i == 0 else "agent", ticket * 10 + rng.randrange(n) if rng.random() < 0.5 else None, "x", at(rng.randrange(3) if i else 0)))
    want = brute(rows)
    assert want and turns(spark, rows) == want
