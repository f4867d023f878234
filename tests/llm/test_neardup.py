import random
import re

from hypothesis import given, settings, strategies as st

from meterlark.llm import neardup


def brute(rows, similarity=0.7, least=8):
    s = {}
    for k, t in rows:
        if k is not None and t is not None:
            w = frozenset(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
            if len(w) >= least:
                s.setdefault(k, []).append(w)
    return {(a, b) for a in s for b in s if a < b and any(len(x & y) >= similarity * len(x | y) - 1e-9 for x in s[a] for y in s[b])}


def pairs(spark, rows, **k):
    df = spark.createDataFrame(rows, "note_id long, body string")
    got = [tuple(r) for r in neardup.similar(df, "note_id", "body", **k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_tables(spark, data):
    df = spark.read.parquet(f"{data}/incident_note.parquet")
    rows = [(r["note_id"], r["body"]) for r in df.collect()]
    assert {tuple(r) for r in neardup.similar(df, "note_id", "body").collect()} == brute(rows)


def test_common_words_only(spark, monkeypatch):
    """Without rare words all links come from the coordinates of common words."""
    monkeypatch.setattr(neardup, "RARE", 1)
    rng = random.Random(5)
    rows = []
    for i in range(160):
        w = rng.sample([f"w{j}" for j in range(40)], rng.randint(8, 30)) if i % 3 or not rows else None
        if w is None:
            w = rows[rng.randrange(len(rows))][1].split()
            w = w[: len(w) - rng.randint(0, 4)] + [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert len(want) > 20 and pairs(spark, rows) == want


def test_sizes_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 2)
    base = [f"x{j}" for j in range(100)]
    rows = [(n, " ".join(base[:n])) for n in (8, 10, 11, 12, 16, 17, 49, 50, 69, 70, 71, 99, 100)]
    assert pairs(spark, rows) == brute(rows)


def test_edges(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, t), (2, t.upper()), (3, "  " + t.replace(" ", ", ") + "!"), (4, None), (5, ""), (6, " "), (7, "too few words"), (8, t + " more"), (None, t), (1, t), (9, " ".join(f"u{i}" for i in range(20000))), (10, " ".join(f"u{i}" for i in range(19000)))]
    assert pairs(spark, rows) == brute(rows)
    assert pairs(spark, []) == set()
    df = spark.createDataFrame([(1, t, "a", 1), (2, t, "b", 2)], "note_id long, body string, cid string, k long")
    assert [tuple(r) for r in neardup.similar(df, "note_id", "body").collect()] == [(1, 2)]


def test_copies_and_links(spark):
    rows = [(i, "a b c d e f g h i j") for i in range(30)] + [(100 + i, "a b c d e f g h i j k") for i in range(10)]
    df = spark.createDataFrame(rows, "note_id long, body string")
    members, links = neardup.classes_and_links(df, "note_id", "body")
    assert {tuple(r) for r in neardup.classes(df, "note_id", "body").collect()} == {(k, 0 if k < 100 else 100, 1) for k, _ in rows}
    assert [tuple(r) for r in neardup.class_links(df, "note_id", "body").collect()] == [(0, 100)]
    assert members.select("cid").distinct().count() == 2 and links.count() == 1
    assert pairs(spark, rows) == brute(rows)


def test_common_words_by_join(spark, data, monkeypatch):
    monkeypatch.setattr(neardup, "HELD", 0)
    test_tables(spark, data)
    test_common_words_only(spark, monkeypatch)


def test_long_sets_of_common_words(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 1)
    monkeypatch.setattr(neardup, "CELLS", 64)
    w = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[200:])), (3, " ".join(w[1200:])), (4, " ".join(w[:40])), (5, " ".join(w[3:40]))]
    assert pairs(spark, rows) == brute(rows)


def connected(links):
    root = {}
    for a, b in links:
        x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                root[n] = x
    return {n: min(x) for n, x in root.items()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=16))
def test_components(spark, links):
    links = [(a, b) for a, b in links if a != b]
    df = spark.createDataFrame(links, "cid_a long, cid_b long")
    assert {r["cid"]: r["root"] for r in neardup.components(df).collect()} == connected(links)


def test_groups(spark):
    chain = [f"c{i}" for i in range(60)]
    rows = [(50 - i, " ".join(chain[i : i + 20])) for i in range(0, 40, 2)] + [(100, "p q r s t u v w x y"), (101, "only one")] + [(7, "m n o p q r s t u v w x y z")]
    got = {r["note_id"]: r["group"] for r in neardup.groups(spark.createDataFrame(rows, "note_id long, body string"), "note_id", "body").collect()}
    joined = connected(brute(rows))
    assert got == {k: joined.get(k, k) for k, t in rows if k != 101} and len(set(got.values())) < 10
    assert neardup.groups(spark.createDataFrame([], "note_id long, body string"), "note_id", "body").count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), min_size=6, max_size=22), max_size=25))
def test_any(spark, sets):
    rows = [(i, " ".join(f"t{w}" for w in s)) for i, s in enumerate(sets)]
    assert pairs(spark, rows) == brute(rows)


def test_postings_meet_in_proportion(spark, monkeypatch):
    """Unrelated sets with few rare words meet less than once for four pairs, and related ones aren't lost."""
    monkeypatch.setattr(neardup, "RARE", 4)
    rng = random.Random(11)
    words, weights = [f"w{i}" for i in range(600)], [1 / (i + 20) for i in range(600)]
    sets = []
    while len(sets) < 600:
        common = set(rng.choices(words, weights, k=150))
        if len(sets) % 10 == 9:
            common = {w for w in sets[-1] if w[0] == "w"}
            common -= set(rng.sample(sorted(common), 3))
        sets.append(common | {f"r{len(sets)}x{i}" for i in range(10)})
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "note_id long, body string")
    met, plain = [], type(df).join

    def join(self, other, on=None, how=None):
        out = plain(self, other, on, how)
        if isinstance(on, (str, list)) and on in ("value", ["level", "value"]):
            met.append(out.filter("cid_a <> cid_b").count())
        return out

    monkeypatch.setattr(type(df), "join", join)
    got = {tuple(r) for r in neardup.similar(df, "note_id", "body").collect()}
    assert got == brute([(i, " ".join(s)) for i, s in enumerate(sets)]) and len(got) >= 50
    assert met and 0 < met[0] < len(sets) ** 2 / 2 / 4
