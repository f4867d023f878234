import random

from meterlark.llm import leaks


def brute(docs, items, least):
    grams = {}
    for i, t in items:
        w = leaks.words_of(t or "")
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.words_of(t or "")
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


def found(spark, docs, items, least):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return leaks.leaks(d, "doc_id", "text", i, "item_id", "text", least)


def test_random(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.randint(2, 14)))) for i in range(30)]
    docs = [(d, rng.choice([", ", " ", "\n- "]).join(word() for _ in range(rng.randint(0, 40)))) for d in range(120)]
    for least in (3, 5):
        got = found(spark, docs, items, least).collect()
        assert {(r[0], r[1]) for r in got} == brute(docs, items, least) and len(got) == len({(r[0], r[1]) for r in got})


def test_tables(spark, data):
    d, i = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_item.parquet")
    got = {(r[0], r[1]) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in i.collect()], 12)


def test_edges(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, passage.upper().replace(" ", " ... ")), (2, None), (3, ""), (4, passage[:-7]), (5, "x " + passage + " y"), (5, "x " + passage), (None, passage), (6, "é " * 50 + passage + " 汉字" * 9), (7, passage.split(" ", 6)[-1]), (8, " ".join(passage.split()[:6]))]
    items = [(1, passage), (2, passage), (3, None), (4, ""), (5, "too short"), (6, " ".join(passage.split()[:11]))]
    want = {(d, i) for d in (1, 5, 6) for i in (1, 2)}
    assert {(r[0], r[1]) for r in found(spark, docs, items, 12).collect()} == want
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 40)  # several blocks of items
    assert {(r[0], r[1]) for r in found(spark, docs, items, 12).collect()} == want
    assert found(spark, docs[:0], items, 12).count() == 0 and found(spark, docs, items[:0], 12).count() == 0
    d = spark.createDataFrame([(1, passage, 2)], "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(9, passage, "w")], "item_id long, text string, words string")
    assert [tuple(r) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()] == [(1, 9, 12)]


def test_longest_run(spark):
    docs = [(1, "a b c d e x a b c d e f g"), (2, "a b c d e f g h " * 3)]
    assert sorted(map(tuple, found(spark, docs, [(1, "z a b c d e f g")], 5).collect())) == [(1, 1, 7), (2, 1, 7)]


def test_proximity(spark):
    item = "red green blue cyan gold grey"
    docs = [(1, "grey cyan x blue red y gold green"), (2, "red green blue"), (3, "red " * 9), (4, "red green " + "x " * 40 + "blue cyan gold grey"), (5, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r[0]: r[2] for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text", 6, near=(5 / 6, 8)).collect()}
    assert got == {1: 6, 5: 6}


def test_proximity_holds_exact_matches(spark, data):
    d, i = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_item.parquet")
    exact = {(r[0], r[1]) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert exact <= {(r[0], r[1]) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text", near=(1.0, 11)).collect()}


def brute_near(docs, items, least, share, slack):
    out, span = {}, max(slack, least)
    for d, t in docs:
        w = leaks.words_of(t)
        spans = [set(w[k : k + span]) for k in range(max(1, len(w) - span + 1))]
        for i, x in items:
            x = leaks.words_of(x)
            for k in range(len(x) - least + 1):
                window = set(x[k : k + least])
                n = max(len(window & s) for s in spans)
                if n >= share * len(window):
                    out[d, i] = max(out.get((d, i), 0), n)
    return out


def near(spark, docs, items, least, share, slack):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r[0], r[1]): r[2] for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text", least, near=(share, slack)).collect()}


def test_proximity_without_the_rarest_word(spark):
    item = "the 4711 red green blue cyan gold grey pink teal plum lime"
    docs = [(1, item.replace("4711", "4712")), (2, item.replace("4711", "x").replace("teal", "y")), (3, item.replace("4711", "x").replace("teal", "y").replace("plum", "z")), (4, "the red green blue cyan gold grey " * 3), (5, "teal 4711 teal 4711")]
    assert near(spark, docs, [(1, item)], 12, 5 / 6, 18) == {(1, 1): 11, (2, 1): 10}


def test_proximity_random(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda letters: rng.choice(letters)
    items = [(i % 25, " ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 30)))) for i in range(30)]  # some keys have two texts
    docs = [(d, " ".join(word("abcdefghijklmnopqrst") for _ in range(rng.randint(0, 40)))) for d in range(80)]
    for least, share, slack in ((3, 0.6, 4), (6, 5 / 6, 8), (5, 0.8, 5), (4, 1.0, 3)):
        want = brute_near(docs, items, least, share, slack)
        assert want and near(spark, docs, items, least, share, slack) == want
    monkeypatch.setattr(leaks, "STRETCH", 8)  # several stretches of an item
    monkeypatch.setattr(leaks, "PLACES", 5)
    assert near(spark, docs, items, 6, 5 / 6, 8) == brute_near(docs, items, 6, 5 / 6, 8)


def test_proximity_of_many_words(spark):
    words = [f"w{k}" for k in range(200)]
    docs = [(1, " ".join(words[150:20:-1])), (2, " ".join(w for k, w in enumerate(words) if k % 2))]
    assert near(spark, docs, [(1, " ".join(words))], 100, 0.9, 110) == brute_near(docs, [(1, " ".join(words))], 100, 0.9, 110) == {(1, 1): 100}


def test_letters_with_two_lower_forms(spark):
    item = "Λόγος και ΛΟΓΟΣ στην İstanbul Straße ÉTÉ naïve ΟΔΥΣΣΕΥΣ 𝐀𝐁 １２ x y"
    odd = " ꙮ ﷽ "  # takes the text out of the usual characters
    docs = [(1, item), (2, item.upper().replace("STRASSE", "Straße")), (3, item.lower()), (4, item + odd), (5, odd + item.lower()), (6, item.replace("ΛΟΓΟΣ", "λογος")), (7, "Λόγος και")]
    assert {r[0] for r in found(spark, docs, [(1, item)], 12).collect()} == {1, 2, 3, 4, 5, 6}


def test_one_index_for_all_blocks(spark, data, monkeypatch):
    d, i = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_item.parquet")
    run = lambda: {tuple(r) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    want = run()
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 30_000)
    assert run() == want
    monkeypatch.setattr(leaks, "INDEX_WORDS", 1)
    assert run() == want
