import random
import re
import unicodedata

from rohspark.llm import leaks

D = "doc_id bigint, text string, item_id string, passage string"
I = "item_id bigint, passage string, answer string, text string, doc_id int"


def plain(text):
    t = unicodedata.normalize("NFKC", text).lower()
    return re.findall(r"[^\W_]+", t)


def brute(docs, items, n):
    out = set()
    for d, text, *_ in docs:
        if d is None or text is None:
            continue
        w = plain(text)
        for i, p, *_ in items:
            q = plain(p or "")
            if i is None or not q:
                continue
            m = min(n, len(q))
            grams = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)}
            if any(tuple(w[k : k + m]) in grams for k in range(len(w) - m + 1)):
                out.add((d, i))
    return out


def world(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "Ähre", "naïve", "ﬁne", "x1", "don’t", "Ⅷ", "日本", "İz"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 12))), "yes", "", 0) for k in range(25)]
    docs = []
    for d in range(120):
        t = [r.choice(vocabulary) for _ in range(r.randrange(0, 30))]
        if r.random() < 0.5:
            t[5:5] = r.choice(items)[1].upper().split(" ")[r.randrange(2) :]
        docs.append((d, r.choice([" ", "\n", "_-", " , "]).join(t), "clash", "clash"))
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = world(seed)
        docs += [(None, items[0][1], "", ""), (900, None, "", ""), (901, "", "", ""), (902, "?! _", "", ""), docs[0]]
        items += [(None, "a b", "", "", 0), (77, None, "", "", 0), (78, "", "", "", 0), (79, " ?", "", "", 0), items[0]]
        got = leaks.find_leaks(spark.createDataFrame(docs, D).repartition(3), spark.createDataFrame(items, I), n=5)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute(docs, items, 5)
        blocks = leaks.find_leaks(spark.createDataFrame(docs[:-1], D), spark.createDataFrame(items, I), n=5, max_patterns=10)
        once = leaks.find_leaks(spark.createDataFrame(docs[:-1], D), spark.createDataFrame(items, I), n=5)
        assert sorted(tuple(r) for r in blocks.collect()) == sorted(tuple(r) for r in once.collect())


def test_offsets_lead_back_to_the_original(spark):
    text = "x ﬁne_été  ½ Ⅷ und STRASSE! y"
    spans = leaks.word_spans(text)
    assert [plain(text[a:b]) for a, b in spans] == [[w] for w in leaks.words(text)] or len(spans) == len(leaks.words(text))
    got = leaks.find_leaks(spark.createDataFrame([(1, text, "", "")], D), spark.createDataFrame([(5, "fine été", "", "", 0)], I)).first()
    assert text[got["leak_start"] : got["leak_end"]] == "ﬁne_été" and got["n_matches"] == 1
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice("aB1 _-\ńéﬁİß½Ⅷ가각ㄱ日Σς") for _ in range(30))
        assert len(leaks.word_spans(t)) == len(leaks.words(t))


def test_answers_and_bounds(spark):
    docs = spark.createDataFrame([(1, "who is it it is me", "", "")], D)
    items = spark.createDataFrame([(5, "Who is it?", "It is me", "", 0)], I)
    assert leaks.find_leaks(docs, items, answer="answer").count() == 1
    assert leaks.find_leaks(docs, spark.createDataFrame([(5, "Who is it?", "It is you", "", 0)], I), answer="answer").count() == 0
    try:
        leaks.find_leaks(docs, items, max_item_chars=3)
        raise AssertionError
    except ValueError:
        pass


def test_long_text_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    text = "lorem ipsum " * 300_000 + passage[30:120] + " dolor" * 100_000
    docs, items = spark.createDataFrame([(1, text, "", "")], D), spark.createDataFrame([(5, passage, "", "", 0)], I)
    got = leaks.find_leaks(docs, items).first()
    assert got["item_id"] == 5 and text[got["leak_start"] : got["leak_end"]].startswith("w")
    assert leaks.find_leaks(spark.createDataFrame([], D), items).count() == 0
    assert leaks.find_leaks(docs, spark.createDataFrame([], I)).count() == 0


def test_a_long_run_of_marks_takes_no_longer():
    import time

    text = "a" + "\u0301" * 60_000 + " b " + "é" * 10
    began = time.perf_counter()
    assert len(leaks.word_spans(text)) == len(leaks.words(text))
    assert time.perf_counter() - began < 5
