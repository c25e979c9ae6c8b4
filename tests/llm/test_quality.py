import random
import unicodedata

import pytest

from rohspark.llm import quality

D = "doc_id bigint, text string, n_words int, verdict string"
C = "lang string, word string"
COMMON = ["the", "und", "a", "l'a"]


def letter(c):
    return unicodedata.category(c)[0] in "LN"


def brute(text):
    w = text.split()
    solid = [c for c in text if not c.isspace()]
    lines = [x for x in text.split("\n") if x.strip()]

    def cut(x):
        x = x.lower()
        keep = [i for i, c in enumerate(x) if letter(c)]
        return x[keep[0] : keep[-1] + 1] if keep else ""

    n = len(w)
    return (
        n, sum(map(len, w)) / n if n else 0, sum(not letter(c) for c in solid) / len(solid) if solid else 0, len(lines),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines) if lines else 0, sum(cut(x) in COMMON for x in w) / n if n else 0,
    )


def texts():
    r = random.Random(1)
    pieces = ["the", "The,", "«und»", "l'a", "naïve", "x²", "½", "__a__", "日本語", "***", "end.", "why?", " ", " ", "é", "…", "🙂", "1,000", "\t", "\r\n", "\n", "\n\n", ""]
    return ["".join(r.choice(pieces) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randrange(60))) for _ in range(300)]


def test_against_brute_force(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, 5, "clash") for i, t in enumerate(ts)], D).repartition(3)
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("de", "a"), ("x", None)], C)
    got = {r["doc_id"]: r for r in quality.text_quality(df, common).collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        r, w = got[i], brute(t)
        assert tuple(r[c] for c in ("n_words", "mean_word_length", "symbol_ratio", "n_lines", "ended_share", "common_share")) == pytest.approx(w), t
        bad = w[0] < 12 or w[1] < 2.5 or w[1] > 15 or w[2] > 0.4 or w[4] < 0.03 or w[5] < 0.08 or w[5] > 0.7
        assert r["is_degenerate"] == bad


def test_repetition_and_verdicts():
    j = quality.Judge(frozenset(["the", "of", "in", "is", "a", "and"]))
    names = [n for n, _ in quality._STATS]

    def of(t):
        return dict(zip(names, j.measure(t)))

    r = random.Random(2)
    nouns = [a + b for a in ("bri", "sta", "mo", "ke", "lu", "pra") for b in ("dge", "tion", "del", "rnel", "nch", "per")]
    prose = "\n".join(f"The {r.choice(nouns)} of {r.choice(nouns)} {r.choice(nouns)} {r.choice(nouns)} in a {r.choice(nouns)} and {r.choice(nouns)}." for _ in range(30))
    assert of(prose)["verdict"] == "prose"
    assert of(prose + "\n" + "\n".join(["The same line is in a text of the kind."] * 40))["verdict"] == "boilerplate"
    assert of("\n".join(f"- the {r.choice(nouns)} and {r.choice(nouns)}" for _ in range(30)))["verdict"] == "list"
    assert of("\n".join(f"| {r.random():.3f} | {r.random():.3f} | {r.random():.3f} |" for _ in range(30)))["verdict"] == "table"
    assert of("")["verdict"] == of(" \n\t")["verdict"] == of("one two")["verdict"] == "near-empty"
    assert of("xqz " * 50)["verdict"] == "junk"
    x = of("a b a b a b c\nline\nline\n\nline")
    assert x["dup_line_share"] == pytest.approx(2 / 4) and x["dup_paragraph_share"] == 0.0
    assert x["top_2gram_chars"] == pytest.approx(6 / 19)


def test_edge_tables(spark):
    common = spark.createDataFrame([("en", "the")], C)
    rows = [(None, "the", 1, ""), (1, None, 1, ""), (2, "", 1, ""), (3, "The. " * 400_000, 1, ""), (3, "x", 1, ""), (3, "x", 1, ""), (4, "a" * 1_000_000, 1, "")]
    got = quality.text_quality(spark.createDataFrame(rows, D), common).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (3, None)}
    assert by[1]["n_words"] is None and by[1]["verdict"] is None and by[1]["is_degenerate"] is None
    assert by[2]["n_words"] == 0 and by[2]["verdict"] == "near-empty" and by[4]["mean_word_length"] == 1_000_000
    assert sorted(r["n_words"] for r in got if r["doc_id"] == 3) == [1, 1, 400_000]
    assert quality.text_quality(spark.createDataFrame([], D), common).count() == 0
    assert quality.text_quality(spark.createDataFrame(rows[:1], D), spark.createDataFrame([], C)).first()["common_share"] == 0.0
    with pytest.raises(ValueError):
        quality.text_quality(spark.createDataFrame([], D), spark.createDataFrame([("", "a"), ("", "b")], C), max_common=1)


def labelled(n=60, seed=4):
    """(label, text): made texts of six kinds, with strays of the other kinds mixed in."""
    r = random.Random(seed)
    small = ["the", "of", "in", "is", "a", "and"]
    nouns = [f"{a}{b}{c}" for a in ("ker", "mol", "tis", "va", "bru", "ol") for b in ("in", "eth", "ar") for c in ("t", "del", "mos", "ra")]

    def sentence():
        return " ".join(r.choice(small) if r.random() < 0.35 else r.choice(nouns) for _ in range(r.randrange(7, 16))).capitalize() + r.choice([".", ".", "!", "?"])

    def prose():
        return "\n\n".join(" ".join(sentence() for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(2, 6)))

    def item():
        return r.choice(["- ", "* ", f"{r.randrange(1, 30)}. ", "• "]) + " ".join(r.choice(nouns) for _ in range(r.randrange(1, 6)))

    def row():
        sep = r.choice([" | ", "\t", ","])
        return sep.join(r.choice([r.choice(nouns), str(r.randrange(999))]) for _ in range(6))

    def mixed(part, stray):
        return "\n".join(stray() if r.random() < 0.12 else part() for _ in range(r.randrange(8, 25)))

    def junk():
        return "\n".join("".join(r.choice("#$%&@{}<>=~ab1 ") for _ in range(40)) for _ in range(8))

    def boilerplate():
        same = [sentence() for _ in range(2)]
        return "\n".join(r.choice(same) if r.random() < 0.8 else sentence() for _ in range(20))

    kinds = {"prose": prose, "list": lambda: mixed(item, sentence), "table": lambda: mixed(row, sentence), "junk": junk, "boilerplate": boilerplate, "near-empty": lambda: " ".join(r.choice(nouns) for _ in range(r.randrange(0, 11)))}
    return [(k, f()) for k, f in kinds.items() for _ in range(n)]


def test_verdicts_on_labelled_texts():
    j = quality.Judge(frozenset(["the", "of", "in", "is", "a", "and"]))
    got = [(k, j.measure(t)[-1]) for k, t in labelled()]
    for kind in {k for k, _ in got}:
        said = sum(v == kind for _, v in got)
        right = sum(k == v == kind for k, v in got)
        assert right / said >= 0.95 and right / sum(k == kind for k, _ in got) >= 0.9, (kind, said, right)
