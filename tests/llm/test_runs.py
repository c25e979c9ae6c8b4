import random

import pytest

from rohspark.llm import runs

S = "who int, line string, o int, p bigint, s int, extent string"


def brute(events, step, flank, least):
    """Runs by the definition: stretches, bridged stretches of one event, and chains of them."""
    out = []
    by = {}
    for who, line, o, p, s, _ in events:
        if None in (who, line, o, p, s) or s < 0:
            continue
        by.setdefault((who, line), []).append((o, p, s))
    for key, seq in by.items():
        seq.sort()
        st = []
        for i, (o, p, s) in enumerate(seq):
            wide = i > 0 and p - seq[i - 1][1] > step
            if i and not wide and s == st[-1]["s"]:
                st[-1]["n"] += 1
                st[-1]["b"] = p
            else:
                st.append({"s": s, "n": 1, "a": p, "b": p, "wide": wide or i == 0})
        bridged = [0 < i < len(st) - 1 and x["n"] == 1 and not x["wide"] and not st[i + 1]["wide"] and st[i - 1]["s"] == st[i + 1]["s"] and min(st[i - 1]["n"], st[i + 1]["n"]) >= flank for i, x in enumerate(st)]
        i = 0
        while i < len(st):
            j, n, nb = i, st[i]["n"], 0
            while j + 2 < len(st) and bridged[j + 1]:
                n, nb, j = n + st[j + 2]["n"], nb + 1, j + 2
            if n >= least:
                out.append((*key, st[i]["s"], n, nb, st[i]["a"], st[j]["b"], st[j]["b"] - st[i]["a"] + 1))
            i = j + 1
    return sorted(out)


def sequence(r, who, n, dull):
    out, p, s = [], 0, 0
    for o in range(n):
        if r.random() < 0.02:
            continue
        p += r.choice([1, 2, 0, 3, 60 if r.random() < 0.1 else 1])
        s = s if r.random() < dull else r.randrange(3)
        out.append((who, "a", o, p, 1 - s if r.random() < 0.08 else None if r.random() < 0.03 else s, "clash"))
    return out


@pytest.mark.parametrize("chunk", [2, 3, 5, 16, 10_000])
def test_against_definition_for_any_chunk(spark, chunk):
    r = random.Random(chunk)
    events = [e for who in range(25) for e in sequence(r, who, 80, r.choice([0.5, 0.9, 0.97, 1.0]))]
    events += [e for e in events if r.random() < 0.05]
    r.shuffle(events)
    df = spark.createDataFrame(events, S)
    for least in (1, 6):
        got = runs.collapse_runs(df, ["who", "line"], "o", "p", "s", max_step=50, min_flank=4, min_events=least, chunk=chunk)
        assert sorted(tuple(x) for x in got.collect()) == brute(events, 50, 4, least)


def test_cases(spark):
    def go(rows, **k):
        return sorted(tuple(x) for x in runs.collapse_runs(spark.createDataFrame(rows, S), ["who", "line"], "o", "p", "s", max_step=10, **k).collect())

    assert go([]) == []
    assert go([(None, "a", 0, 0, 0, ""), (1, None, 0, 0, 0, ""), (1, "a", None, 0, 0, ""), (1, "a", 0, None, 0, ""), (1, "a", 0, 0, None, ""), (1, "a", 0, 0, -9, "")]) == []
    tie = [(1, "a", 0, 5, 0, ""), (1, "a", 0, 3, 0, ""), (1, "a", 0, 3, 0, "")]
    assert go(tie) == [(1, "a", 0, 3, 0, 3, 5, 3)]
    chain = [(1, "", i, i, int(i in (5, 11)), "") for i in range(17)]
    assert go(chain) == [(1, "", 0, 15, 2, 0, 16, 17)] == go(chain, chunk=4)
    copies = [(1, "", i, i, 0, "") for i in (1, 2)] * 40 + [(1, "", 3, 3, 1, "")] + [(1, "", 4, 4, 0, "")] * 9 + [(1, "", 5, 5, 1, "")] * 2
    assert go(copies) == [(1, "", 0, 89, 1, 1, 4, 4), (1, "", 1, 2, 0, 5, 5, 1)] == go(copies, chunk=2)
    long = [(1, "a", i, i, 7, "") for i in range(30_000)]
    assert go(long) == [(1, "a", 7, 30_000, 0, 0, 29_999, 30_000)]
    with pytest.raises(Exception, match="symbols"):
        go([(1, "a", 0, 0, runs.MAX_SYMBOL + 1, "")])


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_the_last_version_counts(spark, chunk, monkeypatch):
    r = random.Random(chunk)
    events = [(*e[:5], v) for who in range(12) for e in sequence(r, who, 60, 0.9) for v in [r.randrange(3)]]
    older = [(who, line, o, 7, 2, v - r.randrange(1, 3)) for who, line, o, _, _, v in events if r.random() < 0.4]
    gone = [(*events[k][:3], None, None, 9) for k in range(0, len(events), 11)]  # later versions without a symbol
    rows = [*events, *older, *older[:50], *gone, (None, "a", 1, 1, 1, 1), (1, "a", None, 1, 1, 1)] + [events[1]] * 500
    r.shuffle(rows)
    last = {}
    for e in [*events, *gone]:
        if e[:3] not in last or e[5] > last[e[:3]][5]:
            last[e[:3]] = e
    df = spark.createDataFrame(rows, "who int, line string, o int, p bigint, s int, version bigint").repartition(3)
    for held in (40, 500_000):
        monkeypatch.setattr(runs, "_HELD", held)
        got = runs.collapse_runs(df, ["who", "line"], "o", "p", "s", max_step=50, min_flank=4, chunk=chunk, version="version")
        assert sorted(tuple(x) for x in got.collect()) == brute(list(last.values()), 50, 4, 1)
    assert runs.collapse_runs(df.limit(0), ["who", "line"], "o", "p", "s", max_step=50, version="version").count() == 0
