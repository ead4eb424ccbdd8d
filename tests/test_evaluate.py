"""Scores against loops over all pairs."""

import random

import pytest

from veilspark.operators import evaluate

E = "doc_id long, ord long, start long, end long, value string, label string"
SAME = evaluate.ALIASES


def sample(seed):
    rng = random.Random(seed)

    def some(n):
        out, ord_ = [], 0
        for d in range(4):
            for _ in range(rng.randrange(0, n)):
                s = rng.randrange(0, 1500) if rng.random() < 0.5 else rng.randrange(0, 60)
                e = s + rng.choice((1, 3, 10, 700))
                value = rng.choice(("ab", "abc", " bc ", "x", ""))
                out.append((d, ord_, *((None, None) if rng.random() < 0.15 else (s, e)), value, rng.choice(("PERSON", "PERSON_NAME", "PHONE_NUMBER", "EMAIL"))))
                ord_ += 1
        return out

    return some(25), some(30)


def hits(gold, found, exact, by_label):
    out = []
    for g in gold:
        for f in found:
            if g[0] != f[0] or by_label and SAME.get(g[5], g[5]) != SAME.get(f[5], f[5]):
                continue
            if g[2] is not None and f[2] is not None:
                ok = g[2:4] == f[2:4] if exact else g[2] < f[3] and f[2] < g[3]
            elif g[2] is None and f[2] is None:
                a, b = g[4].strip(), f[4].strip()
                ok = a == b if exact else a and b and (a in b or b in a)
            else:
                ok = False
            if ok:
                out.append((g[0], g[1], f[1]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("by_label", [False, True])
def test_scores(spark, seed, exact, by_label):
    gold, found = sample(seed)
    g, f = spark.createDataFrame(gold, E), spark.createDataFrame(found, E)
    pairs = hits(gold, found, exact, by_label)
    assert sorted(map(tuple, evaluate.pairs(g, f, exact, by_label).collect())) == pairs
    want = {}
    for d in {r[0] for r in gold + found}:
        e_used, d_used, tp = set(), set(), 0
        mine = [(e, x) for k, e, x in pairs if k == d]
        for e, x in mine:
            if e not in e_used and x not in d_used:
                tp, e_used, d_used = tp + 1, e_used | {e}, d_used | {x}
        e_hit, d_hit = {e for e, _ in mine}, {x for _, x in mine}
        ne, nd = sum(r[0] == d for r in gold), sum(r[0] == d for r in found)
        want[d] = (tp, nd - (tp if exact else len(d_hit)), ne - (tp if exact else len(e_hit)))
    got = {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.score(g, f, exact, by_label).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match(spark, seed):
    gold, found = ([r for r in t if r[2] is not None] for t in sample(seed))
    want = []
    for d in range(4):
        options = []
        for g in gold:
            for f in found:
                if g[0] == f[0] == d and SAME.get(g[5], g[5]) == SAME.get(f[5], f[5]) and g[2] < f[3] and f[2] < g[3]:
                    o = min(g[3], f[3]) - max(g[2], f[2])
                    options.append((o, o / (max(g[3], f[3]) - min(g[2], f[2])), g[1], f[1]))
        used = set()
        for _, _, e, x in sorted(options, reverse=True):
            if ("e", e) not in used and ("d", x) not in used:
                used |= {("e", e), ("d", x)}
                want.append((d, e, x))
    got = evaluate.greedy_match(spark.createDataFrame(gold, E), spark.createDataFrame(found, E)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_expected_positions(spark):
    articles = [(1, "aaaa b aa \\E .*"), (2, "xyx"), (3, "é漢字é")]
    gold = [(1, 0, "aa", "L"), (1, 1, "aa", "L"), (1, 2, "aa", "L"), (1, 3, "aa", "L"), (1, 4, "aa", "L"), (1, 5, ".*", "L"), (1, 6, "\\E", "L"), (1, 7, "", "L"), (2, 0, "x", "L"), (2, 1, "q", "L"), (2, 2, "x", "L"), (3, 0, "é", "L"), (3, 1, "字é", "L"), (9, 0, "x", "L")]
    got = evaluate.expected_positions(spark.createDataFrame(gold, "doc_id long, ord long, value string, label string"), spark.createDataFrame(articles, "doc_id long, text string"))
    text = dict(articles)
    want, asked = {}, {}
    for d, o, v, _ in gold:
        places = [i for i in range(len(text.get(d, "")) - len(v) + 1) if v and text[d].startswith(v, i)]
        n = asked[d, v] = asked.get((d, v), -1) + 1
        s = None if not places else places[n] if n < len(places) else places[0]
        want[d, o] = (s, None if s is None else s + len(v))
    assert {(r["doc_id"], r["ord"]): (r["start"], r["end"]) for r in got.collect()} == want


def test_located_and_characters(spark):
    articles = spark.createDataFrame([(1, "ab cd ab cd")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 0, "cd", "X"), (1, 1, "ab", "Y"), (1, 2, "ab", "Y"), (1, 3, "zz", "Y")], "doc_id long, ord long, value string, label string")
    got = evaluate.located(gold, articles).collect()
    assert [(r["ord"], r["start"]) for r in sorted(got, key=lambda r: r["ord"])] == [(0, 3), (1, 6), (2, 0), (3, None)]
    found = spark.createDataFrame([(1, 0, 4, 7, "x", "X"), (1, 1, 0, 1, "x", "Z")], E)
    kinds = {r["status"]: r["n"] for r in evaluate.char_confusion(evaluate.located(gold, articles).where("start is not null"), found).collect()}
    assert kinds == {"correct": 1, "wrong_label": 2, "missed": 3, "false_positive": 1}


def test_reports(spark):
    runs = spark.createDataFrame([("none", 0, 8, 2, 2), ("all", 1, 9, 1, 1)], "config string, ord int, tp long, fp long, fn long")
    got = {r["config"]: (round(r["precision"], 3), round(r["f1"], 3), round(r["delta"], 3)) for r in evaluate.ablation(runs).collect()}
    assert got == {"none": (0.8, 0.8, 0.0), "all": (0.9, 0.9, 0.1)}
    [r] = evaluate.prf(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).collect()
    assert (r["precision"], r["recall"], r["f1"]) == (None, None, None)
    a, b = (spark.createDataFrame(x, "v string") for x in ([("p",), ("q",), ("q",)], [("q",), ("r",)]))
    assert sorted((r["change"], r["v"]) for r in evaluate.gained_lost(a, b).collect()) == [("gained", "r"), ("lost", "p"), ("lost", "q")]
    cases = spark.createDataFrame([("clear", ["EMAIL", "TW_ID"])], "case string, detected array<string>")
    [r] = evaluate.recall_matrix(cases, ["EMAIL", "ADDRESS"]).collect()
    assert (r["EMAIL"], r["ADDRESS"], r["missing"]) == ("PASS", "MISS", ["ADDRESS"])
