import itertools
import random

from lectern.functions.text import STOP_WORDS
from lectern.operators import similarity, windows


def grown(sizes, anchor, budget):
    """Places chosen by a walk, one step at a time."""
    if anchor not in sizes:
        return set()
    order = sorted(sizes)
    at = order.index(anchor)
    low = high = at
    used, open_, side = sizes[anchor], [True, True], 0
    while any(open_):
        nxt = low - 1 if side == 0 else high + 1
        if open_[side]:
            open_[side] = 0 <= nxt < len(order) and used + sizes[order[nxt]] <= budget
            if open_[side]:
                used += sizes[order[nxt]]
                low, high = (nxt, high) if side == 0 else (low, nxt)
        side = 1 - side
    return {order[i] for i in range(low, high + 1)}


def test_budget_around(spark):
    rng = random.Random(4)
    works = {w: {p: rng.choice([0, 1, 5, 20, 90]) for p in rng.sample(range(30), rng.randint(1, 20))} for w in range(120)}
    rows = [(w, p, n) for w, sizes in works.items() for p, n in sizes.items()]
    for budget in (0, 30, 100, 400):
        got = windows.budget_around(spark.createDataFrame(rows, "w int, p int, n int"), "w", "p", "n", 7, budget).collect()
        assert {(r["w"], r["p"]) for r in got} == {(w, p) for w, sizes in works.items() for p in grown(sizes, 7, budget)}


def test_equal_texts_make_no_pairs_of_all(spark):
    rows = [(i, "bright red wolf") for i in range(400)] + [(500, "wolf red"), (501, "the wolf, Red and bright!"), (502, "")]
    pairs = similarity.similar_pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t", 0.5).collect()
    assert len(pairs) == 401 and {(r["a"], r["b"]) for r in pairs if r["score"] < 1} == {(0, 500)}


def test_metrics_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij kl mn op qr st the uv wx".split(), k=rng.randint(0, 9)))) for i in range(80)]
    bags = {i: [w for w in t.split() if w not in STOP_WORDS] for i, t in rows}
    score = {
        "jaccard": lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)),
        "dice": lambda x, y: 2 * len(set(x) & set(y)) / (len(set(x)) + len(set(y))),
        "cosine": lambda x, y: sum(x.count(w) * y.count(w) for w in set(x)) / (sum(x.count(w) ** 2 for w in set(x)) * sum(y.count(w) ** 2 for w in set(y))) ** 0.5,
    }
    for metric, f in score.items():
        for least in (0.31, 0.69):
            got = similarity.similar_pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t", least, metric)
            reps = {}
            for i, b in sorted(bags.items()):
                if b:
                    reps.setdefault(tuple(sorted(b) if metric == "cosine" else sorted(set(b))), []).append(i)
            expected = {(a[0], b, 1.0) for a in reps.values() for b in a[1:]}
            for x, y in itertools.combinations(sorted(v[0] for v in reps.values()), 2):
                if f(bags[x], bags[y]) >= least:
                    expected.add((x, y, round(f(bags[x], bags[y]), 9)))
            assert {(r["a"], r["b"], round(r["score"], 9)) for r in got.collect()} == expected, (metric, least)
