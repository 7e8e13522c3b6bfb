import random
import re

from lectern.llm import license_scan as L
from lectern.llm import queries
from tests.llm.fixtures import AWKWARD, docs, with_extras

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain_base(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def spans(spark, rows):
    return {r["doc_id"]: r["spans"] for r in L.scan(docs(spark, rows)).collect()}


def test_places_of_phrases(spark):
    rng = random.Random(2)
    words = "cc by CC-BY all rights reserved general public license the İ été x1".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]
    got = {r["doc_id"]: (r["n_words"], r["spans"]) for r in L.scan(docs(spark, rows)).collect()}
    for i, t in rows:
        exact = [s for s in got[i][1] if s["exact"]]
        begins = [s["begin"] for s in exact]
        n, k, first, last, labels = plain_base(t)
        assert (got[i][0], len(exact), min(begins, default=None), max(begins, default=None)) == (n, k, first, last)
        assert ",".join(sorted({s["label"] for s in exact})) == labels


def plain_chain(hits, template):
    """The best share of all chains of hits in which both places rise and that have the telling words: for each first hit, the longest
    chain to each other hit and set of telling words."""
    hits, grams = sorted(hits), len(template.words) - 1
    every, best = frozenset(template.telling), 0.0
    told = lambda at: frozenset(k for k in template.telling if k in (at, at + 1))
    for a, (first, at0) in enumerate(hits):
        longest = {a: {told(at0): 1}}
        for k in range(a + 1, len(hits)):
            i, at = hits[k]
            own = {}
            for j, lengths in longest.items():
                if hits[j][0] < i and hits[j][1] < at:
                    for words, n in lengths.items():
                        own[words | told(at)] = max(own.get(words | told(at), 0), n + 1)
            longest[k] = own
        for k, lengths in longest.items():
            best = max(best, lengths.get(every, 0) / max(grams, hits[k][0] - first + 1))
    return best


def plain_groups(hits, reach):
    left, out = set(hits), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            h = todo.pop()
            group.add(h)
            near = {x for x in left if abs((x[0] - x[1]) - (h[0] - h[1])) <= L.SLACK and abs(x[0] - h[0]) <= reach}
            left -= near
            todo += near
        out.append(group)
    return out


def plain_best(words, template):
    """The best share of a notice; by pairs of words, without hashes."""
    t = template.words
    hits = [(i, j) for i in range(len(words) - 1) for j in range(len(t) - 1) if words[i : i + 2] == list(t[j : j + 2])]
    return max((plain_chain(g, template) for g in plain_groups(hits, len(t))), default=0.0)


def splice(rng):
    """Words of notices and phrases, cut, joined, with words put in, left out and replaced."""
    wordings = [w.replace("{", "").replace("}", "") for ws in L.NOTICES.values() for w in ws] + list(PHRASES)
    out = []
    for _ in range(rng.randint(1, 5)):
        w = L.words_of(rng.choice(wordings))
        if rng.random() < 0.4:
            a = rng.randrange(len(w))
            w = w[a : a + rng.randint(1, len(w))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + ["other"] + w[at:], w[:at] + ["other"] + w[at + 1 :]])
        out += w + [f"x{rng.random()}"[:4]] * rng.randint(0, 4)
    return out


def test_labels_and_score_against_a_plain_version(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(splice(rng))) for i in range(400)]
    found = spans(spark, rows)
    notices = [t for t in L.default_templates() if not t.exact]
    several = 0
    for i, text in rows:
        words = L.words_of(text)
        best = {}
        for t in notices:
            share = plain_best(words, t)
            if share >= L.least_share(t.grams):
                best[t.label] = max(best.get(t.label, 0), share)
        got = {}
        for s in found[i]:
            if not s["exact"]:
                got[s["label"]] = max(got.get(s["label"], 0), s["share"])
                assert 0 <= s["begin"] < s["end"] <= len(words) and s["share"] <= 1
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in best.items()}
        several += len(best)
        whole = {t.label for t in notices if any(words[k : k + len(t.words)] == list(t.words) for k in range(len(words)))}
        assert all(got[x] == 1.0 for x in whole) and {x for x, s in got.items() if s == 1.0} == whole
    assert several > 50


def test_what_follows_hides_no_notice():
    """Random neighbourhoods of notices with one changed word: what is found alone is found with pieces of notices around it."""
    rng = random.Random(21)
    notices = [t for t in L.default_templates() if not t.exact]
    hits = lambda words, t: [(i, j) for i in range(len(words) - 1) for j in range(t.grams) if tuple(words[i : i + 2]) == t.words[j : j + 2]]
    nc = next(t for t in notices if t.label == "cc-by-nc")
    assert L.notices_in(hits("licensed under cc by nc zz 0 4 0".split(), nc), nc)[0][2] > 0.6
    asked = 0
    for _ in range(6000):
        t = rng.choice(notices)
        at = rng.randrange(len(t.words))
        words = [*t.words[:at], *rng.choice([["other"], [], ["other", t.words[at]]]), *t.words[at + 1 :]]
        alone = max((s for *_, s in L.notices_in(hits(words, t), t)), default=0.0)
        piece = lambda: list(t.words[(a := rng.randrange(len(t.words))) : a + rng.randint(1, 5)])  # noqa: B023, E731
        around = [*piece(), *["x"] * rng.randint(0, 2), *words, *["y"] * rng.randint(0, 2), *piece(), *piece()]
        asked += alone > 0
        assert max((s for *_, s in L.notices_in(hits(around, t), t)), default=0.0) >= alone - 1e-12
    assert asked > 3000


def test_many_notices_in_one_text_take_time_in_proportion():
    t = next(t for t in L.default_templates() if t.label == "mit" and len(t.words) > 8)
    n = len(t.words)
    found = [(k * n + j, j) for k in range(4000) for j in range(t.grams)]
    assert L.notices_in(found, t) == [(k * n, k * n + n, 1.0) for k in range(4000)]


def test_every_notice_with_one_changed_word(spark):
    rows, labels = [], []
    for t in L.default_templates():
        if t.exact:
            continue
        for at in range(1, len(t.words) - 1):
            for change in (["other"], ["other", t.words[at]], []):
                broken = {at - 1} if len(change) == 2 else {at - 1, at}
                if any(not {k - 1, k} & set(range(t.grams)) - broken for k in t.telling):
                    continue  # no pair with the telling word is left
                rows.append((len(rows), "before it " + " ".join([*t.words[:at], *change, *t.words[at + 1 :]]) + " after it"))
                labels.append(t.label)
    found = spans(spark, rows)
    for (i, _), label in zip(rows, labels, strict=True):
        assert label in {s["label"] for s in found[i]}, rows[i]


def test_notices_with_changed_words(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    changed = mit.replace("free of charge", "and free of any charge")
    found = spans(
        spark,
        [
            (1, f"intro words here {mit} and more"),
            (2, changed),
            (3, "Permission is granted to any person"),
            (4, mit + " x " + mit),
            (5, "released under the released under the mit"),
            (6, "released under the BSD license"),
            (7, "the \u212A license, licensed under cc by sa 4.0"),
        ],
    )
    assert {s["label"] for s in found[1]} == {"mit"} and found[1][0]["begin"] == 3 and found[1][0]["share"] == 1.0
    assert {s["label"] for s in found[2]} == {"mit"} and found[2][0]["share"] < 1
    assert found[3] == [] and found[6] == []
    assert sorted({s["begin"] for s in found[4]}) == [0, 16] or sorted({s["begin"] for s in found[4]}) == [0, 17]
    assert [s["share"] for s in found[5]] == [0.75]
    assert {s["label"] for s in found[7]} == {"cc-by-sa", "cc-by"}


def test_many_templates_are_joined_by_shuffling(spark, monkeypatch):
    rows = [(1, "x all rights reserved CC BY y"), (2, "nothing"), (3, None), (4, "released under the MIT license")]
    few = spans(spark, rows)
    monkeypatch.setattr(L, "BROADCAST_GRAMS", 0)
    plan = L.hits(docs(spark, rows), L.default_templates())
    assert spans(spark, rows) == few and len(few[1]) == 2 and few[4][0]["label"] == "mit"
    assert "broadcast" not in plan._jdf.queryExecution().analyzed().toString().lower()


def test_awkward_documents(spark):
    got = L.scan(with_extras(docs(spark, AWKWARD + [(9, "All rights reserved.")] * 3))).collect()
    assert len(got) == len(AWKWARD) + 3
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], len(r["spans"])) for r in got) == sorted(
        (i is None, i or 0, plain_base(t)[0], plain_base(t)[1]) for i, t in AWKWARD + [(9, "All rights reserved.")] * 3
    )
    assert L.scan(docs(spark, [])).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op1_license_scan(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
