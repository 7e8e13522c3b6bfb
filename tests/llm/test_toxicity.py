import math
import os
import random
import zlib

import numpy as np
import pytest

from lectern.llm import queries
from lectern.llm import toxicity as T
from tests.llm.fixtures import AWKWARD, assert_values_stay, docs, with_extras

SYLLABLES = "the re on er st ing and ti en es or ver ge ment que ado".split()


def texts(rng, n, bad):
    out = []
    for _ in range(n):
        w = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        if bad:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["grobble", "snirk"]) + rng.choice(SYLLABLES + [""])
        out.append(" ".join(w))
    return out


def scores(model, rows):
    return 1 / (1 + np.exp(-T.worst_windows(T.bags(rows), *model.gram_scores())[0]))


def model_of(rng, n=300):
    good, bad = texts(rng, n, False), texts(rng, n, True)
    return T.fit(good + bad, [0] * n + [1] * n)


def test_unseen_forms_are_found():
    rng = random.Random(1)
    model = model_of(rng)
    held = scores(model, texts(rng, 100, True))
    clean = scores(model, texts(rng, 100, False))
    assert (held >= T.THRESHOLD).mean() > 0.93 and (clean >= T.THRESHOLD).mean() < 0.03
    assert (scores(model, ["the or grobbel ti", "re ing snirkk ti"]) > scores(model, ["the or tion ti", "re ing ment ti"])).all()


def test_a_few_words_in_a_long_text_count():
    rng = random.Random(3)
    model = model_of(rng)
    long = " ".join(texts(rng, 60, False))
    assert scores(model, [long])[0] < T.THRESHOLD <= scores(model, [long + " grobble snirk " + long])[0]


def test_one_class_only():
    model = T.fit(["a b", "c d"], [1, 1])
    assert model.constant == 1.0 and T.fit([], []).constant == 0.0


def test_awkward_documents(spark):
    model = model_of(random.Random(5), 60)
    df = with_extras(docs(spark, AWKWARD))
    got = T.score(df, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    empty = {round(r["score"], 9) for r in got if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert_values_stay(df, T.keep_clean(df, model))
    assert T.score(docs(spark, []), model).count() == 0 and T.keep_clean(docs(spark, []), model).count() == 0


def test_query_never_fits_held_out_rows(spark, sf_dir, monkeypatch):
    seen = []
    own = T.fit
    monkeypatch.setattr(T, "fit", lambda texts, labels, **k: (seen.extend(texts), own(texts, labels, **k))[1])
    got = queries.op10_toxicity(spark, sf_dir).collect()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = {i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r["doc_id"] for r in got if r["held_out"]} == out and len(got) == len(rows)
    assert sorted(seen) == sorted(t for i, t in rows.items() if i in labels and i not in out)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    found = {c: [r["predicted"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == c] for c in (0, 1)}
    assert sum(found[0]) <= 0.02 * len(found[0])


def test_held_out_rows(spark):
    """A third of the toxic labels of these tables is on texts without any insult, so recall is measured beside the rank."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no such table")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]]) for r in queries.op10_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for s, c in got if c], [s for s, c in got if not c]
    assert sum(s >= T.THRESHOLD for s in toxic) >= 0.55 * len(toxic)
    assert sum(s < T.THRESHOLD for s in clean) >= 0.98 * len(clean)
    assert sum(a > b for a in toxic for b in clean) >= 0.85 * len(toxic) * len(clean)


def plain_score(model, text):
    """A loop over words, n-grams and windows."""
    words = []
    for w in (text or "").lower().encode().translate(T._WORD_BYTES).split():
        if not words or words[-1] != w:
            words.append(w)
    scores, empty = model.gram_scores()

    def grams(w):
        out = []
        for n in T.GRAMS:
            for i in range(len(w) + 3 - n):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for b in (b" " + w + b" ")[i : i + n]:
                    h = (h * 0x01000193 + b) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
                out.append(float(scores[h >> 32 - T.BUCKETS_LOG2]))
        return out

    found = [grams(w) for w in words]
    worst = [sum(map(sum, found[i : i + T.WINDOW])) / max(1, sum(map(len, found[i : i + T.WINDOW]))) for i in range(max(1, len(found) - T.WINDOW + 1))]
    return 1 / (1 + math.exp(-max(-30, min(30, (max(worst) if words else 0.0) + empty))))


def test_scores_against_a_plain_version(spark):
    rng = random.Random(9)
    model = model_of(rng, 60)
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(texts(rng, 20, True) + texts(rng, 20, False))] + [(200, "grobble"), (201, "a b"), (202, "ab " * 9)]
    rows = [r for r in rows if len(r[1] or "") < 6000]
    got = {(r["doc_id"], round(r["score"], 5)) for r in T.score(docs(spark, rows), model).collect()}
    assert got == {(i, round(plain_score(model, t), 5)) for i, t in rows}


def test_the_fit_is_bounded_by_ids_that_qualify(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, labels: seen.append(sorted(texts)))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], f"copy {k}") for k in range(3000)] + [(i, "z" * 50 if i % 2 else f"text {i}") for i in ids[1:]]
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in ids], "doc_id bigint, toxic int")
    T.train(docs(spark, rows), labels, rows=5, chars=40)
    assert len(seen[0]) == 10 and sum(t.startswith("copy") for t in seen[0]) <= 1 and all(len(t) <= 40 for t in seen[0])
