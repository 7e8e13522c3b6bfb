import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, url_filter
from lectern.llm.url_filter import Rule
from tests.compare import oracle_rows, spark_rows


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_fits(rule, host, path):
    pattern = lambda glob, any_one: "".join({"*": any_one + "*", "?": any_one}.get(c, re.escape(c)) for c in glob)
    host_fits = re.search(r"(?:^|\.)" + pattern(rule.host, "[^#]") + r"\Z", host, re.S)
    return bool(host_fits and re.match(pattern(rule.path, "[^#]"), path, re.S))


def plain_judge(url, rules, globs=()):
    host, path = plain_parts(url)
    key = lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text)
    first = [min((r for r in some if plain_fits(r, host, path)), key=key, default=None) for some in (rules, globs)]
    verdict = next((r.verdict for r in first if r), "allow")
    return host, path, *(r and r.text for r in first), verdict


def judged(spark, urls, rules, globs=()):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rows = url_filter.judge(df, rules, list(globs)).orderBy("page_id").collect()
    return [(r["host"], r["path"], r["rule"], r["glob"], r["verdict"]) for r in rows]


ODD = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://com/", "http://xcom/", "http://a.com", "http://a.com?x=/en/", "http://a.com#/en/",
    "http://Example.Com/en/1", "http://www.example.com/en/", "http://www.example.com/EN/", "http://notexample.com/en/", "http://a.net/x.com/en/",
    "http://u@www.example.com:80/en/", "ftp://x.net/es/a://b.com/en/", "http://é.com/en/É?q", "http://a.b.net/fr/#f", "HTTP://\n.com/\n/en/", "http:///en/",
    "http://adult-x.example.net/", "http://m.ads-1.example.org/fr/", "http://x.org/a/ads/1", "http://x.org/track1.gif", "http://x.org/track.gif", "http://x.org/track😀.gif",
]


def test_odd_urls(spark):
    assert judged(spark, ODD, queries.URL_RULES, url_filter.GLOBS) == [plain_judge(u, queries.URL_RULES, url_filter.GLOBS) for u in ODD]


@pytest.mark.parametrize("seed", range(4))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    glob = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rules = [Rule(glob("ab.*?é", 5), glob("/a*?", 4), rng.choice(["allow", "block"])) for _ in range([1, 6, 40, 150][seed])]
    rules.append(Rule("a" * 100 + "*b", "/" + "c" * 90, "block"))  # over several words of the state
    urls = ["x://" + glob("abABé.", 8) + glob("/a?#é", 8) for _ in range(400)] + ["x://" + "a" * 130 + "b/" + "c" * 95]
    assert judged(spark, urls, rules) == [plain_judge(u, rules) for u in urls]
    assert judged(spark, urls, [], rules) == [plain_judge(u, [], rules) for u in urls]


def test_long_urls_and_repeated_rows(spark):
    urls = ["http://a.com/" + "x" * 50_000 + "/ads/", "http://" + "a." * 20_000 + "net/es/", "http://a.org/", "http://a.org/"]
    assert judged(spark, urls, queries.URL_RULES, url_filter.GLOBS) == [plain_judge(u, queries.URL_RULES, url_filter.GLOBS) for u in urls]


def test_states_of_texts_of_many_lengths():
    automaton = url_filter.Automaton([Rule("a", "/", "block"), Rule("b*", "", "allow")])
    texts = [".a#/", ".b#", ".ab#", ".a.b#/x", ".", ""]
    got = {}
    for places, fits in automaton.fitting(texts):
        got.update(zip(places, fits.tolist(), strict=True))
    assert [got[i] for i in range(6)] == [[True, False], [False, True], [False, False], [False, True], [False, False], [False, False]]
    assert automaton.words == 1 and automaton.follow.dtype == np.uint64


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, None)], "page_id bigint, url string")
    for k, name in enumerate(["canonical", "c0", "_host", "verdict", "HTML x"]):
        df = df.withColumn(name, F.lit(k))
    out = url_filter.judge(df, queries.URL_RULES)
    assert out.columns == ["page_id", "url", "canonical", "c0", "_host", "HTML x", *url_filter.RESULT]
    assert sorted(map(repr, out.select("page_id", "canonical", "c0", "_host", "`HTML x`", "rule", "verdict").collect()))[0] == repr(
        out.select("page_id", "canonical", "c0", "_host", "`HTML x`", "rule", "verdict").filter("page_id IS NOT NULL").first()
    )
    assert [r["verdict"] for r in out.filter("page_id = 1").collect()] == ["block", "block"]
    assert [tuple(r) for r in out.filter("page_id IS NULL").select("host", "path", "rule", "glob", "verdict").collect()] == [("", "", None, None, "allow")]
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, [], []).collect()} == {"allow"}


def test_query_equals_sql_and_plain(spark, sf_dir):
    rows = queries.op13_url_filter(spark, sf_dir)
    assert spark_rows(rows) == oracle_rows(queries.ORACLES["op13_url_filter"], sf_dir)
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    for r in rows.collect():
        assert (r["host"], r["path"], r["rule"], r["glob"], r["verdict"]) == plain_judge(urls[r["page_id"]], queries.URL_RULES, url_filter.GLOBS)
