from lectern.sources import tool_pages as T


def paths(text):
    return [(b["path"], b["text"]) for c in T.LexiconPage(text).chunks if "blocks" in c for b in c["blocks"]]


def sense(indent, text):
    return f'<div id="sense" style="padding-left: {indent}px;">{text}</div>'


def test_definitions_keep_their_levels():
    page = "<h2><span>λόγος</span>, -ου, ὁ</h2>" + "".join(map(sense, [0, 20, 40, 20, 40, 40, 0, 20, 0], "abcdefghi"))
    assert paths(page) == list(zip(["01", "01:00", "01:00:00", "01:01", "01:01:00", "01:01:01", "02", "02:00", "03"], "abcdefghi", strict=True))


def test_citations_and_unclosed_tags():
    page = '<h2>lupus</h2><div id="sense">a <b>wolf <span class="origjump Perseus:abo:phi,0690,001:1">Verg. E. <i>2</i></span>, <span>not cited</span></div><div id="sense" style="color:red">b,</div>'
    (chunk,) = T.LexiconPage(page).chunks
    assert chunk["term"] == "lupus" and [b["text"] for b in chunk["blocks"]] == ["a wolf Verg. E. 2, not cited", "b"]
    assert chunk["blocks"][0]["citations"][0]["ref"] == "perseus:abo:phi,0690,001:1" and chunk["blocks"][0]["citations"][0]["text"].startswith("Verg. E.")
    assert [b["path"] for b in chunk["blocks"]] == ["01", "02"]


def test_answers_of_pages():
    page = "<h1>Perseus an analysis</h1><li>lupus2, lupum (wolf, 3pike): noun masc/fem (acc) sg</li><li>nothing</li><hr><h2>lupus, -i</h2>" + sense(0, "wolf")
    answer = T.lexicon_answer(page)
    assert answer["lemmas"] == ["lupus"] and answer["chunks"][0] == {"kind": "analysis", "forms": ["lupus", "lupum"], "senses": ["wolf", "pike"], "pos": "noun", "features": ["masc", "fem", "acc", "sg"]}
    assert answer["chunks"][1] == {"kind": "match", "reference": "lupus", "senses": ["wolf"], "citations": []}
    assert T.lexicon_answer("<span>Could not find dictionary headword</span><hr><h2>near</h2>" + sense(0, "x"))["chunks"][0]["kind"] == "fuzzy"
    assert T.lexicon_answer("") == {"lemmas": [], "no_match": False, "chunks": []} and T.lexicon_answer("<<<div></p></b>")["chunks"] == []
    table = '<table class="deep_sky_back"><tr><th><span>tat</span></th><td>[ tad ]{ nom. sg. n. | acc. sg. n. }</td></tr></table><table class="other"><td>[x]{y}</td></table>'
    assert T.analysis_answer(table) == {"lemma": "tad", "analyses": [{"word": "tat", "color": "deep_sky", "variants": [{"tags": "nom. sg. n."}, {"tags": "acc. sg. n."}]}]}


def test_frames(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<h2>x</h2>" + sense(0, "y"))], "call_id int, html string")
    assert {r["call_id"] for r in T.page_answers(rows, T.lexicon_answer).collect()} == {2, 3}
    assert [(r["call_id"], r["path"], r["text"]) for r in T.lexicon_blocks(rows).collect()] == [(3, "01", "y")]
