import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import grammars as G


def senses(text, source="diogenes"):
    return [(s["path"], s["qualifier"], s["gloss"], s["citations"]) for s in G.parse_entry(source, text)["senses"]]


def test_headers_of_lexicon_entries():
    one = lambda text: {k: v for k, v in G.parse_entry("diogenes", text).items() if v and k not in ("parsed", "senses")}
    assert one("lupus, -i, m. (√lup)") == {"headword": "lupus", "gender": "m", "root": "lup", "principal_parts": ["-i"]}
    assert one("amo, amare, amavi, amatum, v.") == {"headword": "amo", "pos": "v", "principal_parts": ["amare", "amavi", "amatum"]}
    assert one("dies, -ei, m. or f.")["gender"] == "m. or f." and one("λόγος, -ου, ὁ")["gender"] == "ὁ"
    assert one("monere, -i")["principal_parts"] == ["-i"] and one("lupus") == {"headword": "lupus"}


def test_senses_keep_their_levels():
    text = "lupus, -i, m.\n I. a wolf\n A. lit., the beast\n 1. grey α. old\n 2. white B. a fish II. greed Cic.; Hor."
    assert senses(text) == [
        ("I", None, "a wolf", []), ("I.A", "lit", "the beast", []), ("I.A.1", None, "grey", []), ("I.A.1.α", None, "old", []), ("I.A.2", None, "white", []),
        ("I.B", None, "a fish", []), ("II", None, "greed", ["Cic", "Hor"]),
    ]
    assert senses("x, -i, m. A. one; two, B. three Ov. II. four") == [("A", None, "one; two", []), ("B", None, "three", ["Ov"]), ("II", None, "four", [])]
    assert senses("x I.") == [("I", None, None, [])]
    assert [p for p, *_ in senses("x " + " ".join(f"{k}. s" for k in range(1, 3000)))][-1] == "2999"


def test_malformed_entries_tell_where():
    for source, text, at in [
        ("diogenes", "completely invalid @#$ syntax !!!", 11), ("diogenes", "", 0), ("diogenes", "  ", 2), ("diogenes", "x, -i, m. (√", 12), ("cdsl", "; x", 0), ("dico", "x [ abc", 7),
        ("dico", "x | ", 4), ("gaffiot", "", 0), ("cdsl", None, 0), ("unknown", "x", 0),
    ]:
        assert G.parse_entry(source, text) == {"parsed": False, "error_at": at}, (source, text)


def test_other_dictionaries():
    found = G.parse_entry("dico", "dharma [ dharman ] m. n. loi, nature | devoir [ Mah. ] ; cf. svadharma | fin")
    assert (found["headword"], found["bracketed_form"], found["grammar_markers"]) == ("dharma", "dharman", ["m.", "n."])
    assert (found["continuation_text"], found["source_references"], found["cross_references"]) == ("devoir [ Mah. ] ; cf. svadharma | fin", ["Mah."], ["svadharma"])
    found = G.parse_entry("cdsl", "1. agni m. RV.; (from ag) (x) fire, ; see anala; &c., MBh.")
    assert (found["definition_text"], found["source_references"], found["cross_references"]) == ("fire", ["RV.", "&c., MBh."], ["see anala"])
    found = G.parse_entry("gaffiot", "lupus, i, m. 1 loup : lupus est Cic. Off. 1, 20 ; Virg. G. 3, 4 2) mors : fin")
    assert found["preamble"] == "lupus, i, m." and [(s["path"], s["gloss"], s["citations"]) for s in found["senses"]] == [
        ("1", "loup", ["Cic. Off. 1, 20", "Virg. G. 3, 4"]), ("2", "mors", []),
    ]
    assert G.parse_entry("gaffiot", "without numbers")["definition_text"] == "without numbers"


def test_french_glosses():
    told = lambda text: [(g["gloss"], g.get("qualifier"), g.get("citations")) for g in G.french_glosses(text)[0]]
    assert told("fig., amour (voir amor); passion\n¶ au fig. x") == [("amour", "fig", ["amor"]), ("passion", None, []), ("x", "au fig", [])]
    assert told("") == told(None) == told(" ; ,") == [] and told("figure, lit") == [("figure", None, [])]
    assert told("amour (latin), x") == [("amour (latin)", None, None), ("x", None, None)] and G.french_glosses("amour (latin), x")[1] == 7


@pytest.mark.parametrize("source", list(G.GRAMMARS))
def test_any_text_gives_a_row(source):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab m. I. A. 1. α. ,;:|[]() \n¶ é Cic. cf. voir fig".split(" ") + [" "]) for _ in range(rng.randint(0, 40)))
        found = G.parse_entry(source, text)
        assert found["parsed"] != (found["error_at"] is not None) and (found["parsed"] or 0 <= found["error_at"] <= len(text))


def test_long_entries_take_time_in_proportion():
    text = "lupus, -i, m. " + " ".join(f"{k}. " + "word " * 20 for k in range(1, 800))
    assert len(senses(text)) == 799
    assert G.parse_entry("gaffiot", "x 1 a : " + "b " * 50_000)["parsed"]


def test_frames(spark):
    rows = spark.createDataFrame([(1, "cdsl", "agni m. fire"), (2, "french", "a (b), c"), (3, None, None), (4, "dico", ""), (1, "cdsl", "agni m. fire")], "`a key` int, src string, t string").withColumn("parsed", F.lit("x"))
    found = sorted(map(tuple, G.parse_entries(rows, ["a key"], "t", "src").select("`a key`", "parsed", "error_at", "headword", F.size("senses")).collect()), key=repr)
    assert found == [(1, True, None, "agni", 0), (1, True, None, "agni", 0), (2, False, 3, None, 2), (3, False, 0, None, 0), (4, False, 0, None, 0)]
    assert G.parse_entries(rows.limit(0), ["a key"], "t", "src").count() == 0
