"""Answers of command-line tools as the JSON that ``lectern.operators.claims`` reads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Codes of the word list's analyses.
CASES = {"NOM": "nominative", "GEN": "genitive", "DAT": "dative", "ACC": "accusative", "ABL": "ablative", "VOC": "vocative", "LOC": "locative"}
NUMBERS = {"S": "singular", "P": "plural"}
GENDERS = {"M": "masculine", "F": "feminine", "N": "neuter", "C": "common"}
TENSES = {"PRES": "present", "IMPF": "imperfect", "FUT": "future", "PERF": "perfect", "PLUP": "pluperfect", "FUTP": "future perfect"}
VOICES = {"ACTIVE": "active", "PASSIVE": "passive"}
MOODS = {"IND": "indicative", "SUB": "subjunctive", "IMP": "imperative", "INF": "infinitive", "PPL": "participle"}
PARTS = ("N", "V", "ADJ", "ADV", "PRON", "VPAR", "NUM", "PREP", "CONJ", "INTERJ", "SUPINE")
ORDINALS = {"1st": "1", "2nd": "2", "3rd": "3", "4th": "4", "5th": "5"}

_TERM = re.compile(rf"^(\S+)\s+({'|'.join(PARTS)})\s+(.*)$")
_CODE = re.compile(rf"^(\S.*?)\s{{1,}}({'|'.join(PARTS)})\b\s*(?:\((1st|2nd|3rd|4th|5th)\))?.*$")


def analysis(code: str) -> dict[str, str]:
    """Features of the codes after a part of speech; numbers that stand for persons are told from those for classes by their place."""
    parts = code.split()
    out: dict[str, str] = {}
    for table, name in ((CASES, "case"), (TENSES, "tense"), (VOICES, "voice"), (MOODS, "mood")):
        found = next((table[p] for p in parts if p in table), None)
        if found:
            out[name] = found
    tail = parts[2:]
    if "mood" in out and len(tail) >= 2 and tail[-2] in ("1", "2", "3"):
        out["person"] = {"1": "first", "2": "second", "3": "third"}[tail[-2]]
    letters = [p for p in tail if p in NUMBERS or p in GENDERS]
    number = next((p for p in letters if p in NUMBERS), None)
    if number:
        out["number"] = NUMBERS[number]
        letters.remove(number)
    if "case" in out and letters:
        out["gender"] = GENDERS.get(letters[-1], "")
    return {k: v for k, v in out.items() if v}


def parse_word_list(text: str) -> dict:
    """``{"wordlist": [...]}``: analyses, then the line of the entry, then its senses; entries without a line of their own are named after
    their first analysed form, stem and ending joined."""
    words: list[dict] = []
    now: dict | None = None
    closed = True
    for line in (x.rstrip() for x in text.splitlines()):
        if not line.strip() or line.startswith("*"):
            continue
        if (m := _TERM.match(line)) and not line.rstrip().endswith(";") and "[" not in line and "," not in m[1]:
            if closed:
                now = {"lemma": m[1].replace(".", ""), "variants": [], "pos": m[2], "senses": [], "terms": []}
                words.append(now)
                closed = False
            now["terms"].append({"term": m[1].replace(".", "")} | analysis(m[3]))
        elif now is not None and not now["senses"] and "," in line and (m := _CODE.match(line)):
            forms = [f.strip() for f in m[1].split(",")]
            now |= {"lemma": forms[0], "variants": [f for f in forms[1:] if f and not f.startswith("-")], "pos": m[2]}
            if m[3]:
                now["conjugation" if m[2] == "V" else "declension"] = ORDINALS[m[3]]
            closed = True
        elif now is not None:
            now["senses"] += [s.strip() for s in line.split(";") if s.strip()]
            closed = True
    return {"wordlist": words}


def word_list_answers(answers: DataFrame) -> DataFrame:
    """``call_id, payload`` of ``call_id, text``."""
    kind = dict(answers.dtypes)["call_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads = [json.dumps(parse_word_list(t or ""), ensure_ascii=False) for t in batch["text"]]
            yield pd.DataFrame({"call_id": batch["call_id"], "payload": payloads})

    return answers.select("call_id", "text").mapInPandas(run, f"call_id {kind}, payload string")
