"""The queries of the training-text operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    chat_format,
    conversation_repair,
    decision_list,
    imatch,
    lexical_search,
    license_scan,
    packing,
    piece_bpe,
    secret_forest,
    simhash,
    token_rollup,
    toxicity,
    url_filter,
)
from lectern.llm.common import tokenizer_path
from lectern.storage import cut, read_table, shared_dir, spread, stored


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    exact = F.filter("spans", lambda s: s["exact"])
    begins = F.transform(exact, lambda s: s["begin"].cast("bigint"))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("bigint").alias("n_base"),
        F.array_min(begins).alias("first_word"),
        F.array_max(begins).alias("last_word"),
        names(exact).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = imatch.prepare(docs)
    pairs = imatch.with_next(imatch.with_hashes(docs, "text", found), {"next_text": "text", "next_hashes": "hashes"})
    n = F.char_length("text")
    cut_at = n - F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), cut_at), F.substring("next_text", F.lit(1), n - cut_at))
    both = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), "hashes", "next_hashes", edited.alias("edited"))
    both = imatch.with_hashes(both, "edited", found, "edited_hashes")
    # as a generator's output the hashes are computed once for each row, not for each of their uses
    both = both.select("doc_id", "n_chars", "hashes", "next_hashes", "edited", F.explode(F.array("edited_hashes")).alias("edited_hashes"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        imatch.fingerprint(F.col("hashes")).alias("fingerprint"),
        imatch.fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        imatch.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        imatch.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = decision_list.train(docs, _read(spark, sf_dir, "labels"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return decision_list.judge(docs.select("doc_id", "text"), rules).select(
        "row.doc_id", *(F.col("stats")[c].alias(c) for c in stats), "base_failed", "kept"
    )


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, table))


#: The conversation that op4 adds: control strings of chat templates inside the texts.
PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = chat_format.format_conversations(rows.unionByName(probe))
    out = out.select(
        "conv_id",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Small numbers as text.
_DECIMALS = [str(i) for i in range(1 << 16)]


def _decimals(ids: list[int]) -> str:
    try:
        return " ".join(map(_DECIMALS.__getitem__, ids))
    except IndexError:
        return " ".join(map(str, ids))


def _piece_digests(ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([digest(_decimals(x)) for x in ids], pa.string()),
        pa.array([digest(t) for t in decoded], pa.string()),
    ]


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(
        _read(spark, sf_dir, "documents"),
        tokenizer_path("piece_bpe_32k.model"),
        _piece_digests,
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.scan(_read(spark, sf_dir, "documents"), secret_forest.train())
    secrets = F.filter("spans", lambda s: s["score"] >= secret_forest.THRESHOLD)
    told = lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"), s["kind"])
    return found.select(
        "doc_id",
        F.size("spans").cast("bigint").alias("n_candidates"),
        F.size(secrets).cast("bigint").alias("n_secrets"),
        F.array_join(F.transform(secrets, told), ",").alias("secrets"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(cut(pieces))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches: all documents; those of low quality go; the counts of toxic ones are revised, with their end id; those labelled
    good and clean move to version 2, with their end id; all is compacted; and the second and third batches come again, which
    changes nothing."""
    counts = cut(
        token_rollup.token_counts(
            _read(spark, sf_dir, "documents"),
            tokenizer_path("word_bpe_49k.json"),
            tokenizer_path("piece_bpe_32k.model"),
        )
    )
    kinds = [("word_bpe_49k", "word_tokens"), ("piece_bpe_32k", "piece_tokens")]
    each = counts.select(
        "doc_id",
        "source",
        "lang",
        F.inline(F.array(*(F.struct(F.lit(k).alias("tokenizer"), F.col(c).alias("tokens")) for k, c in kinds))),
    )
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))

    def changes(rows: DataFrame, op: str, version: str, more: int = 0) -> DataFrame:
        old = F.when(F.lit(op == "revise"), F.col("tokens")).alias("old_tokens")
        tokens = (F.col("tokens") + more).alias("tokens")
        return rows.select(F.lit(op).alias("op"), "source", "lang", "tokenizer", F.lit(version).alias("version"), tokens, old)

    low, toxic, good = (
        each.join(labels.filter(chosen), "doc_id", "left_semi")
        for chosen in ("quality = 0", "quality = 1 AND toxic = 1", "quality = 1 AND toxic = 0")
    )
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.apply("1", changes(each, "insert", "1"))
    rollup.apply("2", changes(low, "delete", "1"))
    rollup.apply("3", changes(toxic, "revise", "1", 1))
    rollup.compact()
    rollup.apply("4", changes(good, "delete", "1").unionByName(changes(good, "insert", "2", 1)))
    rollup.apply("2", changes(low, "delete", "1"))
    rollup.apply("3", changes(toxic, "revise", "1", 1))
    totals = cut(rollup.totals())
    rollup.drop()
    return totals


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )

def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark")
    index = lexical_search.build_index(_read(spark, sf_dir, "documents"), lexical_search.asked_terms(items))
    return lexical_search.search(stored(index, "lexical-index"), items)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: rows are dropped, emptied, robbed of their sentences' ends, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.summaries(conversation_repair.repair(damaged(rows)), lambda said: F.sha2(said, 256))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *map(number, "blank duplicate truncated illegal cost".split()),
        F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("bigint").alias("gaps"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: The contract's rules.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "glob", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_imatch": op2_imatch,
    "op3_decision_list": op3_decision_list,
    "op4_chat_format": op4_chat_format,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_secret_forest": op6_secret_forest,
    "op7_packing": op7_packing,
    "op8_token_rollup": op8_token_rollup,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_url_filter": op13_url_filter,
}



def _like(glob: str) -> str:
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_"}.get(c, c) for c in glob)


def _rule_rows(rules: list[url_filter.Rule]) -> str:
    """Rules as SQL values: the one that wins first."""
    values = (f"({k}, '{_like(r.host)}', '{_like(r.path)}', '{r.text}', '{r.verdict}')" for k, r in enumerate(url_filter.ranked(rules)))
    return f"(VALUES {', '.join(values)}) AS r (k, host, path, rule, verdict)"


def _first_rule(rules: list[url_filter.Rule]) -> str:
    return rf"""SELECT n, min(k) AS k, arg_min(rule, k) AS rule, arg_min(verdict, k) AS verdict
  FROM (SELECT n, r.* EXCLUDE (host, path) FROM p JOIN {_rule_rows(rules)} ON '.' || p.host LIKE '%.' || r.host ESCAPE '\' AND p.path LIKE r.path || '%' ESCAPE '\') GROUP BY n"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ESCAPED = r"regexp_replace({}, '([<\[])(~*)(/?(?:s>|INST\]|ROLE\]|NEXT\]))', '\1\2~\3', 'g')"

#: The other operators' results hang on trained models, library tokenizers or hashes that SQL has not; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op4_chat_format": f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))),
m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role THEN 0 ELSE 1 END AS opens FROM r)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("text")}) + CASE WHEN opens = 1 THEN length('<s>[ROLE][/ROLE]</s>') + length({_ESCAPED.format("role")}) ELSE length('[NEXT]') END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""",
    "op11_lexical_search": rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_TERMS}') AS t FROM documents),
d AS (SELECT r, doc_id, len(t) AS n, t FROM t WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
i AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERMS}')) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT k, item_id, d.r, d.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN d ON p.r = d.r, s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0) WHERE rank <= 10""",
    "op13_url_filter": rf"""WITH u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, {_LOWERED.replace("text", "regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS ({_first_rule(URL_RULES)}), g AS ({_first_rule(url_filter.GLOBS)})
SELECT page_id, host, path, b.rule, g.rule AS glob, coalesce(b.verdict, g.verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (n) LEFT JOIN g USING (n)""",
}
