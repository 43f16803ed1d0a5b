"""One query for each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import bpe, chat, html_text, jaccard, language_model, mixing, negatives, quality_model, quality_rules, topk, url_filter, warc, whitening
from noticeflow.llm.common import table, written

#: (host, path, verdict) of the rules that op1 applies.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
TOKENIZER = "word_bpe_49k.json"
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """NOTICEFLOW_TOKENIZERS names another folder of tokenizer files."""
    folder = os.environ.get("NOTICEFLOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_FITS = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
_LONGEST = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
OP1_SQL = f"""
WITH u AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {_FITS(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule,
       CASE {' '.join(f"WHEN {_FITS(h, p)} THEN '{v}'" for h, p, v in _LONGEST)} ELSE 'allow' END AS verdict
FROM u
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return mixing.mix(docs, exponent=0.7, epochs=1.0, seed="mix-1")


OP2_SQL = """
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN chars > 0
      THEN 1.0 * sum(chars) OVER () * pow(chars, 0.7) / sum(pow(chars, 0.7)) OVER () / chars ELSE 1.0 END AS rate FROM s),
k AS (SELECT source, rate, unnest(generate_series(1, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM r),
p AS (SELECT source, exp(sum(ln(rate) - ln(k::DOUBLE)) OVER (PARTITION BY source ORDER BY k) - rate) AS p, k FROM k
      UNION ALL SELECT source, exp(-rate), 0 FROM r),
c AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
l AS (SELECT source, list(cdf ORDER BY cdf) AS cdfs FROM c GROUP BY source),
n AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text,
      len(list_filter(l.cdfs, lambda x: x <= ('0x' || substr(md5('mix-1|' || d.doc_id::VARCHAR), 1, 13))::UBIGINT / 4503599627370496.0)) AS n
      FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, source, lang, n_chars, text, unnest(generate_series(0, n - 1))::INTEGER AS copy_no FROM n WHERE n > 0)
SELECT doc_id, source, lang, n_chars, text, copy_no,
       md5('mix-1/order|' || doc_id::VARCHAR || '|' || copy_no::VARCHAR) AS shuffle_key FROM e
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    tree = html_text.train(html_text.labelled_blocks(spark))
    return html_text.extract(pages, tree).select("page_id", "url", "text", "n_chars")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = bpe.load(spark, tokenizer_path())
    coded = bpe.recode(docs, tokenizer)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


THRESHOLD = 0.3


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality_model.statistics(docs), "stats")
    model = quality_model.fit(stats, table(spark, sf_dir, "labels"))
    return quality_model.score(stats, model).select(
        "doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    chats = chat.format_chats(turns.unionByName(extra))
    loss = chat.loss_text(F.col("turns"))
    return chat.read_chats(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = lambda c: rf"length(regexp_replace({c}, '([\\<\[\]])', '\\\1', 'g'))"
OP6_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
w AS (SELECT *, lag(role) OVER o AS before, lead(role) OVER o AS after FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_ESCAPED('text')} + CASE WHEN before IS DISTINCT FROM role THEN 5 + {_ESCAPED('role')} ELSE 3 END
      + CASE WHEN after IS DISTINCT FROM role THEN 7 + {_ESCAPED('role')} ELSE 0 END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = written(quality_rules.statistics(docs).drop("text"), "counts")
    verdicts = quality_rules.judge(counted, quality_rules.estimates(counted))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.page_records(warc.read_archives(spark, warc.write_archives(pages, min_bytes=0)))


_DIGIT32 = lambda i: f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32, 4)"
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  translate({' || '.join(_DIGIT32(i) for i in range(8))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM d
"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.join(docs, k=5, percent=75)


#: Links between different sets, each named by its least doc_id, then all that each of them reaches.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
c AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT node, n, unnest(s) AS shingle FROM c),
p AS (SELECT x.node AS a, y.node AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.node <> y.node
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT node, node AS root FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.node = m.node
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM
  (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Bigrams: trigrams would need more disk than four times the input, by the sizes of their arrays; any order can be passed to fit.
ORDER = 2


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality_model.held_out(F.col("doc_id"), 10)
    model = language_model.fit(docs.where(~held_out), order=ORDER)
    scored = language_model.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_mix_sources": op2_mix_sources,
    "op3_html_text": op3_html_text,
    "op4_bpe": op4_bpe,
    "op5_quality_model": op5_quality_model,
    "op6_chat_format": op6_chat_format,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_topk": op9_topk,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_language_model": op13_language_model,
}
SQL = {"op1_url_filter": OP1_SQL, "op2_mix_sources": OP2_SQL, "op6_chat_format": OP6_SQL, "op7_warc": OP7_SQL, "op9_topk": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_hard_negatives": OP11_SQL}
