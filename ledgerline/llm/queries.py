"""One query per training-data operator, with production parameters over whole tables; ORACLES where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe import decode_ids, encode_texts
from ledgerline.llm.collocations import collocations
from ledgerline.llm.common import in_fold, table
from ledgerline.llm.decontaminate import digests, find_passages
from ledgerline.llm.langid import identify
from ledgerline.llm.lm import score_texts
from ledgerline.llm.mixing import mix
from ledgerline.llm.pii import find_pii, written_out
from ledgerline.llm.ranked import ranked_documents
from ledgerline.llm.simhash import near_duplicates
from ledgerline.llm.topk import quantised, top_k
from ledgerline.llm.toxicity import score_toxicity
from ledgerline.llm.url_filter import judge_urls, rule_frame
from ledgerline.llm.warc import capture_histories, page_captures


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capture_histories(page_captures(table(spark, sf_dir, "pages")), least_bytes=1000)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP1_SQL = """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload, url FROM pages),
best AS (SELECT payload, max(page_id) AS keep FROM page WHERE octet_length(payload) >= 1000 GROUP BY payload)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to,
       array_to_string(list_reverse(string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS url_key,
       1704067200 + page_id % 31536000 AS captured
FROM page LEFT JOIN best USING (payload)
"""


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"), ~in_fold(F.col("doc_id"), 5, 1))
    return out.select("doc_id", (~F.col("learnt_from")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), ~in_fold(F.col("doc_id"), 3, 1))
    return out.select("doc_id", (~F.col("learnt_from")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


OP5_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
test AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS run
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM test),
place AS (
  SELECT row_no, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS run
  FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)),
found AS (SELECT row_no, i, size, item FROM place JOIN test USING (size, run)),
hit AS (SELECT row_no, count(DISTINCT pos) AS n_hit FROM (SELECT row_no, unnest(range(i, i + size)) AS pos FROM found) GROUP BY row_no),
own AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM found WHERE item IS NOT NULL) GROUP BY row_no)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (row_no) LEFT JOIN own USING (row_no)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 5, 0))
    return out.select("kept.doc_id", (~F.col("learnt_from")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_frame(spark, URL_RULES))


OP8_SQL = """
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
page AS (
  SELECT row_number() OVER () AS row_no, page_id,
         translate(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ranked AS (
  SELECT page.*, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC) AS n
  FROM page LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""


MIX_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def labelled_languages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that labels has."""
    return documents.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs.select("doc_id", "text"), labelled_languages(docs, table(spark, sf_dir, "labels")), MIX_WEIGHTS, ["doc_id"])
    return out.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.col("mix_domain").alias("domain"), F.col("mix_posterior").alias("posterior"), F.col("mix_rate").alias("rate"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written_out("base"), 256).alias("base_sha256"), written_out("spans").alias("spans"))


#: The tokenizer's file, of the installed package of public vocabularies.
TOKENIZER = "byte_bpe_50k.json"


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    out = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), max_n=4, least=30, covered=80, most=2000)


OP12_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM piece, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size))
  GROUP BY ALL),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE size > 1 AND f >= 30),
cut AS (SELECT *, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, size), ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (
  SELECT cut.lang, cut.phrase, a, h.f AS l, t.f AS r, k, CAST((CAST(a AS HUGEINT) * 2000000) // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cut JOIN gram h ON h.lang = cut.lang AND h.phrase = head JOIN gram t ON t.lang = cut.lang AND t.phrase = tail),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN
    (SELECT lang, a, array_to_string(list_slice(w, i, i + len - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, size - len + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS len FROM cand WHERE size > 2))) b
  ON b.lang = c.lang AND b.phrase = c.phrase AND 100 * CAST(b.a AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
own AS (SELECT row_no, doc_id, len(w) AS n FROM doc WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM own),
tf AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(w) AS term FROM doc) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, row_no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN own USING (row_no), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_topk": op2_topk,
    "op3_lm_score": op3_lm_score,
    "op4_langid": op4_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_bpe": op11_bpe,
    "op12_collocations": op12_collocations,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op1_warc_index": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_url_filter": OP8_SQL,
    "op12_collocations": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
