"""Registered queries over the llm operators, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm import align, chat, decontaminate, hard_negatives, license_templates, licenses, mixing, ngram_lm, pii, quality, simhash, topk, toxicity, warc
from kerbflow.llm.catalog import query
from kerbflow.llm.common import read, remainder
from kerbflow.session import materialise, shared_path

_BASE32 = """list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr({hex}, (1 + 5 * g)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '')"""

_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     h AS (SELECT page_id, strlen(body) AS payload_bytes, body, max(page_id) OVER (PARTITION BY body) AS top, sha1(body) AS hex FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32.format(hex='hex')} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM h"""


@query("op10_warc_archive", _WARC_SQL)
def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Archive of all pages, written and read back."""
    root = shared_path(spark, "warc")
    warc.write_archive(read(spark, folder, "pages", "page_id", "url", "html"), root)
    return warc.record_index(spark, root)


@query("op4_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one of control strings only, formatted and read back."""
    control = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -1L AS conv_id, t.turn, t.role, '{control}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = read(spark, folder, "conversations", "conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(materialise(chat.format_turns(turns), "chat"))


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.ints, v.ints)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op7_exact_topk", _TOPK_SQL)
def exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best others of every fiftieth vector."""
    return topk.search(read(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query("op1_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labelled documents outside one fold."""
    held_out = remainder("doc_id", 4) == 2
    documents = read(spark, folder, "documents", "doc_id", "text", "lang")
    model = toxicity.fit(documents, read(spark, folder, "labels", "doc_id", "toxic"), learn_from=~held_out)
    scored = toxicity.score(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), words=4, radius=4)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_DECON_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
     b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
     g AS (SELECT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
     n AS (SELECT DISTINCT size FROM g),
     s AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, n WHERE len(w) >= size),
     m AS (SELECT s.doc_id, s.i, s.size, g.item_id FROM s JOIN g ON g.size = s.size AND g.gram = array_to_string(s.w[s.i:s.i + s.size - 1], ' ')),
     h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op6_decontamination", _DECON_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that also stand in a benchmark window."""
    found = decontaminate.decontaminate(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: fixed patterns, and what the tagger adds."""
    found = pii.scan(read(spark, folder, "documents", "doc_id", "text"), pii.fit())
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


# Share of all words that each domain is to get: the languages' good texts, and texts of low quality.
MIX_WEIGHTS = {"en": 0.45, "de": 0.15, "fr": 0.15, "es": 0.15, "low": 0.1}


def mixing_model(documents: DataFrame, labels: DataFrame) -> mixing.Model:
    """Domains of labelled documents: the language of those of good quality, ``low`` for the others."""
    table = labels.select("doc_id", "quality").join(documents.select("doc_id", "lang"), "doc_id")
    domain = F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, F.col("lang"))
    return mixing.fit(documents, table, domain, tuple(MIX_WEIGHTS))


@query("op9_source_mixing")
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of every document under which the expected domain totals meet the target weights."""
    documents = read(spark, folder, "documents", "doc_id", "text", "lang")
    model = mixing_model(documents, read(spark, folder, "labels", "doc_id", "quality"))
    found, mix = mixing.mix_documents(documents, model, MIX_WEIGHTS, ["doc_id"])
    place = {name: i for i, name in enumerate(model.domains)}
    share = lambda name: F.round(F.col("posterior")[place[name]], 9) if name in place else F.lit(0.0)
    columns = [share(name).alias(f"p_{name}") for name in MIX_WEIGHTS]
    return found.select("doc_id", "n_words", *columns, "rate", F.lit(round(mix.residual, 6)).alias("residual"))


def _license_sql() -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {text(spdx)}, {text(statement)})" for i, (spdx, statement) in enumerate(license_templates.templates()))
    words = lambda c: f"list_filter(list_transform(regexp_split_to_array(lower({c}), '[^a-z0-9.]+'), lambda w: trim(w, '.')), lambda w: w <> '')"
    marked = lambda c: "(" + " OR ".join(f"contains({c}, '{m}')" for m in licenses.MARKERS) + ")"
    return f"""
WITH t(template, license, statement) AS (VALUES {rows}),
     tt AS (SELECT template, license, term, count(*) AS n FROM (SELECT template, license, unnest({words('statement')}) AS term FROM t) GROUP BY ALL),
     f AS (SELECT doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // 100)::VARCHAR || '/' || doc_id::VARCHAR || '.txt' AS path, coalesce(text, '') AS text FROM documents),
     fw AS (SELECT path, text, {words('text')} AS w FROM f),
     total AS (SELECT count(*) AS n FROM f),
     df AS (SELECT term, count(*) AS n FROM (SELECT path, unnest(list_distinct(w)) AS term FROM fw) WHERE term IN (SELECT term FROM tt) GROUP BY term),
     idf AS (SELECT v.term, ln((1 + total.n)::DOUBLE / (1 + coalesce(df.n, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) v CROSS JOIN total LEFT JOIN df ON df.term = v.term),
     tw AS (SELECT template, license, term, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
     seg AS (SELECT DISTINCT path, n_terms, segment FROM (SELECT path, len(w) AS n_terms, unnest(string_split(regexp_replace(lower(text), '([.!?])[ \\t\\n\\x0b\\f\\r]', '\\1' || chr(10), 'g'), chr(10))) AS segment FROM fw WHERE {marked('lower(text)')}) WHERE {marked('segment')}),
     sv AS (SELECT segment, term, count(*) AS tf FROM (SELECT segment, unnest({words('segment')}) AS term FROM (SELECT DISTINCT segment FROM seg)) GROUP BY ALL),
     sx AS (SELECT segment, sv.term, tf, tf * coalesce(idf, ln((1 + total.n)::DOUBLE) + 1) AS value FROM sv CROSS JOIN total LEFT JOIN idf ON idf.term = sv.term),
     sl AS (SELECT segment, sqrt(sum(value * value)) AS length, sum(tf) AS matched FROM sx GROUP BY segment),
     c AS (SELECT segment, license, round(sum(value * weight) / any_value(length), 9) AS score, any_value(matched) AS matched FROM sx JOIN tw USING (term) JOIN sl USING (segment) GROUP BY segment, template, license),
     m AS (SELECT segment, license, score, matched FROM c WHERE score >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY score DESC, license) = 1),
     own AS (SELECT path, arg_min(license, (-score, license)) AS license, max(score) AS score, 2 * sum(matched) >= any_value(n_terms) AS is_file FROM seg JOIN m USING (segment) GROUP BY path),
     home AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS home FROM f),
     folders AS (SELECT home AS folder, license FROM own JOIN home USING (path) WHERE is_file QUALIFY row_number() OVER (PARTITION BY home ORDER BY score DESC, license, path) = 1),
     given AS (SELECT home, folder, license FROM (SELECT DISTINCT home FROM home) JOIN folders ON home = folder OR starts_with(home, folder || '/') QUALIFY row_number() OVER (PARTITION BY home ORDER BY len(folder) DESC) = 1)
SELECT f.doc_id, coalesce(own.license, given.license) AS license, own.score AS score, CASE WHEN own.license IS NOT NULL THEN 'statement' WHEN given.license IS NOT NULL THEN 'inherited' END AS found,
       CASE WHEN own.license IS NULL THEN given.folder END AS folder
FROM f JOIN home USING (path) LEFT JOIN own USING (path) LEFT JOIN given ON given.home = home.home"""


@query("op5_license_scan", _license_sql())
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document, as a file in a directory of its source, language and hundred of ids."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    path = F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    found = licenses.scan(read(spark, folder, "documents", "doc_id", "text", "source", "lang").select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"/(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "license", "score", "found", "folder")


@query("op3_ngram_scores")
def ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a bigram model of the documents outside one fold."""
    held_out = remainder("doc_id", 7) == 2
    documents = read(spark, folder, "documents", "doc_id", "text")
    found = ngram_lm.score(documents, ngram_lm.fit(documents.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.ints, v.ints)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 50 = 0 AND v.vec_id <> a.vec_id),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op13_hard_negatives", _NEGATIVES_SQL)
def hard_negative_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; the label of every seventh row is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, folder, "embeddings", "vec_id", "embedding", "label"), F.col("vec_id") % 50 == 0, label)


@query("op12_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics of every document, and whether rules and isolation forest keep it."""
    found = quality.judge(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "labels", "doc_id", "quality"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query("op11_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers over every document."""
    found = align.align(read(spark, folder, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
