"""The queries ``opN_<name>`` of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, hmm, html, jaccard, packing, quality, store, topk, toxicity, urlfilter, warc
from quillmark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50, by integer inner product."""
    vec = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    sound = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), vec.alias("vec"))
    found = topk.exact_topk(sound, sound.where(F.col("id") % 50 == 0), k=5)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


ORACLES["op10_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(list_inner_product(q.vec, c.vec))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
  WHERE q.vec_id % 50 = 0
  GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@_query
def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url: the longest listed rule's, else the model's."""
    weights = urlfilter.trained(urlfilter.labelled_table(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, "url", weights).select("page_id", "host", "path", "rule", "verdict")


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived as a WARC record and read back."""
    found = warc.archived(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest
  FROM pages WHERE page_id IS NOT NULL
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS newest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN newest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest > page_id THEN newest END AS refers_to
FROM m
"""


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels outside fold 1 of 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.trained(docs, labels.where(toxicity.fold(F.col("doc_id"), 3) != 1), "toxic")
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether base rules and learned cutoffs keep it."""
    counts = store.saved(quality.counted(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "quality")
    cutoffs = quality.thresholds(counts, table(spark, sf_dir, "labels"), "quality", "lang")
    failed = quality.base_failed()
    return quality.judged(counts, cutoffs, "lang").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("__rejected")).alias("kept"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens."""
    found = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document's shingle set and the group of documents it links with."""
    found = jaccard.linked(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


@_query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the bytes they decode to."""
    found = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document, learned outside fold 2 of 7."""
    return hmm.scored(table(spark, sf_dir, "documents"), toxicity.fold(F.col("doc_id"), 7) == 2)


@_query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), html.trained())
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: A cutoff's bound stays within the risk exactly where so few errors at that risk are no likelier than the chance allowed.
ORACLES["op7_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w),
g AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS three FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM g WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
f AS (
  SELECT d.r, doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(hl) - len(list_distinct(hl)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(hl) AS n_lines,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_bang, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS hl FROM d) d JOIN w USING (r) LEFT JOIN rep USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (
  SELECT r, doc_id, stratum, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'bangs']) AS rule, unnest(list_transform([
    n_symbols::DOUBLE / greatest(n_words, 1) / 4.0, n_dup_lines::DOUBLE / greatest(n_lines, 1), n_repeat_words::DOUBLE / greatest(n_words, 1), n_upper::DOUBLE / greatest(n_upper + n_lower, 1), n_bang::DOUBLE / greatest(n_words, 1) / 2.0
  ], lambda x: least({quality.BINS}, floor({quality.BINS}::DOUBLE * x)))) AS score
  FROM b
), l AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT stratum, rule, score, count(*) FILTER (good <> 0) AS g, count(*) FILTER (good = 0) AS bad FROM s JOIN l USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
top AS (SELECT DISTINCT stratum FROM c),
k AS (SELECT stratum, rule, score, sum(g) OVER (PARTITION BY stratum, rule)::BIGINT AS n, sum(g) OVER o AS e, sum(bad) OVER o - {quality.COST} * sum(g) OVER o AS worth FROM c JOIN top USING (stratum) WINDOW o AS (PARTITION BY stratum, rule ORDER BY score DESC)),
cut AS (
  SELECT stratum, rule, score AS least_score FROM k
  WHERE score >= 1 AND e < n AND worth > 0
    AND list_sum(list_transform(range(0, e::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK} / 5) + (n - i) * ln(1 - {quality.RISK} / 5)))) <= (1 - {quality.CONFIDENCE}) / (5 * (SELECT count(*) FROM top))
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY worth DESC, score DESC) = 1
), bad AS (SELECT DISTINCT r FROM s JOIN cut USING (stratum, rule) WHERE score >= least_score)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM b LEFT JOIN bad USING (r)
"""


def _sql_buckets(host: str, path: str) -> str:
    def grams(text: str, tag: str) -> str:
        return f"list_transform(range(1, greatest(1, length({text}) - 1) + 1), lambda i: '{tag}' || substr('^' || {text} || '$', i, 4))"

    return f"list_sort(list_distinct(list_transform(list_concat({grams(host, 'h')}, {grams(path, 'p')}), lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % {urlfilter.BUCKETS})))"


def _sql_parts(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


def _sql_rules(column: str) -> str:
    made = "NULL"
    for say, host, path in sorted(urlfilter.RULES, key=lambda r: len(r[1]) + len(r[2])):
        made = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{say if column == 'verdict' else host + path}' ELSE {made} END"
    return made


_MARGIN = "w[-1] + coalesce(list_sum(list_transform(own, lambda b: w[b + 1])), 0) / sqrt(greatest(len(own), 1))"
ORACLES["op3_urlfilter"] = f"""
WITH RECURSIVE labelled(url, y) AS (VALUES {', '.join(f"('{u}', {y}::DOUBLE)" for u, y in urlfilter.LABELLED)}),
x AS (SELECT row_number() OVER (ORDER BY md5(url)) - 1 AS k, count(*) OVER () AS many, y, {_sql_buckets('host', 'path')} AS own FROM (SELECT url, y, {_sql_parts('url')} FROM labelled)),
fit(n, w) AS (
  SELECT 0::BIGINT, list_transform(range({urlfilter.BUCKETS + 1}), lambda i: 0::DOUBLE)
  UNION ALL
  SELECT n + 1, list_transform(w, lambda v, i: v * (1 - {urlfilter.RATE} * {urlfilter.DECAY})::DOUBLE + CASE WHEN i = {urlfilter.BUCKETS + 1} THEN {urlfilter.BIAS_STEP} * slope WHEN list_contains(own, i - 1) THEN slope / sqrt(len(own)) ELSE 0 END)
  FROM (SELECT n, w, own, {urlfilter.RATE}::DOUBLE * (y - 1 / (1 + exp(-({_MARGIN})))) AS slope FROM fit JOIN x ON x.k = n % many WHERE n < {urlfilter.EPOCHS} * many)
), model AS (SELECT w FROM fit ORDER BY n DESC LIMIT 1),
p AS (SELECT page_id, {_sql_parts("coalesce(url, '')")} FROM pages)
SELECT page_id, host, path, {_sql_rules('rule')} AS rule, coalesce({_sql_rules('verdict')}, CASE WHEN 1 / (1 + exp(-({_MARGIN}))) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, {_sql_buckets('host', 'path')} AS own FROM p), model
"""


#: On these tables the main text is what stands in the article element, whose only blocks are headings and paragraphs.
_PIECE = "replace(replace(replace(replace(regexp_replace(s, '<[a-z/][^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ORACLES["op4_html"] = f"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), lambda s: trim(regexp_replace({_PIECE}, '\\s+', ' ', 'g'))), lambda s: s <> ''), chr(10)) AS text
  FROM pages)
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op1_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT r.root, e.y FROM reach r JOIN e ON e.x = r.doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(root) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(g)
"""
