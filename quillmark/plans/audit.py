"""Queries of audits and of relational rules: references, set equality, weighted coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import duck as D
from quillmark.functions import text as T
from quillmark.operators import audits, lines, profile
from quillmark.operators.claims import coverage
from quillmark.plans.catalog import query
from quillmark.sources.tables import table

_NODES = """(SELECT l_orderkey AS fixture, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_linenumber % 5 AS node_id, l_partkey % 9 > 0 AS visible, l_partkey % 3 = 0 AS interactive,
  l_suppkey % 4 > 0 AS focusable, l_suppkey % 7 > 0 AS visible_focus, CASE WHEN l_partkey % 2 = 0 THEN l_quantity / 8 END AS contrast, l_partkey % 10 = 0 AS large_text, l_quantity AS width, l_quantity + 3 AS height,
  CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 6 + 1 END AS heading, CASE WHEN l_partkey % 4 > 0 THEN l_returnflag ELSE ' ' END AS name FROM lineitem)"""
_RULES = [
    ("repeated", "E"), ("visible AND interactive AND trim(name) = ''", "E"), ("visible AND interactive AND NOT focusable", "E"), ("visible AND focusable AND NOT visible_focus", "E"),
    ("visible AND contrast < CASE WHEN large_text THEN 3.0 ELSE 4.5 END", "E"), ("visible AND interactive AND (width < 24 OR height < 24)", "W"), ("visible AND heading > before + 1", "W"),
]


def _sum(kind: str) -> str:
    return " + ".join(f"coalesce(({rule})::INTEGER, 0)" for rule, k in _RULES if k == kind)


@query(f"""
WITH n AS {_NODES}, x AS (SELECT *, row_number() OVER (PARTITION BY fixture, node_id ORDER BY pos) > 1 AS repeated, last_value(CASE WHEN visible THEN heading END IGNORE NULLS) OVER (PARTITION BY fixture ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n),
s AS (SELECT fixture, sum({_sum('E')})::BIGINT AS errors, sum({_sum('W')})::BIGINT AS warnings FROM x GROUP BY fixture)
SELECT *, greatest(0, 100 - errors * 18 - warnings * 6) AS score, errors = 0 AND greatest(0, 100 - errors * 18 - warnings * 6) >= 80 AS passed FROM s
""")
def a11y_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order read as a rendered tree, its lines as nodes."""


    q = F.col
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    nodes = table(spark, sf_dir, "lineitem").select(
        q("l_orderkey").alias("fixture"), pos.alias("pos"), (q("l_linenumber") % 5).alias("node_id"), (q("l_partkey") % 9 > 0).alias("visible"), (q("l_partkey") % 3 == 0).alias("interactive"),
        (q("l_suppkey") % 4 > 0).alias("focusable"), (q("l_suppkey") % 7 > 0).alias("visible_focus"), F.when(q("l_partkey") % 2 == 0, q("l_quantity") / 8).alias("contrast"), (q("l_partkey") % 10 == 0).alias("large_text"),
        q("l_quantity").alias("width"), (q("l_quantity") + 3).alias("height"), F.when(q("l_suppkey") % 3 == 0, q("l_partkey") % 6 + 1).alias("heading"), F.when(q("l_partkey") % 4 > 0, q("l_returnflag")).otherwise(" ").alias("name"),
    )
    return audits.accessibility_score(audits.accessibility(nodes))


_CONTROLS = [
    ("s_suppkey % 5 = 0", "document-worker-no-network"), ("s_suppkey % 7 = 0", "document-worker-non-root"), ("s_suppkey % 11 = 0", "document-worker-read-only"), ("s_suppkey % 13 = 0", "document-worker-resource-limits"),
    ("20 + s_suppkey % 6 > 24", "retention-24h"), ("s_acctbal < 0", "metadata-only-logs"), ("s_nationkey % 2 = 0 AND s_suppkey % 3 = 0", "audio-delete"), ("s_suppkey % 17 = 0", "pii-redaction"), ("s_suppkey % 19 = 0", "skill-static-allowlist"),
    ("s_suppkey % 23 = 0", "skill-secret-isolation"), ("s_suppkey % 29 = 0", "prompt-permission-boundary"),
]


@query(f"""
SELECT s_suppkey AS id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _CONTROLS)}) AS found, greatest(0, 100 - 14 * ({' + '.join(f'({c})::INTEGER' for c, _ in _CONTROLS)})) AS score,
  NOT ({' OR '.join(f'({c})' for c, _ in _CONTROLS)}) AS passed FROM supplier
""")
def security_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier read as a security profile."""
    q, k = F.col, F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.when(k % 5 == 0, "egress").otherwise("none").alias("network"), (k % 7 == 0).alias("root"), (k % 11 != 0).alias("read_only"), (k % 13 != 0).alias("limits"), (20 + k % 6).alias("retention_hours"),
        (q("s_acctbal") < 0).alias("raw_logs"), F.when(q("s_nationkey") % 2 == 0, "transient").otherwise("none").alias("audio"), (k % 3 != 0).alias("audio_deleted"), (k % 17 != 0).alias("redacted"), (k % 19 != 0).alias("allowlist"),
        (k % 23 == 0).alias("secrets"), (k % 29 == 0).alias("grants"),
    )
    return audits.security(rows)


@query("""
WITH c AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'warn' ELSE 'pass' END AS s, l_linenumber <= 2 AS blocking FROM lineitem),
n AS (SELECT id, CASE WHEN s = 'fail' AND NOT blocking THEN 'warn' ELSE s END AS s FROM c), g AS (SELECT id, count(*) FILTER (s = 'fail') AS fails, count(*) FILTER (s = 'warn') AS warns FROM n GROUP BY id)
SELECT *, greatest(0, 100 - 22 * fails - 5 * warns) AS score, CASE WHEN fails > 0 THEN 'blocked' WHEN greatest(0, 100 - 22 * fails - 5 * warns) >= 85 THEN 'pass' ELSE 'review' END AS gate FROM g
""")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order read as an export report, its lines as checks."""
    q = F.col
    status = F.when(q("l_returnflag") == "R", "fail").when(q("l_returnflag") == "A", "warn").otherwise("pass")
    return audits.export_gate(table(spark, sf_dir, "lineitem").select(q("l_orderkey").alias("id"), status.alias("status"), (q("l_linenumber") <= 2).alias("blocking")))


@query("""
WITH a AS (SELECT event_type AS suite, event_id // 4 AS fixture, json_extract_string(props, '$.k') AS v, ['exists', 'equals', 'contains', 'not_contains', 'gte', 'lte'][event_id % 6 + 1] AS op, (event_id % 90)::VARCHAR AS e FROM events),
p AS (SELECT suite, fixture, coalesce(CASE op WHEN 'exists' THEN v IS NOT NULL WHEN 'equals' THEN v = e WHEN 'contains' THEN contains(v, e) WHEN 'not_contains' THEN NOT contains(v, e) WHEN 'gte' THEN v::DOUBLE >= e::DOUBLE ELSE v::DOUBLE <= e::DOUBLE END, false) AS ok FROM a),
f AS (SELECT suite, fixture, count(*) AS n, count(*) FILTER (ok) AS k FROM p GROUP BY ALL)
SELECT suite, count(*) AS fixtures, count(*) FILTER (n = k) AS passed_fixtures, sum(n)::BIGINT AS assertions, sum(k)::BIGINT AS passed, floor(sum(k) / sum(n) * 100 * 10.0 + 0.5) / 10.0 AS rate FROM f GROUP BY suite
""")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions on the events' JSON, rolled up to fixtures and suites."""
    q = F.col
    op = F.get(F.array(*map(F.lit, ["exists", "equals", "contains", "not_contains", "gte", "lte"])), (q("event_id") % 6).cast("int"))
    passed = audits.asserted(F.get_json_object("props", "$.k"), op, (q("event_id") % 90).cast("string"))
    return audits.suite_rollup(table(spark, sf_dir, "events").select(q("event_type").alias("suite"), F.expr("event_id div 4").alias("fixture"), passed.alias("passed")))


@query("SELECT o_orderpriority AS grp, floor(sum(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END) / nullif(sum(o_totalprice), 0.0) * 100 * 10.0 + 0.5) / 10.0 AS coverage FROM orders GROUP BY 1")
def weighted_coverage_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted coverage of orders by priority: finished ones count fully, partial ones half."""


    status = F.when(F.col("o_orderstatus") == "F", "met").when(F.col("o_orderstatus") == "P", "partial").otherwise("gap")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(coverage(status, F.col("o_totalprice")).alias("coverage"))


@query("""
SELECT 'known' AS kind, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)
UNION ALL SELECT 'unknown', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)
""")
def semi_anti_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that exist and that do not, by semi and anti joins."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    parts = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    counts = [items.join(parts, "k", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, how in (("known", "left_semi"), ("unknown", "left_anti"))]
    return counts[0].unionByName(counts[1])


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer)
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_left, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_right
""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys each of two sets has alone; the sets are equal if none, in one pass over both."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    rows = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return rows.agg(F.count_if(F.col("a") > F.col("b")).alias("only_left"), F.count_if(F.col("b") > F.col("a")).alias("only_right"))


_HEADS = ["Work Experience", "EDUCATION:", "Core-Skills", "项目经历", "Plain line 2020.04 - 2021.05", "a.b@c.com", "+86 13812345678", "• did things", "Profile | Summary"]
_HEAD_SQL = f"([{', '.join(map(D.lit, _HEADS))}])[doc_id % {len(_HEADS)} + 1]"
_KEY_SQL = f"regexp_replace(lower({D.normalize('t')}), '[{T.SPACE}:：|｜/\\\\\\-_]+', '', 'g')"


_TITLES = ["Intern analyst", "Junior dev", "Senior engineer", "Team lead", "VP sales", "Clerk"]


@query(f"""
WITH w AS (SELECT doc_id, regexp_split_to_array(coalesce(text, '') || chr(10) || {_HEAD_SQL} || chr(10) || ([{', '.join(map(D.lit, _TITLES))}])[doc_id % {len(_TITLES)} + 1], '\\r?\\n') AS ts FROM documents),
l AS (SELECT doc_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS t FROM w), k AS (SELECT *, {_KEY_SQL} AS k FROM l)
SELECT doc_id, pos, CASE k {' '.join(f"WHEN {D.lit(n.replace(' ', ''))} THEN '{kind}'" for kind, names in lines.SECTION_NAMES.items() for n in names)} END AS section,
  {profile.sql_role('t', '(doc_id % 50) / 50.0', '400 + doc_id % 4 * 100')} AS role, nullif(regexp_extract(t, '{lines.DATE}'), '') AS first_date, {profile.sql_seniority(D.normalize('t'))} AS seniority FROM k
""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section, role, date and seniority of every line of every document.

    An example line, chosen by doc_id, is added after the last line of each document,
    and a job title after it. Vertical place and weight are derived from doc_id.
    """
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs)).cast("int"))
    whole = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(_HEADS), F.lit("\n"), pick(_TITLES))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(whole, "\r?\n")).alias("pos", "t"))
    date = F.regexp_extract("t", lines.DATE, 0)
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), lines.section_type(F.col("t")).alias("section"), profile.role(F.col("t"), (F.col("doc_id") % 50) / 50.0, 400 + F.col("doc_id") % 4 * 100).alias("role"), F.when(date != "", date).alias("first_date"), profile.seniority(F.col("t")).alias("seniority"))
