"""Queries of the small rules, on values that the tables hold or that are derived from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import duck as D
from quillmark.functions import text as T
from quillmark.functions import unicode
from quillmark.operators import lines, profile, rules, safety
from quillmark.plans.catalog import query
from quillmark.sources.tables import table


def _pick(values: list[str | None], by: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.expr(by) % len(values)).cast("int"))


def _sql_pick(values: list[str | None], by: str) -> str:
    return f"([{', '.join('NULL' if v is None else D.lit(v) for v in values)}])[({by}) % {len(values)} + 1]"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


_TURNS = "(SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)"
_BEFORE = "(SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT ON (conv_id, turn) * FROM " + _TURNS + " ORDER BY conv_id, turn, text))"


def _before(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _turns(spark, sf_dir).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return rows.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))


_TERMS = "list_concat(regexp_extract_all(t, '{a}'), list_transform(regexp_extract_all(t, '{b}'), lambda x: regexp_replace(x, '\\s+', '', 'g')), regexp_extract_all(t, '\\b\\d+(?:\\.\\d+)?%?\\b'))".format(a=rules.TECHNICAL, b=rules.MEASURED)


@query(f"""
SELECT conv_id, turn, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, {rules.MOST_TERMS}), '|') AS terms
FROM (SELECT conv_id, turn, {_TERMS} AS l FROM (SELECT conv_id, turn, text || ' Kafka 12 ms 40% C++' AS t FROM {_TURNS}))
""")
def preserve_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every turn that a rewrite must keep; a few are appended, as the driver's turns hold hardly any."""
    text = F.concat("text", F.lit(" Kafka 12 ms 40% C++"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(rules.preserved_terms(text), "|").alias("terms"))


_FONTS = ["ABCDEF+Helvetica-Bold", "Roboto Extra-Light Italic", "Source SemiBold", "Arial Black Oblique", "", "Inter Thin", "Lato Medium", "UltraBold", None, "Noto Light", "Serif", "Demi Bold Italic", "Heavy"]


@query(f"""
SELECT p_partkey, CASE WHEN length(f) > 0 THEN CASE {' '.join(f"WHEN regexp_matches(regexp_replace(lower(f), '[^a-z0-9]+', '', 'g'), '{'|'.join(p)}') THEN {w}" for p, w in rules.FONT_WEIGHTS)} ELSE {rules.PLAIN_WEIGHT} END END AS weight,
  CASE WHEN length(f) > 0 THEN CASE WHEN contains(lower(f), 'italic') OR contains(lower(f), 'oblique') THEN 'italic' ELSE 'normal' END END AS style
FROM (SELECT p_partkey, {_sql_pick(_FONTS, 'p_partkey')} AS f FROM part)
""")
def font_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and style of a font name for every part."""
    return table(spark, sf_dir, "part").withColumn("f", _pick(_FONTS, "p_partkey")).select("p_partkey", rules.font_weight(F.col("f")).alias("weight"), rules.font_style(F.col("f")).alias("style"))


_STARTS, _ENDS = ["2019.03", "", None, "2020"], ["2021.05", None, ""]


@query(f"""
SELECT o_orderkey, CASE WHEN s IS NULL AND e IS NULL THEN '' ELSE concat_ws(' - ', s, coalesce(e, CASE WHEN o_orderstatus = 'O' THEN '至今' END)) END AS "date"
FROM (SELECT o_orderkey, o_orderstatus, nullif({_sql_pick(_STARTS, 'o_orderkey')}, '') AS s, nullif({_sql_pick(_ENDS, 'o_custkey')}, '') AS e FROM orders)
""")
def entry_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span to show for every order read as an entry."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.entry_date(_pick(_STARTS, "o_orderkey"), _pick(_ENDS, "o_custkey"), F.col("o_orderstatus") == "O").alias("date"))


_HEADLINES = ["求职意向：旧岗位", "Target role: Clerk", "Analyst", None, "目标岗位 : x", "  "]


@query(f"SELECT c_custkey, regexp_extract(trim(coalesce({_sql_pick(_HEADLINES, 'c_custkey')}, '')), '{rules.TARGET_LABEL}', 1) || trim(c_mktsegment) AS headline FROM customer")
def target_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's headline for a title, keeping a label."""
    return table(spark, sf_dir, "customer").select("c_custkey", rules.headline(_pick(_HEADLINES, "c_custkey"), F.col("c_mktsegment")).alias("headline"))


_LOCALES = ["en-US", "mixed", "zh-CN"]


@query(f"""
SELECT conv_id, turn, CASE l WHEN 'en-US' THEN latin AND NOT han WHEN 'mixed' THEN han AND latin ELSE han END AS fits FROM (
  SELECT conv_id, turn, {_sql_pick(_LOCALES, 'conv_id')} AS l, regexp_matches(t, '\\p{{Han}}') AS han, regexp_matches(t, '\\p{{Latin}}') AS latin FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN '请说明' ELSE '' END AS t FROM {_TURNS}))
""")
def prompt_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every turn's scripts fit a locale; every other turn gets a Han phrase."""
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, "请说明").otherwise(""))
    return _turns(spark, sf_dir).select("conv_id", "turn", rules.locale_fits(text, _pick(_LOCALES, "conv_id")).alias("fits"))


@query("SELECT l_orderkey, l_linenumber, least(99, floor(1 + 98 * (1 - (1 - s) * (1 - s))))::BIGINT AS percent FROM (SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, l_quantity::DOUBLE / 40.0)) AS s FROM lineitem)")
def estimated_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress to show for every order line's share of the time."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.progress(F.col("l_quantity").cast("double") / 40.0).alias("percent"))


@query("SELECT event_id, coalesce(try_cast(nullif(regexp_extract('llm.eval@' || (event_id % 4) || '.' || (event_id % 7), '^llm\\.eval@(\\d+)\\.', 1), '') AS INTEGER) >= 2, false) AND event_id % 5 > 0 AS enhanced FROM events")
def version_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every event's source version is of the second major or later; a fifth are of another capability."""
    name = F.when(F.col("event_id") % 5 > 0, "llm.eval@").otherwise("llm-eval@")
    return table(spark, sf_dir, "events").select("event_id", rules.enhanced(F.concat(name, F.col("event_id") % 4, F.lit("."), F.col("event_id") % 7), "llm.eval").alias("enhanced"))


@query("""
SELECT o_orderkey, least(coalesce(epoch_ms(try_cast(d AS TIMESTAMP)), n + 86400000), n + 86400000) AS expires FROM (
  SELECT o_orderkey, epoch_ms(o_orderdate::TIMESTAMP) AS n, CASE o_orderkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN NULL WHEN 2 THEN strftime(o_orderdate::DATE, '%Y-%m-%d') || ' 07:30:00' ELSE '2099-01-01 00:00:00' END AS d FROM orders)
""")
def bounded_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When every order's record ends, by a declared time that may be no time or too late."""
    day = F.col("o_orderdate").cast("date")
    declared = F.when(F.col("o_orderkey") % 4 == 0, "never").when(F.col("o_orderkey") % 4 == 1, F.lit(None)).when(F.col("o_orderkey") % 4 == 2, F.concat(day.cast("string"), F.lit(" 07:30:00"))).otherwise("2099-01-01 00:00:00")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.expiry(declared, F.unix_millis(day.cast("timestamp"))).alias("expires"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 and UTF-8 length of every document."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


@query(f"SELECT conv_id, turn, length({D.normalize('text')}) >= 2 AND ({D.normalize('text')}) IS DISTINCT FROM ({D.normalize('before')}) AS valid FROM {_BEFORE}")
def evidence_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every turn says something else than the turn before it."""
    return _before(spark, sf_dir).select("conv_id", "turn", rules.answers_differently(F.col("text"), F.col("before")).alias("valid"))


_CANDIDATES = ([None, "Why? ", ""], ["How?", " Why?", "When?"], ["When?", "How?"])
_ASKED = [[], ["Why?"], ["Why?", "How?"], ["When?"]]


@query(f"""
SELECT user_id, event_id, CASE WHEN len(asked) < event_id % 3 THEN list_filter(list_transform([{', '.join(_sql_pick(c, f'event_id // {i + 1}') for i, c in enumerate(_CANDIDATES))}], lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '' AND NOT list_contains(asked, x))[1] END AS prompt
FROM (SELECT *, ([{', '.join('[' + ', '.join(map(D.lit, a)) + ']::VARCHAR[]' for a in _ASKED)}])[user_id % {len(_ASKED)} + 1] AS asked FROM events)
""")
def next_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next follow-up of every event read as an evaluated answer."""
    asked = F.get(F.array(*[F.array(*map(F.lit, a)).cast("array<string>") for a in _ASKED]), (F.col("user_id") % len(_ASKED)).cast("int"))
    candidates = F.array(*[_pick(c, f"event_id div {i + 1}") for i, c in enumerate(_CANDIDATES)])
    return table(spark, sf_dir, "events").select("user_id", "event_id", rules.next_follow_up(candidates, asked, F.col("event_id") % 3).alias("prompt"))


@query("SELECT l_orderkey AS plan, coalesce(min(l_linenumber) FILTER (l_returnflag = 'N' OR l_linestatus = 'F' AND l_orderkey % 2 > 0), count(*))::BIGINT AS cursor FROM lineitem GROUP BY l_orderkey")
def question_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next question of every order read as an interview plan."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("long").alias("idx"), (F.col("l_returnflag") != "N").alias("evaluated"), ((F.col("l_linestatus") == "F") & (F.col("l_orderkey") % 2 > 0)).alias("pending"))
    return rules.question_cursor(rows, F.lit(2))


def _sql_grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - k + 2), lambda i: substr({x}, i, k)))"


@query(f"""
SELECT conv_id, turn, round(CASE WHEN least(length(a), length(b)) = 0 THEN 0.0 WHEN a = b THEN 1.0 WHEN least(length(a), length(b)) >= 8 AND (contains(a, b) OR contains(b, a)) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b))
  ELSE 2.0 * len(list_intersect({_sql_grams('a')}, {_sql_grams('b')})) / (len({_sql_grams('a')}) + len({_sql_grams('b')})) END, 9) AS similarity
FROM (SELECT conv_id, turn, a, b, least(3, length(a), length(b)) AS k FROM (SELECT conv_id, turn, regexp_replace(lower(text), '[\\p{{P}}\\p{{S}}{T.SPACE}]+', '', 'g') AS a, regexp_replace(lower(coalesce(before, '')), '[\\p{{P}}\\p{{S}}{T.SPACE}]+', '', 'g') AS b FROM {_BEFORE}))
""")
def question_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike every turn is to the one before."""
    a, b = rules.compacted(F.col("text")), rules.compacted(F.coalesce("before", F.lit("")))
    rows = _before(spark, sf_dir).select("conv_id", "turn", a.alias("a"), b.alias("b"))
    return rows.select("conv_id", "turn", F.round(rules.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(trim(regexp_replace(lower(nfc_normalize(text)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '))) AS token FROM {_TURNS}) WHERE token <> '' GROUP BY token")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many turns each search token stands; tokens are of compatibility forms."""
    words = F.array_distinct(F.split(rules.search_key(unicode.nfkc(F.col("text"))), " "))
    return _turns(spark, sf_dir).select(F.explode(words).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {safety.sql_exportable('text')} AS text FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN chr(8203) || chr(7) || 'a' || chr(57344) || '□' ELSE '' END AS text FROM documents)")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it may be exported; a third get characters that cannot be."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\u200b\x07a\ue000□").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", safety.exportable(text).alias("text"))


_FILES = ["/tmp/a b.pdf", "C:\\docs\\cv.pdf", "", None, "x/" + "n" * 200 + ".pdf", "tab\there.pdf", "dir/"]


@query(f"""
SELECT s_suppkey, left(CASE WHEN c = '' THEN '{rules.FILE_DEFAULT}' ELSE c END, {rules.FILE_MOST}) AS name FROM (SELECT s_suppkey, replace(regexp_extract(replace(coalesce(nullif({_sql_pick(_FILES, 's_suppkey')}, ''), '{rules.FILE_DEFAULT}'), '\\', '/'), '([^/]*)/*$', 1), chr(9), '') AS c FROM supplier)
""")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which every supplier's file is kept."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.file_name(_pick(_FILES, "s_suppkey")).alias("name"))


_LINES_TEXT = "coalesce(text, '') || chr(10) || 'Work Experience' || chr(10) || '2019.03 - 2020.01 A' || chr(10) || 'did x' || chr(10) || '2020.02 - present B' || chr(10) || 'EDUCATION:' || chr(10) || '2015'"
_EXTRA = "\nWork Experience\n2019.03 - 2020.01 A\ndid x\n2020.02 - present B\nEDUCATION:\n2015"
_L = f"(SELECT doc_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS t FROM (SELECT doc_id, regexp_split_to_array({_LINES_TEXT}, '\\r?\\n') AS ts FROM documents))"
_KIND = "CASE regexp_replace(lower(" + D.normalize("t") + f"), '[{T.SPACE}:：|｜/\\\\\\-_]+', '', 'g') " + " ".join(f"WHEN {D.lit(n.replace(' ', ''))} THEN '{kind}'" for kind, names in lines.SECTION_NAMES.items() for n in names) + " END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.coalesce("text", F.lit("")), F.lit(_EXTRA))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(whole, "\r?\n")).alias("pos", "t")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""
WITH l AS (SELECT *, {_KIND} AS type, regexp_matches(t, '{lines.DATE}') AS dated FROM {_L}),
s AS (SELECT *, count(type) OVER w AS section, last_value(type IGNORE NULLS) OVER w AS kind FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, pos, section, kind, type IS NOT NULL AS heading, CASE WHEN type IS NULL THEN greatest(count(*) FILTER (dated AND type IS NULL) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1, 0) END AS entry FROM s
""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section and entry of every line of every document, after which a small résumé is appended."""
    return rules.structured(_lines(spark, sf_dir), "doc_id").select("doc_id", "pos", "section", "kind", "heading", "entry")


_PLAIN = f"NOT regexp_matches(t, '{rules.EMAIL}|{rules.MOBILE}|{rules.URL}') AND NOT regexp_matches(t, '{lines.DATE}') AND trim(t) <> '' AND length(t) <= {rules.HEADLINE_MOST}"


def _sql_first(pattern: str) -> str:
    return f"arg_min(regexp_extract(t, '{pattern}'), pos) FILTER (regexp_matches(t, '{pattern}'))"


@query(f"""
WITH l AS (SELECT *, count({_KIND}) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM {_L}),
c AS (SELECT *, section = 0 AND {_PLAIN} AS candidate FROM l),
n AS (SELECT *, min(pos) FILTER (candidate AND length(t) <= {rules.NAME_MOST}) OVER (PARTITION BY doc_id) AS named FROM c)
SELECT doc_id, email, regexp_replace(phone, '^[^0-9+]|[^0-9]$', '', 'g') AS phone, url, name, headline, CASE WHEN contains(url, 'linkedin') THEN 'LinkedIn' WHEN contains(url, 'github') THEN 'GitHub' WHEN url IS NOT NULL THEN 'Link' END AS label
FROM (SELECT doc_id, {_sql_first(rules.EMAIL)} AS email, {_sql_first(rules.MOBILE)} AS phone, {_sql_first(rules.URL)} AS url, min(t) FILTER (pos = named) AS name, arg_min(t, pos) FILTER (candidate AND pos IS DISTINCT FROM named) AS headline FROM n GROUP BY doc_id)
""")
def contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address, number, link, name and headline of every document, read as a résumé."""
    return rules.contacts(_lines(spark, sf_dir), "doc_id")


_GIVEN = ["unknown", "caption", None, "footer"]


@query(f"""
SELECT doc_id, role, count(*) AS n FROM (SELECT doc_id, CASE WHEN {_KIND} IS NOT NULL THEN 'heading' WHEN regexp_matches(t, '{profile.CONTACT}') THEN 'contact' WHEN regexp_matches(t, '{profile.BULLET}') THEN 'list-item' WHEN g <> 'unknown' THEN g ELSE 'paragraph' END AS role
FROM (SELECT *, {_sql_pick(_GIVEN, 'pos')} AS g FROM {_L})) GROUP BY ALL
""")
def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document have each role, where what a line is goes before the role it was given."""
    role = rules.merged_role(lines.section_type(F.col("t")).isNotNull(), F.col("t").rlike(profile.CONTACT), F.col("t").rlike(profile.BULLET), _pick(_GIVEN, "pos"))
    return _lines(spark, sf_dir).select("doc_id", role.alias("role")).groupBy("doc_id", "role").agg(F.count("*").alias("n"))


@query(f"""
WITH l AS (SELECT conv_id * 1000 + turn AS id, {D.normalize('text')} AS k FROM {_TURNS})
SELECT id, (SELECT min(m.id) FROM l m WHERE m.k = l.k) AS claim FROM l
""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn the least turn with the same text, white space aside."""
    rows = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rules.first_equal(rows, rows.withColumnRenamed("id", "claim")).select("id", "claim")


@query("""
SELECT o_custkey AS grp, list(o_orderkey ORDER BY o_orderdate, o_orderkey)::VARCHAR AS before, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)::VARCHAR AS after
FROM orders GROUP BY o_custkey HAVING list(o_orderkey ORDER BY o_orderdate, o_orderkey) <> list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)
""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders by worth come in another order than by date, with both orders."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice")
    found = rules.order_changes(rows, "grp", [F.col("o_orderdate")], [(-F.col("o_totalprice")).alias("p")])
    return found.select("grp", *[F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")).alias(c) for c in ("before", "after")])


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus = 'O' AND o_custkey % 2 = 0 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0
""")
def one_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as suggestions that may be taken at once."""
    q, k = F.col, F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k, F.when(k % 3 > 0, "ai").otherwise("rules").alias("source"), F.when(q("o_orderstatus") == "O", "pending").otherwise("accepted").alias("status"), (q("o_custkey") % 2).alias("revision"), F.lit(0).alias("current"),
        F.lit("rewrite").alias("kind"), F.when(k % 5 > 0, "new").otherwise(" ").alias("proposed"), F.lit("old").alias("original"), F.lit(0).alias("before_hash"), F.when(k % 7 > 0, 0).otherwise(1).alias("now_hash"),
    )
    return rules.one_click(rows).select("o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'stale' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'accepted' END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 > 0 THEN 9 ELSE o_custkey % 9 END AS revision FROM orders
""")
def suggestion_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as suggestions, after an edit that changed the text under a quarter of them."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.when(F.col("o_orderstatus") == "O", "pending").otherwise("accepted").alias("status"), (F.col("o_custkey") % 9).alias("revision"), F.lit(9).alias("current"), F.lit("a").alias("before_hash"), F.when(k % 4 > 0, "a").alias("now_hash"))
    return rules.rebound(rows).select("o_orderkey", "status", F.col("revision").cast("long").alias("revision"))


@query(f"""
SELECT grp, n > 0 AND visible >= {rules.PAGE_VISIBLE} AND strong >= {rules.PAGE_STRONG} AND range >= {rules.PAGE_RANGE} AND deviation >= {rules.PAGE_DEVIATION} AS page, n > 0 AND range >= {rules.TEXT_RANGE} AND deviation >= {rules.TEXT_DEVIATION} AS "text"
FROM (SELECT l_suppkey % 50 AS grp, count(*) AS n, avg((l_discount >= 0.09)::INTEGER) AS visible, avg((l_tax >= 0.08)::INTEGER) AS strong, max(l_quantity) - min(l_quantity) AS range, stddev_pop(l_quantity) AS deviation FROM lineitem WHERE l_suppkey % 50 < l_linenumber * 10 GROUP BY 1)
""")
def visual_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether groups of order lines, read as pixels, have anything to see."""
    q = F.col
    rows = table(spark, sf_dir, "lineitem").withColumn("grp", q("l_suppkey") % 50).where("grp < l_linenumber * 10").groupBy("grp")
    rows = rows.agg(F.count("*").alias("n"), F.avg((q("l_discount") >= 0.09).cast("int")).alias("visible"), F.avg((q("l_tax") >= 0.08).cast("int")).alias("strong"), (F.max("l_quantity") - F.min("l_quantity")).alias("range"), F.stddev_pop("l_quantity").alias("deviation"))
    return rows.select("grp", rules.visible_page(q("n"), q("visible"), q("strong"), q("range"), q("deviation")).alias("page"), rules.visible_text(q("n"), q("range"), q("deviation")).alias("text"))


@query(f"""
SELECT doc_id, round(CASE WHEN n > 0 THEN ok::DOUBLE / n ELSE 0.0 END, 9) AS valid FROM (SELECT doc_id, length(regexp_replace(t, '[{T.SPACE}]', '', 'g')) AS n, length(regexp_replace(t, '[{T.SPACE}\\p{{C}}\\x{{FFFD}}]', '', 'g')) AS ok FROM (SELECT doc_id, coalesce(text, '') || repeat(chr(7) || chr(57344) || chr(65533), (doc_id % 5)::INTEGER) AS t FROM documents))
""")
def valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every document's characters that are sound; some that are not are appended by doc_id."""
    text = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("\x07\ue000\ufffd"), (F.col("doc_id") % 5).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rules.valid_share(text), 9).alias("valid"))


@query("""
SELECT grp, round(least(greatest(sum(greatest(w, 0.0) * greatest(h, 0.0)) / 5000.0, 0.0), 1.0), 9) AS share FROM (SELECT l_orderkey AS grp, l_quantity::DOUBLE - 5.0 AS w, l_linenumber * 10.0::DOUBLE AS h FROM lineitem) GROUP BY grp
""")
def area_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a page that every order's lines, read as boxes, cover."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.lit(5.0).alias("x0"), F.lit(0.0).alias("top"), F.col("l_quantity").cast("double").alias("x1"), (F.col("l_linenumber") * 10.0).cast("double").alias("bottom"))
    return rules.area_share(rows, "grp", F.lit(5000.0)).select("grp", F.round("share", 9).alias("share"))


_REASON = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN value IS NULL OR value < 20 THEN 'grounding' WHEN event_id % 2 = 0 THEN 'duplicate' ELSE 'locale' END"


@query(f"SELECT event_type, reason, count(*) AS n, floor(avg(event_id % 101) + 0.5)::BIGINT AS confidence FROM (SELECT event_type, event_id, {_REASON} AS reason FROM events) WHERE reason IS NOT NULL GROUP BY ALL")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often events, read as answers of a model, were rejected for each reason, and their mean confidence, rounded."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.expr(_REASON).alias("reason")).where("reason is not null")
    return rows.groupBy("event_type", "reason").agg(F.count("*").alias("n"), T.half_up(F.avg(F.col("event_id") % 101)).cast("long").alias("confidence"))


@query(f"""
SELECT source, count(*) AS n, count(*) FILTER (confidence < {rules.LEAST_CONFIDENCE}) AS low, count(*) FILTER (status IN ({', '.join(map(D.lit, rules.FACTS))})) AS facts FROM (
  SELECT 'documents' AS source, (doc_id % 100) / 100.0 AS confidence, {_sql_pick([*rules.FACTS, 'conflicting'], 'doc_id')} AS status FROM documents
  UNION ALL SELECT 'conversations', (turn % 100) / 100.0, {_sql_pick([*rules.FACTS, 'needs_evidence'], 'turn')} FROM conversations
  UNION ALL SELECT 'benchmark', 1.0, 'supported' FROM benchmark) GROUP BY source
""")
def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all sources in one table: how many, how many of low confidence, and how many that are facts."""
    one = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), (F.col("doc_id") % 100 / 100.0).alias("confidence"), _pick([*rules.FACTS, "conflicting"], "doc_id").alias("status"))
    two = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), (F.col("turn") % 100 / 100.0).alias("confidence"), _pick([*rules.FACTS, "needs_evidence"], "turn").alias("status"))
    three = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.lit(1.0).alias("confidence"), F.lit("supported").alias("status"))
    rows = one.unionByName(two).unionByName(three)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < rules.LEAST_CONFIDENCE).alias("low"), F.count_if(F.col("status").isin(rules.FACTS)).alias("facts"))


@query(f"""
SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n'), lambda x: {D.normalize('x')}), lambda x: x <> '')))::BIGINT AS n FROM documents
""")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document differ in more than white space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(rules.distinct_texts(F.split(F.coalesce("text", F.lit("")), "\n"))).cast("long").alias("n"))
