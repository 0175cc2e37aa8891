"""Registered queries and the SQL that states the same result.

A query is a function of the session and a folder of tables. Its SQL stands beside it, so that
both are read together; queries without SQL are held against plain versions in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.operators import code_checks, layout_checks
from quillwork.operators import relational as R
from quillwork.operators.counters import Counters
from quillwork.operators.external import evolved, from_client, from_table, logged, retried
from quillwork.operators.lineage import new_path
from quillwork.operators.segments import look_back, positions
from quillwork.operators.similarity import rouge_l_filter, rouge_l_pairs
from quillwork.operators.templates import judge_question, prompts
from quillwork.plans import snippets as S
from quillwork.plans import workflows as W
from quillwork.sources.tables import bad_files, checked_lines, export_array, json_arrays, json_lines, line_counts, metadata_export, model_and_constraint, or_empty, score_map, summary_export, with_prompt_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STRIP = r"'^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def stripped(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as checked rows: language as model or category, source as constraint."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


# Scores


@query("""
SELECT source AS model, CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS category,
  count(*) AS total, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS matched, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS score
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source, lang), (source))
""")
def score_by_category(spark, sf_dir):
    rows = _details(spark, sf_dir).select(F.col("source").alias("model"), F.col("lang").alias("category"), "quality")
    return R.score(rows, ["model", "category"], F.col("quality") == 1, overall=["model"])


@query("""
SELECT lang AS model, CASE WHEN grouping(source) = 1 THEN 'overall' ELSE source END AS "constraint",
  count(*) AS total, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS matched, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS score
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (lang))
""")
def score_overall_by_constraint(spark, sf_dir):
    rows = _details(spark, sf_dir).select(F.col("lang").alias("model"), F.col("source").alias("constraint"), "toxic")
    return R.score(rows, ["model", "constraint"], F.col("toxic") == 0, overall=["model"])


@query("""
SELECT lang AS model, count(quality = 1) AS quality_total, count(*) FILTER (quality = 1) AS quality_matched,
  count(*) FILTER (quality = 1) / count(quality)::DOUBLE AS quality_score, count(toxic) AS clean_total, count(*) FILTER (toxic = 0) AS clean_matched,
  count(*) FILTER (toxic = 0) / count(toxic)::DOUBLE AS clean_score
FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def score_dimensions_pivot(spark, sf_dir):
    rows = _details(spark, sf_dir).withColumnRenamed("lang", "model")
    return R.score_dimensions(rows, ["model"], {"quality": F.col("quality") == 1, "clean": F.col("toxic") == 0})


@query("""
SELECT lang AS model, count(*) AS total, count(*) FILTER (quality = 1 AND n_chars >= 500) AS passed,
  count(*) FILTER (quality = 1 AND n_chars >= 500) / count(*)::DOUBLE AS pass_rate, avg(n_chars::DOUBLE) AS average_confidence
FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def judged_summary(spark, sf_dir):
    rows = _details(spark, sf_dir).withColumnRenamed("lang", "model")
    return R.judged_summary(rows, ["model"], (F.col("quality") == 1) & (F.col("n_chars") >= 500), F.col("n_chars").cast("double"))


@query("""
SELECT lang AS model, count(DISTINCT source) AS n_constraints FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def score_map_export(spark, sf_dir):
    rows = _details(spark, sf_dir).select(F.col("lang").alias("model"), F.col("source").alias("constraint"), "quality")
    maps = score_map(R.score(rows, ["model", "constraint"], F.col("quality") == 1))
    return maps.select("model", F.size(F.from_json("scores", "map<string,struct<total:bigint,matched:bigint,score:double>>")).cast("long").alias("n_constraints"))


# Positional joins and set operations


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier)
SELECT p_partkey, s_suppkey, a.pos FROM a JOIN b ON a.p_size % 25 = b.s_nationkey AND a.pos = b.pos
""")
def positional_join(spark, sf_dir):
    a = R.with_position(read(spark, sf_dir, "part"), ["p_partkey"], ["p_brand"]).withColumn("nation", F.col("p_size") % 25)
    b = R.with_position(read(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_nationkey"]).withColumnRenamed("s_nationkey", "nation")
    return R.positional_join(a, b, ["nation"]).select("p_partkey", "s_suppkey", "pos")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_size % 25 ORDER BY p_partkey) - 1 AS pos FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT p_partkey, s_suppkey, c_custkey FROM a JOIN b ON p_size % 25 = s_nationkey AND a.pos = b.pos JOIN c ON s_nationkey = c_nationkey AND a.pos = c.pos
""")
def three_way_positional(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("nation", F.col("p_size") % 25)
    a = R.with_position(part, ["p_partkey"], ["nation"])
    b = R.with_position(read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation"), ["s_suppkey"], ["nation"])
    c = R.with_position(read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), ["c_custkey"], ["nation"])
    return R.positional_join(R.positional_join(a, b, ["nation"]), c, ["nation"]).select("p_partkey", "s_suppkey", "c_custkey")


@query("""
WITH a AS (SELECT p_partkey, p_size % 25 AS nation, row_number() OVER (PARTITION BY p_size % 25 ORDER BY p_partkey) - 1 AS pos FROM part),
b AS (SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier)
SELECT p_partkey, pos FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.nation = b.nation AND a.pos = b.pos)
""")
def positions_beyond_end(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 25).alias("nation"))
    b = R.with_position(read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation"), ["s_suppkey"], ["nation"])
    return R.beyond_end(R.with_position(part, ["p_partkey"], ["nation"]), b, ["nation"]).select("p_partkey", "pos")


@query("""
SELECT c_mktsegment, count(DISTINCT c_custkey) AS n_used, count(*) AS n_rows FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment
UNION ALL SELECT 'skipped', count(*), 0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)
""")
def missing_group_skip(spark, sf_dir):
    per = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    used = customers.join(per, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n_used"), F.sum("n").alias("n_rows"))
    skipped = customers.join(per, "c_custkey", "left_anti").agg(F.count("*").alias("n_used"))
    return used.union(skipped.select(F.lit("skipped"), "n_used", F.lit(0).cast("long")))


@query(f"""
SELECT doc_id FROM documents d WHERE length({stripped("coalesce(text, '')")}) >= 200
  AND {stripped("coalesce(text, '')")} NOT IN (SELECT {stripped("coalesce(text, '')")} FROM benchmark)
""")
def anti_join_seen(spark, sf_dir):
    new = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"))
    old = read(spark, sf_dir, "benchmark").select(F.col("text").alias("code"))
    return R.unseen(new, old, least=200).select("doc_id")


@query("SELECT lang, count(DISTINCT text) AS n_texts, count(*) AS n_rows FROM documents GROUP BY lang")
def distinct_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    each = docs.groupBy("lang", "text").agg(F.count("*").alias("n"))
    return each.groupBy("lang").agg(F.count("text").alias("n_texts"), F.sum("n").alias("n_rows"))


@query("SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def reindex_kept(spark, sf_dir):
    good = _details(spark, sf_dir).where("quality = 1").select("doc_id")
    return R.reindexed(good, F.col("doc_id")).select(F.col("id").cast("long").alias("id"), "doc_id")


# Chains and levels


_CHAINS = """
c AS (SELECT conv_id, turn, list(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS frame,
  list(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sizes FROM conversations)
"""


@query(f"WITH {_CHAINS} SELECT conv_id, turn AS pos, array_to_string(frame[-(turn + 1):], '>') AS chain FROM c WHERE turn <= 5")
def chain_window(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").cast("int").alias("level"), F.col("role").alias("answer"))
    return R.chains(rows, ["conv_id"]).select("conv_id", "pos", F.array_join("chain", ">").alias("chain"))


_LEVELS = f"""
WITH {_CHAINS}, x AS (SELECT conv_id % 7 AS model, turn AS level, list_transform(sizes[-(turn + 1):], lambda s: s >= 60) AS checks FROM c WHERE turn <= 5),
y AS (SELECT model, level, count(*) AS total, sum(len(list_filter(checks, lambda k: k)))::BIGINT AS matched, count(*) FILTER (len(list_filter(checks, lambda k: NOT k)) = 0) AS perfect FROM x GROUP BY ALL)
"""


def _levels(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").cast("int").alias("level"), F.coalesce(F.length("text"), F.lit(0)).cast("string").alias("answer"))
    checked = R.chains(rows, ["conv_id"]).withColumn("checks", F.transform("chain", lambda n: n.cast("int") >= 60))
    return R.level_scores(checked.withColumn("model", F.col("conv_id") % 7), ["model"])


@query(_LEVELS + "SELECT model, level, total, matched, perfect, matched / (total * (level + 1))::DOUBLE AS ssr, perfect / total::DOUBLE AS hsr FROM y")
def multilevel_ssr_hsr(spark, sf_dir):
    return _levels(spark, sf_dir)


@query(_LEVELS + """, z AS (SELECT range AS level, coalesce(sum(total), 0)::BIGINT AS total, coalesce(sum(matched), 0)::BIGINT AS matched, coalesce(sum(perfect), 0)::BIGINT AS perfect
FROM range(6) LEFT JOIN y ON range = level GROUP BY range)
SELECT level::INT AS level, total, matched, perfect, coalesce(matched / nullif(total * (level + 1), 0)::DOUBLE, 0) AS ssr, coalesce(perfect / nullif(total, 0)::DOUBLE, 0) AS hsr FROM z""")
def multilevel_all_levels(spark, sf_dir):
    return R.all_levels(_levels(spark, sf_dir))


# Text functions


_NAMES = ["syntax_library", "input_output_input_type", "data_structure_size", "code_contextual", "algorithm_type", "non_functional_requirements", "unknown", "example"]


@query(f"""
WITH n AS (SELECT p_partkey, {S.choose_sql(_NAMES)} AS name FROM part)
SELECT p_partkey, CASE WHEN name LIKE 'syntax%' THEN 'syntax' WHEN name LIKE 'input\\_output%' ESCAPE '\\' THEN 'input_output' WHEN name LIKE 'data%' THEN 'data_structure'
    WHEN name LIKE 'code\\_cont%' ESCAPE '\\' THEN 'code_contextual' WHEN name LIKE 'algo%' THEN 'algorithm' WHEN name LIKE 'non%' THEN 'non_functional_requirements' WHEN name = 'example' THEN 'example' END AS category,
  CASE WHEN name = 'unknown' THEN NULL WHEN name LIKE 'syntax%' OR name LIKE 'input%' OR name LIKE 'data%' THEN 'rule' ELSE 'judge' END AS method
FROM n
""")
def category_prefix_route(spark, sf_dir):
    to = R.route(S.choose(_NAMES))
    return read(spark, sf_dir, "part").select("p_partkey", to["category"].alias("category"), to["method"].alias("method"))


@query(f"""
SELECT p_partkey, {stripped("CASE WHEN regexp_matches(r, '(?s)```(?:[0-9A-Za-z_]+)?(.*?)```') THEN regexp_extract(r, '(?s)```(?:[0-9A-Za-z_]+)?(.*?)```', 1) ELSE r END")} AS code
FROM (SELECT p_partkey, {S.pick_sql(S.RESPONSES)} AS r FROM part)
""")
def extract_code_fence(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.extract_code(S.pick(S.RESPONSES)).alias("code"))


def _pair_sql(a: str, b: str) -> str:
    both = f"regexp_matches(r, '(?s)<{a}>.*?</{a}>') AND regexp_matches(r, '(?s)<{b}>.*?</{b}>')"
    cut = lambda t: f"CASE WHEN {both} THEN {stripped(f"regexp_extract(r, '(?s)<{t}>(.*?)</{t}>', 1)")} ELSE '' END"
    return f"SELECT p_partkey, {cut(a)} AS prompt, {cut(b)} AS answer FROM (SELECT p_partkey, {S.pick_sql(S.TAGGED)} AS r FROM part)"


@query(_pair_sql("prompt", "answer"))
def extract_tag_pair(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.tagged_pair(S.pick(S.TAGGED)).alias("x")).select("p_partkey", "x.*")


@query(_pair_sql("new_prompt", "new_answer"))
def extract_new_tag_pair(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.tagged_pair(S.pick(S.TAGGED), "new_prompt", "new_answer").alias("x")).select("p_partkey", "x.*")


@query("""SELECT event_id, (props::JSON)->>'$.k' AS k FROM events""")
def clean_json_fence(spark, sf_dir):
    fenced = F.concat(F.lit("\n```json\n"), F.col("props"), F.lit("\n```  "))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(T.clean_json(fenced), "$.k").alias("k"))


@query(f"""
SELECT p_partkey, coalesce(len(names), 0)::INT AS n_tests, names[1] AS first_name FROM (
  SELECT p_partkey, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.tests[*].name') END AS names FROM (
    SELECT p_partkey, regexp_replace({S.pick_sql(S.TESTS)}, '^```json\n|\n```$', '', 'g') AS j FROM part))
""")
def parse_tests(spark, sf_dir):
    tests = T.parse_tests(S.pick(S.TESTS))
    return read(spark, sf_dir, "part").select("p_partkey", F.size(tests).alias("n_tests"), F.get(tests, F.lit(0))["name"].alias("first_name"))


@query(f"""
WITH v AS (SELECT p_partkey, regexp_extract({S.pick_sql(S.JUDGED)}, '(?s)\\{{.*\\}}', 0) AS j FROM part),
w AS (SELECT p_partkey, j, j <> '' AND json_valid(j) AS ok FROM v),
x AS (SELECT p_partkey, ok, CASE WHEN ok THEN j ELSE '{{}}' END AS j FROM w),
y AS (SELECT p_partkey, ok AND coalesce((j->>'$.meets_requirements') = 'true', false) AS meets,
  CASE WHEN ok THEN coalesce((j->>'$.confidence')::DOUBLE, 0.5) ELSE 0.0 END AS confidence,
  CASE WHEN ok THEN coalesce(j->>'$.reasoning', 'No reasoning provided') ELSE 'Invalid JSON' END AS reasoning,
  CASE WHEN ok THEN coalesce(json_array_length(j, '$.issues'), 0) ELSE 1 END::INT AS n_issues FROM x)
SELECT *, meets AND confidence >= 0.7 AS passed FROM y
""")
def judge_parse_threshold(spark, sf_dir):
    v = F.col("v")
    out = read(spark, sf_dir, "part").select("p_partkey", T.parse_verdict(S.pick(S.JUDGED)).alias("v"))
    return out.select("p_partkey", v["meets_requirements"].alias("meets"), v["confidence"].alias("confidence"), v["reasoning"].alias("reasoning"), F.size(v["issues"]).alias("n_issues"), T.passes(v).alias("passed"))


@query("SELECT turn, role, count(*) FILTER (contains(lower(coalesce(text, '')), 'yes')) AS n_yes, count(*) AS n FROM conversations GROUP BY ALL")
def yes_predicate(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.groupBy("turn", "role").agg(F.count_if(T.says_yes(F.coalesce("text", F.lit("")))).alias("n_yes"), F.count("*").alias("n"))


_ANSWER = f"(SELECT p_partkey, {S.pick_sql(S.ANSWERS)} AS a FROM part)"


@query(f"""
SELECT p_partkey, nullif(trim(string_split(a, ';')[1]), '') AS language, coalesce(nullif(trim(string_split(a, ';')[1]), ''), 'Python') AS with_default,
  nullif(trim(string_split(a, ';')[2]), '') AS function_name FROM {_ANSWER}
""")
def answer_language(spark, sf_dir):
    a = S.pick(S.ANSWERS)
    both = T.language_and_function(a)
    return read(spark, sf_dir, "part").select("p_partkey", T.answer_language(a).alias("language"), both["language"].alias("with_default"), both["function_name"].alias("function_name"))


@query(f"""
SELECT p_partkey, len(parts)::INT AS n_parts, CASE WHEN len(parts) > 3 THEN array_to_string(parts[3:], ';') ELSE parts[-1] END AS tail
FROM (SELECT p_partkey, string_split(a, ';') AS all_parts, CASE WHEN len(string_split(a, ';')) > 3 THEN list_concat(string_split(a, ';')[:2], [array_to_string(string_split(a, ';')[3:], ';')]) ELSE string_split(a, ';') END AS parts FROM {_ANSWER})
""")
def answer_split_limit(spark, sf_dir):
    parts = T.split_answer(S.pick(S.ANSWERS), 2)
    return read(spark, sf_dir, "part").select("p_partkey", F.size(parts).alias("n_parts"), F.element_at(parts, -1).alias("tail"))


@query("""
SELECT p_partkey, len(string_split(p_type, ' '))::INT AS n_items, list_extract(string_split(p_type, ' '), 1) AS first_item, p_brand AS quoted_item,
  p_brand AS class_rule, p_size::VARCHAR AS width, CASE p_size % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'size' ELSE 'operation' END AS level_check
FROM part
""")
def answer_parts(spark, sf_dir):
    listed = T.bracket_list(F.concat(F.lit("["), F.replace("p_type", F.lit(" "), F.lit(",")), F.lit("]")))
    ops = T.quoted_list(F.concat(F.lit("['"), F.col("p_brand"), F.lit("', 'x']")))
    named = T.naming_map(F.concat(F.lit("class:"), F.col("p_brand"), F.lit(",function:b")))
    level = F.element_at(F.array(F.lit(";java;List;"), F.lit("java;List;5"), F.lit("java;List;['add']")), (F.col("p_size") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.size(listed).alias("n_items"),
        F.get(listed, F.lit(0)).alias("first_item"),
        F.get(ops, F.lit(0)).alias("quoted_item"),
        named["class"].alias("class_rule"),
        T.partition(F.concat(F.lit("spaces:"), F.col("p_size").cast("string")))["tail"].alias("width"),
        T.level_check(level).alias("level_check"),
    )


@query("""
SELECT n_nationkey, n_name AS model, 'data_structure_size' AS "constraint" FROM nation
""")
def path_parts(spark, sf_dir):
    file = F.concat(F.lit("/out/"), F.col("n_name"), F.lit("/data_structure_size_"), F.col("n_name"), F.lit("_20250101_000000.json"))
    return read(spark, sf_dir, "nation").select("n_nationkey", model_and_constraint(file).alias("x")).select("n_nationkey", "x.*")


@query("""
SELECT event_type, count(*) FILTER (event_id % 5 = 0) AS n_errors, count(*) AS n FROM events GROUP BY event_type
""")
def error_response_filter(spark, sf_dir):
    said = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("An EXCEPTION at "), F.col("props"))).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(T.is_error(said)).alias("n_errors"), F.count("*").alias("n"))


# Layout, names and comments


_LINES = f"(SELECT p_partkey, style, list_filter(list_transform(string_split(code, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM (SELECT p_partkey, {S.choose_sql(S.STYLES)} AS style, {S.pick_sql(S.BRACED)} AS code FROM part))"
_ENDS = "'(\\)|[0-9A-Za-z_])\\s*$'"


@query(f"""
WITH x AS (SELECT p_partkey, style, l, list_filter(l, lambda s: s = '{{' OR (contains(s, '{{') AND NOT regexp_matches(trim(string_split(s, '{{')[1]), {_ENDS}))) AS bad FROM {_LINES}),
y AS (SELECT *, list_filter(l, lambda s, i: CASE WHEN s = '{{' THEN i = 1 OR NOT regexp_matches(coalesce(l[i - 1], ''), {_ENDS}) ELSE contains(s, '{{') END) AS bad_allman,
  list_filter(l, lambda s, i: contains(s, '}}') AND NOT regexp_matches(trim(s[strpos(s, '}}') + 1:]), '^(else|catch|finally)') AND regexp_matches(coalesce(l[i + 1], ''), '^(else|catch|finally)')) AS bad_1tbs FROM x)
SELECT p_partkey, style, CASE style WHEN 'K&R' THEN len(bad) = 0 WHEN 'Allman' THEN len(bad_allman) = 0 WHEN '1TBS' THEN len(bad) = 0 AND len(bad_1tbs) = 0 ELSE false END AS is_matched FROM y
""")
def brace_style_check(spark, sf_dir):
    style = S.choose(S.STYLES)
    matched = layout_checks.check_braces(S.pick(S.BRACED), F.concat(F.lit("Java;"), style))
    return read(spark, sf_dir, "part").select("p_partkey", style.alias("style"), matched.alias("is_matched"))


def _spacing_sql() -> str:
    tight = " OR ".join(f"regexp_matches(c, '\\b\\w+{op}\\w+\\b')" for op in layout_checks.OPERATORS)
    loose = " OR ".join(f"regexp_matches(c, '\\b\\w+\\s+{op}\\s+\\w+\\b')" for op in layout_checks.OPERATORS)
    return f"CASE WHEN spacing = 'spacing' THEN NOT ({tight} OR regexp_matches(c, ',\\S')) ELSE NOT ({loose} OR regexp_matches(c, ',\\s+\\S')) END"


@query(f"""
WITH x AS (SELECT p_partkey, string_split(a, ';')[1] AS standard, string_split(a, ';')[2] AS spacing, c,
  list_transform(list_filter(string_split(c, chr(10)), lambda s: trim(s) <> ''), lambda s: regexp_extract(s, '^\\s*', 0)) AS leads
  FROM (SELECT p_partkey, {S.choose_sql(S.LAYOUTS)} AS a, {S.pick_sql(S.INDENTED)} AS c FROM part))
SELECT p_partkey, standard, spacing, (CASE WHEN standard LIKE 'spaces:%' THEN len(list_filter(leads, lambda w: contains(w, chr(9)) OR length(w) % string_split(standard, ':')[2]::INT <> 0)) = 0
  WHEN standard = 'tabs' THEN len(list_filter(leads, lambda w: contains(w, ' '))) = 0 ELSE false END) AND ({_spacing_sql()}) AS is_matched FROM x
""")
def indentation_check(spark, sf_dir):
    layout = S.choose(S.LAYOUTS)
    parts = F.split(layout, ";")
    matched = layout_checks.check_indentation(S.pick(S.INDENTED), F.concat(F.lit("python;"), layout))
    return read(spark, sf_dir, "part").select("p_partkey", parts[0].alias("standard"), parts[1].alias("spacing"), matched.alias("is_matched"))


@query(f"""
SELECT p_partkey, convention, CASE convention WHEN 'snake_case' THEN regexp_matches(name, '^[a-z]+[a-z0-9_]*$') WHEN 'PascalCase' THEN regexp_matches(name, '^[A-Z][A-Za-z0-9]*$')
  WHEN 'camelCase' THEN regexp_matches(name, '^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)*$') ELSE regexp_matches(name, '^[a-z]+(-[a-z]+)*$') END AS is_matched
FROM (SELECT p_partkey, {S.choose_sql(list(layout_checks.CONVENTIONS))} AS convention, {S.pick_sql(S.NAMES)} AS name FROM part)
""")
def naming_convention_check(spark, sf_dir):
    convention = S.choose(list(layout_checks.CONVENTIONS))
    return read(spark, sf_dir, "part").select("p_partkey", convention.alias("convention"), layout_checks.fits_convention(S.pick(S.NAMES), convention).alias("is_matched"))


@query(f"""
SELECT p_partkey, p_size % {len(S.COMMENTED)} IN (0, 2, 4) AS is_matched FROM part
""")
def block_comment_check(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", layout_checks.block_comment(S.pick(S.COMMENTED)).alias("is_matched"))


@query(f"""
WITH x AS (SELECT p_partkey, string_split({S.pick_sql(S.GO)}, chr(10)) AS l FROM part)
SELECT p_partkey, len(list_filter(l, lambda s, i: regexp_matches(s, '^(func|type|var|const)\\s+\\w+')
  AND NOT (starts_with(coalesce(l[i - 1], ''), '//') AND starts_with(trim(regexp_replace(coalesce(l[i - 1], ''), '^/+', '')), regexp_extract(s, '^(?:func|type|var|const)\\s+(\\w+)', 1))))) = 0 AS is_matched FROM x
""")
def godoc_check(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", layout_checks.godoc(S.pick(S.GO)).alias("is_matched"))


# Checks on code


@query("""
WITH x AS (SELECT p_partkey, string_split(p_type, ' ') AS found, [p_type, p_brand] AS wanted FROM part)
SELECT p_partkey, len(found) = len(wanted) AND len(list_filter(found, lambda f, i: NOT (contains(coalesce(wanted[i], ''), f) OR contains(f, coalesce(wanted[i], '-'))))) = 0 AS is_matched FROM x
""")
def output_order_match(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", code_checks.same_outputs(F.split("p_type", " "), F.array("p_type", "p_brand")).alias("is_matched"))


@query("SELECT p_partkey, contains(p_name || p_partkey, p_size::VARCHAR) AS is_matched FROM part")
def size_literal_check(spark, sf_dir):
    code = F.concat("p_name", F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", T.contains_number(code, F.col("p_size")).alias("is_matched"))


#: For each Python snippet, the checks of S.PYTHON_CHECKS that it passes whatever its numbers.
_PASSED = {
    0: ["ast_syntax python"],
    1: ["function python;math.sorted", "type Python;Set", "ast_syntax python"],
    2: ["library python;a", "input_type python;get;String", "output_type python;get;Tuple", "output_order python;get;[int,str]", "ast_syntax python"],
    3: [],
    4: ["advanced_syntax python;list comprehension", "ast_syntax python", "operation python;list;['range']"],
}


def _passed_sql() -> str:
    each = " ".join(f"WHEN {k} THEN k IN ({', '.join(S.quoted(c) for c in names)})" if names else f"WHEN {k} THEN false" for k, names in _PASSED.items())
    return f"CASE p_size % {len(S.PYTHON)} {each} END"


@query(f"""
SELECT p_partkey, c[1] AS "constraint", CASE WHEN k = 'size python;dict;1' THEN p_size % {len(S.PYTHON)} = 0 AND contains(p_partkey::VARCHAR, '1') ELSE {_passed_sql()} END AS is_matched,
  c[2] AS answer FROM part, (SELECT unnest([{", ".join(f"[{S.quoted(a)}, {S.quoted(b)}]" for a, b in S.PYTHON_CHECKS)}]) AS c), LATERAL (SELECT c[1] || ' ' || c[2] AS k)
""")
def python_checks(spark, sf_dir):
    wanted = F.array(*[F.struct(F.lit(a).alias("constraint"), F.lit(b).alias("answer")) for a, b in S.PYTHON_CHECKS])
    responses = read(spark, sf_dir, "part").select("p_partkey", S.pick(S.PYTHON).alias("response"))
    responses = code_checks.with_facts(responses, answer=None)  # parsed once, then checked by every constraint
    rows = responses.select("p_partkey", "response", "_facts", "_python", F.explode(wanted).alias("c")).select("p_partkey", "response", "_facts", "_python", "c.*")
    return code_checks.check_rows(rows).select("p_partkey", "constraint", "answer", "is_matched")


_OTHER = [
    ("library", "javascript;react", "import x from 'react-dom';\nconst a = 1;", True),
    ("library", "go;gin", 'import (\n  "fmt"\n  "github.com/gin-gonic/gin"\n)\n', True),
    ("library", "rust;serde", "use std::fmt;\n", False),
    ("function", "java;List.add", "class A { void f() { items.add(1); } }", True),
    ("function", "rust;Vec::push", "fn push(a: i32) { let x = 1; }", False),
    ("input_type", "java;run;List", "class A { int run(ArrayList<String> a, int b) { return 1; } }", True),
    ("input_type", "rust;run;Integer", "fn run(a: Vec<i32>, b: u64) -> String { x }", True),
    ("output_type", "rust;run;String", "fn run(a: Vec<i32>, b: u64) -> String { x }", True),
    ("output_type", "java;run;Map", "class A { Map<String, Integer> run(int b) { return m; } }", True),
    ("input_order", "java;run;[List,Integer]", "class A { int run(List<String> a, int b) { return 1; } }", True),
    ("input_order", "java;run;[Integer,List]", "class A { int run(List<String> a, int b) { return 1; } }", False),
    ("output_order", "rust;run;[i32,String]", "fn run(a: i32) -> (i32, String) { x }", True),
    ("type", "cpp;unordered_map", "std::unordered_map<int, int> m;", True),
    ("size", "Rust;BTreeMap;2500", "let m: BTreeMap<i32, i32> = f(2500);", False),
    ("operation", "java;TreeSet;['add','first']", "TreeSet<Integer> t; t.add(1); t.first();", True),
    ("advanced_syntax", "javascript;arrow functions", "const f = (a) => a + 1;", True),
    ("advanced_syntax", "go;defer statement", "func f() { defer g() }", True),
    ("naming_convention", "java;class:PascalCase,function:camelCase", "class Box { int getItem(int a) { return 1; } }", True),
    ("naming_convention", "java;class:snake_case", "class Box { }", False),
    ("comment_formatting", "java;javadoc", "/** Does. @param a b */\nint f(int a) { return a; }", True),
]


@query(f"""
SELECT n_nationkey, c.f AS "constraint", c.a AS answer, c.m AS is_matched
FROM nation, (SELECT unnest([{", ".join(f"{{'f': {S.quoted(f)}, 'a': {S.quoted(a)}, 'm': {str(m).lower()}}}" for f, a, _, m in _OTHER)}]) AS c)
""")
def other_language_checks(spark, sf_dir):
    wanted = F.array(*[F.struct(F.lit(f).alias("constraint"), F.lit(a).alias("answer"), F.lit(c).alias("response")) for f, a, c, _ in _OTHER])
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(wanted).alias("c")).select("n_nationkey", "c.*")
    return code_checks.check_rows(rows).select("n_nationkey", "constraint", "answer", "is_matched")


# Similarity


#: The benchmark's texts hardly resemble each other; at this limit some of them do.
LIMIT = 0.15
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
_ROUGE = f"""
WITH RECURSIVE d AS (SELECT item_id, {_TOKENS} AS x, len({_TOKENS}) AS m FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, a.x AS x, b.x AS y, a.m AS m, b.m AS n FROM d a JOIN d b ON a.item_id < b.item_id
  WHERE least(a.m, b.m) >= greatest(a.m, b.m) * 0.15 / 1.85 - 1e-9 AND len(list_intersect(a.x, b.x)) > 0),
s(a, b, x, y, m, n, j, r) AS (SELECT a, b, x, y, m, n, 0, list_transform(x, lambda t: 0) FROM p
  UNION ALL SELECT a, b, x, y, m, n, j + 1, list_reduce(list_transform(range(1, m + 1), lambda i: [CASE WHEN x[i] = y[j + 1] THEN CASE WHEN i = 1 THEN 0 ELSE r[i - 1] END + 1 ELSE r[i] END]),
    lambda u, v: list_concat(u, [greatest(u[-1], v[1])])) FROM s WHERE j < n),
e AS (SELECT a, b, r[-1]::INT AS lcs, 2 * r[-1] / (m + n)::DOUBLE AS score FROM s WHERE j = n AND 2 * r[-1] / (m + n)::DOUBLE >= 0.15 - 1e-9)
"""


@query(_ROUGE + "SELECT a, b, lcs, score FROM e")
def rouge_l_pairs_benchmark(spark, sf_dir):
    return rouge_l_pairs(read(spark, sf_dir, "benchmark"), "item_id", "text", LIMIT)


@query(_ROUGE + """, k(item_id, kept) AS (SELECT -1::BIGINT, []::BIGINT[]
  UNION ALL SELECT n.item_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = n.item_id AND list_contains(k.kept, e.a)) THEN k.kept ELSE list_append(k.kept, n.item_id) END
  FROM k JOIN (SELECT item_id, lag(item_id, 1, -1) OVER (ORDER BY item_id) AS before FROM benchmark) n ON n.before = k.item_id)
SELECT unnest(arg_max(kept, item_id)) AS item_id FROM k""")
def rouge_l_greedy_filter(spark, sf_dir):
    return rouge_l_filter(read(spark, sf_dir, "benchmark"), "item_id", "text", LIMIT).select("item_id")


@query()
def rouge_l_filter_conversations(spark, sf_dir):
    """The first turns of all conversations without those that resemble an earlier one."""
    first = read(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "text")
    return rouge_l_filter(first, "conv_id", "text").select("conv_id")


# Samples, templates and repair


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 10")
def per_file_sample(spark, sf_dir):
    return R.sample_each(read(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 10, seed=7).select("source", "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 100")
def global_sample(spark, sf_dir):
    return R.sample_all(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, seed=3)


@query("""
WITH s AS (SELECT p_partkey, (p_partkey - (SELECT min(p_partkey) FROM part)) // 25 AS e, (p_partkey - (SELECT min(p_partkey) FROM part)) % 25 AS i FROM part),
d AS (SELECT e, n_name, row_number() OVER (PARTITION BY e ORDER BY md5('0:' || e || ':' || n_name), n_name) - 1 AS i FROM (SELECT DISTINCT e FROM s), nation)
SELECT p_partkey, n_name FROM s JOIN d USING (e, i)
""")
def balanced_assign(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey")
    least = part.agg(F.min("p_partkey")).first()[0]
    return R.assign_balanced(part.withColumn("pos", F.col("p_partkey") - least), read(spark, sf_dir, "nation"), "n_name").select("p_partkey", "n_name")


@query("""
SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS parts, least(count(*), 5)::INT AS n_shown FROM lineitem GROUP BY l_orderkey
""")
def param_list_sort(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    each = F.struct(F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"))
    listed = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", each.alias("p")))).alias("p"))
    ordered = R.sorted_parameters(F.transform("p", lambda x: x["p"]))
    return listed.select("l_orderkey", F.array_join(F.transform(ordered, lambda p: p["part"].cast("string")), ",").alias("parts"), F.size(R.first_k(ordered, 5)).alias("n_shown"))


@query("""
SELECT p_partkey, 'Use the ' || p_brand || ' library ' || p_name || ' (' || p_type || ').' || chr(10) || 'Library: ' || p_type || chr(10) || 'Example: ' || p_size AS prompt FROM part
""")
def template_prompt(spark, sf_dir):
    seeds = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_type").alias("description"), F.col("p_size").cast("string").alias("example"), F.col("p_brand").alias("language")
    )
    return prompts(seeds, "library").select("p_partkey", "prompt")


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN source WHEN i.item_id IS NOT NULL THEN 'item ' || i.item_id END AS response,
  CASE WHEN quality = 1 OR i.item_id IS NOT NULL THEN NULL ELSE 'no response' END AS error
FROM documents JOIN labels USING (doc_id) LEFT JOIN benchmark i ON i.item_id = doc_id
""")
def repair_route(spark, sf_dir):
    details = _details(spark, sf_dir).select("doc_id", F.col("source").alias("generated_code"), (F.col("quality") == 1).alias("is_matched"))
    responses = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("response"))
    return R.repaired(details, responses, "doc_id")


@query("""
SELECT n_nationkey, n_regionkey, r_name AS response, CASE WHEN r_name IS NULL THEN 'no response' END AS error FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3
""")
def responses_with_retry(spark, sf_dir):
    asked = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    known = read(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("response"))
    return retried(asked, lambda left: from_table(left, known, ["n_regionkey"])).select("n_nationkey", "n_regionkey", "response", "error")


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::INT AS passed, count(*)::INT AS total_tests, count(*) FILTER (o_orderstatus <> 'F')::INT AS n_failures FROM orders GROUP BY o_custkey
""")
def test_results(spark, sf_dir):
    results = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("name"), (F.col("o_orderstatus") == "F").alias("passed"))).alias("results"))
    out = R.test_results(F.col("results"))
    return results.select("o_custkey", out["passed"].alias("passed"), out["total_tests"].alias("total_tests"), F.size(out["failures"]).alias("n_failures"))


# Files, exports and whole steps


@query("""
SELECT replace(p_brand, '#', '') AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey AS id, p_name AS prompt FROM part
""")
def json_array_files(spark, sf_dir):
    """Written as one JSON array per brand and read again, with the position in each file."""
    part = read(spark, sf_dir, "part").select(F.translate("p_brand", "#", "").alias("p_brand"), F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"))
    path = new_path(spark)
    export_array(R.with_position(part, ["id"], ["p_brand"]).withColumnRenamed("p_brand", "file")).select("body", F.col("file").alias("brand")).write.partitionBy("brand").text(path)
    rows = json_arrays(spark, f"{path}/*/*.txt", "struct<id:bigint,prompt:string>")
    return rows.select(F.regexp_extract("file", "brand=([^/]*)/", 1).alias("brand"), F.col("pos").cast("long").alias("pos"), "id", "prompt")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 3 = 0")
def unreadable_files(spark, sf_dir):
    """Files that hold no JSON array, one in three here."""
    nation = read(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 3 == 0, "[{broken").otherwise('[{"id": 1}]').alias("body"))
    path = new_path(spark)
    nation.withColumnRenamed("n_name", "name").write.partitionBy("name").text(path)
    return bad_files(spark, f"{path}/*/*.txt", "struct<id:bigint>").select(F.regexp_replace(F.regexp_extract("file", "name=([^/]*)/", 1), "%20", " ").alias("name"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 4 <> 0")
def json_lines_without_bad_ones(spark, sf_dir):
    """Lines that are no JSON are skipped, and a path that isn't there adds nothing."""
    part = read(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 4 == 0, F.lit('{"id": oops')).otherwise(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))))
    path, schema = new_path(spark), "id bigint, name string"
    part.select(line.alias("value")).write.text(path)
    return json_lines(spark, path, schema).union(or_empty(spark, f"{path}-absent", schema))


@query("""
SELECT lang AS model, source AS constraint_name, count(*) AS total, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS matched,
  sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS score FROM documents JOIN labels USING (doc_id) GROUP BY lang, source
""")
def score_map_content(spark, sf_dir):
    """The exported score maps, read again entry by entry."""
    rows = _details(spark, sf_dir).select(F.col("lang").alias("model"), F.col("source").alias("constraint"), "quality")
    maps = score_map(R.score(rows, ["model", "constraint"], F.col("quality") == 1))
    entries = maps.select("model", F.explode(F.from_json("scores", "map<string,struct<total:bigint,matched:bigint,score:double>>")).alias("constraint_name", "s"))
    return entries.select("model", "constraint_name", "s.*")


@query("""
SELECT lang AS model, count(*) AS total, sum((quality = 1)::INT)::BIGINT AS matched, round(avg((quality = 1)::INT), 9) AS pass_rate,
  round(avg(0.25 * toxic + 0.5), 9) AS average_confidence, sum(doc_id)::BIGINT AS ids FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def summary_and_results(spark, sf_dir):
    """Exports of a summary with its detail rows, per model, read again."""
    rows = _details(spark, sf_dir).select("lang", "doc_id", (F.col("quality") == 1).alias("is_matched"), (0.25 * F.col("toxic") + 0.5).alias("confidence"))
    bodies = summary_export(rows, "lang", "is_matched", "confidence", 0.7)
    shape = "struct<summary:struct<total:bigint,matched:bigint,pass_rate:double,average_confidence:double>,results:array<struct<doc_id:bigint>>>"
    held = bodies.select("model", F.from_json("body", shape).alias("b"))
    ids = F.aggregate(F.col("b.results.doc_id"), F.lit(0).cast("long"), lambda s, x: s + x)
    return held.select("model", "b.summary.total", "b.summary.matched", F.round("b.summary.pass_rate", 9).alias("pass_rate"), F.round("b.summary.average_confidence", 9).alias("average_confidence"), ids.alias("ids"))


@query("SELECT source AS model, count(*) AS total, 'judge' AS eval_model FROM documents GROUP BY source")
def metadata_and_results(spark, sf_dir):
    """One object of metadata and of each model's results, read again."""
    totals = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("model")).agg(F.count("*").alias("total"))
    body = metadata_export(totals, "judge", 0.7, True)
    shape = "struct<metadata:struct<eval_model:string>,results:map<string,struct<total:bigint>>>"
    held = body.select(F.from_json("body", shape).alias("b"))
    return held.select(F.explode("b.results").alias("model", "r"), F.col("b.metadata.eval_model").alias("eval_model")).select("model", "r.total", "eval_model")


@query("""
WITH g AS (SELECT p_partkey, replace(p_type, ' ', '_') AS c FROM part), n AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN replace(p_type, ' ', '_') ELSE replace(p_type, ' ', '-') END AS f FROM part WHERE p_size < 6)
SELECT p_partkey, coalesce(a.f, b.f) AS prompt_file FROM g LEFT JOIN n a ON a.f = c LEFT JOIN n b ON b.f = replace(c, '_', '-') WHERE coalesce(a.f, b.f) IS NOT NULL
""")
def prompt_file_fallback(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.translate("p_type", " ", "_")).otherwise(F.translate("p_type", " ", "-"))
    groups = part.select("p_partkey", F.translate("p_type", " ", "_").alias("constraint"))
    return with_prompt_file(groups, part.where("p_size < 6").select(name.alias("constraint"))).select("p_partkey", "prompt_file")


@query("SELECT lang, format('{:.2f}%', 100 * sum((quality = 1)::INT) / count(*)::DOUBLE) AS share FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def percentages(spark, sf_dir):
    return _details(spark, sf_dir).groupBy("lang").agg(T.percent(F.avg((F.col("quality") == 1).cast("int"))).alias("share"))


@query("SELECT p_partkey, p_size = p_size % 7 AS same FROM part")
def json_equality(spark, sf_dir):
    """Results that differ in white space alone are equal."""
    left, right = F.format_string('{"a": [%d, "x"]}', F.col("p_size")), F.format_string('{ "a":[ %d,"x" ] }', F.col("p_size") % 7)
    return read(spark, sf_dir, "part").select("p_partkey", T.same_json(left, right).alias("same"))


@query("""
SELECT p_partkey AS id, level, p_name || repeat('+', level) AS prompt, repeat('!', level) AS answer FROM part, (SELECT unnest([0, 1, 2, 3])::INT AS level)
WHERE level = 0 OR p_partkey % 5 <> 0
""")
def evolved_levels(spark, sf_dir):
    """Three further levels, each made of the one before; where the answer has no prompt the chain ends."""

    def respond(asked):
        new = F.concat(F.lit("<new_prompt>"), F.col("old"), F.lit("+</new_prompt><new_answer>"), F.col("answer"), F.lit("!</new_answer>"))
        return asked.withColumn("response", F.when(F.col("id") % 5 != 0, new).otherwise("nothing")).withColumn("error", F.lit(None).cast("string"))

    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"), F.lit("").alias("answer"))
    return W.evolve(part, respond).select("id", "level", "prompt", "answer")


@query("SELECT p_partkey, trim(p_type) AS concepts FROM part WHERE p_size % 3 = 1")
def concepts_of_snippets(spark, sf_dir):
    """Of three calls one is missing and one says that it failed; those snippets are left out."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_name").alias("code"), "p_type")
    said = part.where("p_size % 3 != 0").select("p_partkey", F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("  "), "p_type", F.lit("\n"))).otherwise("TimeoutException").alias("response"))
    return W.concepts(part, lambda asked: from_table(asked, said, ["p_partkey"])).select("p_partkey", "concepts")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size % 4 END::INT AS n_tests, CASE WHEN p_size % 4 > 0 THEN p_brand END AS first_input FROM part")
def generated_tests(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.col("p_name").alias("prompt"), F.col("p_type").alias("answer"))
    case = F.struct(F.lit("t").alias("name"), F.col("p_brand").alias("input"), F.lit("1").alias("expected_output"))
    body = F.to_json(F.struct(F.array_repeat(case, F.col("p_size") % 4).alias("tests")))

    def respond(asked):
        return asked.withColumn("response", F.when(F.col("p_size") % 4 == 0, "no tests").otherwise(body)).withColumn("error", F.lit(None).cast("string"))

    return W.generate_tests(part, respond).select("p_partkey", F.size("tests").alias("n_tests"), F.get("tests", F.lit(0))["input"].alias("first_input"))


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'It has to be written in java with the framework spring and show what is typical of it: ' || p_name || '; ' || p_type
  WHEN 1 THEN 'It is in go. The function run takes a List and has to handle these values: ' || p_name WHEN 2 THEN 'It has to use this kind of algorithm: ' || p_name
  WHEN 3 THEN 'It has to behave as the examples of the task show.' || chr(10) || 'Reference solution:' || chr(10) || p_name ELSE 'The answer asked for: ' || p_name END AS asked FROM part
""")
def judge_questions(spark, sf_dir):
    """What is asked by the kind of constraint, from the parts of its answer."""
    kinds = [("framework", "framework", F.concat(F.lit("java;spring; "), "p_name", F.lit("; "), "p_type")), ("input_range", "input_range", F.concat(F.lit("go;run;List; "), "p_name")), ("algorithm", "type", F.col("p_name")), ("example", "example", F.col("p_name")), ("other", "type", F.col("p_name"))]
    pick = [F.when(F.col("p_size") % 5 == i, F.struct(F.lit(a).alias("category"), F.lit(b).alias("constraint"), c.alias("answer"))) for i, (a, b, c) in enumerate(kinds)]
    part = read(spark, sf_dir, "part").select("p_partkey", F.coalesce(*pick).alias("k"))
    text = judge_question(F.col("k.category"), F.col("k.constraint"), F.lit("task"), F.lit("code"), F.col("k.answer"))
    return part.select("p_partkey", F.regexp_extract(text, r"(?s)Constraint: (.*)$", 1).alias("asked"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'python;' || p_brand ELSE ['rust;1.86.0', 'python;3.8', 'java;jdk17'][p_size % 4] END AS answer, p_size % 4 = 2 AND p_partkey % 2 = 0 AS is_matched FROM part")
def language_versions(spark, sf_dir):
    """Known versions only; Python parses by that version's grammar, others need a compiler."""
    answers = F.array(F.concat(F.lit("python;"), "p_brand"), F.lit("rust;1.86.0"), F.lit("python;3.8"), F.lit("java;jdk17"))
    code = F.when(F.col("p_partkey") % 2 == 0, "x = [1]\n").otherwise("match x:\n    case 1:\n        pass\n")
    rows = read(spark, sf_dir, "part").select("p_partkey", code.alias("response"), F.lit("language_version").alias("constraint"), F.get(answers, (F.col("p_size") % 4).cast("int")).alias("answer"))
    return code_checks.check_rows(rows).select("p_partkey", "answer", "is_matched")


@query(f"""
SELECT p_partkey, c AS answer, CASE c WHEN 'java;HashMap' THEN p_size % 2 = 0 WHEN 'java;HashMap;' || (p_partkey % 10) THEN p_size % 2 = 0 WHEN 'java;HashMap;[''put'']' THEN p_size % 2 = 0 AND p_size % 3 = 0 END AS is_matched
FROM part, LATERAL (SELECT unnest(['java;HashMap', 'java;HashMap;' || (p_partkey % 10), 'java;HashMap;[''put'']']) AS c)
""")
def level_dispatch(spark, sf_dir):
    """Type, size or operation by the form of the answer."""
    kind = F.when(F.col("p_size") % 2 == 0, "HashMap").otherwise("TreeMap")
    call = F.when(F.col("p_size") % 3 == 0, "put").otherwise("get")
    code = F.format_string("%s m = new %s(%d); m.%s(a);", kind, kind, F.col("p_partkey"), call)
    answers = F.array(F.lit("java;HashMap"), F.concat(F.lit("java;HashMap;"), (F.col("p_partkey") % 10).cast("string")), F.lit("java;HashMap;['put']"))
    rows = read(spark, sf_dir, "part").select("p_partkey", code.alias("response"), F.lit("level").alias("constraint"), F.explode(answers).alias("answer"))
    return code_checks.check_rows(rows).select("p_partkey", "answer", "is_matched")


# Large groups, counts beside the rows, and logged calls


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem")
def segmented_positions(spark, sf_dir):
    """Positions in three groups that hold all rows, over as many tasks as the table needs."""
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return positions(lines, ["l_orderkey", "l_linenumber"], ["l_returnflag"]).select("l_orderkey", "l_linenumber", "pos")


@query("""
SELECT o_orderkey, array_to_string(list(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), '>') AS chain FROM orders
""")
def segmented_look_back(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    framed = look_back(orders, ["o_orderkey"], ["o_orderstatus"], F.col("o_orderkey").cast("string"), 5)
    return framed.select("o_orderkey", F.array_join("frame", ">").alias("chain"))


@query(f"WITH {_CHAINS} SELECT conv_id, turn AS pos, array_to_string(frame[-(turn + 1):], '>') AS chain FROM c WHERE turn <= 5")
def segmented_chains(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").cast("int").alias("level"), F.col("role").alias("answer"))
    return R.chains(rows, ["conv_id"], segmented=True).select("conv_id", "pos", F.array_join("chain", ">").alias("chain"))


def _lines_with_bad_ones(spark: SparkSession, sf_dir: str) -> str:
    part = read(spark, sf_dir, "part")
    whole = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    line = F.when(F.col("p_partkey") % 4 == 0, F.lit('{"id": oops')).when(F.col("p_partkey") % 7 == 0, F.lit('{"id": "no number"}')).otherwise(whole)
    path = new_path(spark)
    part.select(F.translate("p_brand", "#", "").alias("brand"), line.alias("value")).write.partitionBy("brand").text(path)
    return path


@query("""
SELECT replace(p_brand, '#', '') AS brand, count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 7 <> 0) AS good, count(*) FILTER (p_partkey % 4 = 0 OR p_partkey % 7 = 0) AS bad FROM part GROUP BY ALL
""")
def good_and_bad_lines(spark, sf_dir):
    """Lines of each brand's files that are objects of the schema, and those that aren't."""
    counts = line_counts(spark, f"{_lines_with_bad_ones(spark, sf_dir)}/*/*.txt", "id bigint, name string")
    return counts.groupBy(F.regexp_extract("file", "brand=([^/]*)/", 1).alias("brand")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("""
SELECT 'lines' AS source, unnest(['rows', 'bad']) AS metric, unnest([count(*), count(*) FILTER (p_partkey % 4 = 0 OR p_partkey % 7 = 0)]) AS value FROM part
UNION ALL SELECT 'used', unnest(['rows', 'even']), unnest([count(*), count(*) FILTER (p_partkey % 2 = 0)]) FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0
""")
def counts_beside_rows(spark, sf_dir):
    """Bad lines are counted by the job that writes the good ones."""
    counters = Counters()
    every = counters.watch(checked_lines(spark, f"{_lines_with_bad_ones(spark, sf_dir)}/*/*.txt", "id bigint, name string"), "lines", bad=F.col("bad"))
    used = counters.watch(every.where("not bad").select("item.*"), "used", even=F.col("id") % 2 == 0)
    used.write.parquet(new_path(spark))
    return counters.table(spark)


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN upper(p_type) END AS response, CASE WHEN p_size % 5 = 0 THEN 'ValueError: refused' END AS error FROM part
""")
def logged_calls(spark, sf_dir):
    """Prompts that repeat are asked for once; a second run asks for the failed ones only."""

    def connect():
        def client(prompt: str) -> str:
            if prompt.startswith("0"):
                raise ValueError("refused")
            return prompt.split(":", 1)[1].upper()

        return client

    part = read(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_size") % 5).cast("string"), F.lit(":"), "p_type").alias("prompt"))
    log = new_path(spark)
    for _ in range(2):
        out = logged(part, lambda asked: from_client(asked, connect, tries=1, in_flight=4), log)
    return out.select("p_partkey", "response", "error")
