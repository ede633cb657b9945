"""The engine's queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.config import EndpointOptions
from pagewright.functions import protocol
from pagewright.functions.text import MATH_SYMBOLS, OPERATORS, has_markup
from pagewright.operators import anchors, bench, formatting, governance, ladder, layout, merge, regions, spans, triage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- triage: documents as single pages -------------------------------------------------------


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.profile_text(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.decide(profiles(spark, sf_dir))


def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("doc_id", "char_count", "word_count", F.round("avg_word_len", 6).alias("avg_word_len"), F.round("math_density", 6).alias("math_density"))


def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("doc_id", "route", F.array_join("reasons.code", ",").alias("codes"))


def triage_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.triage_report(decisions(spark, sf_dir), "lang")


def triage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.triage_report(decisions(spark, sf_dir), "source")


def trigger_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.trigger_frequency(decisions(spark, sf_dir))


def topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = triage.compare_topologies(decisions(spark, sf_dir))
    return x.groupBy("topology").agg(F.count("*").alias("pages"), F.count_if(F.col("tier") == 2).alias("sent"), F.count_if("escalated").alias("escalated"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.latency_stats(read(spark, sf_dir, "events"), "value")


_SYMBOLS = MATH_SYMBOLS.replace("^", "\\^")
_PROFILE = f"""p AS (
  SELECT doc_id, lang, source, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS char_count, len(regexp_extract_all(text, '\\S+'))::INT AS word_count,
    length(regexp_replace(text, '\\s+', '', 'g')) AS letters,
    length(text) - length(regexp_replace(text, '[{_SYMBOLS}]', '', 'g')) + length(text) - length(regexp_replace(text, '[=+\\-*/^_{{}}\\\\]', '', 'g')) AS hits
  FROM (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents) s
), f AS (SELECT *, CASE WHEN word_count > 0 THEN letters / word_count ELSE 0.0 END AS avg_word_len, CASE WHEN char_count > 0 THEN hits / char_count ELSE 0.0 END AS math_density FROM p
), d AS (SELECT *, list_filter([CASE WHEN char_count < 120 THEN 'sparse' END, CASE WHEN math_density > 0.015 THEN 'math' END,
    CASE WHEN word_count > 0 AND avg_word_len < 2.0 THEN 'garbled' END, CASE WHEN char_count > 12000 THEN 'dense' END], lambda x: x IS NOT NULL) AS codes FROM f
), r AS (SELECT *, CASE WHEN len(codes) > 0 THEN 'vlm' ELSE 'fast' END AS route FROM d)"""


def _report_sql(column: str) -> str:
    return f"""WITH {_PROFILE} SELECT CASE WHEN grouping({column}) = 1 THEN 'TOTAL' ELSE {column} END AS category, count(*) AS pages, count(*) FILTER (route = 'fast') AS fast,
      count(*) FILTER (route = 'vlm') AS vlm, 0::BIGINT AS error, (count(*) FILTER (route = 'vlm')) / count(*) AS rate FROM r GROUP BY ROLLUP ({column})"""


# -- conversations as documents of several pages ---------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "role", "text")
    pages = t.select("doc_id", "page_index", (F.col("role") == "assistant").alias("escalated"))
    one = t.where("role <> 'system'").select("doc_id", "page_index", F.lower("text").alias("markdown"))
    two = t.where("role = 'assistant'").select("doc_id", "page_index", F.when(F.length("text") % 3 > 0, F.col("text")).alias("markdown"), (F.length("text") % 2 == 0).alias("degraded"), (F.length("text") % 5 == 0).alias("fallback"), F.length("text").alias("input_tokens"), F.col("page_index").alias("output_tokens"))
    return pages, one, two


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_tiers(*_turns(spark, sf_dir))


def merged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_pages(spark, sf_dir).select("doc_id", "page_index", "markdown", "from_tier2", "degraded", "fallback")


def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.concat_pages(merged_pages(spark, sf_dir))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.document_summary(merged_pages(spark, sf_dir)).select("doc_id", "pages", "tier2_pages", "tier2_fraction", "degraded_pages", "fallback_pages", "input_tokens", "output_tokens", "chars")


_MERGED = """t AS (SELECT conv_id AS doc_id, turn AS page_index, role, text, role = 'assistant' AS two FROM conversations),
m AS (SELECT doc_id, page_index, two AS escalated, CASE WHEN two THEN CASE WHEN length(text) % 3 > 0 THEN text ELSE '' END WHEN role <> 'system' THEN coalesce(lower(text), '') ELSE '' END AS markdown,
  two AS from_tier2, coalesce(two AND length(text) % 2 = 0, false) AS degraded, coalesce(two AND length(text) % 5 = 0, false) AS fallback,
  CASE WHEN two THEN length(text) ELSE 0 END AS input_tokens, CASE WHEN two THEN page_index ELSE 0 END AS output_tokens FROM t)"""


# -- replies ---------------------------------------------------------------------------------


def degenerate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", protocol.degenerate(F.col("text")).alias("r"))
    return d.select("doc_id", "r.detected", "r.kind", "r.ngram_size", "r.repeats")


def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a tail made up by repeating their end."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.repeat(F.right(F.col("text"), F.lit(5)), F.lit(60))).alias("text"))
    report, rest = protocol.degenerate_and_rest(F.col("text"))
    return d.select("doc_id", report["detected"].alias("detected"), F.md5(rest).alias("digest"))


def _loops_sql(table: str = "documents") -> str:
    """The run of the last n characters at the end is what an anchored pattern matches."""
    return f"""c AS (SELECT doc_id, text, regexp_replace(text, '\\s+', ' ', 'g') AS t, regexp_extract(text, '[ \\t]{{200,}}|(?:\\r?\\n){{40,}}') AS spiral FROM {table}),
n AS (SELECT doc_id, t, right(t, 300) AS tail, n::INT AS n, greatest(3, ceil(200 / n))::INT AS k FROM c, range(1, 65) s(n)),
hit AS (SELECT doc_id, t, n, right(t, n) AS unit FROM n WHERE length(tail) >= n * k AND right(tail, n * k) = repeat(right(tail, n), k)),
many AS (SELECT doc_id, n, unit, length(regexp_extract(t, '(?:' || regexp_escape(unit) || ')+$')) // n AS repeats FROM hit),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n * repeats DESC, n) AS place FROM many),
loops AS (SELECT c.doc_id, text, unit, spiral <> '' OR best.n IS NOT NULL AS detected, CASE WHEN spiral <> '' THEN 'whitespace_spiral' WHEN best.n IS NOT NULL THEN 'repetition_loop' ELSE '' END AS kind,
  CASE WHEN spiral <> '' OR best.n IS NULL THEN 0 ELSE best.n END AS ngram_size, CASE WHEN spiral <> '' OR best.n IS NULL THEN 0 ELSE repeats::INT END AS repeats
FROM c LEFT JOIN best ON best.doc_id = c.doc_id AND place = 1)"""


TRUNCATED_SQL = f"""WITH made AS (SELECT doc_id, text || repeat(right(text, 5), 60) AS text FROM documents), {_loops_sql("made")},
m AS (SELECT *, length(regexp_extract(regexp_replace(text, '\\s', ' ', 'g'), '(?:' || regexp_escape(unit) || ')+$')) // ngram_size AS units FROM loops)
SELECT doc_id, detected, md5(CASE kind WHEN 'repetition_loop' THEN regexp_replace(left(text, (length(text) - greatest(coalesce(units, 0) - 1, 0) * ngram_size)::BIGINT), '\\s+$', '')
  WHEN 'whitespace_spiral' THEN regexp_replace(regexp_replace(text, '[ \\t]{{200,}}|(?:\\r?\\n){{40,}}', chr(10) || chr(10), 'g'), '\\s+$', '') ELSE text END) AS digest FROM m"""


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of each document's text under a header that depends on its id."""
    k = F.col("doc_id") % 4
    header = F.concat(
        F.lit("---\nprimary_language: "), F.when(k == 1, "null").otherwise(F.col("lang")), F.lit("\nis_rotation_valid: "), F.when(k == 2, "False").otherwise("True"),
        F.lit("\nrotation_correction: "), F.when(k == 2, "90").when(k == 3, "45").otherwise("0"), F.lit("\nis_table: "), F.when(k == 0, "yes").otherwise("False"), F.lit("\nis_diagram: False\n---\n"),
    )
    reply = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat(header, "text"))
    d = read(spark, sf_dir, "documents").select("doc_id", protocol.page_response(reply).alias("r"))
    return d.select("doc_id", "r.primary_language", "r.is_rotation_valid", "r.rotation_correction", "r.is_table", "r.is_diagram", F.length("r.natural_text").alias("chars"))


FRONT_MATTER_SQL = """SELECT doc_id, CASE WHEN bare OR k = 1 THEN NULL ELSE lang END AS primary_language, bare OR k <> 2 AS is_rotation_valid, CASE WHEN NOT bare AND k = 2 THEN 90 ELSE 0 END AS rotation_correction,
  NOT bare AND k = 0 AS is_table, false AS is_diagram, nullif(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 0) AS chars
FROM (SELECT doc_id, lang, text, doc_id % 4 AS k, doc_id % 7 = 0 AS bare FROM documents) d"""


def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as fenced, wrapped, plain and broken replies."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).when(k == 2, F.col("props")).otherwise(F.concat(F.lit("{"), "props"))
    x = e.select("event_id", protocol.extract_json(reply).alias("json"))
    return x.select("event_id", F.col("json").isNotNull().alias("valid"), protocol.validated(F.col("json"), "k int", ("k",))["k"].alias("k"))


def tables_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a chart model's flat rows, ragged for some."""
    raw = F.concat(F.lit("TITLE | Order "), F.col("o_orderkey").cast("string"), F.lit("<0x0A>status | priority<0x0A>"), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" | "), "o_orderpriority")).otherwise(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", protocol.linearised_to_markdown(raw).alias("markdown"))


def latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 3
    source = F.when(k == 0, F.concat(F.lit("  x_{"), F.col("p_size").cast("string"), F.lit("} "))).when(k == 1, F.lit("$y$")).otherwise(F.lit(" "))
    return p.select("p_partkey", protocol.wrap_latex(source, F.col("p_size") > 20).alias("latex"))


REPORT = "Average Score: 78.9% ± 1.2% (average of per-JSONL scores)\ntables.jsonl : 84.8% (159/188 tests)\nmulti_column.jsonl : 83.8% (741/884 tests)\ntables.jsonl : 1.0% (1/2 tests)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's report, once for each region, the interval missing for some."""
    text = F.when(F.col("r_regionkey") % 2 == 0, F.lit(REPORT)).otherwise(F.regexp_replace(F.lit(REPORT), " ± 1.2%", ""))
    r = read(spark, sf_dir, "region").select("r_regionkey", protocol.overall_score(text).alias("o"), protocol.category_scores(text).alias("c"))
    return r.select("r_regionkey", "o.overall", F.round("o.ci_low", 3).alias("ci_low"), F.round("o.ci_high", 3).alias("ci_high"), F.explode("c").alias("c")).select("r_regionkey", "overall", "ci_low", "ci_high", "c.name", "c.score", "c.tests")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts, eight to a page at most."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = read(spark, sf_dir, "events").withColumn("__n", n)
    kind = F.col("event_type")
    turn = F.when(kind == "signup", "is_rotation_valid: False\nrotation_correction: 90").otherwise("is_rotation_valid: True\nrotation_correction: 0")
    body = F.when(kind == "purchase", "").otherwise(F.concat(F.lit("page "), F.col("event_id").cast("string")))
    content = F.concat(F.lit("---\nprimary_language: en\n"), turn, F.lit("\nis_table: True\nis_diagram: False\n---\n"), body)
    tokens = F.floor("value").cast("int")
    return e.select(
        F.col("user_id").alias("doc_id"), F.floor(F.col("__n") / 8).cast("int").alias("page_index"), (F.col("__n") % 8 + 1).alias("attempt"), content.alias("raw_content"),
        F.when(kind == "click", "length").otherwise("stop").alias("finish_reason"), tokens.alias("prompt_tokens"), F.lit(7).alias("completion_tokens"), (tokens + 7).alias("total_tokens"), F.when(kind == "error", "timeout").alias("error"),
    )


def attempt_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = EndpointOptions()
    out = ladder.decide_ladder(ladder.parse_attempts(_attempts(spark, sf_dir), o), o)
    return out.select("doc_id", "page_index", "markdown", "degraded", "fallback", "attempts", "is_table", "input_tokens", "output_tokens")


LADDER_SQL = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
a AS (SELECT user_id AS doc_id, (n // 8)::INT AS page_index, (n % 8 + 1)::INT AS attempt, event_type AS kind, CASE WHEN event_type = 'purchase' THEN '' ELSE 'page ' || event_id END AS body,
  coalesce(floor(value)::INT, 0) AS tokens FROM n),
b AS (SELECT *, kind = 'signup' AND row_number() OVER (PARTITION BY doc_id, page_index, kind = 'signup' ORDER BY attempt) = 1 AS spent FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY attempt) AS place FROM b WHERE kind NOT IN ('error', 'click') AND tokens + 7 <= 16384 AND NOT spent),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY attempt DESC) AS place FROM b WHERE kind <> 'error'),
p AS (SELECT doc_id, page_index, max(attempt) AS made FROM a GROUP BY doc_id, page_index)
SELECT p.doc_id, p.page_index, CASE WHEN w.attempt IS NOT NULL THEN w.body WHEN l.body <> '' THEN l.body ELSE '' END AS markdown, w.attempt IS NULL AS degraded,
  w.attempt IS NULL AND coalesce(l.body, '') = '' AS fallback, coalesce(w.attempt, p.made) AS attempts, coalesce(w.body <> '', false) AS is_table,
  CASE WHEN w.attempt IS NOT NULL THEN w.tokens WHEN l.body <> '' THEN l.tokens ELSE 0 END AS input_tokens, CASE WHEN w.attempt IS NOT NULL OR l.body <> '' THEN 7 ELSE 0 END AS output_tokens
FROM p LEFT JOIN w ON w.doc_id = p.doc_id AND w.page_index = p.page_index AND w.place = 1 LEFT JOIN l ON l.doc_id = p.doc_id AND l.page_index = p.page_index AND l.place = 1"""


# -- governance ------------------------------------------------------------------------------


def licence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers' components, the denylist, and the parts' brands, which are in no registry."""
    own = governance.bill_of_materials(spark).union(spark.createDataFrame([(n,) for n in governance.DENYLIST], "name string"))
    names = own.union(read(spark, sf_dir, "part").select("p_brand").distinct())
    return governance.audit(names, governance.registry(spark)).select("name", "license_class", "violation")


def serving_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each supplier, whose key makes up its machine."""
    k = F.col("s_suppkey")
    gpu = F.struct(F.lit(0).alias("index"), F.lit("card").alias("name"), ((k % 5 + 2) * 8192).cast("int").alias("memory_total_mb"), F.when(k % 2 == 0, 8.9).otherwise(8.0).alias("compute_capability"))
    machines = read(spark, sf_dir, "supplier").select(k.alias("machine"), (k % 3 == 0).alias("shared_display"), F.when(k % 7 == 0, F.slice(F.array(gpu), 1, 0)).otherwise(F.array_repeat(gpu, (k % 2 + 1).cast("int"))).alias("gpus"))
    p = governance.plan_serving(machines)
    return p.select("machine", "quantization", "max_model_len", "gpu_memory_utilization", "max_num_seqs", F.array_join("warnings", ",").alias("warnings"), F.array_join("errors", ",").alias("errors"), "ok")


SERVING_SQL = """WITH g AS (SELECT s_suppkey AS machine, s_suppkey % 3 = 0 AS shared, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 2 + 1 END AS cards, (s_suppkey % 5 + 2) * 8 AS gb, s_suppkey % 2 = 0 AS fp8 FROM supplier),
u AS (SELECT *, CASE WHEN shared THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS use FROM g),
k AS (SELECT *, gb * use - CASE WHEN fp8 THEN 8.5 ELSE 16.0 END::DOUBLE AS kv FROM u), f AS (SELECT *, cards > 0 AND kv >= 1 AS fits FROM k)
SELECT machine, CASE WHEN cards = 0 OR fp8 THEN 'fp8' ELSE 'none' END AS quantization, CASE WHEN fits AND kv < 3 THEN 8192 ELSE 16384 END AS max_model_len, use AS gpu_memory_utilization,
  CASE WHEN fits THEN greatest(4, least(256, floor(floor(kv * 1073741824.0::DOUBLE / 88000) / 4096)))::INT ELSE 256 END AS max_num_seqs,
  concat_ws(',', CASE WHEN fits AND kv < 3 THEN 'context_capped' END, CASE WHEN fits AND shared THEN 'shared_display' END, CASE WHEN fits AND cards > 1 THEN 'prefer_replicas' END) AS warnings,
  CASE WHEN cards = 0 THEN 'no_gpu' WHEN NOT fits THEN 'too_little_memory' ELSE '' END AS errors, cards > 0 AND fits AS ok FROM f"""


# -- benchmark files -------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/d"), k, F.when(F.col("doc_id") % 5 == 0, ".PNG").otherwise(".pdf")).alias("path"))


def bench_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file: category, whether it is an image, its candidate; done ones (labelled) are left out."""
    done = read(spark, sf_dir, "labels").join(_files(spark, sf_dir), "doc_id", "left_semi").select("doc_id")
    f = bench.pending(_files(spark, sf_dir), done, "doc_id")
    return f.select("doc_id", bench.category(F.col("path")).alias("category"), bench.is_image(F.col("path")).alias("image"), bench.candidate_path(F.col("path"), 1, 2).alias("candidate"))


def bench_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests, malformed for some, of the documents that are labelled."""
    line = F.when(F.col("doc_id") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("pdf"), F.lit(1).alias("page"))))
    tests = bench.parse_tests(read(spark, sf_dir, "documents").select("doc_id", line.alias("line")))
    kept = read(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("pdf"))
    return bench.subset_tests(tests, kept).select("doc_id", "pdf")


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _files(spark, sf_dir).select("doc_id", F.col("path").alias("pdf"))
    outcomes = d.where("doc_id % 11 <> 0").select("pdf", F.lit("text").alias("markdown"), F.when(F.col("doc_id") % 4 == 0, "failed").alias("error"), (F.col("doc_id") % 6).alias("pages"), (F.col("doc_id") % 2).alias("escalated"))
    existing = d.where("doc_id % 9 = 0").select(F.explode(F.array(bench.candidate_path(F.col("pdf"), 1, 1), bench.candidate_path(F.col("pdf"), 1, 2))).alias("path"))
    return bench.candidate_summary(bench.candidate_rows(d.select("pdf"), outcomes, existing, 2))


def markup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", has_markup(F.col("html")).alias("marked"))


# -- geometry: an order is a page, its items are what lies on it ------------------------------


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Pages and boxes with whole coordinates, so that engines compare alike."""
    i = read(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") * 10, (F.col("l_linenumber") * 70).cast("double")
    box = i.select(
        F.col("l_orderkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1).alias("obj_id"),
        F.when(F.col("l_partkey") % 3 == 0, "image").otherwise("path").alias("kind"), x.alias("x0"), y.alias("y0"), (x + F.col("l_suppkey") % 90).alias("x1"), (y + F.col("l_partkey") % 40).alias("y1"),
    )
    pages = box.select("doc_id").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return pages, box, ("doc_id",)


_BOXES = """b AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS obj_id, CASE WHEN l_partkey % 3 = 0 THEN 'image' ELSE 'path' END AS kind,
  l_quantity * 10 AS x0, l_linenumber * 70.0::DOUBLE AS y0, l_quantity * 10 + l_suppkey % 90 AS x1, l_linenumber * 70.0::DOUBLE + l_partkey % 40 AS y1 FROM lineitem)"""


def object_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, box, key = _boxes(spark, sf_dir)
    p = triage.profile_objects(box, pages, key)
    return p.select("doc_id", "image_object_count", "path_object_count", F.round("image_area_ratio", 9).alias("image_area_ratio"))


def decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images stand for spans; thin wide paths are the rules."""
    _, box, key = _boxes(spark, sf_dir)
    s = box.where("kind = 'image'").select("doc_id", F.col("obj_id").alias("span_index"), *"x0 y0 x1 y1".split(), F.lit(False).alias("underline"), F.lit(False).alias("strikeout"))
    thin = box.where("kind = 'path'").withColumn("y0", F.col("y0") + F.col("obj_id") % 3 - 70).withColumn("y1", F.col("y0") + F.col("x1") % 4).withColumn("x0", F.lit(0.0))
    return spans.decorate(s, spans.rules(thin, key), key).select("doc_id", "span_index", "underline", "strikeout")


DECORATIONS_SQL = f"""WITH {_BOXES}, s AS (SELECT * FROM b WHERE kind = 'image'), q AS (SELECT doc_id, 0.0::DOUBLE AS x0, x1, y0 + obj_id % 3 - 70 AS y0, y0 + obj_id % 3 - 70 + x1 % 4 AS y1 FROM b WHERE kind = 'path'),
r AS (SELECT doc_id, x0, x1, (y0 + y1) / 2 AS mid FROM q WHERE y1 - y0 <= 3 AND x1 - x0 >= 4),
j AS (SELECT s.doc_id, s.obj_id, r.mid BETWEEN s.y0 - 0.35::DOUBLE * (s.y1 - s.y0) AND s.y0 + 0.12::DOUBLE * (s.y1 - s.y0) AS u, r.mid BETWEEN s.y0 + 0.3::DOUBLE * (s.y1 - s.y0) AND s.y0 + 0.72::DOUBLE * (s.y1 - s.y0) AS t
  FROM s JOIN r ON s.doc_id = r.doc_id AND s.y1 > s.y0 AND s.x1 > s.x0 AND greatest(least(s.x1, r.x1) - greatest(s.x0, r.x0), 0) >= 0.55::DOUBLE * (s.x1 - s.x0)),
h AS (SELECT doc_id, obj_id, bool_or(u) AS u, bool_or(t) AS t FROM j GROUP BY doc_id, obj_id)
SELECT s.doc_id, s.obj_id AS span_index, coalesce(h.u, false) AS underline, coalesce(h.t, false) AS strikeout FROM s LEFT JOIN h ON s.doc_id = h.doc_id AND s.obj_id = h.obj_id"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, box, key = _boxes(spark, sf_dir)
    s = box.select("doc_id", F.col("obj_id").alias("span_index"), F.repeat(F.lit("x"), (F.col("x1") - F.col("x0") + 1).cast("int")).alias("text"), (F.lit(8.0) + F.col("x0") % 70 / 10).alias("size"), (F.col("kind") == "image").alias("bold"), F.lit(0).alias("heading_level"))
    return spans.heading_levels(s, key).select("doc_id", "span_index", "heading_level")


HEADINGS_SQL = f"""WITH {_BOXES}, s AS (SELECT doc_id, obj_id, (x1 - x0 + 1)::INT AS n, 8.0::DOUBLE + x0 % 70 / 10 AS size, kind = 'image' AS bold FROM b),
w AS (SELECT doc_id, median(size) AS body FROM (SELECT doc_id, size, unnest(range(n)) AS i FROM s) e GROUP BY doc_id),
t AS (SELECT s.*, body, size >= body * 1.15::DOUBLE AS large FROM s JOIN w USING (doc_id)),
g AS (SELECT doc_id, round(size, 1) AS rounded, row_number() OVER (PARTITION BY doc_id ORDER BY round(size, 1) DESC) AS place FROM t WHERE large AND n > 1 GROUP BY doc_id, round(size, 1)),
c AS (SELECT doc_id, count(*) AS tops FROM g WHERE place <= 3 GROUP BY doc_id)
SELECT t.doc_id, t.obj_id AS span_index, CASE WHEN large AND g.place <= 3 THEN g.place WHEN bold AND size >= body * 1.08::DOUBLE AND n <= 120 THEN least(coalesce(tops, 0) + 1, 3) ELSE 0 END::INT AS heading_level
FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.rounded = round(t.size, 1) LEFT JOIN c ON c.doc_id = t.doc_id"""


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as spans: rows that only their first span holds together, gutters, lists and headings."""
    pages, box, key = _boxes(spark, sf_dir)
    n, text = F.col("obj_id"), F.concat(F.col("kind"), F.col("obj_id").cast("string"))
    s = box.withColumns({"span_index": n, "text": F.when(n % 4 == 1, F.concat(F.lit("- "), text)).when(n % 4 == 2, F.concat(F.lit("2. "), text)).otherwise(text), "heading_level": F.when(F.col("x0") % 3 == 0, n % 3).otherwise(0)})
    s = s.withColumn("y0", F.col("y0") - n % 2 * 70 + n % 3 * 6)
    return layout.document_layout(pages, s.withColumn("y1", F.col("y0") + 20), key)


LAYOUT_SQL = f"""WITH RECURSIVE {_BOXES}, t AS (SELECT doc_id, obj_id AS i, kind || obj_id AS t, x0, x1, y0 - obj_id % 2 * 70 + obj_id % 3 * 6 AS y0, CASE WHEN x0 % 3 = 0 THEN obj_id % 3 ELSE 0 END AS level FROM b),
s AS (SELECT doc_id, i, CASE i % 4 WHEN 1 THEN '- ' || t WHEN 2 THEN '2. ' || t ELSE t END AS text, x0, x1, y0, y0 + 20 AS y1, level, -(y0 + 10) AS down, row_number() OVER (PARTITION BY doc_id ORDER BY -(y0 + 10), x0, i) AS pos FROM t),
r AS (SELECT doc_id, pos, down AS anchor, 0 AS row FROM s WHERE pos = 1 UNION ALL
  SELECT s.doc_id, s.pos, CASE WHEN abs(s.down - r.anchor) <= 11 THEN r.anchor ELSE s.down END, CASE WHEN abs(s.down - r.anchor) <= 11 THEN r.row ELSE r.row + 1 END FROM r JOIN s ON s.doc_id = r.doc_id AND s.pos = r.pos + 1),
c AS (SELECT s.*, row, coalesce(x0 - lag(x1) OVER w > 120, false)::INT AS cut, row_number() OVER w AS spot FROM s JOIN r ON s.doc_id = r.doc_id AND s.pos = r.pos WINDOW w AS (PARTITION BY s.doc_id, row ORDER BY x0, down, i)),
p AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, row ORDER BY spot) AS part FROM c),
l AS (SELECT doc_id, row, part, trim(string_agg(text, ' ' ORDER BY spot)) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(level) AS level FROM p GROUP BY doc_id, row, part),
e AS (SELECT *, x1 <= 312 AS le, x0 >= 288 AS ri, count(*) OVER d AS n, count(*) FILTER (x1 <= 312) OVER d AS nl, count(*) FILTER (x0 >= 288) OVER d AS nr FROM l WINDOW d AS (PARTITION BY doc_id)),
k AS (SELECT *, unnest(CASE WHEN n >= 6 AND nl >= 3 AND nr >= 3 AND n - nl - nr <= greatest(2, n * 0.15) THEN list_filter([CASE WHEN le THEN 1 END, CASE WHEN ri THEN 2 END, CASE WHEN NOT le AND NOT ri THEN 0 END], lambda x: x IS NOT NULL) ELSE [0] END) AS col FROM e),
g AS (SELECT *, (NOT coalesce(lag(level) OVER w = level AND least(lag(x1) OVER w, x1) - greatest(lag(x0) OVER w, x0) > 0 AND lag(y0) OVER w - y1 <= greatest(y1 - y0, 1) * 1.8::DOUBLE, false))::INT AS fresh FROM k WINDOW w AS (PARTITION BY doc_id, col ORDER BY row, part)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, col ORDER BY row, part) AS block FROM g),
o AS (SELECT doc_id, col, block, trim(string_agg(text, ' ' ORDER BY row, part)) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(level) AS level FROM h GROUP BY doc_id, col, block)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY col, block) - 1)::INT AS reading_order, text, greatest(x0 / 600.0::DOUBLE, 0) AS x, greatest((800.0::DOUBLE - y1) / 800.0::DOUBLE, 0) AS y, least((x1 - x0) / 600.0::DOUBLE, 1) AS w, least((y1 - y0) / 800.0::DOUBLE, 1) AS h,
  CASE WHEN level = 1 THEN 'Title' WHEN level > 1 THEN 'Section' WHEN text[1:2] = '- ' OR text[1:3] = '2. ' THEN 'List' ELSE 'Text' END AS label, level AS heading_level FROM o WHERE text <> ''"""


def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image box with the paths within it, whether they make a lattice, and the centres inside."""
    _, box, key = _boxes(spark, sf_dir)
    images = box.where("kind = 'image'").select("doc_id", "obj_id", (F.col("x0") - 200).alias("x0"), (F.col("y0") - 150).alias("y0"), (F.col("x1") + 200).alias("x1"), (F.col("y1") + 150).alias("y1"), F.lit(12.0).alias("gap"))
    paths = box.where("kind = 'path'").select("doc_id", "x0", "y0", "x1", "y1")
    return regions.with_chars(regions.with_lattice(regions.with_members(images, paths, key), paths, key), paths, key).select("doc_id", "obj_id", "path_count", "lattice", "text_chars")


MEMBERS_SQL = f"""WITH {_BOXES}, i AS (SELECT doc_id, obj_id, x0 - 200 AS x0, y0 - 150 AS y0, x1 + 200 AS x1, y1 + 150 AS y1 FROM b WHERE kind = 'image'), p AS (SELECT * FROM b WHERE kind = 'path'),
j AS (SELECT i.doc_id, i.obj_id, p.doc_id IS NOT NULL AND p.x0 >= i.x0 - 12 AND p.x1 <= i.x1 + 12 AND p.y0 >= i.y0 - 12 AND p.y1 <= i.y1 + 12 AS inside, p.x1 >= i.x0 AND p.x0 <= i.x1 AND p.y1 >= i.y0 AND p.y0 <= i.y1 AS meets,
  p.x1 - p.x0 >= (i.x1 - i.x0) * 0.6::DOUBLE AND p.y1 - p.y0 <= 3 AS flat, p.y1 - p.y0 >= (i.y1 - i.y0) * 0.6::DOUBLE AND p.x1 - p.x0 <= 3 AS upright,
  (p.x0 + p.x1) / 2 BETWEEN i.x0 AND i.x1 AND (p.y0 + p.y1) / 2 BETWEEN i.y0 AND i.y1 AS centre FROM i LEFT JOIN p ON i.doc_id = p.doc_id)
SELECT doc_id, obj_id, count(*) FILTER (inside) AS path_count, count(*) FILTER (meets AND flat) >= 3 AND count(*) FILTER (meets AND upright AND NOT flat) >= 3 AS lattice, count(*) FILTER (centre) AS text_chars FROM j GROUP BY doc_id, obj_id"""


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of pages on which each path is drawn as a dozen strokes, and large images."""
    pages, box, key = _boxes(spark, sf_dir)
    large = box.where("kind = 'image'").withColumns({"x1": F.col("x0") + 4 * (F.col("x1") - F.col("x0")), "y1": F.col("y0") + 6 * (F.col("y1") - F.col("y0"))})
    paths = box.where("kind = 'path'").withColumn("y1", F.col("y0") + 3 * (F.col("y1") - F.col("y0")))
    strokes = paths.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumns({"x0": F.col("x0") + F.col("s"), "x1": F.col("x1") + F.col("s")}).drop("s")
    return regions.detect_regions(pages, large.unionByName(strokes), paths, key)


_GROWN = ", ".join(f"""g{n + 1} AS (SELECT DISTINCT a.doc_id, min(least(a.x0, b.x0)) AS x0, min(least(a.y0, b.y0)) AS y0, max(greatest(a.x1, b.x1)) AS x1, max(greatest(a.y1, b.y1)) AS y1
  FROM g{n} a JOIN g{n} b ON a.doc_id = b.doc_id AND a.x0 - 12 <= b.x1 AND b.x0 <= a.x1 + 12 AND a.y0 - 12 <= b.y1 AND b.y0 <= a.y1 + 12 GROUP BY a.doc_id, a.x0, a.y0, a.x1, a.y1)""" for n in range(7))
#: Boxes grow over all that they touch, seven times: a page has at most seven paths.
REGIONS_SQL = f"""WITH {_BOXES}, i AS (SELECT doc_id, obj_id, x0, y0, x0 + 4 * (x1 - x0) AS x1, y0 + 6 * (y1 - y0) AS y1 FROM b WHERE kind = 'image'), p AS (SELECT doc_id, x0, y0, x1, y0 + 3 * (y1 - y0) AS y1 FROM b WHERE kind = 'path'),
s AS (SELECT doc_id, x0 + n AS x0, y0, x1 + n AS x1, y1 FROM p, range(12) t(n)), g0 AS (SELECT DISTINCT doc_id, x0, y0, x1, y1 FROM s), {_GROWN},
m AS (SELECT a.doc_id, a.x0, a.y0, a.x1, a.y1, count(*) FILTER (b.x0 >= a.x0 - 12 AND b.x1 <= a.x1 + 12 AND b.y0 >= a.y0 - 12 AND b.y1 <= a.y1 + 12) AS n,
  count(*) FILTER (meets AND flat) AS flat, count(*) FILTER (meets AND upright AND NOT flat) AS upright FROM g7 a JOIN (SELECT * FROM s) b ON a.doc_id = b.doc_id,
  LATERAL (SELECT b.x1 >= a.x0 AND b.x0 <= a.x1 AND b.y1 >= a.y0 AND b.y0 <= a.y1 AS meets, b.x1 - b.x0 >= greatest(a.x1 - a.x0, 1e-6) * 0.6::DOUBLE AND b.y1 - b.y0 <= 3 AS flat, b.y1 - b.y0 >= greatest(a.y1 - a.y0, 1e-6) * 0.6::DOUBLE AND b.x1 - b.x0 <= 3 AS upright) q GROUP BY ALL),
r AS (SELECT doc_id, 'chart' AS kind, n::INT AS path_count, x0, y0, x1, y1 FROM m WHERE n >= 12 AND NOT (flat >= 3 AND upright >= 3) UNION ALL SELECT doc_id, 'figure', 0, x0, y0, x1, y1 FROM i),
t AS (SELECT r.*, (SELECT count(*) FROM p WHERE p.doc_id = r.doc_id AND (p.x0 + p.x1) / 2 BETWEEN r.x0 AND r.x1 AND (p.y0 + p.y1) / 2 BETWEEN r.y0 AND r.y1) AS text_chars FROM r),
z AS (SELECT doc_id, kind, greatest(x0 / 600.0::DOUBLE, 0) AS x, greatest((800 - y1) / 800.0::DOUBLE, 0) AS y, least((x1 - x0) / 600.0::DOUBLE, 1) AS w, least((y1 - y0) / 800.0::DOUBLE, 1) AS h, path_count, text_chars FROM t)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY y, x, kind, w, h) - 1)::INT AS region_order, kind, x, y, w, h, path_count, text_chars FROM z
WHERE greatest(w, 0) * greatest(h, 0) >= 0.015 AND NOT (kind = 'chart' AND text_chars > 5000 * greatest(w, 0) * greatest(h, 0))"""


# -- typography and regions put together ------------------------------------------------------


def char_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as characters whose font, size and lines change on the way."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split("p_name", "")).alias("i", "ch"))
    i, x = F.col("i"), F.col("i") * 5.0
    chars = p.where("ch <> ''").select(
        "doc_id", i.alias("char_index"), F.when(i % 11 == 10, 10).otherwise(F.ascii("ch")).alias("codepoint"), F.when(F.floor(i / 5) % 2 == 0, "Sans").otherwise("Sans-Bold").alias("font"), F.lit(0).alias("flags"),
        F.lit(400).alias("weight"), (F.lit(10.0) + F.floor(i / 7) % 2).alias("size"), F.when(i % 13 != 12, x).alias("x0"), F.lit(0.0).alias("y0"), (x + 5).alias("x1"), F.lit(10.0).alias("y1"),
    )
    return spans.spans_from_chars(chars, ("doc_id",)).select("doc_id", "span_index", "text", "x0", "x1", "font", "size", "bold", "italic")


CHAR_SPANS_SQL = """WITH c AS (SELECT p_partkey AS doc_id, i, i % 11 = 10 AS nl, substr(p_name, (i + 1)::BIGINT, 1) AS ch, (i // 5) % 2 = 1 AS bold, 10.0::DOUBLE + (i // 7) % 2 AS size FROM part, range(0, 200) t(i) WHERE i < length(p_name) AND i % 13 <> 12),
s AS (SELECT *, (NOT nl AND coalesce(lag(nl) OVER w OR bold <> lag(bold) OVER w OR size <> lag(size) OVER w, true))::INT AS starts FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
g AS (SELECT doc_id, run, string_agg(ch, '' ORDER BY i) AS text, min(i) * 5.0::DOUBLE AS x0, max(i) * 5.0::DOUBLE + 5 AS x1, bool_and(bold) AS bold, min(size) AS size FROM r WHERE NOT nl GROUP BY doc_id, run)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::INT AS span_index, text, x0, x1, CASE WHEN bold THEN 'Sans-Bold' ELSE 'Sans' END AS font, size, bold, false AS italic FROM g WHERE trim(text) <> ''"""


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part; its name is bold, italic, a heading, struck in two neighbouring spans, or plain."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 5
    doc, name = F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_name")
    pages = p.select(doc, F.lit(0).alias("page_index"), F.concat(F.when(k == 1, "the ").otherwise(""), name, F.lit("  costs\nmuch")).alias("markdown"))
    cut = F.floor(F.length("p_name") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("n"), F.left(name, cut).alias("t")), F.struct(F.lit(1).alias("n"), F.substr(name, cut + 1).alias("t")))
    parts = F.when((k == 3) & (F.substr(name, cut, F.lit(1)) == " "), halves).otherwise(F.array(F.struct(F.lit(0).alias("n"), name.alias("t"))))
    s = p.where(k != 4).select(doc, F.lit(0).alias("page_index"), k.alias("k"), F.explode(parts).alias("s")).select(
        "doc_id", "page_index", F.col("s.n").alias("span_index"), F.col("s.t").alias("text"), (F.col("s.n") * 30.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("s.n") * 30.0 + 29).alias("x1"), F.lit(10.0).alias("y1"), F.lit(10.0).alias("size"),
        (F.col("k") == 0).alias("bold"), (F.col("k") == 1).alias("italic"), F.lit(False).alias("underline"), (F.col("k") == 3).alias("strikeout"), F.when(F.col("k") == 2, 2).otherwise(0).alias("heading_level"),
    )
    out = formatting.apply_formatting(pages, s)
    return out.select("doc_id", "markdown", "spans_applied", "headings", "bold", "italic", "strikeout")


MARKED_SQL = """SELECT p_partkey::VARCHAR AS doc_id, CASE p_partkey % 5 WHEN 0 THEN '**' || p_name || '**' WHEN 1 THEN 'the *' || p_name || '*' WHEN 2 THEN '## ' || p_name WHEN 3 THEN '~~' || p_name || '~~' ELSE p_name END || '  costs' || chr(10) || 'much' AS markdown,
  (p_partkey % 5 <> 4)::INT AS spans_applied, (p_partkey % 5 = 2)::INT AS headings, (p_partkey % 5 = 0)::INT AS bold, (p_partkey % 5 = 1)::INT AS italic, (p_partkey % 5 = 3)::INT AS strikeout FROM part"""


def fused_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image boxes as regions, two models of which one is asked first and often has nothing to say."""
    _, box, key = _boxes(spark, sf_dir)
    n = F.col("obj_id")
    r = box.where("kind = 'image'").select("doc_id", n.alias("region_order"), F.when(n % 2 == 0, "chart").otherwise("figure").alias("kind"))
    models = spark.createDataFrame([("one", 1, ["chart"]), ("two", 2, ["chart", "figure"])], "name string, rank int, kinds array<string>")
    o = F.col("region_order")
    say = lambda name, blank: r.select("doc_id", "region_order", F.lit(name).alias("name"), F.when(blank, " ").otherwise(F.concat(F.lit(f"{name} "), o.cast("string"))).alias("markdown"))
    pages = r.select("doc_id").distinct().select("doc_id", F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.lit(" \n")).alias("markdown"))
    out = regions.fuse_pages(pages, regions.dispatch(r, models, say("one", o % 3 == 0).union(say("two", o % 4 == 3)), key), key)
    return out.select("doc_id", "markdown", "regions", "fell_back", F.coalesce(F.col("by_kind")["chart"], F.lit(0)).alias("charts"), F.coalesce(F.col("by_specialist")["two"], F.lit(0)).alias("by_two"))


FUSED_SQL = f"""WITH {_BOXES}, r AS (SELECT doc_id, obj_id AS o, obj_id % 2 = 0 AS chart, CASE WHEN obj_id % 2 = 0 AND obj_id % 3 <> 0 THEN 'one ' || obj_id WHEN obj_id % 4 <> 3 THEN 'two ' || obj_id END AS a FROM b WHERE kind = 'image')
SELECT doc_id, CASE WHEN count(a) = 0 THEN 'page ' || doc_id || ' ' || chr(10) ELSE 'page ' || doc_id || chr(10) || chr(10) || string_agg(a, chr(10) || chr(10) ORDER BY o) END AS markdown, count(*) AS regions, count(*) FILTER (a IS NULL) AS fell_back,
  count(*) FILTER (chart)::INT AS charts, count(*) FILTER (starts_with(a, 'two'))::INT AS by_two FROM r GROUP BY doc_id"""


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, box, key = _boxes(spark, sf_dir)
    return anchors.anchors(box.select("doc_id", F.col("obj_id").alias("rect_index"), F.col("kind").alias("text"), "x0", "y0"), key=key)


ANCHORS_SQL = f"""WITH {_BOXES}, l AS (SELECT doc_id, obj_id, '[' || x0::BIGINT || ',' || y0::BIGINT || '] ' || kind AS line FROM b),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY obj_id) AS used FROM l)
SELECT doc_id, concat_ws('\n', string_agg(line, '\n' ORDER BY obj_id) FILTER (used <= {anchors.MAX_CHARS}), CASE WHEN max(used) > {anchors.MAX_CHARS} THEN '{anchors.TRUNCATED}' END) AS anchors FROM u GROUP BY doc_id"""

QUERIES = {
    "page_profile": page_profile, "page_route": page_route, "triage_by_lang": triage_by_lang, "triage_by_source": triage_by_source, "trigger_frequency": trigger_frequency,
    "topologies": topologies, "latency": latency, "merged_texts": merged_texts, "concatenated": concatenated, "summaries": summaries, "degenerate_texts": degenerate_texts,
    "truncated_texts": truncated_texts, "front_matter": front_matter, "json_replies": json_replies, "tables_from_lines": tables_from_lines, "latex": latex, "scores": scores,
    "attempt_ladder": attempt_ladder, "licence_audit": licence_audit, "serving_plans": serving_plans, "bench_paths": bench_paths, "bench_tests": bench_tests,
    "candidate_summary": candidate_summary, "markup_guard": markup_guard, "object_profile": object_profile, "decorations": decorations, "headings": headings,
    "layout_blocks": layout_blocks, "region_members": region_members, "page_regions": page_regions, "page_anchors": page_anchors, "char_spans": char_spans, "marked_pages": marked_pages, "fused_pages": fused_pages,
}

_KNOWN = ", ".join(f"('{r[0]}', '{r[3]}')" for r in governance.REGISTRY)
_TIERS = ", ".join(f"('{n}')" for n in sorted({n for t in governance.TIERS.values() for n in t}) + list(governance.DENYLIST))
_DENIED = ", ".join(f"'{n}'" for n in governance.DENYLIST)

ORACLES = {
    "page_profile": f"WITH {_PROFILE} SELECT doc_id, char_count, word_count, round(avg_word_len, 6) AS avg_word_len, round(math_density, 6) AS math_density FROM f",
    "page_route": f"WITH {_PROFILE} SELECT doc_id, route, array_to_string(codes, ',') AS codes FROM r",
    "triage_by_lang": _report_sql("lang"),
    "triage_by_source": _report_sql("source"),
    "trigger_frequency": f"WITH {_PROFILE} SELECT code, count(*) AS pages FROM (SELECT unnest(codes) AS code FROM r) c GROUP BY code",
    "topologies": f"""WITH {_PROFILE} SELECT topology, count(*) AS pages, count(*) FILTER (on_ AND (force OR route = 'vlm')) AS sent, count(*) FILTER ((on_ AND force) OR route = 'vlm') AS escalated
      FROM r, (VALUES ('vlm_only', true, true), ('hybrid', true, false), ('tier1_only', false, false)) t(topology, on_, force) GROUP BY topology""",
    "latency": """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
      SELECT count(*) AS n, median(value) AS median, max(value) FILTER (place = floor(0.95::DOUBLE * n) + 1) AS p95 FROM s""",
    "merged_texts": f"WITH {_MERGED} SELECT doc_id, page_index, markdown, from_tier2, degraded, fallback FROM m",
    "concatenated": f"WITH {_MERGED} SELECT doc_id, coalesce(string_agg(markdown, '\n\n' ORDER BY page_index) FILTER (markdown <> ''), '') AS markdown FROM m GROUP BY doc_id",
    "summaries": f"""WITH {_MERGED} SELECT doc_id, count(*) AS pages, count(*) FILTER (escalated) AS tier2_pages, round((count(*) FILTER (escalated)) / count(*), 4) AS tier2_fraction, count(*) FILTER (degraded) AS degraded_pages,
      count(*) FILTER (fallback) AS fallback_pages, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
      (coalesce(sum(length(markdown)), 0) + 2 * greatest(count(*) FILTER (markdown <> '') - 1, 0))::BIGINT AS chars FROM m GROUP BY doc_id""",
    "degenerate_texts": f"WITH {_loops_sql()} SELECT doc_id, detected, kind, ngram_size, repeats FROM loops",
    "truncated_texts": TRUNCATED_SQL,
    "front_matter": FRONT_MATTER_SQL,
    "json_replies": "SELECT event_id, event_id % 4 <> 3 AS valid, CASE WHEN event_id % 4 <> 3 THEN (props ->> '$.k')::INT END AS k FROM events",
    "tables_from_lines": """SELECT o_orderkey, '**Order ' || o_orderkey || '**' || chr(10) || chr(10) || '| status | priority |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderstatus || ' | '
      || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END || ' |' AS markdown FROM orders""",
    "latex": """SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN '$y$' WHEN 2 THEN '' ELSE CASE WHEN p_size > 20 THEN '\\[x_{' || p_size || '}\\]' ELSE '\\(x_{' || p_size || '}\\)' END END AS latex FROM part""",
    "scores": """SELECT r_regionkey, 78.9::DOUBLE AS overall, CASE WHEN r_regionkey % 2 = 0 THEN 77.7::DOUBLE END AS ci_low, CASE WHEN r_regionkey % 2 = 0 THEN 80.1::DOUBLE END AS ci_high, name, score, tests
      FROM region, (VALUES ('tables', 84.8::DOUBLE, 188), ('multi_column', 83.8::DOUBLE, 884)) c(name, score, tests)""",
    "attempt_ladder": LADDER_SQL,
    "licence_audit": f"""WITH n AS (SELECT * FROM (VALUES {_TIERS}) t(name) UNION ALL SELECT DISTINCT p_brand FROM part), c AS (SELECT * FROM (VALUES {_KNOWN}) t(name, license_class))
      SELECT n.name, license_class, CASE WHEN license_class IS NULL THEN 'unknown component' WHEN n.name IN ({_DENIED}) THEN 'denylisted' WHEN license_class <> 'permissive' THEN 'licence not permissive' END AS violation FROM n LEFT JOIN c USING (name)""",
    "serving_plans": SERVING_SQL,
    "bench_paths": """SELECT doc_id, source AS category, doc_id % 5 = 0 AS image, source || '/d' || doc_id || '_pg1_repeat2.md' AS candidate FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    "bench_tests": "SELECT doc_id, 'd' || doc_id AS pdf FROM documents WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM labels)",
    "candidate_summary": """WITH r AS (SELECT doc_id, rep, doc_id % 9 = 0 AS skipped, CASE WHEN doc_id % 11 <> 0 AND doc_id % 4 = 0 THEN 'failed' END AS error, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 6 END AS pages, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 2 END AS escalated
        FROM documents, (VALUES (1), (2)) t(rep)), g AS (SELECT *, NOT skipped AND error IS NULL AS good FROM r)
      SELECT count(*) FILTER (good OR (skipped AND rep = 1)) AS pdfs_converted, count(*) FILTER (NOT skipped AND error IS NOT NULL) AS pdfs_failed, (coalesce(sum(pages) FILTER (good), 0))::BIGINT AS pages_total,
        (coalesce(sum(escalated) FILTER (good), 0))::BIGINT AS pages_escalated, CASE WHEN sum(pages) FILTER (good) > 0 THEN sum(escalated) FILTER (good) / sum(pages) FILTER (good) ELSE 0.0 END AS escalation_rate FROM g""",
    "markup_guard": """SELECT page_id, contains(html, '**') OR contains(html, '<u>') OR contains(html, '~~') OR contains(html, chr(10) || '#') OR contains(html, '<b>') OR contains(html, '<strong>') OR contains(html, '<em>')
      OR regexp_replace(html, '^\\s+|\\s+$', '', 'g') = '' OR regexp_matches(html, '^\\s*#') AS marked FROM pages""",
    "object_profile": f"""WITH {_BOXES} SELECT doc_id, count(*) FILTER (kind = 'image') AS image_object_count, count(*) FILTER (kind = 'path') AS path_object_count,
      round(least(coalesce(sum(greatest(x1 - x0, 0) * greatest(y1 - y0, 0)) FILTER (kind = 'image'), 0) / 480000.0::DOUBLE, 1), 9) AS image_area_ratio FROM b GROUP BY doc_id""",
    "decorations": DECORATIONS_SQL,
    "headings": HEADINGS_SQL,
    "layout_blocks": LAYOUT_SQL,
    "region_members": MEMBERS_SQL,
    "page_regions": REGIONS_SQL,
    "page_anchors": ANCHORS_SQL,
    "char_spans": CHAR_SPANS_SQL,
    "marked_pages": MARKED_SQL,
    "fused_pages": FUSED_SQL,
}
