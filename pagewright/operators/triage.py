"""Page profiles, routing and the reports over them. The profile is one Arrow pass over the text, the rest
stays in generated code; nothing is shuffled before the reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import TOPOLOGIES, PipelineOptions, TriageThresholds
from pagewright.functions.text import text_profile

#: Code and message of each trigger, in the order of evaluation.
TRIGGERS = (
    ("sparse", lambda v, t: f"sparse text layer ({v} chars < {t.min_text_chars}) — likely scan"),
    ("images", lambda v, t: f"image coverage {v:.0%} > {t.max_image_area_ratio:.0%}"),
    ("math", lambda v, t: f"math density {v:.3f} > {t.max_math_density}"),
    ("paths", lambda v, t: f"{v} vector paths > {t.max_path_objects} — complex tables/figures"),
    ("garbled", lambda v, t: f"avg word length {v:.1f} < {t.min_avg_word_len} — garbled text layer"),
    ("dense", lambda v, t: f"{v} chars > {t.max_chars_per_page} — very dense page (tiny text)"),
)


def render_reason(code: str, value: float, thresholds: TriageThresholds | None = None) -> str:
    """A reason as text. Engines round differently, so it is made here, from code and value."""
    t = thresholds or TriageThresholds()
    v = int(value) if code in ("sparse", "paths", "dense") else value
    return dict(TRIGGERS)[code](v, t)


def profile_text(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds char_count, word_count, avg_word_len, math_density. A NULL text counts as empty."""
    p = F.col("__profile")
    return pages.withColumn("__profile", text_profile(F.col(text))).withColumns({
        "char_count": p["chars"],
        "word_count": p["words"],
        "avg_word_len": F.when(p["words"] > 0, p["letters"] / p["words"]).otherwise(0.0),
        "math_density": F.when(p["chars"] > 0, p["hits"] / p["chars"]).otherwise(0.0),
    }).drop("__profile")


def profile_objects(objects: DataFrame, pages: DataFrame, key: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """``pages`` with image_object_count, path_object_count, image_area_ratio. A box that could not be
    read counts as an image but covers nothing."""
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    # greatest() skips NULLs, a bad box must not: multiply only where all four are there
    area = F.when(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull(), area)
    image, path = F.col("kind") == "image", F.col("kind") == "path"
    sums = objects.groupBy(*key).agg(F.count_if(image).alias("image_object_count"), F.count_if(path).alias("path_object_count"), F.coalesce(F.sum(F.when(image, area)), F.lit(0.0)).alias("__area"))
    joined = pages.join(sums, list(key), "left")
    ratio = F.least(F.coalesce(F.col("__area"), F.lit(0.0)) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0)), F.lit(1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(*pages.columns, zero("image_object_count"), zero("path_object_count"), ratio.alias("image_area_ratio"))


def reasons(t: TriageThresholds) -> Column:
    """array<struct<code, value>> of the triggers that fire, in order."""
    c, words = F.col("char_count"), F.col("word_count")
    fires = (
        ("sparse", c < t.min_text_chars, c),
        ("images", F.col("image_area_ratio") > t.max_image_area_ratio, F.col("image_area_ratio")),
        ("math", F.col("math_density") > t.max_math_density, F.col("math_density")),
        ("paths", F.col("path_object_count") > t.max_path_objects, F.col("path_object_count")),
        ("garbled", (words > 0) & (F.col("avg_word_len") < t.min_avg_word_len), F.col("avg_word_len")),
        ("dense", c > t.max_chars_per_page, c),
    )
    return F.array_compact(F.array(*[F.when(f, F.struct(F.lit(n).alias("code"), v.cast("double").alias("value"))) for n, f, v in fires]))


def decide(profiles: DataFrame, thresholds: TriageThresholds | None = None) -> DataFrame:
    """Adds ``reasons`` and ``route``: vlm iff a trigger fired. Missing object columns are 0. A page
    with an ``error`` has an empty profile, goes to vlm for that reason and is never dropped."""
    for name, zero in (("image_area_ratio", 0.0), ("path_object_count", 0), ("image_object_count", 0)):
        if name not in profiles.columns:
            profiles = profiles.withColumn(name, F.lit(zero))
    why = reasons(thresholds or TriageThresholds())
    if "error" in profiles.columns:
        bad = F.col("error").isNotNull()
        why = F.when(bad, F.array(F.struct(F.lit("unreadable").alias("code"), F.lit(None).cast("double").alias("value")))).otherwise(why)
        counts = ("char_count", "word_count", "avg_word_len", "math_density", "image_area_ratio", "path_object_count", "image_object_count")
        profiles = profiles.withColumns({n: F.when(bad, F.lit(0)).otherwise(F.col(n)) for n in counts})
    out = profiles.withColumn("reasons", why)
    return out.withColumn("route", F.when(F.size("reasons") > 0, "vlm").otherwise("fast"))


def plan_tiers(decisions: DataFrame, options: PipelineOptions | None = None) -> DataFrame:
    """Adds ``tier`` (1 or 2, who converts the page) and ``escalated`` (who is reported). Without
    tier 2 escalations are reported but none is sent; forcing works only with tier 2."""
    o = options or PipelineOptions()
    vlm = F.col("route") == "vlm"
    forced = o.force_tier2_all and o.tier2_enabled
    tier = F.lit(2) if forced else F.when(vlm, 2).otherwise(1) if o.tier2_enabled else F.lit(1)
    return decisions.withColumns({"tier": tier, "escalated": F.lit(True) if forced else vlm})


def compare_topologies(decisions: DataFrame) -> DataFrame:
    """Each page under each topology: ``topology``, ``tier``, ``escalated``. The three rows are a
    literal array, so the pages are neither joined nor read three times."""
    rows = F.array(*[F.struct(F.lit(n).alias("topology"), F.lit(t).alias("on"), F.lit(f).alias("force")) for n, t, f in TOPOLOGIES])
    x = decisions.withColumn("__t", F.explode(rows))
    vlm, on, force = F.col("route") == "vlm", F.col("__t.on"), F.col("__t.force")
    tier = F.when(on & (force | vlm), 2).otherwise(1)
    return x.withColumns({"topology": F.col("__t.topology"), "tier": tier, "escalated": (on & force) | vlm}).drop("__t")


def triage_report(decisions: DataFrame, category: str, errors: DataFrame | None = None) -> DataFrame:
    """By category and in all (category TOTAL): pages, fast, vlm, escalation rate, and documents that
    raised, where ``errors`` lists them."""
    pages = decisions.select(F.col(category).alias("category"), (F.col("route") == "fast").alias("f"), (F.col("route") == "vlm").alias("v"), F.lit(False).alias("e"))
    if errors is not None:
        no = F.lit(False)
        pages = pages.unionByName(errors.select(F.col(category).alias("category"), no.alias("f"), no.alias("v"), F.lit(True).alias("e")))
    sums = pages.rollup("category").agg(F.count_if("f").alias("fast"), F.count_if("v").alias("vlm"), F.count_if("e").alias("error"), F.grouping("category").alias("__g"))
    n = F.col("fast") + F.col("vlm")
    return sums.select(F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), n.alias("pages"), "fast", "vlm", "error", F.when(n > 0, F.col("vlm") / n).otherwise(0.0).alias("rate"))


def trigger_frequency(decisions: DataFrame) -> DataFrame:
    """Pages by trigger code."""
    return decisions.select(F.explode("reasons.code").alias("code")).groupBy("code").agg(F.count("*").alias("pages"))


def triage_json(decisions: DataFrame, thresholds: TriageThresholds | None = None, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """``triage``: each document's pages in order as one JSON array."""
    t = thresholds or TriageThresholds()

    @F.arrow_udf("array<string>")
    def messages(batch: pa.Array) -> pa.Array:
        return pa.array([["unreadable page" if r["code"] == "unreadable" else render_reason(r["code"], r["value"], t) for r in reasons] for reasons in batch.to_pylist()], pa.list_(pa.string()))

    row = F.struct(
        F.col(page).alias("page"), "route", F.col("__m").alias("reasons"), F.col("char_count").alias("chars"), F.round("math_density", 4).alias("math_density"),
        F.round("image_area_ratio", 3).alias("image_area"), F.col("path_object_count").alias("paths"),
    )
    return decisions.withColumn("__m", messages("reasons")).groupBy(doc).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("triage"))


def message_key(message: Column) -> Column:
    """The part of a message before a bracket or dash; numbers stay in it."""
    return F.trim(F.substring_index(F.substring_index(message, "(", 1), "—", 1))


def frequent_messages(rows: DataFrame, message: str, n: int = 15) -> DataFrame:
    """The ``n`` most frequent kinds of message and how often each is there; at a tie by name."""
    counts = rows.where(F.col(message).isNotNull()).groupBy(message_key(F.col(message)).alias("message")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), "message").limit(n)


def first_failures(rows: DataFrame, n: int = 10, name: str = "name", error: str = "error") -> DataFrame:
    """The first ``n`` by name of those with an error."""
    return rows.where(F.col(error).isNotNull()).select(name, error).orderBy(name, error).limit(n)


#: Ranges of values among which the wanted places are looked for.
RANGES = 256


def latency_stats(rows: DataFrame, value: str) -> DataFrame:
    """Median, and the value at place floor(0.95 n) from 0 of the sorted values. Values are counted, told apart by
    ranges, and counted up within a range only; where a range begins follows from the sums of those below it.
    The borders are approximate quantiles: at most ``RANGES`` numbers that are asked for first. NULLs do not count;
    without a value there is n = 0."""
    numbered = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("x"))
    borders = numbered.agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 100 * RANGES)).first()[0] or []
    counts = numbered.groupBy("x").agg(F.count("*").alias("c"))
    below = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(borders))]), lambda b: b < F.col("x"))) if borders else F.lit(0)
    spread = counts.withColumn("r", below)
    before = F.sum("s").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1))  # over RANGES rows
    starts = spread.groupBy("r").agg(F.sum("c").alias("s")).withColumn("before", F.coalesce(before, F.lit(0)))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("r").orderBy("x"))
    placed = spread.join(F.broadcast(starts.select("r", "before")), "r").withColumn("upto", upto).crossJoin(F.broadcast(starts.agg(F.sum("s").alias("n"))))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    low, high, p95 = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2)), at(F.floor(F.lit(0.95) * F.col("n")))
    return placed.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), ((low + high) / 2).alias("median"), p95.alias("p95"))
