"""The retry ladder as a query over a table of attempts: which answer of a page counts.

Attempts are written down before anything is decided, so that a retried task asks no model
twice. The decision is three windowed passes over one shuffle by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import EndpointOptions
from pagewright.functions.protocol import degenerate, page_response, truncate_degenerate

KEY = ("doc_id", "page_index")


def parse_attempts(attempts: DataFrame, options: EndpointOptions | None = None) -> DataFrame:
    """Adds ``response`` and ``valid``: stopped by itself, within the context, not degenerate."""
    o = options or EndpointOptions()
    a = attempts.withColumn("response", page_response(F.col("raw_content")))
    report = degenerate(F.col("response.natural_text"), o.ngram_size, o.min_repeats, o.min_span_chars)
    a = a.withColumn("__loop", report)
    stopped = F.col("finish_reason").isNull() | (F.col("finish_reason") == "stop")
    fits = F.coalesce(F.col("total_tokens"), F.lit(0)) <= o.max_context
    return a.withColumn("valid", stopped & fits & ~F.coalesce(F.col("__loop.detected"), F.lit(False))).withColumnRenamed("__loop", "loop")


def judged(parsed: DataFrame, options: EndpointOptions, key: tuple[str, ...] = KEY) -> DataFrame:
    """Attempts with ``__first_turn``, the first that asks for another rotation, and ``__wins``."""
    r = F.col("response")
    a = parsed.where(F.col("attempt") <= options.max_attempts)
    turn = F.col("error").isNull() & ~r["is_rotation_valid"] & (r["rotation_correction"] != 0)
    a = a.withColumn("__turns", F.sum(F.when(turn, 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("attempt")))
    a = a.withColumn("__first_turn", turn & (F.col("__turns") == 1))
    return a.withColumn("__wins", F.col("error").isNull() & F.col("valid") & ~F.col("__first_turn"))


def unsettled(parsed: DataFrame, options: EndpointOptions | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """Pages that no attempt has settled and that have time left (``seconds`` of all their attempts against
    ``page_budget_s``, 0 for none), with the ``rotation`` at which to ask next."""
    o = options or EndpointOptions()
    turned = F.coalesce(F.max(F.when(F.col("__first_turn"), F.col("response")["rotation_correction"])), F.lit(0))
    pages = judged(parsed, o, key).groupBy(*key).agg(F.bool_or("__wins").alias("won"), F.sum("seconds").alias("seconds"), turned.alias("rotation"))
    in_time = F.col("seconds") < o.page_budget_s if o.page_budget_s else F.lit(True)
    return pages.where(~F.coalesce("won", F.lit(False)) & in_time)


def decide_ladder(parsed: DataFrame, options: EndpointOptions | None = None, text_layer: DataFrame | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row for each page.

    The first valid attempt wins, blank or not; the first attempt that asks for another rotation
    is spent on rendering again, whatever else it says. Without a winner the last attempt that did not
    fail is salvaged if it has a text, truncated and with its flags at their defaults; else the
    page falls back to its text layer, if allowed, or has an ``error``.
    """
    o = options or EndpointOptions()
    r, wins = F.col("response"), F.col("__wins")
    a = judged(parsed, o, key)
    fields = F.struct("attempt", F.lit(None).alias("pad"), r.alias("response"), F.col("prompt_tokens"), F.col("completion_tokens"), F.col("loop"))
    whole = a.groupBy(*key).agg(
        F.min_by(F.when(wins, fields), F.when(wins, F.col("attempt"))).alias("won"),
        F.max_by(F.when(F.col("error").isNull(), fields), F.when(F.col("error").isNull(), F.col("attempt"))).alias("last"),
        F.max("attempt").alias("made"),
        F.min(F.when(F.col("__first_turn"), F.struct("attempt", r["rotation_correction"].alias("degrees")))).alias("turned"),
    )
    won, salvage = F.col("won").isNotNull(), F.col("won").isNull() & F.col("last.response.natural_text").isNotNull()
    turned = F.when(F.col("turned").isNotNull() & (~won | (F.col("turned.attempt") < F.col("won.attempt"))), F.col("turned.degrees")).otherwise(0)
    if text_layer is not None:
        whole = whole.join(text_layer.select(*key, F.col("text").alias("__layer")), list(key), "left")
    layer = F.coalesce(F.col("__layer"), F.lit("")) if text_layer is not None else F.lit("")
    fall = ~won & ~salvage
    fell = fall if o.fallback_to_text_layer else F.lit(False)
    text = F.when(won, F.coalesce("won.response.natural_text", F.lit(""))).when(salvage, truncate_degenerate(F.col("last.response.natural_text"), F.col("last.loop"))).when(fell, layer)
    note = (
        F.when(won & F.col("won.response.natural_text").isNull(), "model reported no readable text")
        .when(won, "")
        .when(salvage & F.col("last.loop.detected"), F.col("last.loop.kind"))
        .when(salvage, "no valid attempt; last answer kept")
        .when(fell, "no usable attempt; embedded text layer used")
    )
    tokens = lambda c: F.when(won, F.col(f"won.{c}")).when(salvage, F.col(f"last.{c}")).otherwise(0)
    shown = won & F.col("won.response.natural_text").isNotNull()
    return whole.select(
        *key, text.alias("markdown"), (salvage | fell).alias("degraded"), fell.alias("fallback"), note.alias("note"),
        F.when(won, F.col("won.attempt")).otherwise(F.col("made")).alias("attempts"), F.when(fell, 0).otherwise(turned).alias("rotation_applied"),
        F.coalesce(shown & F.col("won.response.is_table"), F.lit(False)).alias("is_table"), F.coalesce(shown & F.col("won.response.is_diagram"), F.lit(False)).alias("is_diagram"),
        F.when(won, F.col("won.response.primary_language")).alias("primary_language"),
        F.coalesce(tokens("prompt_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(tokens("completion_tokens"), F.lit(0)).alias("output_tokens"),
        (F.lit("every attempt failed") if not o.fallback_to_text_layer else F.lit(None).cast("string")).alias("__e"), fall.alias("__fall"),
    ).withColumn("error", F.when(F.col("__fall"), F.col("__e"))).drop("__e", "__fall")
