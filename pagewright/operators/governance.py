"""Licence audit, bills of materials, serving plans: small tables and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.schema import COMPONENTS

P, R = "permissive", "restricted"
REGISTRY = (
    ("marker", "code", "Apache-2.0", P, "Datalab", "orchestration only"),
    ("docling", "code", "MIT", P, "IBM Research", ""),
    ("olmocr-toolkit", "code", "Apache-2.0", P, "Ai2", ""),
    ("pagewright", "code", "Apache-2.0", P, "this project", ""),
    ("vllm", "code", "Apache-2.0", P, "vLLM project", ""),
    ("chandra", "weights", "AI Pubs OpenRAIL-M (modified)", R, "Datalab", "limits on revenue; needs a commercial licence"),
    ("surya", "weights", "OpenRAIL-M (modified)", R, "Datalab", "limits on revenue"),
    ("texify", "weights", "GPL-3.0", R, "Datalab", "copyleft reaches the embedding code"),
    ("olmocr-2-7b", "weights", "Apache-2.0", P, "Ai2", ""),
    ("docling-layout-heron", "weights", "Apache-2.0 (CDLA-Permissive data)", P, "IBM Research", ""),
    ("tableformer", "weights", "MIT", P, "IBM Research", ""),
    ("deplot", "weights", "Apache-2.0", P, "Google Research", "charts to tables"),
    ("table-transformer", "weights", "MIT", P, "Microsoft", ""),
    ("pix2tex", "weights", "MIT", P, "lukas-blecher", "formulas to LaTeX"),
    ("unimernet", "weights", "Apache-2.0", P, "OpenDataLab", "opt-in"),
    ("granite-docling", "weights", "Apache-2.0", P, "IBM Research", ""),
    ("rapidocr", "weights", "Apache-2.0", P, "RapidAI / PaddlePaddle", "downloaded at first use, pin before enabling"),
)
DENYLIST = ("chandra", "surya", "texify")
TIERS = {"tier1": ("pagewright", "docling", "docling-layout-heron", "tableformer"), "tier2": ("pagewright", "marker", "olmocr-toolkit", "olmocr-2-7b", "vllm")}

FP8_CAPABILITY = 8.9
WEIGHTS_GB = {"fp8": 8.5, "none": 16.0}
KV_BYTES, PAGE_TOKENS, MIN_SEQS, MAX_SEQS = 88_000, 4096, 4, 256
FP8_MODEL, BF16_MODEL = "allenai/olmOCR-2-7B-1025-FP8", "allenai/olmOCR-2-7B-1025"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), COMPONENTS)


def bill_of_materials(spark: SparkSession, tiers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Distinct component names over all tiers, sorted."""
    rows = [(t, list(names)) for t, names in (tiers or TIERS).items()]
    return spark.createDataFrame(rows, "tier string, names array<string>").select(F.explode("names").alias("name")).distinct().orderBy("name")


def audit(names: DataFrame, components: DataFrame, denylist: tuple[str, ...] = DENYLIST) -> DataFrame:
    """Each name with its licence and why it is a violation (NULL: cleared). A name that is not in
    the registry is one."""
    j = names.join(components, "name", "left")
    why = F.when(F.col("license_class").isNull(), "unknown component").when(F.col("name").isin(*denylist), "denylisted").when(F.col("license_class") != P, "licence not permissive")
    return j.select("name", "kind", "license", "license_class", why.alias("violation"))


def audit_ok(audited: DataFrame) -> DataFrame:
    return audited.agg(F.coalesce(F.bool_and(F.col("violation").isNull()), F.lit(True)).alias("ok"), F.count_if(F.col("violation").isNotNull()).alias("violations"))


#: Violations that a message names; it tells how many there are.
NAMED = 50


def assert_compliant(audited: DataFrame) -> None:
    bad = audited.where("violation IS NOT NULL")
    n = bad.count()
    if n:
        shown = [f"{r['name']}: {r['violation']}" for r in bad.orderBy("name").take(NAMED)]
        more = f"; and {n - len(shown)} more" if n > len(shown) else ""
        raise RuntimeError(f"{n} components without clearance: " + "; ".join(shown) + more)


def concurrency(kv_gb: Column, page_tokens: int = PAGE_TOKENS) -> Column:
    """Page requests in flight that a KV cache of so many GB bears."""
    if page_tokens <= 0:
        return F.lit(MIN_SEQS)
    fit = F.floor(F.floor(kv_gb * float(1 << 30) / float(KV_BYTES)) / page_tokens)
    return F.when(kv_gb <= 0, MIN_SEQS).otherwise(F.greatest(F.lit(MIN_SEQS), F.least(F.lit(MAX_SEQS), fit))).cast("int")


def parse_gpus(lines: DataFrame, line: str = "line") -> DataFrame:
    """GPU rows from ``index, name, memory, capability`` lines; others are dropped."""
    parts = F.split(F.col(line), ",")
    x = lines.select(parts.alias("p")).where(F.size("p") >= 4)
    field = lambda i: F.trim(F.get("p", F.lit(i)))
    g = x.select(field(0).try_cast("int").alias("index"), field(1).alias("name"), F.floor(field(2).try_cast("double")).cast("int").alias("memory_total_mb"), field(3).try_cast("double").alias("compute_capability"))
    return g.where("index IS NOT NULL AND memory_total_mb IS NOT NULL AND compute_capability IS NOT NULL")


def shares_display(version: Column) -> Column:
    """Whether a kernel's version text is that of a guest whose host draws on the same card."""
    return F.contains(F.lower(F.coalesce(version, F.lit(""))), F.lit("microsoft"))


def this_machine(gpus: DataFrame, version_file: str = "/proc/version") -> DataFrame:
    """One row for ``plan_serving``: the GPUs in order of index, and the display."""
    try:
        with open(version_file, encoding="utf-8", errors="replace") as f:
            version = f.read()
    except OSError:
        version = ""
    cards = F.array_sort(F.collect_list(F.struct("index", "name", "memory_total_mb", "compute_capability")))
    return gpus.agg(F.lit("here").alias("machine"), shares_display(F.lit(version)).alias("shared_display"), cards.alias("gpus"))


def plan_serving(machines: DataFrame, requested_model: str | None = None) -> DataFrame:
    """A plan for each machine (columns machine, shared_display, gpus array in order of index):
    model, quantization, context, utilisation, sequences, KV cache, codes of warnings and errors."""
    first = F.get("gpus", F.lit(0))
    cap, memory = first["compute_capability"], first["memory_total_mb"] / 1024.0
    fp8 = cap >= FP8_CAPABILITY
    auto = F.when(fp8, FP8_MODEL).otherwise(BF16_MODEL)
    if requested_model:
        other = F.lit(requested_model) != auto
        is_fp8 = "FP8" in requested_model.upper()
        model = F.lit(requested_model)
        quant = F.when(other, F.when(F.lit(is_fp8) & ~fp8, "fp8").when(F.lit(not is_fp8), "none").otherwise(F.when(fp8, "fp8").otherwise("none"))).otherwise(F.when(fp8, "fp8").otherwise("none"))
        old_card = other & F.lit(is_fp8) & ~fp8
    else:
        model, quant, old_card = auto, F.when(fp8, "fp8").otherwise("none"), F.lit(False)
    none = F.size("gpus") == 0
    use = F.when(F.col("shared_display"), 0.80).otherwise(0.90)
    p = machines.select("machine", "shared_display", "gpus", F.when(none, FP8_MODEL).otherwise(model).alias("model"), F.when(none, "fp8").otherwise(quant).alias("quantization"), use.alias("gpu_memory_utilization"), none.alias("__none"), F.coalesce(old_card, F.lit(False)).alias("__old"), memory.alias("__mem"))
    p = p.withColumn("__kv", F.col("__mem") * F.col("gpu_memory_utilization") - F.when(F.col("quantization") == "fp8", WEIGHTS_GB["fp8"]).otherwise(WEIGHTS_GB["none"]))
    kv = F.col("__kv")
    fits, tight = F.coalesce(kv >= 1.0, F.lit(False)), kv < 3.0
    same = (F.size("gpus") > 1) & F.forall("gpus", lambda g: g["name"] == first["name"])
    code = lambda c, name: F.when(c, name)
    warnings = F.array_compact(F.array(code(F.col("__old"), "fp8_on_old_card"), code(fits & tight, "context_capped"), code(fits & F.col("shared_display"), "shared_display"), code(fits & same, "prefer_replicas")))
    errors = F.array_compact(F.array(code(F.col("__none"), "no_gpu"), code(~F.col("__none") & ~fits, "too_little_memory")))
    return p.select(
        "machine", "model", "quantization", F.when(fits & tight, 8192).otherwise(16384).alias("max_model_len"), "gpu_memory_utilization", F.lit(1).alias("tensor_parallel_size"),
        F.when(fits, concurrency(kv)).otherwise(MAX_SEQS).alias("max_num_seqs"), F.when(fits, F.round(kv, 2)).otherwise(0.0).alias("kv_cache_gb"), "shared_display", warnings.alias("warnings"), errors.alias("errors"),
    ).withColumn("ok", F.size("errors") == 0)


def serving_args() -> Column:
    """The server's argument list, of the columns of a plan."""
    s = lambda c: F.col(c).cast("string")
    return F.array(F.lit("--model"), F.col("model"), F.lit("--max-model-len"), s("max_model_len"), F.lit("--gpu-memory-utilization"), F.format_string("%.2f", F.col("gpu_memory_utilization")), F.lit("--tensor-parallel-size"), s("tensor_parallel_size"), F.lit("--max-num-seqs"), s("max_num_seqs"), F.lit("--enable-prefix-caching"))
