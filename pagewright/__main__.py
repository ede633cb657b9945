"""python -m pagewright audit | triage | convert | batch | plan; --help tells more.

Decoders and clients are given as module:name, a decoder of (path, bytes) or a client factory.
"""

from __future__ import annotations

import argparse
import importlib
import json
import subprocess
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright.config import EndpointOptions, PipelineOptions
from pagewright.operators import governance, triage
from pagewright.plans import convert as plan
from pagewright.sources import files


def named(where: str | None):
    if not where:
        return None
    module, _, name = where.partition(":")
    return getattr(importlib.import_module(module), name)


def options(args: argparse.Namespace) -> PipelineOptions:
    endpoint = EndpointOptions(base_url=args.base_url, model=args.model)
    return PipelineOptions(endpoint=endpoint, tier2_enabled=not args.tier1_only, force_tier2_all=args.vlm_only, max_tier2_workers=args.workers, emit_layout=args.layout)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagewright")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("audit", help="licences of all components; fails on a violation")
    serve = commands.add_parser("plan", help="a serving plan for this machine's GPUs")
    serve.add_argument("--model", default=None)
    for name, text in (("triage", "route and reasons of each page"), ("convert", "one document to Markdown"), ("batch", "all documents of a folder")):
        p = commands.add_parser(name, help=text)
        p.add_argument("input")
        p.add_argument("--decoder", default="pagewright.sources.images:decode_image")
        if name != "triage":
            p.add_argument("output")
            p.add_argument("--client", default=None)
            p.add_argument("--base-url", default=EndpointOptions.base_url)
            p.add_argument("--model", default="")
            p.add_argument("--workers", type=int, default=8)
            p.add_argument("--tier1-only", action="store_true")
            p.add_argument("--vlm-only", action="store_true")
            p.add_argument("--layout", action="store_true")
            p.add_argument("--work", default=None, help="a folder that all executors share; needed on a cluster")
        if name == "batch":
            p.add_argument("--no-skip", action="store_true")
    return top


def work_folder(spark: SparkSession, given: str | None) -> str:
    if given:
        return given
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/convert-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise SystemExit("give --work, a folder that all executors share")
    return tempfile.mkdtemp(prefix="pagewright-")


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "audit":
        names = governance.bill_of_materials(spark)
        audited = governance.audit(names, governance.registry(spark)).orderBy("name").collect()  # a fixed list
        for r in audited:
            print(f"{r['name']}: {r['license']}" + (f" - {r['violation']}" if r["violation"] else ""))
        return int(any(r["violation"] for r in audited))
    if args.command == "plan":
        try:
            said = subprocess.run(["nvidia-smi", "--query-gpu=index,name,memory.total,compute_cap", "--format=csv,noheader,nounits"], capture_output=True, text=True, timeout=20).stdout
        except OSError:
            said = ""
        gpus = governance.parse_gpus(spark.createDataFrame([(x,) for x in said.splitlines()], "line string"))
        machine = governance.this_machine(gpus)
        p = governance.plan_serving(machine, args.model).withColumn("args", governance.serving_args()).first()
        print(json.dumps(p.asDict(recursive=True), indent=2))
        return int(not p.ok)
    decoder = named(args.decoder)
    if args.command == "triage":
        found = files.discover(spark, args.input)
        decoded = files.decode_documents(found, decoder)
        d = triage.decide(triage.profile_objects(files.objects_of(decoded), triage.profile_text(files.pages_of(decoded))))
        for r in triage.triage_json(d).orderBy("doc_id").toLocalIterator():
            print(r.doc_id, r.triage)
        return 0
    work = work_folder(spark, args.work)
    if args.command == "convert":
        found = spark.read.format("binaryFile").load(args.input).select("path", "content")
        decoded = plan._written(files.decode_documents(found, decoder), f"{work}/decoded")
        made = plan.convert(files.pages_of(decoded), work, options(args), named(args.client), files.objects_of(decoded), files.chars_of(decoded))
        r = made.documents.first()
        if args.output == "-":
            print(r.markdown)
        else:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(r.markdown)
        print(f"# pages: {r.pages}, tier 2: {r.tier2_pages} ({r.tier2_fraction:.0%}), degraded: {r.degraded_pages}", file=sys.stderr)
        return 0
    done = plan.batch(spark, args.input, args.output, work, decoder, options(args), named(args.client), not args.no_skip)
    counts = done.agg(F.count("*").alias("all"), F.count("error").alias("failed")).first()
    for r in triage.first_failures(done.select(F.col("doc_id").alias("name"), "error")).collect():
        print(f"FAIL {r['name']}: {r['error']}", file=sys.stderr)
    print(f"# done: {counts['all'] - counts['failed']}/{counts['all']} converted", file=sys.stderr)
    return int(counts["failed"] > 0)


def main() -> int:
    args = arguments().parse_args()
    return run(SparkSession.builder.appName("pagewright").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
