"""From files to Markdown with a decoder and a model made up for the purpose, and what goes into it."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright import __main__ as cli
from pagewright.adapters import model
from pagewright.adapters.specialists import Registry
from pagewright.config import EndpointOptions, PipelineOptions
from pagewright.functions import protocol, text
from pagewright.operators import anchors, bench, governance, ladder, regions, triage
from pagewright.plans import convert as plan
from pagewright.schema import PAGES
from pagewright.sources import files, images
from pagewright.streaming import ingest

PROSE = "The quick brown fox jumps over the lazy dog and walks home. " * 4


def letters(line, y, font="Sans", size=10.0):
    return [(ord(c), font, 0, 400, size, 10.0 + 5 * i, y, 15.0 + 5 * i, y + size) for i, c in enumerate(line)]


def fake_decoder(path, content):
    """Pages are parted by form feeds; a page of its own word is what it says."""
    if content == b"broken":
        raise ValueError("no document")
    for page in content.decode().split("\f"):
        if page == "scan":
            yield files.Page(600.0, 800.0, objects=[("image", 0.0, 0.0, 600.0, 800.0)])
        else:
            yield files.Page(600.0, 800.0, page, chars=letters("Bold words", 700.0, "Sans-Bold") + letters("\n" + PROSE[:60], 600.0))


def factory(options):
    def ask(page, temperature, rotation):
        if page["doc_id"].endswith("down.pdf"):
            raise ConnectionError("refused")
        if temperature < 0.2 and rotation == 0:  # the first attempt finds the page turned
            return model.Reply("---\nis_rotation_valid: False\nrotation_correction: 90\n---\nsideways", "stop", 1, 1, 2)
        if rotation == 90 and temperature < 0.2:
            return model.Reply("go " * 200, "stop", 3, 4, 7)
        return model.Reply(f"---\nprimary_language: en\n---\nread at {rotation} degrees", "stop", 5, 6, 11)

    return ask


@pytest.fixture()
def folder(tmp_path):
    docs = {"a/one.pdf": f"{PROSE}Bold words\fscan", "two.pdf": PROSE, "bad.pdf": "broken", "b/down.pdf": "scan", "note.txt": "no document"}
    for name, content in docs.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content.encode())
    (tmp_path / "out").mkdir()
    return tmp_path


def test_batch(spark, folder):
    done = plan.batch(spark, str(folder / "in"), str(folder / "out"), str(folder / "work"), fake_decoder, client=factory)
    rows = {r.doc_id.rpartition("/in/")[2]: r for r in done.collect()}
    assert set(rows) == {"a/one.pdf", "two.pdf", "bad.pdf", "b/down.pdf"}
    assert rows["bad.pdf"].error == "ValueError: no document" and not (folder / "out/bad.md").exists()
    one = (folder / "out/a/one.md").read_text()
    assert one == PROSE.strip() + " **Bold words**\n\nread at 90 degrees" or "**Bold words**" in one and one.endswith("\n\nread at 90 degrees")
    r = rows["a/one.pdf"]
    assert (r.pages, r.tier2_pages, r.degraded_pages, r.input_tokens, r.output_tokens, r.formatting_marks) == (2, 1, 0, 5, 6, 1)
    assert rows["b/down.pdf"].fallback_pages == 1 and (folder / "out/b/down.md").read_text() == ""
    attempts = spark.read.parquet(*[str(p) for p in (folder / "work/attempts").iterdir()])
    got = {(r.doc_id.rpartition("/in/")[2], r.attempt): r for r in attempts.collect()}
    assert [got["a/one.pdf", n].rotation for n in (1, 2, 3)] == [0, 90, 90] and ("a/one.pdf", 4) not in got
    assert sum(k[0] == "b/down.pdf" for k in got) == 8 and "refused" in got["b/down.pdf", 8].error
    # done ones are skipped
    again = plan.batch(spark, str(folder / "in"), str(folder / "out"), str(folder / "again"), fake_decoder, client=factory)
    assert [r.doc_id.rpartition("/in/")[2] for r in again.collect()] == ["bad.pdf"]


def test_ladder_stops_at_its_budget_and_goes_on_where_it_stopped(spark, tmp_path):
    pages = spark.createDataFrame([("x/down.pdf", 0)], "doc_id string, page_index int")
    o = EndpointOptions(page_budget_s=1e-9, max_attempts=4)
    assert model.run_ladder(pages, factory, str(tmp_path / "a"), o).count() == 1
    assert model.run_ladder(pages, None, str(tmp_path / "a"), o).count() == 1  # nobody is asked again
    with pytest.raises(ValueError):
        EndpointOptions(max_attempts=9)


def test_tier_two_needs_a_client_and_may_not_fall_back(spark, tmp_path):
    pages = spark.createDataFrame([("x/down.pdf", 0, 1.0, 1.0, "layer", None)], PAGES)
    with pytest.raises(model.ModelError):
        plan.convert(pages, str(tmp_path / "a"))
    made = plan.convert(pages, str(tmp_path / "b"), PipelineOptions(tier2_enabled=False))
    assert made.documents.first().markdown == "layer" and made.documents.first().tier2_pages == 1
    strict = PipelineOptions(endpoint=EndpointOptions(fallback_to_text_layer=False, max_attempts=2))
    with pytest.raises(model.ModelError, match="every attempt failed"):
        plan.convert(pages, str(tmp_path / "c"), strict, factory)
    assert plan.convert(pages, str(tmp_path / "d"), PipelineOptions(endpoint=EndpointOptions(max_attempts=1)), factory).documents.first().markdown == "layer"


def test_layout_on_request(spark, tmp_path):
    decoded = spark.createDataFrame([("/x.pdf", bytearray(PROSE.encode()))], "path string, content binary")
    d = files.decode_documents(decoded, fake_decoder).persist()
    made = plan.convert(files.pages_of(d), str(tmp_path), PipelineOptions(emit_layout=True), None, files.objects_of(d), files.chars_of(d))
    assert made.layout.count() == made.documents.first().layout_blocks == 2


def test_command_line(spark, folder, capsys):
    run = lambda *a: cli.run(spark, cli.arguments().parse_args(a))
    assert run("audit") == 0 and "olmocr" in capsys.readouterr().out
    where = ["--decoder", "tests.test_convert:fake_decoder"]
    assert run("triage", str(folder / "in/a"), *where) == 0
    shown = json.loads(capsys.readouterr().out.partition(" ")[2])
    assert [p["route"] for p in shown] == ["fast", "vlm"] and "image coverage 100% > 45%" in shown[1]["reasons"]
    assert run("convert", str(folder / "in/two.pdf"), str(folder / "two.md"), *where, "--work", str(folder / "w1")) == 0
    assert (folder / "two.md").read_text().startswith("The quick")
    assert run("batch", str(folder / "in"), str(folder / "out"), *where, "--tier1-only", "--work", str(folder / "w2")) == 1
    assert "3/4 converted" in capsys.readouterr().err and (folder / "out/two.md").exists()
    assert run("plan") in (0, 1)


# -- parts -----------------------------------------------------------------------------------


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_images_are_documents_of_one_page():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 20, 30) + b"\x01\x01\x11\x00"
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 7, -9)
    for content, size in ((png(300, 200), (300, 200)), (b"GIF89a" + struct.pack("<HH", 4, 5), (4, 5)), (bmp, (7, 9)), (jpeg, (30, 20))):
        assert images.image_size(content) == size
    (page,) = images.decode_image("x.png", png(300, 200))
    assert page.objects == [("image", 0.0, 0.0, 300.0, 200.0)] and page.text == ""
    with pytest.raises(ValueError):
        images.image_size(b"\xff\xd8\xff")


def test_specialists(spark):
    r = Registry()
    r.register("tables", ("chart",), "MIT", "here", lambda: lambda kind, image: "| t |" if image else 1 / 0)
    r.register("gone", ("chart", "figure"), "MIT", "there", lambda: __import__("no_such_module"))
    with pytest.raises(ValueError):
        r.register("tables", ("chart",), "MIT", "here", list)
    with pytest.raises(ValueError):
        r.register("free", ("chart",), " ", "here", list)
    assert r.available() == ["tables"] and r.available("figure") == [] and r.get("other") is None
    bom = {x.name: x for x in r.bill_of_materials(spark).collect()}
    assert bom["tables"].installed and not bom["gone"].installed and bom["gone"].licence == "MIT"
    r.register("rows", ("plot",), "MIT", "here", lambda: lambda kind, image: "TITLE | T<0x0A>a | b<0x0A>1 | 2", "rows")
    r.register("tex", ("formula",), "MIT", "here", lambda: lambda kind, image: " x^2 ", "latex")
    with pytest.raises(ValueError):
        r.register("svg", ("plot",), "MIT", "here", list, "svg")
    others = spark.createDataFrame([("d", 0, 0, "plot", bytearray(b"x")), ("d", 0, 1, "formula", bytearray(b"x"))], "doc_id string, page_index int, region_order int, kind string, image binary")
    assert [x.markdown for x in r.answers(others).orderBy("region_order").collect()] == ["**T**\n\n| a | b |\n|---|---|\n| 1 | 2 |", "\\[x^2\\]"]
    crops = spark.createDataFrame([("d", 0, 0, "chart", bytearray(b"x")), ("d", 0, 1, "chart", bytearray()), ("d", 0, 2, "figure", bytearray(b"x"))], "doc_id string, page_index int, region_order int, kind string, image binary")
    assert [(x.region_order, x.name, x.markdown) for x in r.answers(crops).collect()] == [(0, "tables", "| t |")]
    assert [(x.name, x["rank"]) for x in r.table(spark).orderBy("rank").collect()] == [("tables", 0), ("rows", 1), ("tex", 2)]


def test_serving(spark):
    lines = spark.createDataFrame([("0, Card, 24576, 8.6",), ("1, Card, 24576, 8.6",), ("bad line",), ("2, Card, much, 8.6",)], "line string")
    gpus = governance.parse_gpus(lines)
    assert gpus.count() == 2
    p = governance.plan_serving(governance.this_machine(gpus, "/no/such/file")).withColumn("a", governance.serving_args()).first()
    assert p.quantization == "none" and "prefer_replicas" in p.warnings and p.a[:2] == ["--model", p.model]
    old = governance.plan_serving(governance.this_machine(gpus, "/no/such/file"), "somebody/model-FP8").first()
    assert (old.model, old.quantization) == ("somebody/model-FP8", "fp8") and "fp8_on_old_card" in old.warnings
    shares = spark.createDataFrame([("Linux ... Microsoft-standard-WSL2",), ("Linux 6.1",), (None,)], "v string").select(governance.shares_display(F.col("v")).alias("s"))
    assert [r.s for r in shares.collect()] == [True, False, False]
    audited = governance.audit(spark.createDataFrame([(f"n{i:03}",) for i in range(60)], "name string"), governance.registry(spark))
    with pytest.raises(RuntimeError, match="60 components.*and 10 more"):
        governance.assert_compliant(audited)
    governance.assert_compliant(governance.audit(governance.bill_of_materials(spark), governance.registry(spark)))


def test_render_size_and_crops(spark):
    df = spark.createDataFrame([(612.0, 792.0), (0.0, 0.0)], "w double, h double")
    got = [tuple(r.s) for r in df.select(model.render_size(F.col("w"), F.col("h")).alias("s")).collect()]
    assert got == [(996, 1288), (0, 0)]
    turned = df.select(model.render_size(F.col("w"), F.col("h"), rotation=90).alias("s")).first().s
    assert tuple(turned) == (1288, 996)
    r = spark.createDataFrame([(0.5, 0.5, 0.25, 0.25), (0.0, 0.0, 0.001, 0.5)], "x double, y double, w double, h double")
    crops = [c.crop for c in regions.crop_pixels(r, F.lit(100), F.lit(200)).collect()]
    assert tuple(crops[0]) == (48, 97, 76, 152) and crops[1] is None


def test_prompts(spark):
    df = spark.createDataFrame([("p", "a"), ("p", ""), ("p", None)], "prompt string, anchors string")
    got = [r.p for r in df.select(anchors.anchored_prompt(F.col("prompt"), "HEAD", F.col("anchors")).alias("p")).collect()]
    assert got == ["p\n\nHEAD\na", "p", "p"]
    r = df.limit(1).select(protocol.with_schema(F.col("prompt"), '{"k": 1}').alias("s"), protocol.chat_messages(F.col("prompt"), F.lit("QUJD")).alias("m")).first()
    assert r.s.startswith("p\n\n") and r.s.endswith('{"k": 1}')
    (message,) = json.loads(r.m)
    assert message["content"][0]["text"] == "p" and message["content"][1]["image_url"]["url"].endswith("QUJD")


def test_reports(spark):
    rows = spark.createDataFrame([(f"f{i:02}", f"bad (line {i}) — x" if i % 3 else "timeout") for i in range(30)] + [("ok", None)], "name string, error string")
    assert [(r.message, r["count"]) for r in triage.frequent_messages(rows, "error").collect()] == [("bad", 20), ("timeout", 10)]
    assert [r.name for r in triage.first_failures(rows).collect()] == [f"f{i:02}" for i in range(10)]
    summary = bench.candidate_summary(bench.candidate_rows(spark.createDataFrame([("a.pdf",), ("b.pdf",)], "pdf string"), spark.createDataFrame([("a.pdf", "text", None, 3, 1), ("b.pdf", None, "no", 0, 0)], "pdf string, markdown string, error string, pages int, escalated int"), spark.createDataFrame([], "path string")))
    scores = spark.createDataFrame([(78.9, 77.7, 80.1, [("tables", 84.8, 188)])], "overall double, ci_low double, ci_high double, categories array<struct<name: string, score: double, tests: int>>")
    report = json.loads(bench.report_json(summary, scores, spark.createDataFrame([("b.pdf", "no")], "pdf string, error string"), "mine").first().report)
    assert report["candidate"] == "mine" and report["conversion"]["pages_escalated"] == 1 and report["conversion"]["failures"] == [{"pdf": "b.pdf", "error": "no"}]


def test_files_of_a_benchmark(spark, tmp_path):
    for name in ("tables/b.pdf", "tables/a.pdf", "math/c.PDF", "math/d.png"):
        (tmp_path / "pdfs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pdfs" / name).write_bytes(b"x")
    (tmp_path / "t.jsonl").write_text('{"pdf": "tables/a.pdf"}\n\n{bad\n')
    lines = bench.parse_tests(files.read_test_lines(spark, str(tmp_path))).collect()
    assert [(r.jsonl_name, r.pdf) for r in lines] == [("t.jsonl", "tables/a.pdf")]
    found = files.discover(spark, str(tmp_path)).select(F.col("relative").alias("path"))
    assert [r.path for r in bench.bench_files(found).collect()] == ["pdfs/math/c.PDF", "pdfs/tables/a.pdf", "pdfs/tables/b.pdf"]
    assert [r.path for r in bench.bench_files(found, ["tables"], 1).collect()] == ["pdfs/tables/a.pdf"]
    files.write_markdown(spark.createDataFrame([("x/y.md", "é"), ("z.md", None)], "path string, markdown string"), str(tmp_path / "md"))
    assert (tmp_path / "md/x/y.md").read_text() == "é" and (tmp_path / "md/z.md").read_text() == ""
    assert {r.path for r in files.existing_outputs(spark, str(tmp_path / "md")).collect()} == {"x/y.md", "z.md"}
    with pytest.raises(Exception, match="outside"):
        files.write_markdown(spark.createDataFrame([("../y.md", "é")], "path string, markdown string"), str(tmp_path / "md"))


def test_text_layers(spark):
    pages = spark.createDataFrame([("a", 0, 1.0, 1.0, " x ", None), ("a", 1, 1.0, 1.0, "y", None), ("b", 0, 1.0, 1.0, None, None)], PAGES)
    structured = spark.createDataFrame([("a", 0, "S"), ("a", 1, None)], "doc_id string, page_index int, markdown string")
    assert {(r.doc_id, r.page_index): r.markdown for r in files.structured_or_text(pages, structured).collect()} == {("a", 0): "S", ("a", 1): "", ("b", 0): ""}
    assert [r.markdown for r in files.text_layer(pages, [0]).orderBy("doc_id").collect()] == ["x", ""]
    assert text.sanitize("a\ud800b") == "ab"


def test_unsettled_counts_time(spark):
    rows = [("d", 0, 1, "x", "length", 0, 0, 0, None, 0, 5.0), ("d", 1, 1, "x", "stop", 0, 0, 0, None, 0, 5.0), ("d", 2, 1, None, None, 0, 0, 0, "down", 0, 500.0)]
    parsed = ladder.parse_attempts(spark.createDataFrame(rows, model._COLUMNS))
    assert [r.page_index for r in ladder.unsettled(parsed).collect()] == [0]
    assert sorted(r.page_index for r in ladder.unsettled(parsed, EndpointOptions(page_budget_s=0)).collect()) == [0, 2]


def test_clients_that_try_again():
    calls, waits = [], []

    def flaky(o):
        def ask(page, temperature, rotation):
            calls.append(page)
            if len(calls) < 3:
                raise ConnectionError("refused")
            return model.Reply("ok")

        return ask

    assert model.with_retries(flaky, 3, 1.0, waits.append)(EndpointOptions())({}, 0.1, 0).content == "ok" and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(model.ModelError, match="2 tries"):
        model.with_retries(flaky, 2, 0.0, waits.append)(EndpointOptions())({}, 0.1, 0)


def test_http_client(monkeypatch):
    import io
    import urllib.request

    sent = []

    def urlopen(request, timeout):
        sent.append((request.full_url, json.loads(request.data), timeout))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "---\nis_table: true\n---\nx"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 100, "completion_tokens": 50, "total_tokens": 150}}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    o = EndpointOptions(base_url="http://here/v1/", model="m", timeout_s=5)
    reply = model.http_client(lambda page, side, rotation: f"{side}:{rotation}".encode())(o)({"prompt": "read"}, 0.3, 90)
    assert (reply.finish_reason, reply.prompt_tokens, reply.completion_tokens, reply.total_tokens) == ("stop", 100, 50, 150)
    url, body, timeout = sent[0]
    assert url == "http://here/v1/chat/completions" and timeout == 5 and body["model"] == "m" and body["temperature"] == 0.3 and body["max_tokens"] == o.max_output_tokens
    assert body["messages"][0]["content"][0]["text"] == "read" and body["messages"][0]["content"][1]["image_url"]["url"].endswith("MTI4ODo5MA==")


def test_json_schema():
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

    kind = StructType([StructField("name", StringType(), False), StructField("n", LongType()), StructField("xs", ArrayType(DoubleType()))])
    assert protocol.json_schema(kind) == {"type": "object", "properties": {"name": {"type": "string"}, "n": {"type": "integer"}, "xs": {"type": "array", "items": {"type": "number"}}}, "required": ["name"]}


def test_candidate_of_a_benchmark(spark, tmp_path):
    pdfs = spark.createDataFrame([(f"t/{n}.pdf",) for n in "abc"], "pdf string")
    (tmp_path / "md").mkdir()
    asked = []

    def convert_all(due):
        asked.append(sorted(r.pdf for r in due.collect()))
        return due.select("pdf", F.lit("text").alias("markdown"), F.when(F.col("pdf") == "t/b.pdf", "failed").alias("error"), F.lit(2).alias("pages"), F.lit(1).alias("escalated"))

    r = plan.prepare_candidate(pdfs, str(tmp_path / "w"), str(tmp_path / "md"), convert_all).first()
    assert (r.pdfs_converted, r.pdfs_failed, r.pages_total, r.escalation_rate) == (2, 1, 4, 0.5)
    assert (tmp_path / "md/t/a_pg1_repeat1.md").read_text() == "text" and (tmp_path / "md/t/b_pg1_repeat1.md").read_text() == ""
    (tmp_path / "md/t/c_pg1_repeat1.md").unlink()
    r = plan.prepare_candidate(pdfs, str(tmp_path / "w"), str(tmp_path / "md"), convert_all).first()
    assert asked == [["t/a.pdf", "t/b.pdf", "t/c.pdf"], ["t/c.pdf"]] and (r.pdfs_converted, r.pages_total) == (3, 2)


def test_structured_pages(spark):
    found = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"broken"))], "path string, content binary")

    def extractor(path, content):
        if content == b"broken":
            raise ValueError
        return ["# one", None]

    assert [(r.doc_id, r.page_index, r.markdown) for r in files.structured_pages(found, extractor).collect()] == [("a", 0, "# one"), ("a", 1, "")]


def test_stream_of_documents(spark, folder):
    where = str(folder / "stream")
    for _ in range(2):  # a second run sees nothing new
        ingest.start_ingest(spark, str(folder / "in"), where, str(folder / "check"), available_now=True, decoder=fake_decoder).awaitTermination()
    pages = {(r.doc_id.rpartition("/in/")[2], r.page_index): r for r in spark.read.parquet(f"{where}/pages").collect()}
    assert set(pages) == {("a/one.pdf", 0), ("a/one.pdf", 1), ("two.pdf", 0), ("bad.pdf", 0), ("b/down.pdf", 0)}
    assert [x.code for x in pages["b/down.pdf", 0].reasons] == ["sparse", "images"]
    assert [r.doc_id.rpartition("/in/")[2] for r in ingest.to_redrive(spark, where).collect()] == ["bad.pdf"]
