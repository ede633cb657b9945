"""The training-data operators against brute force, round trips and edge cases."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagewright.llm import bpe, exact_dedup, html_extract, mixing, queries, repair, sharding, simhash, token_rollup, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, lang string, rank int, copy string, hash string"
ODD = ["", " ", "\n\n a  b\t c", "it's we'll  x", "日本語 текст 😀😀", "a" * 3000, "tab\t\t\n  end ", "'s 'll", "x \n y", "1234567 8.9,10"]


def docs(spark, texts, ids=None):
    rows = [(i, t, "s", "en", 7, "keep", None) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_for(bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = bpe.vocabulary(bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY))
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


# -- 1 ---------------------------------------------------------------------------------------


def test_bpe_equals_the_public_encoder(spark, encoder, reference_encoding):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference_encoding.encode_ordinary(t)
        assert encoder.decode(ids) == t


def test_bpe_long_runs_of_lines_without_blanks(encoder, reference_encoding):
    wrapped = base64.encodebytes(random.Random(4).randbytes(200_000)).decode()  # 76 characters a line
    lines = "\n".join(f"w{i}" for i in range(5000))
    for t in (lines, wrapped, f"see {lines}\n\n{lines} 'll\n{wrapped}", "a\n\nb\nc\r\nd\n \ne\n's\x1c\nf"):
        ids = encoder.encode(t)
        assert ids == reference_encoding.encode_ordinary(t)
        assert encoder.decode(ids) == t


def test_bpe_appends_and_edits_are_exact(encoder):
    rng = random.Random(1)
    parts = ["re", "'", "ve ", " the", "  ", "\n", "word", "é", "12", "!?", " a"]
    buffer, text = bpe.TokenBuffer(encoder), ""
    for _ in range(200):
        more = rng.choice(parts)
        buffer.append(more)
        text += more
        if rng.random() < 0.4:
            a = rng.randrange(len(text))
            b, new = min(len(text), a + rng.randrange(4)), rng.choice(parts)
            buffer.replace(a, b, new)
            text = text[:a] + new + text[b:]
        assert buffer.ids == encoder.encode(text)


def test_bpe_table(spark):
    got = bpe.encode(docs(spark, [None, "", "a b"]).withColumn("token_ids", F.lit("old")))
    rows = {r.doc_id: r for r in bpe.decode(got, out="again").collect()}
    assert (rows[0].token_ids, rows[0].again, rows[1].token_ids, rows[1].again, rows[2].again) == (None, None, [], "", "a b")
    assert bpe.encode(docs(spark, [])).count() == 0


# -- 2 ---------------------------------------------------------------------------------------


def test_repair_round_trip_and_slices(spark, reference_encoding):
    texts = [None, *ODD, "the same words again " * 50, "the same words again " * 50]
    packed = repair.compress_documents(docs(spark, texts), shard_tokens=500, min_count=2)
    got = {r.doc_id: r.token_ids for r in repair.decompress(packed).collect()}
    assert got == {i: None if t is None else reference_encoding.encode_ordinary(t) for i, t in enumerate(texts)}
    ids = np.random.default_rng(0).integers(0, 3, 400)
    seq, ends, g = repair.compress(ids, np.array([100, 100, 400]), 10, 2)
    assert len(seq) < 400 and (g.expand(seq) == ids).all() and (g.expand(seq[: ends[0]]) == ids[:100]).all()
    for a, b in ((0, 400), (17, 203), (399, 400), (5, 5)):
        assert (g.slice(seq, a, b) == ids[a:b]).all()
    assert repair.compress_documents(docs(spark, [])).count() == 0


# -- 3 ---------------------------------------------------------------------------------------


def near_texts(n=60):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(120)]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(120)] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_simhash_pairs_equal_brute_force(spark):
    prints = sorted({simhash.fingerprint(t) for t in near_texts()})
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "node bigint, s bigint, v1 bigint, v2 bigint")
    n = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    brute = {(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and n(a[0], b[0]) <= simhash.TAU and n(a[1], b[1]) + n(a[2], b[2]) <= simhash.TAU_PAIRS}
    assert len(brute) > 10
    for thresholds in ([0, 0, 2, 2, 0, 0], [1, 1, 1, 1, 1], [3, 2, 2], [9, -1, -1]):
        if thresholds == [9, -1, -1]:
            continue  # a valid allocation, but far too many values to list
        plan = simhash.Plan(list(range(64))[::-1], thresholds)
        got = {(r.node_a, r.node_b) for r in simhash.near_pairs(nodes, plan=plan).collect()}
        assert got == brute, thresholds
    assert {(r.node_a, r.node_b) for r in simhash.near_pairs(nodes).collect()} == brute
    # hot values cut into blocks, with one side and with two
    for thresholds in ([3, 2, 2], [1, 1, 1, 1, 1]):
        plan = simhash.Plan(list(range(64)), thresholds, most=3)
        assert simhash.hot_values(nodes, plan, 2).count() > 5
        assert {(r.node_a, r.node_b) for r in simhash.near_pairs(nodes, plan=plan, hot=2).collect()} == brute, thresholds
    # no two rows share a value by mere place: each value holds few of the nodes
    listed = simhash.listed_values(nodes, simhash.Plan(list(range(64)), [0, 0, 2, 2, 0, 0]))
    assert listed.groupBy("key").count().agg(F.max("count")).first()[0] < nodes.count()


def test_thresholds_cover_tau():
    for m in simhash.PARTITIONS:
        _, t = simhash.allocate(simhash.TAU, 1e6, [1e6 * (i + 1) for i in range(m)])
        assert sum(x + 1 for x in t) == simhash.TAU + 1


def test_near_dedup_keeps_one_of_each_group(spark):
    t = near_texts(1)[0]
    texts = [t, t, t + " more", None, "", "...", "another thing altogether", t]
    kept = simhash.near_dedup(docs(spark, texts, [5, 3, 9, 1, 2, 4, 6, None]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 6]
    assert kept.columns == docs(spark, []).columns
    assert simhash.near_dedup(docs(spark, [])).count() == 0


# -- 4, 5 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [500_000, 0])
def test_exact_dedup(spark, limit):
    df = docs(spark, ["a", "a", "", "", None, None, "b", "a"], [2, 1, 3, 4, 5, 5, 6, None])
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(df, broadcast_rows=limit).collect()) == [1, 3, 5, 5, 6]
    assert exact_dedup.exact_dedup(docs(spark, []), broadcast_rows=limit).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_exact_dedup_of_many_and_of_hot_texts(spark, bits, monkeypatch):
    rng = random.Random(2)
    texts = [f"text {rng.randrange(300)}" for _ in range(400)] + ["hot"] * 150 + [None, None]
    ids = rng.sample(range(1000), len(texts))
    df = docs(spark, texts, ids)
    first = {}
    for i, t in sorted(zip(ids, texts)):
        first.setdefault(t if t is not None else i, i)
    want = [(first[t if t is not None else i], None if first[t if t is not None else i] == i else i) for i, t in zip(ids, texts)]
    key = lambda p: (p[0], p[1] or -1)
    marked = exact_dedup.mark_duplicates(df, broadcast_rows=0, hot=20, filter_bits=bits)
    got = [(r.keeper, None if r.stays else r.doc_id) for r in marked.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and marked.columns == [*df.columns, "stays", "keeper"]
    # texts that share a hash are told apart by their bytes
    with monkeypatch.context() as m:
        m.setattr(F, "md5", lambda c: F.lpad(F.length(c).cast("string"), 2, "0"))
        collided = exact_dedup.mark_duplicates(df, hot=50)
        assert sorted(((r.keeper, None if r.stays else r.doc_id) for r in collided.collect()), key=key) == sorted(want, key=key)


def slow_jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 400)]
    for n in (1, 7, 1024):
        assert sharding.jump_hash(np.array(keys), n).tolist() == [slow_jump(k, n) for k in keys]
    a, b = sharding.jump_hash(np.arange(50_000), 100), sharding.jump_hash(np.arange(50_000), 110)
    assert set(b[a != b]) <= set(range(100, 110)) and abs((a != b).mean() - 10 / 110) < 0.01
    got = sharding.with_shard(docs(spark, ["x", "y"], [None, 4]).withColumn("shard", F.lit("old")), 8).collect()
    assert {r.doc_id: r.shard for r in got} == {None: None, 4: slow_jump(4, 8)}


# -- 6, 7 ------------------------------------------------------------------------------------


def test_html(spark):
    page = "<html><script>var a='<p>no</p>'</script><nav><a href=x>Home</a><a>News</a></nav><p>" + "A real sentence of the page &amp; more. " * 4 + "</p><p>" + "Another paragraph follows it here. " * 4 + "</p><footer><a>Terms</a> <a>Privacy</a></footer>"
    df = spark.createDataFrame([(1, page, "old"), (2, None, ""), (3, "", ""), (4, "<p>unclosed <b", ""), (5, "1 < 2 and", "")], "page_id int, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_text(df).collect()}
    assert "real sentence of the page & more" in got[1].text and "Home" not in got[1].text and "Privacy" not in got[1].text and "var" not in got[1].text
    assert (got[2].text, got[2].n_blocks, got[3].text, got[3].n_blocks) == (None, None, "", 0)
    assert got[4].n_blocks == 1 and got[5].n_blocks == 1


def test_html_keeps_content_on_pages_of_other_layouts():
    p = lambda n, linked=0: "<p>" + "word " * (n - linked) + "<a>" + "link " * linked + "</a></p>"
    nav, footer = "<nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav>", "<footer>All rights reserved by us</footer>"
    assert html_extract.extract(p(500)) == (" ".join(["word"] * 500), 1, 1)
    for page, kept in (
        (p(60), [60]),
        (nav + p(300), [300]),
        (nav + p(60) + p(90) + p(200), [60, 90, 200]),
        (nav + p(60) + p(100, 5), [60, 100]),
        (p(40) + p(90) + p(50), [40, 90, 50]),
        (nav + p(60, 2) + "<h2>A short heading</h2>" + p(60) + footer, [60, 3, 60]),
        (p(60) + p(40, 1) + p(12) + p(80) + footer, [60, 40, 12, 80]),
        (p(60) + p(20, 2) + p(8) + p(80) + footer, [60, 20, 8, 80]),
        (nav + p(12) + p(9) + p(60) + p(17) + p(10) + footer, [9, 60, 17, 10]),
        (nav + p(60) + p(50) + "<div><a>one two three four</a></div><div><a>five six</a></div>" + footer, [60, 50]),
    ):
        assert [len(b.split()) for b in html_extract.extract(page)[0].split("\n")] == kept


def brute_top_k(v, asking, k):
    s = np.array([[float(np.cumsum(a * b)[-1]) for b in v] for a in v])
    return {i: [(j, s[i, j]) for j in sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[i, j], j))[:k]] for i in asking}


def collected(df):
    got = {}
    for r in df.orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbor_id)
    return got


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_top_k_equals_brute_force(spark, limit):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(150, 6)) * rng.gamma(1, 2, (150, 1))).astype(np.float32)
    v[10] = v[11] = v[12]
    v[20] = 0
    rows = [(i, x.tolist(), "z") for i, x in enumerate(v)] + [(None, [1.0] * 6, ""), (900, None, ""), (901, [], ""), (902, [float("nan")] * 6, ""), (903, [1.0, 2.0], ""), (3, v[3].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    brute = brute_top_k(v.astype(float), range(150), 5)
    got = collected(topk.top_k(df, 5, bucket_rows=20, block_rows=16, broadcast_bytes=limit))
    assert got == {i: [j for j, _ in b] for i, b in brute.items()}
    asked = topk.top_k(df, 5, queries=F.expr("vec_id % 20 = 0"), bucket_rows=20, block_rows=3, broadcast_bytes=limit)
    assert collected(asked) == {i: got[i] for i in range(0, 150, 20)}
    first = asked.where("vec_id = 40 AND rank = 1").first()
    assert (first.neighbor_id, first.score) == (brute[40][0][0], round(brute[40][0][1], topk.DECIMALS))
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_of_tiny_doubles_and_names(spark):
    v = np.random.default_rng(7).normal(size=(60, 4)) * 1e-4
    brute = brute_top_k(v, range(60), 3)
    df = spark.createDataFrame([(f"n{i:03}", x.tolist()) for i, x in enumerate(v)], "vec_id string, embedding array<double>")
    assert collected(topk.top_k(df, 3, bucket_rows=10, block_rows=10)) == {f"n{i:03}": [f"n{j:03}" for j, _ in b] for i, b in brute.items()}


# -- 8, 9, 10 --------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [200_000, 0])
def test_mixing_reaches_the_weights(spark, limit):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, None).otherwise("hot").alias("source"), F.lit("x").alias("copy"))
    out = mixing.mix_sources(df, mixing.Mix(weights={"rare": 1.0, "hot": 1.0}, default_weight=1.0, broadcast_rows=limit))
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert all(abs(x - 1000) < 100 for x in n.values()) and len(n) == 3
    assert out.exceptAll(mixing.mix_sources(df, mixing.Mix(weights={"rare": 1.0, "hot": 1.0}, broadcast_rows=limit))).count() == 0
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    model = toxicity.train(d, labels.where(~held))
    scored = toxicity.with_toxicity(d, model).join(labels.where(held).withColumnRenamed("toxic", "y"), "doc_id").select("toxic", "y").toPandas()
    right = (scored.toxic.astype(int) == scored.y).mean()
    caught = scored[scored.y == 1].toxic.mean()
    assert right > 0.95 and caught > 0.85, (right, caught)
    odd = {r.doc_id: (r.toxicity, r.toxic) for r in toxicity.with_toxicity(docs(spark, [None, "", " "]), model).collect()}
    assert odd == {0: (None, False), 1: (0.0, False), 2: (0.0, False)}
    assert toxicity.drop_toxic(docs(spark, [None, "", " "]), model).count() == 3


def test_toxicity_without_labels(spark):
    model = toxicity.train(docs(spark, ["x"]), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.drop_toxic(docs(spark, ["x", "you idiot"]), model).count() == 2


def test_rollup_is_idempotent(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path))
    df = docs(spark, ["a b", "c", None])
    words = mixing.token_count(F.col("text"))
    assert r.commit("one", token_rollup.changes(df, "w", words)) and not r.commit("one", token_rollup.changes(df, "w", words))
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(3, 3)]
    r.commit("two", token_rollup.revisions(df, "w", words, words + 1))
    r.compact()
    assert not r.commit("two", token_rollup.changes(df, "w", words))
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(3, 6)]
    r.commit("gone", token_rollup.changes(df, "w", words + 1, -1))
    assert r.totals().count() == 0
    assert r.commit("none", token_rollup.changes(docs(spark, []), "w", words))


def test_rollup_survives_crashes_and_commits_during_compaction(spark, tmp_path, monkeypatch):
    r = token_rollup.TokenRollup(spark, str(tmp_path))
    one = token_rollup.changes(docs(spark, ["a b"]).withColumn("source", F.lit(None)), "w", mixing.token_count(F.col("text")))
    publish = token_rollup.TokenRollup._publish

    def dies(self, mark, content):
        raise RuntimeError("the driver died")

    monkeypatch.setattr(token_rollup.TokenRollup, "_publish", dies)
    for call in (lambda: r.commit("one", one), r.compact):
        try:
            call()
        except RuntimeError:
            pass
    assert r.totals().count() == 0 and r.committed() == []
    monkeypatch.setattr(token_rollup.TokenRollup, "_publish", publish)
    assert r.commit("one", one) and r.commit("two", one)
    before = r._entries()
    assert r.commit("three", one)
    # a compaction that listed the batches before the third, and two that listed all
    with monkeypatch.context() as m:
        m.setattr(token_rollup.TokenRollup, "_entries", lambda self: before)
        r.compact()
    r.compact()
    r.compact()
    assert r.commit("four", one) and not r.commit("three", one)
    assert [(x.source, x.docs, x.tokens) for x in r.totals().collect()] == [(None, 4, 8)]
    assert r.committed() == ["four", "one", "three", "two"] and len(r._entries()) == 6
    assert not r._publish(r._mark("one"), {"folder": "another"}) and r._entries()["one"] == before["one"]
    with pytest.raises(ValueError):
        r.commit("fold.x", one)


def test_rollup_query_deletes_just_the_surplus_rows(spark, tmp_path, reference_encoding):
    # repeated rows; an id with two texts, one a copy; copies without ids; NULL and empty texts
    rows = [(1, "one two"), (1, "one two"), (2, "three words here"), (3, "three words here"), (3, "a text of its own"), (None, "one two"), (None, "no id"), (None, "no id"), (4, None), (4, None), (5, ""), (6, "")]
    docs(spark, [t for _, t in rows], [i for i, _ in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    stay = ["one two", "three words here", "a text of its own", "no id", None, None, ""]
    bpe_tokens = sum(1 + len(reference_encoding.encode_ordinary(t)) for t in stay if t is not None)
    got = {r.tokenizer: (r.docs, r.tokens) for r in queries.op10_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {"words-1": (7, sum(len((t or "").split()) for t in stay)), "byte-bpe-50k-1": (7, bpe_tokens)}
