"""The pipeline against a plain version of all its stages, and the queries against their SQL."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import bpe, mixing, queries, repair, simhash, toxicity
from tests.compare import same_rows, tables
from tests.llm.test_operators import SF

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxicity string, token_ids int"


def corpus():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "ne", "sur", "pel") for b in ("ran", "dis", "vo", "ket", "mul", "en", "ars")]
    texts = []
    for _ in range(90):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 140))]
        texts.append(" ".join(base))
        if rng.random() < 0.3:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    bad = [f"you are an {rng.choice(['idiot', 'moron', 'imbecile'])} and your {rng.choice(words)} is {rng.choice(['garbage', 'trash', 'filth'])} {' '.join(rng.choice(words) for _ in range(10))}" for _ in range(40)]
    rows = [(i, t, rng.choice(["hot", "hot", "hot", "b", "c", None])) for i, t in enumerate(texts + bad)]
    rows += [(1000, None, "b"), (1001, "", "b"), (1002, "", "c"), (None, texts[0], "b"), (None, "one of its own kind", None), (5, texts[5], rows[5][2]), (1003, "...", "c")]
    labels = [(len(texts) + k, 1) for k in range(30)] + [(k, 0) for k in range(60)] + [(None, 1)]
    return [(i, t, "en", s, None if t is None else len(t), "keep", 7) for i, t, s in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain_near(rows):
    prints = {i: simhash.fingerprint(r[1]) for i, r in enumerate(rows) if r[0] is not None and simhash.fingerprint(r[1])}
    n = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(prints)
    for x, i in enumerate(order):
        for j in order[:x]:
            a, b = prints[i], prints[j]
            if n(a[0], b[0]) <= simhash.TAU and n(a[1], b[1]) + n(a[2], b[2]) <= simhash.TAU_PAIRS:
                root[find(i)] = find(j)
    best = {}
    for i in prints:
        best[find(i)] = min(best.get(find(i), rows[i][0]), rows[i][0])
    gone = {rows[i][0] for i in prints if best[find(i)] != rows[i][0]}
    return [r for r in rows if r[0] not in gone or r[0] is None]


def plain_mix(rows, mix=mixing.PRODUCTION):
    tokens, out = Counter(), []
    for r in rows:
        tokens[r[3]] += len((r[1] or "").split())
    weight = lambda s: mix.weights.get(s, mix.default_weight)
    some = [s for s in tokens if tokens[s]]
    for r in rows:
        rate = weight(r[3]) * sum(tokens.values()) / (sum(map(weight, some)) * tokens[r[3]]) if tokens[r[3]] else 1.0
        digest = hashlib.md5(f"{mix.seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        out += [r] * (int(rate) + (int(digest[:13], 16) / (1 << 52) < rate - int(rate)))
    return out


def test_pipeline_against_plain_stages(spark, folder):
    rows, _ = corpus()
    df = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(df, spark.read.parquet(f"{folder}/labels.parquet"))
    marks = toxicity.Marks(model.induced)
    scores = model.score([r[1] for r in rows], marks)
    kept = [r for r, s in zip(rows, scores) if s is None or s < toxicity.THRESHOLD]
    assert 30 <= len(rows) - len(kept) <= 45  # forty are toxic, and labels of thirty are known
    seen, exact = set(), []
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is None or r[1] not in seen:
            exact.append(r)
        seen.add(r[1])
    near = plain_near(exact)
    assert len(near) < len(exact) < len(kept)
    encode = repair.id_source(bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY)).encode
    want = Counter((r[0], r[1], r[2], r[3], r[4], r[5], None if r[1] is None else tuple(encode(r[1])), None if r[1] is None else True) for r in plain_mix(near))
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "toxicity", "token_ids", "round_trip"]
    assert Counter((*r[:6], None if r.token_ids is None else tuple(r.token_ids), r.round_trip) for r in out.collect()) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.where("false"), folder)
        assert none.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert none.columns == df.columns


@pytest.fixture(scope="module")
def db():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    assert same_rows(queries.QUERIES[name](spark, SF), db, queries.ORACLES[name]) > 0


def test_queries_without_sql_cover_their_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encode = repair.id_source(bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY)).encode
    for r in queries.op1_bpe(spark, SF).collect():
        assert r.token_ids == encode(docs.pop(r.doc_id)) and r.round_trip and r.n_tokens == len(r.token_ids)
    assert not docs
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    kept = {r[0] for r in plain_near(rows)}
    pairs = queries.op3_simhash(spark, SF).collect()
    assert len(pairs) == len(rows) and {r.doc_id for r in pairs if r.duplicate_id is None} == kept
    model = toxicity.train(df, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = dict(zip((r[0] for r in rows), model.score([r[1] for r in rows], toxicity.Marks(model.induced))))
    assert {r.doc_id: round(r.toxicity, 9) for r in queries.op9_toxicity(spark, SF).collect()} == {i: round(s, 9) for i, s in scores.items()}


def test_rollup_query_against_plain_sums(spark):
    encode = repair.id_source(bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY)).encode
    seen, want = set(), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        if r.text not in seen:
            seen.add(r.text)
            for kind, n in (("words-1", len(r.text.split())), ("byte-bpe-50k-1", len(encode(r.text)) + 1)):
                want[r.source, r.lang, kind] += n
    assert {(r.source, r.lang, r.tokenizer): r.tokens for r in queries.op10_token_rollup(spark, SF).where(F.col("tokens") > 0).collect()} == +want
