"""Operators that SQL cannot express, against slow versions written plainly."""

import json
import random
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import html_extract, mixing, repair, sharding, toxicity, trees
from tests.llm.test_operators import SF, docs, slow_jump

# -- Re-Pair ---------------------------------------------------------------------------------


def pair_counts(sequences):
    """How often each pair can be replaced: overlaps of a pair with itself count once."""
    out = Counter()
    for s in sequences:
        at = {}
        for i in range(len(s) - 1):
            p = (s[i], s[i + 1])
            if at.get(p) != i - 1 or p[0] != p[1]:
                out[p] += 1
                at[p] = i
    return out


def slow_repair(sequences, first, min_count):
    """One pair at a time, always the most frequent."""
    rules = []
    while True:
        counts = pair_counts(sequences)
        best = max(counts, key=lambda p: (counts[p], p), default=None)
        if best is None or counts[best] < min_count:
            return sequences, rules
        new, rules = first + len(rules), [*rules, best]
        after = []
        for s in sequences:
            out, i = [], 0
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == best
                out.append(new if hit else s[i])
                i += 2 if hit else 1
            after.append(out)
        sequences = after


def test_repair_against_one_pair_at_a_time():
    rng = np.random.default_rng(0)
    ours = slow = 0
    for round_ in range(150):
        n = int(rng.integers(0, 300))
        ids = rng.integers(0, int(rng.integers(1, 6)), n)
        cuts = np.sort(rng.integers(0, n + 1, int(rng.integers(0, 4))))
        ends = np.r_[cuts, n].astype(np.int64)
        least = 2 + round_ % 3
        seq, new_ends, g = repair.compress(ids, ends, 10, least)
        parts = [seq[a:b].tolist() for a, b in zip(np.r_[0, new_ends[:-1]], new_ends)]
        originals = [ids[a:b].tolist() for a, b in zip(np.r_[0, ends[:-1]], ends)]
        assert [g.expand(np.array(p)).tolist() for p in parts] == originals
        assert g.lengths(seq).sum() == n
        assert all(c < least for c in pair_counts(parts).values())
        left, rules = slow_repair(originals, 10, least)
        ours += len(seq) + 2 * len(g.left)
        slow += sum(map(len, left)) + 2 * len(rules)
    assert ours < 1.1 * slow  # in batches, and yet about as small


def test_repair_query_on_whole_tables(spark, tmp_path):
    from pagewright.llm import queries

    rows = queries.op2_repair(spark, SF)
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    source = repair.id_source(repair.read_vocabulary(repair.DEFAULT_VOCABULARY))
    got = {r.doc_id: r.token_ids for r in repair.decompress(rows).collect()}
    assert got == {i: source.encode(t) for i, t in want.items()}


def test_repair_keeps_ids_as_they_are(spark):
    df = docs(spark, ["a b a b", "a b a b", None, ""]).withColumn("doc_id", F.when(F.col("doc_id") < 2, "same"))
    rows = repair.compress_documents(df, min_count=2).where("kind = 'document'").collect()
    assert sorted((r.doc_id or "", r.n_tokens is None, len(r.symbols or [])) for r in rows)[-1][0] == "same"
    assert Counter(r.doc_id for r in rows) == {"same": 2, None: 2}
    by_shard = repair.compress_documents(df.withColumn("part", F.lit(3)), shard="part", min_count=2)
    assert {r.shard for r in by_shard.collect()} == {3} and repair.decompress(by_shard).count() == 4


# -- HTML ------------------------------------------------------------------------------------


class Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.words, self.linked, self.hidden, self.link = [], [], [], 0, False

    def flush(self):
        words = "".join(self.words).split()
        if words:
            self.found.append((" ".join(words), len(words), min(len(words), len("".join(self.linked).split()))))
        self.words, self.linked = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template"):
            self.hidden += 1
        elif tag == "a":
            self.link = True
            self.linked.append(" ")
        elif tag == "br":
            self.words.append(" ")
        elif tag not in html_extract.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript", "template"):
            self.hidden -= 1
            self.flush()
        elif tag == "a":
            self.link = False
            self.linked.append(" ")
        elif tag not in html_extract.INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)
            if self.link:
                self.linked.append(data)


def slow_tree(t, row):
    node = 0
    while node < len(t.feature):
        f = t.feature[node]
        node = 2 * node + (2 if f >= 0 and row[f] > t.threshold[node] else 1)
    return t.value[node - len(t.feature)]


def test_html_query_against_a_parser(spark):
    from pagewright.llm import queries

    tree = html_extract.trained_tree()
    got = {r.page_id: r for r in queries.op6_html(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        p = Blocks()
        p.feed(r.html)
        p.close()
        p.flush()
        padded = [(0, 0.0)] + [(n, k / n) for _, n, k in p.found] + [(0, 0.0)]
        keep = [t for i, (t, _, _) in enumerate(p.found) if slow_tree(tree, [*padded[i], *padded[i + 1], *padded[i + 2]]) >= 0.5]
        assert (got[r.page_id].text, got[r.page_id].n_blocks, got[r.page_id].n_content) == ("\n".join(keep), len(p.found), len(keep))


def test_html_edges(spark):
    long_ = "<p>" + "word " * 300_000 + "</p>"
    rows = [(1, long_), (1, long_), (2, "<p>" + "text " * 40 + "<a href=x>open <a>nested</a> link"), (3, "<a>never closed<div>" + "more " * 50 + "</div>"), (4, "<!-- only a comment")]
    df = spark.createDataFrame(rows, "page_id int, html string").withColumn("n_blocks", F.lit("old"))
    got = html_extract.extract_text(df).collect()
    assert len(got) == 5 and sum(r.page_id == 1 and len(r.text.split()) == 300_000 for r in got) == 2
    by = {r.page_id: r for r in got}
    assert by[2].n_blocks == 1 and by[2].text.endswith("open nested link") and by[3].n_blocks == 2 and (by[4].text, by[4].n_blocks) == ("", 0)
    assert html_extract.extract_text(df.where("false")).count() == 0


# -- toxicity --------------------------------------------------------------------------------


def slow_features(text, induced):
    tokens = text.split()
    words = max(len(tokens), 1)
    kinds = []
    for t in tokens:
        w = t.lower() if t.lower().isalpha() else toxicity._TRIM.sub("", t.lower())
        plain = w.translate(toxicity._LEET)
        seed, mixed = w in toxicity.SEED_LEXICON, bool(w) and not w.isalpha() and w not in toxicity.SEED_LEXICON
        kinds.append({"seed": seed, "induced": w in induced, "hidden": mixed and (plain in toxicity.SEED_LEXICON or plain in induced), "you": w in toxicity.SECOND_PERSON, "caps": len(t) > 1 and t.isupper(), "mixed": mixed})
    share = lambda k: sum(x[k] for x in kinds) / words
    insults = [i for i, x in enumerate(kinds) if x["seed"] or x["induced"] or x["hidden"]]
    people = [i for i, x in enumerate(kinds) if x["you"]]
    near = sum(1 / (1 + min(abs(i - p) for p in people)) for i in insults) / len(tokens) if insults and people else 0.0
    raw = text.encode()
    rate = lambda chars: sum(b in chars for b in raw) / max(len(raw), 1)
    return [np.log1p(len(tokens)), share("seed"), share("induced"), share("hidden"), np.log1p(len(insults)), share("you"), near, rate(toxicity._UPPER), share("caps"), rate(toxicity._PUNCTUATION), rate(b"!"), rate(b"0123456789"), share("mixed"), max(map(len, tokens), default=0)]


def test_toxicity_against_plain_loops(spark):
    rng = random.Random(5)
    pool = ["you", "IDIOT", "id10t!", "m0r-on", "the", "word", "Ünïcode", "glarb", "(scum)", "x1", "!!!", "Your", "stupid,"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    induced = frozenset({"glarb"})
    marks = toxicity.Marks(induced)
    for t in texts:
        assert np.allclose(toxicity.features(t, marks), slow_features(t, induced)), t
    x = np.array([slow_features(t, induced) for t in texts])
    y = (x[:, 4] > np.median(x[:, 4])).astype(float)
    b = trees.boost(x, y, rounds=10, min_rows=3)
    margins = [b.start + b.rate * sum(slow_tree(t, r) for t in b.trees) for r in x]
    assert np.allclose(b.margin(x), margins)
    score, label = np.array([rng.random() for _ in range(40)]), np.array([float(rng.random() < 0.4) for _ in range(40)])
    order = np.argsort(score)
    s = label[order]
    # the best monotone fit: the largest of the smallest means
    brute = [max(min(s[a : b + 1].mean() for b in range(i, len(s))) for a in range(i + 1)) for i in range(len(s))]
    assert np.allclose(trees.isotonic(score, label)(score[order]), brute)
    model = toxicity.Model(induced, b, trees.isotonic(np.array(margins), y))
    df = docs(spark, [*texts, None, "", texts[0]]).withColumn("toxic", F.lit("old"))
    rows = toxicity.with_toxicity(df, model).collect()
    curve = trees.isotonic(np.array(margins), y)
    for r in rows:
        want = None if r.text is None else 0.0 if not r.text else float(curve(np.array([margins[texts.index(r.text)]]))[0])
        assert (r.toxicity is None) == (want is None) and (want is None or abs(r.toxicity - want) < 1e-9)
        assert r.toxic == (want is not None and want >= 0.5)


def test_toxicity_edges(spark):
    texts = [f"you {w} of a {w} from house {i}" for i in range(3) for w in ("idiot", "moron", "scum", "clown", "fool", "loser")] + ["a nice day in town " + "and out of it " * (i % 4) + str(i) for i in range(20)] + [f"you and I went from house {i} to the other" for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 18)) for i in range(58)] + [(0, 1), (None, 1), (3, None), (999, 1)], "doc_id bigint, toxic int")
    df = docs(spark, texts)
    model = toxicity.train(df, labels)
    long_ = "calm words only here " * 100_000
    out = docs(spark, ["you utter idiot and moron", "you utter idiot and moron", long_, "w" * 5_000_000, None])
    got = [r.toxic for r in toxicity.with_toxicity(out, model).orderBy("doc_id").collect()]
    assert got == [True, True, False, False, False]
    assert toxicity.drop_toxic(out, model).columns == out.columns and toxicity.drop_toxic(out, model).count() == 3
    assert toxicity.drop_toxic(df.where("false"), model).count() == 0
    assert toxicity.train(df.where("false"), labels).trees.trees == ()
    few = toxicity.train(df, labels.where("doc_id in (0, 1, 50, 51)"))
    assert few.calibration is None


# -- sharding, mixing ------------------------------------------------------------------------


def test_sharding_edges(spark):
    df = docs(spark, ["x", "x", None], [7, 7, None])
    got = sharding.with_shard(df, 5).collect()
    assert [r.shard for r in got if r.doc_id == 7] == [slow_jump(7, 5)] * 2 and [r.shard for r in got if r.doc_id is None] == [None]
    assert sharding.with_shard(df.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        sharding.with_shard(df, 0).collect()


def test_mixing_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "b c", "b"), (3, "b c", "b"), (None, "d", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copy", F.lit("old"))
    out = mixing.mix_sources(df, mixing.Mix()).collect()
    # five tokens for the two sources that have any: half of them each; a source without tokens stays as it is
    assert sorted(r.doc_id for r in out if r.source == "a") == [1, 2]
    assert sum(r.source == "b" for r in out) in (0, 2) and 2 <= sum(r.source is None for r in out) <= 3
    assert json.dumps(sorted(map(str, out))) == json.dumps(sorted(map(str, mixing.mix_sources(df, mixing.Mix()).collect())))
