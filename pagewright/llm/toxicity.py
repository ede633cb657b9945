"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features, over the whole text: densities of insults (a seed lexicon, words induced from the
labelled rows, and insults found after undoing letter substitutions), nearness of insults
to second-person words, rates of capitals, of punctuation and of obfuscated words.

The model is trained on the driver on a bounded sample of labelled rows: the
``sample_rows`` labels with the smallest hash of their id (a parameter; the default is
20,000), whatever the size of the tables. The sample is written once. It is dealt, toxic and clean texts
each by themselves, into ``FOLDS`` folds; words are induced and trees boosted without a fold to get
the margins of its texts, and the calibration is fitted to these margins of all texts, none of which
its own model has seen. The model itself is then made of all folds. Scoring is one pass over the text
column without a shuffle; the model (some 20 kB) travels with the task.

Edge cases: NULL text scores NULL and is not toxic; a text without words scores 0. NULL
labels are ignored; copies of a text are one row of the sample, toxic if one of their labels says so. Without rows of both classes every text
scores the share of toxic labels (0 without labels). Extra columns pass through; an input
column named like an output column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import give_back, materialise, q, require, without
from pagewright.llm.trees import Boosted, Isotonic, boost, isotonic
from pagewright.llm.words import lots

SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.5
SEED_LEXICON = frozenset(
    """idiot idiots idiotic moron morons moronic stupid dumb imbecile loser losers clown clowns scum trash garbage filth
    pathetic worthless disgusting vermin scumbag jerk jackass dumbass asshole bastard bitch crap shit fuck fucking cunt slut whore
    retard retarded freak creep parasite coward cretin dimwit halfwit fool hag pig swine
    idiota estupido imbécil basura asqueroso inútil imbécile connard salope ordure débile abruti dummkopf schwachkopf arschloch
    abschaum wertlos ekelhaft trottel""".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur tu te ti tus usted ustedes vous votre vos toi ton ta du dich dir dein deine euch ihr".split())
#: An induced word is in at least this number and this share of the toxic texts of the sample,
#: and this many times as frequent there as in the others.
INDUCED_TEXTS, INDUCED_SHARE, INDUCED_RATIO = 6, 0.004, 25.0
NAMES = ("log_words", "seed_density", "induced_density", "hidden_density", "log_insults", "person_density", "nearness", "capitals", "all_caps_words", "punctuation", "exclaims", "digits", "obfuscated", "longest_run")

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", ".": "", "-": "", "_": ""})
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_UPPER = bytes(range(65, 91))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGITS = b"0123456789"
_SEED, _INDUCED, _HIDDEN, _PERSON, _CAPS, _MIXED = (1 << k for k in range(6))
CACHE_ENTRIES = 400_000
#: Bytes of text whose features are made at once.
LOT_BYTES = 4 << 20


class Marks(dict):
    """Token -> what it is, as bits."""

    def __init__(self, induced: frozenset[str]):
        super().__init__()
        self.induced = induced

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        word = token.lower()
        if not word.isalpha():
            word = _TRIM.sub("", word)
        m = 0
        if word in SEED_LEXICON:
            m |= _SEED
        elif word and not word.isalpha():
            m |= _MIXED
            plain = word.translate(_LEET)
            if plain in SEED_LEXICON or plain in self.induced:
                m |= _HIDDEN
        if word in self.induced:
            m |= _INDUCED
        if word in SECOND_PERSON:
            m |= _PERSON
        if len(token) > 1 and token.isupper():
            m |= _CAPS
        if len(token) <= 40:
            self[token] = m
        return m


_BYTE_CLASSES = tuple(np.isin(np.arange(256), list(chars)) for chars in (_UPPER, _PUNCTUATION, b"!", _DIGITS))


def feature_rows(texts: pa.Array, marks: Marks) -> np.ndarray:
    """The features of each text, none NULL: what a word is is found once for all its places in the lot."""
    n = len(texts)
    lists = pc.utf8_split_whitespace(texts)
    doc = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes]
    if not size.all():  # white space at the ends leaves empty words
        doc, codes, size = doc[size > 0], codes[size > 0], size[size > 0]
    m = np.fromiter(map(marks.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint8, len(coded.dictionary))[codes]
    count = lambda mask: np.bincount(doc[(m & mask) > 0], minlength=n)
    n_words = np.bincount(doc, minlength=n)
    words = np.maximum(n_words, 1)
    insults, people = count(_SEED | _INDUCED | _HIDDEN), count(_PERSON)
    near, begins = np.zeros(n), np.cumsum(n_words) - n_words
    for i in np.flatnonzero((insults > 0) & (people > 0)):
        own = m[begins[i] : begins[i] + n_words[i]]
        insult, person = np.flatnonzero(own & (_SEED | _INDUCED | _HIDDEN)), np.flatnonzero(own & _PERSON)
        at = np.searchsorted(person, insult)
        gap = np.minimum(np.abs(insult - person[np.minimum(at, len(person) - 1)]), np.abs(insult - person[np.maximum(at - 1, 0)]))
        near[i] = (1.0 / (1.0 + gap)).sum() / n_words[i]
    longest = np.zeros(n)
    if len(doc):
        some = np.flatnonzero(n_words)
        longest[some] = np.maximum.reduceat(size, begins[some])
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint8)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    length = np.maximum(np.diff(np.r_[0, ends]), 1)
    upper, punctuation, exclaims, digits = (np.diff(np.searchsorted(np.flatnonzero(c[raw]), np.r_[0, ends])) / length for c in _BYTE_CLASSES)
    share = lambda mask: count(mask) / words
    return np.stack([
        np.log1p(n_words), share(_SEED), share(_INDUCED), share(_HIDDEN), np.log1p(insults), share(_PERSON), near,
        upper, share(_CAPS), punctuation, exclaims, digits, share(_MIXED), longest,
    ], axis=1)


def features(text: str, marks: Marks) -> list[float]:
    return feature_rows(pa.array([text], pa.string()), marks)[0].tolist()


@dataclass(frozen=True)
class Model:
    induced: frozenset[str] = frozenset()
    trees: Boosted = field(default_factory=lambda: Boosted(-30.0, (), 0.0))
    calibration: Isotonic | None = None

    def score_array(self, texts: pa.Array, marks: Marks) -> np.ndarray:
        """The probability of each text; 0 without a word, NaN for NULL."""
        x = feature_rows(texts.fill_null(""), marks)
        margin = self.trees.margin(x)
        p = self.calibration(margin) if self.calibration else 1 / (1 + np.exp(-margin))
        return np.where(texts.is_null().to_numpy(zero_copy_only=False), np.nan, np.where(x[:, 0] > 0, p, 0.0))

    def score(self, texts: list[str | None], marks: Marks) -> list[float | None]:
        return [None if np.isnan(p) else p for p in self.score_array(pa.array(texts, pa.string()), marks).tolist()]


def _sample(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, sample_rows: int) -> DataFrame:
    """``text``, ``y``, ``fold`` of the distinct texts of the sample, written once."""
    chosen = labels.where(q(label).isNotNull() & q(doc_id).isNotNull()).select(q(doc_id).alias("i"), q(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("i"), "i", "y").limit(sample_rows)
    texts = df.select(q(doc_id).alias("i"), q(text).alias("text"))
    # at most sample_rows pairs of numbers are broadcast
    found = texts.join(F.broadcast(chosen), "i").where("text IS NOT NULL").groupBy(F.md5("text").alias("h")).agg(F.min("text").alias("text"), (F.max("y") > 0).cast("int").alias("y"))
    found = materialise(found, "labelled-texts")
    # two windows over sample_rows digests at most
    folds = found.select("h", ((F.row_number().over(Window.partitionBy("y").orderBy("h")) - 1) % FOLDS).alias("fold"))
    return materialise(found.join(F.broadcast(folds), "h").select("h", "text", "y", "fold"), "labelled-folds")


def induce(sample: DataFrame) -> list[frozenset[str]]:
    """Words that mark toxic texts, by the number of texts of each class that hold them: found without
    each of the folds, and last with all."""

    def count(batches):
        tox, all_ = Counter(), Counter()
        for b in batches:
            for t, y, fold in zip(*(c.to_pylist() for c in b.columns)):
                words = [(fold, w) for w in {_TRIM.sub("", x) for x in set(t.lower().split())} if w.isalpha()]
                words.append((fold, ""))
                all_.update(words)
                if y:
                    tox.update(words)
        keys = list(all_)
        yield pa.RecordBatch.from_arrays([pa.array([w for _, w in keys], pa.string()), pa.array([f for f, _ in keys], pa.int32()), pa.array([tox[x] for x in keys], pa.int64()), pa.array([all_[x] for x in keys], pa.int64())], ["word", "fold", "tox", "seen"])

    per_fold = sample.select("text", "y", "fold").mapInArrow(count, "word string, fold int, tox bigint, seen bigint")
    part = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
    # fold number FOLDS is none, so nothing is left out
    counts = materialise(per_fold.groupBy("word").agg(*[part(c, f) for c in ("tox", "seen") for f in range(FOLDS + 1)]), "word-counts")
    total = counts.where("word = ''").first()

    def marks(f: int) -> Column:
        if total is None or not total[f"tox{f}"] or total[f"tox{f}"] == total[f"seen{f}"]:
            return F.lit(False)
        n_tox, n_clean = total[f"tox{f}"], total[f"seen{f}"] - total[f"tox{f}"]
        tox, clean = F.col(f"tox{f}"), F.col(f"seen{f}") - F.col(f"tox{f}")
        return (tox >= INDUCED_SHARE * n_tox) & (tox >= INDUCED_TEXTS) & ((tox / n_tox) / ((clean + 0.5) / n_clean) >= INDUCED_RATIO)

    flags = counts.where("word <> ''").select("word", F.array(*[marks(f) for f in range(FOLDS + 1)]).alias("m"))
    kept = flags.where(F.array_contains("m", True)).collect()  # bounded by the sample
    return [frozenset(r.word for r in kept if r.m[f]) for f in range(FOLDS + 1)]


def _features(sample: DataFrame, induced: list[frozenset[str]]) -> pd.DataFrame:
    """The features of each text of the sample under each set of induced words, on the driver:
    ``which`` is the number of the set, -1 for all of them."""
    every, common = frozenset().union(*induced), frozenset.intersection(*induced)

    def rows(batches):
        most, least = Marks(every), Marks(common)
        each = [Marks(i) for i in induced]
        for b in batches:
            at = 0
            for lot in lots(b.column(1), LOT_BYTES):
                part = b.slice(at, len(lot))
                at += len(lot)
                x = feature_rows(lot, most)
                # no word of the text is in some of the sets only
                same = (x == feature_rows(lot, least)).all(axis=1) if every != common else np.ones(len(lot), bool)
                yield table(part, np.flatnonzero(same), x[same], -1)
                other = np.flatnonzero(~same)
                if len(other):
                    for k, m in enumerate(each):
                        yield table(part, other, feature_rows(lot.take(pa.array(other)), m), k)

    def table(part: pa.RecordBatch, at: np.ndarray, x: np.ndarray, which: int) -> pa.RecordBatch:
        own = part.take(pa.array(at))
        return pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), pa.array(np.full(len(at), which, np.int32)), *(pa.array(c) for c in x.T)], schema=schema)

    names = ("h", "y", "fold", "which", *NAMES)
    schema = pa.schema([("h", pa.string()), *((n, pa.int32()) for n in names[1:4]), *((n, pa.float64()) for n in NAMES)])
    columns = "h string, y int, fold int, which int, " + ", ".join(f"{n} double" for n in NAMES)
    got = sample.select("h", "text", "y", "fold").mapInArrow(rows, columns).toPandas()  # at most (FOLDS + 1) x sample_rows x 18 numbers
    return got.sort_values(["h", "which"], kind="stable")


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    require(df, text, doc_id)
    require(labels, doc_id, label)
    sample = _sample(df, labels, text, doc_id, label, sample_rows)
    induced = induce(sample)
    got = _features(sample, induced)
    data = [got[got["which"].isin((-1, f))] for f in range(FOLDS + 1)]
    x, y, fold = data[-1][list(NAMES)].to_numpy(float), data[-1]["y"].to_numpy(float), data[-1]["fold"].to_numpy()
    trees = boost(x, y)
    if y.sum() < FOLDS or len(y) - y.sum() < FOLDS:  # too few to leave any out
        return Model(induced[-1], trees)
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        own = data[f][list(NAMES)].to_numpy(float)
        margin[fold == f] = boost(own[fold != f], y[fold != f]).margin(own[fold == f])
    return Model(induced[-1], trees, isotonic(margin, y))


def score_column(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def toxicity(batch: pa.Array) -> pa.Array:
        marks = Marks(model.induced)
        found = [np.zeros(0), *(model.score_array(lot, marks) for lot in lots(batch, LOT_BYTES))]
        out = pa.array(np.concatenate(found), pa.float64(), mask=batch.is_null().to_numpy(zero_copy_only=False))
        give_back()
        return out

    return toxicity(text)


def with_toxicity(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, score: str = "toxicity", flag: str = "toxic") -> DataFrame:
    """``df`` with the calibrated probability and whether it reaches ``threshold``."""
    require(df, text)
    scored = df.select(*[q(c) for c in without(df, score, flag).columns], score_column(q(text), model).alias(score))
    return scored.withColumn(flag, F.coalesce(q(score) >= threshold, F.lit(False)))


def drop_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` below ``threshold``, and those without a text."""
    return df.where(F.coalesce(score_column(q(text), model) < threshold, F.lit(True)))
