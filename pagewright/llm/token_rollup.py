"""Token counts as delta-maintained rollups.

Changes come as signed rows: an insert adds a document's count, a delete takes it away, a
revised count takes the old one away and adds the new one. A batch of changes is summed by
source, language and tokenizer version and committed as a few rows; totals are the sum of all
committed batches, so no document is counted again.

A commit is idempotent. The batch is written to a folder of its own first; it counts from the
moment its marker file, named by the batch id, exists. The marker, which names the folder, is written
whole under another name and then renamed without overwriting, so a batch that is sent twice, a
retried task or a driver that died between any two steps change nothing.

``compact`` sums the batches of one listing into one more folder, a fold, whose marker lists them. Batches
keep their folders, so whatever is committed meanwhile, and however many compactions run at once, each
batch counts once: of folds that share a batch the one of most batches counts, and what no
fold covers counts by itself.

Edge cases: a NULL source, language or count is a group of its own or counts 0 tokens; a
repeated row counts as often as it comes; groups that fall to no documents and no tokens stay
out of the totals. An empty batch commits and changes nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.bpe import DEFAULT_VOCABULARY, LOT_BYTES, encoder_in_turn, read_vocabulary
from pagewright.llm.common import give_back, q, require
from pagewright.llm.words import lots

KEYS = ("source", "lang", "tokenizer")
_FOLD = "fold."
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def bpe_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of byte-level BPE tokens; NULL for NULL."""
    data = read_vocabulary(vocabulary)

    @F.arrow_udf("bigint")
    def count(batch: pa.Array) -> pa.Array:
        e = encoder_in_turn(data)
        sizes = [np.zeros(0, np.int64), *(e.encode_array(lot)[1] for lot in lots(batch, LOT_BYTES))]
        give_back()
        return pa.array(np.concatenate(sizes), pa.int64(), mask=batch.is_null().to_numpy(zero_copy_only=False))

    return count(text)


def changes(df: DataFrame, tokenizer: str, tokens: Column, sign: int = 1, source: str = "source", lang: str = "lang") -> DataFrame:
    """Signed rows for inserting (``sign`` 1) or deleting (-1) the documents of ``df``."""
    require(df, source, lang)
    if sign not in (1, -1):
        raise ValueError("sign is 1 or -1")
    n = F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint"))
    return df.select(q(source).cast("string").alias("source"), q(lang).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("docs"), (n * sign).alias("tokens"))


def revisions(df: DataFrame, tokenizer: str, old: Column, new: Column, new_tokenizer: str | None = None, source: str = "source", lang: str = "lang") -> DataFrame:
    """Signed rows for documents whose count changes from ``old`` to ``new``."""
    return changes(df, tokenizer, old, -1, source, lang).union(changes(df, new_tokenizer or tokenizer, new, 1, source, lang))


class TokenRollup:
    """A rollup in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path("_commits").getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("_commits", "_pending"):
            self._fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _mark(self, batch_id: str):
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch_id) or batch_id.startswith(_FOLD):
            raise ValueError(f"a batch id has letters, digits, dots and hyphens only and does not begin with {_FOLD!r}")
        return self._path(f"_commits/{batch_id}")

    def _publish(self, mark, content: dict) -> bool:
        """Make ``mark`` appear with its content, in one step; False if it is there already."""
        pending = self._path(f"_pending/{uuid.uuid4().hex}")
        stream = self._fs.create(pending, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(pending, mark, none)
        except Exception:
            self._fs.delete(pending, False)
            if self._fs.exists(mark):
                return False
            raise
        return True

    def _entries(self) -> dict[str, dict]:
        """Name and content of every marker; one listing, and each is read once."""
        out = {}
        for status in self._fs.listStatus(self._path("_commits")):
            stream = self._fs.open(status.getPath())
            try:
                out[status.getPath().getName()] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return out

    def committed(self) -> list[str]:
        return sorted(n for n in self._entries() if not n.startswith(_FOLD))

    def commit(self, batch_id: str, delta: DataFrame) -> bool:
        """Add a batch of signed rows; False, and no change, if it was committed before."""
        mark = self._mark(batch_id)
        if self._fs.exists(mark):
            return False
        folder = f"{self.path}/batches/{batch_id}-{uuid.uuid4().hex}"
        _summed(delta).write.parquet(folder)
        return self._publish(mark, {"folder": folder})

    def _sum(self, entries: dict[str, dict]) -> DataFrame:
        folders = [entries[n]["folder"] for n in live(entries)]
        return _summed(self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA))

    def totals(self) -> DataFrame:
        """The sum of all committed batches."""
        return self._sum(self._entries())

    def compact(self) -> None:
        """Fold the batches committed so far into one; their ids stay known, so none counts twice."""
        entries = self._entries()
        names = sorted(n for n in entries if not n.startswith(_FOLD))
        digest = hashlib.md5("/".join(names).encode()).hexdigest()
        mark = self._path(f"_commits/{_FOLD}{digest}")
        if names and not self._fs.exists(mark):
            folder = f"{self.path}/batches/{_FOLD}{digest}-{uuid.uuid4().hex}"
            self._sum(entries).coalesce(1).write.parquet(folder)
            self._publish(mark, {"folder": folder, "folds": names})


def _summed(rows: DataFrame) -> DataFrame:
    total = rows.groupBy(*KEYS).agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))
    return total.where("docs <> 0 OR tokens <> 0")


def live(entries: dict[str, dict]) -> list[str]:
    """Markers whose folders together hold each batch once."""
    covered: set[str] = set()
    out = []
    for name in sorted((n for n in entries if n.startswith(_FOLD)), key=lambda n: (-len(entries[n]["folds"]), n)):
        if covered.isdisjoint(entries[name]["folds"]):
            covered.update(entries[name]["folds"])
            out.append(name)
    return out + sorted(n for n in entries if not n.startswith(_FOLD) and n not in covered)
