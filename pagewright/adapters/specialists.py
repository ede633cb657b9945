"""Models for single regions: a registry in which none is without a licence.

Whether a model can be used is found out once in each process, as that may mean importing it; one that cannot
be made is not available, which is no error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.protocol import linearised_to_markdown, wrap_latex

#: (kind of region, image bytes) -> Markdown.
Model = Callable[[str, bytes], str]


@dataclass(frozen=True)
class Entry:
    """``form``: what the model returns: Markdown, a chart's flat rows, or LaTeX. The last two are made into Markdown
    for the whole table of answers at once."""

    name: str
    kinds: tuple[str, ...]
    licence: str
    origin: str
    factory: Callable[[], Model]
    form: str = "markdown"


_made: dict[str, Model | None] = {}


@dataclass
class Registry:
    entries: dict[str, Entry] = field(default_factory=dict)

    def register(self, name: str, kinds: tuple[str, ...], licence: str, origin: str, factory: Callable[[], Model], form: str = "markdown") -> None:
        if name in self.entries:
            raise ValueError(f"{name!r} is registered already")
        if not licence.strip() or not kinds:
            raise ValueError("a specialist has a licence and takes at least one kind of region")
        if form not in ("markdown", "rows", "latex"):
            raise ValueError("form is markdown, rows or latex")
        self.entries[name] = Entry(name, tuple(kinds), licence, origin, factory, form)
        _made.pop(name, None)

    def get(self, name: str) -> Model | None:
        """The model; None if it is unknown or cannot be made here."""
        if name in self.entries and name not in _made:
            try:
                _made[name] = self.entries[name].factory()
            except Exception:  # noqa: BLE001 - an absent dependency may raise anything
                _made[name] = None
        return _made.get(name) if name in self.entries else None

    def available(self, kind: str | None = None) -> list[str]:
        """Names in order of registration, which is their rank."""
        return [n for n, e in self.entries.items() if (kind is None or kind in e.kinds) and self.get(n) is not None]

    def table(self, spark: SparkSession) -> DataFrame:
        """``name``, ``rank``, ``kinds`` of the models that can be used, for ``regions.dispatch``."""
        rows = [(n, i, list(self.entries[n].kinds)) for i, n in enumerate(self.available())]
        return spark.createDataFrame(rows, "name string, rank int, kinds array<string>")

    def bill_of_materials(self, spark: SparkSession) -> DataFrame:
        rows = [(e.name, list(e.kinds), e.licence, e.origin, self.get(e.name) is not None) for _, e in sorted(self.entries.items())]
        return spark.createDataFrame(rows, "name string, kinds array<string>, licence string, origin string, installed boolean")

    def answers(self, crops: DataFrame) -> DataFrame:
        """What every model that takes a region makes of it: ``crops`` are doc_id, page_index, region_order, kind and
        image. A model that fails has no answer."""

        def run(frames):
            for frame in frames:
                rows = []
                for r in frame.to_dict("records"):
                    for name in self.available(r["kind"]):
                        try:
                            rows.append((r["doc_id"], r["page_index"], r["region_order"], name, self.get(name)(r["kind"], r["image"])))
                        except Exception:  # noqa: BLE001 - the next model, or the page's own text, stands in
                            continue
                yield pd.DataFrame(rows, columns=["doc_id", "page_index", "region_order", "name", "markdown"])

        raw = crops.mapInPandas(run, "doc_id string, page_index int, region_order int, name string, markdown string")
        of = lambda form: F.col("name").isin(*[n for n, e in self.entries.items() if e.form == form])
        said = F.col("markdown")
        return raw.withColumn("markdown", F.when(of("rows"), linearised_to_markdown(said)).when(of("latex"), wrap_latex(said, F.lit(True))).otherwise(said))
