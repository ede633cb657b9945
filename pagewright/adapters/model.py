"""The page model behind the retry ladder: an injectable client, and the ladder that asks it.

The ladder is a loop over attempts, not over pages: an attempt asks for all pages that are still open at
once, is written down, and the table of attempts so far decides which pages stay open
(``operators.ladder``). So there are at most eight jobs, whatever the number of pages, and a run that
is taken up again asks for nothing twice.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import TEMPERATURES, EndpointOptions
from pagewright.operators.ladder import KEY, parse_attempts, unsettled
from pagewright.schema import ATTEMPTS


class ModelError(RuntimeError):
    """A model did not answer, or a page has no answer and may not fall back."""


@dataclass(frozen=True)
class Reply:
    content: str
    finish_reason: str | None = "stop"
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0


#: (columns of the page, temperature, rotation in degrees) -> reply; whatever it raises is that attempt's error.
Client = Callable[[dict, float, int], Reply]
#: Makes a client; called once in each task.
Factory = Callable[[EndpointOptions], Client]

PROMPT = "Transcribe this page as Markdown below a block of YAML with primary_language, is_rotation_valid, rotation_correction, is_table and is_diagram."


def render_size(width: Column, height: Column, options: EndpointOptions | None = None, rotation: Column | int = 0) -> Column:
    """struct<width, height> in pixels of a rendering whose longer side is ``longest_side``."""
    o = options or EndpointOptions()
    scale = F.lit(float(o.longest_side)) / F.greatest(width, height, F.lit(1.0))
    across, down = (F.ceil(side * scale).cast("int") for side in (width, height))
    turned = (rotation if isinstance(rotation, Column) else F.lit(rotation)).isin(90, 270)
    return F.struct(F.when(turned, down).otherwise(across).alias("width"), F.when(turned, across).otherwise(down).alias("height"))


def http_client(render: Callable[[dict, int, int], bytes]) -> Factory:
    """Clients of a chat endpoint. ``render`` gives a page's PNG for a longest side and a rotation."""

    def factory(o: EndpointOptions) -> Client:
        def ask(page: dict, temperature: float, rotation: int) -> Reply:
            image = base64.b64encode(render(page, o.longest_side, rotation)).decode()
            parts = [{"type": "text", "text": page.get("prompt") or PROMPT}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image}"}}]
            body = {"model": o.model, "messages": [{"role": "user", "content": parts}], "max_tokens": o.max_output_tokens, "temperature": temperature}
            request = urllib.request.Request(o.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=o.timeout_s) as response:
                got = json.load(response)
            usage, choice = got.get("usage") or {}, got["choices"][0]
            return Reply(choice["message"]["content"] or "", choice.get("finish_reason"), *(usage.get(f"{k}_tokens") or 0 for k in ("prompt", "completion", "total")))

        return ask

    return factory


def with_retries(factory: Factory, times: int = 3, wait_s: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Factory:
    """Clients that try again where the connection fails, waiting twice as long each time. What the model says is
    not judged here: that is the ladder's."""

    def patient(o: EndpointOptions) -> Client:
        client = factory(o)

        def ask(page: dict, temperature: float, rotation: int) -> Reply:
            for n in range(times):
                try:
                    return client(page, temperature, rotation)
                except OSError as e:
                    if n + 1 == times:
                        raise ModelError(f"no answer in {times} tries: {e}") from e
                    sleep(wait_s * 2**n)
            raise ModelError("times is at least 1")

        return ask

    return patient


_COLUMNS = ATTEMPTS + ", rotation int, seconds double"


def ask_pages(pages: DataFrame, factory: Factory, attempt: int, options: EndpointOptions, workers: int) -> DataFrame:
    """One attempt at each page (doc_id, page_index, rotation and whatever the client reads), ``workers`` of a task
    at a time."""
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    temperature = TEMPERATURES[attempt - 1]

    def asked(frames):
        client = factory(options)

        def one(page: dict) -> tuple:
            start = time.monotonic()
            try:
                r = client(page, temperature, int(page["rotation"]))
                said = (r.content, r.finish_reason, r.prompt_tokens, r.completion_tokens, r.total_tokens, None)
            except Exception as e:  # noqa: BLE001 - what a foreign client raises is that attempt's error
                said = (None, None, 0, 0, 0, f"{type(e).__name__}: {e}")
            return (page["doc_id"], page["page_index"], attempt, *said, page["rotation"], time.monotonic() - start)

        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(one, frame.to_dict("records"))), columns=names)

    return pages.mapInPandas(asked, _COLUMNS)


def run_ladder(pages: DataFrame, factory: Factory, path: str, options: EndpointOptions | None = None, workers: int = 8) -> DataFrame:
    """The attempts at all pages, parsed; they are written below ``path``, an attempt in a folder of its own.
    A page is asked for again until an answer is valid, its time is up or ``max_attempts`` are made."""
    o, spark = options or EndpointOptions(), pages.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    parsed = None
    for attempt in range(1, o.max_attempts + 1):
        folder = f"{path}/attempt-{attempt}"
        done = hadoop(f"{folder}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            due = pages.withColumn("rotation", F.lit(0)) if parsed is None else pages.join(unsettled(parsed, o).select(*KEY, "rotation"), list(KEY))
            ask_pages(due, factory, attempt, o, workers).write.mode("overwrite").parquet(folder)
        parsed = parse_attempts(spark.read.parquet(*[f"{path}/attempt-{n}" for n in range(1, attempt + 1)]), o)
        if unsettled(parsed, o).isEmpty():
            break
    return parsed
