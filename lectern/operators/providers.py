"""Remote providers behind seams: batched calls with retries, and native results where they fail or are not given.

A provider is a plain function; it runs on executors in Arrow batches.  Nothing here opens a
connection by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.vectors import hash_embedding
from lectern.operators.status import ERROR_CLIP

#: Statuses worth another try, tries after the first, base of the wait in seconds.
RETRY_ON, RETRIES, BACKOFF = (429, 500, 502, 503, 504), 2, 1.5
EMBED_BATCH, EMBED_CLIP, SPEECH_CLIP = 64, 8000, 4000


class ProviderError(Exception):
    def __init__(self, provider: str, status: int | None, detail: str):
        super().__init__(f"{provider}: {status}: {detail[:ERROR_CLIP]}")
        self.provider, self.status, self.detail = provider, status, detail[:ERROR_CLIP]


def with_retry(call: Callable, provider: str, retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] | None = None) -> Callable:
    """``call`` tried again on network errors and on RETRY_ON; waits backoff ** attempt."""

    def run(*args):
        import time

        wait = sleep or time.sleep
        for attempt in range(retries + 1):
            try:
                return call(*args)
            except ProviderError as e:
                if e.status not in RETRY_ON or attempt == retries:
                    raise
            except OSError as e:
                if attempt == retries:
                    raise ProviderError(provider, None, str(e)) from e
            wait(backoff**attempt)

    return run


def post_json(provider: str, url: str, payload: dict, headers: dict[str, str], timeout: int, opener: Callable | None = None) -> bytes:
    """Body of the answer to a JSON request; a refusal is a ProviderError with its status and the start of its body."""
    import json
    import urllib.error
    import urllib.request

    asked = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with (opener or urllib.request.urlopen)(asked, timeout=timeout) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        raise ProviderError(provider, e.code, e.read().decode("utf-8", "replace")) from e


def _cascade(rows: DataFrame, inputs: list[str], providers: list[tuple[str, Callable]], kind: str) -> DataFrame:
    """``rows`` with ``_made`` of the first provider that answers, its ``provider`` label and the last ``error``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for pdf in batches:
            made = []
            for values in pdf[inputs].itertuples(index=False):
                answer = (None, None, None)
                for label, call in providers:
                    try:
                        answer = (call(*values), label, answer[2])
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a provider is passed to the next one
                        answer = (None, None, f"{label}: {e}"[:ERROR_CLIP])
                made.append(answer)
            pdf["_made"], pdf["provider"], pdf["error"] = zip(*made, strict=True) if made else ((), (), ())
            yield pdf

    if not providers:
        return rows.select("*", F.lit(None).cast(kind).alias("_made"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("error"))
    return rows.mapInPandas(run, f"{fields}, _made {kind}, provider string, error string")


def written(rows: DataFrame, prompt: str, fallback: str, providers: list[tuple[str, Callable[[str], str]]] = ()) -> DataFrame:
    """``rows`` with ``text``, ``provider`` and ``error``: the first provider's answer to ``prompt``, else the column ``fallback``."""
    made = _cascade(rows, [prompt], list(providers), "string")
    return made.select(*rows.columns, F.coalesce("_made", fallback).alias("text"), F.coalesce("provider", F.lit("template")).alias("provider"), "error")


def spoken(rows: DataFrame, key: str, script: str, title: str, providers: list[tuple[str, Callable[[str], bytes]]] = ()) -> DataFrame:
    """(key, audio, content_type, provider, error): speech of clipped scripts, else the preview tone."""
    from lectern.sources.files import wav

    clipped = rows.select(key, script, title, F.left(script, F.lit(SPEECH_CLIP)).alias("_clip"))
    made = _cascade(clipped, ["_clip"], list(providers), "binary")
    tones = wav(made.where("_made is null"), key, script, title).withColumnRenamed("audio", "_tone")
    out = made.join(tones, key, "left")
    live = F.col("_made").isNotNull()
    return out.select(key, F.coalesce("_made", "_tone").alias("audio"), F.when(live, "audio/mpeg").otherwise("audio/wav").alias("content_type"), F.coalesce("provider", F.lit("demo")).alias("provider"), "error")


def embedded(rows: DataFrame, content: str, call: Callable[[list[str]], list[list[float]]] | None = None, batch: int = EMBED_BATCH) -> DataFrame:
    """``rows`` with ``embedding``: by ``call`` on up to ``batch`` clipped texts at a time; a failing batch, or no call, gets hash embeddings."""
    if call is None:
        return rows.withColumn("embedding", hash_embedding(F.col(content)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for pdf in batches:
            vectors: list = []
            texts = [(t or "")[:EMBED_CLIP] for t in pdf[content]]
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    vectors += call(part)
                except Exception:  # noqa: BLE001
                    vectors += [None] * len(part)
            pdf["_made"] = vectors
            yield pdf

    made = rows.mapInPandas(run, f"{fields}, _made array<double>")
    return made.select(*rows.columns, F.coalesce("_made", hash_embedding(F.col(content))).alias("embedding"))
