"""A local model as a source of answers: bounded concurrent calls from within tasks, each item with its own deadline.

A client is any callable (text, attempt, seconds left) -> (status, body) that may raise; TimeoutError is lateness. It is made once
in each task by a factory, so that connections are never sent anywhere. What goes wrong is a row's error_code: a failed, late or cut
off answer is never the same as one that found nothing. Items that repeat a text are asked about once in a batch of rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..operators.claims import verified
from ..operators.requests import parsed_answer

Client = Callable[[str, int, float], tuple[int, str | None]]
#: Statuses that are worth another attempt.
RETRYABLE = (408, 429, 500, 502, 503, 504)
ANSWERED = "item_id string, status int, body string, attempts int, error_code string"


def retryable(status: Column) -> Column:
    """Whether another attempt may help; nothing known about a failure counts as a broken connection, which may."""
    return F.coalesce(status.isin(*RETRYABLE), F.lit(True))


def call(client: Client, text: str, attempts: int, seconds: float, pause: float, clock=time.monotonic, sleep=time.sleep) -> tuple[int | None, str | None, int, str | None]:
    """(status, body, attempts made, error_code): tried again after what may pass, with growing pauses, never beyond the deadline."""
    end, status, error = clock() + seconds, None, "model_deadline"
    for attempt in range(1, attempts + 1):
        left = end - clock()
        if left <= 0:
            return None, None, attempt - 1, "model_deadline"
        try:
            status, body = client(text, attempt, left)
            if clock() > end:
                return status, None, attempt, "model_deadline"  # an answer that nobody waits for any more
            if 200 <= status < 300:
                return status, body, attempt, None
            error = "model_unavailable" if status in RETRYABLE else "model_refused"
        except TimeoutError:
            status, error = None, "model_deadline"
        except OSError:
            status, error = None, "model_unavailable"
        if error == "model_refused" or attempt == attempts:
            break
        sleep(min(pause * 2 ** (attempt - 1), max(0.0, end - clock())))
    return status, None, attempt, error


def answered(items: DataFrame, factory: Callable[[], Client], workers: int = 8, attempts: int = 3, seconds: float = 60.0, pause: float = 0.2) -> DataFrame:
    """items (item_id string, text) -> ANSWERED. At most `workers` calls of a task are open at once; a task holds one batch of rows.

    Null texts are `no_text`. A client that raises anything else than lateness or a broken connection is `model_client_error`."""
    names = [c.split()[0] for c in ANSWERED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()

        def one(text: str) -> tuple:
            try:
                return call(client, text, attempts, seconds, pause)
            except Exception:  # noqa: BLE001  a client's fault is its row's
                return None, None, attempts, "model_client_error"

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                texts = list(dict.fromkeys(batch["text"].dropna()))
                said = dict(zip(texts, pool.map(one, texts), strict=True))
                rows = [(i, *(said[t] if isinstance(t, str) else (None, None, 0, "no_text"))) for i, t in zip(batch["item_id"], batch["text"], strict=True)]
                out = pd.DataFrame(rows, columns=names)
                out["status"] = out["status"].astype("Int32")
                yield out

    return items.select("item_id", "text").mapInPandas(run, ANSWERED)


def claims_of(answers: DataFrame, items: DataFrame) -> DataFrame:
    """items (item_id, text, ..) with `spans` (verified claims), `rejected` and error_code: of the call, else of the answer. An item
    without an answer is `model_not_asked`."""
    parsed = parsed_answer(F.col("body"))
    said = answers.select("item_id", F.lit(True).alias("_asked"), F.col("error_code").alias("_call_error"), parsed.alias("_parsed"))
    rows = items.join(said, "item_id", "left")
    error = F.when(F.col("_asked").isNull(), "model_not_asked").otherwise(F.coalesce("_call_error", "_parsed.error_code"))
    rows = rows.withColumn("error_code", error).withColumn("_v", F.when(F.col("error_code").isNull(), verified(F.col("text"), F.col("_parsed.claims"))))
    return rows.select(*items.columns, F.col("_v.spans").alias("spans"), F.col("_v.rejected").alias("rejected"), "error_code")


def scripted(items: DataFrame, script: DataFrame) -> DataFrame:
    """Answers from a table (text_sha256, body) instead of a model: a join by content; texts that it lacks are `model_unavailable`."""
    lines = script.select(F.col("text_sha256").alias("_sha"), "body").dropDuplicates(["_sha"])
    rows = items.select("item_id", F.sha2(F.col("text"), 256).alias("_sha")).join(lines, "_sha", "left")
    found = F.col("body").isNotNull()
    return rows.select("item_id", F.when(found, 200).cast("int").alias("status"), "body", F.lit(1).alias("attempts"), F.when(~found, "model_unavailable").alias("error_code"))
