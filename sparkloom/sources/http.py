"""JSON answers of outside services (S12, S13), asked for in the executors."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame


def ask(url: str, retries: int = 2, backoff: float = 0.8, timeout: float = 25.0, headers: dict | None = None) -> tuple[str | None, int, str]:
    """(answer, status, error) of a GET. 204 is an empty answer without error; other failures are tried again, waiting
    backoff, then twice that, and so on. An answer that isn't JSON is wrapped as ``{"_raw_text": ...}``."""
    error, status = "", 0
    for turn in range(retries + 1):
        if turn:
            time.sleep(backoff * turn)
        try:
            with urlopen(Request(url, headers=headers or {}), timeout=timeout) as got:
                status = got.status
                if status == 204:
                    return None, 204, ""
                text = got.read().decode("utf-8", "replace")
            try:
                json.loads(text)
            except ValueError:
                text = json.dumps({"_raw_text": text})
            return text, status, ""
        except HTTPError as e:
            error, status = str(e), e.code
        except (OSError, ValueError) as e:
            error = str(e)
    return None, status, error


def fetch(requests: DataFrame, endpoints: Sequence[str], per_partition: int = 1, **options) -> DataFrame:
    """Requests with the answer, status, error and endpoint of the first endpoint that answers.

    An endpoint is a URL whose ``{column}`` places take a row's quoted values; a null value counts as empty text. The next one
    is asked where one fails or has nothing (204). Columns of the four new names are replaced. per_partition, the number of
    partitions that ask at once, bounds the load on the service. A lost executor's requests are sent again, so ask only for
    what may be repeated, and keep the result with sources.readers.cached.
    """
    new = ["payload", "status", "error", "endpoint"]
    df = requests.drop(*new)
    names, urls = df.columns, list(endpoints)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                values = {k: quote("" if pd.isna(v) else str(v), safe="") for k, v in zip(names, row, strict=True)}
                said: tuple = (None, 0, "no endpoint", None)
                for at, url in enumerate(urls):
                    said = (*ask(url.format(**values), **options), at)
                    if said[0] is not None:
                        break
                rows.append(said)
            yield batch.assign(**dict(zip(new, zip(*rows, strict=True) if rows else [()] * 4, strict=True)))

    schema = df.schema
    for k, kind in zip(new, ("string", "integer", "string", "integer"), strict=True):
        schema = schema.add(k, kind)
    return df.repartition(per_partition).mapInPandas(run, schema)
