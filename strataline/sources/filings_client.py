"""Download of filing documents to a landing folder, which the readers pick up. The transport is a parameter."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession

from .writers import write_text

#: The public addresses and the least seconds between two requests.
REGISTRY_URL = "https://www.sec.gov/files/company_tickers.json"
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK{cik}.json"
MIN_INTERVAL = 0.11


def http_get(url: str, user_agent: str, timeout: float = 30) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as response:
        return response.read().decode("utf-8")


def registry(spark: SparkSession, get: Callable[[str], str]):
    """(ticker, cik_str) of all registered companies."""
    rows = json.loads(get(REGISTRY_URL)).values()
    return spark.createDataFrame([(r["ticker"], int(r["cik_str"])) for r in rows], "ticker string, cik_str long")


def land_filings(spark: SparkSession, companies: Iterable[tuple[str, str]], folder: str, get: Callable[[str], str], pause: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Write <instrument>.json for each (instrument, cik); yields the instruments as they arrive."""
    for instrument, cik in companies:
        pause(MIN_INTERVAL)
        write_text(spark, f"{folder}/{quote(instrument, safe='')}.json", get(FACTS_URL.format(cik=cik)))
        yield instrument
