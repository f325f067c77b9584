"""A batch data source of explorer responses, one saved JSON file per address.

`spark.dataSource.register(ExplorerSource)`, then
`spark.read.format("explorer").option("path", folder).option("addresses", "0x...,0x...").load()`. Addresses are spread over
partitions; each partition keeps to `rate` requests a second, so the sum over `partitions` is the limit in force.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "address string, is_verified boolean, contractname string, compilerversion string, licensetype string, sourcecode string, error string"


class TokenBucket:
    """At most `rate` takes a second on average, and `rate` at once."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.tokens, self.last = max(1.0, rate), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(max(1.0, self.rate), self.tokens + (now - self.last) * self.rate)
        self.last = now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.last += wait
            self.tokens = 1.0
        self.tokens -= 1


def check_address(text: str) -> str:
    if not re.fullmatch(r"0x[0-9a-fA-F]{40}", text):
        raise ValueError(f"no address: {text}")
    return text.lower()


class _Addresses(InputPartition):
    def __init__(self, addresses: list[str]):
        self.addresses = addresses


class ExplorerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rate = float(options.get("rate", "5"))
        self.addresses = [check_address(a.strip()) for a in options.get("addresses", "").split(",") if a.strip()]
        self.count = max(1, int(options.get("partitions", "1")))

    def partitions(self) -> list[InputPartition]:
        return [_Addresses(self.addresses[i :: self.count]) for i in range(self.count)]

    def read(self, partition: _Addresses) -> Iterator[tuple]:
        bucket = TokenBucket(self.rate)
        for address in partition.addresses:
            bucket.take()
            try:
                with open(os.path.join(self.path, f"{address}.json"), encoding="utf-8") as saved:
                    doc = json.load(saved)
                row = (doc.get("result") or [{}])[0]
                source = row.get("SourceCode") or None
                yield (address, source is not None, row.get("ContractName"), row.get("CompilerVersion"), row.get("LicenseType"), source, None if doc.get("status") == "1" else doc.get("message"))
            except (OSError, ValueError) as problem:
                yield (address, False, None, None, None, None, type(problem).__name__)


class ExplorerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "explorer"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExplorerReader:
        return ExplorerReader(dict(self.options))
