"""How queries are registered: SQL through a session, or a function of its tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.session import Session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The tables of a folder, registered when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.session, self.folder = Session(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.session.create_table(name, f"{self.folder}/{name}.parquet", file_format="parquet").frame

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                getattr(self, name)
        return self.session.sql(text)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None, checked: bool = True) -> None:
        """A query in SQL; where the oracle's dialect is the same but for NTZ literals, one text serves both."""
        self.queries[name] = lambda spark, folder: Tables(spark, folder).sql(text)
        if checked:
            self.oracles[name] = (oracle or text).replace("TIMESTAMP_NTZ", "TIMESTAMP")

    def frame(self, name: str, oracle: str | None = None) -> Callable:
        """A query in DataFrame operations: a function of the tables."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if oracle:
                self.oracles[name] = oracle
            return f

        return add
