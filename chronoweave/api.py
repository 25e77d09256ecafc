"""The engine as one object: single and batch conversion, bins, source inference, settings."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import summary
from .plans import convert as plan
from .schema import FORMS, PRIORITY
from .session import cut
from .sources.store import Store, formal_name, releases_of


@dataclass(frozen=True)
class Settings:
    """What a graph is built for. Changed copies check what they are given."""

    organism: str = "world"
    form: str = "gene"
    release: int | None = None
    assembly: int = min(PRIORITY, key=PRIORITY.get)
    releases: tuple[int, ...] = field(default=())

    def change_form(self, form: str) -> Settings:
        if form not in FORMS:
            raise ValueError(f"{form} is not one of {FORMS}")
        return replace(self, form=form)

    def change_release(self, release: int) -> Settings:
        if isinstance(release, bool) or not isinstance(release, int) or release <= 0 or self.releases and release not in self.releases:
            raise ValueError(f"{release} is not one of the releases {self.releases}")
        return replace(self, release=release)

    def change_assembly(self, assembly: int) -> Settings:
        if assembly not in PRIORITY:
            raise ValueError(f"{assembly} is not one of {sorted(PRIORITY)}")
        return replace(self, assembly=assembly)


class Engine:
    def __init__(self, spark: SparkSession, tables: plan.Tables, settings: Settings | None = None, hub: int | None = 50):
        self.spark, self.tables, self.hub = spark, tables, hub
        self.settings = settings or Settings()

    def __repr__(self) -> str:
        return f"Engine({self.settings})"

    @classmethod
    def stored(cls, spark: SparkSession, path: str, prefix: str = "graph", **more) -> Engine:
        return cls(spark, plan.load(Store(spark, path), prefix), **more)

    def queries(self, names: Iterable[str] | DataFrame, from_release: int | None = None, to_release: int | None = None) -> DataFrame:
        """(query_id, from_release, to_release) of names, or of the first column of a table that may have the others."""
        if not isinstance(names, DataFrame):
            names = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "query_id string")
        q = names.withColumnRenamed(names.columns[0], "query_id")
        for c, v in (("from_release", from_release), ("to_release", to_release if to_release is not None else self.settings.release)):
            if c not in q.columns:
                q = q.withColumn(c, F.lit(v).cast("int"))
        return q.select("query_id", "from_release", "to_release")

    def convert_many(self, names: Iterable[str] | DataFrame, from_release: int | None = None, to_release: int | None = None, database: str | None = None, one: bool = True, return_path: bool = False, **more) -> DataFrame:
        if database is not None and database not in self.known_databases:
            raise ValueError(f"{database} is not one of {sorted(self.known_databases)}")
        return plan.convert(self.tables, self.queries(names, from_release, to_release), database, one, return_path, hub=self.hub, **more)

    def convert(self, name: str, from_release: int | None = None, to_release: int | None = None, database: str | None = None, one: bool = True, return_path: bool = False, **more) -> dict:
        """One name: query_id, node, targets, finals, status, and with return_path the rows with their paths."""
        rows = [r.asDict() for r in self.convert_many([name], from_release, to_release, database, one, return_path, **more).collect()]
        found = [r for r in rows if r["target"] is not None]
        out = {"query_id": name, "node": next((r["node"] for r in rows if r["node"]), None), "targets": sorted({r["target"] for r in found}), "finals": sorted({r["final"] for r in found}), "status": rows[0]["status"]}
        return out | ({"rows": found} if return_path else {})

    @staticmethod
    def bins(converted: DataFrame) -> DataFrame:
        return plan.bins(converted)

    @staticmethod
    def report(converted: DataFrame) -> str:
        return plan.report(converted)

    def infer_source(self, names: Iterable[str] | DataFrame, mode: str = "complete", winner: bool = True) -> DataFrame | tuple | None:
        """How many of the names each source has; with winner the first of these as a tuple."""
        if not isinstance(names, DataFrame):
            names = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
        found = summary.infer_source(summary.trios(self.tables.connections), names, mode)
        if not winner:
            return found
        first = found.first()
        return tuple(first)[:-1] if first else None

    @cached_property
    def known_databases(self) -> set[str]:
        return {r.db for r in self.databases().collect()}  # a row a database

    def databases(self) -> DataFrame:
        return self.tables.connections.select("db").filter("not startswith(db, 'form_') and db <> 'base'").distinct()

    def warm_up(self) -> Engine:
        """Writes the graph's tables once, so that what follows starts from them."""
        t = self.tables
        self.tables = plan.Tables(*[cut(x, n) for n, x in (("history", t.history), ("connections", t.connections), ("nodes", t.nodes), ("ranges", t.ranges))])
        return self

    def forms(self) -> list[str]:
        """The forms that the graph includes."""
        have = {r.db for r in self.tables.connections.select("db").filter("startswith(db, 'form_')").distinct().collect()}
        return ["gene", *(["transcript"] if "form_gene" in have else []), *(["translation"] if "form_transcript" in have else [])]


def setup(names: DataFrame, synonyms: DataFrame, organism: str, release: int | None = None) -> Settings:
    """Settings of an organism by any of its names, with the releases that the schemas (name) have; the last by default."""
    formal = formal_name(synonyms, organism)
    have = tuple(r.release for r in releases_of(names, formal).select("release").distinct().orderBy("release").collect())
    s = Settings(organism=formal, releases=have)
    return s.change_release(release if release is not None else have[-1]) if have else s


def logger(level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger("chronoweave")
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    log.setLevel(level)
    return log
