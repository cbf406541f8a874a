"""Inventories that come in pages, as a Python Data Source; and a registry of sources and adapters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from korpuskel.session import ship

MAX_PAGES = 10_000
SCHEMA = "item_id string, title string, version string, lifecycle_status string, canonical_url string, artifact_url string, media_type string"
_FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


class Page(InputPartition):
    """One page of an inventory."""


class InventoryReader(DataSourceReader):
    """Follows the cursor from page to page on the driver, then reads each page in a task of its own."""

    def __init__(self, folder: str, first: str, max_pages: int):
        self.folder, self.first, self.max_pages = Path(folder), first, max_pages

    def _page(self, name: str) -> dict:
        if "/" in name or name.startswith("."):
            raise ValueError(f"cursor {name}")
        value = json.loads((self.folder / name).read_text())
        if not isinstance(value, dict) or not isinstance(value.get("items"), list):
            raise ValueError(f"page {name} has no items")
        return value

    def partitions(self) -> list[Page]:
        names, cursor = [], self.first
        while cursor:
            if cursor in names:
                raise ValueError(f"cursor {cursor} is repeated")
            if len(names) >= self.max_pages:
                raise ValueError(f"more than {self.max_pages} pages")
            names.append(cursor)
            cursor = self._page(cursor).get("next")
        return [Page(name) for name in names]

    def read(self, partition: Page) -> Iterator[tuple]:
        for item in self._page(partition.value)["items"]:
            yield tuple(None if item.get(f) is None else str(item[f]) for f in _FIELDS)


class InventorySource(DataSource):
    """Format ``inventory``: pages {items, next} as JSON files in a folder that all executors share.

    Options: ``path`` of the folder, ``first`` page (page-1.json), ``max_pages``.
    """

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(self.options["path"], self.options.get("first", "page-1.json"), int(self.options.get("max_pages", MAX_PAGES)))


def read_inventory(spark: SparkSession, path: str, scope: list[str] | None = None, **options: str) -> DataFrame:
    """The items of an inventory; an id that is repeated is an error when the frame is run, items without an id are left out.

    ``scope`` keeps the items of these ids only.
    """
    ship(spark)
    spark.dataSource.register(InventorySource)
    items = spark.read.format("inventory").options(path=path, **options).load().where("item_id IS NOT NULL")
    if scope is not None:
        items = items.where(F.col("item_id").isin(scope))
    one = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), *[F.first(f).alias(f) for f in _FIELDS[1:]])
    return one.withColumn("item_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated item "), "item_id")).cast("string")).otherwise(F.col("item_id"))).drop("n")


def resolved(items: DataFrame, lookup: DataFrame, suffixes: list[str]) -> DataFrame:
    """Items with the artifact that a second look-up has for them: ``artifact``, or ``blocker`` where there is none.

    ``items``: item_id. ``lookup``: item_id, name, artifact; of several the first
    suffix of ``suffixes`` that a name ends with decides, then the name.
    """
    order = F.coalesce(*[F.when(F.col("name").endswith(s), i) for i, s in enumerate(suffixes)], F.lit(len(suffixes)))
    best = lookup.where("artifact IS NOT NULL").groupBy("item_id").agg(F.min(F.struct(order.alias("o"), "name", "artifact")).alias("b"))
    return items.join(best, "item_id", "left").select(*items.columns, F.col("b.artifact").alias("artifact"), F.when(F.col("b").isNull(), "NO_ARTIFACT").alias("blocker"))


class Registry:
    """Makers by (kind, name, revision); asking for one that isn't there is an error, and so is registering one twice."""

    def __init__(self) -> None:
        self._makers: dict[tuple[str, str, str], Callable] = {}

    def register(self, kind: str, name: str, revision: str, make: Callable) -> None:
        if (kind, name, revision) in self._makers:
            raise ValueError(f"{kind} {name} {revision} is registered already")
        self._makers[kind, name, revision] = make

    def resolve(self, kind: str, name: str, revision: str) -> Callable:
        if (kind, name, revision) not in self._makers:
            raise LookupError(f"no {kind} {name} {revision}")
        return self._makers[kind, name, revision]
