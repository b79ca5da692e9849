"""Connectors: JDBC tables, REST pages as a data source, and the registry that names them."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAX_PAGES = 100
MAX_ROWS = 50_000
SECRETS = ("password", "token", "secret", "api_key", "authorization")


def jdbc_rows(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, watermark: tuple[str, str] | None = None, limit: int = MAX_ROWS, **options: str) -> DataFrame:
    """A table through JDBC: Spark pushes the columns, the watermark comparison, the order and the limit to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, pushDownLimit="true", **options).load()
    df = df.select(*columns) if columns else df
    if watermark:
        column, value = watermark
        df = df.where(F.col(column) > F.lit(value).cast(dict(df.dtypes)[column])).orderBy(column)
    return df.limit(limit)


def jdbc_columns(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable="information_schema.columns", **options).load().where(F.col("table_schema") == schema)


def at_path(record: object, path: str) -> object:
    """The value at a dotted path, or None."""
    for part in filter(None, path.split(".")):
        record = record.get(part) if isinstance(record, dict) else None
    return record


class RestPage(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)
        self.page = page


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[RestPage]:
        return [RestPage(p) for p in range(1, min(MAX_PAGES, int(self.o.get("pages", "1"))) + 1)]

    def read(self, partition: RestPage) -> Iterator[tuple[str]]:
        parts = urllib.parse.urlsplit(self.o["path"])
        query = dict(urllib.parse.parse_qsl(parts.query))
        if "page_param" in self.o:
            query[self.o["page_param"]] = str(partition.page)
        if "watermark_param" in self.o and "watermark" in self.o:
            query[self.o["watermark_param"]] = self.o["watermark"]
        address = urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query) if parts.scheme != "file" else ""))
        request = urllib.request.Request(address, headers={"Authorization": f"Bearer {self.o['token']}"} if "token" in self.o else {})
        with urllib.request.urlopen(request, timeout=30) as answer:
            found = at_path(json.load(answer), self.o.get("records_path", ""))
        for record in found if isinstance(found, list) else [found] if found else []:
            yield (json.dumps(record),)


class RestSlice(InputPartition):
    def __init__(self, page: int, first: int, until: int):
        super().__init__(page)
        self.page, self.first, self.until = page, first, until


class RestStream(DataSourceStreamReader):
    """Pages as an append-only log: an offset is a page and how many of its records were taken. A batch is the records between two offsets, which
    Spark writes to the checkpoint before it reads them; so after a restart a batch is read again as it was, and the next one goes on from there."""

    def __init__(self, options: dict):
        self.source, self.size, self.seen = RestReader(options), int(options["page_size"]), 1

    def records(self, page: int) -> list[tuple[str]]:
        return list(self.source.read(RestPage(page)))

    def initialOffset(self) -> dict:
        return {"page": 1, "row": 0}

    def latestOffset(self) -> dict:
        """The last page with records: steps that double until a page isn't full, then halves of what lies between."""
        full, step = self.seen - 1, 1  # pages known to be full
        while len(self.records(full + step)) == self.size:
            full, step = full + step, step * 2
        high = full + step  # not full
        while high - full > 1:
            middle = (full + high) // 2
            full, high = (middle, high) if len(self.records(middle)) == self.size else (full, middle)
        self.seen = full + 1
        return {"page": full + 1, "row": len(self.records(full + 1))}

    def partitions(self, start: dict, end: dict) -> list[RestSlice]:
        return [RestSlice(p, start["row"] if p == start["page"] else 0, end["row"] if p == end["page"] else self.size) for p in range(start["page"], end["page"] + 1)]

    def read(self, partition: RestSlice) -> Iterator[tuple[str]]:
        found = self.records(partition.page)[: partition.until]
        if len(found) < partition.until:
            raise ValueError(f"page {partition.page} has lost records")
        yield from found[partition.first :]

    def commit(self, end: dict) -> None:
        pass


class RestSource(DataSource):
    """format("rest_json"): one row (record) of JSON text for each record of each page."""

    @classmethod
    def name(cls) -> str:
        return "rest_json"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> RestReader:
        return RestReader(dict(self.options))

    def streamReader(self, schema) -> RestStream:
        return RestStream(dict(self.options))


def rest_rows(spark: SparkSession, address: str, **options: str) -> DataFrame:
    """Records with columns: the schema is that of the first one."""
    spark.dataSource.register(RestSource)
    raw = spark.read.format("rest_json").options(**options).load(address)
    first = raw.first()
    if first is None:
        return raw
    schema = spark.range(1).select(F.schema_of_json(F.lit(first["record"]))).first()[0]
    return raw.select(F.from_json("record", schema).alias("r")).select("r.*")


def rest_stream(spark: SparkSession, address: str, page_size: int, page_param: str = "page", **options: str) -> DataFrame:
    """Records (record: JSON text) of a paged address as a stream that takes each of them once."""
    spark.dataSource.register(RestSource)
    return spark.readStream.format("rest_json").options(page_size=str(page_size), page_param=page_param, **options).load(address)


def redacted(config: object) -> object:
    """A configuration fit for logs."""
    if isinstance(config, dict):
        return {k: "***" if k.lower() in SECRETS else redacted(v) for k, v in config.items()}
    return [redacted(v) for v in config] if isinstance(config, list) else config


CONNECTORS = {"jdbc": jdbc_rows, "rest": rest_rows}


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    if not 1 <= n <= 500:
        raise ValueError("a preview has 1 to 500 rows")
    return df.limit(n)
