"""The paged HTTP service as a Spark data source: executors fetch their own id batches or page ranges.

    spark.dataSource.register(ServiceSource)
    spark.read.format("service").schema("id long, name string").options(url=..., token_url=..., client_id=..., secret=..., ids="1,2,3").load()

A partition is some id batches, or a range of pages (``rows`` of the table are known or asked
for by ``count_url``), and has a client of its own, which renews its token when the service
answers 401.  ``pace`` is the number of requests a second that all partitions make together,
if they run at once: each keeps ``partitions / pace`` seconds between its own.  A repeated
attempt fetches its range again; rows that come twice, as pages shift, are deduplicated on id
after the read (``service_rows``).
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StringType, StructType

from tidepool.operators.windows import cap_per_group
from tidepool.sources.http import PAGE, Client, field_query, id_batches


@dataclass
class Batches(InputPartition):
    """Query bodies of one partition."""

    bodies: list[str]


class ServiceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def _bodies(self) -> list[str]:
        page, fields = int(self.options.get("page", PAGE)), self.schema.fieldNames()
        if "ids" in self.options:
            ids = [int(x) for x in self.options["ids"].split(",") if x.strip()]
            return [field_query(fields, f"id = ({','.join(map(str, b))})", page) for b in id_batches(ids, page)]
        rows = int(self.options["rows"]) if "rows" in self.options else self._count()
        return [field_query(fields, self.options.get("where"), page, at) for at in range(0, rows, page)]

    def _count(self) -> int:
        with urllib.request.urlopen(self.options["count_url"]) as answer:
            return int(json.loads(answer.read())["count"])

    def partitions(self) -> list[Batches]:
        bodies, n = self._bodies(), int(self.options.get("partitions", 8))
        per = max(1, -(-len(bodies) // n))
        return [Batches(bodies[a : a + per]) for a in range(0, len(bodies), per)] or [Batches([])]

    def read(self, partition: Batches) -> Iterator[tuple]:
        if not partition.bodies:
            return
        o = self.options
        pause = int(o.get("partitions", 8)) / float(o.get("pace", 4))
        client = Client(o["url"], o["token_url"], o["client_id"], o["secret"], pause)
        for body in partition.bodies:
            for row in client.post(body):
                yield tuple(_fitted(row.get(f.name), f.dataType) for f in self.schema)


def _fitted(value, kind: DataType):
    """A JSON value in its column's type: numbers for decimals, JSON text for nested values in string columns."""
    if value is None:
        return None
    if isinstance(kind, ArrayType):
        return [_fitted(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return float(value) if isinstance(kind, (DoubleType, FloatType)) else value


class ServiceSource(DataSource):
    """Options: url, token_url, client_id, secret; ids, or rows or count_url, and where; page, partitions, pace."""

    @classmethod
    def name(cls) -> str:
        return "service"

    def schema(self):
        raise ValueError("give the schema: its names are the fields that are asked for, id among them")

    def reader(self, schema: StructType) -> ServiceReader:
        if "id" not in schema.fieldNames():
            raise ValueError("the schema needs the field id")
        return ServiceReader(schema, self.options)


def service_rows(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    """The service's rows, one for each id."""
    spark.dataSource.register(ServiceSource)
    df = spark.read.format("service").schema(schema).options(**options).load()
    return cap_per_group(df, "id", [F.xxhash64(*df.columns)], 1)
