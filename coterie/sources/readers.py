"""Tables from files, services and databases. File readers are Spark's own; columns are chosen before the
scan, so that Spark reads no others."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..party import PartyFrame, Role, Task

#: JDBC url prefix and default port per kind of database; some speak another one's protocol.
DATABASES = {"mysql": ("jdbc:mysql", 3306), "mariadb": ("jdbc:mariadb", 3306), "oracle": ("jdbc:oracle:thin", 1521), "gaussdb": ("jdbc:postgresql", 6789), "gbase8a": ("jdbc:mysql", 6789), "db2": ("jdbc:db2", 50000)}


def choose(df: DataFrame, target: Sequence[str] | None = None, excluding: Sequence[str] | None = None) -> DataFrame:
    out = df.select(*target) if target else df
    return out.drop(*(excluding or ()))


def from_parquet(spark: SparkSession, path: str, target: Sequence[str] | None = None, excluding: Sequence[str] | None = None) -> DataFrame:
    return choose(spark.read.parquet(path), target, excluding)


def header_names(n: int, labelled: bool) -> list[str]:
    head = ["id", "y"] if labelled else ["id"]
    return head + [f"x{k}" for k in range(n - len(head))]


def from_csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = False, labelled: bool = True, schema: StructType | str | None = None) -> DataFrame:
    """Delimited text. Without a header, columns are id, [y], x0, x1, ..."""
    reader = spark.read.option("sep", delimiter).option("header", has_header).option("ignoreLeadingWhiteSpace", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df if has_header or schema else df.toDF(*header_names(len(df.columns), labelled))


def from_json(spark: SparkSession, path: str, data_field: str = "data") -> DataFrame:
    """A JSON object whose data_field is a list of records."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(data_field))


class _Records(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def rows(self, number: int) -> list[dict]:
        raise NotImplementedError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in self.rows(partition.value):
            yield tuple(r.get(n) for n in self.names)


class _Api(_Records):
    """A call, and a task, for each set of parameters."""

    def calls(self) -> list[dict]:
        own = json.loads(self.options.get("params", "{}"))
        return own if isinstance(own, list) else [own]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.calls()))]

    def rows(self, number: int) -> list[dict]:
        import time
        import urllib.error
        import urllib.request

        body = json.dumps(self.calls()[number]).encode()
        for again in range(int(self.options.get("retries", "3")), -1, -1):
            call = urllib.request.Request(self.options["url"], body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(call, timeout=float(self.options.get("timeout", "60"))) as f:
                    return json.load(f)[self.options.get("datafield", "data")]
            except urllib.error.HTTPError as e:
                if e.code < 500 or not again:  # what the server refuses now it refuses later
                    raise
            except urllib.error.URLError:
                if not again:
                    raise
            time.sleep(0.2)
        raise AssertionError("not reached")


class _Excel(_Records):
    def rows(self, number: int) -> list[dict]:
        import pandas as pd

        return pd.read_excel(self.options["path"]).astype(object).where(lambda x: x.notna(), None).to_dict("records")


class ApiSource(DataSource):
    """POST to a url, once or once for each set of parameters; the records are in one field of the answer."""

    @classmethod
    def name(cls) -> str:
        return "coterie_api"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Api(schema, self.options)


class ExcelSource(DataSource):
    """The first sheet of a workbook (needs a pandas Excel engine on the executors)."""

    @classmethod
    def name(cls) -> str:
        return "coterie_excel"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Excel(schema, self.options)


def from_api(spark: SparkSession, url: str, schema: str, params: dict | list[dict] | None = None, data_field: str = "data", retries: int = 3, timeout: float = 60.0) -> DataFrame:
    """The records that a service answers with. A list of params, such as one for each page, makes a call of each,
    side by side; a call is repeated if the server fails or is not there."""
    spark.dataSource.register(ApiSource)
    return spark.read.format("coterie_api").schema(schema).options(url=url, params=json.dumps(params or {}), dataField=data_field, retries=retries, timeout=timeout).load()


def from_excel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.dataSource.register(ExcelSource)
    return spark.read.format("coterie_excel").schema(schema).option("path", path).load()


def from_anyfile(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    reader = {"csv": from_csv, "txt": from_csv, "dat": from_csv, "json": from_json, "parquet": from_parquet, "xls": from_excel, "xlsx": from_excel}.get(kind)
    if reader is None:
        raise ValueError(f"no reader for .{kind} files")
    return reader(spark, path, **options)


def database_url(kind: str, host: str, database: str, port: int | None = None) -> str:
    prefix, default = DATABASES[kind]
    return f"{prefix}:@{host}:{port or default}/{database}" if kind == "oracle" else f"{prefix}://{host}:{port or default}/{database}"


def database_options(kind: str, host: str, database: str, table: str, user: str, password: str, port: int | None = None, target: Sequence[str] | None = None, split: tuple[str, int, int, int] | None = None) -> dict:
    """Options of Spark's JDBC reader; the chosen columns are part of the query. split: a numeric column, its
    usual least and greatest value, and the number of ranges of it that are read side by side."""
    query = f"select {', '.join(target) if target else '*'} from {table}"
    own = {"url": database_url(kind, host, database, port), "user": user, "password": password}
    if split is None:
        return own | {"query": query}
    column, low, high, parts = split
    return own | {"dbtable": f"({query}) chosen", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


@dataclass(frozen=True)
class Database:
    """A connection: its JDBC url and properties (user, password, driver, ...)."""

    #: How often a range that holds too many rows is cut again.
    ROUNDS = 8

    spark: SparkSession
    url: str
    properties: dict[str, str]

    def ask(self, query: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=query, **self.properties).load()

    def quoted(self, name: str) -> str:
        mark = "`" if self.url.startswith(("jdbc:mysql", "jdbc:mariadb")) else '"'
        return f"{mark}{name}{mark}"

    def columns(self, table: str, target: Sequence[str] | None = None, excluding: Sequence[str] | None = None) -> list[str]:
        """The columns that are wanted, in the table's order unless named; names match in any case."""
        have = self.ask(f"select * from {table} where 1 = 0").columns
        named = {c.lower(): c for c in have}
        if unknown := [c for c in (*(target or ()), *(excluding or ())) if c.lower() not in named]:
            raise ValueError(f"{table} has no columns {unknown}; it has {have}")
        out = [named[c.lower()] for c in target] if target else have
        return [c for c in out if c.lower() not in {x.lower() for x in excluding or ()}]

    def predicates(self, table: str, column: str, parts: int, name: str | None = None) -> list[str]:
        """Conditions on a numeric column (under another name, if given), of which every row meets just one,
        rows without a value included: some `parts` ranges, cut by what the database counts. Ranges of equal
        width are counted first; one that holds more than its share is counted again on a finer grid, down to
        one value or ROUNDS times."""
        own = self.quoted(self.columns(table, [column])[0])
        name = name or own
        low, high, n = self.ask(f"select min({own}) as lo, max({own}) as hi, count({own}) as n from {table}").first()
        if not n:
            return [f"{name} is null"]
        share, done, todo = -(-n // parts), [], [(low, high, n)]
        for _ in range(self.ROUNDS):
            finer = []
            for a, b, held in todo:
                if held <= share or a == b:
                    done.append((a, held))
                    continue
                slot = f"floor(({own} - {a}) / {float(b - a) / (4 * parts)!r})"
                inside = self.ask(f"select slot, count(*) as n, min(v) as lo, max(v) as hi from (select {slot} as slot, {own} as v from {table} where {own} >= {a} and {own} <= {b}) x group by slot")
                finer += [(r[2], r[3], r[1]) for r in inside.collect()]  # 4 * parts rows
            todo = finer
            if not todo:
                break
        cuts, held = [], 0  # neighbours are joined up to a share
        for a, k in sorted([*done, *[(a, k) for a, _, k in todo]]):
            if held and held + k > share:
                cuts.append(a)
                held = 0
            held += k
        ends = [None, *cuts, None]
        ranges = [" and ".join(([f"{name} >= {a}"] if a is not None else []) + ([f"{name} < {b}"] if b is not None else [])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [r or f"{name} is not null" for r in ranges] + [f"{name} is null"]

    def read(self, table: str, target: Sequence[str] | None = None, excluding: Sequence[str] | None = None, split: str | None = None, parts: int = 8) -> DataFrame:
        """The wanted columns, which alone the database is asked for; with split, a numeric column, by one
        task for each of its ranges and one for its nulls."""
        wanted = [self.quoted(c) for c in self.columns(table, target, excluding)]
        if split is None:
            return self.spark.read.jdbc(self.url, f"(select {', '.join(wanted)} from {table}) chosen", properties=self.properties)
        own = self.quoted(self.columns(table, [split])[0])
        query = f"(select {', '.join(wanted)}, {own} as split_by from {table}) chosen"
        return self.spark.read.jdbc(self.url, query, predicates=self.predicates(table, split, parts, "split_by"), properties=self.properties).drop("split_by")


def from_database(spark: SparkSession, kind: str, host: str, database: str, table: str, user: str, password: str, port: int | None = None, target: Sequence[str] | None = None, excluding: Sequence[str] | None = None, split: tuple[str, int, int, int] | str | None = None, parts: int = 8) -> DataFrame:
    """One of DATABASES, by JDBC (its driver must be on the class path); without split one task reads it.
    split: a numeric column, whose ranges are found by asking the database, or what database_options takes."""
    if isinstance(split, tuple):
        return choose(spark.read.format("jdbc").options(**database_options(kind, host, database, table, user, password, port, target, split)).load(), None, excluding)
    return Database(spark, database_url(kind, host, database, port), {"user": user, "password": password}).read(table, target, excluding, split, parts)


def dummy_ids(spark: SparkSession, n: int, random: bool = False, seed: int = 0) -> DataFrame:
    """Ids 1 to n, or hashes of them."""
    ids = spark.range(1, n + 1)
    return ids.select(F.xxhash64("id", F.lit(seed)).alias("id")) if random else ids


def dummy_table(spark: SparkSession, n: int, features: int, seed: int = 0, regression: bool = False, labelled: bool = True) -> DataFrame:
    """Uniform features and, if labelled, a uniform or 0/1 label."""
    y = F.rand(seed).alias("y") if regression else (F.rand(seed) < 0.5).cast("int").alias("y")
    return spark.range(n).select("id", *([y] if labelled else []), *[F.rand(seed + 1 + k).alias(f"x{k}") for k in range(features)])


def crop(pixels, height: int, width: int, top: int, left: int, rows: int, columns: int):
    """A window of an image that is a flat, row-major array column."""
    return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(top + rows - 1)), lambda r: F.slice(pixels, r * width + left + 1, columns)))


def party_crops(pixels, height: int, width: int, parties: int) -> list:
    """Equal spatial parts: left and right halves, three vertical strips, or four quarters."""
    if parties == 4:
        h, w = height // 2, width // 2
        return [crop(pixels, height, width, t, x, h, w) for t in (0, h) for x in (0, w)]
    step = width // parties
    return [crop(pixels, height, width, 0, k * step, height, step if k < parties - 1 else width - step * k) for k in range(parties)]


def draw(name: str, n: int, *parts) -> Column:
    """A number in [0, n) that the parts (columns or constants) and a name determine."""
    text = F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts], F.lit(name))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).cast("int")


def augmented(pixels: str, height: int, width: int, id_col: str, seed: int, epoch: int, pad: int = 4, flip: bool = True) -> Column:
    """An image (a flat array of planes of rows) after a random crop of its zero-padded self, and, half of the
    time, from right to left. What is drawn depends on seed, epoch and the row's id alone, so an epoch looks
    alike however the table is dealt, and the next one does not."""
    down, right = draw("y", 2 * pad + 1, id_col, epoch, seed) - pad, draw("x", 2 * pad + 1, id_col, epoch, seed) - pad
    turned = draw("flip", 2, id_col, epoch, seed) == 1 if flip else F.lit(False)
    plane = height * width

    def pixel(i: Column) -> Column:
        y, x = F.floor(i % plane / width).cast("int"), i % width
        x = F.when(turned, width - 1 - x).otherwise(x) + right
        y = y + down
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        at = F.floor(i / plane).cast("int") * plane + y * width + x
        return F.when(inside, F.get(F.col(pixels), at)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), pixel)


def overridden(df: DataFrame, id_col: str, pixels: str, replaced: DataFrame) -> DataFrame:
    """Images that stand in replaced (id, pixels) in place of the table's own."""
    other = replaced.select(F.col(id_col).alias("_id"), F.col(pixels).alias("_other"))
    out = df.join(other, F.col(id_col) == F.col("_id"), "left")
    return out.select(*[F.coalesce("_other", pixels).alias(c) if c == pixels else df[c] for c in df.columns])


@dataclass(frozen=True)
class NamedDataset:
    """Where a data set lies and what its columns are."""

    path: str
    id_col: str
    features: tuple[str, ...]
    label: str
    task: Task = Task.CLASSIFICATION


def named_dataset(spark: SparkSession, known: dict[str, NamedDataset], name: str, role: Role, passive_share: float = 0.5, permute: str = "sequence", seed: int = 0, importances: dict[str, float] | None = None) -> PartyFrame:
    """One party's side of a data set by name: features are permuted, the first int(share * n) go to the
    passive party, the others and the label to the active one."""
    if name not in known:
        raise ValueError(f"no data set named {name}; there are {sorted(known)}")
    d = known[name]
    whole = PartyFrame(from_anyfile(spark, d.path), d.id_col, d.features, d.label, d.task).permuted(permute, seed, importances)
    active, passive = whole.vertical_split(passive_share)
    return active if role is Role.ACTIVE else passive
