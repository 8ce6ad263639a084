"""Ledger accounts of many companies: a data source that reads one file for each company and year.

A folder holds a folder for each company with its year files (db1{year}.csv, db{year}.csv, db.csv). Files are listed once, on the driver; each is a
partition of its own. Filters on company, fiscal year and account group reach the source: the first two choose files, the third drops rows while a file is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "company string, fy string, code string, name string, acgroup string, bank string, accno string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class YearFile(InputPartition):
    path: str
    company: str
    fy: str


def newest_files(names: list[str], years: list[str]) -> dict[str, str]:
    """Of a company's file names that of each year: db1{year}, then db{year}, then db for a year that has neither."""
    stems = {re.sub(r"\.[^.]*$", "", n).lower(): n for n in sorted(names)}
    known = years or sorted({m[1] for s in stems if (m := re.fullmatch(r"db1?(\d{6})", s))})
    found = {y: next((stems[s] for s in (f"db1{y}", f"db{y}", "db") if s in stems), None) for y in known}
    return {y: n for y, n in found.items() if n}


class CompanyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on company, fy and acgroup are ours; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in ("company", "fy", "acgroup"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[YearFile]:
        from pyarrow import fs

        from tallybook.sources.files import opened

        system, root = opened(self.path)
        companies: dict[str, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.is_file:
                *_, company, name = info.path.split("/")
                companies.setdefault(company, []).append(name)
        years = sorted(f"{fy[:4]}{fy[-2:]}" for fy in self.wanted["fy"]) if "fy" in self.wanted else []
        out = [YearFile(f"{self.path}/{c}/{n}", c, f"{y[:4]}_{y[4:]}") for c, names in sorted(companies.items()) if c in self.wanted.get("company", {c}) for y, n in newest_files(names, years).items()]
        return out or [YearFile("", "", "")]

    def read(self, partition: YearFile):
        import pyarrow as pa
        from pyarrow import compute, csv

        from tallybook.sources.files import opened

        if not partition.path:
            return
        system, at = opened(partition.path)
        with system.open_input_stream(at) as f:
            table = csv.read_csv(f, convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in COLUMNS[2:]}))
        if "acgroup" in self.wanted:
            table = table.filter(compute.is_in(table["acgroup"], value_set=pa.array(sorted(self.wanted["acgroup"]), pa.string())))
        fixed = [pa.array([v] * len(table), pa.string()) for v in (partition.company, partition.fy)]
        table = pa.table([*fixed, *(table[c] for c in COLUMNS[2:])], names=COLUMNS)
        yield from table.to_batches()


class CompanySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "companies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CompanyReader:
        return CompanyReader(self.options["path"].rstrip("/"))


def company_accounts(spark: SparkSession, path: str):
    """Ledger accounts of a folder of companies; filter by company, fy and acgroup to read less."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CompanySource)
    return spark.read.format("companies").load(path)
