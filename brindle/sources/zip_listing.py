"""What archives hold, listed by a task an archive, with predicates on names pushed down; contents are read by a task a block of members.

The driver sees paths of archives only. Archives are opened through seekable files, so remote ones are read by ranges: the
central directory for a listing, and then the members that are wanted.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from brindle.session import Staged
from brindle.sources.crop_sink import file_system
from brindle.sources.files import ZipReader

#: The setting without which Spark takes a source that accepts predicates for an error.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of contents that a batch holds at least before it is passed on.
BATCH = 16 << 20


def opened(path: str) -> zipfile.ZipFile:
    files, place = file_system(path)
    return zipfile.ZipFile(files.open_input_file(place))


@dataclass
class _Archive(InputPartition):
    path: str


class ListingReader(ZipReader):
    """Names by the options, as for the members' source."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.tests: list[tuple[str, object]] = []

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def _passes(self, name: str) -> bool:
        how = {"is": lambda v: name in v, "starts": name.startswith, "ends": name.endswith, "holds": lambda v: v in name}
        return self.wanted(name) and all(how[kind](v) for kind, v in self.tests)

    def read(self, part: _Archive | None) -> Iterator[tuple]:
        if part is None:  # no archive is named
            return
        with opened(part.path) as z:
            found = (i for i in z.infolist() if not i.is_dir() and self._passes(i.filename))
            for k, i in enumerate(found):
                yield part.path, i.filename, i.file_size, k


class PushedListingReader(ListingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality, lists, beginnings, ends and parts of zip_member, and equality and lists of zip_path, are dealt with here, and that there is a value."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and column in (("zip_member",), ("zip_path",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if column == ("zip_path",):
                    self.paths = [p for p in self.paths if p in values]
                else:
                    self.tests.append(("is", values))
            elif isinstance(f, (StringStartsWith, StringEndsWith, StringContains)) and column == ("zip_member",):
                self.tests.append(({StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}[type(f)], f.value))
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f


class ZipListing(DataSource):
    """format('zip_listing'): zip_path, zip_member, length, position (among the listed members of the archive).

    Options: path, suffixes, include, exclude as in 'zip_members'; pushdown (true: takes predicates, which needs the setting
    spark.sql.python.filterPushdown.enabled).
    """

    @classmethod
    def name(cls) -> str:
        return "zip_listing"

    def schema(self) -> str:
        return "zip_path string, zip_member string, length long, position long"

    def reader(self, schema) -> DataSourceReader:
        return (PushedListingReader if self.options.get("pushdown") == "true" else ListingReader)(dict(self.options))


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), include: list[list[str]] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """zip_path, zip_member, length, position of the archives' members; lazy. Predicates reach the source if the session lets them."""
    spark.dataSource.register(ZipListing)
    r = spark.read.format("zip_listing").option("path", path).option("suffixes", ",".join(suffixes)).option("pushdown", spark.conf.get(PUSHDOWN, "false").lower())
    return r.option("include", ";".join(",".join(axis) for axis in include or [])).option("exclude", ",".join(exclude or [])).load()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listed members with their contents; an archive is opened once for neighbours in a batch. A member that can't be read is left out."""
    for b in batches:
        paths, names = (b.column(c).to_pylist() for c in ("zip_path", "zip_member"))
        rows: list[tuple] = []
        held, at, z = 0, None, None
        try:
            for p, n in zip(paths, names, strict=True):
                if p != at:
                    if z:
                        z.close()
                    z, at = opened(p), p
                try:
                    data = z.read(n)
                except (zipfile.BadZipFile, OSError):
                    continue
                rows.append((p, n, len(data), data))
                held += len(data)
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        finally:
            if z:
                z.close()
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"zip_path": pa.string(), "zip_member": pa.string(), "length": pa.int64(), "content": pa.binary()}
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def with_contents(listing: DataFrame, block: int = 2000) -> DataFrame:
    """zip_path, zip_member, length, content of listed members, read in as many tasks as there are blocks of `block` members. Runs the listing's job."""
    known, n = Staged(listing.sparkSession).counted(listing)
    archives = known.select("zip_path").distinct().count()
    # a number of its own: to Spark names are small, and it would put them together in one task
    dealt = known.repartition(max(1, n // block + archives), "zip_path", F.floor(F.col("position") / block)).sortWithinPartitions("zip_path", "position")
    return dealt.mapInArrow(_contents, "zip_path string, zip_member string, length long, content binary")
