"""Listings, JSON labels, manifests, archive members and their sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.functions import scalars as S
from brindle.operators.prefix import scan
from brindle.operators.profile import IMAGE_EXTENSIONS


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length of every file below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def images(files: DataFrame) -> DataFrame:
    return files.filter(S.extension("path").isin(*IMAGE_EXTENSIONS))


def image_pixels(spark: SparkSession, root: str) -> DataFrame:
    """image(origin, height, width, nChannels, mode, data), decoded in the JVM; unreadable files are left out."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)


def json_labels(spark: SparkSession, root: str) -> DataFrame:
    """json_path, json: a row per file, whole."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root).select(F.col("_metadata.file_path").alias("json_path"), F.col("value").alias("json"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A saved manifest; boxes and polygons that were kept as JSON text are parsed."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    if kinds.get("bbox") == "string":
        a = F.from_json("bbox", "array<double>")
        df = df.withColumn("bbox", F.when(F.size(a) == 4, F.struct(a[0].alias("x1"), a[1].alias("y1"), a[2].alias("x2"), a[3].alias("y2"))))
    if kinds.get("polygon") == "string":
        df = df.withColumn("polygon", F.transform(F.from_json("polygon", "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return df


def chunks(spark: SparkSession, glob: str) -> DataFrame:
    """Manifests of a glob as one, columns by name, with the file's stem in `chunk`."""
    return spark.read.option("mergeSchema", "true").parquet(glob).withColumn("chunk", S.stem(F.col("_metadata.file_path")))


def save_manifest(df: DataFrame, path: str, as_text: bool = False) -> None:
    """Parquet with nested columns, or with boxes and polygons as JSON text."""
    if as_text:
        kinds = dict(df.dtypes)
        if kinds.get("bbox", "").startswith("struct"):
            df = df.withColumn("bbox", F.to_json(F.when(F.col("bbox").isNotNull(), F.array("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2"))))
        if kinds.get("polygon", "").startswith("array"):
            df = df.withColumn("polygon", F.to_json(F.transform("polygon", lambda p: F.array(p["x"], p["y"]))))
    df.write.mode("overwrite").parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    """A part file more, with its own header, which history() takes off again."""
    df.write.mode("append").option("header", "true").csv(path)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def cached_by_fingerprint(compute, root: str, digest: str, spark: SparkSession) -> DataFrame:
    """What compute() gave for this digest before, or now."""
    path = f"{root.rstrip('/')}/{digest}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parse_listing(lines: DataFrame, order: str = "line_no", text: str = "value", by: list[str] | None = None) -> DataFrame:
    """A printed tree: 'name | size | key' rows under folder rows, to folder, name, size, size_gb, filekey.

    A row's folder is the last folder row before it (within `by`, if the text has parts), which a scan by ranges carries down.
    """
    # The marks of a printed tree, the length of a folder's name, and rows that sum up.
    mark = r"^[\s│├└─|+\\\-]*"
    cut = F.split(text, r"\|")
    key = F.trim(F.element_at(cut, -1))
    is_file = (F.size(cut) >= 3) & key.rlike("^[0-9]{2,}$")
    folder = F.trim(F.regexp_replace(text, mark, ""))
    keyed = F.col(text).rlike(r"\|\s*[0-9]{2,}\s*$")
    is_folder = ~is_file & ~keyed & (folder != "") & (F.length(folder) < 120) & ~F.lower(folder).rlike("^(total|sum|---)")
    part = lambda k: F.trim(F.try_element_at(cut, F.lit(k)))
    lines = scan(lines.select(*(by or []), order, text), [order], {"_folder": ("last", F.when(is_folder, folder))}, by)
    rows = lines.select(*(by or []), order, F.coalesce("_folder", F.lit("")).alias("folder"), F.regexp_replace(part(-3), mark, "").alias("name"), part(-2).alias("size"), key.alias("filekey"), is_file.alias("_f"))
    return rows.filter("_f").drop("_f").withColumn("size_gb", S.size_gb("size"))


def archives(files: DataFrame, path: str = "path") -> DataFrame:
    """Archives that are no half-finished downloads."""
    # Endings of archives and the name of a download's backup.
    return files.filter(F.lower(path).rlike(r"\.(zip|tar|tar\.gz|tgz)$") & ~S.file_name(path).rlike(r"^download_[0-9]{8}_[0-9]{6}\.tar$"))


class _Members(InputPartition):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        words = lambda text: [w for w in text.split(",") if w]
        self.paths = words(options.get("path", ""))
        self.suffixes = tuple(s.lower() for s in words(options.get("suffixes", "")))
        self.slice = int(options.get("members", "2000"))
        self.contents = options.get("contents", "true") == "true"
        self.exclude = words(options.get("exclude", ""))
        self.include = [words(axis) for axis in options.get("include", "").split(";") if axis]

    def wanted(self, name: str) -> bool:
        if self.suffixes and not name.lower().endswith(self.suffixes) or any(x in name for x in self.exclude):
            return False
        return all(axis[0] in name or not any(o in name for o in axis[1:]) for axis in self.include)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            with zipfile.ZipFile(p) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir() and self.wanted(i.filename)]
            out += [_Members(p, names[k : k + self.slice]) for k in range(0, len(names), self.slice)]
        return out

    def read(self, part: _Members | None) -> Iterator[tuple]:
        if part is None:  # no member is wanted
            return
        with zipfile.ZipFile(part.path) as z:
            for n in part.names:
                if not self.contents:
                    yield part.path, n, z.getinfo(n).file_size, None
                    continue
                try:
                    data = z.read(n)
                except (zipfile.BadZipFile, OSError):
                    continue
                yield part.path, n, len(data), data


class ZipSource(DataSource):
    """format('zip_members'): zip_path, zip_member, length, content, read through the central directory without unpacking.

    Options: path (several with commas, in storage that the workers see as files), suffixes, members (a task's share),
    contents (false: null), include (axes with semicolons, each words with commas: the wanted one, then its others), exclude
    (words). Members that these leave out are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "zip_path string, zip_member string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(dict(self.options))


# The fields of a saved profile.
REPORT = "root string, scanned_at string, n_images long, n_jsons long, size_gb double, has_normal boolean, class_counts map<string,long>, resolutions map<string,long>, lesion_area map<string,double>, field_guess map<string,string>, warnings array<string>"


def load_report(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    """What save_report() wrote, by a given schema: unknown keys are ignored, missing ones are null."""
    return spark.read.schema(schema).json(path)


def peek(files: DataFrame, path: str = "path", size: str = "length", samples: int = 30) -> DataFrame:
    """One row: images, jsons, files, size_gb, what to do next, and the first paths."""
    kind = S.extension(path)
    first = F.slice(F.array_sort(F.collect_list(F.col("p"))), 1, samples)
    some = files.select(F.col(path).alias("p")).orderBy("p").limit(samples).agg(first.alias("samples"))
    g = files.agg(F.count_if(kind.isin(*IMAGE_EXTENSIONS)).alias("images"), F.count_if(kind == "json").alias("jsons"), F.count("*").alias("files"), (F.coalesce(F.sum(size), F.lit(0)) / float(1 << 30)).alias("size_gb"))
    advice = F.when((F.col("images") > 0) & (F.col("jsons") > 0), "complete").when(F.col("jsons") > 0, "images are missing").when(F.col("images") > 0, "labels are missing").otherwise("nothing usable")
    return g.withColumn("advice", advice).crossJoin(F.broadcast(some))


def verify(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """One row: images, jsons, size_gb (rounded to hundredths), and a warning if there is no image."""
    return peek(files, path, size, 1).select("images", "jsons", F.round("size_gb", 2).alias("size_gb"), (F.col("images") == 0).alias("no_images"))


def has_usable_data(files: DataFrame, least: int = 1, path: str = "path") -> bool:
    """Whether there are `least` images, labels or finished archives; looks no further than those. Runs a job."""
    usable = files.filter(S.extension(path).isin(*IMAGE_EXTENSIONS, "json")).select(path).union(archives(files, path).select(path))
    return usable.limit(least).count() >= least


def label_plan(files: DataFrame, free_gb: float, kind: str = "kind", gb: str = "gb") -> DataFrame:
    """kind, gb, largest, fits (all of it), largest_fits: whether the archives of a kind fit the free space."""
    return files.groupBy(kind).agg(F.sum(gb).alias("gb"), F.max(gb).alias("largest")).withColumn("fits", F.col("gb") <= free_gb).withColumn("largest_fits", F.col("largest") <= free_gb)


def prepared_tags(listing: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """tag, root, n_files: the crop folders 'root/.../crops/tag/file' that hold images, from the first root that has each.

    Empty folders hide nothing, and folders go before archives of the same tag ('crops_tag.zip', n_files null).
    """
    rank = F.coalesce(*(F.when(F.col(path).startswith(r.rstrip("/") + "/"), F.lit(k)) for k, r in enumerate(roots)))
    tag = F.regexp_extract(path, r"/crops/([^/]+)/", 1)
    dirs = listing.filter(S.extension(path).isin(*IMAGE_EXTENSIONS) & (tag != "")).select(rank.alias("rank"), tag.alias("tag")).filter("rank is not null").groupBy("tag", "rank").agg(F.count("*").alias("n_files"))
    packed = F.regexp_extract(S.file_name(path), r"^crops_(.+)\.zip$", 1)
    zips = listing.filter(packed != "").select(packed.alias("tag"), rank.alias("rank"), F.lit(None).cast("long").alias("n_files")).filter("rank is not null").distinct()
    best = dirs.unionByName(zips).groupBy("tag").agg(F.min(F.struct(F.col("n_files").isNull().alias("packed"), "rank", "n_files")).alias("b"))
    return best.select("tag", F.element_at(F.array(*map(F.lit, roots)), (F.col("b.rank") + 1).cast("int")).alias("root"), F.col("b.n_files").alias("n_files"))


def runs(listing: DataFrame, checkpoint: str = "best.pt", path: str = "path") -> DataFrame:
    """name: the folders that hold a checkpoint."""
    return listing.filter(S.file_name(path) == checkpoint).select(F.element_at(F.split(path, "/"), -2).alias("name")).distinct()


def run_names(listings: list[DataFrame]) -> DataFrame:
    """The runs of several roots, each name once."""
    out = runs(listings[0])
    for x in listings[1:]:
        out = out.union(runs(x))
    return out.distinct()


def import_files(there: DataFrame, incoming: DataFrame, key: str = "name") -> DataFrame:
    """The incoming rows whose key is not there yet: existing files win."""
    return incoming.join(there.select(key).distinct(), key, "left_anti")


def merge_prepared(inputs: list[DataFrame], tag: str, key: str) -> DataFrame:
    """Prepared inputs in order of preference: for each tag the first input that has any of it, files of one name once."""
    from brindle.operators.normalize import keep_first

    out = None
    for k, df in enumerate(inputs):
        df = df.withColumn("input_rank", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return keep_first(out, [tag, key], ["input_rank"])


def run_settings(names: DataFrame, name: str = "name") -> DataFrame:
    """stage, model, crop of a run's name 'stage2_model_crop_...'."""
    part = F.split(name, "_")
    return names.withColumn("stage", F.nullif(F.regexp_extract(name, "^stage([0-9]+)_", 1), F.lit("")).cast("int")).withColumn("model", F.try_element_at(part, F.lit(2))).withColumn("crop", F.get(F.filter(part, lambda t: t.rlike(r"^(full|m[0-9.]+|f[0-9]+)$")), F.lit(0)))


def dataset_card(sections: dict[str, DataFrame], title: str, rows: int = 50) -> str:
    """Markdown of small frames, `rows` rows each."""
    out = io.StringIO()
    out.write(f"# {title}\n")
    for name, df in sections.items():
        out.write(f"\n## {name}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n")
        for r in df.limit(rows).collect():
            out.write(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n")
    return out.getvalue()
