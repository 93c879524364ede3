"""Crops as PNG files, written under a commit: only what a committed task wrote ever stands under a crop's name.

A task writes into a folder of its own attempt, with a table of what it did. The commit, on the driver, keeps the committed
attempts' folders and deletes those of failed and speculative ones; an abort deletes all. A second job then moves the crops
to their names, each move being harmless if it is made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from brindle.functions import png
from brindle.session import Staged

#: Where attempts stand below the root; names with a dot are no crops to any listing.
ATTEMPTS = ".attempts"
DONE = pa.schema([("image_path", pa.string()), ("crop_rel", pa.string()), ("held", pa.string()), ("error", pa.string())])


def file_system(root: str):
    """The file system of a folder that pyarrow knows, and the folder's path there."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return files, base.rstrip("/")


def _there(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type == fs.FileType.File


def _remove(files, folder: str) -> None:
    from pyarrow import fs

    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)


def cut(image: dict | None, window: dict | None) -> tuple[bytes | None, str | None]:
    """The window of an image (BGR) as PNG, or what is wrong."""
    if not image or not image["height"] or image["height"] <= 0:
        return None, "no image"
    if not window:
        return None, "no window"
    a = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    part = a[max(0, window["y1"]) : window["y2"], max(0, window["x1"]) : window["x2"]]
    part = part[:, :, 2::-1] if part.shape[2] >= 3 else part[:, :, :1]
    return (png.encode(np.ascontiguousarray(part)), None) if part.size else (None, "empty window")


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class CropWriter(DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyarrow import parquet

        files, base = file_system(self.root)
        name = uuid.uuid4().hex
        folder = f"{base}/{ATTEMPTS}/{self.job}/{name}"
        files.create_dir(folder)
        n = 0
        try:
            with parquet.ParquetWriter(f"{folder}/done.parquet", DONE, filesystem=files) as done:
                for b in iterator:
                    held, errors = [], []
                    for rel, image, window in zip(*(b.column(c).to_pylist() for c in ("crop_rel", "image", "window")), strict=True):
                        data, why = (None, None) if _there(files, f"{base}/{rel}") else cut(image, window)
                        errors.append(why)
                        held.append(None if data is None else f"{folder}/{n}.png")
                        if data is not None:
                            with files.open_output_stream(held[-1]) as out:
                                out.write(data)
                            n += 1
                    done.write_batch(pa.record_batch([b.column("image_path"), b.column("crop_rel"), pa.array(held, pa.string()), pa.array(errors, pa.string())], schema=DONE))
        except BaseException:
            _remove(files, folder)
            raise
        return Attempt(name)

    def commit(self, messages: list[Attempt | None]) -> None:
        """One look at a name and at most one deletion an attempt; no crop is touched."""
        from pyarrow import fs

        files, base = file_system(self.root)
        kept = {m.folder for m in messages if m}
        for found in files.get_file_info(fs.FileSelector(f"{base}/{ATTEMPTS}/{self.job}", allow_not_found=True)):
            if found.base_name not in kept:
                _remove(files, found.path)

    def abort(self, messages: list[Attempt | None]) -> None:
        files, base = file_system(self.root)
        _remove(files, f"{base}/{ATTEMPTS}/{self.job}")


class CropSink(DataSource):
    """format('crop_files'): writes rows(image_path, crop_rel, image, window). Options: root, job (a name of its own)."""

    @classmethod
    def name(cls) -> str:
        return "crop_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CropWriter(self.options["root"], self.options["job"])


def _moved(root: str, job: str):
    """Batches of committed attempts' folders to image_path, crop_rel, crop_path, error, with the crops under their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        files, base = file_system(root)
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            for b in parquet.ParquetFile(f"{base}/{ATTEMPTS}/{job}/{folder}/done.parquet", filesystem=files).iter_batches(5000):
                paths = []
                for rel, held, why in zip(*(b.column(c).to_pylist() for c in ("crop_rel", "held", "error")), strict=True):
                    target = f"{base}/{rel}"
                    if held:
                        files.create_dir(target.rpartition("/")[0])
                        try:
                            files.move(held, target)
                        except OSError:
                            # moved by a task that was lost, or by its twin
                            if not _there(files, target):
                                raise
                    paths.append(None if why else target)
                yield pa.record_batch([b.column("image_path"), b.column("crop_rel"), pa.array(paths, pa.string()), b.column("error")], ["image_path", "crop_rel", "crop_path", "error"])

    return run


def save_crops(rows: DataFrame, root: str, staged: Staged) -> DataFrame:
    """rows(image_path, crop_rel, image, window) to a written table image_path, crop_rel, crop_path, error: a PNG file each, where there is none yet.

    root is a folder of any file system that pyarrow knows, shared by all workers. crop_rel names one row each. Runs two jobs;
    if the first fails, nothing of it is left, and if the second does, whole crops only.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(CropSink)
    rows.select("image_path", "crop_rel", "image", "window").write.format("crop_files").option("root", root).option("job", job).mode("append").save()
    from pyarrow import fs

    files, base = file_system(root)
    attempts = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(f"{base}/{ATTEMPTS}/{job}", allow_not_found=True)))  # a task each
    todo = spark.createDataFrame([(a,) for a in attempts], "folder string").repartition(max(1, len(attempts)), "folder")
    done = staged.write(todo.mapInArrow(_moved(root, job), "image_path string, crop_rel string, crop_path string, error string"))
    _remove(files, f"{base}/{ATTEMPTS}/{job}")
    return done
