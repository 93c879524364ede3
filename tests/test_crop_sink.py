"""Crops under a commit: what failed or lost a race leaves nothing, and moves may be made again."""

import os

import pytest
from pyspark.sql import functions as F

from brindle.functions import png
from brindle.session import Staged
from brindle.sources import crop_sink as C

IMAGE = "named_struct('height', 4, 'width', 4, 'nChannels', 3, 'data', cast(repeat(chr(65 + id % 26), 48) as binary))"
WINDOW = "named_struct('x1', 1, 'y1', 0, 'x2', 3, 'y2', 4)"


def crops_of(spark, n, image=IMAGE, window=WINDOW):
    return spark.range(0, n, 1, 4).select(F.concat(F.lit("p"), "id").alias("image_path"), F.format_string("t/%02d/%d.png", F.col("id") % 3, "id").alias("crop_rel"), F.expr(image).alias("image"), F.expr(window).alias("window"))


def tree(root):
    return sorted(os.path.relpath(os.path.join(top, f), root) for top, _, names in os.walk(root) for f in names)


def test_crops_stand_under_their_names(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = crops_of(spark, 20).withColumn("window", F.expr(f"if(image_path = 'p7', null, if(image_path = 'p8', named_struct('x1', 9, 'y1', 0, 'x2', 12, 'y2', 4), {WINDOW}))"))
    got = {r["image_path"]: r for r in C.save_crops(rows, root, Staged(spark)).collect()}
    assert len(got) == 20 and {p: r["error"] for p, r in got.items() if r["error"]} == {"p7": "no window", "p8": "empty window"}
    assert tree(root) == sorted(r["crop_rel"] for p, r in got.items() if not r["error"])  # no attempt is left
    assert (png.decode(open(got["p2"]["crop_path"], "rb").read()) == ord("C")).all()
    # what is there stays, and counts
    open(got["p2"]["crop_path"], "wb").write(b"mine")
    again = {r["image_path"]: r["crop_path"] for r in C.save_crops(rows, root, Staged(spark)).collect()}
    assert again == {p: r["crop_path"] for p, r in got.items()} and open(got["p2"]["crop_path"], "rb").read() == b"mine"


def test_nothing_to_write(spark, tmp_path):
    assert C.save_crops(crops_of(spark, 20).limit(0), str(tmp_path / "out"), Staged(spark)).count() == 0


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    """One image of 20 has too few bytes; tasks that were through by then leave nothing either."""
    root = str(tmp_path / "out")
    bad = IMAGE.replace("48", "if(id = 17, 5, 48)")
    with pytest.raises(Exception, match="reshape"):
        C.save_crops(crops_of(spark, 20, bad), root, Staged(spark))
    assert tree(root) == []


def test_speculative_and_lost_attempts(tmp_path):
    """Two attempts of one task, one that died midway, and a move that is made twice."""
    import pyarrow as pa

    root = str(tmp_path / "out")
    w = C.CropWriter(root, "j")
    image = {"height": 2, "width": 2, "nChannels": 3, "data": bytes(12)}
    batch = pa.RecordBatch.from_pylist([{"image_path": "a", "crop_rel": "t/a.png", "image": image, "window": {"x1": 0, "y1": 0, "x2": 2, "y2": 2}}])
    won, lost = w.write(iter([batch])), w.write(iter([batch]))

    def dies():
        yield batch
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        w.write(dies())
    assert sorted(os.listdir(f"{root}/.attempts/j")) == sorted([won.folder, lost.folder])
    w.commit([won, None])
    assert os.listdir(f"{root}/.attempts/j") == [won.folder]
    folders = pa.RecordBatch.from_pylist([{"folder": won.folder}])
    first, second = (pa.Table.from_batches(C._moved(root, "j")(iter([folders]))).to_pylist() for _ in range(2))
    assert first == second == [{"image_path": "a", "crop_rel": "t/a.png", "crop_path": f"{root}/t/a.png", "error": None}]
    w.abort([won])
    assert tree(root) == ["t/a.png"]
