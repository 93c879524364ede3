"""Files in and out, archives, streams."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import messages as MS
from brindle.functions import png as PNG
from brindle.sources import crops
from brindle.sources import files as S
from brindle.sources import zipped
from brindle.streaming import ingest


def png(w, h, value):
    """A grey-free RGB PNG of one colour."""

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes((value, value, value)) * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_listing_and_images(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.png").write_bytes(png(20, 10, 7))
    (tmp_path / "a/y.json").write_text('{"a": 1}')
    got = S.listing(spark, str(tmp_path))
    assert got.count() == 2 and S.images(got).count() == 1
    im = S.image_pixels(spark, str(tmp_path / "a/b")).select("image.width", "image.height", "image.data", "image").collect()[0]
    assert (im["width"], im["height"], len(im["data"])) == (20, 10, 600)
    from brindle.functions import geometry as G
    from brindle.functions import pixels

    df = S.image_pixels(spark, str(tmp_path / "a/b"))
    r = df.select(pixels.phash_udf()("image").alias("h"), pixels.sharpness_udf()("image").alias("s"), pixels.crop(F.col("image"), G.box(*map(F.lit, (2, 3, 7, 9)), "int")).alias("c")).collect()[0]
    assert len(r["h"]) == 4 and r["s"] == 0 and (r["c"]["width"], r["c"]["height"]) == (5, 6)
    assert S.json_labels(spark, str(tmp_path)).collect()[0]["json"] == '{"a": 1}'


def test_zip_members(spark, tmp_path):
    p = tmp_path / "z.zip"
    with zipfile.ZipFile(p, "w") as z:
        for k in range(5):
            z.writestr(f"d/{k}.json", f'{{"k": {k}}}')
        z.writestr("d/x.jpg", b"jpg")
    spark.dataSource.register(S.ZipSource)
    df = spark.read.format("zip_members").option("suffixes", ".json").option("members", "2").load(str(p))
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["zip_member"], r["length"]) for r in df.collect()) == [(f"d/{k}.json", 8) for k in range(5)]


def test_manifest_forms(spark, tmp_path):
    from brindle.functions import geometry as G

    box = G.box(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))
    df = spark.range(2).select("id", F.when(F.col("id") == 0, box).alias("bbox"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).alias("polygon"))
    for text in (False, True):
        path = str(tmp_path / f"m{text}")
        S.save_manifest(df, path, as_text=text)
        back = {r["id"]: r for r in S.manifest(spark, path).collect()}
        assert tuple(back[0]["bbox"]) == (1.0, 2.0, 3.0, 4.0) and back[1]["bbox"] is None and tuple(back[0]["polygon"][0]) == (1.0, 2.0)
    assert "| id |" in S.dataset_card({"rows": df.select("id")}, "card")


def test_listing_text(spark):
    text = ["root", "├─ 반려견 A1", "│  ├─ one.zip | 1.2 GB | 51937", "│  └─ two.zip | 300 MB | 51938", "├─ 반려묘", "│  └─ three.zip | 5 KB | 60", "total | 3 | files"]
    df = spark.createDataFrame(list(enumerate(text)), "line_no int, value string")
    got = [(r["folder"], r["name"], r["size"], r["filekey"]) for r in S.parse_listing(df).orderBy("line_no").collect()]
    assert got == [("반려견 A1", "one.zip", "1.2 GB", "51937"), ("반려견 A1", "two.zip", "300 MB", "51938"), ("반려묘", "three.zip", "5 KB", "60")]


def test_prepared_inputs_first_wins(spark):
    a = spark.createDataFrame([("m1.5", "1.jpg", "a")], "tag string, name string, src string")
    b = spark.createDataFrame([("m1.5", "1.jpg", "b"), ("full", "2.jpg", "b")], "tag string, name string, src string")
    assert sorted((r["tag"], r["src"]) for r in S.merge_prepared([a, b], "tag", "name").collect()) == [("full", "b"), ("m1.5", "a")]
    r = S.run_settings(spark.createDataFrame([("stage2_resnet50_m2.5_x",)], "name string")).collect()[0]
    assert (r["stage"], r["model"], r["crop"]) == (2, "resnet50", "m2.5")


def test_cache_by_fingerprint(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.cached_by_fingerprint(compute, str(tmp_path), "abc", spark).count() == 3
    assert len(calls) == 1


def test_stream_appends_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    spark.range(5).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(str(src))
    spark.range(3, 8).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(str(src))
    for n in range(2):  # the second run has forgotten its checkpoint
        stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(src))
        q = ingest.append_manifest(stream, out, "k", str(tmp_path / f"ck{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_stream_windows(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 5.0)], "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = ingest.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", "kind", "value")
    q = s.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["kind"], r["n"], r["total"]) for r in spark.table("win").collect()) == [("a", 2, 3.0), ("b", 1, 5.0)]


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(4)
    for c in (1, 3):
        a = rng.integers(0, 256, (9, 7, c), np.uint8)
        assert (PNG.decode(PNG.encode(a)) == a).all()
    # every filter, by its definition
    a = rng.integers(0, 256, (10, 6, 3), np.uint8).reshape(10, 18).astype(int)
    lines = []
    for y in range(10):
        left, up = np.concatenate(([0] * 3, a[y, :-3])), a[y - 1] if y else a[y] * 0
        corner = np.concatenate(([0] * 3, up[:-3]))
        p = left + up - corner
        near = [min((abs(q - x), k, x) for k, x in enumerate((l, u, d)))[2] for q, l, u, d in zip(p, left, up, corner, strict=True)]
        guess = [a[y] * 0, left, up, (left + up) // 2, np.array(near)][y % 5]
        lines.append(bytes([y % 5]) + ((a[y] - guess) % 256).astype(np.uint8).tobytes())
    whole = PNG.encode(np.zeros((10, 6, 3), np.uint8))
    body = zlib.compress(b"".join(lines))
    at = whole.index(b"IDAT")
    n = struct.unpack(">I", whole[at - 4 : at])[0]
    data = whole[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0" * 4 + whole[at + 8 + n :]
    assert (PNG.decode(data) == a.reshape(10, 6, 3)).all()
    assert PNG.decode(b"no picture") is None and PNG.decode(data[:60]) is None


def record(name, label, box=None, normal=False):
    place = {"box": {"location": [dict(zip(("x", "y", "width", "height"), box, strict=True))]}} if box else {}
    return json.dumps({"metaData": {"Raw data ID": name, "lesions": label, "species": "D", "breed": "b", "resolution": "20X10"}, "labelingInfo": [place]})


def test_manifest_and_crops_from_a_zip(spark, tmp_path):
    p = tmp_path / "VL01.zip"
    pictures = {"반려견/일반카메라/유증상/src/A2/one.png": png(20, 10, 7), "반려견/일반카메라/유증상/other/one.png": png(20, 10, 8), "반려견/일반카메라/무증상/two.png": png(30, 30, 9), "반려견/더모스코프/유증상/three.png": png(20, 10, 1), "반려견/일반카메라/유증상/bad.png": b"\x89PNG broken"}
    with zipfile.ZipFile(p, "w") as z:
        for n, data in pictures.items():
            z.writestr(n, data)
        z.writestr("반려견/일반카메라/유증상/lab/A2/one.json", record("one.png", "A2", (1, 2, 6, 4)))
        z.writestr("반려견/일반카메라/무증상/two.json", record("two.png", "A7"))
        z.writestr("반려견/더모스코프/유증상/three.json", record("three.png", "A3"))
        z.writestr("반려견/일반카메라/유증상/bad.json", json.dumps({"image": {"file": "bad.png", "width": 20, "height": 10}, "disease": "A4", "pet_id": 5, "bbox": [[1, 1], [3, 5]]}))
        z.writestr("반려견/일반카메라/유증상/lost.json", record("lost.png", "A1"))
        z.writestr("반려견/일반카메라/유증상/broken.json", "{")
    rows = {r["image_name"]: r for r in zipped.manifest_from_zip(spark, str(p), dogs_only=False, normal_camera_only=False).collect()}
    assert set(rows) == {"one.png", "two.png", "three.png", "bad.png"}
    one, bad = rows["one.png"], rows["bad.png"]
    assert one["zip_member"] == "반려견/일반카메라/유증상/src/A2/one.png" and one["camera"] == "일반카메라" and tuple(one["bbox"]) == (1.0, 2.0, 7.0, 6.0)
    assert (bad["label"], bad["animal_id"], bad["img_w"], tuple(bad["bbox"]), bad["area_ratio"], bad["is_normal"]) == ("A4", "5", 20, (1.0, 1.0, 3.0, 5.0), 8 / 200, False)
    assert rows["two.png"]["is_normal"] and rows["two.png"]["label"] == "A7"
    scoped = zipped.manifest_from_zip(spark, str(p))
    assert {r["image_name"] for r in scoped.select("image_name").collect()} == {"one.png", "two.png"}  # the fallback knows no species
    some = zipped.members(spark, str(p), (".png",), contents=False, include=[["무증상", "유증상"]], exclude=["더모"])
    assert [(r["zip_member"], r["content"]) for r in some.collect()] == [("반려견/일반카메라/무증상/two.png", None)]
    with pytest.raises(ValueError):
        zipped.manifest_from_zip(spark, str(p), include=[["무증상", "유증상"]], exclude=["two"])
    # crops: what can't be decoded fails and goes
    pixels = zipped.zip_pixels(spark, str(p))
    manifest = zipped.manifest_from_zip(spark, str(p), dogs_only=False, normal_camera_only=False).cache()
    root = str(tmp_path / "crops")
    kept, failed = crops.crop_run(manifest, pixels, root, "f4")
    got = {r["image_name"]: r for r in kept.collect()}
    assert set(got) == {"one.png", "two.png", "three.png"} and [(r["image_path"].split("/")[-1], r["error"]) for r in failed.collect()] == [("bad.png", "no image")]
    cut = PNG.decode(open(got["one.png"]["crop_path"], "rb").read())
    assert cut.shape == (4, 4, 3) and (cut == 7).all() and got["one.png"]["crop_path"].endswith(got["one.png"]["crop_rel"])
    # again: what is there stays
    open(got["one.png"]["crop_path"], "wb").write(b"mine")
    crops.crop_run(manifest, pixels, root, "f4")
    assert open(got["one.png"]["crop_path"], "rb").read() == b"mine"
    # another tag
    listing = S.listing(spark, root)
    with pytest.raises(FileNotFoundError):
        crops.switch_tag(manifest, listing, root, "full")
    assert crops.switch_tag(manifest, listing, root, "full", allow_missing=True).count() == 0
    assert crops.switch_tag(kept, listing, root, "f4").count() == 3


def test_reports_history_and_chunks(spark, tmp_path):
    S.save_report(spark.sql("SELECT 'r' AS root, 3L AS n_images, map('A1', 2L) AS class_counts, 'x' AS unheard_of"), str(tmp_path / "rep"))
    r = S.load_report(spark, str(tmp_path / "rep")).collect()[0]
    assert (r["root"], r["n_images"], r["class_counts"], r["size_gb"]) == ("r", 3, {"A1": 2}, None) and "unheard_of" not in r.asDict()
    for k in range(3):
        S.append_history(spark.createDataFrame([(k, k / 2)], "epoch int, loss double").repartition(2), str(tmp_path / "hist"))
    assert sorted(map(tuple, S.history(spark, str(tmp_path / "hist"), "epoch int, loss double").collect())) == [(0, 0.0), (1, 0.5), (2, 1.0)]
    spark.range(2).write.parquet(str(tmp_path / "c/one.parquet"))
    spark.range(3).withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "c/two.parquet"))
    assert S.chunks(spark, str(tmp_path / "c/*.parquet")).filter("more is null").count() == 2


def test_prepared_inputs_are_found(spark):
    paths = ["/in/a/crops/full/x.txt", "/in/a/crops/m1.5/1.jpg", "/in/b/crops/full/1.jpg", "/in/b/crops/full/2.jpg", "/in/b/crops/m1.5/1.jpg", "/in/a/crops_f320.zip", "/in/b/crops_full.zip", "/out/crops/f9/1.jpg"]
    got = S.prepared_tags(spark.createDataFrame([(p,) for p in paths], "path string"), ["/in/a", "/in/b"])
    assert sorted(map(tuple, got.collect())) == [("f320", "/in/a", None), ("full", "/in/b", 2), ("m1.5", "/in/a", 1)]
    listed = spark.createDataFrame([("/d/download_20240101_120000.tar",), ("/d/x.txt",)], "path string")
    assert not S.has_usable_data(listed) and S.has_usable_data(listed.union(spark.createDataFrame([("/d/TL.zip",)], "path string")))
    mine = S.import_files(spark.createDataFrame([("a", 1)], "name string, v int"), spark.createDataFrame([("a", 2), ("b", 2)], "name string, v int"))
    assert [tuple(r) for r in mine.collect()] == [("b", 2)]


def test_messages(spark):
    rows = [("i1", [("A5", 0.81), ("A2", 0.125)], False, "high"), ("i2", [("A7", 0.6)], False, "low"), ("i3", [("A1", 0.3)], True, "low"), ("i4", [], False, "low"), ("i5", [("A1", 0.55)], False, "middle")]
    df = spark.createDataFrame(rows, "image string, topk array<struct<class:string,p:double>>, abstain boolean, band string")
    m = {r["image"]: r["m"] for r in df.select("image", MS.message("topk", "abstain", "band").alias("m")).collect()}
    assert m["i1"].startswith("🔎 **미란·궤양** 형태의 병변이 의심됩니다. (신뢰도 81%, 높음)\n\n⚠️ 피부 장벽 손상") and "다른 가능성: 비듬·각질·상피성잔고리 12%" in m["i1"]
    assert m["i2"].startswith("🟢") and "신뢰도가 낮습니다" in m["i2"] and m["i3"].startswith("📷") and m["i4"].startswith("📷") and "⚠️" not in m["i5"]
    assert all(x.endswith(f"_{MS.DISCLAIMER}_") for x in m.values())
    j = json.loads(df.select(MS.prediction_json("image", "topk", "abstain", "band").alias("j")).first()["j"])
    assert j["topk"][0] == {"class": "A5", "name_ko": "미란·궤양", "name_en": "Erosion / Ulcer", "prob": 0.81} and j["confidence_band"] == "높음"


def test_settings(spark, tmp_path):
    from dataclasses import dataclass

    from brindle import config

    @dataclass(frozen=True)
    class Settings:
        size: int = 224
        scale: tuple = (0.7, 1.0)
        exp_name: str = "run"

    presets = {"default": {}, "narrow": {"scale": (0.85, 1.0)}}
    s = config.overlay(Settings(size=320), presets, "narrow")
    assert s == Settings(320, (0.85, 1.0), "run_narrow") and config.overlay(s, presets, "default") == s
    config.save(spark, s, str(tmp_path / "s"))
    assert config.load(spark, Settings, str(tmp_path / "s")) == s == config.from_dict(Settings, {"size": 320, "scale": [0.85, 1.0], "exp_name": "run_narrow", "old": 1})
    with pytest.raises(KeyError):
        config.overlay(s, presets, "wide")
    runs = spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "run string, x int, y int")
    assert {r["setting"] for r in config.differences(runs, "run", ["x", "y"]).collect()} == {"y"}


def test_staged_tables_go(spark, tmp_path):
    import os

    from brindle.session import Staged, _root

    with Staged(spark) as s:
        t, n = s.counted(spark.range(5))
        folder = s.root.removeprefix("file:")
        assert n == t.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)
    s = Staged(spark)
    a, b = s.write(spark.range(2)), s.write(spark.range(3))
    s.keep(b)
    assert b.count() == 3 and os.listdir(s.root.removeprefix("file:")) == ["2"]
    s.drop(b)
    assert _root(spark) in s.root
    # a query's tables stay while its lazy result may need them, and go with clean()
    from brindle.plans import catalogue
    from brindle.session import clean, shared_dir

    n = catalogue.queries()["near_dup_clusters"](spark, "/root/testdata/sf0.001").count()
    root = shared_dir(spark).removeprefix("file:")
    assert n and any(x.startswith("brindle-") for x in os.listdir(root))
    clean(spark)
    assert not any(x.startswith("brindle-") for x in os.listdir(root))
    assert catalogue.queries()["near_dup_clusters"](spark, "/root/testdata/sf0.001").count() == n


def test_diagnosis(spark):
    from brindle.functions import json_walk
    from brindle.operators import profile

    json_walk.register(spark)
    texts = [(k, json.dumps({"pet": {"no": k % 10}, "box": [k, 2], "kind": "A1"})) for k in range(40)]
    rows = spark.createDataFrame(texts, "id int, json string")
    leaves = spark.sql("SELECT id, f.* FROM {rows}, LATERAL flatten_json(json) f", rows=rows)
    files = spark.createDataFrame([(f"/d/A1/IMG_{k % 5}_{k}.json",) for k in range(60)], "path string")
    d = profile.diagnose(files, leaves)
    keys = {r["path"]: (r["n_unique"], r["may_be_id"]) for r in d["keys"].collect()}
    assert keys == {"kind": (1, False), "pet.no": (10, True), "box[]": (40, False)}
    assert {r["path"] for r in d["geometry"].collect()} == {"box[]"} and d["shapes"].first()["value"] == "L_#_#"
    assert all(df.count() >= 0 for df in d.values())
