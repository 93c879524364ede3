"""Archives are listed and read in tasks; predicates on names reach the source."""

import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.sources import zip_listing as Z
from brindle.sources import zipped


@pytest.fixture
def archives(tmp_path):
    for a in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as z:
            z.writestr("d/", b"")
            for k in range(7):
                z.writestr(f"d/{k}.json", f'"{a}{k}"')
            z.writestr("e/x.png", b"png")
    return f"{tmp_path}/one.zip", f"file://{tmp_path}/two.zip"


def scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("BatchScan") :]


def test_predicates_are_pushed(spark, archives):
    one, two = archives
    both = Z.listed(spark, f"{one},{two}")
    assert both.count() == 16 and both.rdd.getNumPartitions() == 2
    for how, n in ((F.col("zip_member").startswith("e/"), 2), (F.col("zip_member").endswith("3.json"), 2), (F.col("zip_member").contains("/4"), 2), (F.col("zip_member").isin("d/1.json", "d/2.json", "no"), 4), (F.col("zip_path") == one, 8)):
        got = both.filter(how)
        assert got.count() == n and "Filter" not in got._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0], how
    assert both.filter("zip_path = 'none'").count() == 0
    # what the source can't take stays with Spark
    assert both.filter("length(zip_member) > 7 and zip_member like 'd/%'").count() == 14
    spark.conf.set(Z.PUSHDOWN, "false")
    try:
        off = Z.listed(spark, f"{one},{two}").filter("zip_member like 'e/%'")
        assert off.count() == 2
    finally:
        spark.conf.set(Z.PUSHDOWN, "true")


def test_contents_by_blocks(spark, archives):
    one, two = archives
    read = Z.with_contents(Z.listed(spark, f"{one},{two}", (".json",)), block=3)
    assert read.rdd.getNumPartitions() == 6
    got = {(r["zip_path"], r["zip_member"]): (r["length"], bytes(r["content"])) for r in read.collect()}
    assert got == {(p, f"d/{k}.json"): (6, f'"{a}{k}"'.encode()) for a, p in (("one", one), ("two", two)) for k in range(7)}
    some = zipped.members(spark, f"{one},{two}", (".json", ".png"), where="zip_member like '%.png' and length < 10")
    assert [(r["zip_path"], bytes(r["content"])) for r in some.orderBy("zip_path").collect()] == [(p, b"png") for p in sorted((one, two))]
    assert zipped.members(spark, one, (".none",)).count() == 0 and zipped.members(spark, "", (".json",)).count() == 0


def test_the_driver_opens_no_archive(spark, tmp_path):
    """A plan over an archive that isn't there is made; only its task fails."""
    lost = Z.listed(spark, str(tmp_path / "lost.zip"))
    lost._jdf.queryExecution().optimizedPlan()
    with pytest.raises(Exception, match="lost.zip"):
        lost.count()
