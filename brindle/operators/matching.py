"""The image of a record's name whose path shares most components with the record's, however often the name comes.

A name with few images is compared with all of them. For a frequent one, an index by rarity: components that always come
together within a name are one item, items that all images of the name have are a constant, and sets of items grow from the
rarest on. A set that few images have gives its images as candidates; of a set that many have, only its first path is kept, as
no more can be gained from it but by a larger set. So each record meets a bounded number of images a set, no pair of a
name's records and images is made, and the best one is still found: what a record and an image share either begins with a set
of few images or is itself a set whose first path is known. A set that can't reach what its record has already is not grown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.session import Staged

#: Images of a set up to which they are candidates.
FEW = 8


def components(path: Column | str) -> Column:
    return F.array_distinct(F.split(path, r"[/\\]"))


def _items(has: DataFrame, images: DataFrame, group: list[str]) -> DataFrame:
    """group, c, item: components of images by item; items sort by rarity. Those that all images of a group have: null."""
    total = images.groupBy(*group).agg(F.count("*").alias("n"))
    each = has.groupBy(*group, "c").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("p")).alias("who"))
    # equal sets of images, told by their number and a hash
    first = each.groupBy(*group, "df", "who").agg(F.min("c").alias("item"))
    named = each.join(first, [*group, "df", "who"]).join(total, group)
    return named.select(*group, "c", F.when(F.col("df") < F.col("n"), F.concat(F.lpad(F.col("df").cast("string"), 19, "0"), F.lit("/"), F.col("item"))).alias("item"))


def candidates(records: DataFrame, images: DataFrame, group: list[str], few: int, staged: Staged) -> DataFrame:
    """records(r, path, group), images(p: a path, group), both distinct: r, o, p, images of its group and how many components they
    share with the record at least; the one that shares most is among them with all it shares. Records of groups without
    images have none.

    r names a record. Group columns must not be null. Candidates are at most `few` for each set of items that a record has.
    """
    sizes = images.groupBy(*group).agg(F.count("*").alias("n"), F.min("p").alias("first"))
    sized = staged.write(records.join(sizes, group))
    overlap = F.size(F.array_intersect(components("path"), components("p"))).cast("long")
    small = sized.filter(F.col("n") <= few).join(images, group).select("r", overlap.alias("o"), "p")
    large = sized.filter(F.col("n") > few)
    busy, n = staged.counted(images.join(large.select(*group).distinct(), group))
    if not n:
        return small
    has = staged.write(busy.select(*group, "p", F.explode(components("p")).alias("c")))
    items = staged.write(_items(has, busy, group))
    own = large.select("r", *group, "first", F.explode(components("path")).alias("c")).join(items, [*group, "c"])
    # what every image of the group has of the record, and the items that tell them apart with their weights
    base = staged.write(large.select("r", *group, "path", "first").join(own.groupBy("r").agg(F.count_if(F.col("item").isNull()).alias("base")), "r", "left").withColumn("base", F.coalesce("base", F.lit(0).cast("long"))))
    mine = staged.write(own.filter("item is not null").groupBy("r", *group, "item").agg(F.count("*").alias("w")))
    asked = mine.select(*group, "item").distinct()
    theirs = staged.write(has.join(items.filter("item is not null"), [*group, "c"]).select(*group, "p", "item").distinct().join(asked, [*group, "item"]))
    found = [base.select("r", F.col("base").alias("o"), F.col("first").alias("p"))]

    left = mine.select("r", *group, F.array("item").alias("s"), "w")
    right = theirs.select(*group, "p", F.array("item").alias("s"))
    common: tuple[DataFrame, DataFrame] | None = None
    while True:
        left, right = staged.write(left), staged.write(right)
        df = right.groupBy(*group, "s").agg(F.count("*").alias("n"), F.min("p").alias("first"))
        met = staged.write(left.join(df, [*group, "s"]))
        near = met.filter(F.col("n") <= few).join(right, [*group, "s"]).select("r", "p").distinct()
        found.append(staged.write(near.join(base.select("r", "path"), "r").select("r", overlap.alias("o"), "p")))
        often = met.filter(F.col("n") > few)
        found.append(often.join(base.select("r", "base"), "r").select("r", (F.col("base") + F.col("w")).alias("o"), F.col("first").alias("p")))
        if common is None:
            # an item of few images begins no larger set, and none is needed in one
            wide = often.select(*group, F.col("s")[0].alias("item")).distinct()
            common = staged.write(mine.join(wide, [*group, "item"])), staged.write(theirs.join(wide, [*group, "item"]))
        reached = _union(found).groupBy("r").agg(F.max("o").alias("most"))
        last = F.element_at("s", -1)
        more = often.select("r", *group, "s", "w").join(common[0].withColumnRenamed("w", "v"), ["r", *group]).filter(F.col("item") > last)
        bound = more.groupBy("r", *group, "s", "w").agg(F.sum("v").alias("v"), F.collect_list(F.struct("item", F.col("v").alias("iv"))).alias("next"))
        open_ = bound.join(reached, "r").join(base.select("r", "base"), "r").filter(F.col("base") + F.col("w") + F.col("v") >= F.col("most"))
        grown, n = staged.counted(open_.select("r", *group, "s", "w", F.explode("next").alias("x")).select("r", *group, F.concat("s", F.array("x.item")).alias("s"), (F.col("w") + F.col("x.iv")).alias("w")))
        if not n:
            break
        wanted = grown.select(*group, "s").distinct()
        begun = right.join(wanted.select(*group, F.slice("s", 1, F.size("s") - 1).alias("s")).distinct(), [*group, "s"])
        begun = begun.join(common[1], [*group, "p"]).filter(F.col("item") > last).select(*group, "p", F.concat("s", F.array("item")).alias("s"))
        left, right = grown, begun.join(wanted, [*group, "s"], "left_semi")
    return _union([small, *found])


def best_overlap(records: DataFrame, images: DataFrame, group: list[str], few: int = FEW, staged: Staged | None = None) -> DataFrame:
    """r, p of `candidates`: the image that shares most, equal ones the first."""
    staged = staged or Staged(records.sparkSession)
    best = candidates(records, images, group, few, staged).groupBy("r").agg(F.min(F.struct((-F.col("o")).alias("o"), "p")).alias("b"))
    return staged.write(best.select("r", F.col("b.p").alias("p")))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def match_images(records: DataFrame, images: DataFrame, name: str = "image_name", record_path: str = "json_path", image_path: str = "image_path", within: list[str] | None = None, few: int = FEW) -> DataFrame:
    """records with the image of their name, else of their stem, that shares most path components; unmatched ones go.

    Equal images: the first path. within: columns of both sides that must be equal; null ones match nothing. Equal records are
    compared once, whatever their number. A null name or path matches nothing.
    """
    within = within or []
    staged = Staged(records.sparkSession)
    pics = images.filter(F.col(image_path).isNotNull()).select(F.col(image_path).alias("p"), *within)
    keys = pics.select("p", *within, F.explode(F.array(S.file_name("p"), S.stem("p"))).alias("k")).distinct()
    # one row a different record, with a number that is fixed by the writing
    sought = staged.write(records.select(F.col(name).alias("name"), F.col(record_path).alias("path"), *within).filter("name is not null and path is not null").distinct().withColumn("r", F.monotonically_increasing_id()))
    both = sought.select("r", "path", *within, F.explode(F.array(F.struct(F.lit(0).alias("want"), F.col("name").alias("k")), F.struct(F.lit(1).alias("want"), S.stem("name").alias("k")))).alias("w")).select("r", "path", *within, "w.*")
    there = both.join(keys.select(*within, "k").distinct(), [*within, "k"])
    # the name goes before the stem, so that a record asks one group only
    first = there.groupBy("r").agg(F.min(F.struct("want", "k")).alias("f")).select("r", F.col("f.k").alias("k"))
    one = sought.select("r", "path", *within).join(first, "r")
    best = best_overlap(one, keys, ["k", *within], few)
    named = sought.join(best, "r").select(F.col("name").alias("_name"), F.col("path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in within), F.col("p").alias(image_path))
    same = (F.col(name) == F.col("_name")) & (F.col(record_path) == F.col("_path"))
    for c in within:
        same &= F.col(c) == F.col(f"_{c}")
    return records.join(named, same).drop("_name", "_path", *(f"_{c}" for c in within))
