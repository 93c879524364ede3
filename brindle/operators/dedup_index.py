"""Near-duplicate clusters of a corpus that grows by chunks: a stored index of signature bands, and a stored forest.

The bands of all signatures so far are a table bucketed by (band, bits). A chunk's bands are dealt out the same way and meet
it bucket by bucket, so what is stored isn't shuffled, and neither old signatures nor old pairs are compared again. New links
go into the forest, of which only what they touch is rewritten. The clusters are those of all rows at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.dedup import BANDS, bands, parted
from brindle.operators.dedup import links as near_links
from brindle.operators.forest import Forest
from brindle.session import Staged

WORDS = [f"b{k}" for k in range(BANDS)]


class SignatureIndex:
    """name: of the bucketed table in the session's catalogue; path: the folder of all that is stored, which all executors reach.

    A session that doesn't know the table yet opens what is stored at the path. An add that failed is repeated with the same
    chunk. Keys are of one type (`kind`) and may come again; a key's signature is that of its first chunk.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, kind: str = "long", buckets: int = 64, max_hamming: int = 6, crowded: int = 2000):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.max_hamming, self.crowded = max_hamming, crowded
        self.forest = Forest(spark, f"{self.path}/forest", kind)
        words = ", ".join(f"{w} bigint" for w in WORDS)
        self.member = f"key {kind}, id {kind}"
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} (band int, bits bigint, id {kind}, {words}) USING parquet CLUSTERED BY (band, bits) INTO {buckets} BUCKETS LOCATION '{self.path}/bands'")
        self.buckets = buckets

    def _members(self) -> DataFrame:
        g = self.forest.generation()
        return self.spark.read.schema(self.member).parquet(*(f"{self.path}/members/{k}" for k in range(1, g + 1))) if g else self.spark.createDataFrame([], self.member)

    def add(self, sigs: DataFrame, key: str = "doc_id") -> None:
        """A chunk's signatures: key, b0 to b3, nulls for none."""
        g = self.forest.generation()
        staged = Staged(self.spark)
        chunk = staged.write(sigs.select(F.col(key).alias("key"), *WORDS).join(self._members().select("key"), "key", "left_anti"))
        known = chunk.filter("b0 is not null")
        stored = self.spark.table(self.name)
        reps = known.groupBy(*WORDS).agg(F.min("key").alias("k"))
        # an equal signature is in the bucket of its first band
        same = stored.filter("band = 0").select("bits", "id", *WORDS)
        at = reps.withColumn("bits", F.col("b0")).join(same, ["bits", *WORDS], "left").groupBy(*WORDS, "k").agg(F.min("id").alias("old"))
        at = staged.write(at.select(*WORDS, "k", "old", F.coalesce("old", "k").alias("id")))
        new = at.filter("old is null").select(*WORDS, "id")
        mine = staged.write(bands(new))
        asked = mine.select("band", "bits").distinct()
        both = staged.write(stored.join(asked, ["band", "bits"]).select("id", F.struct(*WORDS).alias("s"), "band", "bits", F.lit(False).alias("fresh")).unionByName(mine.withColumn("fresh", F.lit(True))))
        sized = both.groupBy("band", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        links = near_links(parted(both, sized, self.max_hamming, self.crowded), self.max_hamming)
        # every representative is a vertex, and the smallest key of a chunk may name its cluster
        links = staged.write(links.unionByName(at.select(F.col("id").alias("u"), F.col("k").alias("v"))))
        mine.select("band", "bits", "id", *(F.col(f"s.{w}").alias(w) for w in WORDS)).repartition(self.buckets, "band", "bits").write.bucketBy(self.buckets, "band", "bits").format("parquet").option("path", f"{self.path}/bands").mode("append").saveAsTable(self.name)
        chunk.join(at.select(*WORDS, "id"), WORDS, "left").select("key", "id").write.mode("overwrite").parquet(f"{self.path}/members/{g + 1}")
        self.forest.add(links)

    def clusters(self, key: str = "doc_id") -> DataFrame:
        """key, dup_cluster: the smallest key of the component; hashed: whether there is a signature. Without one a row is alone."""
        comp = self.forest.components().withColumnRenamed("v", "id")
        return self._members().join(comp, "id", "left").select(F.col("key").alias(key), F.coalesce("component", "key").alias("dup_cluster"), F.col("id").isNotNull().alias("hashed"))
