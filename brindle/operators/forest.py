"""Components that are kept between runs and grow by edges: a stored forest, of which a batch rewrites what it touches only.

A vertex is written once, with the root that it had then. Roots that later edges join are listed apart as moves, from the old
root to the one that now stands; that list is rewritten by a batch, the vertices aren't. A generation counts once its moves are
written, the last step, so a batch that failed leaves nothing that is read, and is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.graph import connected_components
from brindle.session import Staged


class Forest:
    """A folder that all executors reach. keep_names: a component keeps the name of its oldest part, the smallest of equal age;
    otherwise its name is its smallest vertex, whatever comes."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", keep_names: bool = False):
        self.spark, self.path, self.keep_names = spark, path.rstrip("/"), keep_names
        self.vertex = f"v {kind}, root {kind}, born int"
        self.move = f"root {kind}, now {kind}"

    def generation(self) -> int:
        """The last whole one; 0 for none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/moves")
        fs = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(p):
            return 0
        done = [f.getPath() for f in fs.listStatus(p)]
        return max((int(d.getName()) for d in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))), default=0)

    def _stored(self, g: int) -> tuple[DataFrame, DataFrame]:
        if not g:
            return self.spark.createDataFrame([], self.vertex), self.spark.createDataFrame([], self.move)
        paths = [f"{self.path}/vertices/{k}" for k in range(1, g + 1)]
        return self.spark.read.schema(self.vertex).parquet(*paths), self.spark.read.schema(self.move).parquet(f"{self.path}/moves/{g}")

    def components(self) -> DataFrame:
        """v, component: every vertex that an edge has named so far."""
        vertices, moves = self._stored(self.generation())
        return vertices.join(moves, "root", "left").select("v", F.coalesce("now", "root").alias("component"))

    def add(self, edges: DataFrame) -> None:
        """edges(u, v) join what they touch. A loop makes its vertex known; nulls are ignored."""
        g = self.generation()
        staged = Staged(self.spark)
        vertices, moves = self._stored(g)
        e = staged.write(edges.select("u", "v").filter("u is not null and v is not null").distinct())
        named = e.select(F.col("u").alias("v")).union(e.select("v")).distinct()
        at = named.join(vertices, "v", "left").join(moves, "root", "left")
        at = staged.write(at.select("v", F.coalesce("now", "root", "v").alias("top"), F.col("root").isNull().alias("new"), "born"))
        tops = lambda c: at.select(F.col("v").alias(c), F.col("top").alias(f"{c}_top"))
        joined = e.join(tops("u"), "u").join(tops("v"), "v").select(F.col("u_top").alias("u"), F.col("v_top").alias("v")).filter("u <> v")
        comp = staged.write(connected_components(joined, staged))
        if self.keep_names:
            # a root's age is that of the vertex that bears its name
            aged = comp.join(vertices.select("v", "born"), "v", "left").withColumn("born", F.coalesce("born", F.lit(g + 1)))
            name = aged.groupBy("component").agg(F.min(F.struct("born", "v"))["v"].alias("name"))
            comp = staged.write(comp.join(name, "component").select("v", F.col("name").alias("component")))
        where = comp.select(F.col("v").alias("top"), "component")
        fresh = at.filter("new").join(where, "top", "left").select("v", F.coalesce("component", "top").alias("root"), F.lit(g + 1).alias("born"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/vertices/{g + 1}")
        # old moves go on to where their ends have gone; roots of old components that were joined move now
        on = moves.join(comp.select(F.col("v").alias("now"), F.col("component").alias("then")), "now", "left").select("root", F.coalesce("then", "now").alias("now"))
        old = at.filter("not new").select("top").distinct().join(where, "top").filter("top <> component")
        old = old.join(on.select(F.col("root").alias("top")), "top", "left_anti").select(F.col("top").alias("root"), F.col("component").alias("now"))
        on.unionByName(old).write.mode("overwrite").parquet(f"{self.path}/moves/{g + 1}")
