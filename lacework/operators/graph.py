"""A static, undirected, simple graph as DataFrames, optionally with one integer label a vertex."""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids are below this in the binary formats.
MOST_ID = 2**31


class InvalidGraph(ValueError):
    pass


def standardize(raw: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst), one row for each undirected edge, src < dst: self-loops, directions and repeats go. Rows with a null
    end are no edges."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    return raw.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; further columns go with them."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select("dst", "src", *rest))


def number_rows(df: DataFrame, order: list, name: str = "new_id", partitions: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the given order, without sorting all rows in one task: ranges are sorted apart, and each
    starts at the sum of the counts before it (one number a range on the driver). The sorted ranges are a table in the
    shared folder, so that a lost executor can't have ranges cut anew under numbers that are given already."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = _as_table(ranged, shared_folder(spark)).withColumn("_p", F.shiftright("_at", 33))
    start, starts = 0, []
    for p, c in sorted(held.groupBy("_p").count().collect()):
        starts.append((p, start))
        start += c
    starts = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))
    return held.join(starts, "_p").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_start")


def shared_folder(spark) -> str:
    """A new folder in the one that the executors share (spark.checkpoint.dir; a temporary one in a local session)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lacework-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/graph-{uuid.uuid4().hex}"


def _as_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Graph:
    """edges: (src, dst), one row for each undirected edge, src < dst. vertices: (id[, label]); the ends of the edges
    where it isn't given. Views are made once and lazily; nothing is cached unless cache() is called."""

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None):
        self.edges = edges
        self._vertices = vertices
        self._cached = False

    @staticmethod
    def from_edges(raw: DataFrame, src: str = "src", dst: str = "dst", vertices: DataFrame | None = None) -> Graph:
        return Graph(standardize(raw, src, dst), vertices)

    @staticmethod
    def from_parquet(spark, path: str, src: str = "src", dst: str = "dst", vertices: DataFrame | None = None) -> Graph:
        return Graph.from_edges(spark.read.parquet(path), src, dst, vertices)

    def cache(self) -> Graph:
        """Keeps the edges, and the views that several steps of one job read, in memory or on the executors' disks; lost
        parts are computed again."""
        self.edges = self.edges.persist()
        self._cached = True
        return self

    def kept(self, df: DataFrame) -> DataFrame:
        return df.persist() if self._cached else df

    @property
    def is_labelled(self) -> bool:
        return self._vertices is not None and "label" in self._vertices.columns

    @cached_property
    def vertices(self) -> DataFrame:
        return self._vertices if self._vertices is not None else self.und.select(F.col("src").alias("id")).distinct()

    @cached_property
    def labels(self) -> DataFrame:
        """(id, label)"""
        if not self.is_labelled:
            raise InvalidGraph("the graph has no vertex labels")
        return self.vertices.select("id", F.col("label").cast("int").alias("label"))

    @cached_property
    def und(self) -> DataFrame:
        """Both directions of every edge."""
        return symmetrize(self.edges.select("src", "dst"))

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, degree), isolated vertices of a given vertex table included."""
        found = self.und.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        if self._vertices is None:
            return found
        return self.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    @cached_property
    def adj(self) -> DataFrame:
        """(id, nbrs): sorted neighbours; an empty array for isolated vertices of a given vertex table."""
        found = self.und.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
        if self._vertices is None:
            return found
        return self.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))

    @cached_property
    def oriented(self) -> DataFrame:
        """(src, dst): every edge from the end with the smaller (degree, id). No vertex has more than sqrt(2E) of them,
        which bounds the lists that cliques intersect, however large a hub is. For cliques only."""
        deg = self.und.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("k"))
        deg = self.kept(deg)
        e = self.edges.join(deg.select(F.col("v").alias("src"), F.col("k").alias("ks")), "src").join(deg.select(F.col("v").alias("dst"), F.col("k").alias("kd")), "dst")
        first = F.struct("ks", "src") < F.struct("kd", "dst")
        return e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))

    @cached_property
    def out(self) -> DataFrame:
        """(id, nbrs) of the oriented edges."""
        return self.kept(self.oriented.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")))

    @cached_property
    def labelled_und(self) -> DataFrame:
        """(src, dst, ls, ld)"""
        lab = self.labels
        return self.kept(self.und.join(lab.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst"))

    @cached_property
    def label_counts(self) -> DataFrame:
        """(v, lv, l, c): how many neighbours of v have label l. v is taken from the end that labelled_und is dealt by, so
        that nothing moves."""
        return self.kept(self.labelled_und.groupBy(F.col("dst").alias("v"), F.col("ld").alias("lv"), F.col("ls").alias("l")).agg(F.count("*").alias("c")))

    def neighbours_by_label(self) -> DataFrame:
        """(id, label, nbrs)"""
        return self.labelled_und.groupBy(F.col("src").alias("id"), F.col("ld").alias("label")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))

    def vertices_with_label(self, label: int) -> DataFrame:
        return self.labels.where(F.col("label") == label)

    def densify(self) -> tuple[Graph, DataFrame]:
        """The graph under ids 0 .. V - 1, in the order of the ids of vertices that have an edge, and (id, new_id)."""
        ids = number_rows(self.und.select(F.col("src").alias("id")).distinct(), ["id"])
        return self.relabel(ids), ids

    def relabel(self, ids: DataFrame) -> Graph:
        """The graph under new_id of (id, new_id)."""
        e = self.edges.join(ids.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("new_id").alias("d")), "dst")
        vertices = None if self._vertices is None else self.vertices.join(ids, "id").drop("id").withColumnRenamed("new_id", "id")
        return Graph(e.select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")), vertices)

    def shuffled_ids(self, seed: int = 17) -> DataFrame:
        """(id, new_id): a permutation of 0 .. V - 1 in the order of a seeded hash."""
        return number_rows(self.vertices.select("id").withColumn("_h", F.xxhash64("id", F.lit(seed))), ["_h", "id"]).drop("_h")

    def degree_rank_ids(self) -> DataFrame:
        """(id, new_id): ranks by (degree, id)."""
        return number_rows(self.degrees, ["degree", "id"]).select("id", "new_id")

    def locality_ids(self, seed_degree: int = 512) -> DataFrame:
        """(id, new_id): ids that keep neighbourhoods together. Vertices of at least seed_degree neighbours are seeds, each
        with a colour, by id; in each round an uncoloured vertex takes the least colour among its neighbours, until no round
        finds any; new ids follow (colour, round, id), and vertices without a path to a seed come last. A bijection with one
        range of ids a colour."""
        seeds = number_rows(self.degrees.where(F.col("degree") >= seed_degree).select("id"), ["id"], "colour")
        # Each round is a table, so that plans don't grow. Neighbours of a round are in it, the one before or the next.
        spark, folder, hop = self.edges.sparkSession, shared_folder(self.edges.sparkSession), 0
        front = before = _as_table(seeds.select("id", "colour", F.lit(0).alias("hop")), f"{folder}/0")
        while not front.isEmpty():
            hop += 1
            step = front.join(self.und, front["id"] == self.und["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("colour"))
            known = front.union(before).select("id")
            before, front = front, _as_table(step.join(known, "id", "left_anti").select("id", "colour", F.lit(hop).alias("hop")), f"{folder}/{hop}")
        done = spark.read.schema(front.schema).parquet(*(f"{folder}/{k}" for k in range(hop + 1)))
        every = self.vertices.select("id").join(done, "id", "left").withColumn("lost", F.col("colour").isNull())
        return number_rows(every, ["lost", "colour", "hop", "id"]).select("id", "colour", "new_id")

    def validate(self) -> None:
        """Raises InvalidGraph unless the labels are 0 .. L - 1 without gaps and ids are 0 <= id < 2^31."""
        low, high = self.und.agg(F.min("src"), F.max("src")).first()
        if low is not None and (low < 0 or high >= MOST_ID):
            raise InvalidGraph(f"ids must be at least 0 and below {MOST_ID}: {low} .. {high}")
        if self.is_labelled:
            n, low, high, nulls = self.labels.agg(F.count_distinct("label"), F.min("label"), F.max("label"), F.count(F.when(F.col("label").isNull(), 1))).first()
            if nulls or n and (low != 0 or high != n - 1):
                raise InvalidGraph(f"labels must be 0 .. L - 1, each used: {n} labels from {low} to {high}, {nulls} vertices without")


def check_edges(directed: DataFrame) -> DataFrame:
    """One row about edges that should be stored in both directions: n_self_loops, n_dups (rows beyond the first of a
    pair), n_asym (pairs without their reverse), degree_sum, num_edges."""
    pairs = directed.groupBy("src", "dst").agg(F.count("*").alias("c"))
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    asym = pairs.join(back, ["src", "dst"], "left_anti").agg(F.count("*").alias("n_asym"))
    sums = pairs.agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("c"))), F.lit(0)).alias("n_self_loops"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_dups"), F.coalesce(F.sum("c"), F.lit(0)).alias("num_edges"))
    degree = directed.groupBy("src").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("degree_sum"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(sums).join(one(asym), "_k").join(one(degree), "_k").select(*(F.col(c).cast("long") for c in ("n_self_loops", "n_dups", "n_asym", "degree_sum", "num_edges")))
