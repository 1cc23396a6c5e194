"""Packed little-endian files: graphs with a header, bare edge lists, bare vertex labels.

A graph file is a header of 20 bytes (u32 vertices, u64 edges, i32 has vertex labels, i32 has edge labels), then a u32
label for each vertex if there are any, then an edge (u32 source, u32 target[, u32 label]) for each stored direction,
sorted. An edge list is edges without a header, a label file is labels alone. All are records of a fixed width, so they
are read in ranges of rows, each a task of its own, and sections that aren't asked for aren't opened.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from lacework.operators.graph import Graph, InvalidGraph, symmetrize

HEADER = struct.Struct("<IQii")
#: Rows of a read task and of a batch.
TASK_ROWS, BATCH_ROWS = 8 << 20, 1 << 20


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def file_size(path: str) -> int:
    fs, at = _file_system(path)
    return fs.get_file_info(at).size or 0


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class PackedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.offset, self.rows = options["path"], int(options.get("offset", 0)), int(options["rows"])
        self.width = int(options["width"])
        self.numbered, self.task_rows = options.get("numbered", "false") == "true", int(options.get("taskrows", TASK_ROWS))
        self.names = schema.names

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(self.rows, a + self.task_rows)) for a in range(0, self.rows, self.task_rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, at = _file_system(self.path)
        with fs.open_input_file(at) as f:
            for a in range(partition.first, partition.last, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.last - a)
                f.seek(self.offset + a * 4 * self.width)
                data = np.frombuffer(f.read(n * 4 * self.width), "<u4").reshape(n, self.width).astype(np.int64)
                columns = [np.arange(a, a + n)] * self.numbered + [data[:, k] for k in range(len(self.names) - self.numbered)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=self.names)


class Packed(DataSource):
    """Options: path; fields, names of the leading u32 fields that are wanted; width, u32 fields of a record; offset, bytes
    before the first record; rows; numbered, whether the row number comes first, as id; taskRows."""

    @classmethod
    def name(cls) -> str:
        return "packed_u32"

    def schema(self) -> StructType:
        names = ["id"] * (self.options.get("numbered", "false") == "true") + self.options["fields"].split(",")
        return StructType([StructField(x, LongType()) for x in names])

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(self.options, schema)


def read_packed(spark: SparkSession, path: str, fields: str, width: int, offset: int = 0, rows: int | None = None, numbered: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    if rows is None:
        size = file_size(path) - offset
        if size % (4 * width):
            raise InvalidGraph(f"{path}: {size} bytes aren't records of {4 * width}")
        rows = size // (4 * width)
    spark.dataSource.register(Packed)
    return spark.read.format("packed_u32").options(path=path, fields=fields, width=width, offset=offset, rows=rows, numbered=str(numbered).lower(), taskRows=task_rows).load()


@dataclass(frozen=True)
class Header:
    vertices: int
    edges: int
    vertex_labels: bool
    edge_labels: bool

    @property
    def edges_at(self) -> int:
        return HEADER.size + 4 * self.vertices * self.vertex_labels


def read_header(path: str) -> Header:
    fs, at = _file_system(path)
    with fs.open_input_file(at) as f:
        data = f.read(HEADER.size)
    if len(data) < HEADER.size:
        raise InvalidGraph(f"{path} has no header")
    v, e, a, b = HEADER.unpack(data)
    found = Header(v, e, bool(a), bool(b))
    if (size := file_size(path)) != found.edges_at + e * (12 if b else 8):
        raise InvalidGraph(f"{path} has {size} bytes, not those of {found}")
    return found


def read_directed(spark: SparkSession, path: str, edge_labels: bool = False) -> DataFrame:
    """The stored edges (src, dst[, label]); labels of a labelled file are skipped unless asked for."""
    h = read_header(path)
    if edge_labels and not h.edge_labels:
        raise InvalidGraph(f"{path} has no edge labels")
    return read_packed(spark, path, "src,dst,label" if edge_labels else "src,dst", 3 if h.edge_labels else 2, h.edges_at, h.edges)


def read_graph(spark: SparkSession, path: str, labels: bool = False) -> Graph:
    """The undirected graph of a file with both directions. Files with edge labels can't be mined."""
    h = read_header(path)
    if h.edge_labels:
        raise InvalidGraph(f"{path} has edge labels, which mining doesn't take")
    if labels and not h.vertex_labels:
        raise InvalidGraph(f"{path} has no vertex labels")
    vertices = read_packed(spark, path, "label", 1, HEADER.size, h.vertices, True).withColumn("label", F.col("label").cast("int")) if labels else spark.range(h.vertices)
    return Graph(read_directed(spark, path).where("src < dst"), vertices)


def read_edge_list(spark: SparkSession, path: str, edge_labels: bool = False) -> DataFrame:
    return read_packed(spark, path, "src,dst,label" if edge_labels else "src,dst", 3 if edge_labels else 2)


def read_labels(spark: SparkSession, path: str, vertices: int | None = None) -> DataFrame:
    """(id, label); a file of another size than `vertices` labels is refused."""
    if vertices is not None and file_size(path) != 4 * vertices:
        raise InvalidGraph(f"{path} has {file_size(path)} bytes, not {4 * vertices}")
    return read_packed(spark, path, "label", 1, numbered=True).withColumn("label", F.col("label").cast("int"))


def _write_parts(df: DataFrame, folder: str) -> list[tuple[int, str, int]]:
    """Writes the long columns of df as packed u32 records, a file for each task that has rows: (partition, file, rows).
    Files of attempts that failed have other names and aren't listed."""
    fs, at = _file_system(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, name = TaskContext.get().partitionId(), 0, f"{at}/{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if len(data) and (data.min() < 0 or data.max() >= 2**32):
                raise InvalidGraph("a value isn't an unsigned 32-bit integer")
            out = out or _file_system(folder)[0].open_output_stream(name)
            out.write(data.astype("<u4").tobytes())
            rows += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([rows], pa.int64())], names=["part", "name", "rows"])

    return sorted(tuple(x) for x in df.mapInArrow(run, "part int, name string, rows long").collect())


def write_packed(dfs: list[DataFrame], path: str, header: bytes = b"") -> int:
    """One file: the header, then the records of each DataFrame, in the order of its partitions. Tasks write parts side by
    side; the driver only joins their bytes. Returns the number of records."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    fs, at = _file_system(path)
    total = 0
    try:
        parts = [p for df in dfs for p in _write_parts(df, folder)]
        with fs.open_output_stream(at) as out:
            out.write(header)
            for _, name, rows in parts:
                with fs.open_input_stream(name) as f:
                    while chunk := f.read(16 << 20):
                        out.write(chunk)
                total += rows
    finally:
        folder_at = _file_system(folder)[1]
        if fs.get_file_info(folder_at).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(folder_at)
    return total


def _in_order(df: DataFrame, *by: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by)


def write_graph(directed: DataFrame, path: str, vertices: int, labels: DataFrame | None = None, is_directed: bool = False, extension: str = ".dgraph") -> str:
    """A graph file from edges (src, dst[, label]) over the ids 0 .. vertices - 1: both directions are stored unless
    is_directed. Self-loops, repeated edges and ends outside are refused. labels: (id, label), one for each vertex."""
    edges = directed if is_directed else symmetrize(directed)
    low, high, n, loops = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst")), F.count("*"), F.count(F.when(F.col("src") == F.col("dst"), 1))).first()
    if loops:
        raise InvalidGraph(f"{loops} self-loops")
    if n and (low < 0 or high >= vertices):
        raise InvalidGraph(f"ends {low} .. {high} aren't all among {vertices} vertices")
    if not edges.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise InvalidGraph("repeated edges")
    edge_labels = "label" in edges.columns
    dfs = [_in_order(edges.select("src", "dst", *["label"] * edge_labels), "src", "dst")]
    if labels is not None:
        if labels.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first() != (vertices, vertices, *((0, vertices - 1) if vertices else (None, None))):
            raise InvalidGraph(f"labels must be given once for each of the {vertices} vertices")
        dfs.insert(0, _in_order(labels.select("id", F.col("label").cast("long").alias("label")), "id").select("label"))
    path = path if path.endswith(extension) else path + extension
    write_packed(dfs, path, HEADER.pack(vertices, n, int(labels is not None), int(edge_labels)))
    return path


def write_edge_list(edges: DataFrame, path: str) -> str:
    """Bare packed edges, sorted."""
    path = path if path.endswith(".biedgelist") else path + ".biedgelist"
    write_packed([_in_order(edges.select("src", "dst"), "src", "dst")], path)
    return path


def write_oriented(graph: Graph, path: str) -> str:
    """The graph under ranks by (degree, id), each edge from its smaller end, without labels. For cliques only."""
    ids = graph.degree_rank_ids()
    return write_graph(graph.relabel(ids).edges, path, graph.vertices.count(), is_directed=True)
