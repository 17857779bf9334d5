"""Helpers shared by the operators: staging, chunks of texts, bit counts, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towerlens import session

#: Characters of text that one chunk inside a task holds at most (a longer text is a chunk of its own).
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Staged tables by the staging block they belong to, innermost last.
_OPEN: list[dict[int, tuple[DataFrame, str]]] = []


#: Rows of a small staged table per task and file.
STAGED_ROWS = 5_000


def few(df: DataFrame, most: int | None) -> DataFrame:
    """``df`` in as few tasks as its rows, of which it has ``most`` at most, ask for."""
    return df if most is None else df.coalesce(max(1, -(-most // STAGED_ROWS)))


def stage(df: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here. ``most`` is the
    number of rows it has at most; a small table then takes as few tasks and files."""
    path = session.scratch(df.sparkSession, label)
    df = few(df, most)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1][id(found)] = (found, path)
    return found


class staging:
    """Deletes, at its end, the folders of the tables staged inside it, but for those kept.

    What is kept, or returned to an enclosing block, must have been staged itself: nothing
    read after the block may still depend on a deleted table. A failure deletes nothing.
    """

    def __enter__(self) -> staging:
        _OPEN.append({})
        self.kept: set[int] = set()
        return self

    def keep(self, *frames: DataFrame) -> None:
        self.kept |= set(map(id, frames))

    def __exit__(self, kind, value, trace) -> None:
        own = _OPEN.pop()
        for key, (frame, path) in own.items():
            if kind is not None or key in self.kept:
                if _OPEN:
                    _OPEN[-1][key] = (frame, path)
                continue
            folder = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, which name a row in every later reading of it.

    They come from the files' own metadata where ``docs`` reads Parquet files row by row; any
    other table is written first.
    """
    plan = [line.lstrip(" +-:") for line in docs._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip()]
    if not (all(line.startswith(("Relation [", "Project [", "Filter ")) for line in plan) and plan[-1].rstrip().endswith("parquet")):
        docs = stage(docs, "rows")
    about = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(about["file_path"]).alias("__file"), about["row_index"].alias("__row"))


def row_key(*columns: str):
    """A key that is never null and equal only for rows equal in the given columns."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *parts))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text, whole rows always."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray([0 if not s.is_valid else s.as_buffer().size for s in texts], np.int64)
        bin_of = np.cumsum(sizes) // limit
        starts = [0, *(np.nonzero(np.diff(bin_of))[0] + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_LANES = np.uint64(0x0101010101010101)


def bit_sums(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per group of consecutive 64-bit hashes, how many have each bit set: shape (groups, 64).

    Eight bits are counted at a time in the eight bytes of a word, over blocks of at most
    255 hashes, so that no byte overflows; the blocks of a group are summed after that.
    """
    lengths = np.asarray(lengths, np.int64)
    sums = np.zeros((len(lengths), 64), np.int64)
    blocks = (lengths + 254) // 255
    if not blocks.sum():
        return sums
    first = np.cumsum(blocks) - blocks
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks)
    starts = begin + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * 255
    counts = np.empty((len(starts), 64), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts[:, k::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    full = lengths > 0
    sums[full] = np.add.reduceat(counts, first[full], axis=0, dtype=np.int64)
    return sums


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SimHash of each group: a bit is 1 if set in over half of the group's hashes."""
    bits = bit_sums(hashes, lengths) * 2 > np.asarray(lengths, np.int64)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, component) per linked node.

    Ids are 64-bit hashes; ``component`` is a node of the component. Each round hooks every
    node to the smallest id around it and contracts the links to the hooked nodes, so that
    links vanish geometrically; every round is written to the shared folder, by as many tasks
    as its links ask for. ``most`` is the number of links at most, where it is known.
    """
    with staging() as own:
        found = _components(links, most)
        own.keep(found)
    return found


def _components(links: DataFrame, most: int | None) -> DataFrame:
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stage(few(edges, most), "links")
    hooks: list[DataFrame] = []
    nodes = None
    while count := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hook = stage(few(hook.select("node", F.least("node", "near").alias("to")), 2 * count), "hooks")
        nodes = nodes or 2 * count
        hooks.append(hook)  # every hook is read once more at the end
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(left, "a").join(right, "b").filter("to_a <> to_b")
        edges = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = stage(few(edges, count), "links")
    if not hooks:
        return stage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    found = hooks[0].select("node", F.col("to").alias("component"))
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("component"), F.col("to").alias("_next"))
        found = found.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
    return stage(few(found, nodes), "components")
