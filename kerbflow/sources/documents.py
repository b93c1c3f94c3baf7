"""One-document JSON files read in many tasks.

A file that is one object or one array has no line to split at. It is read as fragments between commas, which the
text reader finds from any byte offset; a task gets those of a block in order. A first pass sums each block up for a
start outside and one inside a string: quotes, bracket depth, and commas by depth. Running sums over the blocks give
every block its real start. In a second pass the commas of the outermost level end the document's entries; only pieces
of entries that cross a block border are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbflow.session import materialise, ship

_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_QUOTE, _ESCAPE = ord('"'), ord("\\")

_SUMMARY = "file long, block long, quotes long, outside long, inside long, head int, start_inside boolean, depth long, commas long"
_PIECE = "file long, number long, block long, is_array boolean, whole boolean, closed boolean, part binary"


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the texts of a batch in one buffer and where each ends in it."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets[1:] - offsets[0]


def _quotes(data: np.ndarray) -> np.ndarray:
    """Marks of the quotes that no backslash escapes."""
    marks = data == _QUOTE
    escape = data == _ESCAPE
    if escape.any():
        at = np.flatnonzero(marks)
        plain = np.maximum.accumulate(np.where(escape, -1, np.arange(len(data))))  # last byte that is no backslash
        before = np.where(at > 0, plain[at - 1], -1)
        marks[at[(at - 1 - before) % 2 == 1]] = False
    return marks


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that lie in one block, with their bytes and the ends of their fragments."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("file", "block")]
        cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            run = batch.slice(a, b - a)
            yield (run, *_text(run.column("part")))


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SUMMARY``: one with the sums of a block, then its commas by kind of start and relative depth."""
    key, sums, commas = None, None, {}
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()),
                        ("head", pa.int32()), ("start_inside", pa.bool_()), ("depth", pa.int64()), ("commas", pa.int64())])

    def done():
        rows = [(*key, *sums, None, None, None), *((*key, None, None, None, None, *at, n) for at, n in commas.items())]
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), schema.types)], schema=schema)

    for run, data, ends in _runs(batches):
        now = (run.column("file")[0].as_py(), run.column("block")[0].as_py())
        if now != key:
            if key is not None:
                yield done()
            key, sums, commas = now, [0, 0, 0, None], {}
        marks = _quotes(data)
        swapped = (np.cumsum(marks) + sums[0]) % 2 == 1  # inside a string, for a start outside
        step = _STEP[data]
        for inside in (False, True):
            free = ~swapped if not inside else swapped
            depth = np.cumsum(np.where(free, step, 0)) + sums[2 if inside else 1]
            for level, n in zip(*np.unique(depth[ends - 1][free[ends - 1]], return_counts=True)):
                commas[inside, int(level)] = commas.get((inside, int(level)), 0) + int(n)
            sums[2 if inside else 1] = int(depth[-1])
        sums[0] += int(marks.sum())
        if sums[3] is None:
            solid = data[~_SPACE[data]]
            sums[3] = int(solid[0]) if len(solid) else None
    if key is not None:
        yield done()


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PIECE``: entries that a block holds whole, and the parts of those that cross its borders."""
    key, quotes, depth, number, crossing, is_array, held = None, 0, 0, 0, True, False, []

    def rows(texts, whole, closed=False):
        n = len(texts)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, key[0])), pa.array(np.arange(number, number + n)), pa.array(np.full(n, key[1])), pa.array(np.full(n, is_array)),
            pa.array(np.full(n, whole)), pa.array(np.full(n, closed)), texts.cast(pa.binary())], names=["file", "number", "block", "is_array", "whole", "closed", "part"])

    def rest():
        return rows(pa.array([b"".join(held)], pa.binary()), False, depth == 0 and quotes == 0)

    for run, data, ends in _runs(batches):
        now = (run.column("file")[0].as_py(), run.column("block")[0].as_py())
        if now != key:
            if held:
                yield rest()
            key, held = now, []
            quotes, depth, number, crossing, is_array = (run.column(name)[0].as_py() for name in ("quotes", "depth", "number", "crossing", "is_array"))
        marks = _quotes(data)
        free = (np.cumsum(marks) + quotes) % 2 == 0
        level = np.cumsum(np.where(free, _STEP[data], 0)) + depth
        stops = ends[free[ends - 1] & (level[ends - 1] == 1)]
        quotes, depth = (quotes + int(marks.sum())) % 2, int(level[-1])
        if len(stops):
            held.append(data[:stops[0]].tobytes())
            yield rows(pa.array([b"".join(held)], pa.binary()), not crossing)
            body = pa.py_buffer(data[stops[0]:stops[-1]].tobytes())
            number += 1
            if len(stops) > 1:
                yield rows(pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer((stops - stops[0]).astype(np.int64)), body]), True)
            crossing, held, number, data = False, [], number + len(stops) - 1, data[stops[-1]:]
        if len(data):
            held.append(data.tobytes())
    if held:
        yield rest()


def _read(spark: SparkSession, path: str) -> DataFrame:
    """(name, block, part): fragments with their comma; the last one of a file gets one as well."""
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit(",")).alias("part"))


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, block, quotes, depth, number, crossing, is_array): state at the start of every block of every file; a row a block.

    Like the list of files that the driver holds anyway, it is small against the texts and sent to every task.
    """
    files = materialise(spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("name"), F.monotonically_increasing_id().alias("file")), "json-files")
    found = _read(spark, path).join(F.broadcast(files), "name").select("file", "block", "part").mapInArrow(_summaries, _SUMMARY)
    found = materialise(found, "json-blocks")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def before(amount: Column) -> Column:
        return F.coalesce(F.sum(amount).over(earlier), F.lit(0))

    blocks = found.where("quotes IS NOT NULL").select("file", "block", "head", "outside", "inside", before(F.col("quotes")).alias("before"))
    blocks = blocks.withColumn("start_inside", F.col("before") % 2 == 1)
    blocks = blocks.withColumn("depth", before(F.when(F.col("start_inside"), F.col("inside")).otherwise(F.col("outside"))))
    commas = found.where("commas IS NOT NULL").select("file", "block", "start_inside", (F.lit(1) - F.col("depth")).alias("depth"), "commas")
    ended = blocks.join(commas, ["file", "block", "start_inside", "depth"], "left")
    kind = F.first("head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    states = ended.select(
        "file", "block", F.col("start_inside").cast("long").alias("quotes"), "depth", before(F.col("commas")).alias("number"),
        (F.row_number().over(order) > 1).alias("crossing"), (F.coalesce(kind, F.lit(0)) == ord("[")).alias("is_array"))
    return materialise(states.join(files, "file"), "json-starts")


def _found(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, number, is_array, entry) with files as numbers, and the starts of their blocks."""
    ship(spark)
    starts = _starts(spark, path)
    state = ["file", "block", "quotes", "depth", "number", "crossing", "is_array"]
    pieces = _read(spark, path).join(F.broadcast(starts), ["name", "block"]).select(*state, "part").mapInArrow(_pieces, _PIECE)
    pieces = materialise(pieces.withColumn("part", F.col("part").cast("string")), "json-pieces")
    cut = pieces.where("NOT whole").groupBy("file", "number", "is_array").agg(
        F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"), F.bool_or("closed").alias("closed"))
    parts = pieces.where("whole").select("file", "number", "is_array", "closed", "part").unionByName(
        cut.select("file", "number", "is_array", "closed", F.array_join("parts.part", "").alias("part")))
    text = F.substring("part", F.lit(1), F.length("part") - 1)  # without its comma
    text = F.when(F.col("number") == 0, F.regexp_replace(text, r"^\s*[\[{]", "")).otherwise(text)
    text = F.when(F.col("closed"), F.regexp_replace(text, r"[\]}]\s*$", "")).otherwise(text)
    return parts.select("file", "number", "is_array", text.alias("entry")).where(F.col("entry").rlike(r"\S")), starts


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, is_array, entry): texts of the outermost entries; ``"key": value`` where the document is an object.

    Empty documents have none. Entries are as long as they are; files must not be compressed to be split.
    """
    found, starts = _found(spark, path)
    names = starts.where("NOT crossing").select("file", "name")
    return found.join(F.broadcast(names), "file").select(F.col("name").alias("file"), "number", "is_array", "entry")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(value): the objects of array files, and the one object of each other file."""
    found = _found(spark, path)[0]
    single = found.where("NOT is_array").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("number", "entry"))).alias("all"))
    one = single.select(F.concat(F.lit("{"), F.array_join("all.entry", ","), F.lit("}")).alias("value"))
    return found.where("is_array").select(F.col("entry").alias("value")).unionByName(one)


def keyed(spark: SparkSession, path: str) -> DataFrame:
    """(value): every entry of object files as an object of its own."""
    return _found(spark, path)[0].where("NOT is_array").select(F.concat(F.lit("{"), F.col("entry"), F.lit("}")).alias("value"))
