"""Rank correlations of very many candidates or resamples over the same rows, block against block.

The average rank of a value is the weight below it plus half of one more than the weight of its ties, both sums over
all rows. So ranks add up over blocks of rows: a task takes some candidates (or resamples) and one block, meets the
other blocks in turn, and hands out three sums a candidate. It holds two blocks at a time; nothing that grows with
candidates times rows is stored or shuffled. The blocks that candidates rank are files of the shared folder, which
tasks read, so only candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.session import materialise, shared_path, ship, slices

BLOCK = 1 << 14  # rows of a block
VECTORS = 1 << 20  # distinct vectors of a stored block: 48 MB
AT_ONCE = 4  # candidates that meet a stored block at a time
PRIME = 2_147_483_647
MIX = (1_000_003, 7_919, 15_485_863, 104_729)  # factors of draw, resample, block and seed


def in_blocks(rows: DataFrame, keys: Sequence[str], block: Column, fields: Sequence[str]) -> DataFrame:
    """(keys..., block, rows): each block's rows as one array."""
    return rows.groupBy(*keys, block.alias("block")).agg(F.collect_list(F.struct(*fields)).alias("rows"))


def against_all(blocks: DataFrame, keys: Sequence[str], chunks: Column) -> DataFrame:
    """(keys..., chunk, mine, own, other, others): each chunk of the array and block beside every block, in order."""
    own = blocks.withColumnRenamed("block", "mine").withColumnRenamed("rows", "own")
    met = own.join(blocks.select(*keys, F.col("block").alias("other"), F.col("rows").alias("others")), list(keys)).withColumn("chunk", F.explode(chunks))
    spread = met.repartition(4 * slices(blocks.sparkSession), *keys, "chunk", "mine")
    return spread.sortWithinPartitions(*keys, "chunk", "mine", "other")


def _array(rows: pa.StructArray, name: str) -> np.ndarray:
    return np.asarray(rows.field(name))


# Candidate weightings --------------------------------------------------------------------------------------------

def predictions(rows: dict[str, np.ndarray], names: Sequence[str], weights: np.ndarray, digits: int) -> np.ndarray:
    """Weighted sums in the order of the names, rounded half up by plain arithmetic."""
    total = weights[0] * rows[names[0]]
    for i, name in enumerate(names[1:], 1):
        total = total + weights[i] * rows[name]
    scale = 10.0 ** digits
    return np.floor(total * scale + 0.5) / scale


def stored_block(path: str, block: int, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of a block below a folder that Spark wrote."""
    store, place = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    table = dataset.dataset(f"{place}/block={block}", filesystem=store, format="parquet").to_table(list(names), use_threads=False)
    return {name: table.column(name).to_numpy() for name in names}


def _groups(values: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values in order, and the sums of each weight by value."""
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], *(np.add.reduceat(w[order], first) for w in weights)


def _candidate_sums(path: str, present: Sequence[int], middle: float, names: Sequence[str], digits: int):
    def sums(own: dict[str, np.ndarray], mine: int, weights: np.ndarray) -> Iterator[tuple[float, float]]:
        state = []
        for w in weights:
            values, n, label = _groups(predictions(own, names, w, digits), own["n"], own["label"])
            state.append([values, n, label, np.concatenate([[0.0], np.cumsum(n)[:-1]]), n.copy()])
        for other in (x for x in present if x != mine):
            others = stored_block(path, other, [*names, "n"])
            for (values, _, _, before, ties), w in zip(state, weights):
                theirs, counts = _groups(predictions(others, names, w, digits), others["n"])
                upto = np.concatenate([[0.0], np.cumsum(counts)])
                low, high = (upto[np.searchsorted(theirs, values, side)] for side in ("left", "right"))
                before += low
                ties += high - low
        for _, n, label, before, ties in state:
            dx = before + (ties + 1) / 2 - middle
            yield float((dx * (label - n * middle)).sum()), float((dx * dx * n).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, None
        for batch in batches:
            candidates = batch.column("candidate")
            weights = np.stack([np.asarray(batch.column(f"weight_{name}"), dtype=np.float64) for name in names], axis=1)
            for mine in present:
                if held != mine:
                    own, held = stored_block(path, mine, [*names, "n", "label"]), mine
                    own["n"] = own["n"].astype(np.float64)
                for first in range(0, len(candidates), AT_ONCE):
                    found = list(sums(own, mine, weights[first : first + AT_ONCE]))
                    yield pa.RecordBatch.from_arrays([candidates.slice(first, AT_ONCE), *(pa.array(c, pa.float64()) for c in zip(*found))], ["candidate", "xy", "xx"])
    return run


def candidate_correlations(vectors: DataFrame, pool: DataFrame, names: Sequence[str], chunk: int, digits: int = 9) -> DataFrame:
    """(candidate, xy, xx, yy) of each weighting in ``pool`` (candidate, weight_<name>...).

    ``vectors`` has distinct component vectors with ``n`` rows each, the sum of their label ranks ``label`` and of
    the squared ones ``squares``. A task takes about ``chunk`` candidates, at least.
    """
    spark = vectors.sparkSession
    ship(spark)
    stored = materialise(vectors, "component-vectors")
    count, size = stored.agg(F.count("*"), F.sum("n")).first()
    middle = ((size or 0) + 1) / 2.0
    block = F.pmod(F.xxhash64(*names), F.lit(max(1, -(-count // VECTORS)))).cast("int")
    path = shared_path(spark, "vector-blocks")
    blocks = stored.select(*[F.col(name).cast("double") for name in names], "n", F.col("label").cast("double").alias("label"), block.alias("block"))
    blocks.write.partitionBy("block").parquet(path)
    present = sorted(r.block for r in blocks.select("block").distinct().collect())  # one number a block
    tasks = max(1, min(4 * slices(spark), -(-pool.count() // chunk)))
    dealt = pool.select("candidate", *[F.col(f"weight_{name}").cast("double") for name in names]).repartition(tasks, "candidate")
    sums = dealt.mapInArrow(_candidate_sums(path, present, middle, tuple(names), digits), "candidate int, xy double, xx double")
    spread = stored.agg(F.sum("squares") - size * middle * middle if size else F.lit(0.0)).scalar()
    return sums.groupBy("candidate").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx")).withColumn("yy", spread)


# Resamples -------------------------------------------------------------------------------------------------------

def picks(seed: int, resample: int, block: int, draws: int, size: int) -> np.ndarray:
    """Rows of a block that its draws take: fifth powers modulo a prime, which any engine can repeat."""
    x = (np.arange(draws, dtype=np.int64) * MIX[0] + 1 + resample * MIX[1] + block * MIX[2] + seed * MIX[3]) % PRIME
    for step in (1, 2):
        square = x * x % PRIME
        x = (square * square % PRIME * x + step * (resample + 1)) % PRIME
    return x % size


def block_draws(seed: int, resample: int, sizes: np.ndarray) -> np.ndarray:
    """How many of a resample's draws fall into each block: one multinomial split, the same in every task."""
    if len(sizes) == 1:
        return sizes
    return np.random.Generator(np.random.Philox(key=[seed, resample])).multinomial(sizes.sum(), sizes / sizes.sum())


def resample_weights(seed: int, resample: int, block: int, sizes: np.ndarray) -> np.ndarray:
    """How often a resample takes each row of a block; every row once in the sample itself (number -1)."""
    size = int(sizes[block])
    if resample < 0:
        return np.ones(size)
    return np.bincount(picks(seed, resample, block, int(block_draws(seed, resample, sizes)[block]), size), minlength=size).astype(np.float64)


def _resample_sums(group: str, seed: int, chunk: int, last: int):
    def flushed(state: dict) -> pa.RecordBatch:
        out = []
        middle = (state["sizes"].sum() + 1) / 2
        for k, resample in enumerate(state["resamples"]):
            m = resample_weights(seed, resample, state["mine"], state["sizes"])
            dx, dy = (state[f"before_{a}"][k] + (state[f"ties_{a}"][k] + 1) / 2 - middle for a in "xy")
            out.append(((m * dx * dy).sum(), (m * dx * dx).sum(), (m * dy * dy).sum()))
        size = len(out)
        return pa.RecordBatch.from_arrays(
            [pa.array([state["group"]] * size), pa.array(state["resamples"], pa.int32()), pa.array([int(state["sizes"].sum())] * size, pa.int64()), *map(pa.array, map(list, zip(*out)))],
            [group, "boot", "size", "xy", "xx", "yy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for row in range(batch.num_rows):
                name, part, mine, other = (batch.column(c)[row].as_py() for c in (group, "chunk", "mine", "other"))
                own, others = (batch.column(c)[row].values for c in ("own", "others"))
                sizes = np.asarray(batch.column("sizes")[row].values)
                resamples = list(range(part * chunk - 1, min(last, (part + 1) * chunk - 1)))
                if state is None or state["key"] != (name, part, mine):
                    if state is not None:
                        yield flushed(state)
                    state = {"key": (name, part, mine), "group": name, "mine": mine, "sizes": sizes, "resamples": resamples}
                    state |= {f"{kind}_{a}": np.zeros((len(resamples), len(own))) for kind in ("before", "ties") for a in "xy"}
                places = []
                for a in "xy":
                    order = np.argsort(_array(others, a))
                    places.append((a, order, *(np.searchsorted(_array(others, a)[order], _array(own, a), side) for side in ("left", "right"))))
                for k, resample in enumerate(resamples):
                    m = resample_weights(seed, resample, other, sizes)
                    for a, order, low, high in places:
                        upto = np.concatenate([[0.0], np.cumsum(m[order])])
                        state[f"before_{a}"][k] += upto[low]
                        state[f"ties_{a}"][k] += upto[high] - upto[low]
        if state is not None:
            yield flushed(state)
    return run


def resample_correlations(rows: DataFrame, group: str, n_boot: int, seed: int, chunk: int = 64) -> DataFrame:
    """(group, boot, size, xy, xx, yy) of the sample (boot -1) and of each resample.

    ``rows`` has group, ``slot`` (0-based row number in the group), x, y. A resample draws as many rows as the group
    has; the draws are split over blocks of slots, and a block draws its own rows by number.
    """
    ship(rows.sparkSession)
    block = F.floor(F.col("slot") / BLOCK).cast("int")
    packed = in_blocks(rows, [group], block, ["slot", "x", "y"]).withColumn("rows", F.array_sort("rows"))
    packed = materialise(packed, "resample-blocks")
    sizes = packed.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("block", F.size("rows").cast("long").alias("n")))).alias("sizes"))
    sized = packed.join(sizes.select(group, F.col("sizes.n").alias("sizes")), group)
    chunks = F.sequence(F.lit(0), F.lit(n_boot // chunk))
    spread = against_all(sized, [group], chunks)
    kind = rows.schema[group].dataType.simpleString()
    sums = spread.mapInArrow(_resample_sums(group, seed, chunk, n_boot), f"`{group}` {kind}, boot int, size long, xy double, xx double, yy double")
    return sums.groupBy(group, "boot", "size").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
