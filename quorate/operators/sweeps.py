"""A chamber's votes dealt over tasks by items: components and classes by sweeps over all cells, with no square of voters.

``Dealt`` packs each item's cells once, in blocks, and keeps them as a table.  A sweep broadcasts a few columns of a number for each
voter, every task adds up its own blocks, and the sums come back by slices, so the driver and a task hold a few columns of voters
and a block, whatever the number of cells.  ``sparse_votes`` has the same for chambers whose square fits one task.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import brief_shuffles, written
from .ranks import running

#: Voters of a chamber up to which it is one task, which holds their square.
DIRECT = 8000
#: Voters that are broadcast with their numbers; more are joined.
FEW = 1_000_000
#: Cells of a block.
BLOCK = 500_000
#: Parts in which the sums of a sweep come back.
SLICES = 8
#: Columns of the solver before it keeps only the best ones.
MOST = 160
#: Largest residual of a component, as a share of the greatest eigenvalue.
TOLERANCE = 1e-8


def large(rows: DataFrame) -> bool:
    """Whether a chamber of (chamber, voter, ...) has more voters than one task is given."""
    return (rows.groupBy("chamber").agg(F.countDistinct("voter").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) > DIRECT


@dataclass
class Block:
    """Cells (i, j, y) of the items ``items`` of a chamber; ``centre`` and ``scale`` are those of the filled columns."""

    chamber: str
    items: np.ndarray
    lens: np.ndarray
    i: np.ndarray
    y: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    @cached_property
    def j(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lens)), self.lens)

    def right(self, fill: np.ndarray, off: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Columns of the standardised table times a vector of voters."""
        return (np.bincount(self.j, off * u[self.i], len(self.lens)) + fill @ u - self.centre * u.sum()) / self.scale


TYPES = {"items": np.int64, "lens": np.int32, "i": np.int32, "y": np.float64, "centre": np.float64, "scale": np.float64}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            bits = len(row["y"]) < 2 * len(row["i"])  # a byte a cell, or eight
            yield Block(row["chamber"], *(np.frombuffer(row[c], np.uint8 if c == "y" and bits else t).astype(np.float64 if c == "y" else t, copy=False) for c, t in TYPES.items()))


class Dealt:
    """(chamber, voter, party, item, y), one row for each voter and item: ``voters`` (chamber, voter, code) and ``blocks`` as tables; by chamber the
    numbers of its voters: ``fill`` (mean y; 0.5 where there is none) and ``sides`` (1 for Republicans), and ``items``, their number."""

    def __init__(self, rows: DataFrame, save: Callable[[DataFrame], DataFrame] = written):
        self.spark = rows.sparkSession
        known = rows.groupBy("chamber", "voter").agg(F.min("party").alias("party"), F.avg(F.nanvl("y", F.lit(None))).alias("fill")).withColumn("one", F.lit(1))
        self.voters = save(running(known, ["chamber"], ["voter"], ["one"], save).select("chamber", "voter", "party", F.coalesce("fill", F.lit(0.5)).alias("fill"), F.col("before_one").cast("int").alias("code")))
        table = self.voters.select("chamber", "code", "fill", (F.col("party") == "Republican").alias("side")).toArrow()  # numbers a voter, no names
        chambers, code = np.array(table.column("chamber").to_pylist(), object), table.column("code").to_numpy()
        self.fill, self.sides = {}, {}
        for c in sorted(set(chambers)):
            at = np.flatnonzero(chambers == c)
            at = at[np.argsort(code[at])]
            self.fill[c] = table.column("fill").to_numpy()[at]
            self.sides[c] = np.array(table.column("side").fill_null(False).to_pylist())[at]
        numbers = self.voters.select("chamber", "voter", "code")
        numbers = F.broadcast(numbers) if len(code) <= FEW else numbers
        cell = F.when(F.col("y").isNotNull() & ~F.isnan("y"), F.struct("code", F.col("y").cast("double").alias("y")))
        lists = rows.join(numbers, ["chamber", "voter"]).groupBy("chamber", "item").agg(F.array_sort(F.collect_list(cell)).alias("list"))
        fill = self.spark.sparkContext.broadcast(self.fill)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chamber, lists = batch.column("chamber").dictionary_encode(), batch.column("codes")
                for k, name in enumerate(chamber.dictionary.to_pylist()):
                    at = np.flatnonzero(chamber.indices.to_numpy() == k)
                    size = np.diff(lists.offsets.to_numpy().astype(np.int64))[at]
                    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1, len(at)]
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                        some = batch.take(pa.array(at[lo:hi]))
                        f, lens = fill.value[name], size[lo:hi].astype(np.int32)
                        i, y = some.column("codes").flatten().to_numpy(), some.column("ys").flatten().to_numpy()
                        j, p, n = np.repeat(np.arange(hi - lo), lens), hi - lo, len(f)
                        centre = (f.sum() + np.bincount(j, y - f[i], p)) / n
                        var = ((f**2).sum() + np.bincount(j, y**2 - f[i] ** 2, p)) / n - centre**2
                        scale = np.sqrt(np.where(var > 1e-12, var, 1.0))
                        bits = ((y == 0) | (y == 1)).all()
                        arrays = {"items": some.column("item").to_numpy(), "lens": lens, "i": i, "y": y.astype(np.uint8) if bits else y, "centre": centre, "scale": scale}
                        columns = [pa.array([name]), *(pa.array([arrays[c].astype(t if c != "y" else arrays[c].dtype).tobytes()]) for c, t in TYPES.items())]
                        yield pa.record_batch([*columns, pa.array([p], pa.int64()), pa.array([float((var * n / scale**2).sum())])], names=["chamber", *TYPES, "p", "square"])

        schema = "chamber string, " + ", ".join(f"{c} binary" for c in TYPES) + ", p long, square double"
        self.blocks = save(lists.select("chamber", "item", F.col("list.code").alias("codes"), F.col("list.y").alias("ys")).mapInArrow(pack, schema))
        totals = self.blocks.groupBy("chamber").agg(F.sum("p").alias("p"), F.sum("square").alias("square")).collect()
        self.items, self.square = {r["chamber"]: r["p"] for r in totals}, {r["chamber"]: r["square"] for r in totals}

    def sums(self, add: Callable[[Block, np.ndarray, np.ndarray], np.ndarray], columns: dict[str, np.ndarray], width: int = 0) -> dict[str, np.ndarray]:
        """By chamber the sum over all blocks of ``add(block, fill, columns of the chamber)``, in ``width`` columns or as many as it is given; chambers without columns are left out."""
        held = self.spark.sparkContext.broadcast({c: (self.fill[c], v) for c, v in columns.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, np.ndarray] = {}
            for block in _blocks(batches):
                if block.chamber in held.value:
                    part = add(block, *held.value[block.chamber])
                    found[block.chamber] = found[block.chamber] + part if block.chamber in found else part
            for c, total in found.items():
                for k, part in enumerate(np.array_split(total.reshape(-1), SLICES)):
                    yield pa.record_batch([pa.array([c]), pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["chamber", "slice", "sums"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                for c, k, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    part = np.frombuffer(part)
                    found[c, k] = found[c, k] + part if (c, k) in found else part
            for (c, k), part in found.items():
                yield pa.record_batch([pa.array([c]), pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["chamber", "slice", "sums"])

        schema = "chamber string, slice int, sums binary"
        with brief_shuffles(self.spark):
            table = self.blocks.select("chamber", *TYPES).mapInArrow(run, schema).repartition(SLICES, "chamber", "slice").mapInArrow(join, schema).toArrow()
        parts = {(r["chamber"], r["slice"]): np.frombuffer(r["sums"]) for r in table.to_pylist()}
        held.destroy()
        return {c: np.concatenate([parts[c, k] for k in range(SLICES)]).reshape(-1, width or v.shape[1]) for c, v in columns.items() if (c, 0) in parts}

    def components(self, k: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By chamber (left vectors, singular values, share of the squares) of the first ``k`` components, as ``Standard.components`` has them."""

        def add(block: Block, fill: np.ndarray, v: np.ndarray) -> np.ndarray:
            off, out = block.y - fill[block.i], np.empty((len(fill), v.shape[1]))
            for t in range(v.shape[1]):
                w = block.right(fill, off, v[:, t]) / block.scale
                out[:, t] = np.bincount(block.i, off * w[block.j], len(fill)) + fill * w.sum() - (block.centre * w).sum()
            return out

        solvers = {c: greatest(len(f), min(k, len(f), self.items[c])) for c, f in self.fill.items()}
        asked, out = {c: next(s) for c, s in solvers.items()}, {}
        while asked:
            got = self.sums(add, asked)
            for c in list(asked):
                try:
                    asked[c] = solvers[c].send(got[c])
                except StopIteration as end:
                    (e, u), _ = end.value, asked.pop(c)
                    u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)
                    e = np.clip(e, 0, None)
                    out[c] = u, np.sqrt(e), e / max(self.square[c], 1e-300)
        return out

    def by_voter(self, columns: dict[str, tuple], tell: Callable[..., dict], schema: str) -> DataFrame:
        """A row for each voter with ``tell(chamber, codes, *columns)`` beside chamber and voter, from what is known by chamber."""
        held, arrow = self.spark.sparkContext.broadcast(columns), to_arrow_schema(StructType.fromDDL(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = np.array(batch.column("chamber").to_pylist(), object)
                for c in sorted(set(names)):
                    some = batch.take(pa.array(np.flatnonzero(names == c)))
                    code = some.column("code").to_numpy()
                    for more in tell(c, code, *held.value[c]):
                        columns = {"chamber": some.column("chamber"), "voter": some.column("voter")} | {n: pa.array(v) for n, v in more.items()}
                        yield pa.record_batch([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

        return self.voters.select("chamber", "voter", "code").mapInArrow(run, schema)

    def by_item(self, columns: dict[str, tuple], tell: Callable[..., list[dict]], schema: str) -> DataFrame:
        """The rows that ``tell(block, fill, *columns)`` makes of every block."""
        held, arrow = self.spark.sparkContext.broadcast({c: (self.fill[c], *v) for c, v in columns.items()}), to_arrow_schema(StructType.fromDDL(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                for columns in tell(block, *held.value[block.chamber]):
                    yield pa.record_batch([pa.array(np.full(len(block.items), block.chamber, object) if f.name == "chamber" else columns[f.name]).cast(f.type) for f in arrow], schema=arrow)

        return self.blocks.select("chamber", *TYPES).mapInArrow(run, schema)


def greatest(n: int, k: int, seed: int = 0, tolerance: float = TOLERANCE) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(eigenvalues, vectors) of the ``k`` greatest of a symmetric operator on ``n`` numbers, by a block Krylov space with restarts.

    Yields blocks of columns and is sent the operator's image of each; ends when every residual is below ``tolerance`` of the greatest eigenvalue.
    """
    width = min(n, k + 4)
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    basis, image = np.empty((n, 0)), np.empty((n, 0))
    while True:
        got = yield new
        basis, image = np.hstack([basis, new]), np.hstack([image, got])
        inner = basis.T @ image
        e, s = np.linalg.eigh((inner + inner.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        u = basis @ s[:, :k]
        rest = np.linalg.norm(image @ s[:, :k] - u * e[:k], axis=0).max(initial=0)
        if rest <= tolerance * max(e[0], 1e-300) or basis.shape[1] >= n:
            return e[:k], u
        for _ in range(2):
            got = got - basis @ (basis.T @ got)
        new, left = np.linalg.qr(got)
        new = new[:, np.abs(np.diag(left)) > 1e-12 * max(e[0], 1e-300)]
        if not new.shape[1]:  # nothing leads out of the space
            return e[:k], u
        for _ in range(2):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        if basis.shape[1] + width > MOST:
            best = s[:, : 2 * width]
            basis, image = basis @ best, image @ best
        new = new[:, : n - basis.shape[1]]
