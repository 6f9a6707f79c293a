"""Near-duplicate vectors by lattice hashing: random projections decoded to points of E8.

Vectors that are certainly all linked with each other (each within half the angle of a common
centre) become one class, so a crowd of near copies is one row in everything that follows. Classes
are hashed in several tables, looked up in the neighbouring lattice cells too, compared in their
cells by sign sketches, and then decided: by the angle between the centres where it leaves no
doubt, else vector by vector in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.llm.common import mixed
from rideops.llm.components import connected_components
from rideops.session import cut_lineage

#: Tables, lattice blocks of a table, neighbouring cells tried per block, lattice scale. By simulation
#: with 64 dimensions a pair at cosine 0.90 meets with probability 0.989, at 0.93 with 0.997.
TABLES, BLOCKS, PROBES, SCALE = 6, 2, 4, 0.85
#: Bits of a sign sketch, deviations allowed, rounds of class building, classes compared at once, vectors of a block.
SKETCH, DEVIATIONS, ROUNDS, CHUNK, BLOCK = 256, 4.5, 4, 2048, 1024


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of size 1, or eight of size 1/2 with an even number negative."""
    pairs = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    out = np.zeros((len(pairs), 8))
    for row, (i, j, s, t) in zip(out, pairs):
        row[i], row[j] = s, t
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([out, halves[(halves < 0).sum(1) % 2 == 0]])


MINIMAL = _minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: if the rounded sum is odd, the worst entry goes the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row, doubled so that it is integer."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], whole, half)).astype(np.int64)


def _hashed(points: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(points.shape[:-1], seed, np.uint64)
    for k in range(points.shape[-1]):
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + points[..., k].astype(np.uint64))
    return h


class Projections:
    """Random directions for vectors of one length."""

    def __init__(self, size: int) -> None:
        rng = np.random.default_rng([8, size])
        self.size, self.step = size, SCALE * np.sqrt(8 / size)
        self.blocks = rng.standard_normal((TABLES, BLOCKS, size, 8)) / np.sqrt(size)
        self.signs = rng.standard_normal((size, SKETCH))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home cells, neighbouring cells) of each vector: n x tables, n x tables x (blocks * probes)."""
        n = len(unit)
        home, near = np.zeros((n, TABLES), np.uint64), np.zeros((n, TABLES, BLOCKS * PROBES), np.uint64)
        for t in range(TABLES):
            codes, others = [], []
            for b in range(BLOCKS):
                x = unit @ self.blocks[t, b] / self.step
                point = nearest_point(x)
                gain = (x - point / 2) @ MINIMAL.T
                best = np.argpartition(-gain, PROBES, 1)[:, :PROBES]
                codes.append(_hashed(point, self.size * 100 + b))
                others.append(_hashed(point[:, None] + np.rint(2 * MINIMAL[best]).astype(np.int64), self.size * 100 + b))
            mark = mixed(np.array([t + 1], np.uint64))[0]

            def joined(parts: list[np.ndarray]) -> np.ndarray:
                h = np.full(parts[0].shape, mark)
                for p in parts:
                    h = mixed(h * np.uint64(0x9FB21C651E98DF25) + p)
                return h

            home[:, t] = joined(codes)
            for b in range(BLOCKS):
                for p in range(PROBES):
                    near[:, t, b * PROBES + p] = joined([others[c][:, p] if c == b else codes[c] for c in range(BLOCKS)])
        return home, near

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1)


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(usable rows, unit vectors in double precision of each)."""
    rows, units = [], []
    for i, v in enumerate(column):
        if v.is_valid and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
            if size > 0 and np.isfinite(size):
                rows.append(i)
                units.append(x / size)
    return np.array(rows, np.int64), units


def _by_length(units: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(u) for u in units])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.stack([units[i] for i in at])


def hashed_vectors(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, unit, home) of every usable vector; ``home`` holds its cell in each table."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Projections] = {}
        for batch in batches:
            rows, units = _units(batch.column(2))
            home = np.zeros((len(rows), TABLES), np.uint64)
            for at, unit in _by_length(units):
                p = ready[unit.shape[1]] = ready.get(unit.shape[1]) or Projections(unit.shape[1])
                home[at] = p.cells(unit)[0]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take).cast(pa.int64()), pa.array(units, pa.list_(pa.float64())),
                pa.array(list(home.view(np.int64)), pa.list_(pa.int64()))], names=["rid", "vec_id", "unit", "home"])

    return vectors.select("rid", "vec_id", "embedding").mapInArrow(convert, "rid long, vec_id long, unit array<double>, home array<long>")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def classes_of(rows: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members add ``class`` and ``near`` (cosine to the class's centre) to the rows.

    In each round the cells of two tables together propose a centre, the vector of least hash, for
    the vectors still alone; those within half the linking angle of it join. Any two of a class are
    linked by the triangle inequality. A crowd in a cell supplies the centre in proportion to its
    share, and its cell's other rounds follow.
    """
    half = float(np.cos(np.arccos(cosine) / 2)) + 1e-9
    done, rest = None, rows
    for r in range(ROUNDS):
        cell = F.xxhash64(F.col("home")[r % TABLES], F.col("home")[(r + 1) % TABLES], F.size("unit"))
        turn = F.xxhash64(F.lit(r), F.col("rid"))
        celled = rest.withColumn("_cell", cell)
        centres = celled.groupBy("_cell").agg(F.min_by(F.struct("rid", "unit"), turn).alias("_c"))
        tried = celled.join(centres, "_cell").withColumn("_near", _dot("unit", "_c.unit")).withColumn("_own", (F.col("_near") >= half) | (F.col("rid") == F.col("_c.rid")))
        counted = cut_lineage(tried.select(*rows.columns, F.col("_c.rid").alias("class"), F.when(F.col("rid") == F.col("_c.rid"), 1.0).otherwise(F.col("_near")).alias("near"), "_own"))
        together = counted.where("_own").groupBy("class").count().where("count > 1").select("class")
        joined = counted.where("_own").join(together, "class").select(*rows.columns, "class", "near")
        done = joined if done is None else done.unionAll(joined)
        rest = cut_lineage(counted.join(joined.select("rid"), "rid", "left_anti").select(*rows.columns))
    members = cut_lineage(done.unionAll(rest.select(*rows.columns, F.col("rid").alias("class"), F.lit(1.0).alias("near"))))
    centre = F.max(F.when(F.col("rid") == F.col("class"), F.col("unit")))
    return members, cut_lineage(members.groupBy("class").agg(F.min("near").alias("near"), F.count("*").alias("members"), centre.alias("unit")))


def _candidates(members: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b) classes of which members meet in a cell, one of them at home there, and whose centres' sketches allow a link.

    Every member brings its own cells, so that two vectors meet as likely in classes as alone.
    """
    angle = float(np.arccos(cosine))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Projections] = {}
        for batch in batches:
            units = [v.values.to_numpy(zero_copy_only=False) for v in batch.column(1)]
            for at, unit in _by_length(units):
                p = ready[unit.shape[1]] = ready.get(unit.shape[1]) or Projections(unit.shape[1])
                home, near = p.cells(unit)
                n, k = len(at), TABLES * (1 + BLOCKS * PROBES)
                cells = np.concatenate([home, near.reshape(n, -1)], 1).ravel()
                ids, at_home = np.repeat(batch.column(0).to_numpy()[at], k), np.tile(np.arange(k) < TABLES, n)
                order = np.lexsort((~at_home, cells, ids))  # a class's cell once a batch, at home if any member is
                first = order[np.append(True, (np.diff(ids[order]) != 0) | (np.diff(cells[order]) != 0))]
                yield pa.RecordBatch.from_arrays([pa.array(cells[first].view(np.int64)), pa.array(ids[first]), pa.array(at_home[first])], names=["cell", "class", "home"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Projections] = {}
        for batch in batches:
            units = [v.values.to_numpy(zero_copy_only=False) for v in batch.column(2)]
            for at, unit in _by_length(units):
                p = ready[unit.shape[1]] = ready.get(unit.shape[1]) or Projections(unit.shape[1])
                radius = np.arccos(np.clip(batch.column(1).to_numpy()[at], -1, 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array(radius), pa.array([x.tobytes() for x in p.sketch(unit)], pa.binary())],
                    names=["class", "radius", "sketch"])

    centres = classes.select("class", "near", "unit").mapInArrow(sketched, "class long, radius double, sketch binary")
    cells = members.select("class", "unit").mapInArrow(spread, "cell long, class long, home boolean")
    rows = cells.groupBy("cell", "class").agg(F.max("home").alias("home"))
    buckets = 16 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, ids, home, radius = (table[c].to_numpy(zero_copy_only=False) for c in ("cell", "class", "home", "radius"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(ids), SKETCH // 64)
        order = np.lexsort((~home, cell))
        left, right = [], []
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            homes = int(home[part].sum())
            for lo in range(0, homes, CHUNK):
                i = part[lo:min(lo + CHUNK, homes)]
                for start in range(lo, len(part), CHUNK):
                    j = part[start:start + CHUNK]
                    differ = sum(np.bitwise_count(sketch[i, w][:, None] ^ sketch[j, w][None, :]).astype(np.int16) for w in range(sketch.shape[1]))
                    share = np.minimum((angle + radius[i][:, None] + radius[j][None, :]) / np.pi, 1.0)
                    allowed = SKETCH * share + DEVIATIONS * np.sqrt(SKETCH * share * (1 - share) + 1e-9)
                    x, y = np.nonzero((differ <= allowed) & (ids[i][:, None] != ids[j][None, :]))
                    left.append(np.minimum(ids[i[x]], ids[j[y]]))
                    right.append(np.maximum(ids[i[x]], ids[j[y]]))
        none = [np.zeros(0, np.int64)]
        pairs = np.unique(np.stack([np.concatenate(left or none), np.concatenate(right or none)]), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    alone = rows.groupBy("cell").agg(F.count("*").alias("_n"), F.max("home").alias("_h")).where("_n > 1 and _h").select("cell")
    met = rows.join(alone, "cell").join(centres, "class").withColumn("_bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
    return met.groupBy("_bucket").applyInArrow(compare, "a long, b long").distinct()


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Links of vectors by cosine in double precision, counted, and their components.

    Returns per input row: vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable by links, itself included), kept (vec_id = component_id). Vectors that are
    null, empty, zero, or hold null or non-finite entries link with nothing, as do vectors of
    different lengths. Rows equal in id and vector are one vector; other rows of one id are vectors
    of their own. Every link reported is verified; lattice hashing may miss links (see ``TABLES``).
    """
    rows = vectors.select("vec_id", "embedding").withColumn("rid", F.xxhash64("vec_id", "embedding"))
    usable = cut_lineage(hashed_vectors(rows.dropDuplicates(["rid"])))
    members, classes = classes_of(usable, cosine)
    candidates = _candidates(members, classes, cosine)
    block = F.pmod(F.xxhash64("rid"), F.ceil(F.col("members") / BLOCK))
    blocks = (members.join(classes.select("class", "members"), "class").groupBy("class", block.alias("_block"))
              .agg(F.collect_list("rid").alias("rids"), F.collect_list("unit").alias("units")))
    pairs = (candidates.join(blocks.select(F.col("class").alias("a"), F.col("rids").alias("left"), F.col("units").alias("u")), "a")
             .join(blocks.select(F.col("class").alias("b"), F.col("rids").alias("right"), F.col("units").alias("v")), "b"))

    def matrix(value: pa.Scalar) -> np.ndarray:
        flat = value.values
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, count, a, b = [], [], [], []
            for i in range(batch.num_rows):
                u, v = matrix(batch.column(3)[i]), matrix(batch.column(5)[i])
                if u.shape[1] != v.shape[1]:
                    continue
                linked = u @ v.T >= cosine
                if linked.any():
                    for ids, n in ((batch.column(2)[i], linked.sum(1)), (batch.column(4)[i], linked.sum(0))):
                        some = np.flatnonzero(n)
                        rid.append(ids.values.to_numpy()[some])
                        count.append(n[some])
                        a.append(np.full(len(some), batch.column(0)[i].as_py()))
                        b.append(np.full(len(some), batch.column(1)[i].as_py()))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none).astype(np.int64)) for x in (rid, count, a, b)], names=["rid", "n", "a", "b"])

    found = cut_lineage(pairs.select("a", "b", "left", "u", "right", "v").mapInArrow(decide, "rid long, n long, a long, b long"))
    joined = connected_components(found.select("a", "b").distinct())
    links = found.groupBy("rid").agg(F.sum("n").alias("_outside"))
    groups = members.select("rid", "vec_id", "class").join(joined, F.col("class") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "class"))
    least = groups.groupBy("_group").agg(F.min("vec_id").alias("component_id"))
    known = (groups.join(least, "_group").join(classes.select("class", "members"), "class").join(links, "rid", "left")
             .select("rid", "component_id", (F.col("members") - 1 + F.coalesce("_outside", F.lit(0))).alias("n_links")))
    return (rows.select("rid", "vec_id").join(known, "rid", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
