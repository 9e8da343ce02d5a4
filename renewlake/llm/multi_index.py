"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from renewlake.llm.common import prepared, stored
from renewlake.llm.components import connected_components
from renewlake.llm.vectors import one_per_id

SAMPLE = 20_000  # vectors that the codebooks and the traversal depth are fitted on
CODES = 256  # codes of a half at most
BLOCK_ROWS = 2_048  # members of a cell row's block, and queries of a chunk
ROWS_AT_ONCE = 256


def _units(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _decoded(cells, kind: str, dim: int) -> np.ndarray:
    return _units(np.frombuffer(b"".join(cells), kind).reshape(-1, dim))


def _distances(v: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances to the codes of one half."""
    return (v * v).sum(1)[:, None] - 2 * v @ codes.T + (codes * codes).sum(1)[None, :]


def _codebook(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means of one half of the sample."""
    codes = v[rng.choice(len(v), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(v, codes).argmin(1)
        for c in range(k):
            mine = v[near == c]
            codes[c] = mine.mean(0) if len(mine) else v[rng.integers(len(v))]
    return codes


class MultiIndex:
    """Two codebooks, and how many cells a traversal visits."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float, seed: int):
        rng = np.random.default_rng(seed)
        self.half = max(1, sample.shape[1] // 2)
        k = int(2 ** np.clip(round(np.log2(max(n, 1) ** 0.5 / 8)), 3, np.log2(CODES)))
        k = min(k, len(sample))
        self.one = _codebook(sample[:, : self.half], k, rng)
        rest = sample[:, self.half:]
        self.two = _codebook(rest, k, rng) if rest.shape[1] else np.zeros((1, 0))
        # A partner just at the threshold, in a random direction: the cells to visit until it is met.
        probe = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
        aside = rng.standard_normal(probe.shape)
        aside -= (aside * probe).sum(1, keepdims=True) * probe
        size = np.sqrt((aside * aside).sum(1, keepdims=True))
        partner = threshold * probe + np.sqrt(1 - threshold ** 2) * aside / np.where(size > 0, size, 1)
        a, b = self.home(partner)
        d1, d2 = self.tables(probe)
        own = d1[np.arange(len(probe)), a] + d2[np.arange(len(probe)), b]
        met = [int((d1[i][:, None] + d2[i][None, :] <= own[i]).sum()) for i in range(len(probe))]
        self.cells = max(1, int(np.quantile(met, recall, method="higher")))

    @classmethod
    def of(cls, parts: dict) -> MultiIndex:
        """The index that vars() took apart: a broadcast names its classes, and workers may lack the package."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index

    def tables(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(v[:, : self.half], self.one), _distances(v[:, self.half:], self.two)

    def home(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = self.tables(v)
        return d1.argmin(1), d2.argmin(1)

    def radius(self, v: np.ndarray) -> np.ndarray:
        """The distance at which a multi-sequence traversal of the product grid stops.

        Of the n cells nearest by the sum of both halves' distances, the one in place i of the
        first half's order and j of the second's has (i + 1)(j + 1) <= n, so only the first n
        places of each order need be merged.
        """
        d1, d2 = self.tables(v)
        deep1, deep2 = min(self.cells, d1.shape[1]), min(self.cells, d2.shape[1])
        near1, near2 = np.sort(d1, 1)[:, :deep1], np.sort(d2, 1)[:, :deep2]
        out = np.empty(len(v))
        for at in range(0, len(v), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            sums = (near1[part][:, :, None] + near2[part][:, None, :]).reshape(len(near1[part]), -1)
            stop = min(self.cells, sums.shape[1]) - 1
            out[part] = np.partition(sums, stop, axis=1)[:, stop]
        return out + 1e-9


def _place(index, kind: str, dim: int):
    """Home cell, radius, and the rows of the grid that a traversal visits."""

    def run(batches):
        grid = MultiIndex.of(index.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _decoded(batch.column(2).to_pylist(), kind, dim)
            d1, d2 = grid.tables(v)
            reach = grid.radius(v)
            visits = [np.flatnonzero(row) for row in d1 + d2.min(1, keepdims=True) <= reach[:, None]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(d1.argmin(1), pa.int32()), pa.array(reach),
                 pa.array([x.astype(np.int32) for x in visits], pa.list_(pa.int32()))],
                names=["rep", "copies", "raw", "c1", "reach", "visits"])

    return run


def _forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vertex of a block's link matrix, the smallest id that links within the block reach."""
    top = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(linked, columns[None, :], top).min(1))
        new_columns = np.minimum(columns, np.where(linked, new_rows[:, None], top).min(0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _verify(index, kind: str, dim: int, threshold: float):
    """Links of one chunk of queries with one block of a grid row's members: counts, and a spanning label."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        grid = MultiIndex.of(index.value)
        c1 = int(block["row"].iloc[0])
        asks = block["asks"].to_numpy()
        members, queries = block[~asks], block[asks]
        out = []
        if len(members) and len(queries):
            v, q = _decoded(members["raw"], kind, dim), _decoded(queries["raw"], kind, dim)
            v_id, q_id = members["rep"].to_numpy(), queries["rep"].to_numpy()
            v_copies, q_copies = members["copies"].to_numpy(), queries["copies"].to_numpy()
            v_reach, q_reach = members["reach"].to_numpy(), queries["reach"].to_numpy()
            v1, v2 = grid.tables(v)
            v_cell = v2.argmin(1)
            q1, q2 = grid.tables(q)
            qa, qb = q1.argmin(1), q2.argmin(1)
            for cell in np.unique(v_cell):
                mine = np.flatnonzero(v_cell == cell)
                comes = np.flatnonzero(q1[:, c1] + q2[:, cell] <= q_reach)
                for at in range(0, len(comes), ROWS_AT_ONCE):
                    who = comes[at: at + ROWS_AT_ONCE]
                    linked = (q[who] @ v[mine].T >= threshold) & (q_id[who][:, None] != v_id[mine][None, :])
                    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                    if not len(rows):
                        continue
                    linked, who, those = linked[np.ix_(rows, columns)], who[rows], mine[columns]
                    # A member whose own traversal misses the query's cell learns of the link here.
                    back = v1[those][:, qa[who]] + v2[those][:, qb[who]] <= v_reach[those][:, None]
                    missed = linked & ~back.T
                    label_q, label_v = _forest(linked, q_id[who], v_id[those])
                    out.append(pd.DataFrame({"rep": q_id[who], "links": linked @ v_copies[those], "label": label_q}))
                    out.append(pd.DataFrame({"rep": v_id[those], "links": q_copies[who] @ missed, "label": label_v}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "label": []}).astype("int64")

    return run


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.9, recall: float = 0.995, seed: int = 5,
                           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors that link by cosine >= threshold.

    Inverted multi-index: a codebook for each half of the vectors, fitted on 20,000 vectors,
    forms a grid of cells; every vector lies in one. Each vector also visits the cells nearest
    to it in order of the sum of both halves' distances, as many as bring a partner at the very
    threshold, in a random direction, with probability `recall` (closer partners come sooner).
    Met pairs are verified by cosine in double precision. Equal vectors are one entry with a
    count. Cells and queries are cut into blocks of bounded size; a block gives counts and one
    label per vector, never its pairs.

    n_links counts the other vectors linked directly, component_id is the smallest vec_id that
    links reach, kept says that it is the vector's own.

    Defined cases: a vector that is null, empty, zero or has null or non-finite components
    links with nothing; vectors of unlike length don't link; of rows that repeat an id the
    smallest usable vector counts; rows with a null id are left out; an empty table gives an
    empty table; further columns are ignored.
    """
    spark = prepared(table.sparkSession)
    rows = stored(one_per_id(table, id_col, vec_col), "vectors")
    element = rows.schema["vec"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"

    def pack(batches):
        for batch in batches:
            cells = [np.array(v, kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["vec_id", "raw"])

    fine = rows.where(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0))
    packed = stored(fine.mapInArrow(pack, "vec_id long, raw binary"), "packed")
    classes = stored(packed.groupBy("raw").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "raw"), "classes")
    width = 4 if kind == "<f4" else 8
    met = None
    for size in sorted(r[0] for r in classes.select(F.octet_length("raw")).distinct().collect()):
        part = _links_of(spark, classes.where(F.octet_length("raw") == size), kind, size // width, threshold, recall, seed)
        met = part if met is None else met.unionAll(part)
    result = rows.select("vec_id")
    if met is None:
        return result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                             F.lit(True).alias("kept"))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(met.select("rep", "label"), "rep", "label")
    found = (packed.join(classes, "raw").select("vec_id", "rep", "copies").join(counts, "rep", "left")
             .join(labels.withColumnRenamed("vertex", "rep"), "rep", "left")
             .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component_id", "rep").alias("component_id")))
    return result.join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))


def _links_of(spark, classes: DataFrame, kind: str, dim: int, threshold: float, recall: float, seed: int) -> DataFrame:
    sample = classes.orderBy(F.xxhash64("raw", F.lit(seed)), "rep").limit(SAMPLE).select("raw").collect()
    units = _decoded([r["raw"] for r in sample], kind, dim)
    index = spark.sparkContext.broadcast(vars(MultiIndex(units, classes.count(), threshold, recall, seed)))
    placed = stored(classes.mapInArrow(
        _place(index, kind, dim),
        "rep long, copies long, raw binary, c1 int, reach double, visits array<int>"), "placed")
    asks = placed.select(F.explode("visits").alias("row"), "rep", "copies", "raw", "reach")
    held = placed.groupBy(F.col("c1").alias("row")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    come = asks.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    plan = F.broadcast(held.join(come, "row"))  # one row per code, 256 at most
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
    asked = asks.join(plan, "row").select(
        "row", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"),
        "rep", "copies", "raw", "reach", F.lit(True).alias("asks"))
    shown = placed.withColumnRenamed("c1", "row").join(plan, "row").select(
        "row", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "rep", "copies", "raw", "reach", F.lit(False).alias("asks"))
    return stored(asked.unionByName(shown).groupBy("row", "block", "part").applyInPandas(
        _verify(index, kind, dim, threshold), "rep long, links long, label long"), "vector-links")
