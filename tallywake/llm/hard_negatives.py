"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited in order of summed bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.storage import reach_workers, stored

#: Vectors that the codebooks are fitted on, rounds of it, and the most codewords of a half.
SAMPLE, FIT_ROUNDS, CODEWORDS_MOST = 4096, 8, 256
#: Rows of a cell that the number of codewords aims at.
CELL_ROWS = 256
#: Rows of a zone and anchors of a chunk: one task holds one of each.
ZONE_ROWS, CHUNK_ANCHORS = 8192, 4096
#: Components of this size and more take no part, so that scores of up to 128 dimensions fit 64 bits.
COMPONENT_LIMIT = 1 << 28
_EXACT = float(1 << 53)
_NONE = -(1 << 63)


@dataclass
class Codebooks:
    """Codewords of the first and second half of a vector."""

    halves: tuple[np.ndarray, np.ndarray]
    cut: int

    @classmethod
    def fitted(cls, sample: np.ndarray, codewords: int) -> Codebooks:
        """K-means of each half, from the first distinct vectors of the sample."""
        cut = sample.shape[1] // 2
        return cls((_kmeans(sample[:, :cut], codewords), _kmeans(sample[:, cut:], codewords)), cut)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def codes(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Code and distance to its codeword, for each half."""
        codes, radii = [], []
        for half, words in zip(self.split(x), self.halves):
            code = _nearest(half, words)
            codes.append(code.astype(np.int32))
            radii.append(np.sqrt(((half - words[code]) ** 2).sum(1)))
        return codes, radii


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1) - 2 * (x @ words.T), axis=1)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    words = np.unique(x, axis=0)
    words = words[np.linspace(0, len(words) - 1, min(k, len(words))).astype(int)]
    for _ in range(FIT_ROUNDS):
        code = _nearest(x, words)
        n = np.bincount(code, minlength=len(words))
        sums = np.stack([np.bincount(code, x[:, j], len(words)) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((len(words), 0))
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _slack(size: np.ndarray | float) -> np.ndarray | float:
    """What rounding may take from a bound."""
    return 1 + 1e-9 * abs(size)


class Zone:
    """Rows of one task, lying by cell; cells hold what bounds the scores inside."""

    def __init__(self, books: Codebooks, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        codes, radii = books.codes(vectors.astype(np.float64))
        order = np.lexsort((ids, codes[1], codes[0]))
        self.books, self.ids, self.labels = books, ids[order], labels[order]
        self.exact = vectors[order]
        self.vectors = self.exact.astype(np.float64)
        self.longest = float(np.sqrt((self.vectors**2).sum(1).max(initial=0)))
        # Per half the codes that occur, and the radius around each.
        self.words, places = [], []
        self.radii = []
        for half in range(2):
            held, place = np.unique(codes[half][order], return_inverse=True)
            radius = np.zeros(len(held))
            np.maximum.at(radius, place, radii[half][order])
            self.words.append(books.halves[half][held])
            self.radii.append(radius)
            places.append(place)
        cell = places[0] * len(self.words[1]) + places[1]
        starts = np.flatnonzero(np.concatenate((np.ones(1, bool), cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, int)
        self.cells = {(int(places[0][a]), int(places[1][a])): (int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(cell)))}

    def bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Middle and reach of the scores of each half's codes."""
        middle, reach = [], []
        for half, part in enumerate(self.books.split(anchor[None, :])):
            middle.append(self.words[half] @ part[0])
            reach.append(self.radii[half] * np.sqrt((part**2).sum()))
        return middle, reach

    def scores(self, a: int, b: int, anchor: np.ndarray) -> np.ndarray:
        wide = anchor.astype(np.float64)
        if self.longest * float(np.sqrt((wide**2).sum())) < _EXACT:
            return (self.vectors[a:b] @ wide).astype(np.int64)
        return (self.exact[a:b] * anchor).sum(1)

    def cells_from_best(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, first row, end) of every cell, the largest upper bound first.

        A heap holds pairs of places in the two lists of codes, each sorted by its
        half's bound; a pair brings in the next one of either list.
        """
        middle, reach = self.bounds(anchor.astype(np.float64))
        upper = [m + r for m, r in zip(middle, reach)]
        order = [np.argsort(-u, kind="stable") for u in upper]
        if not self.cells:
            return
        sorted_bounds = [u[o] for u, o in zip(upper, order)]
        heap, seen = [(-(sorted_bounds[0][0] + sorted_bounds[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            x, y = int(order[0][i]), int(order[1][j])
            rows = self.cells.get((x, y))
            if rows is not None:
                low = float(middle[0][x] - reach[0][x] + middle[1][y] - reach[1][y])
                yield -bound + _slack(bound), low - _slack(low), *rows
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(order[0]) and q < len(order[1]) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (-(sorted_bounds[0][p] + sorted_bounds[1][q]), p, q))


@dataclass
class Wanted:
    """Best rows of the anchor's label, or of all others, whose score lies in low..high; floor: what is already certain."""

    name: int
    same: bool
    low: int
    high: int
    count: int
    floor: int
    ids: np.ndarray
    scores: np.ndarray

    def least(self) -> int:
        """Scores below this can not be among the best."""
        own = int(self.scores[self.count - 1]) if len(self.scores) >= self.count else _NONE
        return max(self.low, self.floor, own)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        best = np.lexsort((ids, -scores))[: self.count]
        self.ids, self.scores = ids[best], scores[best]


def search(zone: Zone, anchor_id: int, label: int, anchor: np.ndarray, wanted: list[Wanted]) -> None:
    """Fill ``wanted`` from the zone; ends when no further cell can hold a row of any window."""
    for upper, low, a, b in zone.cells_from_best(anchor):
        least = min(w.least() for w in wanted)
        if upper < least:
            return
        if low > max(w.high for w in wanted):
            continue
        scores = zone.scores(a, b, anchor)
        ids, same = zone.ids[a:b], zone.labels[a:b] == label
        other = ids != anchor_id
        for w in wanted:
            hit = other & (same == w.same) & (scores >= w.least()) & (scores <= w.high)
            if hit.any():
                w.add(ids[hit], scores[hit])


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and components floor(``scale`` x), one row per vec_id.

    Left out: a null vec_id, label or vector; a null, infinite or undefined
    component, or one of COMPONENT_LIMIT and more after scaling. Of rows with one
    vec_id the smallest by label, then vector, takes part.
    """
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < COMPONENT_LIMIT))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(sound)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", scaled.alias("v"))).alias("row")).select("vec_id", "row.label", "row.v")


def _matrix(t: pa.Table, name: str, dim: int, kind: type) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)


_WANTED = T.ArrayType(
    T.StructType([T.StructField("name", T.LongType()), T.StructField("same", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("low", "high", "count", "floor")]])
)
_FOUND = "anchor_id long, name long, vec_id long, score long"


class MultiIndex:
    """Rows by cell of two codebooks, in zones that one task each can hold.

    Cells lie in zones of ZONE_ROWS by their codes; a cell with more rows is split
    by vec_id. The driver holds one row per cell, at most CODEWORDS_MOST squared.
    """

    def __init__(self, rows: DataFrame) -> None:
        reach_workers(rows.sparkSession)
        self.spark = rows.sparkSession
        sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        self.dim, self.n = (sizes.dim, sizes.n) if sizes else (0, 0)
        rows = rows.where(F.size("v") == self.dim)
        if not self.n:
            return
        sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()], np.float64).reshape(-1, self.dim)
        self.books = books = Codebooks.fitted(sample, min(CODEWORDS_MOST, max(1, round((self.n / CELL_ROWS) ** 0.5))))
        dim = self.dim

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                codes, radii = books.codes(_matrix(table, "v", dim, np.float64))
                for name, column in zip(("c1", "c2", "r1", "r2"), (*codes, *radii)):
                    table = table.append_column(name, pa.array(column))
                yield from table.combine_chunks().to_batches()

        coded = stored(rows.mapInArrow(code, "vec_id long, label long, v array<int>, c1 int, c2 int, r1 double, r2 double"), "coded")
        reach = (F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
        cells = coded.groupBy("c1", "c2").agg(*reach).orderBy("c1", "c2").collect()  # at most CODEWORDS_MOST squared
        # Cells in order of their codes fill zones; one that alone is too large has zones of its own.
        zones, parts, zone, filled = [], [], 0, 0
        for cell in cells:
            split = -(-cell.n // ZONE_ROWS)
            if filled and filled + cell.n > ZONE_ROWS:
                zone, filled = zone + 1, 0
            zones.append(zone)
            parts.append(split)
            zone, filled = (zone + split, 0) if split > 1 else (zone, filled + cell.n)
        self.c1, self.c2, self.r1, self.r2 = (np.array([c[k] for c in cells]) for k in ("c1", "c2", "r1", "r2"))
        self.zones, self.parts = np.array(zones), np.array(parts)
        plan = self.spark.createDataFrame([(c.c1, c.c2, z, p) for c, z, p in zip(cells, zones, parts)], "c1 int, c2 int, zone int, parts int")
        place = F.col("zone") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
        self.rows = stored(coded.join(F.broadcast(plan), ["c1", "c2"]).select("vec_id", "label", "v", place.alias("zone")), "zoned")

    def find(self, anchors: DataFrame, chunks: int, seed: bool) -> DataFrame:
        """anchor_id, name, vec_id and score of the best rows of each window of ``anchors`` (anchor_id, label, v, wanted).

        With ``seed``, an anchor looks into its most promising zone only, which gives
        floors. Without, it goes to every zone where a cell's bound reaches the least
        floor of its windows, so nothing is missed.
        """
        books, dim = self.books, self.dim
        c1, c2, r1, r2 = self.c1, self.c2, self.r1, self.r2
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), self.zones[1:] != self.zones[:-1])))
        starts, parts = self.zones[first], self.parts[first]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(pa.Table.from_batches([batch]), "v", dim, np.float64)
                wanted = batch.column(batch.schema.get_field_index("wanted")).to_pylist()
                taken, zones = [], []
                for i, (a, b) in enumerate(zip(*books.split(x))):
                    upper = (books.halves[0] @ a)[c1] + r1 * np.sqrt(a @ a) + (books.halves[1] @ b)[c2] + r2 * np.sqrt(b @ b)
                    best = np.maximum.reduceat(upper + _slack(upper), first)
                    least = min(max(w["low"], w["floor"]) for w in wanted[i])
                    if seed:
                        chosen = starts[[int(np.argmax(best))]]
                    else:
                        reached = np.flatnonzero(best >= least)
                        chosen = np.concatenate([np.zeros(0, int), *[starts[u] + np.arange(parts[u]) for u in reached]])
                    taken.append(np.full(len(chosen), i))
                    zones.append(chosen)
                out = batch.take(pa.array(np.concatenate([np.zeros(0, int), *taken])))
                yield out.append_column("zone", pa.array(np.concatenate([np.zeros(0, int), *zones]), pa.int32()))

        schema = T.StructType([*anchors.schema.fields, T.StructField("zone", T.IntegerType())])
        chunk = F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int")
        routed = stored(anchors.mapInArrow(route, schema).withColumn("chunk", chunk), "routed")
        # Only chunks that have an anchor for a zone bring its rows along.
        met = self.rows.select("vec_id", "label", "v", "zone").join(routed.select("zone", "chunk").distinct().toDF("zone", "chunk"), "zone")

        def meet(block: pa.Table, asked: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if block.num_rows and asked.num_rows:
                zone = Zone(books, block.column("vec_id").to_numpy(), block.column("label").to_numpy(), _matrix(block, "v", dim, np.int64))
                vectors = _matrix(asked, "v", dim, np.int64)
                for i, (anchor_id, label, windows) in enumerate(zip(*(asked.column(n).to_pylist() for n in ("anchor_id", "label", "wanted")))):
                    wanted = [Wanted(**w, ids=np.zeros(0, np.int64), scores=np.zeros(0, np.int64)) for w in windows]
                    search(zone, anchor_id, label, vectors[i], wanted)
                    found += [(anchor_id, w.name, w.ids, w.scores) for w in wanted]
            counts = [len(f[2]) for f in found]
            columns = [np.repeat(np.array([f[k] for f in found], np.int64), counts) for k in range(2)]
            columns += [np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (2, 3)]
            return pa.table([pa.array(c) for c in columns], names=["anchor_id", "name", "vec_id", "score"])

        keys = ["zone", "chunk"]
        return met.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(meet, _FOUND)

    def best(self, anchors: DataFrame) -> DataFrame:
        """The best rows of every window, with their rank: first floors from one zone, then all zones that can reach them."""
        chunks = max(1, -(-anchors.count() // CHUNK_ANCHORS))
        seeds = self.find(anchors, chunks, True)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "name").orderBy(F.desc("score"), "vec_id"))
        least = seeds.groupBy("anchor_id", "name").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        floors = least.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("n", "floor")))).alias("floors"))  # one entry per window
        raised = F.transform("wanted", lambda w: w.withField("floor", F.when(F.col("floors")[w["name"]]["n"] >= w["count"], F.col("floors")[w["name"]]["floor"]).otherwise(w["floor"])))
        floored = anchors.join(floors, "anchor_id", "left").withColumn("wanted", raised).select(anchors.columns)
        found = self.find(floored, chunks, False).withColumn("rank", rank)
        counts = anchors.select("anchor_id", F.explode("wanted").alias("w")).select("anchor_id", "w.name", "w.count")
        return found.join(counts, ["anchor_id", "name"]).where("rank <= count").drop("count")


def _windows(*fields: Column) -> Column:
    names = ("name", "same", "low", "high", "count", "floor")
    return F.array(F.struct(*[f.cast(t.dataType).alias(n) for f, t, n in zip(fields, _WANTED.elementType.fields, names)]))


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Rows of other labels that an anchor scores nearly as high as a row of its own label.

    Components become floor(``scale`` x); a score is the integer inner product with
    the anchor. Anchors are the rows whose vec_id is divisible by ``every``, their
    positives the first ``positives`` other rows of the same label (all, if fewer),
    highest score first, ties to the smaller vec_id. For each positive come the
    first ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score; a positive without such a row has
    none, so a negative positive_score never has one.

    Rows lie in zones of an inverted multi-index (``MultiIndex``). Within a zone a
    heap visits cells by the sum of their half-space bounds and stops when every
    window is certain; which zones an anchor must see follows from the same bounds.
    So the result is exact, whatever the codebooks are.

    Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score. ``usable`` says which rows take part; of those, vectors that
    are not as long as most (ties: the shorter) take none. Other columns are not
    looked at. An empty table, or one label only, gives no row.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, scale), "rows")
    index = MultiIndex(rows)
    if not index.n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    none, most = F.lit(_NONE), F.lit(-(_NONE + 1))
    same = anchors.withColumn("wanted", _windows(F.lit(0), F.lit(True), none, most, F.lit(positives), none))
    chosen = stored(index.best(same).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    least, largest = F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"(positive_score * {high}) div 100")
    window = _windows(F.col("rank"), F.lit(False), least, largest, F.lit(negatives), none)[0]
    windows = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(window).alias("wanted"))  # one entry per positive
    found = index.best(anchors.join(windows, "anchor_id").select("anchor_id", "label", "v", "wanted"))
    named = chosen.select("anchor_id", F.col("rank").cast("long").alias("name"), "positive_id", "positive_score")
    return found.join(named, ["anchor_id", "name"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def moved_labels(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the label (label + 1) % 10 where vec_id is divisible by 7."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def oracle() -> str:
    """DuckDB SQL for the query's rows: every anchor against every row."""
    return """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from e a join e r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id and len(a.v) = len(r.v)),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (
  select p.anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3"""
