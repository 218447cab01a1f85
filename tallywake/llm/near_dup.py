"""Near copies by min-max hashing: both ends of every permutation, banded; links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.components import components
from tallywake.llm.storage import reach_workers, release_dictionaries, stored
from tallywake.llm.words import _WINDOW_STEPS, Texts, Words, mix, portions, windows, words

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8^7)^48, about 1.2e-5, if its sets are large.
BANDS, ROWS = 48, 7
PERMUTATIONS = BANDS * ROWS // 2
#: Minimum and maximum of one permutation depend on each other in small sets (of 4 in 5 shingles both agree with
#: 0.6, not 0.64, which makes that 1.1e-4), so sets of fewer than SMALL have more bands, with fewer ends each.
SMALL, SMALL_BANDS, SMALL_ROWS = 64, 8, 4
#: Bits of every end that go into a node's sketch.
SKETCH_BITS = 4
SKETCH_WORDS = BANDS * ROWS * SKETCH_BITS // 64
#: A finer sketch, for nodes whose buckets hold several components: more permutations, fewer bits of each end.
FINE_PERMUTATIONS, FINE_BITS = 1024, 2
#: Rounds in which nodes meet the leaders of their buckets, and how many leaders of a node are compared in each.
STAR_ROUNDS, STAR_PAIRS = 2, 4
#: Members of a block: larger buckets are compared block by block.
BLOCK = 4096
#: Parts into which the nodes of a component are dealt.
SALTS = 32
_CHUNK = 2048

_rng = np.random.default_rng(44)
_MULTIPLIERS = (_rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_FINE_MULTIPLIERS = (np.random.default_rng(45).integers(0, 2**31, FINE_PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SMALL_MULTIPLIERS = (np.random.default_rng(46).integers(0, 2**31, SMALL_BANDS * SMALL_ROWS // 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_BAND_STEPS = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: Texts, size: int, fold: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle, none make none."""
    w = words(texts, fold)
    at, hashes = windows(w, size)
    cuts = np.searchsorted(at, w.bounds)
    return [np.unique(hashes[a:b]) if b > a else _short(w, i) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def _short(w: Words, i: int) -> np.ndarray:
    own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
    if not len(own):
        return own
    return mix((own * _WINDOW_STEPS[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))


def set_number(shingles: np.ndarray) -> int:
    """A number for a set of shingles: equal sets have equal numbers."""
    return int(mix(shingles ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64))


def check_number(shingles: np.ndarray) -> int:
    """Another one, of another hash: sets that differ but agree in one differ in the other."""
    return int(mix(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64).astype(np.int64))


def band_keys(shingles: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One key per band; ``values`` are the ends of the set."""
    keys = mix((values.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_STEPS).sum(1, dtype=np.uint64))
    if len(shingles) < SMALL:
        more = ends(shingles, _SMALL_MULTIPLIERS).reshape(SMALL_BANDS, SMALL_ROWS).astype(np.uint64)
        keys = np.concatenate((keys, mix((more * _BAND_STEPS[:SMALL_BANDS, :SMALL_ROWS]).sum(1, dtype=np.uint64))))
    return keys.view(np.int64)


def ends(shingles: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    low, high = np.full(len(multipliers), 2**32 - 1, np.uint32), np.zeros(len(multipliers), np.uint32)
    for i in range(0, x.shape[1], _CHUNK):
        moved = multipliers * x[:, i : i + _CHUNK]
        low, high = np.minimum(low, moved.min(1)), np.maximum(high, moved.max(1))
    return np.stack((low, high), 1).ravel()


def sketch(values: np.ndarray, bits: int) -> np.ndarray:
    """Some middle bits of every end, packed into 64-bit words."""
    shifts = np.arange(5, 5 + bits, dtype=np.uint32)
    return np.packbits((values[:, None] >> shifts).astype(np.uint8) & 1).view(np.int64)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("check", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_dictionaries()
        for batch in batches:
            sizes, nodes, checks, bands, sketches = [], [], [], [], []
            for texts in portions(batch.column(1)):
                for s in shingle_sets(texts, size):
                    sizes.append(len(s))
                    if not len(s):
                        nodes.append(None)
                        checks.append(None)
                        bands.append(None)
                        sketches.append(None)
                        continue
                    e = ends(s)
                    nodes.append(set_number(s))
                    checks.append(check_number(s))
                    bands.append(band_keys(s, e))
                    sketches.append(sketch(e, SKETCH_BITS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _agreement() -> Column:
    """Bits in which the sketches of x and y agree."""
    return reduce(lambda a, b: a + b, [64 - F.bit_count(F.expr(f"x.sketch[{i}] ^ y.sketch[{i}]")) for i in range(SKETCH_WORDS)])


def _least_agreement(percent: int, ends_kept: int, bits: int) -> int:
    """4.5 standard deviations below the mean agreement of sketches at that similarity: a link falls lower with probability 3e-6."""
    same, other = percent / 100, 1 - percent / 100
    mean = bits * (same + other / 2)
    spread = same * bits**2 + other * (bits**2 + bits) / 4 - mean**2
    return int(ends_kept * mean - 4.5 * (ends_kept * spread) ** 0.5)


def _sized(percent: int) -> Column:
    """Sizes of nodes x and y leave a similarity of ``percent`` possible."""
    return 100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")


def _alike(percent: int) -> Column:
    """Sizes and sketches of nodes x and y do."""
    return _sized(percent) & (_agreement() >= _least_agreement(percent, BANDS * ROWS, SKETCH_BITS))


def _finely_alike(percent: int) -> Column:
    """Nodes x and y are as similar as that, as far as sketches can tell; of two small sets the shingles themselves can."""
    agree = F.aggregate(F.zip_with("x.fine", "y.fine", lambda a, b: 64 - F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    small = F.greatest("x.n_shingles", "y.n_shingles") < SMALL
    mixed = F.least("x.n_shingles", "y.n_shingles") < SMALL
    common = F.size(F.array_intersect("x.fine", "y.fine"))
    exactly = (100 + percent) * common >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    finely = F.when(mixed, True).otherwise(agree >= _least_agreement(percent, 2 * FINE_PERMUTATIONS, FINE_BITS))
    return _sized(percent) & F.when(small, exactly).otherwise(_alike(percent) & finely)


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """One text of each wanted node; only these texts are moved."""
    texts = nodes.select("node", "check", "doc_id").join(wanted, "node").join(docs.select("doc_id", "text"), "doc_id").select("node", "check", "text")

    def same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [check_number(s) if len(s) else None for p in portions(batch.column(2)) for s in shingle_sets(p, size)]
            yield batch.filter(pa.array([n == m for n, m in zip(numbers, batch.column(1).to_pylist())], pa.bool_())).select(["node", "text"])

    # A doc_id that stands for several texts brings them all: those of other sets go.
    return stored(texts.mapInArrow(same_set, texts.drop("check").schema).dropDuplicates(["node"]), "texts")


def _fine_sketches(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, fine: the finer sketch of each wanted node; of a small set, its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_dictionaries()
        for batch in batches:
            found = [s.view(np.int64) if len(s) < SMALL else sketch(ends(s, _FINE_MULTIPLIERS), FINE_BITS) for p in portions(batch.column(1)) for s in shingle_sets(p, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "fine"])

    return _texts(wanted, nodes, docs, size).mapInArrow(run, "node long, fine array<long>")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full shingle sets reach ``percent``; a pair is one row with both texts."""
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            names, keep = batch.column(0).to_pylist(), []
            others = (s for p in portions(batch.column(3)) for s in shingle_sets(p, size))
            for i, other in enumerate(others):
                if held[0] != names[i]:
                    held = (names[i], shingle_sets(next(portions(batch.column(2).slice(i, 1))), size)[0])
                common = len(np.intersect1d(held[1], other, assume_unique=True))
                keep.append(100 * common >= percent * (len(held[1]) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def _star_pairs(buckets: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a node and the leader of a bucket, in different components: for each node the STAR_PAIRS that look most alike.

    A bucket draws a new leader in each turn, and a node has a leader in every
    bucket, so members of a dense group meet many others at linear cost.
    """
    lead = F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("h"), "node", "comp"))
    leaders = buckets.groupBy("key").agg(lead.alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    pairs = buckets.join(leaders.select("key", "l"), "key").where("comp <> l.comp").select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()
    x, y = (nodes.select("node", "n_shingles", "sketch").alias(n) for n in "xy")
    scored = pairs.join(x, F.col("x.node") == F.col("b")).join(y, F.col("y.node") == F.col("a")).where(_alike(percent)).select("a", "b", _agreement().alias("agreement"))
    best = Window.partitionBy("b").orderBy(F.desc("agreement"), "a")
    return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= STAR_PAIRS).select("a", "b")


def _cross_pairs(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs that share a bucket, lie in different components and may be alike.

    Buckets of one component drop out. In the others only members outside the
    largest component look for partners, and a pair counts in the first band that
    it shares. A bucket of more than BLOCK members is cut into blocks, and every
    block of seekers meets every block of members under a key of its own.

    Heavily edited copies of a large group reach none of its members, though they
    are close to many. Finer sketches of these members keep most such pairs from
    being formed, and small sets are compared by their shingles at once.
    """
    parts = buckets.groupBy("key", "comp").agg(F.count("*").alias("n"))
    per_key = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main")).where("main.n < n")
    per_key = per_key.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mixed = stored(buckets.join(per_key, "key"), "mixed")
    fine = stored(_fine_sketches(mixed.select("node").distinct(), nodes, docs, size), "fine")
    halves = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands")  # enough to tell which bands a pair shares
    rows = mixed.join(nodes.select("node", "n_shingles", "sketch", halves).join(fine, "node"), "node")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = rows.where("comp <> main").withColumn("bx", own).withColumn("by", other).alias("x")
    y = rows.withColumn("by", own).withColumn("bx", other).alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    first = F.expr(f"not exists(sequence(0, {BANDS + SMALL_BANDS - 2}), i -> i < x.at and get(x.bands, i) = get(y.bands, i))")
    pairs = x.join(y, met & (F.col("x.comp") != F.col("y.comp")) & once & _finely_alike(percent) & first)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _told_apart(signed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signed`` and ``nodes`` with another node number where different sets have one in common.

    Sets are equal if both their numbers are. At 1e11 documents some hundred sets
    share the first number with another one; all but the least check number then
    get a number made of both.
    """
    clashes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("check").alias("least")).where("n > 1").select("node", "least")
    if clashes.isEmpty():
        return signed, nodes
    number = F.when(F.col("check") > F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.join(clashes, "node", "left").withColumn("node", number).select(rows.columns)

    return stored(renamed(signed), "signatures"), stored(renamed(nodes), "nodes")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets reach a Jaccard similarity of ``percent`` / 100.

    A pair at similarity 0.8 shares no band with probability 1.6e-5 at most, and
    each of the two sketches hides it with 4e-6 at most. Pairs of sets of fewer
    than SMALL shingles do without sketches. Nothing else is left out.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a
    set is the distinct runs of ``shingle_words`` words, or the whole sequence of
    a shorter text. Equal sets are one node. In every bucket the members meet a
    leader drawn for that bucket, and the best of a node's leaders are compared on
    full sets, over some rounds; then all pairs that still lie in different
    components are. So a dense group costs its size times the bands, and what
    remains are pairs that must be looked at.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and
    kept (doc_id = component_id), one row per input row; repeated rows are kept
    or not together. A text without words has no set and is linked with nothing.
    A row without doc_id cannot be named: it is linked with nothing, its
    component_id is null and it is kept. An empty table gives no row. Other
    columns are not looked at.
    """
    reach_workers(docs.sparkSession)
    signed = stored(_signatures(docs, shingle_words), "signatures")
    nodes = stored(
        signed.where("node is not null and doc_id is not null")
        .groupBy("node", "check")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    signed, nodes = _told_apart(signed, nodes)
    members = nodes.select(F.posexplode("bands").alias("at", "band"), "node").select((F.col("band") + F.col("at")).alias("key"), "at", "node")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stored(members.join(shared.select("key"), "key"), "buckets")

    def labelled(roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return buckets.withColumn("comp", F.col("node"))
        return stored(buckets.join(roots, "node", "left").select("key", "at", "node", F.coalesce("root", "node").alias("comp")), "labelled")

    links: list[DataFrame] = []
    roots: DataFrame | None = None
    for turn in range(STAR_ROUNDS):
        pairs = stored(_star_pairs(labelled(roots), nodes, turn, percent), "pairs")
        confirmed = stored(_confirmed(pairs, nodes, docs, shingle_words, percent), "links")
        if confirmed.isEmpty():
            break
        links.append(confirmed)
        roots = components(reduce(DataFrame.union, links))
    rest = stored(_cross_pairs(labelled(roots), nodes, docs, shingle_words, percent), "pairs")
    links.append(stored(_confirmed(rest, nodes, docs, shingle_words, percent), "links"))
    roots = components(reduce(DataFrame.union, links))
    # One root may have most nodes: its rows are dealt out, and so are copies of its one result.
    least = nodes.select("node", F.col("doc_id").alias("least_doc"))
    grouped = least.join(roots.union(roots.select("root", "root").distinct()), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    component = grouped.groupBy("root").agg(F.min("least_doc").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = grouped.join(component, ["root", "salt"]).select("node", "component_id").union(least.join(roots.select("node").union(roots.select("root")).distinct(), "node", "left_anti"))
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, whatever these are called.

    Of every group of near copies the rows of its smallest doc_id stay: repeated
    rows of it all do. Rows without doc_id, and those whose text is null, empty or
    without words, are copies of nothing and stay. Texts count whole, however long.
    An empty table gives no row.
    """
    gone = near_duplicates(docs, shingle_words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
