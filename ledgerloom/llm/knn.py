"""Most similar vectors for every vector.

Multi-probe p-stable hashing.  ``tables`` hash tables of ``functions`` Gaussian
projections cut into cells of ``width``; each vector is filed once per table in
its home bucket and looks up its home bucket and the ``probes`` perturbed
buckets that are likeliest to hold a neighbour, in estimated success order (the
distance of its projections to the cell borders).  The candidates of all tables
are merged and reranked by exact cosine in double precision.

Scale:

* Exact copies are one *class*, named by a 64-bit hash of the vector and merged
  with map-side combining, so a vector that makes up a third of all rows is
  hashed and compared once; its members come back at the end, at most ``k``
  pairs each.
* Vectors are shuffled once, by class.  The shuffle by bucket carries a bucket, an
  id and 64 sign bits, which thin the candidates where they meet, before any pair
  is shuffled (a true neighbour stays with close to three standard deviations
  to spare); 128 further bits thin the rest before the few that are left meet
  their vectors.
* The number of functions and tables follows the number of vectors (``sized``),
  so the candidates per vector stay where they are.
* A bucket with more than ``bucket_rows`` filed classes is compared in blocks
  instead of pair by pair: every pair of blocks is one matrix product, and the
  ``k`` best of the rows of both sides leave it, so neither record of a pair
  misses it.  No bucket is capped; in the others an asking row meets at most
  ``bucket_rows`` classes.
* Nothing is collected to the driver or broadcast: the projections are drawn
  from the seed on every executor.

Defined results: a vector is usable if it has exactly ``dim`` finite non-null
numbers that are not all zero and its row is active; others are in no pair.  Of
equally similar neighbours the smaller id counts first.  An id delivered again
is one record (its vector with the smaller hash where they differ).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Hashing:
    """Parameters of the index for collections of up to ``base_rows`` vectors; ``sized`` fits them to larger ones."""

    dim: int = 64
    tables: int = 9
    functions: int = 17
    width: float = 2.4
    probes: int = 2
    seed: int = 20240117
    #: Buckets with more filed classes are compared in blocks.
    bucket_rows: int = 512
    block_rows: int = 4096
    #: Differing bits of the 64 that travel with a bucket row, up to which two rows become a candidate; 64 keeps all.
    row_bits: int = 15
    #: Differing bits of the 128 of the classes up to which a candidate is compared exactly; 128 keeps all.
    sketch_bits: int = 29
    base_rows: int = 500_000
    #: Share of the pairs at a cosine of ``floor_cosine`` that ``sized`` keeps.
    recall: float = 0.96
    floor_cosine: float = 0.93


def found_per_table(h: Hashing, pairs: int = 4000) -> float:
    """The share of pairs at the floor that one table finds, simulated on random directions with the seed."""
    rng = np.random.default_rng(h.seed + 2)
    a, b = rng.normal(size=(2, pairs, h.dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b *= np.sqrt(1 - h.floor_cosine**2) / np.linalg.norm(b, axis=1)[:, None]
    found = []
    one = replace(h, tables=4)
    for (x, px), (y, py) in zip(bucket_keys(a, one), bucket_keys(h.floor_cosine * a + b, one), strict=True):
        found.append((x == y) | (px == y[:, None]).any(1) | (py == x[:, None]).any(1))
    return float(np.mean(found))


def sized(h: Hashing, rows: int) -> Hashing:
    """The parameters for a collection of ``rows`` vectors.

    Two unrelated vectors share a cell of one function with a probability of
    about 0.55, so every factor of 1.8 in the rows takes one more function to
    keep the candidates per vector where they are; the tables follow from the
    recall that is asked for at the floor.
    """
    if rows <= h.base_rows:
        return h
    more = replace(h, functions=h.functions + int(np.ceil(np.log(rows / h.base_rows) / np.log(1.8))))
    return replace(more, tables=int(np.ceil(np.log(1 - h.recall) / np.log(1 - found_per_table(more)))))


def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` perturbation sets in order of expected success.

    Ranks 1..2M order the distances to the cell borders; rank j and rank
    2M+1-j are the two borders of one function and exclude each other.  A set's
    score is the sum of the expected squared distances.
    """
    m = functions
    j = np.arange(1, 2 * m + 1, dtype=float)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    mirrored = 2 * m + 1 - j
    high = 1 - mirrored / (m + 1) + mirrored * (mirrored + 1) / (4 * (m + 1) * (m + 2))
    z = np.where(j <= m, low, high)
    heap: list[tuple[float, tuple[int, ...]]] = [(z[0], (1,))]
    found: list[tuple[int, ...]] = []
    while heap and len(found) < probes:
        score, ranks = heapq.heappop(heap)
        if all(2 * m + 1 - r not in ranks for r in ranks):
            found.append(ranks)
        top = ranks[-1]
        if top < 2 * m:
            heapq.heappush(heap, (score - z[top - 1] + z[top], (*ranks[:-1], top + 1)))
            heapq.heappush(heap, (score + z[top], (*ranks, top + 1)))
    return found


def bucket_keys(unit: np.ndarray, h: Hashing) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per table the home key of every row and its probe keys (rows, probes)."""
    rng = np.random.default_rng(h.seed)
    sets = perturbations(h.functions, h.probes)
    for _ in range(h.tables):
        directions = rng.normal(size=(h.dim, h.functions))
        shift = rng.uniform(0, h.width, h.functions)
        mix = rng.integers(1, 2**62, h.functions, dtype=np.int64) * 2 + 1
        salt = rng.integers(-(2**62), 2**62, dtype=np.int64)
        place = (unit @ directions + shift) / h.width
        cell = np.floor(place).astype(np.int64)
        home = (cell * mix).sum(1) + salt
        inside = place - cell
        # step -1 over the lower border, +1 over the upper one
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1)
        step = np.concatenate([-mix, mix])
        probes = np.empty((len(unit), len(sets)), dtype=np.int64)
        for i, ranks in enumerate(sets):
            probes[:, i] = home + step[order[:, np.array(ranks) - 1]].sum(1)
        yield home, probes


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list<float> column without nulls as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(vectors: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """(id, hash, vec) of every usable row: hash of the vector, vec its numbers; a record delivered again has several."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<float>").alias("vec"))
    good = F.col("id").isNotNull() & (F.size("vec") == dim) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    return rows.filter(good).select("id", F.xxhash64("vec").alias("hash"), "vec")


def signs(unit: np.ndarray, seed: int, words: int) -> np.ndarray:
    """The signs of 64 random projections a word, as (rows, words) of int64."""
    directions = np.random.default_rng(seed).normal(size=(unit.shape[1], 64 * words))
    return np.packbits(unit @ directions > 0, axis=1).view("<i8")


def sketches(classes: DataFrame, h: Hashing) -> DataFrame:
    """(class, s0, s1): the signs of 128 random projections."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = signs(matrix(batch.column(1), h.dim), h.seed + 1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1]))], ["class", "s0", "s1"])

    return classes.select("class", "vec").mapInArrow(scan, "class bigint, s0 bigint, s1 bigint")


def thinned(pairs: DataFrame, classes: DataFrame, h: Hashing) -> DataFrame:
    """The pairs whose sketches differ in at most ``sketch_bits`` bits."""
    if h.sketch_bits >= 128:
        return pairs
    s = sketches(classes, h)
    both = pairs.join(s.select(F.col("class").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1")), "a").join(s.select(F.col("class").alias("b"), "s0", "s1"), "b")
    differ = F.bit_count(F.col("a0").bitwiseXOR(F.col("s0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("s1")))
    return both.filter(differ <= h.sketch_bits).select("a", "b")


def bucket_rows(classes: DataFrame, h: Hashing, home: bool) -> DataFrame:
    """(key, class, sketch): the home bucket of every class in every table, or its probe buckets, with 64 sign bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = matrix(batch.column(1), h.dim)
            unit /= np.linalg.norm(unit, axis=1)[:, None]
            ids = batch.column(0).to_numpy()
            sketch = np.ascontiguousarray(signs(unit, h.seed + 3, 1)[:, 0])
            for own, probes in bucket_keys(unit, h):
                n = 1 if home else probes.shape[1]
                key = own if home else probes.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(ids, n)), pa.array(np.repeat(sketch, n))], ["key", "class", "sketch"])

    # stated here because the joins infer it, and an exchange is only shared by equal plans
    return classes.select("class", "vec").mapInArrow(scan, "key bigint, class bigint, sketch bigint").filter("key IS NOT NULL AND class IS NOT NULL AND sketch IS NOT NULL")


def exact_cosine(pairs: DataFrame, classes: DataFrame, dim: int) -> DataFrame:
    """Pairs (a, b) with their cosine in double precision."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column(2), dim), matrix(batch.column(3), dim)
            cosine = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], ["a", "b", "cosine"])

    left = classes.select(F.col("class").alias("a"), F.col("vec").alias("va"))
    right = classes.select(F.col("class").alias("b"), F.col("vec").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    return both.mapInArrow(scan, "a bigint, b bigint, cosine double")


def rows_counted() -> Column:
    """A count of bucket rows that reads all their columns: an exchange is only shared by equal plans."""
    return F.count_if(F.pmod(F.col("class").bitwiseXOR(F.col("sketch")), F.lit(2)) < 2)


def kth_best(c: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The k-th largest value along an axis, the smallest where there are fewer, less what equal products may differ by."""
    at = max(c.shape[axis] - k, 0)
    return np.take(np.partition(c, at, axis=axis), at, axis=axis) - 1e-12


def blocked_pairs(filed: DataFrame, asked: DataFrame, hot: DataFrame, classes: DataFrame, h: Hashing, k: int, floor: float) -> DataFrame:
    """Pairs (a, b, cosine) inside hot buckets: for the rows of either side of a block pair the ``k`` best of at least ``floor``.

    A bucket with n filed (``hot``: key, n) and m asking classes is cut into
    ceil(n / block_rows) times ceil(m / block_rows) block pairs, independent
    groups of bounded size.
    """
    part = lambda n: F.ceil(F.col(n) / h.block_rows).cast("int")
    own = lambda n: F.pmod(F.xxhash64("class", "sketch"), part(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), part(n) - 1))
    asks = asked.join(hot, "key").groupBy("key").agg(rows_counted().alias("asks"))
    # filed classes ask at home too
    sizes = hot.join(asks, "key", "left").select("key", "n", (F.col("n") + F.coalesce("asks", F.lit(0))).alias("m"))
    inside = filed.join(sizes, "key").join(classes, "class")
    outside = asked.join(sizes, "key").join(classes, "class")
    filing = inside.select("key", own("n").alias("i"), "class", "vec", every("m").alias("j"), F.lit(True).alias("home"))
    asking = inside.unionByName(outside).select("key", own("m").alias("j"), "class", "vec", every("n").alias("i"), F.lit(False).alias("home")).select("key", "i", "class", "vec", "j", "home")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        def side(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            m = np.stack(part["vec"].to_list()).astype(np.float64)
            return part["class"].to_numpy(), m / np.linalg.norm(m, axis=1)[:, None]

        x, y = pdf[~pdf["home"]], pdf[pdf["home"]]
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        (a, xm), (b, ym) = side(x), side(y)
        found = []
        for s in range(0, len(a), 1024):
            c = xm[s : s + 1024] @ ym.T
            c[a[s : s + 1024][:, None] == b[None, :]] = -2
            # the best of either side leave, as a pair may be needed by one of its records alone;
            # every neighbour as similar as the k-th stays, so ties are settled later
            by_row = kth_best(c, k, 1)
            by_col = kth_best(c, k, 0)
            row, col = np.nonzero(((c >= by_row[:, None]) | (c >= by_col[None, :])) & (c >= floor))
            found.append(pd.DataFrame({"a": a[s + row], "b": b[col], "cosine": c[row, col]}))
        return pd.concat(found)

    return filing.unionByName(asking).groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint, cosine double")


def class_neighbours(classes: DataFrame, live: DataFrame, h: Hashing, k: int, floor: float) -> DataFrame:
    """Neighbours (a, b, cosine), both ways, among the ``live`` classes with cosine of at least ``floor``."""
    filed, asked = bucket_rows(classes, h, True), bucket_rows(classes, h, False)
    # counted in a window, so that all uses share the exchange of the bucket rows themselves
    counted = filed.withColumn("n", F.count("class").over(Window.partitionBy("key")))
    open_buckets = counted.filter(F.col("n") <= h.bucket_rows)
    hot = counted.filter(F.col("n") > h.bucket_rows).groupBy("key").agg(rows_counted().alias("n")).filter(F.col("n") > h.bucket_rows)
    there = open_buckets.select("key", F.col("class").alias("b"), F.col("sketch").alias("t"))
    alike = F.bit_count(F.col("sketch").bitwiseXOR(F.col("t"))) <= h.row_bits
    at_home = open_buckets.select("key", F.col("class").alias("a"), "sketch").join(there, "key").filter("a < b").filter(alike)
    probed = asked.join(there, "key").filter("class <> b").filter(alike)
    pairs = at_home.select("a", "b").unionByName(probed.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")))
    few = thinned(pairs, classes, h).distinct()
    near = exact_cosine(few, classes, h.dim).filter(F.col("cosine") >= floor).unionByName(blocked_pairs(filed, asked, hot, classes.join(live, "class", "left_semi"), h, k, floor))
    both_ways = F.inline(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")))
    found = near.select(both_ways).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return found.join(live.select(F.col("class").alias("b")), "b", "left_semi").join(live.select(F.col("class").alias("a")), "a", "left_semi")


def similar_pairs(vectors: DataFrame, id_column: str, vector_column: str, k: int = 5, floor: float = 0.93, h: Hashing = Hashing()) -> DataFrame:
    """Pairs of records with cosine of at least ``floor``, one being among the ``k`` most similar of the other.

    Columns: id_1, id_2 (the smaller first), cosine.

    Neighbours below the floor cannot displace one above it, so ranks among the
    neighbours of at least ``floor`` are ranks among all.  Counting the vectors,
    which the parameters follow, is a job that runs while the plan is built.
    """
    h = sized(h, vectors.count())
    rows = usable(vectors, id_column, vector_column, h.dim)
    members = rows.groupBy("id").agg(F.min("hash").alias("class"))
    # no join stands before the exchanges that are to be shared
    classes = rows.groupBy(F.col("hash").alias("class")).agg(F.first("vec").alias("vec"))
    live = members.select("class").distinct()
    # a class enters a neighbour list with at most its k + 1 smallest ids
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("r") <= k + 1)
    near = class_neighbours(classes, live, h, k, floor).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b")))
    # copies of the k-th neighbour's similarity could only lose to it by id: keep ties
    cut = near.withColumn("cut", F.min(F.when(F.col("r") <= k, F.col("cosine"))).over(Window.partitionBy("a"))).filter(F.col("cosine") >= F.col("cut"))
    copies = first.filter("r = 2").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("cosine"))
    listed = (
        cut.select("a", "b", "cosine")
        .unionByName(copies)
        .join(first.select(F.col("class").alias("b"), "id"), "b")
        .withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "id")))
        .filter(F.col("r") <= k + 1)
        .groupBy("a")
        .agg(F.array_sort(F.collect_list(F.struct("r", "id", "cosine"))).alias("near"))
    )
    joined = members.join(listed, F.col("class") == F.col("a")).select("id", F.explode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("x"))
    return joined.groupBy(F.least("id", "x.id").alias("id_1"), F.greatest("id", "x.id").alias("id_2")).agg(F.max("x.cosine").alias("cosine"))


#: Rows of a block of queries and of a block of vectors in the exact search.
QUERY_BLOCK, VECTOR_BLOCK = 8192, 32_768


def top_k_search(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int = 5, dim: int = 64) -> DataFrame:
    """The exact k most similar other records of a stated set of query ids: id, rank, neighbour, cosine.

    Queries and vectors are cut into blocks of bounded size by a hash of their
    ids; every pair of blocks is one group, a matrix product in one task that
    keeps k neighbours a query.  Nothing goes through the driver but the two
    counts that fix the number of blocks (jobs that run while the plan is
    built).  For neighbours at any distance this replaces hashing, which would
    have to visit most buckets to find them; it is quadratic in the collection
    at a fixed share of queries.
    """
    rows = usable(vectors, id_column, vector_column, dim).groupBy("id").agg(F.min_by("vec", "hash").alias("vec"))
    asking = queries.select(F.col(id_column).cast("bigint").alias("id")).distinct()
    across, down = (max(1, -(-df.count() // size)) for df, size in ((vectors, VECTOR_BLOCK), (asking, QUERY_BLOCK)))
    place = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.join(asking, "id", "left_semi").select("id", "vec", place(1, down).alias("i"), every(across).alias("j"))
    right = rows.select(F.col("id").alias("other"), F.col("vec").alias("other_vec"), place(2, across).alias("j"), every(down).alias("i"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_block_search(k, dim), "a bigint, b bigint, cosine double")
    # equal vectors may differ in the last digit of their products
    w = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 12)), "b")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("a").alias("id"), "rank", F.col("b").alias("neighbour"), "cosine")


def _block_search(k: int, dim: int):
    def search(asking: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        def side(part: pd.DataFrame, name: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
            part = part.sort_values(name)
            m = np.stack(part[vec].to_list()).astype(np.float64)
            return part[name].to_numpy(), m / np.linalg.norm(m, axis=1)[:, None]

        found = [pd.DataFrame({"a": [], "b": [], "cosine": []})]
        if len(asking) and len(others):
            (ids, unit), (names, x) = side(asking, "id", "vec"), side(others, "other", "other_vec")
            for s in range(0, len(ids), 512):
                mine = ids[s : s + 512]
                c = unit[s : s + 512] @ x.T
                # a record is not its own neighbour
                at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                own = np.nonzero(names[at] == mine)[0]
                c[own, at[own]] = -2
                # every neighbour as similar as the k-th stays, ties are settled by id later
                least = kth_best(c, k, 1)
                row, col = np.nonzero((c >= least[:, None]) & (c > -2))
                found.append(pd.DataFrame({"a": mine[row], "b": names[col], "cosine": c[row, col]}))
        return pd.concat(found)

    return search
