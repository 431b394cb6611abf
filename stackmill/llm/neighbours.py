"""The most similar vectors of every vector, by counting collisions of single projections.

A random direction is one hash function: the projections of all rows on it are kept as a sorted array, a query's window is
centred on its own projection, and every row whose position falls between the ends of the window collides with the
query. Rows that collide on enough of the projections are verified with their exact cosine. Windows are widened on the
same arrays (virtual rehashing) for the queries that have not found k neighbours yet.

A window over a whole collection would hold a fixed share of its rows, and all queries together would cost its square.
The rows are therefore routed first, to the upper ends of the sorted arrays of many directions: a vector belongs to the few
directions on which its projection is largest. Directions are sums of two, one out of each of two small bases, so that
their number grows with the rows and the work of routing a row with its square root only. Arrays are then sorted, and
collisions counted, among the rows of one direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.session import tasks

#: Rows of a collection whose arrays are sorted whole, without routing, and rows aimed at for each direction beyond.
WHOLE, PER_DIRECTION = 8192, 512
#: Rows whose arrays one task sorts at once; a larger group is cut into blocks whose pairs go to different tasks.
BLOCK = 8192
#: Directions of the first base from which on a second one is used.
FIRST_BASE = 256
#: Rows that are routed at once, so that the memory of a task doesn't depend on the batches that it gets.
ROUTED = 2048


def usable(vector: Column, dim: int) -> Column:
    """True for a vector of `dim` finite numbers that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(count: int, dim: int, seed: int) -> np.ndarray:
    """`count` unit vectors out of random orthogonal bases, each with its opposite; the same for the same seed."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-count // (2 * dim)))]
    both = np.concatenate([np.concatenate([b, -b]) for b in bases])
    return both[rng.permutation(len(both))[:count]].astype("f4")


def plan_of(rows: int) -> tuple[int, int, int]:
    """Directions in each of two bases for a collection of so many rows, and to how many of their sums a vector is routed.

    A second base is used once the first one is large enough to span all dimensions several times.
    """
    if rows <= WHOLE:
        return 1, 1, 1
    count = 1 << int(np.ceil(np.log2(rows / PER_DIRECTION)))
    first = min(count, max(FIRST_BASE, int(np.ceil(np.sqrt(count)))))
    return first, -(-count // first), max(4, round(np.log2(count) / 2) + 2)


def _unit(blobs: pd.Series, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), dtype="<f4").reshape(-1, dim).astype("f8")
    v /= np.abs(v).max(axis=1, keepdims=True)  # neither very large nor very small numbers lose their direction
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def routes(x: np.ndarray, bases: list[np.ndarray], keep: int) -> np.ndarray:
    """For each row the numbers, in order, of the `keep` sums of a direction out of each base on which it has its largest projections."""
    sums, codes = np.zeros((len(x), 1), dtype="f4"), np.zeros((len(x), 1), dtype=np.int64)
    for base in bases:
        h = x @ base.T
        best = min(keep, len(base))  # the largest sums are made of the largest parts
        at = np.argpartition(-h, best - 1, axis=1)[:, :best]
        sums = (sums[:, :, None] + np.take_along_axis(h, at, axis=1)[:, None, :]).reshape(len(x), -1)
        codes = (codes[:, :, None] * len(base) + at[:, None, :]).reshape(len(x), -1)
    top = np.argpartition(-sums, keep - 1, axis=1)[:, :keep]
    return np.sort(np.take_along_axis(codes, top, axis=1), axis=1)


def _route(batches: Iterator[pd.DataFrame], rows_of: dict, centre: dict, dim: int, seed: int) -> Iterator[pd.DataFrame]:
    made: dict[tuple[int, int], list[np.ndarray]] = {}
    for whole in batches:
        for begin in range(0, len(whole), ROUTED):
            pdf = whole.iloc[begin : begin + ROUTED].reset_index(drop=True)
            raw = np.stack(pdf["vector"].to_numpy()).astype("<f4")
            out = pd.DataFrame({"collection": pdf["collection"], "id": pdf["id"], "copies": pdf["copies"], "v": [x.tobytes() for x in raw]})
            codes = np.empty(len(pdf), dtype=object)
            for name, at in pdf.groupby("collection", dropna=False, sort=False).indices.items():
                name = None if pd.isna(name) else name
                first, second, keep = plan_of(rows_of.get(name, 0))
                if first == 1:
                    for i in at:
                        codes[i] = [0]
                    continue
                if (first, second) not in made:
                    made[first, second] = [directions(n, dim, seed + 100 * k) for k, n in enumerate((first, second)) if k == 0 or n > 1]
                x = (_unit(out["v"].iloc[at], dim) - centre[name]).astype("f4")
                for i, c in zip(at, routes(x, made[first, second], keep)):
                    codes[i] = c.tolist()
            yield out.assign(codes=codes)


def _window_bits(array: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each window [low, high] on a projection, a bitmap of the rows inside: the rows before its end in the sorted array, without those before its start."""
    n = len(array)
    order = np.argsort(array, kind="stable")
    before = np.zeros((n + 1, -(-n // 64)), dtype=np.uint64)
    before[np.arange(1, n + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
    np.bitwise_xor.accumulate(before, axis=0, out=before)
    sorted_ = array[order]
    return before[np.searchsorted(sorted_, high, side="right")] ^ before[np.searchsorted(sorted_, low, side="left")]


def _collisions(h: np.ndarray, rows: np.ndarray, reach: float, least: int, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other) that collide on at least `least` projections, the others from `first` on and before `end`."""
    if not len(rows) or end <= first:
        return
    digits: list[np.ndarray] = []  # the binary digits of the counts, a bitmap each
    for p in h:
        carry = _window_bits(p[first:end], p[rows] - reach, p[rows] + reach)
        for d in digits:
            over = d & carry
            d ^= carry
            carry = over
        if len(digits) < int(len(h)).bit_length():
            digits.append(carry)
    above, equal = np.zeros_like(digits[0]), np.full_like(digits[0], ~np.uint64(0))
    for k in range(max(len(digits), int(least).bit_length()) - 1, -1, -1):
        d = digits[k] if k < len(digits) else np.zeros_like(above)
        if least >> k & 1:
            equal &= d
        else:
            above |= equal & d
            equal &= ~d
    enough = above | equal
    for at in range(0, len(rows), 1024):
        part = enough[at : at + 1024]
        q, w = np.nonzero(part)
        bits = np.unpackbits(part[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, b = np.nonzero(bits)
        others = w[i] * 64 + b
        inside = others < end - first
        yield rows[at + q[i][inside]], others[inside] + first


def collided(v: np.ndarray, k: int, least_cosine: float, projections: int, seed: int, split: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, cosine) of the k most similar others of each row; with `split`, rows before it meet only rows from it on, and the other way round."""
    n, dim = v.shape
    v4 = v.astype("f4")
    h = (directions(2 * dim, dim, seed + 1)[:projections] @ v4.T).copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_rows = np.arange(n)
    widest = np.sqrt(2 - 2 * least_cosine)
    chance = 0.683  # a pair at the radius of a window collides on a projection so often; two deviations below are still taken
    least = max(1, int(len(h) * chance - 2 * np.sqrt(len(h) * chance * (1 - chance))))
    for radius in (widest / 2, widest):
        groups = [(open_rows, 0, n)] if not split else [(open_rows[open_rows < split], split, n), (open_rows[open_rows >= split], 0, split)]
        rows, others, cosines = [], [], []
        for q, lo, hi in groups:
            for i, j in _collisions(h, q, radius / np.sqrt(dim), least, lo, hi):
                i, j = i[i != j], j[i != j]
                for a in range(0, len(i), 1 << 18):
                    x, y = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
                    rough = np.einsum("ij,ij->i", v4[x], v4[y])
                    x, y = x[ok := rough > 1 - radius**2 / 2 - 1e-4], y[ok]
                    exact = np.einsum("ij,ij->i", v[x], v[y])
                    ok = exact >= max(least_cosine, 1 - radius**2 / 2)
                    rows.append(x[ok]), others.append(y[ok]), cosines.append(exact[ok])
        i, j, c = (np.concatenate([*x, np.empty(0, dtype=t)]) for x, t in ((rows, int), (others, int), (cosines, float)))
        order = np.lexsort((j, -c, i))
        i, j, c = i[order], j[order], c[order]
        counts = np.bincount(i, minlength=n)
        rank = np.arange(len(i)) - (np.cumsum(counts) - counts)[i]
        last = radius == widest
        keep = (rank < k) & (last | (counts[i] >= k))
        found.append((i[keep], j[keep], c[keep]))
        open_rows = open_rows[counts[open_rows] < k]
    return tuple(np.concatenate(x) for x in zip(*found))


def _compare(pdf: pd.DataFrame, k: int, least_cosine: float, dim: int, projections: int, seed: int) -> pd.DataFrame:
    one, two = pdf["one"].iloc[0], pdf["two"].iloc[0]
    pdf = pdf.sort_values(["mine", "id"]) if one != two else pdf
    code, ids, copies = pdf["code"].iloc[0], pdf["id"].to_numpy(), pdf["copies"].to_numpy()
    i, j, c = collided(_unit(pdf["v"], dim), k, least_cosine, projections, seed, int((pdf["mine"] == one).sum()) if one != two else 0)
    if pdf["codes"].map(len).max() > 1:  # a pair counts in the first of the windows that it shares
        codes = np.stack(pdf["codes"].to_numpy())
        shared = np.where((codes[i][:, :, None] == codes[j][:, None, :]).any(2), codes[i], np.iinfo(np.int32).max).min(axis=1)
        i, j, c = i[shared == code], j[shared == code], c[shared == code]
    return pd.DataFrame({"a": ids[i], "b": ids[j], "cosine": c, "a_copies": copies[i], "b_copies": copies[j]})


def nearest(points: DataFrame, k: int = 5, least_cosine: float = 0.85, dim: int = 64, projections: int = 48, seed: int = 7,
            key: str = "point_id", vector: str = "vector", part: str = "collection") -> DataFrame:
    """The k most similar other rows of each row, within its `part`.

    Returns id, neighbour, cosine and rank (from 1; cosine falling, then neighbour). Cosines below `least_cosine` don't
    count. The index holds every row; its recall on clustered vectors is above 0.99 (README). Left out are rows
    with a null key, and rows whose vector is null, has another number of dimensions than `dim`, holds a null, NaN or
    infinite number or is all zero. Repeated rows count once; a key with several vectors has the best of their cosines.
    Rows of a null part are a part of their own. Equal vectors are compared once, and each of them still gets its own
    neighbours, with the smallest keys where they are alike. Other columns are ignored.
    """
    spark = points.sparkSession
    rows = points.select(F.col(key).alias("id"), F.col(part).alias("collection"), F.col(vector).cast("array<float>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"), dim))
    # one row for each different vector; a hot group of copies is combined before the shuffle
    groups = rows.groupBy("collection", "vector").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("copies"))

    # one row for each collection: its size and its mean direction on a sample bounded to 1/64 of the rows
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sizes = {r[0]: r[1] for r in rows.groupBy("collection").count().collect()}
    large = [c for c, n in sizes.items() if n > WHOLE and c is not None]
    centre = {c: np.zeros(dim) for c in sizes}
    if large or sizes.get(None, 0) > WHOLE:
        part_of = rows.where((F.col("collection").isin(large) | F.col("collection").isNull()) & (F.pmod(F.xxhash64("id"), F.lit(64)) == 0))
        mean = part_of.select("collection", F.transform("vector", lambda x: x / norm).alias("u")).groupBy("collection").agg(*[F.avg(F.col("u")[i]).alias(f"m{i}") for i in range(dim)])
        centre |= {r[0]: np.array(r[1:], dtype="f8") for r in mean.collect()}

    route, routed = partial(_route, rows_of=sizes, centre=centre, dim=dim, seed=seed), "collection string, id string, copies boolean, v binary, codes array<int>"
    placed = groups.mapInPandas(route, routed).select("*", F.explode("codes").alias("code"))
    hot = {}
    if any(n > BLOCK for n in sizes.values()):  # windows with more rows than one task compares, counted before vectors are moved
        filled = rows.withColumn("copies", F.lit(False)).mapInPandas(route, routed).select("collection", F.explode("codes").alias("code")).groupBy("collection", "code").count()
        hot = {(r[0], r[1]): -(-r[2] // BLOCK) for r in filled.where(F.col("count") > BLOCK).collect()}
    if hot:
        blocks = spark.createDataFrame([(c, d, n) for (c, d), n in hot.items()], "c string, d int, blocks int")
        placed = placed.join(F.broadcast(blocks), F.col("collection").eqNullSafe(F.col("c")) & (F.col("code") == F.col("d")), "left").drop("c", "d")
        placed = placed.withColumn("mine", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
        placed = placed.select("collection", "id", "copies", "v", "codes", "code", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    else:
        placed = placed.select("*", F.lit(0).alias("mine"), F.lit(0).alias("one"), F.lit(0).alias("two"))
    by = ["collection", "code", "one", "two"]
    pairs = placed.repartition(tasks(spark), *by).groupBy(*by).applyInPandas(
        lambda pdf: _compare(pdf, k, least_cosine, dim, projections, seed),
        "a string, b string, cosine double, a_copies boolean, b_copies boolean").persist(StorageLevel.MEMORY_AND_DISK)  # read twice below

    # copies: every member of a group of equal vectors, and the k + 1 smallest keys that stand for it to others
    prints = [F.xxhash64("collection", "vector").alias("h1"), F.xxhash64(F.lit(1), "collection", "vector").alias("h2")]  # 128 bits stand for a vector
    printed = rows.select(F.col("id").alias("member"), *prints)
    twins = printed.groupBy("h1", "h2").agg(F.min("member").alias("rep"), F.max("member").alias("last")).where("rep <> last").drop("last")
    members = printed.join(twins, ["h1", "h2"]).select("rep", "member").distinct()
    heads = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).where(F.col("n") <= k + 1).select("rep", F.col("member").alias("head"))
    plain = pairs.where(~F.col("a_copies") & ~F.col("b_copies")).select("a", "b", "cosine")
    mixed = pairs.where(F.col("a_copies") | F.col("b_copies")).select("a", "b", "cosine")
    mixed = mixed.unionByName(heads.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct().withColumn("cosine", F.lit(1.0)))
    mixed = mixed.join(heads, F.col("b") == F.col("rep"), "left").select("a", F.coalesce("head", "b").alias("b"), "cosine")
    best = mixed.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("n") <= k + 1)
    mixed = best.join(members, F.col("a") == F.col("rep"), "left").select(F.coalesce("member", "a").alias("a"), "b", "cosine")
    every = plain.unionByName(mixed).where(F.col("a") != F.col("b"))
    ranked = every.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine", F.col("rank").cast("bigint").alias("rank"))


def pairs_of(neighbours: DataFrame) -> DataFrame:
    """Each pair of which one has the other among its neighbours, once, the smaller key first."""
    return neighbours.select(F.least("id", "neighbour").alias("point_lo"), F.greatest("id", "neighbour").alias("point_hi")).distinct()
