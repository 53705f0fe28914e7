"""Work on all pairs or all rows of vector sets by blocks, and a truncated SVD of TF-IDF.

Rows are sparse or dense vectors in a distributed table; what the driver holds is bounded by the vocabulary and the number of
components, never by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import stash

#: Words of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Columns beside the wanted ones in the range finder, and slices in which its sums are shuffled.
OVERSAMPLE, SLICES = 20, 32
#: Terms up to which the products of all pairs of terms are summed, once (134 MB); with more, each round passes over the rows.
PAIRED = 4_096


def limited_tfidf(docs: DataFrame, max_terms: int = 3_000, text: str = "text") -> DataFrame:
    """V08. (id, term, weight): TF-IDF over the ``max_terms`` most frequent terms (ties by term), tf * (ln((1 + n) / (1 + df)) + 1),
    L2-normalised in each document. Documents without such a term have no row."""
    words = docs.select("id", F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term"))
    tf = stash(words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    n = docs.count()
    per = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = stash(per.orderBy(F.desc("total"), "term").limit(max_terms).select("term", (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1).alias("idf")), "terms")
    # at most max_terms rows are broadcast
    w = tf.join(F.broadcast(kept), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    size = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s"))
    return w.join(size, "id").select("id", "term", (F.col("w") / F.col("s")).alias("weight"))


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, columns and values of a batch of (cols, vals) lists."""
    cols = batch.column("cols")
    n = np.diff(np.asarray(cols.offsets, dtype=np.int64))
    return np.repeat(np.arange(len(n)), n), np.asarray(cols.flatten(), dtype=np.int64), np.asarray(batch.column("vals").flatten(), dtype=np.float64)


def _times(batch: pa.RecordBatch, right: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The batch's rows times ``right``, summed run by run."""
    rows, cols, vals = entries = _sparse(batch)
    out = np.zeros((batch.num_rows, right.shape[1]))
    for s in range(0, len(rows), 50_000):  # about 130 MB of products for 320 columns
        part = slice(s, s + 50_000)
        at, starts = np.unique(rows[part], return_index=True)
        out[at] += np.add.reduceat(right[cols[part]] * vals[part, None], starts, axis=0) if len(at) else 0
    return out, entries


def _gram_times(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """A' (A right) for the sparse rows A: each task sums its rows' part, the parts are added slice by slice of terms."""
    terms, width = right.shape
    shared = rows.sparkSession.sparkContext.broadcast(right)
    step = -(-terms // SLICES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, width))
        right = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 2_000):
                part = batch.slice(s, 2_000)
                product, (at, cols, vals) = _times(part, right)
                order = np.argsort(cols, kind="stable")
                for t in range(0, len(order), 50_000):
                    o = order[t : t + 50_000]
                    col, starts = np.unique(cols[o], return_index=True)
                    total[col] += np.add.reduceat(product[at[o]] * vals[o, None], starts, axis=0)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": [total[i * step : (i + 1) * step].tobytes() for i in range(SLICES)]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("part").to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(part)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(held), pa.int32()), "part": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    parts = rows.select("cols", "vals").mapInArrow(partial, "slice int, part binary").repartition(SLICES, "slice").mapInArrow(added, "slice int, part binary").collect()
    shared.unpersist()
    out = np.concatenate([np.frombuffer(r["part"]) for r in sorted(parts, key=lambda r: r["slice"])])
    return out.reshape(-1, width)


def _gram(rows: DataFrame, terms: int) -> np.ndarray:
    """A'A for the sparse rows A in one pass: each task sums its rows' part, the parts are added slice by slice of terms, of
    which a slice holds the columns from its own on."""
    step = -(-terms // SLICES)
    bounds = [(s, min(s + step, terms)) for s in range(0, terms, step)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in range(0, batch.num_rows, 1_000):
                part = batch.slice(s, 1_000)
                at, cols, vals = _sparse(part)
                dense = np.zeros((part.num_rows, terms))
                dense[at, cols] = vals
                if total is None:
                    total = np.zeros((terms, terms))
                total += dense.T @ dense
        if total is not None:
            for i, (a, b) in enumerate(bounds):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "part": [total[a:b, a:].tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(part.as_buffer())
        for i, v in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "part": pa.array([v.tobytes()], pa.binary())})

    parts = rows.select("cols", "vals").mapInArrow(partial, "slice int, part binary").repartition(SLICES, "slice").mapInArrow(added, "slice int, part binary")
    out = np.zeros((terms, terms))
    for r in parts.collect():
        a, b = bounds[r["slice"]]
        own = np.frombuffer(r["part"]).reshape(b - a, terms - a)
        out[a:b, a:] = own
        out[a:, a:b] = own.T
    return out


def tfidf_svd(docs: DataFrame, width: int = 300, max_terms: int = 3_000, rounds: int = 12, tol: float = 1e-10, seed: int = 0, text: str = "text") -> tuple[DataFrame, list[float]]:
    """V08. ((id, x), singular values): documents as L2-normalised rows of the truncated SVD of their TF-IDF table.

    Randomised subspace iteration: a seeded normal matrix (terms x width + 20) is multiplied by the table and its transpose,
    orthonormalised, and again, until the squared singular values change by less than ``tol`` of the largest, in at most ``rounds`` rounds;
    their last change is then all that may be missing. Up to ``PAIRED`` terms the table's product with its transpose is summed once in the tasks and the driver holds
    terms x terms numbers; with more, each round passes over the rows and the driver holds terms x (width + 20). Where the table has fewer than
    ``width`` singular values above 1e-7 of the largest, the others and their part of x are zeros. The sign of a component makes its largest loading
    positive. Documents without a known term, null and empty texts have a zero vector."""
    docs = docs.select("id", F.col(text).alias("text"))
    w = stash(limited_tfidf(docs, max_terms), "tfidf")
    names = sorted(r["term"] for r in w.select("term").distinct().toLocalIterator())  # max_terms at most
    number = docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(names)], "term string, col int")
    entries = F.array_sort(F.collect_list(F.struct("col", "weight")))  # a document has max_terms entries at most
    rows = stash(w.join(F.broadcast(number), "term").groupBy("id").agg(entries.alias("e")).select("id", F.col("e.col").alias("cols"), F.col("e.weight").alias("vals")), "rows")
    zero = [0.0] * width
    if not names:
        return docs.select("id", F.lit(zero).cast("array<double>").alias("x")), zero
    cols = min(len(names), width + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(names), cols)))[0]
    gram = _gram(rows, len(names)) if len(names) <= PAIRED else None
    last = None
    for _ in range(rounds):
        z = _gram_times(rows, q) if gram is None else gram @ q
        values, turn = np.linalg.eigh((t := q.T @ z) / 2 + t.T / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis = q @ turn
        if last is not None and np.abs(values - last).max() <= tol * max(values[0], 1e-300):
            break
        last = values
        q = np.linalg.qr(z)[0]
    singular = np.sqrt(np.maximum(values, 0))[:width]
    basis = basis[:, :width]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])])
    singular = np.where(singular > singular[0] * 1e-7, singular, 0.0)  # squares do not tell less from nothing
    basis = basis * (singular > 0)
    basis = np.pad(basis, ((0, 0), (0, width - basis.shape[1])))
    shared = docs.sparkSession.sparkContext.broadcast(basis)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2_000):
                part = batch.slice(s, 2_000)
                y, _ = _times(part, shared.value)
                y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * width, y.ravel())], names=["id", "x"])

    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(project, f"id {id_type}, x array<double>")
    rest = docs.join(rows.select("id"), "id", "left_anti").select("id", F.lit(zero).cast("array<double>").alias("x"))
    return found.unionByName(rest), [*map(float, singular), *zero[len(singular):]]


# ---- all pairs of two sets of vectors ----


#: Pairs whose values a task works on at once, few enough for the processor's cache.
AT_ONCE = 1 << 17
#: Rows of either side of a tile, whose pairs a task works on at once; few enough for the processor's cache.
TILE = 256
#: Vectors in one packed row, and numbers that a task packs before it writes them.
PACK_ROWS, PACK_NUMBERS = 1_024, 1 << 22


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of the column x, which are there and of one length."""
    lists = batch.column("x")
    if lists.null_count or pc.min_max(sizes := pc.list_value_length(lists))["min"] != pc.min_max(sizes)["max"]:
        raise ValueError("a vector is null, or vectors differ in length")
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _packed(x: DataFrame, blocks: int) -> DataFrame:
    """(block, n, dim, v): the vectors of (id, x) dealt into ``blocks`` by the id, in rows of up to ``PACK_ROWS`` vectors as bytes, in single
    precision where that is exact. Copies of a packed row for each block of the other side are copies of bytes, not a row for each vector."""
    of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            at, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            order = np.argsort(at, kind="stable")
            at, v = at[order], v[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                for s in range(0, len(part), PACK_ROWS):
                    some = v[part[s] : part[min(s + PACK_ROWS, len(part)) - 1] + 1]
                    with np.errstate(all="ignore"):
                        single = some.astype(np.float32)
                    exact = single.astype(np.float64).tobytes() == some.tobytes()
                    row = [[int(at[part[0]])], [some.shape[0]], [some.shape[1]], [(single if exact else some).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=["block", "n", "dim", "v"])

        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch)
                if held and held[-1][1].shape[1] != v.shape[1]:
                    raise ValueError("vectors of different lengths")
                held.append((batch.column("block").to_numpy(), v))
                if sum(h[1].size for h in held) >= PACK_NUMBERS:
                    yield from flush()
        if held:
            yield from flush()

    return x.select(of.alias("block"), "x").mapInArrow(pack, "block int, n int, dim int, v binary")


def _block_pairs(a: DataFrame, b: DataFrame, block_rows: int, run, ready=lambda x, y: (x, y)) -> DataFrame:
    """``run(left, right)`` of tiles of the matrices of every two blocks of the sets: (s, n), a sum over their pairs and the number of pairs.
    ``ready`` makes of two blocks what is cut into tiles. A packed row is copied once for each block of the other set. Where both are the same set, two different blocks meet once and count twice."""
    same = a is b
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda t: max(-(-t.count() // block_rows), math.isqrt(tasks), 1)
    m = count(a)
    n = m if same else count(b)
    to = lambda k, low=0, high=None: F.explode(F.sequence(F.lit(low), F.lit(k - 1) if high is None else high))
    parts = min(m * n, 16 * tasks)  # so few pairs of blocks in a task that the tasks even out
    left = _packed(a, m).withColumnRenamed("block", "i").select("i", to(n, F.col("i") if same else 0).alias("j"), "n", "dim", "v").repartition(parts, "i", "j").groupBy("i", "j")
    right = _packed(b, n).withColumnRenamed("block", "j").select("j", to(m, high=F.col("j") if same else None).alias("i"), "n", "dim", "v").repartition(parts, "i", "j").groupBy("i", "j")

    def vectors(t: pa.Table) -> np.ndarray:
        rows = zip(t.column("n").to_pylist(), t.column("dim").to_pylist(), (v.as_buffer() for v in t.column("v")))
        return np.concatenate([np.frombuffer(v, dtype=f"f{v.size // max(n * dim, 1) or 8}").reshape(n, dim) for n, dim, v in rows], dtype=np.float64)

    def both(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return pa.table({"s": pa.array([], pa.float64()), "n": pa.array([], pa.float64())})
        x, y = ready(vectors(p), vectors(q))
        s = sum(float(run(x[k : k + TILE], y[i : i + TILE])) for i in range(0, len(y), TILE) for k in range(0, len(x), TILE))
        times = 2 if same and key[0].as_py() != key[1].as_py() else 1
        return pa.table({"s": [s * times], "n": [float(len(x) * len(y) * times)]})

    return left.cogroup(right).applyInArrow(both, "s double, n double")


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = (-2 * x) @ y.T
    out += np.einsum("ij,ij->i", x, x)[:, None]
    out += np.einsum("ij,ij->i", y, y)[None]
    return np.maximum(out, 0, out=out)


def mean_distance(a: DataFrame, b: DataFrame, block_rows: int = 8_192) -> DataFrame:
    """V15. (similarity): minus the mean euclidean distance of all pairs of two sets (id, x)."""
    sums = _block_pairs(a, b, block_rows, lambda x, y: np.sqrt(_square_distances(x, y)).sum())
    return sums.agg((-F.sum("s") / F.sum("n")).alias("similarity"))


def mmd_bandwidth(a: DataFrame, b: DataFrame) -> float:
    """Mean squared distance of two different rows of both sets: 2 n sum |x|^2 - 2 |sum x|^2 over n^2 - n; no pair is formed."""
    both = a.select("x").unionByName(b.select("x"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                n, s, q = n + len(x), s + x.sum(axis=0), q + float((x * x).sum())
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] + [0] * (len(s) - 1), pa.int64()), "q": [q] + [0.0] * (len(s) - 1), "dim": pa.array(range(len(s)), pa.int32()), "s": s})

    dims = both.mapInArrow(partial, "n long, q double, dim int, s double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("s").alias("s"))
    n, q, ss = dims.agg(F.sum("n"), F.sum("q"), F.sum(F.col("s") * F.col("s"))).first()
    return (2 * n * q - 2 * ss) / (n * n - n) if n and n > 1 else 1.0


#: The exponential on [-SPAN, 0] to 2e-14, highest power first, and how often it may be squared, so that an error stays below 1e-12.
SPAN, SQUARINGS = 0.07, 12
EXP = np.polynomial.Chebyshev.interpolate(np.exp, 6, [-SPAN, 0]).convert(kind=np.polynomial.Polynomial).coef[::-1].tolist()


def _halves(x: np.ndarray, y: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are minus the squared distances over ``width``."""
    xx, yy = (np.einsum("ij,ij->i", m, m)[:, None] / width for m in (x, y))
    return np.hstack([x * (2 / width), -xx, np.full_like(xx, -1)]), np.hstack([y, np.ones_like(yy), yy])


def _gaussians(u: np.ndarray, v: np.ndarray, kernels: int, room: np.ndarray) -> float:
    """The sum over all pairs of exp(d) + exp(2 d) + exp(4 d) + ..., d the product of rows of :func:`_halves`. Where the lengths of the vectors bound d,
    exp(d) is a polynomial of a small part of d, squared as often as d is halved; numpy's exponential takes twice as long. ``room`` has two rows of a number for each pair, at least."""
    d, e = (r[: len(u) * len(v)].reshape(len(u), len(v)) for r in room)
    most = (math.sqrt(max(-u[:, -2].min(), 0)) + math.sqrt(max(v[:, -1].max(), 0))) ** 2
    times = max(math.ceil(math.log2(most / SPAN)), 0) if most > SPAN else 0 if most >= 0 else SQUARINGS + 1
    if times <= SQUARINGS:
        np.matmul(u * 0.5**times, v.T, out=d)
        np.multiply(d, EXP[0], out=e)
        for c in EXP[1:-1]:
            e += c
            e *= d
        e += EXP[-1]
        for _ in range(times):
            np.multiply(e, e, out=e)
    else:
        np.matmul(u, v.T, out=e)
        np.exp(np.minimum(e, 0, out=e), out=e)
    e = e.ravel()
    total = e.sum()
    for k in range(1, kernels):
        total += e @ e
        if k < kernels - 1:
            np.multiply(e, e, out=e)  # half the width squares the kernel
    return float(total)


def mmd(a: DataFrame, b: DataFrame, kernels: int = 5, factor: float = 2.0, block_rows: int = 8_192) -> DataFrame:
    """V15. (similarity): minus the maximum mean discrepancy of two sets (id, x): mean kernel inside a, minus twice that between,
    plus that inside b; the kernel is a sum of ``kernels`` Gaussians around the bandwidth of the data. Pairs are met in blocks of
    ``block_rows``; an empty set gives null."""
    widths = [(mmd_bandwidth(a, b) or 1.0) * factor ** (k - kernels // 2) for k in range(kernels)]

    if factor == 2.0 and kernels > 0:
        room: list[np.ndarray] = []  # made once a task

        def kernel(u: np.ndarray, v: np.ndarray) -> float:
            if not room:
                room.append(np.empty((2, TILE * TILE)))
            return _gaussians(u, v, kernels, room[0])

        ready = lambda x, y: _halves(x, y, widths[-1])
    else:
        ready, kernel = lambda x, y: (x, y), lambda x, y: sum(np.exp(-_square_distances(x, y) / w).sum() for w in widths)

    mean = lambda p, q, c: _block_pairs(p, q, block_rows, kernel, ready).agg((F.sum("s") * c / F.sum("n")).alias("v"))
    parts = mean(a, a, 1).unionByName(mean(a, b, -2)).unionByName(mean(b, b, 1))
    return parts.agg(F.when(F.count("v") == 3, -F.sum("v")).alias("similarity"))


# ---- the most similar rows ----


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in the order of the dimensions."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _best_of_block(ids: np.ndarray, x: np.ndarray, n: np.ndarray, others: np.ndarray, y: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, sim) of the ``k`` most similar others of each row, ties to the smaller other. A matrix product finds those within
    rounding of the k-th best, which are then computed as in SQL. Of equal others only the first k + 1 can be among them."""
    order = np.argsort(others, kind="stable")
    others, y, m = others[order], y[order], m[order]
    _, group = np.unique(y, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")  # ascending others in each group
    start = np.searchsorted(group[by], group[by])
    keep = np.sort(by[np.arange(len(by)) - start <= k])
    others, y, m = others[keep], y[keep], m[keep]
    out: list[tuple] = []
    with np.errstate(all="ignore"):
        unit, right = (x / n[:, None]).astype(np.float32), (y / m[:, None]).astype(np.float32).T
        margin = 4e-9 + (x.shape[1] + 4) * 2.4e-7  # of two products in single precision
        rows = max(AT_ONCE * 8 // max(len(others), 1), 1)
        sets = min(64 * k, len(others))  # the k-th of the maxima of disjoint sets is no more than the k-th best
        for s in range(0, len(x), rows):
            sims = unit[s : s + rows] @ right
            sims[~np.isfinite(sims)] = np.inf  # judged below
            sims[ids[s : s + rows, None] == others[None]] = -np.inf
            tops = sims[:, : len(others) // sets * sets].reshape(len(sims), -1, sets).max(axis=1)
            low = np.partition(tops, sets - k, axis=1)[:, sets - k] if sets > k else np.full(len(sims), -np.inf, np.float32)
            r, c = np.nonzero(sims >= np.maximum(low - margin, -margin)[:, None])
            for at in range(0, len(r), 50_000):
                end = at + 50_000
                i, j = r[at:end] + s, c[at:end]
                sim = _exact(x[i], y[j]) / (n[i] * m[j])
                rank = np.where(np.isnan(sim), np.inf, np.floor(sim * 1e9 + 0.5))
                good = rank > 0
                i, j, sim, rank = i[good], j[good], sim[good], rank[good]
                best = np.lexsort((others[j], -rank, i))
                i, j, sim = i[best], j[best], sim[best]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((i[first], others[j[first]], sim[first]))
    if not out:
        return np.zeros(0, dtype=int), others[:0], np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def block_top_k(x: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, other, sim): for each row of (id, x) and each block of the rows, of every length of vectors, the ``k`` most similar others in the block with a
    positive or undefined cosine. Vectors with null elements or of length zero have none; a row is copied once for each block, on both sides."""
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-x.count() // block_rows), 2 * math.isqrt(tasks), 1)
    terms = F.aggregate(F.zip_with("x", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    unit = x.select("id", F.col("x").cast("array<double>").alias("x"), F.size("x").alias("d")).withColumn("n", F.sqrt(terms)).where("n > 0")
    of, to = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = unit.select(of.alias("b"), to.alias("c"), "d", "id", "x", "n").groupBy("b", "c", "d")
    right = unit.select(to.alias("b"), of.alias("c"), F.col("d").alias("d"), F.col("id").alias("o"), F.col("x").alias("y"), F.col("n").alias("m")).groupBy("b", "c", "d")
    id_type = unit.schema["id"].dataType.simpleString()
    plain = pa.types.is_integer

    def best(p: pa.Table, q: pa.Table) -> pa.Table:
        def parts(t: pa.Table, i: str, x: str, n: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            v = np.asarray(pa.concat_arrays(t.column(x).chunks).flatten(), dtype=np.float64).reshape(t.num_rows, -1)
            return pa.concat_arrays(t.column(i).chunks), v, t.column(n).to_numpy()

        if not p.num_rows or not q.num_rows:
            none = (p.column("id") if p.num_rows else q.column("o")).slice(0, 0)  # an empty side has no columns
            return pa.table({"id": none, "other": none, "sim": pa.array([], pa.float64())})
        (a, u, n), (b, v, m) = parts(p, "id", "x", "n"), parts(q, "o", "y", "m")
        if not plain(a.type):  # numbers in the order of the ids
            names = pa.concat_arrays([a, b]).unique().sort()
            put = {v: i for i, v in enumerate(names.to_pylist())}
            left_ids, right_ids = (np.array([put[v] for v in t.to_pylist()]) for t in (a, b))
        else:
            names, left_ids, right_ids = None, a.to_numpy(), b.to_numpy()
        i, other, sim = _best_of_block(left_ids, u, n, right_ids, v, m, k)
        return pa.table({"id": a.take(pa.array(i)), "other": pa.array(other, a.type) if names is None else names.take(pa.array(other)), "sim": pa.array(sim)})

    return left.cogroup(right).applyInArrow(best, f"id {id_type}, other {id_type}, sim double")
