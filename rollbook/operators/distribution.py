"""Sums of independent yes/no draws: exact distributions that merge, quantiles, and simulated differences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A window of this many standard deviations, and some more bins, holds all mass that doubles can tell from 0.
SPREAD, MARGIN = 12, 20
#: Nodes that one node of the product tree has below it; cells, and distributions, that a task holds before it combines them.
FAN, CELLS, HELD = 16, 1024, 32
#: Rows of a whole distribution that are made together.
BLOCK = 1 << 16
#: Iterations that one start of a generator serves.
CHUNK = 10_000

#: A distribution that merges: the mass of offset, offset + 1, ...; the window, mean and variance of ``draws`` draws.
STATE = "draws long, offset long, mass array<double>, mean double, var double"
Dist = tuple[int, int, np.ndarray, float, float]
NOTHING: Dist = (0, 0, np.ones(1), 0.0, 0.0)


def _binomial(n: int, q: float) -> Dist:
    """Binomial(n, q)."""
    if q <= 0 or q >= 1:
        return n, 0 if q <= 0 else n, np.ones(1), n * q, 0.0
    sd = (n * q * (1 - q)) ** 0.5
    low, high = max(0, int(n * q - SPREAD * sd - MARGIN)), min(n, int(n * q + SPREAD * sd + MARGIN))
    k = np.arange(low, high)
    steps = np.log((n - k) / (k + 1)) + np.log(q) - np.log1p(-q)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.exp(logs - logs.max())
    return n, low, mass / mass.sum(), n * q, n * q * (1 - q)


def _combined(parts: list[Dist]) -> Dist:
    """Convolution of distributions, the shortest two first."""
    parts = sorted(parts, key=lambda x: -len(x[2])) or [NOTHING]
    while len(parts) > 1:
        (n1, o1, a, m1, v1), (n2, o2, b, m2, v2) = parts.pop(), parts.pop()
        if min(len(a), len(b)) <= 256:
            mass = np.convolve(a, b)
        else:
            size = len(a) + len(b) - 1
            mass = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size).clip(0)
        offset, mean, var = o1 + o2, m1 + m2, v1 + v2
        width = SPREAD * var**0.5 + MARGIN
        low, high = max(0, int(mean - width) - offset), min(len(mass), int(mean + width) + 2 - offset)
        parts.append((n1 + n2, offset + low, mass[low:high], mean, var))
        parts.sort(key=lambda x: -len(x[2]))
    return parts[0]


def _runs(keys: list[str], read: Callable[[pa.RecordBatch, int, int], Iterator[Dist]]) -> Callable:
    """A task over rows sorted by the node ``__node``: each run of one node, over batches too, becomes one distribution.

    What is held at a time is at most HELD distributions, whatever the length of a run.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held = None, None, []

        def out() -> pa.RecordBatch:
            n, offset, mass, mean, var = _combined(held)
            made = [pa.array([n]), pa.array([offset]), pa.array([mass]), pa.array([mean]), pa.array([var])]
            return pa.RecordBatch.from_arrays([*first, *made], names=[*keys, "__node", "draws", "offset", "mass", "mean", "var"])

        for batch in batches:
            nodes = np.array(batch.column("__node").to_pylist(), object)
            starts = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1), len(nodes)] if len(nodes) else []
            for low, high in zip(starts[:-1], starts[1:]):
                if nodes[low] != at:
                    if at is not None:
                        yield out()
                    at, held = nodes[low], []
                    first = [batch.column(k).slice(low, 1) for k in [*keys, "__node"]]
                for dist in read(batch, low, high):
                    held.append(dist)
                    if len(held) >= HELD:
                        held = [_combined(held)]
        if at is not None:
            yield out()

    return fold


def _of_cells(batch: pa.RecordBatch, low: int, high: int) -> Iterator[Dist]:
    qs, ns = batch.column("__q").slice(low, high - low).to_pylist(), batch.column("__n").slice(low, high - low).to_pylist()
    for k in range(0, len(qs), CELLS):
        yield _combined([_binomial(n, q) for q, n in zip(qs[k:k + CELLS], ns[k:k + CELLS]) if q is not None])


def _of_states(batch: pa.RecordBatch, low: int, high: int) -> Iterator[Dist]:
    mass = batch.column("mass")
    for k in range(low, high):
        yield (*(batch.column(c)[k].as_py() for c in ("draws", "offset")), mass[k].values.to_numpy(), *(batch.column(c)[k].as_py() for c in ("mean", "var")))


def _folded(df: DataFrame, keys: list[str], columns: list[str], node: Column, read: Callable) -> DataFrame:
    """One row for each (keys, node): keys, __node, STATE."""
    named = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], node.alias("node")), {"ignoreNullFields": "false"})
    rows = df.select(*keys, node.cast("int").alias("__salt"), named.alias("__node"), *columns)
    kinds = dict(rows.dtypes)
    dealt = rows.drop("__salt").repartition("__node").sortWithinPartitions("__node")
    shape = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    made = dealt.mapInArrow(_runs(keys, read), f"{shape}__node string, {STATE}")
    return made.withColumn("__salt", F.get_json_object("__node", "$.node").cast("int"))


def merged(states: DataFrame, keys: list[str], salt: Column | None = None, spread: int = 1) -> DataFrame:
    """keys and STATE of each group of ``states``: the distribution of the sum of what they stand for.

    ``salt``, from 0 to ``spread`` - 1, deals a group's rows over nodes of a product tree, FAN below each; a level is a shuffle by (group,
    node), so the rows of one group, however many, are never one task's.
    """
    columns = ["draws", "offset", "mass", "mean", "var"]
    node = F.lit(0) if salt is None else salt
    while True:
        spread = -(-spread // FAN)
        states = _folded(states, keys, columns, F.floor(node / FAN) if spread > 1 else F.lit(0), _of_states)
        if spread == 1:
            return states.select(*keys, *columns)
        node = F.col("__salt")


def distributions(df: DataFrame, keys: list[str], q: str = "p_female", n: str | None = None) -> DataFrame:
    """keys and STATE: the distribution of the number of successes of each group.

    Rows without ``q`` don't count; a group of such rows alone has draws 0 and mass [1]. A probability outside [0, 1]
    is an error. ``n`` names a column of row weights. No rows: no groups. Equal probabilities are counted first; distinct ones are dealt
    over the nodes of a product tree by their hash, as many as there are shuffle partitions, and a task streams through its nodes. A
    distribution's length grows with the square root of its draws.
    """
    p = F.col(q).cast("double")
    ok = F.when(p.isNull() | (~F.isnan(p) & (p >= 0) & (p <= 1)), p).otherwise(F.raise_error(F.lit("probability outside [0, 1]")).cast("double"))
    weight = F.col(n) if n else F.lit(1)
    cells = df.withColumn("__q", ok).groupBy(*keys, "__q").agg(F.sum(weight).cast("long").alias("__n"))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = _folded(cells, keys, ["__q", "__n"], F.pmod(F.xxhash64("__q"), F.lit(spread)), _of_cells)
    return merged(states, keys, F.col("__salt"), spread)


def cumulative(dist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, mass, cdf: a row for each number of successes from 0 to draws.

    Masses that doubles can't tell from 0 are 0. The window's cumulative masses come from its own row, in blocks; what lies outside it has a constant
    one. Blocks are dealt over all tasks before their rows are made.
    """
    kinds = dict(dist.dtypes)
    shape = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mass = batch.column("mass")[i].values.to_numpy()
                total = np.cumsum(mass)
                first = batch.column("offset")[i].as_py()
                for k in range(0, len(mass), BLOCK):
                    own = [batch.column(c).slice(i, 1) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([first + k]), pa.array([mass[k:k + BLOCK]]), pa.array([total[k:k + BLOCK]])], names=[*keys, "start", "mass", "cdf"])

    kept = dist.select(*keys, "offset", "mass").mapInArrow(blocks, f"{shape}start long, mass array<double>, cdf array<double>")
    after = F.col("offset") + F.size("mass")
    flat = dist.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("low"), F.col("offset").alias("high"), F.lit(0.0).alias("cdf")),
        F.struct(after.alias("low"), (F.col("draws") + 1).alias("high"), F.aggregate("mass", F.lit(0.0), lambda a, x: a + x).alias("cdf")))).alias("x")).where("x.low < x.high")
    flat = flat.select(*keys, "x.high", "x.cdf", F.explode(F.sequence("x.low", F.col("x.high") - 1, F.lit(BLOCK).cast("long"))).alias("start"))
    dealt = lambda df: df.repartition(*keys, "start")
    inside = dealt(kept).select(*keys, "start", F.posexplode(F.arrays_zip("mass", "cdf")).alias("pos", "x")).select(*keys, (F.col("start") + F.col("pos")).alias("k"), "x.mass", "x.cdf")
    outside = dealt(flat).select(*keys, F.explode(F.sequence("start", F.least(F.col("start") + BLOCK, F.col("high")) - 1)).alias("k"), F.lit(0.0).alias("mass"), "cdf")
    return inside.union(outside)


def with_quantiles(dist: DataFrame, alphas: dict[str, float]) -> DataFrame:
    """``dist`` with a column per entry of ``alphas``: the least k whose cumulative mass reaches alpha, else the last k."""
    if any(not 0 <= a <= 1 for a in alphas.values()):
        raise ValueError("quantile outside [0, 1]")

    def below(alpha: float) -> Column:
        """How many of the masses, added up, stay under alpha."""
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["below"] + F.when(acc["sum"] + x < alpha, 1).otherwise(0)).alias("below"))
        return F.aggregate("mass", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below")), step, lambda acc: acc["below"])

    return dist.withColumns({
        name: F.lit(0).cast("long") if alpha == 0 else F.when(below(alpha) < F.size("mass"), F.col("offset") + below(alpha)).otherwise(F.col("draws")) for name, alpha in alphas.items()})


def monte_carlo_difference(df: DataFrame, group: str, a: str, b: str, q: str = "p_female", iterations: int = 100_000, seed: int = 42) -> DataFrame:
    """p2_5, p50, p97_5 of the simulated percentage of group ``b`` minus that of ``a``; nulls if either is empty.

    Every cell (group, distinct probability) has a counter-based generator of its own, keyed by seed and cell and started anew for each chunk of
    iterations: what it draws doesn't depend on the task, the partitions or the other cells. A task adds up the draws of its cells, and
    holds two counts an iteration, whatever the number of cells; the partial sums are added by a shuffle on (chunk, group). For independent groups alone.
    """
    if iterations < 1:
        raise ValueError("iterations must be positive")
    cells = df.where(F.col(q).isNotNull() & F.col(group).isin(a, b)).groupBy((F.col(group) == b).alias("g"), F.col(q).cast("double").alias("q")).agg(F.count("*").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, people = {}, {}
        for batch in batches:
            for g, p, n in zip(batch["g"], batch["q"], batch["n"]):
                sums = total.setdefault(g, np.zeros(iterations, np.int64))
                people[g] = people.get(g, 0) + n
                key = np.random.SeedSequence([seed, int(g), int(np.float64(p + 0.0).view(np.uint64))]).generate_state(2, np.uint64)
                for chunk in range(0, iterations, CHUNK):
                    rng = np.random.Generator(np.random.Philox(key=key, counter=[0, 0, 0, chunk]))
                    sums[chunk:chunk + CHUNK] += rng.binomial(n, p, len(sums[chunk:chunk + CHUNK]))
        for g, sums in total.items():
            for chunk in range(0, iterations, CHUNK):
                yield pd.DataFrame({"g": [g], "chunk": [chunk], "people": [people[g]], "sums": [sums[chunk:chunk + CHUNK]]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [rows["g"][0]], "chunk": [rows["chunk"][0]], "people": [rows["people"].sum()], "sums": [np.sum(rows["sums"].tolist(), axis=0)]})

    shape = "g boolean, chunk long, people long, sums array<long>"
    parts = cells.repartition("g", "q").mapInPandas(draw, shape).groupBy("chunk", "g").applyInPandas(add, shape)  # a row for each task
    share = lambda g: F.max(F.when(F.col("g") == g, F.transform("sums", lambda x: 100 * x / F.col("people"))))
    drawn = parts.groupBy("chunk").agg(share(False).alias("a"), share(True).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    drawn = drawn.select(F.explode(F.zip_with("b", "a", lambda x, y: x - y)).alias("d"))
    at = F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return drawn.agg(at.alias("p")).select(F.col("p")[0].alias("p2_5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p97_5"))


def _least_reaching(alpha: float, a: tuple, b: tuple) -> float:
    """The least value of 100 * (B / n_b - A / n_a) whose cumulative probability reaches alpha; a, b: (draws, offset, masses)."""
    (na, oa, pa_), (nb, ob, pb) = a, b
    kind = np.int64 if na * nb < 1 << 61 else object
    xa, cdf = np.arange(oa, oa + len(pa_)).astype(kind), np.concatenate(([0.0], np.cumsum(pb)))

    def reached(m: int) -> bool:
        """Whether P(na * B - nb * A <= m) is at least alpha."""
        most = (m + nb * xa) // na - ob + 1
        return float(pa_ @ cdf[np.clip(most, 0, len(pb)).astype(np.int64)]) >= alpha

    low, high = -na * nb - 1, na * nb
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) else (middle, high)
    return 100.0 * high / (na * nb)


def exact_difference(df: DataFrame, group: str, a: str, b: str, alphas: dict[str, float], q: str = "p_female") -> DataFrame:
    """One row, a column per entry of ``alphas``: that quantile of the percentage of group ``b`` minus that of ``a``, without simulation;
    nulls if either is empty.

    The cumulative probability of a value is a sum over the window of the one distribution, each term a lookup in the other; the least
    value that reaches alpha is found by halving among the whole numbers n_a * B - n_b * A. Both windows grow with the square root of the draws.
    """
    states = distributions(df.where(F.col(group).isin(a, b) & F.col(q).isNotNull()), [group], q)
    side = lambda x: F.max(F.when(F.col(group) == x, F.struct("draws", "offset", "mass")))
    pair = states.agg(side(a).alias("a"), side(b).alias("b"))  # two rows at most

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two in zip(batch["a"], batch["b"]):
                known = one is not None and two is not None
                sides = [(x["draws"], x["offset"], np.asarray(x["mass"])) for x in (one, two)] if known else []
                yield pd.DataFrame({k: [_least_reaching(alpha, *sides) if known else None] for k, alpha in alphas.items()}, dtype=float)

    return pair.mapInPandas(find, ", ".join(f"`{k}` double" for k in alphas))
