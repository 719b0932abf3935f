"""Exact top-k inner products with M-trees: paged metric nodes, covering radii, parent distances, best-first search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import cut

#: Vectors of a tree and of a leaf page, about; roots at most, which are a sample of the vectors.
TREE, PAGE, MOST_ROOTS = 4096, 128, 1024
#: Steps of the distance to a root by which its vectors are dealt to trees: at most MOST_ROOTS * RINGS rows are broadcast.
RINGS = 256
#: Queries, and trees of a root, that are held against each other together.
QUERIES, TREES = 512, 512
#: A bound is passed over only if it is beyond the k-th distance by more than this share of the largest norm.
SLACK = 1e-5
#: Inner products are exact in doubles while squared norms stay below this.
EXACT = 2.0**52


def grid(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 256) -> DataFrame:
    """vec_id, vec (64-bit integers floor(scale * x), x as double, as bytes). Vectors that are null or hold a null or
    non-finite component are left out. A component beyond 26 bits is an error: products would not be exact."""
    whole = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [np.floor(np.asarray(x, np.float64) * scale) for x in batch["embedding"]]
            if any((np.abs(x) >= EXACT**0.5).any() for x in rows):
                raise ValueError("a component is too large for exact inner products")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vec": [x.astype(np.int64).tobytes() for x in rows]})

    rows = vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.where("vec_id IS NOT NULL").mapInPandas(each, "vec_id long, vec binary")


def _matrix(vecs, width: int) -> np.ndarray:
    """Rows of integer vectors as doubles; shorter ones end in zeros."""
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        x = np.frombuffer(v, np.int64)
        out[i, : len(x)] = x
    return out


class Space:
    """Vectors of norm up to ``norm`` get one more component that brings them to that norm; a query's is 0. Then
    |query - vector|^2 = |query|^2 + norm^2 - 2 * inner product, so the nearest have the highest inner products."""

    def __init__(self, norm2: float, width: int):
        self.norm2, self.width, self.slack = norm2, width, SLACK * (norm2**0.5 + 1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0, self.norm2 - (x * x).sum(axis=1)))[:, None]), axis=1)

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors, a row for each of x."""
        return np.sqrt(np.maximum(0, 2 * self.norm2 - 2 * (x @ y.T)))

    def from_queries(self, q2: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Distances of queries of squared norms ``q2``, a row for each, from their inner products."""
        return np.sqrt(np.maximum(0, q2[:, None] + self.norm2 - 2 * products))


_TREE = "tree long, root int, ids binary, vecs binary, up binary, starts binary, routers binary, radius binary, router_up binary, head binary, head_up double, reach double, low double, high double"


def build(space: Space, tree: int, root: int, ids: np.ndarray, x: np.ndarray, to_root: np.ndarray) -> tuple:
    """One tree as a row. Leaf pages lie one after the other, each entry with its distance to its page's router, and each
    page's router has a covering radius and its distance to the tree's own router, the head. The head has the
    covering radius of the tree and its distance to the root, whose distances to all vectors lie from low to high."""
    n = len(ids)
    lifted = space.lifted(x)
    picks = np.arange(-(-2 * n // PAGE)) * n // -(-2 * n // PAGE)
    near = np.empty(n, np.int64)
    for a in range(0, n, 1024):
        near[a : a + 1024] = space.between(lifted[a : a + 1024], lifted[picks]).argmin(axis=1)
    up = np.empty(n)
    for p in np.unique(near):
        mine = np.flatnonzero(near == p)
        up[mine] = space.between(lifted[mine], lifted[picks[p]][None])[:, 0]
    order = np.lexsort((ids, up, near))
    near, up = near[order], up[order]
    within = np.arange(n) - np.searchsorted(near, near)
    lead = np.flatnonzero((within % PAGE) == 0)
    routers = picks[near[lead]]
    head = picks[space.between(lifted[picks], lifted.mean(axis=0)[None])[:, 0].argmin()]
    from_head = space.between(lifted, lifted[head][None])[:, 0]
    radius = np.maximum.reduceat(up, lead)
    ints = lambda a: a.astype(np.int64).tobytes()
    return (tree, root, ids[order].tobytes(), ints(x[order]), up.tobytes(), ints(lead), ints(x[routers]), radius.tobytes(), from_head[routers].tobytes(),
            ints(x[head][None]), float(to_root[head]), float(from_head.max()), float(to_root.min()), float(to_root.max()))


class Best:
    """The k best ids and products of each of some queries so far, ties to the smaller id."""

    def __init__(self, space: Space, q2: np.ndarray, bound: np.ndarray, k: int):
        self.space, self.q2, self.k = space, q2, k
        self.ids, self.products = np.full((len(q2), k), np.iinfo(np.int64).max), np.full((len(q2), k), -np.inf)
        self.bound = bound.copy()

    def take(self, rows: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        """Offer ``products`` (a row for each of the queries ``rows``, -inf where there is none) of the vectors ``ids``."""
        row, col = np.nonzero((products >= self.products[rows, -1:]) & (products > -np.inf))
        if not len(row):
            return
        some = np.unique(row)
        who = np.concatenate((rows[row], np.repeat(rows[some], self.k)))
        found, score = np.concatenate((ids[col], self.ids[rows[some]].ravel())), np.concatenate((products[row, col], self.products[rows[some]].ravel()))
        order = np.lexsort((found, -score, who))
        who, found, score = who[order], found[order], score[order]
        on = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        self.ids[rows[some]], self.products[rows[some]] = found[on].reshape(-1, self.k), score[on].reshape(-1, self.k)
        full = rows[some][self.products[rows[some], -1] > -np.inf]
        self.bound[full] = np.minimum(self.bound[full], self.space.from_queries(self.q2[full], self.products[full, -1:])[:, 0])


class Tree:
    def __init__(self, space: Space, row):
        whole = lambda b: np.frombuffer(b, np.int64)
        real = lambda b: np.frombuffer(b, np.float64)
        self.space, self.ids = space, whole(row.ids)
        self.vecs, self.routers, self.head = (whole(b).reshape(-1, space.width).astype(np.float64) for b in (row.vecs, row.routers, row.head))
        self.up, self.radius, self.router_up = real(row.up), real(row.radius), real(row.router_up)
        self.starts = np.append(whole(row.starts), len(self.ids))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> Best:
        """The best k of each query (a row of ``q``) within its distance ``bound``, without its own id.

        Each query goes through its pages by their least possible distance and ends at the first beyond its bound; in
        each round, all queries whose turn it is at one page share a matrix product.
        """
        space, q2 = self.space, (q * q).sum(axis=1)
        best = Best(space, q2, bound, k)
        # a page is out by the distances stored to the head, before its own router is looked at
        to_head = space.from_queries(q2, q @ self.head.T)
        open_ = np.abs(to_head - self.router_up) - self.radius <= bound[:, None] + space.slack
        pages = np.flatnonzero(open_.any(axis=0))
        to_router = space.from_queries(q2, q @ self.routers[pages].T)
        least = np.where(open_[:, pages], to_router - self.radius[pages], np.inf)
        order = np.argsort(least, axis=1, kind="stable")
        going = np.arange(len(q))
        for turn in range(len(pages)):
            page = order[going, turn]
            still = least[going, page] <= best.bound[going] + space.slack
            going, page = going[still], page[still]
            if not len(going):
                break
            for p in np.unique(page):
                who = going[page == p]
                a, b = self.starts[pages[p]], self.starts[pages[p] + 1]
                near = np.abs(to_router[who, p][:, None] - self.up[a:b]) <= best.bound[who][:, None] + space.slack
                entries = np.flatnonzero(near.any(axis=0))
                products = q[who] @ self.vecs[a + entries].T
                ids = self.ids[a + entries]
                products[~near[:, entries] | (own[who][:, None] == ids)] = -np.inf
                best.take(who, ids, products)
        return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """The k highest inner products of each query's integer vector with all other vectors: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. The tree has four levels: roots (a sample), under each its trees of about
    TREE vectors, under each tree its leaf pages, in each page its entries; every node has a router, a covering radius
    and its distance to the router above. Vectors go to the nearest root, and to that root's trees by their distance to it; a
    distance that very many rows share spreads over many trees by a hash.

    A query first searches the tree it lies in, which bounds its k-th distance. Then it descends: to the roots within that
    bound, by a join to their trees, and to those within it, whose pages it goes through nearest first. Bounds leave out only
    what lies beyond the k-th distance, so the result is exact. Only roots (MOST_ROOTS at most) and the counts of their rings
    (MOST_ROOTS * RINGS) are broadcast, whatever the number of vectors.

    Ties go to the smaller id; with fewer than k candidates there are fewer rows. Vectors that are null or hold a null
    or non-finite component take no part, nor do rows without id; shorter vectors end in zeros. A query is not its
    own candidate, nor are other rows with its id; repeated rows are candidates each, and a repeated query is one query of
    the least of its vectors. Other columns, whatever their names, play no part. An empty table gives no rows. Vectors
    whose squared norms leave the exact range of doubles are an error.
    """
    spark = vectors.sparkSession
    found = cut(grid(vectors, vec_id, embedding, scale))
    n, width = found.agg(F.count("*"), F.coalesce(F.max(F.length("vec") / 8), F.lit(1)).cast("int")).first()
    width = max(1, width)

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["vec"], width)
            yield pd.DataFrame({"n2": [(x * x).sum(axis=1).max() if len(x) else 0.0]})

    norm2 = found.select("vec").mapInPandas(norms, "n2 double").agg(F.coalesce(F.max("n2"), F.lit(0.0))).first()[0]
    if norm2 >= EXACT:
        raise ValueError("vectors are too long for exact inner products")
    space = Space(norm2, width)
    few = found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(MOST_ROOTS, n // TREE + 1))).collect()
    roots = spark.sparkContext.broadcast(_matrix([r.vec for r in few], width))
    step = 2 * norm2**0.5 / RINGS + 1e-9  # no two lifted vectors are further apart than twice their norm

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lifted = space.lifted(roots.value)
        for batch in batches:
            far = space.between(space.lifted(_matrix(batch["vec"], width)), lifted)
            root = far.argmin(axis=1) if len(batch) else np.zeros(0, np.int64)
            up = far[np.arange(len(batch)), root]
            yield batch.assign(root=root.astype(np.int32), up=up, ring=(up / step).astype(np.int32))

    placed = cut(found.mapInPandas(place, "vec_id long, vec binary, root int, up double, ring int"))
    rings = placed.groupBy("root", "ring").agg(F.count("*").alias("n"))
    inner = Window.partitionBy("root").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)  # RINGS rows at most
    rings = rings.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    nth = F.floor((F.col("inner") + F.pmod(F.xxhash64("vec_id", "vec", F.lit(3)), F.col("n"))) / TREE)
    placed = placed.join(F.broadcast(rings), ["root", "ring"]).withColumn("tree", F.col("root").cast("long") * (1 << 32) + nth).drop("ring", "n", "inner")

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        row = build(space, int(group["tree"].iloc[0]), int(group["root"].iloc[0]), group["vec_id"].to_numpy(np.int64), _matrix(group["vec"], width), group["up"].to_numpy())
        return pd.DataFrame([row], columns=[c.split()[0] for c in _TREE.split(", ")])

    trees = cut(placed.groupBy("tree").applyInPandas(grow, _TREE))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                asked = row.queries
                own, bound = np.array([q["vec_id"] for q in asked]), np.array([q["bound"] for q in asked])
                best = Tree(space, row).search(_matrix([q["vec"] for q in asked], width), own, k, bound)
                on = best.products > -np.inf
                yield pd.DataFrame({
                    "query_id": own, "vec": [q["vec"] for q in asked], "tree": row.tree, "bound": np.where(on.all(axis=1), best.bound, np.inf),
                    "ids": [i[o] for i, o in zip(best.ids, on)], "products": [p[o].astype(np.int64) for p, o in zip(best.products, on)],
                })

    hits = "query_id long, vec binary, tree long, bound double, ids array<long>, products array<long>"
    query = F.struct("vec_id", "vec", "bound")
    queries = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("vec", "tree")).alias("own")).select("vec_id", "own.vec", "own.tree", F.lit(float("inf")).alias("bound"))
    at_home = queries.groupBy("tree").agg(F.collect_list(query).alias("queries"))  # no more than the tree holds
    first = cut(at_home.join(trees, "tree").mapInPandas(searched, hits))

    spans = {r.root: (r.low, r.high) for r in trees.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # MOST_ROOTS at most

    def to_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which = np.array(sorted(spans), np.int64)
        low, high = (np.array([spans[r][j] for r in which]) for j in (0, 1))
        for batch in batches:
            q = _matrix(batch["vec"], width)
            far = space.from_queries((q * q).sum(axis=1), q @ roots.value[which].T)
            row, col = np.nonzero(np.maximum(far - high, low - far) <= batch["bound"].to_numpy()[:, None] + space.slack)
            some = batch.iloc[row]
            yield pd.DataFrame({"root": which[col].astype(np.int32), "vec_id": some["query_id"].to_numpy(), "vec": some["vec"].to_numpy(), "bound": some["bound"].to_numpy(), "home": some["tree"].to_numpy(), "far": far[row, col]})

    reached = first.select("query_id", "vec", "tree", "bound").mapInPandas(to_roots, "root int, vec_id long, vec binary, bound double, home long, far double")
    block = lambda key, size, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(1, size)))
    asking = reached.groupBy("root", block("vec_id", n // 50 // QUERIES, 5).alias("block")).agg(F.collect_list(F.struct("vec_id", "vec", "bound", "home", "far")).alias("queries"))
    nodes = trees.select("root", "tree", F.struct("tree", "head", "head_up", "reach", "low", "high").alias("node"))
    nodes = nodes.groupBy("root", block("tree", n // TREE // TREES, 5).alias("part")).agg(F.collect_list("node").alias("nodes")).drop("part")

    def to_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, nodes in zip(batch["queries"], batch["nodes"]):
                tree, head_up, reach, low, high = (np.array([x[c] for x in nodes]) for c in ("tree", "head_up", "reach", "low", "high"))
                own, bound, home, far = (np.array([x[c] for x in asked]) for c in ("vec_id", "bound", "home", "far"))
                limit = (bound + space.slack)[:, None]
                # first by the distances stored to the root, then by the distance to the tree's own router
                near = (np.maximum(far[:, None] - high, low - far[:, None]) <= limit) & (np.abs(far[:, None] - head_up) - reach <= limit) & (home[:, None] != tree)
                cols = np.flatnonzero(near.any(axis=0))
                q = _matrix([x["vec"] for x in asked], width)
                near[:, cols] &= space.from_queries((q * q).sum(axis=1), q @ _matrix([nodes[c]["head"] for c in cols], width).T) - reach[cols] <= limit
                row, col = np.nonzero(near)
                yield pd.DataFrame({"tree": tree[col], "vec_id": own[row], "vec": [asked[i]["vec"] for i in row], "bound": bound[row]})

    pairs = asking.join(nodes, "root").select("queries", "nodes").mapInPandas(to_trees, "tree long, vec_id long, vec binary, bound double")
    gathered = pairs.groupBy("tree", block("vec_id", n // 50 // QUERIES, 7).alias("block")).agg(F.collect_list(query).alias("queries"))
    second = gathered.join(trees, "tree").mapInPandas(searched, hits)
    scored = first.union(second).select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("products").alias("score"))).alias("x")).select("query_id", "x.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_mtree(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = {"op9_mtree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""}
