"""Merkle manifest: leaves ranked by a radix trie of the ids, subtrees built pack by pack, proofs for every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import cut, table
from rollbook.operators.inference import numbered

#: Bits of an id below each level of the histograms: a bucket of the lowest level has 256 ids, a node of the others at most 16,384 children.
LEVELS = (8, 22, 36, 50)
#: Rows of one bucket from which on it is parted by the ties as well; it changes how the work is dealt, not the ranks.
BUCKET = 100_000
#: Leaves, then nodes, that one row holds while its levels are built: the largest power of the fanout up to this.
PACK = 256
#: Equal rows are told apart by rank alone; their copies are made in runs of so many.
RUN = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A column as the leaf has it: ``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _before(df: DataFrame, parents: list[str], order: Column, n: str = "n") -> DataFrame:
    """``df`` with start: the sum of n over the rows of the same parents that come before."""
    return df.withColumn("start", F.coalesce(F.sum(n).over(Window.partitionBy(*parents).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def ranked(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """``rows`` with rank (from 0 within the group, by key, then tie, null keys first) and size (rows of the group).

    ``rows`` has n, how many equal rows it stands for; rank is that of the first of them. The digits of the key are a trie: counts go up from
    buckets of 256 keys, starts come down, each the sum over the siblings before. No window holds more than one node's children, so nothing
    is sorted as a whole, and a hot group is as many buckets as it has ranges of keys. Digits above the highest one that differs at all
    have nothing to tell and are left out. Where a bucket has over BUCKET rows, as its keys repeat, the first digits of the tie, which is a digest,
    are one more digit below the key.
    """
    names = {b: f"p{b}" for b in LEVELS}
    low = names[LEVELS[0]]
    base = rows.withColumn(low, F.shiftright(F.col(key).cast("long"), LEVELS[0]))
    counts = cut(base.groupBy(group, low).agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("rows")))
    seen = counts.agg(F.min(low).alias("least"), F.max(low).alias("most"), F.max("rows").alias("rows")).first()
    used = [b for b in LEVELS[1:] if seen["least"] is not None and seen["least"] >> (b - LEVELS[0]) != seen["most"] >> (b - LEVELS[0])]
    path = [names[b] for b in reversed(used)] + [low]  # from the root down
    levels = [counts.select(group, low, *[F.shiftright(low, b - LEVELS[0]).alias(names[b]) for b in used], "n")]
    for i in range(len(path) - 1, -1, -1):
        levels.append(levels[-1].groupBy(group, *path[:i]).agg(F.sum("n").alias("n")))
    above = levels[-1].select(group, F.col("n").alias("size"), F.lit(0).cast("long").alias("base"))
    for i, here in enumerate(reversed(levels[:-1])):
        above = _down(_before(here, [group, *path[:i]], F.col(path[i]).asc_nulls_first()), above, [group, *path[:i]], [group, *path[:i + 1]])
    starts, cells = above.select(group, low, "size", "base"), [group, low]
    if (seen["rows"] or 0) > BUCKET:
        base = base.withColumn("mix", F.substring(tie, 1, 3))
        cells = [group, low, key, "mix"]
        fine = _before(base.groupBy(*cells).agg(F.sum("n").alias("n")), [group, low], F.struct(F.col(key).isNotNull(), F.col(key), F.col("mix")))
        starts = _down(fine, starts, [group, low], cells)
    last = _before(base, cells, F.struct(F.col(key).isNotNull(), F.col(key), F.col(tie)))
    return last.alias("h").join(starts.alias("a"), _same("h", "a", cells)).select(*[f"h.{c}" for c in rows.columns], "size", (F.col("base") + F.col("start")).cast("long").alias("rank"))


def _down(here: DataFrame, above: DataFrame, parents: list[str], keys: list[str]) -> DataFrame:
    """keys, size, base: a level's starts on top of those of its parents."""
    return here.alias("h").join(above.alias("a"), _same("h", "a", parents)).select(*[f"h.{k}" for k in keys], "size", (F.col("base") + F.col("start")).alias("base"))


def _depth(size: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    steps, reach = F.lit(0), fanout
    powers = []
    while reach < 1 << 62:
        powers.append(reach // fanout)
        reach *= fanout
    return reduce(lambda a, p: a + F.when(size > p, 1).otherwise(0), powers, steps)


def _climbed(digests: Column, levels: Column, most: int, fanout: int) -> Column:
    """The levels of a pack, leaves first: array of arrays of digests, each node the digest of its run's digests."""
    def up(known: Column, _: Column) -> Column:
        top = F.element_at(known, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(top) - 1) / fanout).cast("int"))
        return F.concat(known, F.array(F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(top, i * fanout + 1, F.lit(fanout)), ""), 256))))

    return F.aggregate(F.slice(F.array(*[F.lit(i) for i in range(most)]), F.lit(1), levels), F.array(digests), up)


def packed(nodes: DataFrame, groups: list[str], carry: list[str], fanout: int, most: int) -> DataFrame:
    """Nodes of one level (groups, place, size, digest, ``carry``) in packs of fanout ** most: groups, pack, size, members (in order) and
    levels. A pack climbs ``most`` levels, or as many as its tree has left."""
    width = fanout**most
    rows = nodes.groupBy(*groups, F.floor(F.col("place") / width).cast("long").alias("pack")).agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("place", "digest", *carry))).alias("members"))
    climbs = F.least(F.lit(most), _depth(F.col("size"), fanout))
    return rows.withColumn("levels", _climbed(F.transform("members", lambda m: m["digest"]), climbs, most, fanout))


def tree(nodes: DataFrame, groups: list[str], carry: list[str], fanout: int = 2) -> list[DataFrame]:
    """Packs of every height, lowest first; the last has one pack for each group, whose last level is the root. ``nodes``: groups, place (from 0),
    size (leaves of the tree), digest, ``carry``. Each height is written before the next reads it, so a lost executor costs one height."""
    most = 1
    while fanout ** (most + 1) <= PACK:
        most += 1
    heights = []
    while True:
        heights.append(cut(packed(nodes, groups, carry, fanout, most)))
        width = fanout**most
        nodes = heights[-1].select(*groups, F.col("pack").alias("place"), F.ceil(F.col("size") / width).cast("long").alias("size"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        carry = []
        if heights[-1].where(F.col("size") > width).isEmpty():
            return heights


def _steps(levels: Column, at: Column, fanout: int) -> Column:
    """The proof of member ``at`` inside its pack: for each level climbed struct(left, right), the joined digests of its run's others."""
    def one(level: Column, i: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(fanout)), i)).cast("int")
        nth = place % fanout
        return F.struct(
            F.array_join(F.slice(level, place - nth + 1, nth), "").alias("left"), F.array_join(F.slice(level, place + 2, F.lit(fanout - 1) - nth), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), one)


def proofs(heights: list[DataFrame], groups: list[str], carry: list[str], fanout: int = 2, above: DataFrame | None = None) -> DataFrame:
    """groups, place, digest, ``carry``, proof (array of struct(left, right), from the leaf up), subroot (of the leaf's group) and root, for every
    leaf. ``above`` (groups, proof, root) goes on top of the groups' own roots."""
    step = "array<struct<left:string,right:string>>"
    top = F.element_at(F.element_at("levels", -1), 1)
    upper = heights[-1].select(*groups, "pack", F.array().cast(step).alias("upper"), top.alias("subroot"), top.alias("root"))
    if above is not None:
        upper = upper.drop("upper", "root").alias("h").join(above.alias("a"), _same("h", "a", groups)).select("h.*", F.col("a.proof").alias("upper"), "a.root")
    for i in reversed(range(len(heights))):
        packs = heights[i].alias("h").join(upper.alias("u"), _same("h", "u", [*groups, "pack"])).select(*[f"h.{g}" for g in groups], "h.members", "h.levels", "upper", "subroot", "root")
        each = packs.select(*groups, "levels", "upper", "subroot", "root", F.posexplode("members").alias("at", "m"))
        proof = F.concat(_steps(F.col("levels"), F.col("at"), fanout), F.col("upper"))
        rows = each.select(*groups, F.col("m.place").alias("place"), F.col("m.digest").alias("digest"), *[F.col(f"m.{c}").alias(c) for c in (carry if i == 0 else [])], proof.alias("proof"), "subroot", "root")
        upper = rows.select(*groups, F.col("place").alias("pack"), F.col("proof").alias("upper"), "subroot", "root")
    return rows


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered_chars(doc_id: Column, n_chars: Column, each: int = 7) -> Column:
    """n_chars, one more where ``each`` divides the CRC-32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string")) % each == 0, n_chars + 1).otherwise(n_chars)


def manifest(docs: DataFrame, fanout: int = 2, each: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs`` (doc_id, source, lang, n_chars, text).

    Leaves ascend by doc_id in each lang, null ids first; rows of one id by their leaf. Equal rows are leaves of their own: each has its
    own place and proof, and which of them has which can't be told. A null lang is a group of its own, before all others. Null fields are
    ``-``; an empty text is ``0:``. Null ids and null n_chars are never tampered with. Texts are hashed whole, however long; only digests are
    shuffled. An empty table gives no rows; a group of one row has its leaf as subroot. Other columns play no part.
    """
    at = {c: F.col(c) for c in FIELDS}
    changed = at | {"n_chars": tampered_chars(at["doc_id"], at["n_chars"].cast("long"), each)}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("grp"), leaf_of(list(at.values())).alias("digest"), leaf_of(list(changed.values())).alias("other"))
    leaves = cut(rows.groupBy("grp", "doc_id", "digest", "other").agg(F.count("*").cast("long").alias("n")))
    placed = ranked(leaves, "grp", "doc_id", "digest")
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    nth = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)).alias("nth")
    nodes = runs.select("grp", "doc_id", "digest", "other", "size", "rank", nth).select("grp", "doc_id", "digest", "other", "size", (F.col("rank") + F.col("nth")).alias("place"))
    heights = tree(nodes, ["grp"], ["doc_id", "other"], fanout)
    subroots = cut(heights[-1].select("grp", F.element_at(F.element_at("levels", -1), 1).alias("digest")))
    order = numbered(subroots, "grp").withColumn("size", F.lit(subroots.count())).select(F.lit(0).alias("all"), F.col("nth").cast("long").alias("place"), "size", "digest", "grp")
    top = proofs(tree(order, ["all"], ["grp"], fanout), ["all"], ["grp"], fanout)
    every = proofs(heights, ["grp"], ["doc_id", "other"], fanout, top.select("grp", "proof", "root"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = every.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("other"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELDS = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "{}::VARCHAR", "text": "text"}


def _leaf_sql(chars: str) -> str:
    return "sha256(" + " || ".join("CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0})::VARCHAR || ':' || {0} END".format(v.format(chars)) for v in _FIELDS.values()) + ")"


#: CRC-32 bit by bit over the digits of the id; levels and folds by recursion.
ORACLE_SQL = {"op12_merkle": f"""
WITH RECURSIVE c AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS state FROM documents),
l AS (SELECT doc_id, coalesce('1' || lang, '0') AS grp, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + CASE WHEN xor(state, 4294967295::BIGINT) % 7 = 0 THEN 1 ELSE 0 END)')} AS other FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
t AS (SELECT grp, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM p
    UNION ALL SELECT grp, any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY grp, place // 2),
s AS (SELECT grp, digest AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS seat FROM t WHERE n = 1),
u AS (SELECT 0 AS level, seat AS place, subroot AS digest, count(*) OVER () AS n FROM s
    UNION ALL SELECT any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY place // 2),
r AS (SELECT digest AS root FROM u WHERE n = 1),
x AS (SELECT p.*, s.subroot, s.height, s.seat, row_number() OVER () AS id FROM p JOIN s USING (grp)),
lv AS (SELECT grp, level, max(n) AS n FROM t WHERE n > 1 GROUP BY ALL UNION ALL SELECT s.grp, s.height + u.level, max(u.n) FROM s, u WHERE u.n > 1 GROUP BY ALL),
q AS (SELECT x.id, lv.level, CASE WHEN lv.level < x.height THEN x.place >> lv.level ELSE x.seat >> (lv.level - x.height) END AS place, x.grp, x.height FROM x JOIN lv USING (grp)),
y AS (SELECT q.id, q.level, q.place % 2 AS side, coalesce(CASE WHEN q.level < q.height THEN t.digest ELSE u.digest END, '') AS digest FROM q
    LEFT JOIN t ON q.level < q.height AND t.grp = q.grp AND t.level = q.level AND t.place = xor(q.place, 1) LEFT JOIN u ON q.level >= q.height AND u.level = q.level - q.height AND u.place = xor(q.place, 1)),
z AS (SELECT id, list(CASE WHEN side = 1 THEN 'L' ELSE 'R' END || digest ORDER BY level) AS steps, sha256(string_agg(digest, '' ORDER BY level)) AS proof FROM y GROUP BY id),
o AS (SELECT x.doc_id, x.leaf, x.subroot, r.root, coalesce(z.proof, sha256('')) AS proof_sha256, list_reduce(list_prepend(x.other, coalesce(z.steps, [])), lambda a, d: sha256(CASE WHEN d[1] = 'L' THEN d[2:] || a ELSE a || d[2:] END)) AS folded_root
    FROM x CROSS JOIN r LEFT JOIN z USING (id))
SELECT *, folded_root = root AS verified FROM o
"""}
