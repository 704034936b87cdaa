"""A Merkle manifest of a document table: one tree per language, their roots joined into one, and a proof for every row.

Rows are sorted by language and identifier over ranges; a row's place in its tree is its place in its range after the counts of
the ranges before. Levels are built bottom-up and persisted in blocks of `stride` binary levels: a block holds up to
2 ** stride neighbours of one level and all digests above them up to its top, which is one node of the next block level. Proofs
are pushed top-down by joining each block with its top's proof: each child puts its siblings before the proof that it
inherits. A block and not each level is exchanged, so rows move once upwards, and of proofs, which grow with the height, only
one per block moves downwards. The trees' roots are leaves of one more tree, built and pushed alike.

No key gets a task of its own: a tree is spread over ranges and blocks however many rows it has. What is broadcast (counts by
range and tree, proofs by tree) is measured first, with a shuffled join beyond the limit.

Defined results: each row is a leaf; null values are encoded as `-`, an empty text as `0:`. Rows of one identifier ascend by
their digests, null identifiers come first; rows alike in every encoded column have a leaf each, and which of them stands where
changes nothing that is returned. A null language is a tree of its own, before all others. An empty table gives no rows. Other
columns are not part of a leaf, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, small_enough, table

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
STRIDE = 4  # binary levels of a block
NONE = "array<string>"


def encoded(c: Column) -> Column:
    """A value after its count of bytes, `-` if null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def joined_digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def checked(df: DataFrame) -> DataFrame:
    """Broadcast where its measured size allows."""
    return F.broadcast(df) if small_enough(df) else df


def placed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `i`, their place from 0 among the rows of their tree in the given order, and `n`, how many those are."""
    ordered = rows.orderBy(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]).withColumn("at", F.monotonically_increasing_id())
    stored = materialize(ordered, name)  # places must not change when a task runs again
    part = F.shiftright("at", 33)
    runs = stored.groupBy(part.alias("part_"), F.col(tree).alias("tree_")).agg(F.min("at").alias("first_"), F.count("*").alias("c"))
    whole = Window.partitionBy("tree_")
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part_", "tree_", "first_", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before_"), F.sum("c").over(whole).alias("n"))  # a row per range and tree
    runs = checked(materialize(runs, f"{name}-runs"))
    out = stored.join(runs, (part == F.col("part_")) & F.col(tree).eqNullSafe(F.col("tree_")))
    return out.withColumn("i", F.col("at") - F.col("first_") + F.col("before_")).drop("at", "part_", "tree_", "first_", "before_")


def height(n: Column) -> Column:
    """Binary levels above n nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def parents(level: Column) -> Column:
    """The digests above a level's digests: of each two, and of a last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda j: joined_digest(F.get(level, j * 2), F.coalesce(F.get(level, j * 2 + 1), F.lit(""))))


def build(nodes: DataFrame, name: str, stride: int = STRIDE) -> tuple[list[DataFrame], DataFrame]:
    """Persisted block levels from the leaves up, and (tree, digest) of every tree. Nodes: (tree, i, n, digest, item); `item`
    stays with its leaf. A block is (tree, g, n, items, levels): its place, its level's count of nodes, its digests by level."""
    most = nodes.agg(F.max("n").alias("n")).select(F.coalesce(height(F.col("n")), F.lit(0)).alias("h")).first()["h"]
    blocks, tops = [], None
    for k in range(max(1, -(-most // stride))):
        each = F.sort_array(F.collect_list(F.struct("i", "digest", *(["item"] if k == 0 else []))))  # 2 ** stride at most
        g = nodes.groupBy("tree", F.shiftright("i", stride).alias("g"), "n").agg(each.alias("x"))
        t = F.least(height(F.col("n")), F.lit(stride))
        first = F.array(F.transform("x", lambda s: s["digest"]))
        levels = F.when(t > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(t, F.lit(1))), first, lambda a, _: F.concat(a, F.array(parents(F.element_at(a, -1)))))).otherwise(first)
        items = F.transform("x", lambda s: s["item"]) if k == 0 else F.lit(None).cast("array<string>")
        blocks.append(materialize(g.select("tree", "g", "n", items.alias("items"), levels.alias("levels")), f"{name}-{k}"))
        up = blocks[-1].select("tree", F.col("g").alias("i"), F.expr(f"(n + {(1 << stride) - 1}) div {1 << stride}").alias("n"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"))
        done = up.where("n = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        nodes = up.where("n > 1")
    return blocks, tops


def own_siblings(levels: Column, c: Column) -> Column:
    """Of a block's child c, its sibling at each level below the block's top: the side it stands on (L, R) and its digest, or
    an empty string where there is none."""

    def entry(level: Column, k: Column) -> Column:
        i = F.floor(c / F.pow(F.lit(2.0), k)).cast("int")
        other = i + 1 - (i % 2) * 2
        return F.when(other < F.size(level), F.concat(F.when(other > i, F.lit("R")).otherwise(F.lit("L")), F.get(level, other))).otherwise("")

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), entry)


def push(blocks: list[DataFrame], inherited: DataFrame, name: str, stride: int = STRIDE) -> DataFrame:
    """(tree, i, digest, item, subroot, proof) of every leaf. `inherited`: (tree, subroot, proof) of every tree's top."""
    own = None
    inherited = checked(inherited).withColumnRenamed("tree", "of")
    for k in reversed(range(len(blocks))):
        b = blocks[k]
        tops = b.where(F.col("n") <= 1 << stride).join(inherited, F.col("tree").eqNullSafe(F.col("of")))
        rows = tops.drop("of")
        if own is not None:
            below = b.where(F.col("n") > 1 << stride).join(own, F.col("tree").eqNullSafe(F.col("of")) & (F.col("g") == F.col("at")))
            rows = rows.unionByName(below.drop("of", "at"))
        children = rows.select("*", F.posexplode(F.get("levels", F.lit(0))).alias("c", "digest"))
        i = (F.shiftleft("g", stride) + F.col("c")).alias("at")
        proof = F.concat(own_siblings(F.col("levels"), F.col("c")), "proof").alias("proof")
        if k:
            own = materialize(children.select(F.col("tree").alias("of"), i, "subroot", proof), f"{name}-proofs-{k}")
        else:
            return children.select("tree", i.alias("i"), "digest", F.get("items", F.col("c")).alias("item"), "subroot", proof)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def step(acc: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.when(s.startswith("R"), joined_digest(acc, other)).when(s.startswith("L"), joined_digest(other, acc)).otherwise(joined_digest(acc))

    return F.aggregate(proof, leaf, step)


def manifest(leaves: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, str | None]:
    """(tree, i, digest, item, subroot, proof) of every leaf and the root. Leaves: (tree, doc_id, digest, item)."""
    stored = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")  # hashed once, sorted after
    nodes = placed(stored, "tree", ["doc_id", "digest", "tie"], "merkle-sorted").select("tree", "i", "n", "digest", "item")
    blocks, tops = build(nodes, "merkle-blocks", stride)
    subroots = placed(tops.select(F.lit(0).alias("all"), F.col("tree").alias("of"), "digest"), "all", ["of"], "merkle-subroots")
    above, top = build(subroots.select(F.col("all").alias("tree"), "i", "n", "digest", F.struct("of").alias("item")), "merkle-top", stride)
    found = top.collect()  # one row
    if not found:
        return push(blocks, tops.select("tree", F.col("digest").alias("subroot"), F.array().cast(NONE).alias("proof")), "merkle", stride), None
    start = top.select("tree", F.lit("").alias("subroot"), F.array().cast(NONE).alias("proof"))
    inherited = push(above, start, "merkle-top", stride).select(F.col("item.of").alias("tree"), F.col("digest").alias("subroot"), "proof")
    return push(blocks, materialize(inherited, "merkle-inherited"), "merkle", stride), found[0]["digest"]


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = {c: encoded(F.col(c)) for c in COLUMNS}
    changed = parts | {"n_chars": encoded(F.col("n_chars") + 1)}
    other = F.when(tampered(F.col("doc_id")), joined_digest(*changed.values()))
    leaves = docs.select(F.col("lang").alias("tree"), "doc_id", joined_digest(*parts.values()).alias("digest"), F.struct("doc_id", other.alias("other")).alias("item"))
    rows, root = manifest(leaves)
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), ""), 256)
    out = rows.select("item.doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("item.other", "digest"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """WITH RECURSIVE
crc AS (SELECT doc_id, rn, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS BIGINT), 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s, row_number() OVER () AS rn FROM documents)),
d AS (SELECT *, row_number() OVER () AS rn FROM documents),
e AS (SELECT d.doc_id, lang, coalesce(crc % 7 = 0, FALSE) AS bad,
    coalesce(concat(strlen(CAST(d.doc_id AS VARCHAR)), ':', CAST(d.doc_id AS VARCHAR)), '-') || coalesce(concat(strlen(source), ':', source), '-') || coalesce(concat(strlen(lang), ':', lang), '-') AS head,
    coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', CAST(n_chars AS VARCHAR)), '-') AS size, coalesce(concat(strlen(CAST(n_chars + 1 AS VARCHAR)), ':', CAST(n_chars + 1 AS VARCHAR)), '-') AS size1,
    coalesce(concat(strlen(text), ':', text), '-') AS body FROM d JOIN crc USING (rn)),
leaves AS (SELECT doc_id, coalesce('x' || lang, '') AS tree, sha256(head || size || body) AS leaf, CASE WHEN bad THEN sha256(head || size1 || body) END AS other FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS lvl, i, n, leaf AS d FROM l
  UNION ALL SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 2, n),
subs AS (SELECT tree, lvl AS h, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS j, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, j AS i, m AS n, subroot AS d FROM subs
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2, n),
root AS (SELECT d AS root, lvl AS h FROM tops WHERE n = 1),
path AS (SELECT l.tree, l.i, k AS at_, (l.i >> k) % 2 AS side, x.d FROM l JOIN subs USING (tree), unnest(range(0, h)) AS t(k) LEFT JOIN nodes x ON x.tree = l.tree AND x.lvl = k AND x.i = xor(l.i >> k, 1)),
above AS (SELECT subs.tree, k AS at_, (j >> k) % 2 AS side, x.d FROM subs, root, unnest(range(0, root.h)) AS t(k) LEFT JOIN tops x ON x.lvl = k AND x.i = xor(j >> k, 1)),
p AS (SELECT tree, i, list(concat(CASE WHEN d IS NULL THEN '-' WHEN side = 0 THEN 'R' ELSE 'L' END, coalesce(d, '')) ORDER BY at_) AS p FROM path GROUP BY tree, i),
q AS (SELECT tree, list(concat(CASE WHEN d IS NULL THEN '-' WHEN side = 0 THEN 'R' ELSE 'L' END, coalesce(d, '')) ORDER BY at_) AS q FROM above GROUP BY tree),
r AS (SELECT doc_id, leaf, coalesce(other, leaf) AS used, subroot, root, list_concat(coalesce(p, []), coalesce(q, [])) AS proof FROM l JOIN subs USING (tree) JOIN root ON TRUE LEFT JOIN p ON p.tree = l.tree AND p.i = l.i LEFT JOIN q ON q.tree = l.tree),
f AS (SELECT *, list_reduce(list_prepend(used, proof), lambda a, s: CASE left(s, 1) WHEN 'R' THEN sha256(a || substr(s, 2)) WHEN 'L' THEN sha256(substr(s, 2) || a) ELSE sha256(a) END) AS folded_root FROM r)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: substr(s, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""
