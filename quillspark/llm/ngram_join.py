"""N-gram Jaccard self-join by grouped prefixes.

Sets are hashed word shingles under one global order: estimated document frequency, rarest first, then the hash. Any
order gives all links; this one keeps common passages out of prefixes. Two sets with 100 |x & y| >= 80 |x | y| share a
token among the first n - ceil(0.8 n) + 1 of each.

1. Documents with equal words in a row (by a 128-bit digest) form a class, represented by its least doc_id.
2. Classes that share one of four min-hashes with others are linked to the least class of that min-hash if the
   verified similarity suffices: a linear number of pairs that ties large families of near copies together.
3. Prefix tokens are dealt over buckets in packed columns. In a bucket, the classes with an equal prefix and size (and
   component so far) are collapsed into one group; pairs of groups of different components that share a token are
   filtered by size and position, then expanded into their members. A token that more than HOT documents may have is
   split into blocks of documents, and each pair of blocks is a token of its own, so that no task holds all of them.
4. Expanded pairs are verified on the words of the full sets, not on hashes, and components of both kinds of links are
   labelled.

For components, pairs inside one component already are left out, so no link between components is lost. `class_links`
and `link_counts` take no such step: they verify all pairs of classes, inside components too. The order's frequencies
come from counters of fixed number (2 ** SKETCH_BITS), filled from all documents; it is all that is broadcast besides
id sets whose size is checked first.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer than `width`
words have one shingle; rows that repeat a doc_id count as one vertex, so a link of either row joins both; a null
doc_id gets a null component. Texts of equal sets in another order of words are linked like others. `deduplicate_near`
decides row by row: rows of repeated or null ids are vertices of their own, and other columns may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import blocks_for, bucket_labels, materialize, numbered, small_enough, table
from quillspark.llm.components import components
from quillspark.llm.vectors import U, bucket_of, mix, pack, pack_sorted, rows_of, shingles, slices_of, unpack, unpack_sorted, words_of

WIDTH, PERCENT = 5, 80
SKETCH_BITS, SKETCH_ROWS = 21, 64
HOT = 8192  # documents of a token that are matched in one task
MINHASHES = 4
FLUSH = 500_000  # pairs held before they are handed on



def with_shingles(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """A batch's rows with the words of their text, the last column, and its shingles."""
    for *cols, texts in slices_of(batch):
        words = [words_of(t) for t in texts]
        yield from zip(*cols, words, shingles(words, width))


def features(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's size, key and min-hashes, and per task the counters of its tokens (rows with a `part`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        seeds = mix(np.arange(1, MINHASHES + 1, dtype=U))
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("mins", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
        for b in batches:
            rows, held = [], []
            for ids, texts in slices_of(b):
                words = [words_of(t) for t in texts]
                sets = shingles(words, width)
                full = [s for s in sets if len(s)]
                mins = iter(())
                if full:
                    every, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                    mins = iter(np.stack([np.minimum.reduceat(mix(every ^ x), starts) for x in seeds], 1).view(np.int64).tolist())
                    held.append((every >> U(64 - SKETCH_BITS)).astype(np.int64))
                for i, w, s in zip(ids, words, sets):
                    key = np.frombuffer(hashlib.blake2b(b" ".join(w), digest_size=16).digest(), np.int64).tolist() if len(s) else (0, 0)
                    rows.append({"doc_id": i, "n": len(s), "k1": key[0], "k2": key[1], "mins": next(mins) if len(s) else [], "part": None, "counts": None})
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if counts.any():
            parts = np.split(counts.astype(np.uint32), SKETCH_ROWS)
            yield pa.RecordBatch.from_pylist([{"doc_id": None, "n": 0, "k1": 0, "k2": 0, "mins": None, "part": i, "counts": pack(x)} for i, x in enumerate(parts)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, mins array<long>, part int, counts binary")


def token_order(found: DataFrame) -> np.ndarray:
    """Per counter the number of documents with a token of it, as far as 32 bits go: 8 MB at any input size."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpack(x, np.uint32).astype(np.int64) for x in t["counts"].to_pylist())
        return pa.table({"part": t["part"].slice(0, 1), "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    rows = found.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    order = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.uint32)
    for r in rows:
        order[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return order.ravel()


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets are similar enough, by their whole texts."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "join-ids")
    wanted = F.broadcast(ids) if small_enough(ids) else ids
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    left = pairs.join(texts, F.col("a") == F.col("doc_id")).select("a", "b", F.col("text").alias("ta"))
    both = left.join(texts.select(F.col("doc_id").alias("id_b"), F.col("text").alias("tb")), F.col("b") == F.col("id_b")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sb = None, None
        for batch in batches:
            keep = []
            for i, (_, b, ta, tb) in enumerate(rows_of(batch)):
                if b != last:
                    last, sb = b, word_sets(tb, width)
                sa = word_sets(ta, width)
                common = len(sa & sb)
                if 100 * common >= percent * (len(sa) + len(sb) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    return both.mapInArrow(run, "a long, b long")


def word_sets(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as words."""
    w = words_of(text)
    return set(zip(*(w[j:] for j in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the least class of each min-hash that it shares with others."""
    each = classes.select("rep", F.posexplode("mins").alias("j", "m"))
    pivots = each.groupBy("j", "m").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).where("c > 1").select(F.col("j").alias("pj"), F.col("m").alias("pm"), "pivot")
    return each.join(pivots, (F.col("j") == F.col("pj")) & (F.col("m") == F.col("pm"))).where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()


def f_of(s: np.ndarray, freq: np.ndarray) -> np.ndarray:
    return freq[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]


def blocks_of(f: np.ndarray, usual: int) -> np.ndarray:
    """In how many blocks tokens are split by their counters, which hold `usual` documents of other tokens too."""
    step = max(HOT, usual)
    return np.where(f > usual + step, 2 * (f - usual) // step + 2, 1)


def split_hot(front: np.ndarray, places: np.ndarray, blocks: np.ndarray, doc_id: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's prefix with each hot token replaced by its tokens for pairs of blocks: the document is in one block,
    chosen by its id, and meets the documents of each block, its own included, in such a pair."""
    out, at = [front[blocks == 1]], [places[blocks == 1]]
    for t, p, n in zip(front[blocks > 1], places[blocks > 1].tolist(), blocks[blocks > 1].tolist()):
        own = int(mix(np.array([doc_id], np.int64).view(U))[0] % U(n))
        other = np.delete(np.arange(n, dtype=U), own)
        pair = np.minimum(other, U(own)) * U(n) + np.maximum(other, U(own))
        out.append(mix(t ^ mix(pair + U(1))))
        at.append(np.full(len(pair), p))
    return np.concatenate(out), np.concatenate(at)


def prefix_postings(docs: DataFrame, marks: DataFrame, order, labels: list[int], width: int, percent: int) -> DataFrame:
    """(bucket, body): per task and bucket the postings of prefix tokens, packed. `marks`: (id, comp) of documents in a
    component so far, and with a null comp of documents that another one of their class represents."""
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("id"), "left").where("id IS NULL OR comp IS NOT NULL")
    rows = rows.select("doc_id", F.coalesce("comp", "doc_id").alias("comp"), "text")
    buckets = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = order.value
        usual = int(np.median(freq))
        schema = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])
        tok, pos, ref, table_ = [], [], [], []
        size = 0

        def flush():
            t, p, r = np.concatenate(tok), np.concatenate(pos), np.concatenate(ref)
            d = np.array(table_, np.int64).reshape(-1, 4)  # doc_id, comp, n, group key
            by = np.argsort(t)
            t, p, r = t[by], p[by], r[by]
            cut = np.searchsorted(bucket_of(t, buckets), np.arange(buckets + 1))
            out = []
            for i in range(buckets):
                lo, hi = cut[i], cut[i + 1]
                if hi > lo:
                    used, at = np.unique(r[lo:hi], return_inverse=True)
                    x = d[used]
                    cols = [pack_sorted(t[lo:hi]), pack(p[lo:hi].astype(np.uint32)), pack(at.astype(np.uint32)), pack(np.diff(x[:, 0], prepend=0)), pack(x[:, 1] - x[:, 0]), pack(x[:, 2].astype(np.uint32)), pack(x[:, 3])]
                    out.append({"bucket": labels[i], "body": b"".join(len(c).to_bytes(4, "little") + c for c in cols)})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for b in batches:
            for i, comp, _, s in with_shingles(b, width):
                n = len(s)
                if not n:
                    continue
                take = n - (percent * n + 99) // 100 + 1
                front = s[np.lexsort((s, f_of(s, freq)))[:take]]
                places = np.arange(take)
                group = int.from_bytes(hashlib.blake2b(front.tobytes(), digest_size=8, key=n.to_bytes(8, "little")).digest(), "little", signed=True)
                blocks = blocks_of(f_of(front, freq).astype(np.int64), usual)
                if (blocks > 1).any():
                    front, places = split_hot(front, places, blocks, i)
                tok.append(mix(~front))  # ties in the order favour small hashes: spread anew, they are dealt evenly
                pos.append(places)
                ref.append(np.full(len(front), len(table_)))
                table_.append((i, comp, n, group))
                size += len(front)
                if size > 2_000_000:
                    yield flush()
                    tok, pos, ref, table_, size = [], [], [], [], 0
        if size:
            yield flush()

    return rows.mapInArrow(run, "bucket int, body binary")


def decode(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cols, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        cols.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    ids = np.cumsum(unpack(cols[3], np.int64))
    docs = np.stack([ids, ids + unpack(cols[4], np.int64), unpack(cols[5], np.uint32).astype(np.int64), unpack(cols[6], np.int64)], 1)
    return unpack_sorted(cols[0], U), unpack(cols[1], np.uint32).astype(np.int64), unpack(cols[2], np.uint32).astype(np.int64), docs


def bucket_pairs(bodies: list[bytes], percent: int) -> Iterator[np.ndarray]:
    """Candidate pairs of one bucket as arrays of (doc_id, doc_id), each sorted and distinct within an array."""
    tok, pos, ref, docs, base = [], [], [], [], 0
    for body in bodies:
        t, p, r, d = decode(body)
        tok.append(t), pos.append(p), ref.append(r + base), docs.append(d)
        base += len(d)
    tok, pos, ref, docs = np.concatenate(tok), np.concatenate(pos), np.concatenate(ref), np.concatenate(docs)
    by = np.argsort(tok)
    tok, pos, ref = tok[by], pos[by], ref[by]
    edge = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    long = np.diff(np.append(edge, len(tok))) > 1
    live = np.repeat(long, np.diff(np.append(edge, len(tok))))
    tok, pos, ref = tok[live], pos[live], ref[live]
    if not len(tok):
        return
    # collapse the members of a group: equal prefix and size, and one component
    by = np.lexsort((docs[ref, 1], docs[ref, 3], tok))
    tok, pos, ref = tok[by], pos[by], ref[by]
    comp, key, n, ids = docs[ref, 1], docs[ref, 3], docs[ref, 2], docs[ref, 0]
    head = np.append(True, (tok[1:] != tok[:-1]) | (key[1:] != key[:-1]) | (comp[1:] != comp[:-1]) | (n[1:] != n[:-1]))
    g = np.flatnonzero(head)  # groups: their first member
    g_end = np.append(g[1:], len(tok))
    by = np.lexsort((n[g], tok[g]))  # by size within a token, so that a group looks as far as sizes fit
    g, g_end = g[by], g_end[by]
    g_tok, g_comp, g_n, g_pos = tok[g], comp[g], n[g], pos[g]
    run = np.flatnonzero(np.append(True, g_tok[1:] != g_tok[:-1]))
    length = np.diff(np.append(run, len(g_tok)))

    def passing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = g_n[a], g_n[b]
        bound = 1 + np.minimum(na - g_pos[a], nb - g_pos[b]) - 1
        ok = (g_comp[a] != g_comp[b]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * bound >= percent * (na + nb))
        a, b = a[ok], b[ok]
        one = (g_end[a] - g[a] == 1) & (g_end[b] - g[b] == 1)
        out = [np.stack([ids[g[a[one]]], ids[g[b[one]]]], 1)]
        for x, y in zip(a[~one], b[~one]):
            i, j = ids[g[x] : g_end[x]], ids[g[y] : g_end[y]]
            out.append(np.stack([np.repeat(i, len(j)), np.tile(j, len(i))], 1))
        return np.concatenate(out)

    held, count = [], 0
    for m in np.unique(length[length > 1]):
        starts = run[length == m]
        i, j = np.triu_indices(m, 1) if m <= 512 else (None, None)
        if i is not None:
            step = max(1, 1_000_000 // len(i))
            chunks = ((np.repeat(s, len(i)) + np.tile(i, len(s)), np.repeat(s, len(i)) + np.tile(j, len(s))) for s in np.split(starts, range(step, len(starts), step)))
        else:
            reach = lambda s: s + np.searchsorted(100 * g_n[s : s + m], -(-g_n[s : s + m] * 10000 // percent), side="right")
            chunks = ((np.full(y - s - x - 1, s + x), np.arange(s + x + 1, y)) for s in starts for x, y in enumerate(reach(s).tolist()) if y > s + x + 1)
        for a, b in chunks:
            if len(p := passing(a, b)):
                held.append(p)
                count += len(p)
            if count > FLUSH:
                yield distinct_pairs(np.concatenate(held))
                held, count = [], 0
    if held:
        yield distinct_pairs(np.concatenate(held))


def distinct_pairs(p: np.ndarray) -> np.ndarray:
    p = np.sort(p[p[:, 0] != p[:, 1]], 1)
    return np.unique(p, axis=0)


def candidates(postings: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            held, now = [], None
            for b in batches:
                for bucket, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if bucket != now and held:
                        yield from bucket_pairs(held, percent)
                        held = []
                    now = bucket
                    held.append(body)
            if held:
                yield from bucket_pairs(held, percent)

        for p in pairs():
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    dealt = postings.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def equal_sets(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets (k1, k2, rep, mins), documents (doc_id, n, rep), and the ids that a class's least one represents."""
    sets = found.where("part IS NULL").select("doc_id", "n", "k1", "k2", "mins")
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins"))
    classes = materialize(classes, "join-classes")
    of_class = materialize(sets.join(classes.drop("mins"), ["k1", "k2"], "left").select("doc_id", "n", "rep"), "join-members")
    copies = of_class.where("rep <> doc_id").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("comp"))
    reps = classes.select(F.col("rep").alias("r")).distinct()
    return classes, of_class, copies.join(reps, F.col("id") == F.col("r"), "left_anti").distinct()


def class_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links (a, b), a < b, between the least documents of classes of equal sets, also inside components; and the
    documents (doc_id, n, rep) of the classes. A family of k different near copies has up to k (k - 1) / 2 links."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(features(docs, width), "join-features")
    _, of_class, marks = equal_sets(found)
    order = spark.sparkContext.broadcast(token_order(found))
    marks = materialize(marks, "join-marks")
    marks = F.broadcast(marks) if small_enough(marks) else marks
    buckets = blocks_for(docs, 8)
    labels = bucket_labels(spark, buckets)
    pairs = materialize(candidates(prefix_postings(docs, marks, order, labels, width, percent), buckets, percent), "join-pairs")
    return materialize(verified(docs, pairs, width, percent).distinct(), "join-all-links"), of_class


def link_counts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, class_id (the least document of an equal set) and n_links, the other classes that
    its class is linked with."""
    links, of_class = class_links(docs, width, percent)
    ends = links.select(F.col("a").alias("end")).union(links.select("b")).groupBy("end").agg(F.count("*").alias("c"))
    return of_class.join(ends, F.col("rep") == F.col("end"), "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("c", F.lit(0)).alias("n_links"))


def similarity_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(features(docs, width), "join-features")
    classes, of_class, copies = equal_sets(found)
    order = spark.sparkContext.broadcast(token_order(found))
    stars = materialize(star_pairs(classes), "join-stars")
    # a repeated doc_id with different sets belongs to several classes, and joins them
    again = of_class.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = materialize(verified(docs, stars, width, percent), "join-links")
    first = materialize(components(links), "join-components")
    marks = copies.union(first.select("id", F.col("component").alias("comp")))
    marks = materialize(marks, "join-marks")
    marks = F.broadcast(marks) if small_enough(marks) else marks
    buckets = blocks_for(docs, 8)
    labels = bucket_labels(spark, buckets)
    pairs = materialize(candidates(prefix_postings(docs, marks, order, labels, width, percent), buckets, percent), "join-pairs")
    more = verified(docs, pairs, width, percent)
    to = first.select(F.col("id"), F.col("component").alias("c"))
    both = more.union(again.select("a", "b").distinct())
    lifted = both.join(to, F.col("a") == F.col("id"), "left").select(F.coalesce("c", "a").alias("a"), "b")
    lifted = lifted.join(to, F.col("b") == F.col("id"), "left").select("a", F.coalesce("c", "b").alias("b"))
    second = components(lifted)
    top = materialize(second, "join-top").select(F.col("id").alias("i2"), F.col("component").alias("c2"))
    label = of_class.join(to, F.col("rep") == F.col("id"), "left").select("doc_id", "n", F.coalesce("c", "rep", "doc_id").alias("c1"))
    label = label.join(top, F.col("c1") == F.col("i2"), "left")
    return label.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c2", "c1").alias("component_id"))


def deduplicate_near(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that are the least of their component, with all their columns; texts without words all stay.

    Where ids are repeated or null, rows are numbered first, in order of id (null last), text and all columns.
    """
    rows = numbered(docs, "join-rows")
    if rows is None:
        drop = similarity_components(docs, width, percent).where("component_id < doc_id").select("doc_id")
        return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    rows = rows.withColumnRenamed("rid", "doc_id")
    drop = similarity_components(rows, width, percent).where("component_id < doc_id").select("doc_id")
    return rows.join(drop, "doc_id", "left_anti").select("row.*")


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ e ON e.a = r.other),
least_ AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_ l USING (doc_id)
"""
