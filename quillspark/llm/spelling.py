"""Spelling variants: words that differ by one letter are grouped under the form that is much more frequent.

Words are counted with a partial sum before the exchange. The vocabulary is sorted over ranges and each range packed into
compact tries of at most `SHARD` letters, nodes level by level, so that a node's children stand side by side. The shards are
broadcast some at a time, at most `ROUND` bytes of them, and each word's distance-one Levenshtein automaton runs depth-first
through every shard of the round: while no edit was made it follows the word's own path, and at each node of it may leave out
the next letter, take a child in its place or before it; after the edit only the exact rest is walked. A shard whose words
start otherwise is left at its first nodes. Accepted neighbours are reduced to their count and the best of them, in the task
and then over all rounds. Chains of forms are followed by doubling; a form's count is five times that of the word before it
or more, so chains are as short as the logarithm of the greatest count, and a word of n letters is the form of at most
64 (2 n + 1) others, so no key of these joins is hot.

Defined results: null and empty texts have no words. A null identifier deletes nothing. Repeated rows count each time. A text
without a word that is frequent enough adds nothing; an empty table gives no rows. Of near words with one count the first in
code-point order is the form. Letters are those of the fixed pattern, whose code points fit one byte each. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, forget, materialize, table
from quillspark.llm.vectors import slices_of

NOT_LETTERS = "[^a-zÀ-ÿ]+"  # once A-Z are lower-cased
LEAST_LETTERS, LEAST_TIMES, TIMES, DROPPED = 6, 5, 5, 199
SHARD, ROUND = 1 << 18, 32 << 20  # letters of a shard, a longer word alone; bytes of the shards that are broadcast at once
TASK = 1 << 16  # letters of the words that a task searches for
NEAR = "word string, n_near long, best long, near string"


def word_counts(docs: DataFrame, dropped: int = DROPPED, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): runs of letters, some without one letter by the checksum of identifier and run."""
    runs = docs.select("doc_id", F.explode(F.split(ascii_lower(F.col("text")), NOT_LETTERS)).alias("run")).where(F.length("run") >= letters)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("k"))
    word = F.when(F.col("h") % dropped == 0, F.concat(F.expr("left(run, k)"), F.expr("substring(run, k + 2)"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


class Trie:
    """Sorted words in nodes level by level: `labels` of the nodes, `start`, the first child of each (the next one's start is its
    end), and `n`, the count of the word that ends there, or 0."""

    def __init__(self, labels: bytes, start: bytes, n: bytes):
        self.labels, self.start, self.n = labels, memoryview(start).cast("I"), memoryview(n).cast("q")

    def end(self, node: int, rest: bytes) -> int:
        """The node after `rest` from a node, or -1."""
        find, start = self.labels.find, self.start
        for c in rest:
            node = find(c, start[node], start[node + 1])
            if node < 0:
                return -1
        return node

    def neighbours(self, word: bytes) -> Iterator[tuple[int, bytes]]:
        """(count, word) of the words at distance one, each once: a letter is left out at the end of a run of it, and put in
        where another follows."""
        labels, start, n, end = self.labels, self.start, self.n, self.end
        node, size = 0, len(word)
        for i in range(size + 1):
            own = word[i] if i < size else -1
            rest, after = word[i:], word[i + 1 :]
            if own >= 0 and after[:1] != word[i : i + 1]:
                k = end(node, after)
                if k >= 0 and n[k]:
                    yield n[k], word[:i] + after
            path = -1
            for child in range(start[node], start[node + 1]):
                c = labels[child]
                if c == own:
                    path = child
                    continue
                k = end(child, rest)
                if k >= 0 and n[k]:
                    yield n[k], word[:i] + labels[child : child + 1] + rest
                if own >= 0:
                    k = end(child, after)
                    if k >= 0 and n[k]:
                        yield n[k], word[:i] + labels[child : child + 1] + after
            if path < 0:
                return
            node = path


def pack(words: list[bytes], counts: list[int]) -> tuple[bytes, bytes, bytes]:
    """A trie's labels, starts and counts, level by level: at each depth a node for every word that differs from the one before
    it in its letters so far."""
    size = np.array([len(w) for w in words])
    at = np.cumsum(size) - size
    letters = np.frombuffer(b"".join(words), np.uint8)
    labels, starts, ends = [np.zeros(1, np.uint8)], [], [np.zeros(1, np.int64)]
    live, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # words that are long enough, and their nodes of the level above
    total, depth, above = 1, 0, 1
    n = np.array(counts, np.int64)
    while above:
        keep = size[live] > depth
        live, node = live[keep], node[keep]
        label = letters[at[live] + depth]
        new = np.append(True, (node[1:] != node[:-1]) | (label[1:] != label[:-1]))[: len(live)]
        first = np.bincount(node[new], minlength=above)  # children of each node above
        starts.append(total + np.cumsum(first) - first)
        node = np.cumsum(new) - 1
        above, depth = int(new.sum()), depth + 1
        total += above
        labels.append(label[new])
        done = size[live] == depth
        found = np.zeros(above, np.int64)
        found[node[done]] = n[live[done]]
        ends.append(found)
    start = np.append(np.concatenate(starts), [total])
    return np.concatenate(labels).tobytes(), start.astype(np.uint32).tobytes(), np.concatenate(ends).tobytes()


def shards(words: DataFrame, total: int, letters: int = SHARD) -> DataFrame:
    """(labels, start, n, size) of tries of the sorted words (word, n), which have `total` letters, `letters` at most in each."""
    ranged = words.repartitionByRange(max(1, -(-total // letters)), "word").sortWithinPartitions("word")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            parts = pack([w for w, _ in held], [n for _, n in held])
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in parts], pa.array([sum(map(len, parts))], pa.int64())], names=["labels", "start", "n", "size"])

        held, size = [], 0
        for b in batches:
            for columns in slices_of(b, 4096):
                for word, n in zip(*columns):
                    if held and size + len(word) > letters:
                        yield row()
                        held, size = [], 0
                    held.append((word.encode("latin-1"), n))
                    size += len(word)
        if held:
            yield row()

    return ranged.mapInArrow(packed, "labels binary, start binary, n binary, size long")


def rounds(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Shards by rounds, `most` bytes in each; a larger shard has one of its own."""
    out, held = [], 0
    for k, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(k)
        held += size
    return out


def near_words(words: DataFrame, letters: int = SHARD, most: int = ROUND) -> DataFrame:
    """(word, n_near, best, near): of each word that has near ones among (word, n), how many, and the most frequent."""
    spark = words.sparkSession
    total = words.agg(F.sum(F.length("word")).alias("n")).first()["n"] or 0
    stored = materialize(shards(words, total, letters).withColumn("k", F.monotonically_increasing_id()), "spelling-tries")
    sizes = [(r["k"], r["size"]) for r in stored.select("k", "size").orderBy("k").collect()]  # a row per shard, of `letters` letters
    parts, asked = [], words.select("word").repartition(max(1, -(-total // TASK)))
    for chosen in rounds(sizes, most):
        held = spark.sparkContext.broadcast([(bytes(r["labels"]), bytes(r["start"]), bytes(r["n"])) for r in stored.where(F.col("k").between(chosen[0], chosen[-1])).orderBy("k").collect()])  # `most` bytes

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tries = [Trie(*x) for x in held.value]
            for b in batches:
                for (names,) in slices_of(b, 1024):
                    out = []
                    for name in names:
                        count, best = 0, (0, b"")
                        for trie in tries:
                            for n, near in trie.neighbours(name.encode("latin-1")):
                                count += 1
                                best = min(best, (-n, near))
                        if count:
                            out.append((name, count, -best[0], best[1].decode("latin-1")))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best", "near"])

        parts.append(materialize(asked.mapInArrow(search, NEAR), "spelling-near"))
        held.destroy()
    forget(stored)
    if not parts:
        return words.sparkSession.createDataFrame([], NEAR)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = F.min(F.struct((-F.col("best")).alias("b"), "near"))
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.b")).alias("best"), "f.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling."""
    links = materialize(forms.select("word", F.col("form").alias("at")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("from_"), F.col("at").alias("to_"))
        step = materialize(links.join(ahead, F.col("at") == F.col("from_"), "left").select("word", F.coalesce("to_", "at").alias("at"), F.col("to_").isNotNull().alias("moved")), "spelling-links")
        forget(links)
        links = step
        if links.where("moved").isEmpty():
            return links.select("word", F.col("at").alias("root"))


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of `docs` (doc_id, text)."""
    words = materialize(word_counts(docs.select("doc_id", "text")), "spelling-words", 10_000)
    near = near_words(words)
    chosen = F.col("best") >= F.col("n") * times
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("near")).alias("form"), F.when(chosen, F.col("best")).alias("form_n"))
    rows = materialize(rows, "spelling-forms", 10_000)
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH RECURSIVE
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each_ AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS b FROM each_),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM bytes),
v AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
p AS (SELECT word, n, CAST(k AS BIGINT) AS k FROM v, unnest(range(1, length(word) + 1)) AS t(k)),
r AS (SELECT word, n, left(word, k - 1) || '?' || substr(word, k + 1) AS key FROM p),
d AS (SELECT DISTINCT word, n, left(word, k - 1) || substr(word, k + 1) AS less FROM p),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM r a JOIN r b USING (key) WHERE a.word <> b.word
  UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS best, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN best END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN g USING (word)),
chain(word, at_) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at_ WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at_ AS root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word) JOIN f e ON e.word = chain.at_ AND e.form IS NULL"""
