"""Language-model scores from a weighted backoff automaton.

The model has three words, with Dirichlet smoothing at each order: P(w | u v) = (c(u v w) + K3 P(w | v)) / (c(u v) + K3),
P(w | v) = (c(v w) + K2 P(w)) / (c(v) + K2), and the add-one unigram P(w). As an automaton, each history that occurs in
training is a state: the root, words, and pairs of words. An n-gram that occurs is an arc of its history's state, with its
log10 probability, to the state of the longest known end of what was read. For other words a state has a failure arc to the
history without its first word, with log10 (K / (c + K)). A text is read once from left to right, from the state of a text's
start; where a state has no arc for the next word, failure arcs are followed until one has.

The state at a place is the longest known end of the text before it. So a block of texts is read in columns: the states
carried along are found for all places at once, then the failure arcs of all places are followed together.

No task holds the whole model. Documents are put into blocks of like size as they come, whatever their keys, and stored. A
block asks for the counts of just the n-grams that occur in it, in packed columns dealt over buckets of n-grams; a bucket
adds up the training counts of all blocks and answers each block; the block builds its part of the automaton from the
answers and reads its documents. Blocks and buckets are as many as the input's size asks for, so both keep their size.

Words are told apart by 64 bits of a hash, pairs and triples by 56. Defined results: null and empty texts are the end token
alone; repeated rows and ids are scored, and counted in training, as often as they occur; a null doc_id counts as training;
without training rows every count is 0; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import blocks_for, bucket_labels, materialize, table
from quillspark.llm.vectors import U, bucket_of, hash_words, mix, pack, pack_sorted, rows_of, tokens, unpack, unpack_sorted, words_of

K2, K3 = 1000.0, 50.0  # weight of the shorter history; of the nine pairs tried, the best for held-out texts
BLOCK_BYTES = 4 << 20  # of texts
END = hash_words([b"\x01end of text"])[0] ^ U(0x5DEECE66D)  # no word hashes to it but by chance
A, B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SHORT = U(8)  # bits that hashes of pairs and triples drop
ORDERS = ("uni", "bi", "tri")


def after(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * A + (word ^ B))


class Block:
    """The token stream of some texts, with their distinct n-grams and the places of each."""

    def __init__(self, texts: list[str | None]):
        parts = [np.append(h, END) for h in tokens([words_of(t) for t in texts])]
        self.ends = np.cumsum([len(p) for p in parts])
        self.tok = np.concatenate(parts) if parts else np.zeros(0, U)
        self.starts = np.append(0, self.ends[:-1]).astype(np.int64)
        pair = after(np.append(END, self.tok[:-1]), self.tok)  # a text starts after an end
        triple = after(np.append(U(0), pair[:-1]), self.tok) >> SHORT
        self.first = np.zeros(len(self.tok), bool)
        self.first[self.starts] = True
        triple[self.first] = 0  # a text's first word has no triple
        self.grams, self.at = zip(*(np.unique(x, return_inverse=True) for x in (self.tok, pair >> SHORT, triple)))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        w = np.repeat(train.astype(np.float64), self.ends - self.starts)
        return [np.bincount(at, w, len(g)).astype(np.uint32) for g, at in zip(self.grams, self.at)]


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    States: 0 is the root, then the block's words, then its pairs. `c`: the training counts of the block's n-grams.
    """

    def __init__(self, block: Block, c: list[np.ndarray], n: int, v: int, k2: float = K2, k3: float = K3):
        self.block, (c1, c2, c3) = block, [x.astype(np.float64) for x in c]
        uni, bi, tri = block.at
        words, pairs = len(c1), len(c2)
        last = np.append(np.searchsorted(block.grams[0], END), uni[:-1])  # the word before each place; texts start after an end
        before = np.where(block.first, -1, np.append(-1, bi[:-1]))  # the pair before each place, none for a text's first word
        # states along the texts: the longest known history
        self.state = np.where((before >= 0) & (c2[before] > 0), 1 + words + before, np.where(c1[last] > 0, 1 + last, 0))
        self.known = c1 > 0
        # failure arcs: a pair's leads to its last word, a word's to the root
        self.fail = np.zeros(1 + words + pairs, np.int64)
        self.fail[1 + words + bi] = 1 + uni
        with np.errstate(divide="ignore"):
            self.fail_weight = np.concatenate([[0.0], np.log10(k2 / (c1 + k2)), np.log10(k3 / (c2 + k3))])
            # arcs by n-gram, nan where there is none; the root has one for each word
            p1 = (c1 + 1) / (n + 1 * (v + 1))
            one = first_places(bi, pairs)
            p2 = (c2 + k2 * p1[uni[one]]) / (c1[last[one]] + k2)
            two = first_places(tri, len(c3))
            history = np.where(before[two] >= 0, c2[before[two]], 0.0)
            p3 = (c3 + k3 * p2[bi[two]]) / (history + k3)
            self.arcs = [np.log10(p1), np.where(c2 > 0, np.log10(p2), np.nan), np.where((c3 > 0) & (before[two] >= 0), np.log10(p3), np.nan)]
        self.words = words

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: base score, score, known tokens."""
        b = self.block
        state, total = self.state.copy(), np.zeros(len(b.tok))
        for order in (2, 1):  # pairs have arcs by triples, words by pairs
            here = state > self.words if order == 2 else (state > 0) & (state <= self.words)
            arc = np.where(here, self.arcs[order][b.at[order]], np.nan)
            taken = ~np.isnan(arc)
            total[taken] += arc[taken]
            state[taken] = -1  # done
            failing = here & ~taken
            total[failing] += self.fail_weight[state[failing]]
            state[failing] = self.fail[state[failing]]
            if order == 2:  # a failing pair's word may itself be without arcs only if it is unknown
                state[failing & (state > 0) & ~self.known[np.maximum(state - 1, 0) % max(self.words, 1)]] = 0
        root = state == 0
        base = self.arcs[0][b.at[0]]
        total[root] += base[root]
        add = lambda x: np.add.reduceat(x, b.starts) if len(b.starts) else np.zeros(0)
        return add(base), add(total), add(self.known[b.at[0]].astype(np.int64))


def first_places(at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at[::-1]] = np.arange(len(at))[::-1]
    return out


def stored_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, body): the rows (doc_id, train, text) as they come, some MB of texts together, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def body() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole)
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + number], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for b in batches:
            cut, ends = 0, np.cumsum([len(x) if x else 0 for x in b.column(2).cast(pa.large_binary()).to_pylist()])
            while cut < b.num_rows:
                done = ends[cut - 1] if cut else 0
                to = min(b.num_rows, int(np.searchsorted(ends, done + block_bytes - size)) + 1)
                held.append(b.slice(cut, to - cut))
                size, cut = size + int(ends[to - 1] - done), to
                if size >= block_bytes:
                    yield body()
                    number, held, size = number + 1, [], 0
        if held:
            yield body()

    return materialize(rows.mapInArrow(run, "block long, body binary"), "lm-blocks")


def opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def requests(blocks: DataFrame, labels: list[int]) -> DataFrame:
    """(bucket, block, uni, uni_n, bi, bi_n, tri, tri_n): per block and bucket the distinct n-grams and their training counts."""
    buckets = len(labels)
    fields = [f"{x}{n}" for x in ORDERS for n in ("", "_n")]
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                number, t = b.column(0)[i].as_py(), opened(b.column(1)[i].as_py())
                block = Block(t["text"].to_pylist())
                counts = block.counts(np.array(t["train"].to_pylist(), bool))
                cuts = [np.searchsorted(bucket_of(g << (U(0) if k == 0 else SHORT), buckets), np.arange(buckets + 1)) for k, g in enumerate(block.grams)]
                for j in range(buckets):
                    row = {"bucket": labels[j], "block": number}
                    for x, g, n, cut in zip(ORDERS, block.grams, counts, cuts):
                        row[x], row[f"{x}_n"] = pack_sorted(g[cut[j] : cut[j + 1]]), pack(n[cut[j] : cut[j + 1]])
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return blocks.mapInArrow(run, "bucket int, block long, " + ", ".join(f"{x} binary" for x in fields))


def answers(asked: DataFrame, labels: list[int]) -> DataFrame:
    """(block, bucket, uni, bi, tri, tokens, types): the counts over all blocks of what a block asked a bucket for."""
    place = {label: i for i, label in enumerate(labels)}
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ORDERS), ("tokens", pa.int64()), ("types", pa.int64())])

    def answer(number: int, rows: list[tuple]) -> pa.RecordBatch:
        out, n, v = {}, 0, 0
        for k, kind in enumerate(ORDERS):
            keys = [unpack_sorted(r[2 + 2 * k], U) for r in rows]
            counts = np.concatenate([unpack(r[3 + 2 * k], np.uint32) for r in rows])
            sizes = np.cumsum([len(x) for x in keys])[:-1]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            total = np.bincount(at, counts).astype(np.int64) if len(at) else np.zeros(0, np.int64)
            out[kind] = pa.array([pack(x) for x in np.split(total[at], sizes)], pa.binary())
            if not k:
                n, v = int(total.sum()), int((total > 0).sum())
        first = np.arange(len(rows)) == 0
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([place[number]] * len(rows), pa.int32()), *(out[x] for x in ORDERS), pa.array(n * first, pa.int64()), pa.array(v * first, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for b in batches:
            for row in rows_of(b):
                if row[0] != now and rows:
                    yield answer(now, rows)
                    rows = []
                now = row[0]
                rows.append(row)
        if rows:
            yield answer(now, rows)

    dealt = asked.repartition(len(labels), "bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(run, "block long, bucket int, uni binary, bi binary, tri binary, tokens long, types long"), "lm-counts", 4)  # rows are whole blocks


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", k2: float = K2, k3: float = K3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score); `train`: a column, true for the rows to learn from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), train.alias("train"), F.col(text_col).alias("text"))
    labels = bucket_labels(docs.sparkSession, blocks_for(docs, 8))
    blocks = stored_blocks(rows, block_bytes)
    counts = answers(requests(blocks, labels), labels)
    sums = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n, v = int(sums[0]), int(sums[1])
    of_block = counts.groupBy(F.col("block").alias("of")).agg(F.sort_array(F.collect_list(F.struct("bucket", *ORDERS))).alias("counts"))
    joined = blocks.join(of_block.hint("merge"), F.col("block") == F.col("of")).select("body", "counts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, found = opened(b.column(0)[i].as_py()), b.column(1)[i].as_py()
                block = Block(t["text"].to_pylist())
                whole = [np.concatenate([unpack(x[kind], np.int64) for x in found]) for kind in ORDERS]
                base, full, known = Automaton(block, whole, n, v, k2, k3).read()
                out = [t["doc_id"].combine_chunks(), t["train"].combine_chunks(), pa.array(block.ends - block.starts, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(base), n), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return materialize(joined.mapInArrow(read, schema), "lm-scores", 4)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
