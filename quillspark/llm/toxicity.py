"""Toxicity scores from a weighted finite-state pattern grammar.

Small transducers read a sentence's tokens by class: insult, threat, target, negation and reported speech. Their
composition is one automaton whose arcs emit a pattern for every insult or threat, such as `insult+aimed` or
`insult+negated`. Commas and colons end what a target or a negation reaches, but not reported speech, which also goes on
through quotation marks. Quotes whose reporting verb follows them are found by a transducer that reads the sentence from
its end and marks tokens before the others read them. A match scores its pattern's weight times the lexeme's weight; a
text's score is the chance that at least one of its matches is toxic.

Lexemes (words, and stems for inflected words) and the weights of patterns are learned from labelled rows outside the
held-out fold, at most `sample` of them, in the order of a hash of the id. A lexeme's support counts distinct texts by
the digest of the whole text with its white space made equal, so that copies of one text don't make its words insults.

Sentences are read whole, texts of any length too. Defined results: null, empty and wordless texts score the floor; rows are scored one by one, so repeated rows and ids
get equal scores; without labels the seed lexicon and prior weights alone are used; of labels that repeat an id the largest holds; other
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quillspark.llm.common import fresh, materialize, table
from quillspark.llm.exact_dedup import normalized
from quillspark.llm.vectors import rows_of

SAMPLE = 20_000  # labelled rows that the weights are learned from, at most
STEMS = (4, 5, 6)  # lengths of stems
SUPPORT, SHARE, PRECISION = 4, 0.01, 0.9  # a lexeme's distinct toxic texts, at least; as a share of all toxic rows; lower bound of its precision
FLOOR = 0.02
SEEDS = {"idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "bastard", "bitch", "asshole", "retard", "vermin", "filth"}
CLASSES = {
    "h": {"kill", "hurt", "destroy", "beat", "stab", "shoot", "crush", "burn", "murder"},
    "t": {"you", "your", "youre", "they", "them", "he", "she", "him", "her", "u", "these", "those"},
    "n": {"not", "never", "isn", "aren", "wasn", "hardly", "nicht", "nunca", "jamais"},
    "r": {"said", "says", "say", "called", "quoted", "wrote", "writes", "claimed", "alleged", "reported", "shouted", "yelled", "asked", "replied", "answered", "told", "whispered", "screamed", "posted", "stated", "remarked", "sagte", "schrieb", "rief", "dijo", "dit"},
}
PRIOR = {"insult": 0.9, "aimed": 0.95, "negated": 0.15, "reported": 0.25, "threat": 0.85}
WORD = re.compile(r"[^\W\d_]+")
QUOTES = '"\u201c\u201d\u201e\u00ab\u00bb'
TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES}]|[,:]")
SENTENCE = re.compile(rf"[.!?;\n]+(?![{QUOTES}])")  # a mark before a closing quote doesn't end the sentence around it
ALPHABET = "xihtnrqpIHT"  # classes; q: quotation mark, p: pause; large letters: tokens of a quote whose verb follows
AHEAD = 3  # tokens from a quote's end to its verb


class Transducer:
    """A deterministic transducer over token classes: step(state, class) gives (state, outputs)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __mul__(self, other: Transducer) -> Transducer:
        def step(state, c):
            a, x = self.step(state[0], c)
            b, y = other.step(state[1], c)
            return (a, b), x | y

        return Transducer((self.start, other.start), step)

    def compiled(self, alphabet: str) -> dict:
        """All reachable states' arcs: (state number, class) to (state number, pattern or None)."""
        number, todo, arcs = {self.start: 0}, [self.start], {}
        while todo:
            s = todo.pop()
            for c in alphabet:
                t, out = self.step(s, c)
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                arcs[number[s], c] = number[t], pattern_of(out)
        return arcs


def pattern_of(out: frozenset) -> str | None:
    if not out & {"insult", "threat"}:
        return None
    return "+".join(x for x in ("insult", "threat", "aimed", "negated", "reported") if x in out)


def fading(opener: str, span: int, mark: str, on: str) -> Transducer:
    """After an opener, tokens of the classes `on` within `span` tokens are marked, up to the next pause or quotation mark."""

    def step(left, c):
        c = c.lower()
        out = frozenset([mark]) if left and c in on else frozenset()
        return (0 if c in "pq" else span if c in opener else max(0, left - 1)), out

    return Transducer(0, step)


def speech(span: int = 6) -> Transducer:
    """Tokens within `span` of a reporting verb, all tokens of a quote that such a verb opens, and large letters are reported.

    States: tokens left after a verb, "in" an attributed quote, "out" in another one.
    """

    def step(state, c):
        told = c.lower() in "ith" and (c.isupper() or state == "in" or (isinstance(state, int) and state > 0))
        out = frozenset(["reported"]) if told else frozenset()
        if c == "q":
            return (0 if isinstance(state, str) else "in" if state else "out"), out
        if c == "p" or isinstance(state, str):
            return state, out
        return (span if c == "r" else max(0, state - 1)), out

    return Transducer(0, step)


def attributed() -> Transducer:
    """Over a sentence from its end: the tokens of a quote after whose end a reporting verb comes within AHEAD tokens."""

    def step(state, c):
        out = frozenset(["quoted"]) if state == "in" and c != "q" else frozenset()
        if c == "q":
            return (0 if isinstance(state, str) else "in" if state else "out"), out
        if c == "p" or isinstance(state, str):
            return state, out
        return (AHEAD if c == "r" else max(0, state - 1)), out

    return Transducer(0, step)


def grammar() -> dict:
    insult = Transducer(0, lambda s, c: (0, frozenset(["insult"]) if c in "iI" else frozenset()))
    threat = fading("h", 3, "threat", "t")
    target = fading("t", 4, "aimed", "i")
    negation = fading("n", 2, "negated", "i")
    return (insult * threat * target * negation * speech()).compiled(ALPHABET)


class Scorer:
    def __init__(self, lexemes: dict[str, float], weights: dict[str, float]):
        self.words = {k: w for k, w in lexemes.items() if not k.endswith("*")}
        self.stems = {n: {k[:-1]: w for k, w in lexemes.items() if k.endswith("*") and len(k) == n + 1} for n in STEMS}
        self.weights, self.arcs, self.quotes = weights, grammar(), attributed()
        self.classes = {w: c for c, ws in CLASSES.items() for w in ws}

    def lexeme(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for n, stems in self.stems.items():
            if stems:
                w = max(w, stems.get(word[:n], 0.0))
        return w

    def patterns(self, text: str | None) -> list[tuple[str, float]]:
        """(pattern, lexeme weight) of each match, clause by clause."""
        if not text:
            return []
        low = text.lower()
        known = set(WORD.findall(low))
        hot = {w: x for w in known if (x := self.lexeme(w))}
        if not hot and not known & CLASSES["h"]:
            return []
        out = []
        for sentence in SENTENCE.split(low):
            tokens = TOKEN.findall(sentence)
            classes = self.classed(tokens, hot)
            state = 0
            for w, c in zip(tokens, classes):
                state, pattern = self.arcs[state, c]
                if pattern:
                    out.append((pattern, hot.get(w, 1.0)))
        return out

    def classed(self, tokens: list[str], hot: dict[str, float]) -> list[str]:
        """The tokens' classes, in large letters within quotes whose verb follows."""
        classes = ["q" if w in QUOTES else "p" if w in ",:" else "i" if w in hot else self.classes.get(w, "x") for w in tokens]
        if "q" in classes and "r" in classes:
            state, right = self.quotes.start, self.quotes
            for k in range(len(classes) - 1, -1, -1):
                state, marks = right.step(state, classes[k])
                if marks and classes[k] in "iht":
                    classes[k] = classes[k].upper()
        return classes

    def score(self, text: str | None) -> float:
        miss = 1 - FLOOR
        for pattern, w in self.patterns(text):
            miss *= 1 - min(0.999, self.weights.get(pattern, prior(pattern)) * w)
        return 1 - miss


def prior(pattern: str) -> float:
    parts = pattern.split("+")
    return min([PRIOR[x] for x in parts if x in ("negated", "reported")] or [max(PRIOR[x] for x in parts)])


def fold(mod: int, col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod == 2, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~fold(4)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "id")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "toxic")  # bounded by `sample`


def learn_lexemes(train: DataFrame) -> dict[str, float]:
    """Words and stems (with a `*`) whose lower bound of precision for toxic texts is high, from the sample's distinct texts."""
    texts = train.groupBy((F.col("toxic") > 0).alias("toxic"), F.sha2(normalized(F.col("text")), 256).alias("digest")).agg(F.first("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n = Counter(), Counter()
        for b in batches:
            for text, toxic in rows_of(b):
                words = set(WORD.findall((text or "").lower()))
                (p if toxic else n).update(words | {w[:k] + "*" for k in STEMS for w in words if len(w) >= k})
        rows = list(p.keys() | n.keys())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([p[w] for w in rows], pa.int64()), pa.array([n[w] for w in rows], pa.int64())], names=["lexeme", "p", "n"])

    counts = texts.select("text", "toxic").mapInArrow(counted, "lexeme string, p long, n long").groupBy("lexeme").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    support = max(SUPPORT, SHARE * train.where("toxic > 0").count())
    counts = counts.where((F.col("p") >= support) & (F.col("p") > F.col("n")))
    share, total = F.col("p") / (F.col("p") + F.col("n")), F.col("p") + F.col("n")
    lower = (share + 0.5 / total - F.sqrt(share * (1 - share) / total + 0.25 / total / total)) / (1 + 1 / total)  # Wilson, one sigma
    best = counts.withColumn("lower", lower).where(F.col("lower") >= PRECISION).collect()  # words of at most `sample` texts
    found = {r["lexeme"]: (r["p"], r["n"], r["lower"]) for r in best}
    for k in [k for k in found if k.endswith("*") and found[k][1]]:  # a longer stem that explains nearly all of it is the safer one
        if any(len(j) > len(k) and j.startswith(k[:-1]) and found[j][0] >= 0.9 * found[k][0] and found[j][1] < found[k][1] for j in found):
            del found[k]
    return {k: v[2] for k, v in found.items()}


def learn_weights(train: DataFrame, lexemes: dict[str, float], strength: float = 20.0) -> dict[str, float]:
    """Per pattern the share of toxic texts among those whose strongest match it is, drawn towards the prior."""
    flat = {}

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = Scorer(lexemes, flat), {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if found := scorer.patterns(text):
                    top = max(found, key=lambda x: (prior(x[0]) * x[1], x[0]))[0]
                    one = counts.setdefault(top, [0, 0])
                    one[0] += toxic > 0
                    one[1] += 1
        yield pa.RecordBatch.from_pylist([{"pattern": k, "p": a, "n": b} for k, (a, b) in counts.items()], schema=pa.schema([("pattern", pa.string()), ("p", pa.int64()), ("n", pa.int64())]))

    rows = train.select("text", "toxic").mapInArrow(strongest, "pattern string, p long, n long").groupBy("pattern").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return {r["pattern"]: (r["p"] + strength * prior(r["pattern"])) / (r["n"] + strength) for r in rows.collect()}  # a row per pattern


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], dict[str, float]]:
    train = materialize(training(docs, labels, sample), "toxicity-train")  # `sample` rows, read three times
    lexemes = {w: 0.8 for w in SEEDS} | learn_lexemes(train)
    return lexemes, learn_weights(train, lexemes)


def score_texts(docs: DataFrame, model: tuple[dict[str, float], dict[str, float]], name: str = "score") -> DataFrame:
    """`docs` with their scores in a last column `name`; where a column has that name in any case, see `fresh`."""
    lexemes, weights = model
    name, text = fresh(docs, name), docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexemes, weights)
        for b in batches:
            scores = pa.array([scorer.score(row[0]) for row in rows_of(b.select([text]))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, name])

    return docs.mapInArrow(scored, StructType(list(docs.schema.fields)).add(name, DoubleType()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score_texts(docs, model)
    return out.select("doc_id", fold(4).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
