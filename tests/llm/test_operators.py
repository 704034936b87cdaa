"""The training-data operators against brute force on small tables that hold nulls, empty, long and repeated texts."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, decontaminate, exact_dedup, license_scan, lm_score, mixing, ngram_join, pii, suffix_dedup, toxicity, url_filter

random.seed(7)
VOCAB = [a + b for a in ("th", "er", "on", "é", "ß") for b in ("an", "in", "el", "ou")]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(60) for _ in range(6)]
    shared = prose(70)
    texts = [None, "", " \n\t", "one", "one", "Two  words", "two words", *base, base[0], base[0].replace(" ", "\n"), base[1].upper()]
    for i in range(12):  # near copies
        w = base[2].split()
        w[i * 4 % 60] = "x%d" % i
        texts.append(" ".join(w))
    texts += [prose(20) + " " + shared + " " + prose(20) for _ in range(4)] + [shared + "\0" + shared, prose(9000), "a" * 450, "né " * 150]
    return list(enumerate(texts))


ROWS = corpus()
SCHEMA = "doc_id long, text string, lang string, source string, score double, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, [None, "a", "b", "a"][i % 4], 0.5, 1) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def smallest(n, links):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in n}


def similar_pairs(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    return [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_ngram_join(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(docs).collect()}
    want = smallest([i for i, _ in ROWS], similar_pairs(ROWS))
    assert got == {i: (len(shingle_set(t)), want[i]) for i, t in ROWS}
    assert ngram_join.similarity_components(none).count() == 0
    kept = ngram_join.deduplicate_near(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_bucket_pairs_expand_groups():
    """Documents of equal prefix and size in two components are one group each; their members are all paired."""
    import numpy as np

    from quillspark.llm.vectors import pack, pack_sorted

    doc = np.array([[1, 1, 5, 9], [2, 1, 5, 9], [3, 3, 5, 9], [4, 4, 9, 8]])
    cols = [pack_sorted(np.array([7, 7, 7, 7], np.uint64)), pack(np.zeros(4, np.uint32)), pack(np.arange(4, dtype=np.uint32)), pack(np.diff(doc[:, 0], prepend=0)), pack(doc[:, 1] - doc[:, 0]), pack(doc[:, 2].astype(np.uint32)), pack(doc[:, 3])]
    body = b"".join(len(c).to_bytes(4, "little") + c for c in cols)
    found = {tuple(p) for a in ngram_join.bucket_pairs([body], 80) for p in a.tolist()}
    assert found == {(1, 3), (2, 3)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (70, 70)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 70: 50, 100: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_grammar():
    s = toxicity.Scorer({"idiot": 0.9, "moro*": 0.9}, {})
    plain, negated, reported, aimed = (s.score(x) for x in ("what an idiot", "he is not an idiot", "she said an idiot came", "you are an idiot"))
    assert aimed >= plain > 0.3 > negated and reported < plain
    assert s.patterns("moronic, really") == [("insult", 0.9)]
    assert s.patterns("I will kill you") == [("threat", 1.0)]
    assert s.score(None) == s.score("") == s.score("kind words") < 0.3
    for x in ('He said, "you are an idiot".', "He said: you idiot", '"You idiot," he said.', "\u201cYou idiot!\u201d she shouted, he said.", 'He wrote: "what fools, and you, idiot, came"'):
        assert [p for p, _ in s.patterns(x)] == ["insult+aimed+reported"] or s.patterns(x)[0][0].endswith("reported"), x
    for x in ('He came. "You idiot"', "You idiot. He said so.", '"Hm" he said. You idiot'):
        assert [p for p, _ in s.patterns(x)] == ["insult+aimed"], x


def plain_patterns(cs):
    """Patterns of a sentence's classes by looking around each token, without an automaton."""
    def reach(j, opener, span):
        return any(cs[k] in opener and j - k <= span and not set("pq") & set(cs[k + 1 : j]) for k in range(j))

    quotes = [k for k, c in enumerate(cs) if c == "q"]
    inside, told = {}, set()
    open_at, left = None, 0
    for k, c in enumerate(cs):  # quotes in order, with whether a verb opens them
        if c == "q":
            if open_at is None:
                open_at = (k, left > 0)
            else:
                inside.update({x: open_at[1] for x in range(open_at[0] + 1, k)})
                open_at, left = None, 0
            continue
        if open_at is None and c != "p":
            if left > 0:
                told.add(k)
            left = 6 if c == "r" else max(0, left - 1)
    if open_at:
        inside.update({x: open_at[1] for x in range(open_at[0] + 1, len(cs))})
    told |= {k for k, v in inside.items() if v}
    n, close, ahead, marked = len(cs), None, 0, []  # the same from the end
    for k in range(n - 1, -1, -1):
        if cs[k] == "q":
            if close is None:
                close = ahead > 0
            else:
                close, ahead = None, 0
        elif close is None and cs[k] != "p":
            ahead = 3 if cs[k] == "r" else max(0, ahead - 1)
        elif close:
            marked.append(k)
    told |= set(marked)
    out = []
    for j, c in enumerate(cs):
        marks = [("insult", c == "i"), ("threat", c == "t" and reach(j, "h", 3)), ("aimed", c == "i" and reach(j, "t", 4)), ("negated", c == "i" and reach(j, "n", 2)), ("reported", c in "ith" and j in told)]
        if marks[0][1] or marks[1][1]:
            out.append("+".join(m for m, on in marks if on))
    return out


def test_toxicity_grammar_against_plain_reading():
    s = toxicity.Scorer({"idiot": 0.9}, {})
    word = {"x": "tree", "i": "idiot", "h": "kill", "t": "you", "n": "not", "r": "said", "q": '"', "p": ","}
    rng = random.Random(11)
    for _ in range(4000):
        cs = rng.choices("xihtnrqp", weights=(4, 4, 1, 3, 1, 2, 3, 1), k=rng.randint(1, 14))
        assert [p for p, _ in s.patterns(" ".join(word[c] for c in cs))] == plain_patterns(cs), cs


def test_toxicity_learns(spark, none):
    bad, rows, labels = ["gribble", "snorkish"], [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        rows.append((i, prose(30) + (" %s%s " % (random.choice(bad), random.choice(["", "s", "ling"])) if toxic else " ") + prose(30), None, None, 0.0, 1))
        labels.append((i, 1, toxic))
    rows += [(1000, None, None, None, 0.0, 1), (1001, "", None, None, 0.0, 1), (1001, "", None, None, 0.0, 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = toxicity.score_texts(d, toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(out) == len(rows)
    for r in out:
        held = r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        if held:
            assert (r["score_"] >= 0.3) == (r.doc_id % 5 == 0) and r.score == 0.0
    empty = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_texts(none, empty).count() == 0


def fill(sizes, weights=(5, 2, 1)):
    """Targets by repeated sharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)


def test_mixing(spark, docs, none):
    for d in (docs, spark.createDataFrame([(i, prose(random.randint(0, 40)), "en", random.choice(["x", "y", "z", "é", None]), 0.0, 1) for i in range(900)], SCHEMA)):
        rows = d.collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(words(r.text))
        want = fill(dict(sizes))
        got = mixing.plan_mix(d).collect()
        assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan_mix(d.repartition(5)).collect()), key=repr)
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.copies <= 2
            taken[r.source] += r.copies * r["size"]
        longest = max(r["size"] for r in got)
        assert all(abs(taken[s] - want[s]) <= max(1, longest) for s in sizes)
        assert mixing.mix(d).count() == sum(r.copies for r in got)
    assert mixing.plan_mix(none).count() == 0


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def test_exact_dedup(spark, docs, none):
    got = {r.doc_id: r for r in exact_dedup.mark_duplicates(docs).collect()}
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    for i, t in ROWS:
        g, r = groups[norm(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest())
    assert {r.doc_id for r in exact_dedup.deduplicate(docs).collect()} == {min(g) for g in groups.values()}
    assert exact_dedup.mark_duplicates(none).count() == 0
    again = docs.unionByName(docs)
    assert all(r.group_size == 2 * len(groups[norm(dict(ROWS)[r.doc_id])]) for r in exact_dedup.mark_duplicates(again).collect())


def test_exact_dedup_state_goes_on(spark, tmp_path):
    """A second run with the same state meets what the first has seen."""
    one, two = (spark.createDataFrame([(i, "same")], "doc_id long, text string") for i in (5, 9))
    one.write.parquet(str(tmp_path / "a"))
    state = str(tmp_path / "state")
    first = exact_dedup.digest_groups(spark.read.parquet(str(tmp_path / "a")), state=state).collect()
    two.write.mode("append").parquet(str(tmp_path / "a"))
    second = exact_dedup.digest_groups(spark.read.parquet(str(tmp_path / "a")), state=state).collect()
    assert (first[0].keep_id, first[0].n, second[0].keep_id, second[0].n) == (5, 1, 5, 2)


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_pii(x):
    out = []
    for kind, rx in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(rx, x):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (13 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    texts = ["", "a@b.c_x@d.e f@g", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +1 2 +12 call (555) 123-4567 now",
             "mail ana(at)corp.com and é x@y.zz ü 1.1.1.1", "1" * 3000 + " a@b." + "c." * 2000 + "d " + "1." * 2000 + "1", "%%@a.b-@-.-", "part 123 456 7890a", "card 4111.1111.1111.1111, v 1.2.3"]
    d = spark.createDataFrame([*enumerate(texts), (99, None), (99, None)], "doc_id long, text string")
    model = pii.trained(spark, docs=d)
    rows = pii.find(d, model).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        base = plain_pii(r.text)
        assert [(s.kind, s.start, s.end) for s in r.base] == base
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in rows}
    assert ("phone", 32, 46) in by[4] and ("email", 5, 20) in by[5]
    out = {r.doc_id: r.text for r in pii.redact(d, model).collect()}
    assert out[5] == "mail [email] and é [email] ü [ip]"


def test_url_filter(spark):
    urls = ["http://a.org/es/1", "http://EXAMPLE.org/es/1", "https://m.example.org/en/12?x#y", "http://x.com/fr/", "http://com/fr/1", "ftp://xcom/fr/1", "http://x.org", "http://x.org?/y", "no scheme", None, "", "a://b://c.org/", "http://.org/", "http://org:80/", "http://q.com/de/\nz"]
    d = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string")

    def plain(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = sorted(map(tuple, url_filter.apply_rules(d, url_filter.RULES).collect()), key=repr)
    assert got == sorted(((r.page_id, *plain(r.url)) for r in d.collect()), key=repr)
    assert url_filter.apply_rules(d.limit(0), url_filter.RULES).count() == 0 and url_filter.apply_rules(d, []).count() == len(urls) + 1
    own = [("org", "", "block"), ("b.com", "/x" + chr(0xD7FF), "block"), ("com", "/" + chr(0x10FFFF), "block"), ("com", "/x", "allow")]
    urls = ["http://a.org", "http://organic/z", "http://b.com/x" + chr(0xD7FF) + chr(0x10FFFF) + "y", "http://b.com/x" + chr(0xE000), "http://com/" + chr(0x10FFFF) * 3, "http://com/x" + chr(0x10FFFF) * 2]
    got = {r.page_id: r.rule for r in url_filter.apply_rules(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), own).collect()}
    assert got == {0: "org", 1: None, 2: "b.com/x" + chr(0xD7FF), 3: "com/x", 4: "com/" + chr(0x10FFFF), 5: "com/x"}
    assert [e[2] for e in url_filter.rule_events([("a", "/", "x"), ("a", "/b/", "y")])] == ["a/", "a/b/", "a/", None]


class PlainAutomaton:
    """States as tuples of words, one step after the other."""

    def __init__(self, texts, k2, k3):
        self.c = Counter(g for x in texts for g in self.grams(x))
        self.k = {2: k3, 1: k2}
        self.n, self.v = sum(n for g, n in self.c.items() if len(g) == 1), sum(len(g) == 1 for g in self.c)

    def grams(self, x):
        x = [None, *x]  # a text starts after an end
        return [(w,) for w in x[1:]] + list(zip(x, x[1:])) + list(zip(x, x[1:], x[2:]))

    def p(self, w, state):
        if not state:
            return (self.c[(w,)] + 1) / (self.n + self.v + 1)
        k = self.k[len(state)]
        return (self.c[(*state, w)] + k * self.p(w, state[1:])) / (self.c[state] + k)

    def read(self, x):
        total, state = 0.0, (None,) if self.c[(None,)] else ()
        for w in x:
            at = state
            while at and not self.c[(*at, w)]:  # failure arcs
                k = self.k[len(at)]
                total += math.log10(k / (self.c[at] + k))
                at = at[1:]
            total += math.log10(self.p(w, at))
            state = (*state, w)[-2:]
            while state and not self.c[state]:
                state = state[1:]
        return total


@pytest.mark.parametrize("block_bytes", [lm_score.BLOCK_BYTES, 500])
def test_lm_score(docs, none, block_bytes):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = {r.doc_id: r for r in lm_score.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, k2=3.0, k3=0.5, block_bytes=block_bytes).collect()}
    tok = {i: words(t) + [None] for i, t in ROWS}
    model = PlainAutomaton([x for i, x in tok.items() if not held(i)], 3.0, 0.5)
    assert len(got) == len(tok) and any(map(held, tok))
    for i, x in tok.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(model.c[(w,)] > 0 for w in x), model.n)
        assert math.isclose(r.base_score, sum(math.log10(model.p(w, ())) for w in x), rel_tol=1e-9)
        assert math.isclose(r.score, model.read(x), rel_tol=1e-9)
    assert lm_score.score(none, F.lit(True)).count() == 0
    assert all(r.train_tokens == r.n_known == 0 for r in lm_score.score(docs, F.lit(False)).collect())
    assert lm_score.score(docs.unionByName(docs), F.lit(True)).count() == 2 * len(ROWS)


def test_license_scan(spark, docs, none):
    texts = ["Released under the MIT License.", "no license", "MIT  license mit-LICENSE; Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.", None, "GNU General Public License, version 3 or later", "SPDX-License-Identifier: MIT", "permit license general public licenses", "é mit license " * 300]
    d = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = license_scan.scan(d).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (texts[r.doc_id] or "").encode().lower())
        want = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.encode().split())
        assert r.n_words == len(w) and sorted((p.start, p.label) for p in r.places) == want
    by = {r.doc_id: {x.label for x in r.detections} for r in got}
    assert by[0] == {"mit"} and by[3] == {"cc-by-nc"} and by[6] == {"mit"} and by[1] == by[4] == set() and "gpl" in by[5]
    for r in got:  # no detection inside another
        assert not any(a is not b and a.start >= b.start and a.end <= b.end for a in r.detections for b in r.detections)
    assert license_scan.scan(none).count() == 0 and len(license_scan.RULES) >= 200


def sampled(rx):
    """A text that a rule's expression matches, by chance."""
    from re import _constants as k
    from re import _parser

    def node(op, a):
        if op == k.LITERAL:
            return chr(a)
        if op == k.NOT_LITERAL:
            return "q"
        if op == k.IN:
            return "q" if a[0][0] == k.NEGATE else node(*random.choice(a))
        if op == k.RANGE:
            return chr(random.randint(*a))
        if op == k.MAX_REPEAT:
            return "".join(seq(a[2]) for _ in range(random.randint(a[0], min(int(a[1]), a[0] + 2))))
        if op == k.BRANCH:
            return seq(random.choice(a[1]))
        if op == k.SUBPATTERN:
            return seq(a[3])
        assert op in (k.ASSERT, k.ASSERT_NOT), op
        return ""

    seq = lambda p: "".join(node(*x) for x in p)
    return seq(_parser.parse(rx))


def plain_scan(text):
    """The rule engine, one rule and text after the other, without a prefilter."""
    norm = " " + " ".join(w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())) + " "
    found = []
    for label, rx, _, priority, _ in license_scan.RULES:
        for m in re.finditer(rx, norm):
            found.append((-priority, m[0].count(" "), norm[: m.start()].count(" "), label))
    kept = []
    for p, n, s, label in sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3])):
        if not any((s >= a and s + n <= b) or (a >= s and b <= s + n) for a, b, _, _ in kept):
            kept.append((s, s + n, -p, label))
    return sorted(kept)


def test_license_rules_against_plain_engine(spark):
    rng = random.Random(3)
    texts = []
    for label, rx, keywords, _, _ in license_scan.RULES:
        for _ in range(4):
            x = sampled(rx)
            assert set(keywords) & set(x.split()), (rx, x)  # the prefilter leaves no match out
            texts.append(x)
    texts = [rng.choice([", ", "\n", " "]).join(rng.sample(texts, rng.randint(1, 5))) for _ in range(400)] + texts + ["x " * 20_000 + "MIT License" + " y" * 20_000]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)).collect()}
    for i, x in enumerate(texts):
        assert sorted((d.start, d.end, d.priority, d.label) for d in got[i].detections) == plain_scan(x), x[:300]


def covered(rows, least):
    text = {i: (t or "").encode() for i, t in rows}
    c = Counter(b[k : k + least] for b in text.values() for k in range(len(b) - least + 1))
    return {i: sorted({j for k in range(len(b) - least + 1) if c[b[k : k + least]] > 1 for j in range(k, k + least)}) for i, b in text.items()}


def test_suffix_dedup(docs, none):
    want = covered(ROWS, 200)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        b = (dict(ROWS)[r.doc_id] or "").encode()
        gone = set(want[r.doc_id])
        runs = sum(1 for j in gone if j - 1 not in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), len(gone), runs, bytes(x for j, x in enumerate(b) if j not in gone))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_maximal_repeats():
    for _ in range(20):
        strs = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 50))) for _ in range(6)]
        want = covered([(i, s.decode()) for i, s in enumerate(strs)], 5)
        got = {i: set() for i in want}
        for length, places in suffix_dedup.maximal_repeats(strs, 5):
            assert len(places) > 1 and len({strs[o][p : p + length] for o, p in places}) == 1
            all_ = [(o, p) for o, s in enumerate(strs) for p in range(len(s)) if s[p : p + length] == strs[places[0][0]][places[0][1] :][:length]]
            assert sorted(places) == sorted(all_)  # every occurrence
            lefts = {strs[o][p - 1] if p else (o, p) for o, p in places}
            assert len(lefts) > 1
            for o, p in places:
                got[o].update(range(p, p + length))
        assert {i: sorted(v) for i, v in got.items()} == want


def test_context_covers():
    base = bytes(random.choice(b"abcdefgh ") for _ in range(400))
    held = []
    for j in range(60):
        left, r = bytes(random.choice(b"xyz") for _ in range(random.randint(0, 168))), random.randint(40, 200)
        shared = random.randint(0, len(left))
        before, after = left[: len(left) - shared] + base[200 - shared : 200], base[200 : 200 + r] + bytes(random.choice(b"xyz") for _ in range(random.randint(0, 200 - r)))
        if len(before + after) >= 200:
            held.append((j % 2, j, 0, len(before), 1000 * j, before + after))
    held.append((*held[0][:3], held[0][3] + 5, held[0][4], held[0][5][:-5]))  # an overlapping context of one document
    got = {(held[j][1], p) for j, s, e in suffix_dedup.context_covers(held, 200) for p in range(s, e)}
    places = {}
    for g, j, _, at, start, raw in held:
        for k in range(len(raw) - 199):
            places.setdefault((g, raw[k : k + 200]), set()).add((j, start + k))
    want = {(j, q) for at in places.values() if len(at) > 1 for j, p in at for q in range(p, p + 200)}
    assert got == want != set()


def plain_hits(rows, items, width=10):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= own
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(ROWS[7][1].split()[5:30])), (2, "two words"), (3, None), (10, "!"), (4, ROWS[-4][1][:150].upper()), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(ROWS, items)
    for mb in (16, -1):  # broadcast or not
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(docs, bench, mb=mb).collect()}
        assert got == want
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {i for i, x in want.items() if not x[1]}
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.unionByName(docs), bench).count() == 2 * len(ROWS)


def plain_near(rows, items, slop, width=10):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    n = Counter(w for _, t in rows for w in split(t))
    out = {}
    for i, t in rows:
        d = split(t)
        for item, x in items:
            w = split(x)
            for k in range(max(len(w) - width, 0) + 1 if w else 0):
                win = w[k : k + width]
                if len(win) < 2 or not all(n[y] for y in win):
                    continue
                sig = sorted((n[y], y, o) for o, y in enumerate(win))[:3]
                for p in (p for p, y in enumerate(d) if y == sig[0][1]):
                    gaps = [min((abs(q - (p + o - sig[0][2])) for q, z in enumerate(d) if z == y), default=99) for _, y, o in sig[1:]]
                    if all(g <= slop for g in gaps):
                        out.setdefault((i, str(item)), []).append((p - sig[0][2], max(gaps)))
    return {k: (len({p for p, _ in v}), min(g for _, g in v)) for k, v in out.items()}


def test_proximity_matches(spark):
    rng = random.Random(5)
    vocab = "abcdefghijklmnop"
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "")]
    items = [(k, " ".join(rng.choice(vocab + "q") for _ in range(rng.randint(1, 14)))) for k in range(12)]
    rows += [(70 + k, "x y " + t.replace(" c ", " z c ", 1) + " w") for k, t in items]
    d, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([*items, (None, "a b c"), (99, None)], "item_id long, text string")
    for mb in (16, -1):
        got = {(r.doc_id, r.item_id): (r.places, r.off) for r in decontaminate.near_matches(d, bench, slop=2, mb=mb).collect()}
        assert got == plain_near(rows, items, 2) != {}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", ["a", "b", None][i % 3], 0) for i, t in ROWS] + [(500 + i, prose(25) + " you idiot " + prose(25), "en", "a", 0) for i in range(5)]
    item = " ".join(ROWS[8][1].split()[3:20])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 500)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t in ROWS]
    first = {}
    for i, t in kept:
        first.setdefault(norm(t), i)
    kept = [(i, t) for i, t in kept if first[norm(t)] == i]
    label = smallest([i for i, _ in kept], similar_pairs(kept))
    kept = [(i, t) for i, t in kept if label[i] == i]
    hit = plain_hits(kept, [(1, item)])
    kept = [(i, t) for i, t in kept if not hit[i][1]]
    source = {i: s for i, _, _, s, _ in rows}
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(spark.createDataFrame([(i, t, source[i]) for i, t in kept], "doc_id long, text string, source string")).collect()}
    assert Counter(r.doc_id for r in out) == Counter({i: c for i, c in plan.items() if c})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "mixing"]


def test_license_scan_templates_without_license(spark):
    """Each template that doesn't need the word license finds its family without it, across lines and marks too."""
    texts = ["Distributed under the GNU GPL v3", "available under CC BY 4.0", "subject to the conditions of the MPL", "released\nunder the MIT", "released freely under the MIT.", "offered per Apache 2.0", "the\nterms\n of the EUPL", "under the MIT tree"]
    want = ["gpl", "cc-by", "mpl", "mit", "mit", "apache", "eupl", None]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: sorted({x.label for x in r.detections}) for r in license_scan.scan(d).collect()}
    assert got == {i: [x] if x else [] for i, x in enumerate(want)}
    own = license_scan.scan(d, rules=[("tree", " mit tree(?= )", ("tree",), 1, 0.5)], phrases=[("cc by", "cc")]).collect()
    assert {r.doc_id for r in own if r.detections} == {7} and {r.doc_id for r in own if r.places} == {1}


def test_context_covers_large_last_class():
    """More than 30,000 suffixes, most of them in the last class."""
    few, many = (bytes(random.choice(b"abcdefgh ") for _ in range(200)) for _ in range(2))
    held = [(0, j, 0, 0, 7, few) for j in range(2)] + [(1, j, 0, 68, 9, many) for j in range(2, 31_000)]
    got = {(held[j][1], s, e) for j, s, e in suffix_dedup.context_covers(held, 200)}
    assert got == {(j, 7, 207) if j < 2 else (j, 9, 209) for j in range(31_000)}


def test_pii_cards_of_single_digits(spark):
    """Card numbers whose digits are all apart."""
    card = "4111111111111111"
    texts = [" ".join(card), "-".join(card), "é pay " + " -"[0].join(card) + ", not " + "-".join("4111111111111112"), "4 1"]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(d, ([], {})).collect()}
    assert got == {i: plain_pii(t) for i, t in enumerate(texts)} and [len(got[i]) for i in range(4)] == [1, 1, 1, 0]


def test_deduplicate_repeated_and_null_ids(spark):
    rows = [(1, "x", 0), (0, "y", 0), (1, "y", 1), (5, "z a", 3), (5, "z  a", 2), (5, "z a", 2), (None, "n", 1), (None, "n", 1), (None, "n", 0), (None, "y", 4), (7, "w", 0), (7, None, 0), (None, "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(3)
    out = exact_dedup.deduplicate(d)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == d.columns and Counter(norm(t) for _, t, _ in got) == Counter({norm(t): 1 for _, t, _ in rows})
    assert set(got) <= set(rows) and {norm(t): i for i, t, _ in got} == {"x": 1, "y": 0, "z a": 5, "n": None, "w": 7, "": 7}
    assert sorted(got, key=repr) == sorted((tuple(r) for r in exact_dedup.deduplicate(d.repartition(5)).collect()), key=repr)


def test_toxicity_learns_below_a_shared_header(spark):
    """Labelled texts that share a header of more than 64 characters are still different texts."""
    head = "this notice stands above each page of the archive and says nothing of what is written below it. "
    rows = [(i, head + prose(10) + (" gribble " if i % 5 == 0 else " ") + prose(10 + i % 7)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    found = toxicity.learn_lexemes(toxicity.training(d, labels, 1000))
    assert "gribble" in found and not {"notice", "archive"} & set(found)
    copies = spark.createDataFrame([("one gribble", 1)] * 30 + [("one  gribble", 1)] * 30 + [("kind words", 0)] * 30, "text string, toxic int")
    assert toxicity.learn_lexemes(copies) == {}


def test_ngram_links(docs, none):
    """All links between different sets, also inside a component."""
    first = {}
    for i, t in ROWS:
        first.setdefault(frozenset(shingle_set(t)), i)
    rep = {i: first[frozenset(shingle_set(t))] if shingle_set(t) else None for i, t in ROWS}
    want = {(a, b) for a, b in similar_pairs(ROWS) if rep[a] == a and rep[b] == b}
    links, _ = ngram_join.class_links(docs)
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len({x for p in want for x in p})  # more than a tree of each component
    assert {tuple(r) for r in ngram_join.link_counts(docs).collect()} == {(i, c, sum(c in p for p in want)) for i, c in rep.items()}
    assert ngram_join.link_counts(none).count() == 0


def low_entropy():
    """Texts of short periods, and lines that many texts share with different neighbours."""
    line = prose(60)[:260]
    texts = ["-" * 700, "-" * 200, "x" + "-" * 5000, "ab" * 400, "ab" * 100, "b" + "ab" * 110 + "c", ("=" * 40 + "+") * 30, "-" * 199, "-" * 201 + " end"]
    texts += [prose(random.randint(1, 30)) + line + prose(random.randint(1, 30)) for _ in range(40)] + [line + "-" * 300, None, "", texts[0]]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_suffix_dedup_low_entropy_and_hot_anchors(spark, hot, monkeypatch):
    rows = low_entropy()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, bodies string").repartition(3)
    want = covered(rows, 200)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(d, hot=hot).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        b, gone = (t or "").encode(), set(want[i])
        assert (got[i].n_removed, bytes(got[i].kept)) == (len(gone), bytes(x for j, x in enumerate(b) if j not in gone)), i


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_repeats_have_all_occurrences(spark, hot):
    rows = [(i, t) for i, t in low_entropy() if i > 8] + ROWS[-8:]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    found = {}
    for r in suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect():
        found.setdefault((r["repeat"], r["length"]), []).append((r.doc_id, r.start))
    text = {i: (t or "").encode() for i, t in rows}
    gone = {i: set() for i in text}
    for (name, n), places in found.items():
        one = text[places[0][0]][places[0][1] :][:n]
        assert len(one) == n >= 200 and hashlib.blake2b(one, digest_size=16).hexdigest() == name
        everywhere = [(i, k) for i, b in text.items() for k in range(len(b) - n + 1) if b[k : k + n] == one]
        if len(set(one)) > 8:  # runs of a short period list their first period only
            assert sorted(places) == everywhere and len(places) > 1
        for i, k in places:
            gone[i].update(range(k, k + n))
    want = covered(rows, 200)
    assert all(gone[i] <= set(want[i]) for i in gone)
    varied = [i for i in gone if len(set(text[i])) > 8 and b"---" not in text[i]]
    assert len(varied) > 40 and all(sorted(gone[i]) == want[i] for i in varied)
    assert suffix_dedup.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_repeated_rows(spark):
    a, b = prose(80), prose(80)
    rows = [(1, a), (1, a), (1, b), (2, b + "x"), (None, prose(90)), (None, a + "y"), (3, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(d).collect())
    want = covered(list(enumerate(t for _, t in rows)), 200)
    assert got == Counter((i, len(t.encode()), len(want[k])) for k, (i, t) in enumerate(rows))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_polynomials_stay_apart(spark):
    import numpy as np

    from quillspark.llm.vectors import hash_words

    x, y = thue_morse(1024)
    some = [x.encode(), y.encode(), b"a", b"a" * 9, b"a" * 8, b"a" * 16, b"a" * 5000, b"b" * 5000, b"\0", b"\0\0", b"\0" * 9]
    assert len(np.unique(hash_words(some))) == len(some) and (hash_words(some[3:5]) == hash_words(some)[3:5]).all()
    d = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similarity_components(d).collect()} == {1: 1, 2: 2, 3: 1}
    got = {r.doc_id: r.base_score for r in lm_score.score(d, F.lit(True)).collect()}
    assert got[1] == got[3] != got[2]


def test_ngram_join_hot_tokens(spark, docs, monkeypatch):
    """Tokens of many documents are split into pairs of blocks; no link is lost."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "HOT", 2)
    assert ngram_join.blocks_of(np.array([0, 2, 3, 9]), 0).tolist() == [1, 1, 5, 11]
    meets = {}
    for i in range(40):
        for t in ngram_join.split_hot(np.array([7], np.uint64), np.array([3]), np.array([5]), i)[0].tolist():
            meets.setdefault(t, set()).add(i)
    assert {frozenset(p) for m in meets.values() for p in itertools.combinations(m, 2)} == {frozenset(p) for p in itertools.combinations(range(40), 2)}
    assert max(map(len, meets.values())) < 30
    marks = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp")).limit(0)
    plain, hot = (
        {tuple(r) for r in ngram_join.candidates(ngram_join.prefix_postings(docs.select("doc_id", "text"), marks, SimpleNamespace(value=f.astype(np.uint32)), [0, 1, 2, 3], 5, 80), 4, 80).collect()}
        for f in (np.arange(1 << ngram_join.SKETCH_BITS) % 3, np.arange(1 << ngram_join.SKETCH_BITS) % 3 * 30_000)
    )
    assert plain == hot != set()


def test_deduplicate_near_repeated_and_null_ids(spark):
    a, b = prose(40), prose(40)
    near = a.split()
    near[0] = "x"
    rows = [(0, "BB dup", 1), (1, "AA unique", 1), (1, "BB dup", 2), (5, a, 1), (5, " ".join(near), 2), (None, a.replace(" ", "  "), 3), (None, b, 4), (None, b, 4), (None, None, 5), (7, "", 6), (7, " ", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(3)
    out = ngram_join.deduplicate_near(d)
    assert out.columns == d.columns
    got = sorted(map(tuple, out.collect()), key=repr)
    assert [r for r in got if (r[1] or "").strip()] == sorted([(0, "BB dup", 1), (1, "AA unique", 1), next(r for r in got if r[0] == 5), (None, b, 4)], key=repr)
    assert sum(r[0] == 5 for r in got) == 1 and sum(not (r[1] or "").strip() for r in got) == 3


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUBS", 4)  # few hubs, the other vertices by shuffle
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(59, 130), (300, 301), (301, 300), (None, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(60), *range(100, 131)]}, 300: 300, 301: 300}


def test_mix_repeated_and_null_ids(spark):
    """Rows of one id are documents of their own: the words taken meet the target, in the plan and in the corpus."""
    rows = [(1, "a b c", "s", "x")] * 6 + [(i, "a b c", "s", "y") for i in range(2, 6)] + [(None, "a b c d", "t", "z")] * 9 + [(None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_id string").repartition(4)
    want = fill({"s": 30, "t": 36, None: 0})
    plan = mixing.plan_mix(d).collect()
    out = mixing.mix(d)
    assert len(plan) == len(rows) and out.columns == d.columns
    got = out.collect()
    for s in ("s", "t"):
        assert abs(sum(r.copies * r["size"] for r in plan if r.source == s) - want[s]) <= 4
        assert abs(sum(len(r.text.split()) for r in got if r.source == s) - want[s]) <= 4
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(d.repartition(2)).collect()), key=repr)


def test_mark_duplicates_keeps_one_of_repeated_rows(spark):
    rows = [(1, "x")] * 4 + [(2, "x"), (3, "y"), (None, "z"), (None, "z"), (None, "x")]
    got = exact_dedup.mark_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter({(1, 1, 6, True): 1, (1, 1, 6, False): 3, (2, 1, 6, False): 1, (None, 1, 6, False): 1, (3, 3, 1, True): 1, (None, None, 2, True): 1, (None, None, 2, False): 1})


def test_pipeline_odd_rows_and_columns(spark, tmp_path):
    """Repeated and null ids, repeated rows, and columns with the names that stages use."""
    import corpus_pipeline

    text = [prose(30) for _ in range(6)]
    rows = [(1, text[0]), (1, text[1]), (0, text[1]), (None, text[2]), (None, text[2]), (None, text[3]), (7, text[4]), (7, text[4]), (8, None), (9, ""), (None, None)]
    extra = {"hit_id": "long", "Score": "double", "_mix_id": "string", "rid": "long", "key": "string", "component_id": "long", "copies": "long", "digest": "string"}
    names = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {v}" for k, v in extra.items())
    data = [(i, t, "en", "s", len(t or ""), 1, 0.5, "m", 2, "k", 3, 4, "d") for i, t in rows]
    for part, documents in (("some", data), ("none", [])):
        d = tmp_path / part
        spark.createDataFrame(documents, schema).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(d))
        assert out.columns == names
        got = Counter(r.text for r in out.collect())
        if documents:
            assert set(text[:5]) - set(got) <= set(text) and sum(got.values()) >= 6 and all(n <= 2 for t, n in got.items() if t)
        else:
            assert not got
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path / "some"))
    assert Counter(r.text for r in docs.where("n_chars > 0").collect()) == Counter(text[:5])


def test_pii_quality_and_lengths(spark, docs):
    """Each kind's held-out precision and recall; spans of any length; ties; secrets."""
    found = pii.quality(spark, docs=docs)
    assert all(p >= pii.PRECISION and r >= 0.9 for p, r in found.values()), found
    texts = ["ana(at)a.b.c.d.e.f.g.h.com", "x" * 90 + "(at)" + "y" * 80 + ".org now", "see 2001:db8::1 and 12:30:45", "call 0171 2345 6789 on 2021-03-04", 'token = "7702344ead31d5951ffa625c69a7546f3a470a7f" x', "meet at noon. Then at 3.14"]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), pii.trained(spark, docs=docs)).collect()}
    spans = {i: [(s.kind, s.start, s.end) for s in r.spans] for i, r in rows.items()}
    assert spans[0] == [("email", 0, 26)] and spans[1] == [("email", 0, 178)] and spans[2] == [("ip", 4, 15)] and spans[3] == [("phone", 5, 19)] and spans[5] == []
    assert [rows[i].secrets for i in range(6)] == [0, 0, 0, 0, 1, 0]
    for r in rows.values():
        x = sorted((s.start, s.end) for s in r.spans)
        assert all(a[1] <= b[0] for a, b in zip(x, x[1:]))
    assert pii.find(docs.limit(0), pii.trained(spark, docs=docs.limit(0))).count() == 0


def test_bucket_labels(spark):
    from quillspark.llm.common import bucket_labels

    for n in (1, 5, 61):
        labels = bucket_labels(spark, n)
        rows = spark.createDataFrame([(x,) for x in labels], "b int").repartition(n, "b").groupBy(F.spark_partition_id()).count().collect()
        assert len(set(labels)) == n and [r["count"] for r in rows] == [1] * n
