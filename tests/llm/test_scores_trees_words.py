"""Quality scores, the Merkle manifest and spelling variants against plain versions, on small tables with nulls, empty and long
texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle, quality, spelling

SYLLABLES = ["an", "be", "cor", "del", "é", "für", "go", "ha", "in", "lo"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def crc(x):
    return zlib.crc32(str(x).encode())


def folder(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- quality ---


def plain_features(text):
    words = (text or "").split()
    grams = [f" {w} "[i : i + n] for w in words for n in quality.GRAMS for i in range(len(w) + 3 - n)]
    return Counter(grams), Counter(words), sum(a == b for a, b in zip(words, words[1:]))


def test_quality_features(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "a a  a b", "\n é\té \n", prose(rng, 40), "ab " * 30, "x" * 500, " "]
    ids, owner = quality.features(texts)
    known = {}
    for i, t in enumerate(texts):
        grams, words, again = plain_features(t)
        mine = sorted(ids[owner == i].tolist())
        assert mine == sorted(quality.features([t])[0].tolist()) and mine.count(1) == again
        assert len(mine) == grams.total() + words.total() + again
        for w in words:  # a feature per distinct word or n-gram, the same in every text
            known.setdefault(w, set()).update(quality.features([w])[0].tolist())
    assert all(known[w] <= set(ids.tolist()) for w in known)
    long = prose(rng, 3000)
    whole = quality.counted(long)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert "".join(quality.pieces(long)) == long and len(list(quality.pieces(long))) > 50
    assert [x.tolist() for x in quality.counted(long)[:1]] == [whole[0].tolist()] or len(set(quality.counted(long)[0]) ^ set(whole[0])) <= 1  # a repeat across two pieces isn't one


def quality_rows():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randint(20, 60))
        bad = i % 5 == 0
        if bad:
            text = [" ".join(w + "$$$" for w in text.split()), text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 30)][i // 5 % 3]
        rows.append((i, text, "en" if bad else "de", "s", 1))
        labels.append((i, int(not bad)))
    return rows, labels


def test_op11_quality(spark, tmp_path):
    rows, labels = quality_rows()
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (1002, " \n", None, None, None), (1003, rows[1][1], "x", "y", 2), (None, rows[1][1], None, None, None), (1, rows[1][1], None, None, None), (1004, "go ha " * 100_000, None, None, None), (1005, "z" * 300_000, None, None, None)]
    sf = folder(spark, tmp_path, documents=(rows + odd, "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels + [(0, None), (None, 1)], "doc_id long, quality int"))
    df = quality.op11_quality(spark, sf)
    out = df.collect()
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and len(out) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and crc(r.doc_id) % 3 == 1) for r in out)
    scores = defaultdict(set)
    for r in out:
        scores[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and scores[1000] == scores[1001] == scores[1002] and scores[1003] == scores[1] == scores[None]
    want, held = dict(labels), [r for r in out if r.held_out and r.doc_id < 1000]
    assert len(held) > 100 and sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sorted(tuple(r) for r in quality.op11_quality(spark, sf).collect() if r.doc_id is not None) == sorted(tuple(r) for r in out if r.doc_id is not None)  # reruns agree


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0.1)], "doc_id long, text string, Score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs.select("doc_id", "text"), none)
    out = quality.score_texts(docs, model)
    assert [tuple(r) for r in out.collect()] == [(1, "a b", 0.1, 0.5)] and out.columns[-1] == "score_"
    assert quality.score_texts(docs.limit(0), model).count() == 0


# --- Merkle manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """(root, path of each leaf: the side and digest of its siblings, level by level)."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            j = i ^ 1
            paths[leaf].append(((j > i) - (j < i), level[j]) if j < len(level) else None)
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain_merkle(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r, h(*map(enc, r))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    out, subs = [], {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs[lang] = tree([d for _, d in by[lang]])
    root, above = tree([subs[x][0] for x in langs])
    for lang, top in zip(langs, above):
        for (r, d), path in zip(by[lang], subs[lang][1]):
            path = path + top
            bad = r[0] is not None and crc(r[0]) % 7 == 0
            acc = h(*map(enc, (*r[:3], r[3] + 1 if r[3] is not None else None, r[4]))) if bad else d
            for s in path:
                acc = h(acc) if s is None else h(acc, s[1]) if s[0] > 0 else h(s[1], acc)
            out.append((r[0], d, subs[lang][0], root, h(*[s[1] for s in path if s]), acc, acc == root))
    return out


def merkle_rows(n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "a", "é"]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, i]), rng.choice([None, "", prose(rng, 5)])) for i in rng.sample(range(10 * n), n)]
    return rows + [(7, "s", "zz", 1, "alone"), (None, None, None, None, None), (None, None, "en", 3, "x"), rows[0], rows[0], (rows[0][0], "other", rows[0][2], 5, "t" * 100_000)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_op12_merkle(spark, tmp_path):
    rows = merkle_rows(150)
    sf = folder(spark, tmp_path, documents=(rows, SCHEMA))
    df = merkle.op12_merkle(spark, sf)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out, want = [tuple(r) for r in df.collect()], plain_merkle(rows)
    assert sorted(out, key=repr) == sorted(want, key=repr)
    by = {r[0]: r for r in out if r[0] is not None}
    changed = {r[0] for r in rows if r[0] is not None and r[3] is not None and crc(r[0]) % 7 == 0}
    assert changed and all(not by[i][6] for i in changed) and all(v[6] for i, v in by.items() if i not in changed)


@pytest.mark.parametrize("stride", [1, 3])
def test_merkle_strides_and_heights(spark, stride):
    rng = random.Random(stride)
    rows = [(t, i, h(f"{t}/{i}")) for t, n in [("a", 1), ("b", 2), ("c", 8), ("d", 9), ("e", 17), (None, 5)] for i in range(n)]
    rng.shuffle(rows)
    leaves = spark.createDataFrame(rows, "tree string, doc_id long, digest string").withColumn("item", F.struct("doc_id"))
    out, root = merkle.manifest(leaves, stride)
    by = defaultdict(list)
    for t, i, d in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        by[t].append(d)
    subs = {t: tree(ds) for t, ds in by.items()}
    top, above = tree([s[0] for s in subs.values()])
    assert root == top
    want = {(t, i): [*path, *up] for (t, s), up in zip(subs.items(), above) for i, path in enumerate(s[1])}
    side = {1: "R", -1: "L"}
    got = {(r.tree, r.item.doc_id): list(r.proof) for r in out.collect()}
    assert got == {k: ["" if s is None else side[s[0]] + s[1] for s in path] for k, path in want.items()}


def test_merkle_empty_and_single(spark, tmp_path):
    assert merkle.op12_merkle(spark, folder(spark, tmp_path / "none", documents=([], SCHEMA))).count() == 0
    one = [(5, None, "en", 2, "ab")]
    (r,) = merkle.op12_merkle(spark, folder(spark, tmp_path / "one", documents=(one, SCHEMA))).collect()
    assert tuple(r) == plain_merkle(one)[0] and r.leaf == r.subroot == r.root and r.proof_sha256 == h()


# --- spelling ---


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spelling(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            if i is not None and (k := zlib.crc32(f"{i}:{run}".encode())) % 199 == 0:
                run = run[: k % len(run)] + run[k % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    close = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in close.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(close[w]), n[form[w]] if w in form else None) for w, c in n.items()}


def spelling_rows():
    rng = random.Random(9)
    base = ["letters", "straße", "journée", "wordless", "aabbaabb", "Ünderling"]
    rows = []
    for i in range(1500):
        words = []
        for _ in range(rng.randint(3, 12)):
            w = rng.choice(base)
            for _ in range(rng.choices([0, 1, 2, 3], [80, 12, 5, 3])[0]):  # letters changed near the end, so that forms chain
                k = rng.choice([0, len(w) - 1, len(w)])
                w = rng.choice([w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1 :], w[:k] + w[k + 1 :]])
            words.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
        rows.append((i, rng.choice([" ", "-", "7", "\n"]).join(words)))
    chain = [("abcdefgh", 3000), ("abcdefgx", 500), ("abcdefxx", 90), ("abcdexxx", 15), ("tietiea", 5), ("tietieb", 40), ("tietiec", 40)]
    rows += [(5000 + k, " ".join([w] * c)) for k, (w, c) in enumerate(chain)]
    return rows + [(None, "letters " * 9), (None, None), (7000, ""), (7001, None), (7002, "é" * 400), (7002, ("q" * 3000 + " ") * 6), rows[3], rows[3]]


def test_op13_spelling(spark, tmp_path):
    rows = spelling_rows()
    sf = folder(spark, tmp_path, documents=([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n long, word string"))
    df = spelling.op13_spelling(spark, sf)
    out, want = [tuple(r) for r in df.collect()], plain_spelling(rows)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(out) == len(set(out)) and set(out) == want
    assert sum(f is not None for _, f, *_ in out) > 20 and any(f is not None and r != f for _, f, r, *_ in out)


def test_spelling_in_many_shards_and_rounds(spark, monkeypatch):
    counts = [(w, n) for w, _, _, n, _, _ in plain_spelling(spelling_rows())]
    words = spark.createDataFrame(counts, "word string, n long").repartition(3)
    want = {(w, len(xs), max(n for _, n in xs)) for w, xs in ((w, [x for x in counts if near(w, x[0])]) for w, _ in counts) if xs}
    for letters, most in ((50, 1500), (1 << 18, 32 << 20)):
        assert {(r.word, r.n_near, r.best) for r in spelling.near_words(words, letters, most).collect()} == want
    assert spelling.near_words(words.limit(0)).count() == 0


def test_tries_against_pairs():
    rng = random.Random(3)
    for _ in range(100):
        words = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))})
        counts = [rng.randint(1, 9) for _ in words]
        trie = spelling.Trie(*spelling.pack(words, counts))
        for q in [*words, b"ababab", b"z"]:
            assert sorted((w, n) for n, w in trie.neighbours(q)) == [(w, c) for w, c in zip(words, counts) if w != q and near(w, q)]


def test_spelling_of_nothing(spark, tmp_path):
    assert spelling.op13_spelling(spark, folder(spark, tmp_path, documents=([], "doc_id long, text string"))).count() == 0
