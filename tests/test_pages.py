"""Pages, their places and contents lines: against loops that read a book from its first page on."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import order, toc

ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(s):
    if not re.fullmatch("[ivxlcdm]+", s.lower()):
        return None
    total = prev = 0
    for c in reversed(s.lower()):
        total += -ROMAN[c] if ROMAN[c] < prev else ROMAN[c]
        prev = ROMAN[c]
    return total or None


def test_ranges_by_rows(spark):
    """The optimizer's size of joined rows is the product of both sides, which asked for thousands of ranges."""
    a = spark.range(20_000).selectExpr("id", "id AS v")
    assert order.ranges_for(a.join(a.select("id", F.col("v").alias("w")), "id")) == 1 and order.ranges_for(a, 1000) == 20


def test_many_ranges(spark):
    """Thousands of ranges are found without an expression per range, which the engine can't compile."""
    cuts = [float(x) for x in range(0, 12_285, 3)]
    found = spark.range(-2, 12_290, 5).select("id", order.range_of(F.col("id"), cuts).alias("r"), order.range_of(F.lit(None), cuts).alias("none"), order.range_of(F.col("id"), []).alias("one"))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40 * len(cuts)
    for r in found.collect():
        assert (r.r, r.none, r.one) == (sum(c < r.id for c in cuts), 0, 0)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_numbered_and_least_from(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randint(0, 99)) for i in rng.sample(range(-500, 500), 300)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    want = {}
    for k, at, _ in sorted(rows, key=lambda r: r[1]):
        want[k, at] = sum(1 for x in want if x[0] == k)
    assert {(r.k, r.at): r.place for r in order.numbered(df, "k", "at", "place", parts).collect()} == want
    asked = [(k, q, f"{k}{q}") for k in ("a", "b", "c") for q in range(-520, 520, 13)]
    got = order.least_from(df.where("k IS NOT NULL"), spark.createDataFrame(asked, "k string, at int, q string"), "k", "at", "v", parts)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(k, q, n, min((v for x, at, v in rows if x == k and at >= q), default=None)) for k, q, n in asked], key=repr)
    assert order.numbered(df.limit(0), "k", "at", "place", parts).count() == 0


def plain_scan(pages, after):
    """Entries (title, page, printed, found on) of one book's texts."""
    labels = {}
    for i, t in enumerate(pages):
        kept = [x.strip() for x in (t or "").split("\n") if x.strip()]
        hits = [m.group(1) for x in kept[-2:] if (m := re.match(r"^(?:page\s*)?([ivxlcdm\d]+)$", x.lower().replace(".", "").strip()))]
        if hits:
            labels.setdefault(hits[0], i)

    def page_of(p):
        if p.lower() in labels:
            return labels[p.lower()]
        if p.isdigit():
            above = [i for k, i in labels.items() if k.isdigit() and int(k) >= int(p)]
            if above:
                return min(above)
        r = roman_value(p)
        return next((i for k, i in labels.items() if r is not None and (int(k) if k.isdigit() else roman_value(k)) == r), None)

    out, seen = [], set()
    for i, t in enumerate(pages):
        new = 0
        for line in (t or "").split("\n"):
            m = re.match(r"^\s*(.+?)[.\-\s]{2,}(\S+)\s*$", re.sub("[–—‒]", "-", line.strip()))
            if m:
                title, at = re.sub(r"[.\-\s–—_]+$", "", m.group(1).strip()), page_of(m.group(2))
                if at is not None and (title, at) not in seen:
                    seen.add((title, at))
                    out.append((title, at, m.group(2), i))
                    new += 1
        if i > after and not new:
            break
    return out


def books(rng, n):
    out = {}
    for b in range(n):
        pages = []
        for i in range(rng.choice([0, 1, 12, 30])):
            lines = [rng.choice(["plain words here", "", f"Part {rng.randint(0, 4)} ..... {rng.randint(0, 40)}", f"Tale — – {rng.randint(0, 9)}", "Preface  iv", "odd.  Xyz.", "A - - x", f"Long {'9' * 45} .. {'9' * 45}", "e. m"]) for _ in range(rng.randint(0, 3))]
            foot = rng.choice([[], [f"Page {i + 1}"], [str(i)], ["iv."], [str(i), "the end"], ["", f" {i} ", " "]])
            pages.append(None if rng.random() < 0.1 else "\n".join(lines + foot))
        out[f"b{b}"] = pages
    return out


@pytest.mark.parametrize("after", [3, 50])
def test_contents_scan_stops_as_a_loop_does(spark, after):
    rng = random.Random(after)
    of = books(rng, 25)
    rows = [(b, i, t, "x") for b, pages in of.items() for i, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "source string, page_idx int, text string, found_on string").repartition(4)
    got = {}
    for r in toc.scan_contents(df, after=after).orderBy("ord").collect():
        got.setdefault(r.source, []).append((r.title, r.page_idx, r.printed, r.found_on))
    want = {b: e for b, pages in of.items() if (e := plain_scan(pages, after))}
    assert got == want and len(want) > 5
    assert any(len(plain_scan(p, after)) < len(plain_scan(p, 10**6)) for p in of.values()) or after > 30
    assert toc.scan_contents(df.limit(0)).count() == 0


def test_page_lookup_over_ranges(spark):
    rng = random.Random(8)
    labels = [(s, str(n), p, p) for s in "ab" for p, n in enumerate(rng.sample(range(400), 120))] + [("a", "9" * 40, 500, 500), ("a", "xx", 501, 501)]
    df = spark.createDataFrame(labels, "source string, label string, page_idx int, ord int")
    asked = [(s, str(q)) for s in "abc" for q in range(0, 420, 7)] + [("a", "9" * 45), ("a", "XX"), ("a", "20")]
    q = spark.createDataFrame(asked, "source string, query string")
    one, many = ({tuple(r) for r in toc.look_up_pages(df, q, parts).collect()} for parts in (1, 9))
    assert one == many and len(one) == len(asked)
    for s, x in asked[:120]:
        exact = [p for b, n, p, _ in labels if (b, n) == (s, x)]
        assert (s, x, min(exact or [p for b, n, p, _ in labels if b == s and len(n) < 9 and n.isdigit() and int(n) >= int(x)], default=None)) in one


# --- files of pages ---


def again(file, at):
    """The second source of the tests; it reads the file once more."""
    from zipfile import ZipFile

    return None if at == 4 else f"{len(ZipFile(file).namelist())} entries, page {at}"


def test_decoder_source_in_shares(spark, tmp_path, monkeypatch):
    """An archive read by several tasks, each its share of pages, with a second source for poor pages."""
    import os
    from zipfile import ZipFile

    from quillspark.sources import pages as S

    here = os.path.dirname(__file__)
    monkeypatch.syspath_prepend(here)
    rng = random.Random(3)
    books = {"a": [3, 11], "b": [1], "c": [0, 2]}
    want = {}
    for book, files in books.items():
        (tmp_path / book).mkdir()
        at = 0
        for k, n in enumerate(files):
            with ZipFile(tmp_path / book / f"part{k}.zip", "w") as z:
                texts = [rng.choice(["", "short", "a long page " * rng.randint(10, 400)]) for _ in range(n)]
                images = [rng.randint(0, 2) for _ in range(n)]
                for i, t in enumerate(texts):
                    z.writestr(f"{i:04}.txt", t)
                    for j in range(images[i]):
                        z.writestr(f"{i:04}-{j}.png", bytes(rng.choices(range(256), k=200)))
            entries = n + sum(images)
            for i, t in enumerate(texts):
                poor = len(t.strip()) < 100
                want[book, at] = (f"{entries} entries, page {i}" if poor and i != 4 else t, images[i])
                at += 1
    (tmp_path / "a" / "_SUCCESS").write_text("")
    for mb in (64, 0.001):
        df = S.decoded_pages(spark, str(tmp_path), "quillspark.sources.pages:zip_decoder", None, ".zip", mb)
        plain = {(r.book.rpartition("/")[2], r.page_idx): r.images for r in df.collect()}
        assert plain == {k: v[1] for k, v in want.items()}
        reader = S.PageReader({"path": str(tmp_path), "decoder": "quillspark.sources.pages:zip_decoder", "fallback": "test_pages:again", "suffix": ".zip", "splitMb": str(mb)})
        parts = reader.partitions()
        assert len(parts) > 5 if mb < 1 else len(parts) == 1
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted((r["text"], r["images"]) for r in rows) == sorted(want.values())
    assert S.decoded_pages(spark, str(tmp_path), "quillspark.sources.pages:zip_decoder", suffix=".none").count() == 0


def test_plan_of_page_files():
    from quillspark.sources.pages import plan

    files = [("a", 10), ("b", 95), ("c", 250), ("d", 0), ("e", 100), ("f", 1)]  # neighbours share a task up to 100 bytes
    parts = plan(files, 100)
    assert sorted(parts) == [[("a", 0, 1)], [("b", 0, 1), ("d", 0, 1)], [("c", 0, 3)], [("c", 1, 3)], [("c", 2, 3)], [("e", 0, 1)], [("f", 0, 1)]]
    assert plan([], 100) == []


def test_feed_files_in_splits(spark, tmp_path):
    """Pages of large files, split in the middle of pages, keep their places; so do empty and null ones."""
    from quillspark.sources import pages as S

    rng = random.Random(6)
    rows = [(s, i, rng.choice([None, "", "x" * rng.randint(1, 3000), "two\nlines", "feed\fwithin"])) for s, n in (("a", 230), ("b c", 7), ("d", 1)) for i in range(n)]
    want = {(s, i): (t or "").replace("\f", " ") for s, i, t in rows}
    S.write_pages(spark.createDataFrame(rows, "source string, page_idx int, text string").repartition(5), str(tmp_path / "p"), 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = S.feed_pages(spark, str(tmp_path / "p"))
            got = [((r.book.rpartition("source=")[2].replace("%20", " "), r.page_idx), r.text) for r in out.collect()]
            assert len(got) == len(rows) and dict(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_second_source_and_blank_pages(spark):
    from pyspark.sql import functions as F

    from quillspark.sources import pages as S

    long = "w" * 100
    rows = [(1, 0, long), (1, 1, " " + "w" * 99 + " "), (1, 2, None), (1, 3, ""), (1, 4, "short"), (None, 0, None)]
    df = spark.createDataFrame(rows, "doc int, page int, text string")
    second = spark.createDataFrame([(1, 0, "unused"), (1, 1, "b"), (1, 1, "a"), (1, 2, "two"), (1, 4, None), (None, 0, "n")], "doc int, page int, text string")
    got = {(r.doc, r.page): r.text for r in S.with_second_source(df, second, ["doc", "page"]).collect()}
    assert got == {(1, 0): long, (1, 1): "a", (1, 2): "two", (1, 3): "", (1, 4): "short", (None, 0): None}
    blank = spark.createDataFrame([("", 0, True), (" \n\t", 0, True), (None, None, True), ("", 1, False), ("x", 0, False), (None, 2, False)], "text string, images int, want boolean")
    assert all(r.got == r.want for r in blank.select("want", S.blank_page(F.col("text"), F.col("images")).alias("got")).collect())
