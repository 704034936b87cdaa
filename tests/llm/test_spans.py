"""Spans within a text against plain loops, and texts with very many of them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.llm import license_scan, pii, spans

SPAN = "array<struct<start:int,end:int,p:int>>"


def drawn(rng, n, length, most):
    out = []
    for k in range(n):
        a = rng.randint(0, length)
        out.append((a, a + rng.randint(1, most), k))
    return out


def test_spans_against_loops(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        n = rng.choice([0, 1, 2, 5, 12, 30])
        xs, others = drawn(rng, n, 4 * n + 3, rng.choice([2, 6, 20])), drawn(rng, rng.choice([0, 1, 4, 9]), 4 * n + 3, 5)
        rows.append((sorted(xs), sorted(xs, key=lambda x: (x[0], -x[1], x[2])), sorted(others)))
    rows.append((sorted(big := drawn(rng, 1500, 6000, 5)), sorted(big, key=lambda x: (x[0], -x[1], x[2])), sorted(drawn(rng, 900, 6000, 3))))  # more than blocks of the folds
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, xs {SPAN}, outer {SPAN}, others {SPAN}").repartition(4)
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    inside = lambda a, b: ((a["start"] >= b["start"]) & (a["end"] <= b["end"])) | ((b["start"] >= a["start"]) & (b["end"] <= a["end"]))
    rank = lambda x: F.struct((x["p"] % 7).alias("r"), x["start"].alias("s"), x["p"].alias("p"))
    out = df.select(
        "i", spans.apart_from(F.col("xs"), F.col("others")).alias("apart"), F.array_sort(spans.best_first(F.col("xs"), rank, overlap)).alias("free"), F.array_sort(spans.best_first(F.col("outer"), rank, inside, True)).alias("un"),
    )

    def greedy(xs, clash):
        kept = []
        for x in sorted(xs, key=lambda x: (x[2] % 7, x[0], x[2])):
            if not any(clash(x, k) for k in kept):
                kept.append(x)
        return sorted(kept)

    over = lambda a, b: a[0] < b[1] and b[0] < a[1]
    within = lambda a, b: (a[0] >= b[0] and a[1] <= b[1]) or (b[0] >= a[0] and b[1] <= a[1])
    for r in out.collect():
        xs, _, others = rows[r.i]
        assert [tuple(x) for x in r.apart] == [x for x in xs if not any(over(x, o) for o in others)]
        assert [tuple(x) for x in r.free] == greedy(xs, over) and [tuple(x) for x in r.un] == greedy(xs, within)


def test_very_many_matches(spark, tmp_path):
    """Texts of 200 KB and more that hardly hold anything but matches."""
    n = 14_000
    numbers = ", ".join(f"0{i % 100:02}-{i % 7919:04}-{i * 7 % 9973:04}" for i in range(n))
    mails = " ".join(f"a{i}@b.org" for i in range(n))
    spark.createDataFrame([(1, numbers), (2, mails), (3, "mit license " * n)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in pii.find(df, ([], dict.fromkeys(pii.KINDS, -1.0))).collect()}
    assert len(got[1].spans) == n and {s.kind for s in got[1].spans} == {"phone"} and not got[1].base
    assert [(numbers[s.start : s.end]) for s in got[1].spans][-1] == numbers.rpartition(" ")[2]
    assert len(got[2].base) == len(got[2].spans) == n and mails[got[2].base[-1].start : got[2].base[-1].end] == f"a{n - 1}@b.org"
    found = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [p.start for p in found[3].places] == list(range(0, 2 * n, 2)) and len(found[3].detections) >= n and not found[1].detections
