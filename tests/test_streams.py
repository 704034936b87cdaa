"""Streams: captions that come late, and catalogs that follow profiles, against what a whole table gives."""

from __future__ import annotations

import datetime as dt
import json
import random

from quillspark.plans import render
from quillspark.streaming import captions, catalog

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "video_id string, ts timestamp, ord long, duration double, text string"


def test_late_captions(spark, tmp_path):
    """Captions in any order within the delay are as in order; one beyond it is dropped."""
    rng = random.Random(2)
    rows = [(v, T0 + dt.timedelta(seconds=k * 2 + rng.choice([0, 0, 9]) * (k % 4 == 0)), k, float(rng.randint(0, 2)), rng.choice(["a b", "c", " ", None])) for v in ("x", "y") for k in range(40)]
    rows = list({(v, t): (v, t, *r) for v, t, *r in rows}.values())
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 8)))
    batches = [arrival[: len(arrival) // 2], arrival[len(arrival) // 2 :], [(None, T0 + dt.timedelta(days=1), 0, 0.0, "end")], [("x", T0, 99, 0.0, "too late")], [(None, T0 + dt.timedelta(days=2), 0, 0.0, "end")]]
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = captions.speakers_of_files(spark, str(tmp_path / "in"), SCHEMA, 3.0, "10 seconds", str(tmp_path / "out"), str(tmp_path / "ck"))
    table = spark.createDataFrame([(v, o, t.timestamp(), d, x) for v, t, o, d, x in sorted(rows, key=lambda r: (r[0], r[1]))], "video_id string, ord long, start double, duration double, text string")
    ranked = table.selectExpr("video_id", "row_number() OVER (PARTITION BY video_id ORDER BY start) AS ord", "ord AS k", "start", "duration", "text")
    want = {(r.video_id, r.k): r.speaker for r in render.diarize(ranked, 3.0).collect()}
    got = {(r.video_id, r.ord): r.speaker for r in out.collect()}
    assert ("x", 99) not in got and {k: v for k, v in got.items() if k[0]} == want and len(set(want.values())) == 2


def test_videos_share_a_call(spark, tmp_path, monkeypatch):
    """Many videos cost some calls of Python, as many as there are buckets and not videos; each goes on where it ended."""
    calls = tmp_path / "calls"
    calls.mkdir()
    plain = captions.Turns.__call__

    def counted(self, key, batches, state):
        (calls / f"{random.Random().random()}").touch()
        return plain(self, key, batches, state)

    monkeypatch.setattr(captions.Turns, "__call__", counted)
    rng = random.Random(4)
    rows = [(f"v{v}", T0 + dt.timedelta(seconds=at), at, 0.0, "a") for v in range(300) for at in rng.sample(range(60), 6)]
    halves = [[r for r in rows if r[2] < 30], [r for r in rows if r[2] >= 30], [(None, T0 + dt.timedelta(days=1), 0, 0.0, "end")], [(None, T0 + dt.timedelta(days=2), 0, 0.0, "end")]]
    for k, b in enumerate(halves):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", captions.ROCKS)
    q = captions.stream_speakers(stream.select(*spark.createDataFrame([], SCHEMA).columns), 9.0, "10 seconds", buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    table = spark.createDataFrame([(v, o, t.timestamp(), d, x) for v, t, o, d, x in rows], "video_id string, ord long, start double, duration double, text string")
    want = {(r.video_id, r.ord): r.speaker for r in render.diarize(table, 9.0).collect()}
    assert {(r.video_id, r.ord): r.speaker for r in spark.read.parquet(str(tmp_path / "out")).where("video_id IS NOT NULL").collect()} == want
    assert 4 <= len(list(calls.iterdir())) <= 40


def test_catalog_refresh(spark, tmp_path):
    rng = random.Random(3)
    batches = [[{"name": rng.choice(["a", "b", "c", None, f"n{k}"]), "created": f"{rng.randint(0, 99):02}", **({"quality": rng.random()} if rng.random() < 0.7 else {}), "clips": rng.randint(0, 9)} for _ in range(12)] for k in range(4)]
    want = {}
    for k, b in enumerate(batches):
        mine = {}
        for p in b:
            x = (p["created"], p.get("quality", 0.0), p["clips"])
            if p["name"] is not None:
                mine[p["name"]] = max(mine.get(p["name"], x), x)
        for name, (created, quality, clips) in mine.items():
            want[name] = (quality, created, clips, want[name][3] if name in want else k, k)
    (tmp_path / "in").mkdir()
    for k, b in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, b)))
        catalog.refresh(spark, str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "ck"))
        if k == 2:
            catalog.compact(spark, str(tmp_path / "cat"), 1)
            catalog.compact(spark, str(tmp_path / "cat"), 1)  # again, with deltas and base in place
            catalog.upsert(spark.read.schema(catalog.PROFILE).json(str(tmp_path / "in" / "1.json")), 1, str(tmp_path / "cat"))
    got = {r["name"]: (r.quality, r.created, r.clips, r.first_batch, r.batch) for r in catalog.read_catalog(spark, str(tmp_path / "cat")).collect()}
    assert got == want
