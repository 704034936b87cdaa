"""Speakers of captions that arrive as a stream, late ones included: a state per bucket of videos, kept in RocksDB.

Captions wait in the state until the watermark has passed them; those are then taken in order of time, and each goes to the
speaker whose turn it is, as `plans.render.diarize` does for a whole table. What is kept of a video is the end of its last
caption, its turn, and the captions within the delay. Captions later than the delay are dropped by the watermark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS, TYPES = ["video_id", "start", "ord", "duration", "text"], {"video_id": object, "start": float, "ord": "int64", "duration": float, "text": object}
STATE = "videos array<string>, ended array<double>, turns array<long>, video_id array<string>, start array<double>, ord array<long>, duration array<double>, text array<string>"
OUT = "video_id string, ord long, start double, text string, speaker string"


class Turns:
    """The captions of a bucket of videos in a batch, or none when its timer is due. Rows (video_id, ord, start, duration, text):
    seconds from the epoch, and `ord` among those of one time. A call per bucket, since one per video costs more than its work."""

    def __init__(self, gap: float):
        self.gap = gap

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        videos, ended, turns, *waiting = state.get if state.exists else [[] for _ in range(3 + len(COLUMNS))]
        last = dict(zip(videos, zip(ended, turns)))
        held = pd.concat([pd.DataFrame(dict(zip(COLUMNS, waiting))).astype(TYPES), *[b[COLUMNS] for b in batches]], ignore_index=True)
        due = held["start"] <= passed / 1000  # none before them can come any more
        rest, now = held[~due], held[due].sort_values(["video_id", "start", "ord", "duration"], ignore_index=True)
        if len(now):
            end = now["start"] + now["duration"]
            video = now["video_id"].groupby(now["video_id"], dropna=False).ngroup()
            first = video != video.shift()
            before = [last.get(v, (0.0, 0)) for v in now["video_id"][first]]
            since = end.shift()
            since[first] = [x[0] for x in before]
            changes = (now["start"] - since > self.gap).astype("int64")
            changes[first] += [x[1] for x in before]
            n = changes.groupby(video).cumsum()
            final = video != video.shift(-1)
            last |= dict(zip(now["video_id"][final], zip(end[final].tolist(), n[final].tolist())))
            yield now[["video_id", "ord", "start", "text"]].assign(speaker="Speaker " + (n % 2 + 1).astype(str))
        state.update((list(last), [x[0] for x in last.values()], [x[1] for x in last.values()], *[rest[c].tolist() for c in COLUMNS]))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["start"].min() * 1000), passed + 1))


def stream_speakers(captions: DataFrame, gap: float, delay: str, buckets: int = 256) -> DataFrame:
    """A stream (video_id, ord, start, text, speaker) of a stream (video_id string, ts timestamp, ord, duration, text); blank
    captions are left out. Videos are dealt over `buckets` by a digest; a bucket's state is rewritten when it gets captions."""
    spoken = captions.where(F.trim(F.coalesce("text", F.lit(""))) != "").withWatermark("ts", delay)
    rows = spoken.select("video_id", "ts", F.col("ord").cast("long").alias("ord"), (F.unix_micros("ts") / 1e6).alias("start"), F.col("duration").cast("double").alias("duration"), "text")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(Turns(gap).__call__, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def speakers_of_files(spark: SparkSession, source: str, schema: str, gap: float, delay: str, sink: str, checkpoint: str, files: int = 1, partitions: int | None = None) -> DataFrame:
    """Captions of the Parquet files of a folder, as they arrive, `files` in a batch; the speakers are appended to `sink`. The
    state has `partitions` parts, by default the session's shuffle partitions; a checkpoint keeps the number it began with."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        q = stream_speakers(rows, gap, delay).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUT).parquet(sink)
