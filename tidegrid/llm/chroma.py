"""Chroma fingerprints of audio columns, and alignment of excerpts with recordings.

Audio is mono PCM, 16-bit little-endian. Overlapping frames give spectra, folded into twelve pitch classes. Filters on the integral image of
(frames x pitch classes) compare neighbouring areas in time and pitch; two bits each are packed into one integer per frame position. Equal
integers of a query and a recording vote for a time offset; the offset with most votes is checked by the share of differing bits.

Recordings with equal fingerprints are one entry of the index. The votes are summed before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.store import split_join, store

RATE = 4096
FRAME = 1024
HOP = 512
LOWEST, HIGHEST = 100.0, 1700.0  # Hz
SPAN = 8  # frames under a filter
# Sixteen filters by rule: each shape over four places on the circle of pitch classes.
SHAPES = ("rise", "pitch", "middle", "corner")
LEVELS = np.log([0.6, 1.0, 1.0 / 0.6])  # of the ratio of the two areas
LEAST_VOTES = 2
MOST_ERRORS = 0.25
LEAST_OVERLAP = 8


def _fold() -> np.ndarray:
    """Frequency bins x pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hz >= LOWEST) & (hz <= HIGHEST)
    pitch = np.zeros(len(hz), int)
    pitch[use] = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    out = np.zeros((len(hz), 12), np.float32)
    out[np.flatnonzero(use), pitch[use]] = 1
    return out


_FOLD = _fold()
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(pcm: bytes) -> np.ndarray:
    """Frames x 12, each frame scaled to length one; frames of silence are zero."""
    x = np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(np.float32) / 32768
    if len(x) < FRAME:
        return np.zeros((0, 12))
    found = []
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for lo in range(0, len(views), 512):  # bounded, whatever the length of the recording
        power = np.abs(np.fft.rfft(views[lo : lo + 512] * _WINDOW)).astype(np.float32) ** 2
        found.append(power @ _FOLD)
    c = np.concatenate(found).astype(np.float64)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-3, c / np.maximum(norm, 1e-3), 0.0)


def fingerprint(pcm: bytes) -> np.ndarray:
    """One packed 32-bit integer per position; empty for audio shorter than the filters."""
    c = chroma(pcm)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    wide = np.hstack([c, c])  # the circle of pitch classes, twice around
    image = np.zeros((len(c) + 1, 25))
    image[1:, 1:] = wide.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t1 : t1 + n, p1] - image[t0 : t0 + n, p1] - image[t1 : t1 + n, p0] + image[t0 : t0 + n, p0]

    half, out = SPAN // 2, np.zeros(n, np.uint32)
    for shape in SHAPES:
        for place in range(4):
            p = 3 * place
            if shape == "rise":
                a, b = area(0, half, p, p + 3), area(half, SPAN, p, p + 3)
            elif shape == "pitch":
                a, b = area(0, SPAN, p, p + 2), area(0, SPAN, p + 2, p + 4)
            elif shape == "middle":
                a, b = area(2, SPAN - 2, p, p + 4), area(0, 2, p, p + 4) + area(SPAN - 2, SPAN, p, p + 4)
            else:
                a = area(0, half, p, p + 3) + area(half, SPAN, p + 3, p + 6)
                b = area(half, SPAN, p, p + 3) + area(0, half, p + 3, p + 6)
            level = np.searchsorted(LEVELS, np.log((a + 0.01) / (b + 0.01)))
            out = out << np.uint32(2) | (level ^ (level >> 1)).astype(np.uint32)  # neighbouring levels differ in one bit
    return out.view(np.int32)


def fingerprints(media: DataFrame, key: str, audio: str) -> DataFrame:
    """(id, digest, prints) of every row; null or too short audio has no prints. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(f.tobytes()).digest() for f in made], pa.binary()), pa.array(made, pa.list_(pa.int32()))], ["id", "digest", "prints"])

    return media.select(F.col(key).cast("long"), F.col(audio)).mapInArrow(run, "id long, digest binary, prints array<int>")


def align(queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """(query, digest, offset, votes, errors, overlap): entries of the index that a query fits, both sides as :func:`fingerprints` returns them.

    ``offset`` is the place of the query in the recording, in hops; ``errors`` the share of differing bits where they overlap. A query without
    prints fits nothing.
    """
    index = recordings.filter("size(prints) > 0").groupBy("digest").agg(F.first("prints").alias("prints"))
    index, _ = store(index, "prints")
    asked = queries.filter("size(prints) > 0").select(F.col("id").alias("query"), F.col("prints").alias("asked")).distinct()
    ours = asked.select("query", F.posexplode("asked").alias("p", "value")).groupBy("query", "value").agg(F.collect_list("p").alias("ps"))
    theirs = index.select("digest", F.posexplode("prints").alias("r", "value"))
    votes = theirs.join(ours, "value").select("query", "digest", F.explode(F.expr("transform(ps, p -> r - p)")).alias("offset")).groupBy("query", "digest", "offset").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("query", "digest").agg(F.max(F.struct("votes", F.col("offset").alias("offset"))).alias("v")).select("query", "digest", "v.votes", "v.offset").filter(f"votes >= {LEAST_VOTES}")
    both = best.join(asked, "query").join(index, "digest")
    lo, hi = F.greatest(F.lit(0), F.col("offset")), F.least(F.size("prints"), F.col("offset") + F.size("asked"))
    cut = both.withColumn("lo", lo).withColumn("overlap", hi - lo).filter(f"overlap >= {LEAST_OVERLAP}")
    differ = F.expr("aggregate(zip_with(slice(prints, lo + 1, overlap), slice(asked, lo - offset + 1, overlap), (x, y) -> bit_count((x ^ y) & 4294967295L)), 0L, (s, x) -> s + x)")
    return cut.select("query", "digest", "offset", "votes", (differ / (32.0 * F.col("overlap"))).alias("errors"), "overlap").filter(f"errors <= {MOST_ERRORS}")


def tones(vector: np.ndarray, note: int = HOP) -> bytes:
    """A recording of a vector: one note per value, its pitch by the value's size."""
    step = np.floor(vector.astype(np.float64) * 40).astype(int) % 24
    hz = np.repeat(220.0 * 2 ** (step / 12), note)
    x = np.sin(2 * np.pi * np.cumsum(hz) / RATE)
    return (0.5 * 32767 * x).astype("<i2").tobytes()


def vector_recordings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", excerpts: bool = False) -> DataFrame:
    """(id, audio): each vector as a recording, or as an excerpt of half its length: fainter, with noise, from a place that its id decides.

    Null vectors and values are silence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sounds = b.column(0).to_pylist(), []
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                sounds = []
                for i, v in zip(ids[lo : lo + 64], part.column(1).to_pylist()):
                    pcm = tones(np.nan_to_num(np.array([0.0 if x is None else x for x in v or []])))
                    if excerpts:
                        notes = len(pcm) // (2 * HOP)
                        at = (i or 0) // 100 % max(1, notes // 2)
                        x = np.frombuffer(pcm, "<i2")[at * HOP : (at + notes // 2) * HOP].astype(np.float64)
                        pcm = (0.7 * x + np.random.default_rng(i or 0).normal(0, 200, len(x))).astype("<i2").tobytes()
                    sounds.append(pcm)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sounds, pa.binary())], ["id", "audio"])

    return vectors.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(run, "id long, audio binary")


def search(media: DataFrame, excerpts: DataFrame, key: str = "id", audio: str = "audio") -> DataFrame:
    """(query_id, match_id, copies, offset, votes, errors, overlap): recordings that an excerpt is from.

    Recordings with equal fingerprints are one match, named by the smallest id, with their number.
    """
    made, _ = store(fingerprints(media, key, audio), "media")
    named = made.filter("size(prints) > 0").groupBy("digest").agg(F.min("id").alias("match_id"), F.count(F.lit(1)).alias("copies"))
    asked, _ = store(fingerprints(excerpts, key, audio), "asked")
    return align(asked, made).join(named, "digest").select(F.col("query").alias("query_id"), "match_id", "copies", "offset", "votes", F.round("errors", 6).alias("errors"), "overlap")
