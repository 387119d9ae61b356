"""Readers of labelled corpora, WAV headers and line coverage files."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CORPUS


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per labelled note: corpus (file stem), number, now, note and its expected tasks."""
    raw = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return raw.select(stem.alias("corpus"), F.to_timestamp_ntz("now", F.lit("yyyy-MM-dd'T'HH:mm")).alias("now"), F.posexplode("cases").alias("number", "c")).select("corpus", "number", "now", F.col("c.note").alias("note"), F.col("c.tasks").alias("expected"))


def _pcm(content: bytes) -> bytes | None:
    """The samples of a 16 kHz mono 16-bit RIFF file, else None."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, good = 12, False
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            good = (kind, channels, rate, bits) == (1, 1, 16000, 16)
        elif name == b"data":
            return body if good else None
        at += 8 + size + size % 2
    return None


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, n_samples and RMS level of WAV files; null where a file is not 16 kHz mono PCM."""

    def run(batches):
        for pdf in batches:
            found = [_pcm(c) for c in pdf["content"]]
            levels = [None if p is None else np.frombuffer(p[: len(p) // 2 * 2], "<i2").astype(np.float64) / 32768 for p in found]
            yield pd.DataFrame({"path": pdf["path"], "n_samples": [None if x is None else len(x) for x in levels], "rms": [None if x is None else float(np.sqrt(np.mean(x**2))) if len(x) else 0.0 for x in levels]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(run, "path string, n_samples long, rms double")


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """file, lines found and hit; repeated entries of a line add up.

    Records are split at end_of_record, so each is a row whatever the size of the file.
    """
    records = spark.read.option("lineSep", "end_of_record").text(path)
    file = F.regexp_extract("value", r"SF:([^\r\n]+)", 1)
    lines = F.regexp_extract_all("value", F.lit(r"DA:(\d+,\d+)"), F.lit(1))
    each = records.select(file.alias("file"), F.explode(lines).alias("x")).where("file <> ''")
    by_line = each.groupBy("file", F.split("x", ",")[0].cast("int").alias("line")).agg(F.sum(F.split("x", ",")[1].cast("long")).alias("hits"))
    return by_line.groupBy("file").agg(F.count("*").alias("found"), F.count_if(F.col("hits") > 0).alias("hit"))
