"""Recorded captures: manifests, binary event chunks, file hashes."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S

# Fixed values of the record format, version 3 (little endian).
MAGIC, VERSION = 0x43415846, 3
HEADER = struct.Struct("<IHHQQQQQ")  # magic, schema, kind, session, ordinal, ns, epoch_ms, server_tick
LEAST, MOST, TEXT_LIMIT = 48, 8192, 1024

# Body of each kind: t text, ? flag, and struct letters for numbers; a name of "-" is skipped.
_COMBAT = [("t", "world"), ("t", "target"), ("t", "target_kind"), ("t", "reason"), ("i", "target_id"),
           *[("d", f"{p}_{a}") for p in ("eye", "low", "high") for a in "xyz"], ("i", "ping"), ("?", "available"), ("d", "yaw"), ("d", "pitch"),
           ("?", "rotation"), ("?", "sprint"), ("?", "target_player")]
_MINING = [("i", "bx"), ("i", "by"), ("i", "bz"), ("t", "world"), ("t", "state_key"), ("t", "block"), ("t", "tool"), ("t", "reason"), ("d", "damage"), ("?", "available")]
_ORDERED = [("Q", "packet"), ("Q", "batch")]
BODIES = {
    1: [("t", "player"), ("I", "protocol"), ("I", "model")],
    2: [], 3: [("t", "reason")], 4: [],
    5: [*_ORDERED, ("Q", "sampled_ns"), ("B", "action"), ("B", "face"), *_MINING], 6: _MINING,
    7: [*_ORDERED, ("Q", "sampled_ns"), *_COMBAT], 8: [("Q", "sampled_ns"), *_COMBAT], 9: _ORDERED,
    10: [("t", "cause"), ("t", "from_world"), ("t", "to_world"), *[("d", f"{p}_{a}") for p in ("from", "to") for a in "xyz"]],
    11: [*_ORDERED, ("Q", "sampled_ns"), *[("d", a) for a in "xyz"], ("d", "yaw"), ("d", "pitch"), ("?", "has_pos"), ("?", "has_look"), ("?", "ground"), ("t", "world"), ("t", "reason"),
         *[("?", n) for n in ("available", "source", "destination", "clear", "flat", "item", "sprint")], ("d", "speed"), ("d", "friction"), ("d", "jump")],
    12: [("Q", "token"), ("d", "vx"), ("d", "vy"), ("d", "vz"), ("?", "additive")], 13: [("Q", "token")], 14: [],
}
COLUMNS = [part.split()[0] for part in S.OBS_DDL.split(",")]


def decode_record(raw: bytes) -> dict:
    """One record as a flat dict; anything unexpected raises ValueError."""
    if len(raw) < HEADER.size:
        raise ValueError("header: too few bytes")
    magic, version, kind, session, ordinal, ns, epoch, tick = HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("header: magic or version")
    if kind not in BODIES:
        raise ValueError("header: kind")
    out = {"kind": kind, "session": session, "ordinal": ordinal, "ns": ns, "epoch_ms": epoch, "server_tick": tick}
    at = HEADER.size
    try:
        for code, name in BODIES[kind]:
            if code == "t":
                (size,) = struct.unpack_from("<H", raw, at)
                at += 2
                if size > TEXT_LIMIT or at + size > len(raw):
                    raise ValueError("body: text length")
                out[name], at = raw[at:at + size].decode("ascii"), at + size
            elif code == "?":
                if raw[at] > 1:
                    raise ValueError("body: boolean")
                out[name], at = bool(raw[at]), at + 1
            else:
                (out[name],) = struct.unpack_from("<" + code, raw, at)
                at += struct.calcsize("<" + code)
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise ValueError(f"body: {e}") from None
    if at != len(raw):
        raise ValueError("body: trailing bytes")
    return out


def split_records(data: bytes) -> Iterator[bytes]:
    """Length-prefixed records of one uncompressed chunk."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("chunk: cut prefix")
        (size,) = struct.unpack_from("<I", data, at)
        if not LEAST <= size <= MOST:
            raise ValueError("chunk: record size")
        if at + 4 + size > len(data):
            raise ValueError("chunk: cut record")
        yield data[at + 4:at + 4 + size]
        at += 4 + size


def decode_chunks(chunks: DataFrame, zipped: bool = True, batch: int = 20_000) -> DataFrame:
    """Decode (trial, path, content) rows into observations; a bad chunk ends in one row with ``error``.

    ``position`` is the place in the chunk; with the chunk's path it gives the delivery order.
    """
    names = ["trial", "path", "position", "error", *COLUMNS[1:]]

    def run(batches):
        for pdf in batches:
            out = []
            for trial, path, content in zip(pdf["trial"], pdf["path"], pdf["content"]):
                position = 0
                try:
                    data = gzip.decompress(content) if zipped else bytes(content)
                    for position, raw in enumerate(split_records(data)):
                        out.append({"trial": trial, "path": path, "position": position, **decode_record(raw)})
                        if len(out) >= batch:
                            yield _frame(out, names)
                            out = []
                except (ValueError, OSError, EOFError) as e:
                    out.append({"trial": trial, "path": path, "position": position, "error": str(e)})
            if out:
                yield _frame(out, names)

    schema = "trial string, path string, position bigint, error string, " + S.OBS_DDL.strip().split(",", 1)[1]
    return chunks.select("trial", "path", "content").mapInPandas(run, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def read_captures(spark: SparkSession, root: str) -> DataFrame:
    """Chunks ``run-*/trial-*/events-*.acbin.gz`` under ``root``, decoded; one file is one unit of work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "events-*.acbin.gz").option("recursiveFileLookup", "true").load(root)
    trial = F.regexp_extract("path", r"trial-([^/]+)/[^/]+$", 1)
    return decode_chunks(files.select(trial.alias("trial"), "path", "content"))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every manifest.json with its folder; a broken one keeps its text in ``_corrupt`` instead of failing the scan."""
    schema = S._fields(S.MANIFEST_DDL + ", _corrupt string")
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true")
          .option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(root))
    return df.withColumn("manifest_path", F.col("_metadata.file_path"))


def hash_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SHA-256 and size of every file; the content never leaves its task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_hashes(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files that changed, are missing, or are not in the catalog."""
    j = files.select("path", "sha256").join(catalog.select("path", F.col("sha256").alias("expected")), "path", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("sha256") != F.col("expected"), "changed")
    return j.select("path", problem.alias("problem")).filter("problem IS NOT NULL")
