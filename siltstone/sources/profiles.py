"""Tags of colour profiles: a binary table of big-endian offsets, read from a BINARY column."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "status string, reason string, bytes bigint, colour_space string, connection_space string, n_tags bigint, description string, red_x double, red_y double, red_z double, chroma_x double, chroma_y double"
# Where a profile's header ends and its tags lie, and the most tags that are read.
HEADER, TAG, MOST_TAGS = 128, 12, 1_000


def part(data: bytes, start: int, length: int) -> bytes:
    if start < 0 or length < 0 or start + length > len(data):
        raise ValueError(f"bytes {start} to {start + length} of {len(data)}")
    return data[start : start + length]


def number(data: bytes, start: int) -> int:
    return struct.unpack(">I", part(data, start, 4))[0]


def text_of(data: bytes, at: int) -> str | None:
    """A description: plain text, or the first of several languages."""
    kind = part(data, at, 4)
    if kind == b"desc":
        n = number(data, at + 8)
        return part(data, at + 12, max(0, n - 1)).decode("latin1").strip("\0 ")
    if kind == b"mluc" and number(data, at + 8):  # records of language, length and offset from 16 on
        return part(data, at + number(data, at + 24), number(data, at + 20)).decode("utf-16-be", "replace")
    return None


def read_profile(data: bytes | None) -> tuple:
    """The row of SCHEMA. status: `ok`, `none` (null or empty), `short` (no header and count), `bad_offset` (with what could be read)."""
    if not data:
        return ("none", None, 0, None, None, 0, None, *[np.nan] * 5)
    if len(data) < HEADER + 4:
        return ("short", f"{len(data)} bytes", len(data), None, None, 0, None, *[np.nan] * 5)
    spaces = [data[k : k + 4].decode("latin1") for k in (16, 20)]
    count, description, red, reason = number(data, HEADER), None, None, None
    tags: dict[bytes, int] = {}
    try:
        if count > MOST_TAGS:
            raise ValueError(f"{count} tags")
        for k in range(count):
            start = HEADER + 4 + TAG * k
            tags[part(data, start, 4)] = number(data, start + 4)
            part(data, number(data, start + 4), number(data, start + 8))  # what the table says must be there
        for name in (b"desc", b"dscm"):
            if name in tags and not description:
                description = text_of(data, tags[name])
        if b"rXYZ" in tags and part(data, tags[b"rXYZ"], 4) in (b"XYZ ", b"xyz "):
            red = [v / 65536 for v in struct.unpack(">3i", part(data, tags[b"rXYZ"] + 8, 12))]
    except ValueError as why:
        reason = str(why)
    x, y, z = red or [np.nan] * 3
    total = x + y + z
    share = (x / total, y / total) if red and total else (np.nan, np.nan)
    return ("ok" if reason is None else "bad_offset", reason, len(data), *spaces, count, description, x, y, z, *share)


def profile_tags(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Columns `keep` and what each profile of a binary column says; a malformed one fails no job."""
    source = files.select(*keep, F.col(content).cast("binary").alias("__content"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__content")

    def run(frames):
        for pdf in frames:
            made = pd.DataFrame([read_profile(None if c is None else bytes(c)) for c in pdf["__content"]], columns=names, index=pdf.index)
            yield pd.concat([pdf[keep], made], axis=1)

    return source.mapInPandas(run, ", ".join([kinds, SCHEMA] if kinds else [SCHEMA]))
