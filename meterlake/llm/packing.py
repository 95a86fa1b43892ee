"""Number arrays as bytes, and the messages that blocks and shards send each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

MESSAGE = "shard int, block long, a binary, b binary, c binary, d binary"
MESSAGE_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), *[(x, pa.binary()) for x in "abcd"]])


def pack(a: np.ndarray) -> bytes:
    """Byte planes, as many as the largest number needs, compressed."""
    a = np.ascontiguousarray(a, "<u8")
    planes = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : b[0]] = raw.T
    return out.view("<u8").reshape(-1)


def pack_rising(a: np.ndarray) -> bytes:
    """A sorted array, as its steps."""
    return pack(np.diff(np.ascontiguousarray(a, "<u8"), prepend=np.uint64(0)))


def unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def messages(rows: list[tuple]) -> pa.Table:
    """Rows of MESSAGE, missing fields at the end as nulls."""
    return pa.Table.from_pylist([dict(zip(MESSAGE_SCHEMA.names, r)) for r in rows], MESSAGE_SCHEMA)
