"""Keyset cursors: 22 bytes of magic, version, direction, series id and timestamp, base64url without padding."""

from __future__ import annotations

import base64
import binascii
import struct

from ..errors import QueryError

_FORM, _MAGIC, _VERSION = ">4sBBQq", b"TMKC", 1


def encode(series_id: int, ts: int, descending: bool) -> str:
    return base64.urlsafe_b64encode(struct.pack(_FORM, _MAGIC, _VERSION, 2 if descending else 1, series_id, ts)).decode().rstrip("=")


def decode(token: str, descending: bool) -> tuple[int, int]:
    """``(series_id, ts)``; a malformed token or one of the other direction is refused."""
    try:
        raw = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True)
        magic, version, direction, series_id, ts = struct.unpack(_FORM, raw)
    except (binascii.Error, struct.error, ValueError) as e:
        raise QueryError("invalid-cursor", "malformed token") from e
    if magic != _MAGIC or version != _VERSION or direction != (2 if descending else 1):
        raise QueryError("invalid-cursor", "foreign token or other direction")
    return series_id, ts
