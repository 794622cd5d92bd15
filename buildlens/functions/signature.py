"""Webhook signature checks as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256; only the two key pads are computed outside Spark."""
    inner, outer = _pads(secret)
    digest = F.sha2(F.concat(F.lit(inner), F.encode(body, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def signature_provider(hub_signature: Column, gitlab_token: Column) -> Column:
    return (F.when(F.coalesce(hub_signature, F.lit("")) != "", "github")
            .when(F.coalesce(gitlab_token, F.lit("")) != "", "gitlab")
            .otherwise("unknown"))


def signature_valid(body: Column, hub_signature: Column, gitlab_token: Column, secret: str,
                    development: bool = False) -> Column:
    """Never rejects: only says whether the delivery is signed correctly."""
    return (F.when(F.coalesce(hub_signature, F.lit("")) != "",
                   hub_signature == F.concat(F.lit("sha256="), hmac_sha256(body, secret)))
            .when(F.coalesce(gitlab_token, F.lit("")) != "", gitlab_token == F.lit(secret))
            .otherwise(F.lit(development)))
