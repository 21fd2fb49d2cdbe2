"""Sealed objects: AES-GCM with a random nonce for each row, bound to where the object belongs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sealed(content: Column, key: Column, place: Column) -> Column:
    """Nonce, ciphertext and tag of ``content``; Spark draws the nonce. ``place`` must be the same to open it."""
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), place)


def opened(content: Column, key: Column, place: Column) -> Column:
    """The content of a sealed object; null if it was changed, moved or sealed under another key."""
    return F.try_aes_decrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), place)
