"""Signatures and token encryption as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "v1:"
_BLOCK = 64


def _xor(key: Column, byte: int) -> Column:
    """key, filled up to a hash block with zeros, with every byte xor-ed. Bytes are looked up as Latin characters, and the zeros
    are filled in as the byte itself; translate() would delete what becomes a zero, so that goes by another character."""
    held = F.decode(F.when(F.length(key) > _BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key), "ISO-8859-1")
    into = "".join(chr(c ^ byte) if c != byte else "\u0100" for c in range(256))
    swapped = F.translate(held, "".join(map(chr, range(256))), into)
    return F.encode(F.rpad(F.replace(swapped, F.lit("\u0100"), F.lit("\0")), _BLOCK, chr(byte)), "ISO-8859-1")


def hmac_sha256(key: Column, body: Column) -> Column:
    """Lower-case hexadecimal HMAC-SHA256 of binary columns, from sha2 alone."""
    inner = F.sha2(F.concat(_xor(key, 0x36), body), 256)
    return F.sha2(F.concat(_xor(key, 0x5C), F.unhex(inner)), 256)


def signature_ok(secret: Column, body: Column, signature: Column) -> Column:
    """signature is `sha256=` and the body's HMAC; malformed or null is false. Digests of both sides are compared, so
    the time does not tell how much of the signature agrees."""
    given = F.regexp_extract(F.coalesce(signature, F.lit("")), "^sha256=([0-9a-fA-F]{64})$", 1)  # empty, which no HMAC is, if malformed
    own = hmac_sha256(secret.cast("binary"), F.coalesce(body, F.lit("").cast("binary")))
    return F.coalesce(F.sha2(F.lower(given).cast("binary"), 256) == F.sha2(own.cast("binary"), 256), F.lit(False))


def is_key(key: Column) -> Column:
    """64 hexadecimal digits."""
    return F.coalesce(key.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def encrypt(plain: Column, key: Column) -> Column:
    """AES-256-GCM with a random nonce; `v1:` and base64 of nonce (12), tag (16) and text. Raises for a bad key."""
    checked = F.when(is_key(key), key).otherwise(F.raise_error(F.lit("the key must be 64 hexadecimal digits")).cast("string"))
    raw = F.aes_encrypt(plain.cast("binary"), F.unhex(checked), F.lit("GCM"), F.lit("DEFAULT"))
    # the engine's layout is nonce, text, tag
    # (bound once by transform(), as each use of the expression would draw a nonce of its own)
    return F.transform(F.array(raw), lambda r: F.concat(F.lit(PREFIX), F.base64(F.concat(F.substring(r, 1, 12), F.substring(r, F.length(r) - 15, F.lit(16)), F.substring(r, F.lit(13), F.length(r) - 28)))))[0]


def decrypt(sealed: Column, key: Column) -> Column:
    """the text of encrypt(); raises for a bad key, an unknown prefix or a wrong tag."""
    checked = F.when(is_key(key), key).otherwise(F.raise_error(F.lit("the key must be 64 hexadecimal digits")).cast("string"))
    body = F.when(sealed.startswith(PREFIX), F.substring(sealed, F.lit(len(PREFIX) + 1), F.length(sealed))).otherwise(F.raise_error(F.lit("unknown cipher prefix")).cast("string"))
    raw = F.unbase64(body)
    own = F.concat(F.substring(raw, 1, 12), F.substring(raw, F.lit(29), F.length(raw)), F.substring(raw, 13, 16))
    return F.aes_decrypt(own, F.unhex(checked), F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def authenticated_url(url: Column, token: Column) -> Column:
    """the token as the password of user x-access-token; without a token the URL as it is."""
    secured = F.concat(F.regexp_extract(url, "^(https?://)", 1), F.lit("x-access-token:"), F.url_encode(token), F.lit("@"), F.regexp_replace(url, "^https?://([^/@]*@)?", ""))
    return F.when(token.isNull() | ~url.rlike("^https?://"), url).otherwise(secured)
