"""Keyed hashes and format-preserving encryption as JVM expressions (no UDF)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lamina.model import RuleError, Secrets

#: Algorithm: block size of its HMAC in bytes, and the hash's name.
ALGORITHMS = {"HmacSHA256": (64, "sha256"), "HmacSHA512": (128, "sha512"), "HmacSHA1": (64, "sha1")}
#: Hides pads, keys and round tables in plans and event logs when set as spark.sql.redaction.string.regex.
REDACTION = r"[0-9a-fA-F]{32,}"
INT_MAX, ID_MAX = 2**31 - 1, 10**18 - 1
ROUNDS = 10


def _digest(data: Column, name: str) -> Column:
    return F.sha1(data) if name == "sha1" else F.sha2(data, int(name[3:]))


def hmac_hex(value: Column, secrets: Secrets) -> Column:
    """Lower-case hex HMAC of the value's text; null stays null."""
    if secrets.algorithm not in ALGORITHMS:
        raise RuleError("CONFIG_HMAC_ALGORITHM", f"unknown algorithm {secrets.algorithm}")
    size, name = ALGORITHMS[secrets.algorithm]
    key = secrets.hmac_secret.encode()
    key = (hashlib.new(name, key).digest() if len(key) > size else key).ljust(size, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return _digest(F.concat(outer, F.unhex(_digest(F.concat(inner, F.encode(value.cast("string"), "UTF-8")), name))), name)


def long_of(hexes: Column) -> Column:
    """First 8 bytes of a hex digest as a signed big-endian long."""
    return F.conv(F.substring(hexes, 1, 16), 16, -10).cast("long")


def long_key(value: Column, secrets: Secrets) -> Column:
    return long_of(hmac_hex(value, secrets))


def seed(value: Column, secrets: Secrets) -> Column:
    """Seed of fakes: the long key of the lowered value."""
    return long_key(F.lower(value.cast("string")), secrets)


def fingerprint(value: Column, secrets: Secrets) -> Column:
    """First 8 hex characters; null counts as the text null."""
    return F.substring(hmac_hex(F.coalesce(value.cast("string"), F.lit("null")), secrets), 1, 8)


def uuid_of(value: Column, secrets: Secrets) -> Column:
    """One-way UUID (version 4, variant 10) from the HMAC of the lowered value."""
    h = hmac_hex(F.lower(value.cast("string")), secrets)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


# --- FF1 (NIST SP 800-38G) with an empty tweak ---------------------------------------------------


def _block(data: Column, key: str) -> Column:
    """AES of one 16-byte block: ECB with padding, of which the first block is taken."""
    return F.substring(F.aes_encrypt(data, F.lit(bytearray(key.encode())), F.lit("ECB"), F.lit("PKCS")), 1, 16)


def _first_block(key: str, radix: int, digits: int) -> Column:
    p = bytes([1, 2, 1]) + radix.to_bytes(3, "big") + bytes([10, digits // 2 % 256]) + digits.to_bytes(4, "big") + bytes(4)
    return _block(F.lit(bytearray(p)), key)


def _round_hex(i: Column, b: Column, key: str, radix: int, digits: int, width: int) -> Column:
    """First 8 bytes (hex) of the round function: the second block differs from zero in its low 1 + width bytes only."""
    r = _first_block(key, radix, digits)
    low = F.conv(F.hex(F.substring(r, 9, 8)), 16, -10).cast("long")
    x = low.bitwiseXOR((i * F.lit(1 << 8 * width)).bitwiseOR(b))
    return F.hex(F.substring(_block(F.concat(F.substring(r, 1, 8), F.unhex(F.lpad(F.hex(x), 16, "0"))), key), 1, 8))


def _number(hexes: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(hexes, start, length), 16, 10).cast("long")


_tables: dict[bytes, bytes] = {}


def round_table(key: str) -> bytes:
    """The radix-2 round function of all 10 rounds on all 16-bit halves, 2 bytes each: its domain is so small that encryption becomes 10 look-ups."""
    known = hashlib.sha256(b"rounds" + key.encode()).digest()
    if known not in _tables:
        halves = SparkSession.active().range(0, 1 << 16, 1, 8)
        cells = F.concat(*(F.substring(F.unhex(_round_hex(F.lit(i).cast("long"), F.col("id"), key, 2, 31, 2)), 7, 2) for i in range(ROUNDS)))
        rows = sorted((r.id, bytes(r.c)) for r in halves.select("id", cells.alias("c")).collect())
        _tables[known] = b"".join(c[2 * i : 2 * i + 2] for i in range(ROUNDS) for _, c in rows)
    return _tables[known]


def _ff1_bits(value: Column, key: str) -> Column:
    """FF1 over 31 bits, as 15 and 16, by the round table."""
    table = F.lit(bytearray(round_table(key)))

    def step(state: Column, i: Column) -> Column:
        place = i * (2 << 16) + state["b"] * 2 + 1
        cell = F.conv(F.hex(F.substring(table, place, F.lit(2))), 16, 10).cast("int")
        width = F.when(i % 2 == 0, (1 << 15) - 1).otherwise((1 << 16) - 1)
        return F.struct(state["b"].alias("a"), (state["a"] + cell).bitwiseAND(width).alias("b"))

    start = F.struct(F.shiftright(value, 16).cast("int").alias("a"), value.bitwiseAND(0xFFFF).cast("int").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.shiftleft(s["a"].cast("long"), 16).bitwiseOR(s["b"].cast("long")))


def _ff1_digits(value: Column, key: str) -> Column:
    """FF1 over 18 decimal digits, one AES block a round."""
    half = 10**9

    def step(state: Column, i: Column) -> Column:
        s = _round_hex(i, state["b"], key, 10, 18, 4)
        y = ((_number(s, 1, 8) % half) * (2**32 % half) + _number(s, 9, 8)) % half
        return F.struct(state["b"].alias("a"), ((state["a"] + y) % half).alias("b"))

    start = F.struct(F.call_function("div", value, F.lit(half)).alias("a"), (value % half).alias("b"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), start, step, lambda s: s["a"] * half + s["b"])


def encrypt_id(value: Column, secrets: Secrets) -> Column:
    """Format-preserving id: integers up to 2**31-1 stay in that range, larger ones have up to 18 digits.

    Anything else (negative, too large, not an integer) fails the query. The two ranges overlap in their results, so a
    column that spans 2**31 is not mapped one to one.
    """
    text = F.trim(value.cast("string"))
    number = text.try_cast("bigint")
    wrong = F.raise_error(F.lit("[ANON_FPE_ID_OUT_OF_RANGE] not an integer from 0 to 10^18-1"))
    valid = text.rlike(r"^[+-]?[0-9]+$") & number.isNotNull() & (number >= 0) & (number <= ID_MAX)
    small = F.least(F.greatest(number, F.lit(0)), F.lit(INT_MAX))
    return F.when(value.isNull(), F.lit(None).cast("long")).when(~F.coalesce(valid, F.lit(False)), wrong.cast("long")).when(number <= INT_MAX, _ff1_bits(small, secrets.fpe_key)).otherwise(_ff1_digits(number, secrets.fpe_key))
