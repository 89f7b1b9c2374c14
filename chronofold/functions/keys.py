"""Content-addressed record keys as column expressions.

A record's full key is sha64(payload) XOR sha64(stored key of the record before it); the stored key writes a prefix of
its bits, led by a 1, in base 64.  64-bit values are signed longs with the same bits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-+"
RESERVED = ("0", "1")


def canonical(payload: Column) -> Column:
    """JSON text with sorted keys and no white space."""
    return F.to_json(F.parse_json(payload))


def hash_text(payload: Column) -> Column:
    """What is hashed of a payload (JSON text): a string's own characters, '' for null, canonical JSON for all else.

    Text that is no JSON is hashed as it is.  Numbers are written as Spark writes them (1.0E21, not 1e+21).
    """
    parsed = F.try_parse_json(payload)
    kind = F.schema_of_variant(parsed)
    return F.when(payload.isNull(), "").when(parsed.isNull(), payload).when(kind == "VOID", "").when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(F.to_json(parsed))


def sha64_hex(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def sha64(text: Column) -> Column:
    """First eight bytes of SHA-256, big-endian; null is the empty string."""
    raw = F.unhex(sha64_hex(text))
    return F.conv(F.hex(raw), 16, -10).cast("long")


def full_key(payload: Column, previous: Column) -> Column:
    """The full key of a payload (JSON text) behind the stored key of the record before it."""
    return sha64(hash_text(payload)).bitwiseXOR(sha64(previous))


def recover_previous(key: Column, payload: Column) -> Column:
    """The hash of the previous key, from a full key and its payload."""
    return key.bitwiseXOR(sha64(hash_text(payload)))


def token_id(token: Column, left: Column, right: Column) -> Column:
    return sha64(token).bitwiseXOR(left).bitwiseXOR(right)


def to_base64(n: Column) -> Column:
    """Unsigned 64-bit value in the 64-symbol alphabet, unpadded; 0 is '0'."""
    six = lambda i: F.shiftrightunsigned(n, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    digits = [F.substring(F.lit(ALPHABET), six(i) + 1, F.lit(1)) for i in range(10, -1, -1)]
    return F.concat(F.ltrim(F.concat(*digits[:-1]), F.lit("0")), digits[-1])


def from_base64(key: Column) -> Column:
    """Inverse of to_base64; unknown symbols are skipped, values wrap at 64 bits."""
    values = F.transform(F.filter(F.split(key, ""), lambda c: F.length(c) > 0), lambda c: F.instr(F.lit(ALPHABET), c).cast("long") - 1)
    return F.aggregate(F.filter(values, lambda v: v >= 0), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, 6).bitwiseOR(v))


def to_bits(key: Column) -> Column:
    """The bits of a stored key, without the leading 1; '0' and '1' are their own bits."""
    return F.when(key.isin(*RESERVED), key).otherwise(F.substring(F.bin(from_base64(key)), 2, 64))


def key_bits(full: Column) -> Column:
    """All 64 bits of a full key."""
    return F.lpad(F.bin(full), 64, "0")


def level_of(key: Column) -> Column:
    return F.length(to_bits(key))


def position_to_key_length(position: Column) -> Column:
    return F.ceil(F.log(position + 1) / F.log(F.lit(64.0)))


def key_length_to_position(length: Column) -> Column:
    return F.pow(F.lit(64.0), length - 1)


def capacity(level: Column) -> Column:
    """How many keys a level holds."""
    return F.pow(F.lit(2.0), level).cast("long")


# The same in Python, for the allocator, which is sequential by log.


def py_sha64(text: str | None) -> int:
    return int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")


def py_base64(n: int) -> str:
    if n == 0:
        return "0"
    out = ""
    while n:
        out = ALPHABET[n & 63] + out
        n >>= 6
    return out


def py_bits(key: str) -> str:
    if key in RESERVED:
        return key
    n = 0
    for c in key:
        if c in ALPHABET:
            n = n * 64 + ALPHABET.index(c)
    return bin(n)[3:]


class Allocator:
    """The taken prefixes of one log, as numbers led by a 1, with a count by level so that closed levels are skipped."""

    def __init__(self):
        self.taken: set[int] = set()
        self.levels: dict[int, int] = {}

    def take(self, bits: str) -> bool:
        n = int("1" + bits, 2)
        if n in self.taken:
            return False
        self.taken.add(n)
        self.levels[len(bits)] = self.levels.get(len(bits), 0) + 1
        return True

    def allocate(self, bits: str, start: int = 2) -> str:
        """The stored key of the shortest free prefix of bits, from a length of start; it is taken."""
        for n in range(start, len(bits) + 1):
            if self.levels.get(n, 0) < 1 << n and self.take(bits[:n]):
                return py_base64(int("1" + bits[:n], 2))
        raise ValueError("no free prefix is left")


def allocate(bits: str, taken: set[str], start: int = 2) -> str:
    """The shortest free prefix of bits among a set of bit strings; it is taken."""
    own = Allocator()
    for t in taken:
        own.take(t)
    key = own.allocate(bits, start)
    taken.add(py_bits(key))
    return key


def nano() -> Column:
    """Nanoseconds since the epoch (of whole microseconds)."""
    return F.unix_micros(F.current_timestamp()) * 1000
