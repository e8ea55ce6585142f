"""Random draws that only the holder of a secret can repeat, for private release.

A draw is a keyed hash (SHA-256, nested as in HMAC) of a row's key, so it is the same on any partitioning
and on a lost executor's second try, and nobody without the secret can compute it and take the noise off.
There is no default secret.  Each purpose has a key of its own, which stands in query plans and event logs:
guard those like the secret itself.
"""

from __future__ import annotations

import hashlib
import hmac
import math
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

#: hexadecimal digits that decide one yes-or-no draw, and bytes that a secret has at least
DIGITS, SECRET_BYTES = 30, 16


def noise_key(secret: bytes, purpose: str) -> str:
    """The key of one purpose; a secret under 16 bytes is refused."""
    if not isinstance(secret, bytes) or len(secret) < SECRET_BYTES:
        raise ValueError(f"a secret of at least {SECRET_BYTES} random bytes is needed")
    return hmac.new(secret, purpose.encode(), hashlib.sha256).hexdigest()


def _message(parts: list[str | None]) -> str:
    return "".join("n" if p is None else f"{len(p)}:{p}" for p in parts)


def keyed_hash(key: str, *parts: object) -> str:
    """On the driver, what keyed_digits gives for a row."""
    inner = hashlib.sha256((key + _message([None if p is None else str(p) for p in parts])).encode()).hexdigest()
    return hashlib.sha256((key + inner).encode()).hexdigest()


def keyed_draw(key: str, *parts: object) -> float:
    return (int(keyed_hash(key, *parts)[:13], 16) + 0.5) / (1 << 52)


def keyed_digits(key: str, *parts: Column | str) -> Column:
    """64 hexadecimal digits; the parts of a row's key are told apart by their lengths, nulls by a letter."""
    texts = [(p if isinstance(p, Column) else F.col(p)).cast("string") for p in parts]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    inner = F.sha2(F.concat(F.lit(key), *marked), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def keyed_uniform(key: str, *parts: Column | str) -> Column:
    """A number in (0, 1)."""
    return (F.conv(F.substring(keyed_digits(key, *parts), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def laplace_bits(eps: float) -> list[str]:
    """Bit i of a geometric number with ratio exp(-eps) is 1 with chance 1 / (1 + exp(eps 2^i)), independently of the others.

    Each chance in ``DIGITS`` hexadecimal digits, up to the bit whose chance is below one unit of the last.
    """
    if not eps > 0 or not math.isfinite(eps):
        raise ValueError("eps must be positive")
    out = []
    with localcontext() as ctx:
        ctx.prec = 60
        unit = Decimal(16) ** DIGITS
        while True:
            chance = int(unit / (1 + (Decimal(eps) * (1 << len(out))).exp()))
            if not chance:
                return out
            out.append(f"{chance:0{DIGITS}x}")


def discrete_laplace(eps: float, key: str, *parts: Column | str) -> Column:
    """An integer x with chance proportional to exp(-eps |x|), exact to 2^-120: the difference of two geometric numbers.

    Noise is whole, so no low bits of a sum tell the count; chances are compared as digits, without floating point.
    """
    total = F.lit(0).cast("long")
    for i, chance in enumerate(laplace_bits(eps)):
        bit = [F.when(F.substring(keyed_digits(key, *parts, F.lit(f"{side}{i}")), 1, DIGITS) < chance, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for side in "+-"]
        total = total + bit[0] - bit[1]
    return total
