"""Counter-based randomness: values that depend on a seed and coordinates only, so that any region can be made alone."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*key: Column, stream: int = 0) -> Column:
    """In (0, 1), from a 64-bit hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(stream), *key), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*key: Column, stream: int = 0) -> Column:
    """Standard normal (Box-Muller on two streams), without leaving the JVM."""
    return F.sqrt(-2.0 * F.ln(uniform(*key, stream=2 * stream + 1))) * F.cos(2.0 * math.pi * uniform(*key, stream=2 * stream + 2))


# The rational approximations of the inverse normal distribution of algorithm AS 241, numerators and denominators by rising power.
_MIDDLE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
           (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_NEAR = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
         (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
# Multipliers of x, y, t and channel, and of the mix, of the coordinate hash; of seed and tile of the tile seed.
COORDINATES = {"x": 6364136223846793005, "y": 1442695040888963407, "t": 22695477, "channel": 1103515245}
MIX, MIX_ADD, MIX_SHIFTS, CLAMP = 2862933555777941757, 3037000493, (33, 29), 1e-12
TILES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _ratio(r: Column, polynomials: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    def value(coefficients):
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * r + c
        return out

    return value(polynomials[0]) / value(polynomials[1])


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share p in (0, 1) lies, to 16 digits."""
    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.when(tail <= 5, _ratio(tail - 1.6, _NEAR)).otherwise(_ratio(tail - 5.0, _FAR))
    return F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, _MIDDLE)).otherwise(F.signum(q) * outer)


def times(a: Column, factor: int, add: int = 0) -> Column:
    """a * factor + add in 64 bits, wrapping; long arithmetic itself would raise. In limbs of 16 bits with carries."""
    limb = lambda x, k: (x >> (16 * k)) & 0xFFFF
    mine = [F.shiftrightunsigned(a, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in range(4)]
    out, carry = F.lit(0).cast("long"), None
    for k in range(4):
        total = F.lit(limb(add, k)).cast("long")
        for i in range(k + 1):
            total = total + mine[i] * F.lit(limb(factor, k - i)).cast("long")
        total = total if carry is None else total + carry
        out = out.bitwiseOR(F.shiftleft(total.bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * k))
        carry = F.shiftrightunsigned(total, 16)
    return out


def coordinate_normal(cells: DataFrame, channels: int, seed: int) -> DataFrame:
    """cells (t, y, x and more) with c0, c1, ..: standard normal values of (seed, channel, t, y, x).

    A 64-bit hash of the products of coordinates and odd factors, its low 53 bits as a share, the normal value of that
    share. Step by step in columns, so that no expression is written out twice.
    """
    base = F.lit(seed).cast("long")
    for c in ("x", "y", "t"):
        base = base.bitwiseXOR(times(F.col(c).cast("long"), COORDINATES[c]))
    names, out = [f"c{c}" for c in range(channels)], cells.withColumn("_base", base)
    out = out.withColumns({n: F.col("_base").bitwiseXOR(F.lit(k * COORDINATES["channel"]).cast("long")) for k, n in enumerate(names)})
    out = out.withColumns({n: F.col(n).bitwiseXOR(F.shiftright(n, MIX_SHIFTS[0])) for n in names})
    out = out.withColumns({n: times(F.col(n), MIX, MIX_ADD) for n in names})
    out = out.withColumns({n: F.col(n).bitwiseXOR(F.shiftright(n, MIX_SHIFTS[1])).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53) for n in names})
    return out.withColumns({n: normal_quantile(F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), F.col(n)))) for n in names}).drop("_base")


def derived_seed(master: Column, episode: Column) -> Column:
    """The first 8 hex digits of sha256('master:episode') as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", master.cast("string"), episode.cast("string")), 256), 1, 8), 16, 10).cast("bigint")


def derive_seed(master: int, episode: int) -> int:
    return int(hashlib.sha256(f"{master}:{episode}".encode()).hexdigest()[:8], 16)


def content_seed(values: bytes) -> int:
    """A window's 63-bit seed from its content."""
    return int.from_bytes(hashlib.blake2b(values, digest_size=8).digest(), "little") >> 1


def tile_seed(seed: Column, wy: Column, wx: Column) -> Column:
    """A tile's 63-bit seed from the field's seed and the low 32 bits of the tile's place."""
    low = lambda c: c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    h = times(seed.cast("long"), TILES[0]).bitwiseXOR(times(low(wy), TILES[1])).bitwiseXOR(times(low(wx), TILES[2]))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 31)).bitwiseAND(F.lit((1 << 63) - 1))


def sigma_schedule(step: Column, n: int, low: float, high: float, rho: float = 7.0) -> Column:
    """Noise level of step 0..n: powers of an even grid in sigma^(1/rho), and 0 at the end."""
    a, b = high ** (1 / rho), low ** (1 / rho)
    return F.when(step >= n, 0.0).otherwise(F.pow(F.lit(a) + step * ((b - a) / max(n - 1, 1)), F.lit(rho)))


def ramp(i: Column, size: int, edge: float = 0.01) -> Column:
    """Blend weight along one axis of a window: from ``edge`` at the borders up to 1 in the middle."""
    middle = (size - 1) / 2
    return F.lit(1.0) - (1 - edge) * F.abs(i - middle) / (middle or 1.0)
