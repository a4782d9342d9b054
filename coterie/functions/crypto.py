"""Additively homomorphic and blind-signature arithmetic, and SM3, as Arrow UDFs.

Big integers travel as hexadecimal strings. Key generation is for demonstration of the protocols; keys
come from the caller in earnest use.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- primes ---


def _probable_prime(n: int, rng: random.Random, rounds: int = 24) -> bool:
    if n < 4:
        return n in (2, 3)
    if n % 2 == 0:
        return False
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for _ in range(rounds):
        x = pow(rng.randrange(2, n - 1), d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def prime(bits: int, rng: random.Random) -> int:
    while True:
        n = rng.getrandbits(bits) | 1 | 1 << (bits - 1) | 1 << (bits - 2)
        if _probable_prime(n, rng):
            return n


def _rng(seed: int | None) -> random.Random:
    return random.SystemRandom() if seed is None else random.Random(seed)


# --- RSA ---


@dataclass(frozen=True)
class RSA:
    n: int
    e: int
    d: int | None = None

    @classmethod
    def generate(cls, bits: int = 1024, e: int = 65537, seed: int | None = None) -> RSA:
        rng = _rng(seed)
        while True:
            p, q = prime(bits // 2, rng), prime(bits // 2, rng)
            phi = (p - 1) * (q - 1)
            if p != q and math.gcd(e, phi) == 1:
                return cls(p * q, e, pow(e, -1, phi))

    @property
    def public(self) -> RSA:
        return RSA(self.n, self.e)

    def encrypt(self, x: int) -> int:
        return pow(x, self.e, self.n)

    def sign(self, x: int) -> int:
        return pow(x, self.d, self.n)

    decrypt = sign


def powmod(column: Column, exponent: int, modulus: int) -> Column:
    """Hex number to hex number, value ** exponent mod modulus."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f"{pow(int(v, 16), exponent, modulus):x}")

    return run(column)


def blind(column: Column, key: RSA, seed: int) -> Column:
    """id (hex) times r ** e, where r is a hash of seed and id: recomputed to unblind, never stored."""
    n, e = key.n, key.e

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{int(v, 16) * pow(factor(v, seed, n), e, n) % n:x}")

    return run(column)


def unblind(column: Column, signed: Column, key: RSA, seed: int) -> Column:
    n = key.n

    @F.pandas_udf("string")
    def run(x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([f"{int(b, 16) * pow(factor(a, seed, n), -1, n) % n:x}" for a, b in zip(x, s, strict=True)])

    return run(column, signed)


def factor(value: str, seed: int, n: int) -> int:
    import hashlib

    out = b"".join(hashlib.sha512(f"{seed}:{k}:{value}".encode()).digest() for k in range(-(-n.bit_length() // 512)))
    return int.from_bytes(out, "big") % (n - 2) + 2


def id_number(column: Column) -> Column:
    """An id as a number of 256 bits, in hex."""
    return F.sha2(column.cast("string"), 256)


# --- Paillier ---


@dataclass(frozen=True)
class Paillier:
    """E(m) = (1 + m n) r^n mod n^2 on integers mod n; the upper half stands for negative numbers. Reals
    are fixed-point numbers with `precision` binary places."""

    n: int
    lam: int | None = None
    precision: int = 30

    @classmethod
    def generate(cls, bits: int = 1024, precision: int = 30, seed: int | None = None) -> Paillier:
        rng = _rng(seed)
        while True:
            p, q = prime(bits // 2, rng), prime(bits // 2, rng)
            if p != q and math.gcd(p * q, (p - 1) * (q - 1)) == 1:
                return cls(p * q, math.lcm(p - 1, q - 1), precision)

    @property
    def public(self) -> Paillier:
        return Paillier(self.n, None, self.precision)

    def encode(self, x: float) -> int:
        return round(x * (1 << self.precision)) % self.n

    def decode(self, m: int, products: int = 0) -> float:
        """products: plain factors that were multiplied in, each with its own binary places."""
        m = m - self.n if m > self.n // 2 else m
        return m / (1 << self.precision * (1 + products))

    def encrypt(self, x: float, rng: random.Random | None = None) -> int:
        r = (rng or random.SystemRandom()).randrange(1, self.n)
        return (1 + self.encode(x) * self.n) * pow(r, self.n, self.n**2) % self.n**2

    def decrypt(self, c: int, products: int = 0) -> float:
        u = pow(c, self.lam, self.n**2)
        return self.decode((u - 1) // self.n * pow(self.lam, -1, self.n) % self.n, products)

    def add(self, a: int, b: int) -> int:
        return a * b % self.n**2

    def times(self, c: int, x: float) -> int:
        return pow(c, self.encode(x), self.n**2)

    def zeros(self, count: int, base: int | None = None) -> list[int]:
        """Encryptions of 0, to refresh quick encodings with. With base, only so many are powers; the others
        are products of two of them."""
        own = [self.encrypt(0.0) for _ in range(min(count, base or count))]
        rng = random.SystemRandom()
        return own + [self.add(rng.choice(own), rng.choice(own)) for _ in range(count - len(own))]


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to a few tasks for each core: a file of some MB is read by one task, which would
    make all ciphers, at milliseconds each, by itself."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


def encrypt_column(column: Column, key: Paillier, zeros: list[int] | None = None) -> Column:
    """Ciphertexts in hex. With zeros, an encoding is refreshed by one of them instead of a power."""
    public = key.public

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        rng, n2 = random.SystemRandom(), public.n**2
        one = (lambda v: (1 + public.encode(v) * public.n) * rng.choice(zeros) % n2) if zeros else public.encrypt
        return x.map(lambda v: None if pd.isna(v) else f"{one(v):x}")

    return run(column)


def decrypt_column(column: Column, key: Paillier, products: int = 0) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else key.decrypt(int(v, 16), products))

    return run(column)


def times_column(column: Column, plain: Column, key: Paillier) -> Column:
    public = key.public

    @F.pandas_udf("string")
    def run(c: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([f"{public.times(int(a, 16), float(b)):x}" for a, b in zip(c, x, strict=True)])

    return run(column, plain)


def cipher_minus(a: Column, b: Column, key: Paillier) -> Column:
    """Hex cipher of the difference: a times the inverse of b."""
    n2 = key.n**2

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else f"{int(u, 16) * pow(int(v, 16), -1, n2) % n2:x}" for u, v in zip(x, y, strict=True)])

    return run(a, b)


def cipher_sum(df: DataFrame, keys: list[str], column: str, key: Paillier) -> DataFrame:
    """(keys, column): the encrypted sum per group. Products are made within each partition first, so a
    group of any size reaches its last task as one number per partition."""
    n2, names = key.n**2, [*keys, column]

    def partial(batches):
        held: dict = {}
        for b in batches:
            for row in b[names].itertuples(index=False, name=None):
                held[row[:-1]] = held.get(row[:-1], 1) * int(row[-1], 16) % n2
        rows = [(*k, f"{v:x}") for k, v in held.items()]
        yield pd.DataFrame(rows, columns=names)

    @F.pandas_udf("string")
    def product(x: pd.Series) -> str:
        out = 1
        for v in x:
            out = out * int(v, 16) % n2
        return f"{out:x}"

    own = df.select(*names)
    return own.mapInPandas(partial, own.schema).groupBy(*keys).agg(product(column).alias(column))


def exponent_encode(column: Column, precision: float = 0.001) -> Column:
    """struct(mantissa, exponent) with value = mantissa * 2 ** exponent: the exponent is the largest at which
    a step of the mantissa is no more than `precision`, and grows where the mantissa would pass 2 ** 53."""
    low = math.floor(math.log2(precision))
    wide = F.greatest(F.lit(low), F.ceil(F.log2(F.greatest(F.abs(column), F.lit(1e-300)))) - 53).cast("int")
    mantissa = F.round(column / F.pow(F.lit(2.0), wide)).cast("long")
    return F.struct(mantissa.alias("mantissa"), wide.alias("exponent"))


def exponent_decode(encoded: Column) -> Column:
    return encoded["mantissa"] * F.pow(F.lit(2.0), encoded["exponent"])


def cipher_matmul(df: DataFrame, cipher: str, features: list[str], key: Paillier, keys: list[str] | None = None) -> DataFrame:
    """([keys,] feature, product): for each plain feature, the encrypted sum over rows of x times the cipher
    column, that is one row of X' E(v). Rows are multiplied where they lie and summed as cipher_sum does."""
    keys = keys or []
    long = df.select(*keys, cipher, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([*keys, cipher], features, "feature", "x")
    products = long.withColumn("product", times_column(F.col(cipher), F.col("x"), key))
    return cipher_sum(products, [*keys, "feature"], "product", key)


def dot_encrypted(values: Column, weights: list[int], key: Paillier) -> Column:
    """Hex cipher of the dot product of a plain array column with encrypted weights: what a party computes
    for the layer of another one."""
    public, n2 = key.public, key.n**2

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(row) -> str:
            out = 1
            for a, w in zip(row, weights, strict=True):
                out = out * public.times(w, float(a)) % n2
            return f"{out:x}"

        return x.map(one)

    return run(values)


#: Bits of one packed number: the places of a sum, with room for the sign and 2 ** 16 rows at 2 ** 40 each.
PACKED_BITS = 96


def packed_bits(rows: int, largest: float, key: Paillier) -> int:
    """Bits that a packed sum of so many numbers, none over `largest`, takes with its sign."""
    return max(1, math.ceil(math.log2(max(rows, 1) * max(largest, 1e-9) * 2**key.precision + 1))) + 2


def capacity(key: Paillier, bits: int) -> int:
    """How many packed numbers of so many bits a plaintext holds; an error if none fits."""
    if (room := (key.n.bit_length() - 2) // bits) < 1:
        raise ValueError(f"a key of {key.n.bit_length()} bits has no room for {bits} bits")
    return room


def pack_ciphers(df: DataFrame, keys: list[str], slot: Column, column: str, key: Paillier, bits: int) -> DataFrame:
    """(keys, column): the ciphers of a group in one, each moved up by its slot times bits. A group has one
    row for a slot and no more slots than the key's capacity."""
    n2 = key.n**2

    @F.pandas_udf("string")
    def run(slots: pd.Series, ciphers: pd.Series) -> pd.Series:
        def one(places, values) -> str:
            out = 1
            for k, v in zip(places, values, strict=True):
                out = out * pow(int(v, 16), 1 << bits * int(k), n2) % n2
            return f"{out:x}"

        return pd.Series([one(a, b) for a, b in zip(slots, ciphers, strict=True)])

    held = df.select(*keys, F.struct(slot.cast("int").alias("slot"), F.col(column).alias("c")).alias("_x")).groupBy(*keys).agg(F.collect_list("_x").alias("_x"))
    return held.select(*keys, run(F.col("_x.slot"), F.col("_x.c")).alias(column))


def encrypt_packed(columns: list[Column], key: Paillier, zeros: list[int], bits: int = PACKED_BITS) -> Column:
    """Several reals in one plaintext, `bits` apart, so that one sum over ciphers adds them all."""
    capacity(key, bits * len(columns))
    public = key.public

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        rng, n2 = random.SystemRandom(), public.n**2

        def one(row) -> str:
            m = sum(round(v * (1 << public.precision)) << bits * k for k, v in enumerate(row)) % public.n
            return f"{(1 + m * public.n) * rng.choice(zeros) % n2:x}"

        return x.map(one)

    return run(F.array(*[c.cast("double") for c in columns]))


def decrypt_packed(column: Column, key: Paillier, count: int, bits: int = PACKED_BITS) -> Column:
    """The packed reals as an array."""
    half, whole = 1 << bits - 1, 1 << bits

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        def one(v: str) -> list[float]:
            u = pow(int(v, 16), key.lam, key.n**2)
            m = (u - 1) // key.n * pow(key.lam, -1, key.n) % key.n
            m = m - key.n if m > key.n // 2 else m
            out = []
            for _ in range(count):
                low = (m + half) % whole - half
                out.append(low / (1 << key.precision))
                m = (m - low) >> bits
            return out

        return x.map(one)

    return run(column)


def system(name: str, bits: int = 1024, seed: int | None = None, zeros: int = 64):
    """(encrypt, sum, decrypt) of a system by name: plain, paillier or fast_paillier. encrypt takes a column,
    sum (df, keys, column), decrypt a column of sums."""
    if name == "plain":
        return (lambda c: c), (lambda df, keys, c: df.groupBy(*keys).agg(F.sum(c).alias(c))), (lambda c: c)
    if name not in ("paillier", "fast_paillier"):
        raise ValueError(f"no system named {name}")
    key = Paillier.generate(bits, seed=seed)
    quick = key.zeros(zeros, base=8) if name == "fast_paillier" else None
    return (lambda c: encrypt_column(c, key, quick)), (lambda df, keys, c: cipher_sum(df, keys, c, key)), (lambda c: decrypt_column(c, key))


# --- SM3 (GB/T 32905-2016) ---

_SM3_START = (0x7380166F, 0x4914B2B9, 0x172442D7, 0xDA8A0600, 0xA96F30BC, 0x163138AA, 0xE38DEE4D, 0xB0FB0E4E)


def _rol(x: np.ndarray, k: int) -> np.ndarray:
    k %= 32
    return (x << np.uint32(k)) | (x >> np.uint32(32 - k)) if k else x


def _sm3_block(v: list[np.ndarray], block: np.ndarray) -> list[np.ndarray]:
    """The state after one block of 16 words each; all messages of a batch move together."""
    w = list(block)
    for j in range(16, 68):
        x = w[j - 16] ^ w[j - 9] ^ _rol(w[j - 3], 15)
        w.append(x ^ _rol(x, 15) ^ _rol(x, 23) ^ _rol(w[j - 13], 7) ^ w[j - 6])
    a, b, c, d, e, f, g, h = v
    for j in range(64):
        t = np.array([0x79CC4519 if j < 16 else 0x7A879D8A], np.uint32)
        s1 = _rol(_rol(a, 12) + e + _rol(t, j), 7)
        s2 = s1 ^ _rol(a, 12)
        ff = a ^ b ^ c if j < 16 else (a & b) | (a & c) | (b & c)
        gg = e ^ f ^ g if j < 16 else (e & f) | (~e & g)
        t1 = ff + d + s2 + (w[j] ^ w[j + 4])
        t2 = gg + h + s1 + w[j]
        a, b, c, d, e, f, g, h = t1, a, _rol(b, 9), c, t2 ^ _rol(t2, 9) ^ _rol(t2, 17), e, _rol(f, 19), g
    return [x ^ y for x, y in zip(v, (a, b, c, d, e, f, g, h), strict=True)]


def sm3_many(messages: list[bytes]) -> list[str]:
    """The SM3 digests in hex, by the published standard; messages of equal numbers of blocks go together."""
    padded = [m + b"\x80" + b"\x00" * ((55 - len(m)) % 64) + (8 * len(m)).to_bytes(8, "big") for m in messages]
    out, by_size = [""] * len(messages), {}
    for i, m in enumerate(padded):
        by_size.setdefault(len(m), []).append(i)
    for size, own in by_size.items():
        words = np.frombuffer(b"".join(padded[i] for i in own), ">u4").astype(np.uint32).reshape(len(own), size // 64, 16)
        v = [np.full(len(own), x, np.uint32) for x in _SM3_START]
        for k in range(size // 64):
            v = _sm3_block(v, words[:, k].T)
        digests = np.stack(v, 1).astype(">u4").tobytes()
        for at, i in enumerate(own):
            out[i] = digests[32 * at : 32 * at + 32].hex()
    return out


def sm3(data: bytes) -> str:
    return sm3_many([data])[0]


def sm3_hex(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        known = x.notna()
        out = pd.Series([None] * len(x), dtype=object)
        out[known.to_numpy()] = sm3_many([v.encode() for v in x[known]])
        return out

    return run(column)
