"""Hashes, ciphers and URI work that have no column form, as Arrow-batched functions over whole columns."""

from __future__ import annotations

import ipaddress
import posixpath
import zlib
from urllib.parse import urljoin, urlsplit, urlunsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

M32, M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & M32


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86_32."""
    h, n = seed, len(data) & ~3
    for k in np.frombuffer(data[:n], "<u4").tolist():
        h ^= _rotl(k * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
        h = (_rotl(h, 13) * 5 + 0xE6546B64) & M32
    if len(data) > n:
        h ^= _rotl(int.from_bytes(data[n:], "little") * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & M32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & M32
    return h ^ (h >> 16)


def murmur2_64(data: bytes, seed: int = 0) -> int:
    """MurmurHash2 64A."""
    m = 0xC6A4A7935BD1E995
    h, n = (seed ^ (len(data) * m)) & M64, len(data) & ~7
    for k in np.frombuffer(data[:n], "<u8").tolist():
        k = k * m & M64
        h = (h ^ ((k ^ (k >> 47)) * m & M64)) * m & M64
    if len(data) > n:
        h = (h ^ int.from_bytes(data[n:], "little")) * m & M64
    h = (h ^ (h >> 47)) * m & M64
    return h ^ (h >> 47)


def crc_mix(data: bytes, seed: int = 0) -> int:
    """CRC-32 from ``seed`` without the inversions, then a 32-bit mix by shifts."""
    x = zlib.crc32(data, seed ^ M32) ^ M32
    x = (x + (x << 12)) & M32
    x ^= x >> 22
    x = (x + (x << 4)) & M32
    x ^= x >> 9
    x = (x + (x << 10)) & M32
    x ^= x >> 2
    x = (x + (x << 7)) & M32
    return x ^ (x >> 12)


def crc_mix_col(text: Column) -> Column:
    """``crc_mix`` of a string column from seed 0, in built-in functions.

    A CRC is linear: without the inversions it is the plain one xor that of as many zero bytes.
    """
    zeros = F.encode(F.repeat(F.lit("\x00"), F.octet_length(text)), "UTF-8")
    x = F.crc32(F.encode(text, "UTF-8")).bitwiseXOR(F.crc32(zeros))
    for left, right in ((12, 22), (4, 9), (10, 2), (7, 12)):
        x = (x + F.shiftleft(x, left)).bitwiseAND(M32)
        x = x.bitwiseXOR(F.shiftright(x, right))
    return x


def murmur3_x64_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 x64_128 as two unsigned 64-bit halves."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & M64
    one = lambda k: rot(k * c1 & M64, 31) * c2 & M64
    two = lambda k: rot(k * c2 & M64, 33) * c1 & M64
    h1 = h2 = seed
    n = len(data) & ~15
    cells = np.frombuffer(data[:n], "<u8").tolist()
    for k1, k2 in zip(cells[::2], cells[1::2]):
        h1 = (((rot(h1 ^ one(k1), 27) + h2) & M64) * 5 + 0x52DCE729) & M64
        h2 = (((rot(h2 ^ two(k2), 31) + h1) & M64) * 5 + 0x38495AB5) & M64
    tail = data[n:]
    if len(tail) > 8:
        h2 ^= two(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= one(int.from_bytes(tail[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & M64
    h2 = (h2 + h1) & M64

    def last(h: int) -> int:
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & M64
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & M64
        return h ^ (h >> 33)

    h1, h2 = last(h1), last(h2)
    h1 = (h1 + h2) & M64
    return h1, (h2 + h1) & M64


#: Fixed values of MurmurHash3 x86_128: multipliers, rotations of a block's words, rotations and addends of the state.
_M128_C = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
_M128_K = (15, 16, 17, 18)
_M128_H = ((19, 0x561CCD1B), (17, 0x0BCAA747), (15, 0x96CD1C35), (13, 0x32AC3B17))


def murmur3_x86_128(data: bytes, seed: int = 0) -> tuple[int, int, int, int]:
    """MurmurHash3 x86_128 as four unsigned 32-bit words."""
    h = [seed] * 4

    def word(i: int, k: int) -> int:
        return _rotl(k * _M128_C[i] & M32, _M128_K[i]) * _M128_C[(i + 1) % 4] & M32

    n = len(data) & ~15
    for j, k in enumerate(np.frombuffer(data[:n], "<u4").tolist()):
        i = j % 4
        turn, add = _M128_H[i]
        h[i] = ((_rotl(h[i] ^ word(i, k), turn) + h[(i + 1) % 4]) * 5 + add) & M32
    for i in range(4):
        h[i] ^= word(i, int.from_bytes(data[n + 4 * i : n + 4 * i + 4], "little"))

    def spread() -> None:
        h[0] = sum(h) & M32
        h[1:] = [(x + h[0]) & M32 for x in h[1:]]

    def last(x: int) -> int:
        x = (x ^ (x >> 16)) * 0x85EBCA6B & M32
        x = (x ^ (x >> 13)) * 0xC2B2AE35 & M32
        return x ^ (x >> 16)

    h = [x ^ len(data) for x in h]
    spread()
    h = [last(x) for x in h]
    spread()
    return tuple(h)


def random_sequence(seed: int, n: int) -> list[int]:
    """The minimal standard generator: x -> 16807 * x mod 2**31 - 1."""
    out, x = [], seed
    for _ in range(n):
        x = x * 16807 % (2**31 - 1)
        out.append(x)
    return out


def random_step(x: Column) -> Column:
    """The next number of the minimal standard generator."""
    return x * 16807 % (2**31 - 1)


def crc_step(crc: Column, byte: Column) -> Column:
    """One byte into the register of CRC-32 (a long, without the inversions)."""
    x = crc.bitwiseXOR(byte)
    for _ in range(8):
        x = F.shiftright(x, 1).bitwiseXOR(x.bitwiseAND(1) * 0xEDB88320)
    return x


#: Fixed value: the first bytes of an encrypted file.
ENCRYPTED = b"VimCrypt~01!"


class ZipCipher:
    """The traditional stream cipher of zip archives; it keeps its state from call to call."""

    def __init__(self, password: bytes):
        self.keys = [0x12345678, 0x23456789, 0x34567890]
        for b in password:
            self._advance(b)

    def _advance(self, byte: int) -> None:
        k = self.keys
        k[0] = _crc_step(k[0], byte)
        k[1] = ((k[1] + (k[0] & 0xFF)) * 134775813 + 1) & M32
        k[2] = _crc_step(k[2], k[1] >> 24)

    def _mask(self) -> int:
        t = (self.keys[2] | 2) & 0xFFFF
        return (t * (t ^ 1) >> 8) & 0xFF

    def encrypt(self, data: bytes) -> bytes:
        out = bytearray()
        for b in data:
            out.append(b ^ self._mask())
            self._advance(b)
        return bytes(out)

    def decrypt(self, data: bytes) -> bytes:
        out = bytearray()
        for b in data:
            out.append(b ^ self._mask())
            self._advance(out[-1])
        return bytes(out)


def _crc_step(crc: int, byte: int) -> int:
    return zlib.crc32(bytes([byte]), crc ^ M32) ^ M32


@pandas_udf(T.StringType())
def ip6_text_col(data: pd.Series) -> pd.Series:
    """Sixteen bytes as IPv6 text, the longest run of zero groups as ::."""
    return data.map(lambda d: None if d is None or len(d) != 16 else str(ipaddress.IPv6Address(bytes(d))))


def xor_bytes(data: bytes, key: bytes, start: int = 0) -> bytes:
    """XOR with a key that is repeated, from its ``start``-th byte on."""
    if not key or not data:
        return data
    k = np.frombuffer(key, np.uint8)
    return (np.frombuffer(data, np.uint8) ^ k[(np.arange(len(data)) + start) % len(key)]).tobytes()


def _by_length(values: list[bytes | None]):
    """(places, bytes as a matrix) of the values of each length: a hash of all of them takes one step a word."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            places.setdefault(len(v), []).append(i)
    for n, at in places.items():
        yield at, np.frombuffer(b"".join(values[i] for i in at), np.uint8).reshape(len(at), n)


def _words(cells: np.ndarray, size: int) -> np.ndarray:
    """Little-endian words of ``size`` bytes, the last one filled with zeros."""
    short = -cells.shape[1] % size
    return np.ascontiguousarray(np.pad(cells, ((0, 0), (0, short)))).view(f"<u{size}")


def murmur3_32_many(values: list[bytes | None], seed: int = 0) -> list[int | None]:
    """``murmur3_32`` of many values at once."""
    out: list[int | None] = [None] * len(values)
    u = np.uint32
    for at, cells in _by_length(values):
        n, words = cells.shape[1], _words(cells, 4)
        h = np.full(len(at), seed, u)
        for j in range(words.shape[1]):
            k = words[:, j] * u(0xCC9E2D51)
            h ^= (k << u(15) | k >> u(17)) * u(0x1B873593)
            if 4 * j + 4 <= n:
                h = (h << u(13) | h >> u(19)) * u(5) + u(0xE6546B64)
        h ^= u(n & M32)
        h = (h ^ h >> u(16)) * u(0x85EBCA6B)
        h = (h ^ h >> u(13)) * u(0xC2B2AE35)
        for i, x in zip(at, (h ^ h >> u(16)).tolist()):
            out[i] = x
    return out


def murmur2_64_many(values: list[bytes | None], seed: int = 0) -> list[int | None]:
    """``murmur2_64`` of many values at once."""
    out: list[int | None] = [None] * len(values)
    u, m = np.uint64, np.uint64(0xC6A4A7935BD1E995)
    for at, cells in _by_length(values):
        n, words = cells.shape[1], _words(cells, 8)
        h = np.full(len(at), (seed ^ n * int(m)) & M64, u)
        for j in range(words.shape[1]):
            k = words[:, j]
            if 8 * j + 8 <= n:
                k = k * m
                k = (k ^ k >> u(47)) * m
            h = (h ^ k) * m
        h = (h ^ h >> u(47)) * m
        for i, x in zip(at, (h ^ h >> u(47)).tolist()):
            out[i] = x
    return out


@pandas_udf(T.LongType())
def murmur3_32_col(s: pd.Series) -> pd.Series:
    return pd.Series(murmur3_32_many([None if x is None else x.encode() for x in s]), dtype=object)


@pandas_udf(T.StringType())
def murmur2_64_col(s: pd.Series) -> pd.Series:
    """As a decimal string: unsigned 64 bits do not fit a long."""
    return pd.Series([None if h is None else str(h) for h in murmur2_64_many([None if x is None else x.encode() for x in s])], dtype=object)


def zip_cipher_many(values: list[bytes | None], passwords: list[str | None], decrypt: bool) -> list[bytes | None]:
    """Each value under the ``ZipCipher`` of its password, all values of a length a byte at a time."""
    out: list[bytes | None] = [None] * len(values)
    table = np.array([_crc_step(0, b) for b in range(256)], np.uint32)
    u = np.uint32
    start = {p: ZipCipher(p.encode()).keys for p in set(passwords) if p is not None}
    for at, cells in _by_length([v if p is not None else None for v, p in zip(values, passwords)]):
        k0, k1, k2 = (np.array([start[passwords[i]][j] for i in at], u) for j in range(3))
        done = np.empty_like(cells)
        for j in range(cells.shape[1]):
            t = (k2 | u(2)) & u(0xFFFF)
            done[:, j] = cells[:, j] ^ (t * (t ^ u(1)) >> u(8)).astype(np.uint8)
            plain = (done if decrypt else cells)[:, j]
            k0 = table[(k0 ^ plain) & u(255)] ^ k0 >> u(8)
            k1 = (k1 + (k0 & u(255))) * u(134775813) + u(1)
            k2 = table[(k2 ^ k1 >> u(24)) & u(255)] ^ k2 >> u(8)
        for i, row in zip(at, done):
            out[i] = row.tobytes()
    return out


@pandas_udf(T.BinaryType())
def encrypt_col(data: pd.Series, password: pd.Series) -> pd.Series:
    """Values as the traditional zip cipher encrypts them; null data or a null password gives null."""
    return pd.Series(zip_cipher_many([None if d is None else bytes(d) for d in data], list(password), False), dtype=object)


@pandas_udf(T.BinaryType())
def decrypt_col(data: pd.Series, password: pd.Series) -> pd.Series:
    return pd.Series(zip_cipher_many([None if d is None else bytes(d) for d in data], list(password), True), dtype=object)


@pandas_udf(T.BinaryType())
def encrypted_file_col(content: pd.Series, password: pd.Series) -> pd.Series:
    """The bytes of an encrypted file with the content: the magic and the content under the cipher."""
    hidden = zip_cipher_many([None if d is None else bytes(d) for d in content], list(password), False)
    return pd.Series([None if h is None else ENCRYPTED + h for h in hidden], dtype=object)


@pandas_udf(T.BinaryType())
def decrypted_file_col(content: pd.Series, password: pd.Series) -> pd.Series:
    """The content of an encrypted file; null where the magic is missing."""
    own = [bytes(d)[len(ENCRYPTED) :] if d is not None and bytes(d).startswith(ENCRYPTED) else None for d in content]
    return pd.Series(zip_cipher_many(own, list(password), True), dtype=object)


def floating_bytes(value: Column, n: int, big: bool = True) -> Column:
    """A number as 4 or 8 bytes of IEEE 754 (rounded to the nearest; beyond its range infinite)."""
    if n not in (4, 8):
        raise ValueError("a floating-point number has 4 or 8 bytes")
    kind = f"{'>' if big else '<'}f{n}"

    @pandas_udf(T.BinaryType())
    def put(column: pd.Series, known: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            raw = column.to_numpy(np.float64, na_value=np.nan).astype(kind).tobytes()
        return pd.Series([raw[i * n : i * n + n] if k else None for i, k in enumerate(known)], dtype=object)

    return put(value.cast("double"), value.isNotNull())


@pandas_udf(T.BinaryType())
def xor_col(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or k is None else xor_bytes(bytes(d), k.encode()) for d, k in zip(data, key)])


def normal_uri(url: str) -> str:
    """Scheme and host in lower case, dot segments resolved."""
    u = urlsplit(url)
    path = u.path
    if path.startswith("/"):
        slash = "/" if path.endswith(("/", "/.", "/..")) and path != "/" else ""
        path = posixpath.normpath(path).replace("//", "/") + slash
        path = path.replace("//", "/")
    return urlunsplit((u.scheme.lower(), u.netloc.lower() if "@" not in u.netloc else u.netloc, path, u.query, u.fragment))


@pandas_udf(T.StringType())
def uri_resolve_col(base: pd.Series, relative: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or r is None else normal_uri(urljoin(b, r)) for b, r in zip(base, relative)])


@pandas_udf(T.BinaryType())
def gzip_col(data: pd.Series) -> pd.Series:
    def one(d):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(bytes(d)) + c.flush()

    return data.map(lambda d: None if d is None else one(d))


def inflate(data: bytes, encoding: str) -> bytes:
    """Undo a comma list of content encodings, last first: gzip, deflate (zlib or raw), identity."""
    for name in reversed([e.strip().lower() for e in encoding.split(",") if e.strip()]):
        if name in ("gzip", "x-gzip"):
            data = zlib.decompress(data, 47)
        elif name == "deflate":
            try:
                data = zlib.decompress(data)
            except zlib.error:
                data = zlib.decompress(data, -15)
        elif name not in ("identity", "chunked"):
            raise ValueError(f"content encoding {name}")
    return data


def _inflated(data: bytes | None, encoding: str | None) -> bytes | None:
    try:
        return None if data is None else inflate(bytes(data), encoding or "")
    except (ValueError, zlib.error):
        return None


@pandas_udf(T.BinaryType())
def inflate_col(data: pd.Series, encoding: pd.Series) -> pd.Series:
    """``inflate`` by row; null where the encoding is unknown or the data are broken, so that one row fails no job."""
    return pd.Series([_inflated(d, e) for d, e in zip(data, encoding)], dtype=object)
