"""String, number, time and address functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"


def tokens(s: Column, delimiters: str) -> Column:
    """Non-empty tokens between any of the delimiters."""
    mark = delimiters[0]
    return F.filter(F.split(F.translate(s, delimiters, mark * len(delimiters)), "[" + _in_class(mark) + "]"), lambda x: x != "")


def arguments(s: Column) -> Column:
    """The arguments of a command line, apart by blanks and tabs; null if there are none."""
    found = tokens(s, " \t")
    return F.when(F.size(found) > 0, found)


def packed_arguments(data: Column) -> Column:
    """The arguments of a command in binary form: their number (four bytes, little-endian), then texts that end at a NUL; null
    if there are fewer than the number says."""
    octet = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long")
    count = (octet(0) + octet(1) * 256 + octet(2) * 65536 + octet(3) * 16777216).try_cast("int")
    parts = F.split(F.substring(data, 5, 2**31 - 1).cast("string"), "\x00", -1)
    whole = (F.size(parts) > count) | ((F.size(parts) == count) & (F.element_at(parts, -1) != ""))
    return F.when((F.octet_length(data) > 4) & (count > 0) & whole, F.slice(parts, 1, count))


def type_name(column: Column) -> Column:
    """The name of a column's type, on every row."""
    return F.typeof(column)


def _in_class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in chars)


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def lower_ascii(s: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_bytes(s: Column) -> Column:
    """The bytes of hexadecimal text; null for an odd number of digits or another character."""
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))


def first_of_set(s: Column, chars: str) -> Column:
    """Position (from 0) of the first character of a set, or the length if there is none."""
    at = F.regexp_instr(s, F.lit("[" + _in_class(chars) + "]"))
    return F.when(at == 0, F.length(s)).otherwise(at - 1)


def last_of_set(s: Column, chars: str) -> Column:
    """Position of the last character of a set, or -1."""
    at = F.regexp_instr(F.reverse(s), F.lit("[" + _in_class(chars) + "]"))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(s) - at)


def replace_set(s: Column, chars: str, by: str) -> Column:
    return F.translate(s, chars, by * len(chars))


#: The factor of each suffix.
SUFFIXES = {"k": 1000, "K": 1024, "m": 1000000, "M": 1048576, "g": 1000000000, "G": 1073741824, "s": 1, "S": 1, "t": 60, "T": 60, "h": 3600, "H": 3600, "d": 86400, "w": 604800}


def cast_suffix(s: Column) -> Column:
    """Integer with base (0x.., 0..) and an optional factor suffix, as a long; null where it is malformed."""
    shape = r"^([+-]?)(0[xX][0-9a-fA-F]+?|0[0-7]*|[1-9][0-9]*)([kKmMgGsStThHdw]?)$"
    sign, digits, suffix = (F.regexp_extract(s, shape, i) for i in (1, 2, 3))
    number = (
        F.when(F.lower(digits).startswith("0x"), F.conv(F.substring(digits, 3, 64), 16, 10))
        .when(digits.startswith("0") & (F.length(digits) > 1), F.conv(digits, 8, 10))
        .otherwise(digits)
    ).try_cast("long")
    factor = F.lit(1).cast("long")
    for k, v in SUFFIXES.items():
        factor = F.when(suffix == k, F.lit(v).cast("long")).otherwise(factor)
    return F.when(digits != "", number * factor * F.when(sign == "-", F.lit(-1)).otherwise(F.lit(1)))


def cast_suffix_float(s: Column) -> Column:
    """A decimal number, with or without exponent, and an optional factor suffix, as a double; null where it is malformed."""
    shape = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)([kKmMgGsStThHdw]?)$"
    number, suffix = F.regexp_extract(s, shape, 1), F.regexp_extract(s, shape, 2)
    factor = F.lit(1.0)
    for k, v in SUFFIXES.items():
        factor = F.when(suffix == k, F.lit(float(v))).otherwise(factor)
    return F.when(number != "", number.try_cast("double") * factor)


def mobile_at(s: Column) -> Column:
    """Position (from 0) of the first mobile number of eleven digits, or -1."""
    return F.regexp_instr(s, F.lit(r"(?:(?<![0-9])|(?<=(?<![0-9])86))1[345789][0-9]{9}(?![0-9])")) - 1


def format_time(ms: Column, pattern: str) -> Column:
    """strftime patterns (Y m d H M S j) over milliseconds since the epoch, in the session's time zone."""
    java = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            if pattern[i + 1] not in java:
                raise ValueError(f"time pattern %{pattern[i + 1]}")
            out += java[pattern[i + 1]]
            i += 2
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]
            i += 1
    return F.date_format(F.timestamp_millis(ms), out)


def ip_number(s: Column) -> Column:
    """Dotted IPv4 as a long; null unless it has four parts of 0 to 255."""
    part = F.split(s, r"\.")
    cell = [F.get(part, F.lit(i)).try_cast("long") for i in range(4)]
    good = s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    for c in cell:
        good = good & (c <= 255)
    return F.when(good, ((cell[0] * 256 + cell[1]) * 256 + cell[2]) * 256 + cell[3])


def ip_text(n: Column) -> Column:
    """A long as dotted IPv4."""
    return F.concat_ws(".", *[(F.shiftright(n, k).bitwiseAND(F.lit(255))).cast("string") for k in (24, 16, 8, 0)])


def option_map(s: Column) -> Column:
    """``a=1,b&c=2`` as a map; an option without a value is "1"."""
    parts = F.filter(F.split(s, "[, &]+"), lambda x: x != "")
    return F.map_from_arrays(
        F.transform(parts, lambda p: F.substring_index(p, "=", 1)),
        F.transform(parts, lambda p: F.when(F.instr(p, "=") > 0, F.regexp_extract(p, "=(.*)$", 1)).otherwise(F.lit("1"))),
    )


def unsigned_be(data: Column, offset: int, n: int) -> Column:
    """n bytes of a binary column, big-endian, from an offset (0-based), as a long."""
    return F.conv(F.hex(F.substring(data, offset + 1, n)), 16, 10).cast("long")


def unsigned_le(data: Column, offset: int, n: int) -> Column:
    total = F.lit(0).cast("long")
    for i in range(n):
        total = total + F.shiftleft(unsigned_be(data, offset + i, 1), 8 * i)
    return total


def signed(data: Column, offset: int, n: int, big: bool = True) -> Column:
    """n bytes (1, 2, 4 or 8) as a signed number; null where the data end before."""
    read = unsigned_be if big else unsigned_le
    if n == 8:
        high, low = (0, 4) if big else (4, 0)
        value = F.shiftleft(read(data, offset + high, 4), 32).bitwiseOR(read(data, offset + low, 4))
    else:
        value = read(data, offset, n)
        value = value - F.when(value >= 1 << (8 * n - 1), F.lit(1 << (8 * n))).otherwise(F.lit(0))
    return F.when(F.octet_length(data) >= offset + n, value)


def floating(data: Column, offset: int, n: int, big: bool = True) -> Column:
    """n bytes (4 or 8) as an IEEE 754 number, as a double; null where the data end before."""
    digits, bits, top = (23, 127, 0xFF) if n == 4 else (52, 1023, 0x7FF)
    raw = signed(data, offset, n, big)
    mantissa = raw.bitwiseAND(F.lit((1 << digits) - 1)).cast("double")
    exponent = F.shiftright(raw, digits).bitwiseAND(F.lit(top))
    sign = F.when(raw < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    size = (
        F.when(exponent == top, F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, mantissa * F.lit(2.0 ** (1 - bits - digits)))
        .otherwise((mantissa / F.lit(2.0**digits) + 1.0) * F.pow(F.lit(2.0), exponent - bits))
    )
    return sign * size


def sized_bytes(data: Column, offset: int, n: int, big: bool = True) -> Column:
    """The bytes behind a length of n bytes; null where the data end before they do."""
    size = (unsigned_be if big else unsigned_le)(data, offset, n)
    return F.when((F.octet_length(data) >= offset + n) & (F.octet_length(data) >= offset + n + size), F.substr(data, F.lit(offset + n + 1), size.cast("int")))


def number_bytes(value: Column, n: int, big: bool = True) -> Column:
    """The low n bytes of a whole number, negative ones as two's complement."""
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n))
    if not big:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.unhex(digits)


def _resolved(path: Column) -> Column:
    """A path from the root without its dot segments; others as they are."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a).when(s == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s))),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.startswith("/"), F.array_join(F.when(folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")).otherwise(path)


def uri_struct(s: Column) -> Column:
    """scheme, user_info, host, port, path (dot segments resolved), query, fragment of a URL; missing parts are null."""
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:([^/?#@]*)@)?([^/?#:]*)(?::([0-9]+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

    def part(i: int) -> Column:
        got = F.regexp_extract(s, whole, i)
        return F.when(got != "", got)

    return F.struct(
        F.lower(part(1)).alias("scheme"), part(2).alias("user_info"), F.lower(part(3)).alias("host"), part(4).cast("int").alias("port"),
        _resolved(part(5)).alias("path"), part(6).alias("query"), part(7).alias("fragment"),
    )
