"""Mode S frames as column expressions: parity, addresses, messages, registers.

A frame is upper-case hexadecimal text of 14 or 28 digits. Everything is integer arithmetic on longs; no Python runs
on the rows. Parity and the larger messages are lambdas, which keeps generated code below the size that compiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .refdata import FRAME_BITS

GENERATOR = 0x1FFF409  # Fixed value: the parity polynomial with its leading term.
CHARSET = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ##### ###############0123456789######"  # Fixed value: characters of callsigns.
EXPLICIT = (11, 17, 18)  # formats that carry their address in clear
PARITY_ADDRESSED = (0, 4, 5, 16, 20, 21)


def number(hex_: Column) -> Column:
    return F.conv(hex_, 16, 10).cast("long")


def _table(values: list[int]) -> Column:
    """A literal array, parsed at once instead of put together value by value."""
    return F.expr(f"array({', '.join(map(str, values))})")


def _remainders(n: int) -> list[int]:
    """What each of n data bits, last first, leaves after division by the generator."""
    out, r = [], GENERATOR & 0xFFFFFF
    for _ in range(n):
        out.append(r)
        r <<= 1
        if r >> 24:
            r ^= GENERATOR
    return out


def _of_digits(n: int) -> list[list[int]]:
    """What each value of each of n data digits leaves, last digit first, from the polynomial."""
    left = _remainders(4 * n)
    return [[reduce(lambda x, bit: x ^ (left[4 * k + bit] if digit >> bit & 1 else 0), range(4), 0) for digit in range(16)] for k in range(n)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` as a lambda: computed once a row, and kept out of the generated code, which has a size limit."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _remainder(high: Column, low: Column) -> Column:
    """The remainder of 22 data digits, the last 10 in ``low``: division is linear, so each digit has its share, one look-up in a table of 16.

    The last digit's is a lambda: its projection then isn't generated as one method, too large to be compiled, but as small ones.
    """
    digit = lambda value, k: F.shiftright(value, 4 * k).bitwiseAND(F.lit(15)).cast("int")
    at = [digit(low, k) for k in range(10)] + [digit(high, k) for k in range(12)]
    last, *others = zip(map(_table, _of_digits(22)), at)
    shares = [_let(last[1], lambda d: F.get(last[0], d)), *(F.get(t, d) for t, d in others)]
    return reduce(lambda a, b: a.bitwiseXOR(b), shares).cast("long")


def with_data_crc(rows: DataFrame, hex_: str, name: str, parity_digits: int = 0) -> DataFrame:
    """Adds the remainder of the data part, 22 or 8 digits without those of the parity behind; null for other lengths.

    A short frame is a long one with zeros before it. The numbers are columns of their own, so that each is read once a row.
    """
    size = F.length(hex_) - parity_digits
    high = F.when(size == 22, number(F.substring(hex_, 1, 12))).when(size == 8, F.lit(0).cast("long"))
    low = number(F.when(size == 22, F.substring(hex_, 13, 10)).otherwise(F.substring(hex_, 1, 8)))
    return rows.withColumns({"__high": high, "__low": low}).withColumn(name, _remainder(F.col("__high"), F.col("__low"))).drop("__high", "__low")


def downlink_format(hex_: Column) -> Column:
    return F.shiftright(number(F.substring(hex_, 1, 2)), 3).cast("int")


def bits(value: Column, start: int, width: int, total: int = 56) -> Column:
    """Bits start .. start + width - 1 of a field of so many bits, counted from 1 at the left."""
    return F.shiftright(value, total - start - width + 1).bitwiseAND(F.lit((1 << width) - 1))


def signed(value: Column, width: int) -> Column:
    return F.when(value >= 1 << (width - 1), value - (1 << width)).otherwise(value)


def flips(spark: SparkSession) -> DataFrame:
    """(syndrome, flip_a, flip_b, flip_p): all patterns of one and two wrong bits in a long frame, outside its first
    five bits, as masks on its digits 1-11, 12-22 and 23-28. 5778 rows, whatever the data."""
    left = _remainders(88)
    of_bit = {k: left[87 - k] if k < 88 else 1 << (111 - k) for k in range(112)}
    mask = lambda ks: tuple(sum(1 << (hi - 1 - k) for k in ks if lo <= k < hi) for lo, hi in ((0, 44), (44, 88), (88, 112)))
    patterns = [(k,) for k in range(5, 112)] + [(j, k) for j in range(5, 112) for k in range(j + 1, 112)]
    rows = [(reduce(lambda a, b: a ^ b, (of_bit[k] for k in p)), *mask(p)) for p in patterns]
    return spark.createDataFrame(rows, "syndrome long, flip_a long, flip_b long, flip_p long")


def repair_frames(frames: DataFrame) -> DataFrame:
    """Frames of formats 17 and 18 with one or two wrong bits set right; adds ``crc_ok`` and ``corrected``."""
    # the remainder of a whole frame: 0 if its parity is right, the address for formats that overlay it
    rows = with_data_crc(frames.withColumn("df", downlink_format(F.col("hex"))), "hex", "__data", 6)
    parity = number(F.substring("hex", F.length("hex") - 5, F.lit(6)))
    rows = rows.withColumn("residual", F.col("__data").bitwiseXOR(parity)).drop("__data")
    wrong = F.when(F.col("df").isin(17, 18) & (F.col("residual") != 0) & (F.length("hex") == 28), F.col("residual"))
    joined = rows.withColumn("__s", wrong).join(F.broadcast(flips(frames.sparkSession)), F.col("__s") == F.col("syndrome"), "left")
    part = lambda at, n, flip: F.lpad(F.hex(number(F.substring("hex", at, n)).bitwiseXOR(F.col(flip))), n, "0")
    fixed = F.concat(part(1, 11, "flip_a"), part(12, 11, "flip_b"), part(23, 6, "flip_p"))
    corrected = F.col("syndrome").isNotNull()
    out = joined.withColumns({"hex": F.when(corrected, fixed).otherwise(F.col("hex")), "corrected": corrected})
    out = out.withColumn("residual", F.when(corrected, 0).otherwise(F.col("residual")))
    return out.drop("__s", "syndrome", "flip_a", "flip_b", "flip_p")


def parse_frames(frames: DataFrame, validate_icao: bool = True, ttl: float = 60.0) -> DataFrame:
    """Frames (receiver, seq, hex, timestamp) of known format and length, with df, icao, msg_bits, crc_ok, corrected.

    Addresses that are read from the parity are believed, if asked, only where the same receiver got the same address
    in clear within ``ttl`` seconds before, in arrival order.
    """
    known = F.create_map(*(F.lit(x) for kv in FRAME_BITS.items() for x in kv))
    rows = frames.withColumn("df", downlink_format(F.col("hex"))).filter(known[F.col("df")] == F.length("hex") * 4).drop("df")
    rows = repair_frames(rows)
    clear = F.col("df").isin(*EXPLICIT)
    icao = F.when(clear, F.substring("hex", 3, 6)).otherwise(F.lpad(F.hex("residual"), 6, "0"))
    # frames that carry their address must check out; for the others the remainder is the address itself
    rows = rows.withColumns({"icao": icao, "msg_bits": F.length("hex") * 4, "crc_ok": ~clear | (F.col("residual") == 0)})
    if validate_icao:
        seen = Window.partitionBy("receiver", "icao").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(clear & F.col("crc_ok"), F.col("timestamp")), ignorenulls=True).over(seen)
        rows = rows.withColumn("__seen", last).filter(clear | (F.col("timestamp") - F.col("__seen") <= ttl)).drop("__seen")
    return rows.drop("residual")


def _from_gray(bits_: int) -> list[int]:
    """The number for each Gray code of so many bits."""
    out = [0] * (1 << bits_)
    for n in range(1 << bits_):
        out[n ^ (n >> 1)] = n
    return out


#: Hundreds of feet within five hundred for each code C1 C2 C4; 0 for those that mean nothing.
_HUNDREDS = (0, 1, 3, 2, 5, 0, 4, 0)
#: Where the bits of the two Gray codes of a high altitude stand in a 13-bit field, first bit first: D2 D4 A1 A2 A4 B1 B2 B4, C1 C2 C4.
_FIVES_AT, _HUNDREDS_AT = (2, 0, 11, 9, 7, 5, 3, 1), (12, 10, 8)


def _gillham_high(code: Column) -> Column:
    """Altitude from 30,800 to 126,700 feet, as the standard codes it: counts of five hundred, and hundreds that run up and down in turn."""
    picked = lambda places: reduce(lambda x, k: x * 2 + F.shiftright(code, k).bitwiseAND(F.lit(1)), places, F.lit(0))
    fives = F.get(_table(_from_gray(8)), picked(_FIVES_AT).cast("int"))
    hundreds = F.get(_table(list(_HUNDREDS)), picked(_HUNDREDS_AT).cast("int"))
    return F.when(hundreds > 0, (fives * 500 + F.when(fives % 2 == 1, 6 - hundreds).otherwise(hundreds) * 100 - 1300).cast("int"))


def hundreds_13(feet: Column) -> Column:
    """The 13-bit field of an altitude from 30,800 to 126,700 feet in hundreds, rounded down: what lies too high for steps of 25 feet."""
    n = F.floor(feet / 100) + 12
    fives, at = F.floor(n / 5).cast("long"), F.pmod(n, F.lit(5)) + 1
    hundreds = F.when(fives % 2 == 1, 6 - at).otherwise(at)
    gray, code = fives.bitwiseXOR(F.shiftright(fives, 1)), F.get(_table([_HUNDREDS.index(k) for k in range(1, 6)]), (hundreds - 1).cast("int")).cast("long")
    moved = lambda value, places: [F.shiftleft(F.shiftright(value, len(places) - 1 - k).bitwiseAND(F.lit(1)), to) for k, to in enumerate(places)]
    return reduce(lambda a, b: a.bitwiseOR(b), moved(gray, _FIVES_AT) + moved(code, _HUNDREDS_AT))


def gillham(code: Column, wide: Column | None = None) -> Column:
    """Altitude of a Gray-coded 13-bit field (its bits in the order C1 A1 C2 A2 C4 A4 M B1 Q B2 D2 B4 D4).

    Codes without D bits are read as the reference reads them, also those of 12 bits, which have no M. It leaves out D bits, which
    are set from 30,800 feet on; there ``wide`` is the code with its M, if ``code`` has none.
    """
    return F.when(code.bitwiseAND(F.lit(5)) != 0, _gillham_high(code if wide is None else wide)).otherwise(_gillham_low(code))


def _gillham_low(code: Column) -> Column:
    b = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(1))
    c = F.get(_table(_from_gray(3)), (b(8) * 4 + b(10) * 2 + b(12)).cast("int"))
    ab = F.get(_table(_from_gray(6)), (b(7) * 32 + b(9) * 16 + b(11) * 8 + b(1) * 4 + b(3) * 2 + b(5)).cast("int"))
    # hundreds run from 1 to 5, so the result lies between -1100 and 30800
    return F.when(c.between(1, 5), (ab * 500 + c * 100 - 1200).cast("int"))


def altitude_12(code: Column) -> Column:
    n = F.shiftleft(F.shiftright(code, 5), 4).bitwiseOR(code.bitwiseAND(F.lit(15)))
    q = F.shiftright(code, 4).bitwiseAND(F.lit(1))
    wide = F.shiftleft(F.shiftright(code, 6), 7).bitwiseOR(code.bitwiseAND(F.lit(63)))
    return F.when(code == 0, None).when(q == 1, (n * 25 - 1000).cast("int")).otherwise(gillham(code, wide))


def altitude_13(code: Column) -> Column:
    part = lambda mask, shift: F.shiftright(code.bitwiseAND(F.lit(mask)), shift)
    n = part(0x1F80, 2).bitwiseOR(part(0x20, 1)).bitwiseOR(part(0xF, 0))
    bit = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(1))
    return F.when((code == 0) | (bit(6) == 1), None).when(bit(4) == 1, (n * 25 - 1000).cast("int")).otherwise(gillham(code))


def squawk_13(code: Column) -> Column:
    b = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(1))
    digits = (b(7) * 4 + b(9) * 2 + b(11), b(1) * 4 + b(3) * 2 + b(5), b(8) * 4 + b(10) * 2 + b(12), b(0) * 4 + b(2) * 2 + b(4))
    return F.concat(*(x.cast("string") for x in digits))


def callsign(me: Column) -> Column:
    place = lambda k: F.substring(F.lit(CHARSET), bits(me, 9 + 6 * k, 6).cast("int") + 1, F.lit(1))
    return F.concat(*(place(k) for k in range(8)))


def velocity(me: Column, spec_bits: bool = False) -> Column:
    """Struct (speed_kts, heading_deg, vertical_rate_fpm, speed_type) of a velocity message.

    The airspeed form reads its vertical rate from other bits than the ground form; ``spec_bits`` reads both alike.
    """
    subtype = bits(me, 6, 3)
    ew, ns = bits(me, 15, 10) - 1, bits(me, 26, 10) - 1
    vx, vy = F.when(bits(me, 14, 1) == 1, -ew).otherwise(ew), F.when(bits(me, 25, 1) == 1, -ns).otherwise(ns)
    both = (ew >= 0) & (ns >= 0)

    def rate(sign: Column, raw: Column) -> Column:
        value = (raw - 1) * 64
        return F.when(raw > 0, F.when(sign == 1, -value).otherwise(value)).cast("int")

    ground_rate = rate(bits(me, 37, 1), bits(me, 38, 9))
    air_rate = ground_rate if spec_bits else rate(bits(me, 46, 1), bits(me, 47, 9))
    heading = F.round(F.pmod(F.degrees(F.atan2(vx.cast("double"), vy.cast("double"))), F.lit(360.0)), 2)
    ground = F.struct(
        F.when(both, F.round(F.sqrt((vx * vx + vy * vy).cast("double")), 2)).alias("speed_kts"), F.when(both, heading).alias("heading_deg"),
        ground_rate.alias("vertical_rate_fpm"), F.lit("ground").alias("speed_type"),
    )
    raw = bits(me, 26, 10)
    air = F.struct(
        F.when(raw > 0, (raw - 1).cast("double")).alias("speed_kts"), F.when(bits(me, 14, 1) == 1, F.round(bits(me, 15, 10) * 360.0 / 1024, 2)).alias("heading_deg"),
        air_rate.alias("vertical_rate_fpm"), F.when(bits(me, 25, 1) == 1, "tas").otherwise("ias").alias("speed_type"),
    )
    return F.when(subtype.isin(1, 2), ground).when(subtype.isin(3, 4), air)


def _field(mb: Column, status: int, start: int, width: int, value) -> Column:
    return F.when(bits(mb, status, 1) == 1, value(bits(mb, start, width)))


def bds40(mb: Column) -> dict[str, Column]:
    return {
        "mcp_altitude_ft": _field(mb, 1, 2, 12, lambda v: (v * 16).cast("int")),
        "fms_altitude_ft": _field(mb, 14, 15, 12, lambda v: (v * 16).cast("int")),
        "baro_setting_mb": _field(mb, 27, 28, 12, lambda v: 800.0 + v * 0.1),
    }


def _circle(width: int):
    return lambda v: (signed(v, width) * (90.0 / 512.0) + 360.0) % 360.0


def bds50(mb: Column) -> dict[str, Column]:
    return {
        "roll_deg": _field(mb, 1, 2, 10, lambda v: signed(v, 10) * (45.0 / 256.0)),
        "true_track_deg": _field(mb, 12, 13, 11, _circle(11)),
        "ground_speed_kts": _field(mb, 24, 25, 10, lambda v: (v * 2).cast("int")),
        "track_rate_dps": _field(mb, 35, 36, 10, lambda v: signed(v, 10) * (8.0 / 256.0)),
        "true_airspeed_kts": _field(mb, 46, 47, 10, lambda v: (v * 2).cast("int")),
    }


def bds60(mb: Column) -> dict[str, Column]:
    return {
        "magnetic_heading_deg": _field(mb, 1, 2, 11, _circle(11)),
        "indicated_airspeed_kts": _field(mb, 13, 14, 10, lambda v: v.cast("int")),
        "mach": _field(mb, 24, 25, 10, lambda v: v * (2.048 / 512.0)),
        "baro_vertical_rate_fpm": _field(mb, 35, 36, 10, lambda v: (signed(v, 10) * 32).cast("int")),
        "inertial_vertical_rate_fpm": _field(mb, 46, 47, 10, lambda v: (signed(v, 10) * 32).cast("int")),
    }


# Ranges in which a register's fields are plausible.
PLAUSIBLE = {
    "mcp_altitude_ft": (0, 65520), "fms_altitude_ft": (0, 65520), "baro_setting_mb": (800.0, 1200.0), "roll_deg": (-60.0, 60.0),
    "true_track_deg": (0.0, math.nextafter(360.0, 0.0)), "ground_speed_kts": (0, 700), "track_rate_dps": (-16.0, 16.0), "true_airspeed_kts": (0, 700),
    "magnetic_heading_deg": (0.0, math.nextafter(360.0, 0.0)), "indicated_airspeed_kts": (0, 500), "mach": (0.0, 1.0),
    "baro_vertical_rate_fpm": (-6000, 6000), "inertial_vertical_rate_fpm": (-6000, 6000),
}


def register_score(fields: dict[str, Column]) -> Column:
    """2 for every present field in its plausible range, -10 for every one outside."""
    each = [F.when(c.isNull(), 0).when(c.between(*PLAUSIBLE[k]), 2).otherwise(-10) for k, c in fields.items()]
    return reduce(lambda a, b: a + b, each)


def register_scores(mb: Column) -> Column:
    """Scores of the registers 4,0, 5,0 and 6,0, in this order."""
    return F.array(register_score(bds40(mb)), register_score(bds50(mb)), register_score(bds60(mb)))


def comm_b(mb: Column) -> Column:
    """Struct (register, bds40, bds50, bds60) of a 56-bit Comm-B field; null unless one register leads by 4."""
    return _let(mb, lambda m: _let(register_scores(m), lambda scores: _told(m, scores)))


def _told(mb: Column, scores: Column) -> Column:
    ordered = F.array_sort(scores)
    best, lead = F.get(ordered, F.lit(2)), F.get(ordered, F.lit(2)) - F.get(ordered, F.lit(1))
    first = F.array_position(scores, best)
    registers = {"bds40": bds40(mb), "bds50": bds50(mb), "bds60": bds60(mb)}
    parts = [F.when(first == k + 1, F.struct(*(c.alias(n) for n, c in f.items()))).alias(name) for k, (name, f) in enumerate(registers.items())]
    name = F.element_at(F.array(*(F.lit(k) for k in registers)), first.cast("int"))
    return F.when((best > 0) & (lead >= 4), F.struct(name.alias("register"), *parts))


def decode_messages(frames: DataFrame, every: bool = False) -> DataFrame:
    """Parsed frames with what they say: msg_type and the fields of its kind, others null. Frames without message go,
    unless ``every`` valid frame is wanted: some of them only tell an address."""
    me = F.when((F.length("hex") == 28), number(F.substring("hex", 9, 14)))
    rows = frames.withColumn("me", me).withColumn("tc", F.when(F.col("df").isin(17, 18), bits(F.col("me"), 1, 5).cast("int")))
    m, tc, df = F.col("me"), F.col("tc"), F.col("df")
    kind = (
        F.when(tc.between(1, 4), "identification").when(tc.between(5, 18) | tc.between(20, 22), "position")
        .when((tc == 19) & bits(m, 6, 3).between(1, 4), "velocity").when(df.isin(0, 4, 16, 20), "altitude").when(df.isin(5, 21), "squawk")
    )
    code = F.col("__code")
    is_ = lambda k: F.col("msg_type") == k
    rows = rows.withColumn("msg_type", kind).filter("crc_ok" if every else "crc_ok AND msg_type IS NOT NULL")
    rows = rows.withColumns({
        "__code": number(F.substring("hex", 5, 4)).bitwiseAND(F.lit(0x1FFF)), "__alt": bits(m, 9, 12),
    })
    return rows.withColumns({
        "callsign": F.when(is_("identification"), _let(m, callsign)),
        "category": F.when(is_("identification"), bits(m, 6, 3).cast("int")),
        "altitude_ft": F.when(is_("position") & (tc >= 9), _let(F.col("__alt"), altitude_12)).when(is_("altitude"), _let(code, altitude_13)),
        "is_surface": F.when(is_("position"), tc < 9),
        "cpr_odd": F.when(is_("position"), bits(m, 22, 1) == 1),
        "cpr_lat": F.when(is_("position"), bits(m, 23, 17)),
        "cpr_lon": F.when(is_("position"), bits(m, 40, 17)),
        "velocity": F.when(is_("velocity"), _let(m, velocity)),
        "squawk": F.when(is_("squawk"), _let(code, squawk_13)),
        "comm_b": F.when(df.isin(20, 21), comm_b(m)),
    }).drop("me", "__code", "__alt")
