"""Tag payload and controller register expressions (C7-C10, F6). All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_EPC = "<no-epc>"
# Sentinels stored instead of NULL.
SENTINELS = ["NO_READ", "NO_TAG", "PENDING", "?"]


def strip_zeros(epc: Column) -> Column:
    s = F.ltrim(F.trim(F.coalesce(epc, F.lit(""))), F.lit("0"))
    return F.when(s == "", "0").otherwise(s)


def tag_number(epc: Column, tail: int = 4) -> Column:
    """Decimal tags without leading zeros, other tags by their last digits, blank stays blank."""
    raw = F.trim(F.coalesce(epc, F.lit("")))
    stripped = strip_zeros(epc)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(raw == "", "")
        .when(stripped.rlike("^[0-9]+$"), stripped)
        .when(F.length(digits) >= tail, F.right(digits, F.lit(tail)))
        .when(digits != "", digits)
        .otherwise(stripped)
    )


def in_range(text: Column, lo: int, hi: int) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(t.rlike("^[0-9]+$") & t.try_cast("decimal(38,0)").between(lo, hi), F.lit(False))


def is_plant_tag(epc: Column, lo: int, hi: int) -> Column:
    """decimal in the plant's range, else the extracted number is."""
    return in_range(epc, lo, hi) | in_range(tag_number(epc), lo, hi)


def decode_epc(epc: Column) -> Column:
    """Digits and even-length hex as they are; base64url as printable ASCII, otherwise hex."""
    s = F.trim(F.coalesce(epc, F.lit("")))
    std = F.translate(s, "-_", "+/")
    rest = F.length(std) % 4
    padded = F.when(rest == 2, F.concat(std, F.lit("=="))).when(rest == 3, F.concat(std, F.lit("="))).otherwise(std)
    well_formed = padded.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(padded) % 4 == 0)
    raw = F.when(well_formed, F.try_to_binary(padded, F.lit("base64")))
    hexed = F.lower(F.hex(raw))
    printable = hexed.rlike("^(?:(?:0[9a-d]|1[c-f]|[2-6][0-9a-f]|7[0-9a-e]))+$")
    text = F.trim(F.decode(raw, "US-ASCII"))
    text = F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    shown = F.when(printable & (text != "") & ~text.rlike(r"[^\x20-\x7e]"), text)
    even_hex = s.rlike("^(?:[0-9a-fA-F]{2})+$")
    return (
        F.when(s == "", NO_EPC).when(s.rlike("^[0-9]+$"), s).when(even_hex, s).otherwise(F.coalesce(shown, hexed, F.lit(NO_EPC)))
    )


def rssi_dbm(centi_dbm: Column, dbm: Column) -> Column:
    """Centi-dBm reading if present, else the plain reading."""
    return F.coalesce(centi_dbm / 100.0, dbm)


def trigger_state(word: Column, kind: str = "auto", on_value: int = 1, bit: int = -1, mask: int = 0) -> Column:
    """Register word to 0/1 by value, bit or mask; ``auto`` prefers mask, then bit, then value."""
    w = F.coalesce(word.try_cast("long"), F.lit(None).cast("long"))
    if kind == "auto":
        kind = "mask" if mask else "bit" if bit >= 0 else "value"
    if kind == "bit" and bit >= 0:
        state = F.shiftright(w, bit).bitwiseAND(F.lit(1)) == 1
    elif kind == "mask" and mask:
        state = w.bitwiseAND(F.lit(mask)) == (on_value & mask)
    else:
        state = w == on_value
    return F.coalesce(state.cast("int"), F.lit(0))


def is_real(value: Column, sentinels: list[str] = SENTINELS) -> Column:
    """present and not one of the sentinels."""
    return F.coalesce((F.trim(value) != "") & ~value.isin(sentinels), F.lit(False))


__all__ = [n for n in dir() if not n.startswith("_")]
