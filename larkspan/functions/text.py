"""Text expressions: names, place names, presets, stamps, tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRESETS = {
    "SHORTTURBO": (7, 500.0, 5),
    "SHORTFAST": (7, 250.0, 5),
    "SHORTSLOW": (8, 250.0, 5),
    "MEDIUMFAST": (9, 250.0, 5),
    "MEDIUMSLOW": (10, 250.0, 5),
    "LONGFAST": (11, 250.0, 5),
    "LONGMODERATE": (11, 125.0, 8),
    "LONGSLOW": (12, 125.0, 8),
    "VERYLONGSLOW": (12, 62.5, 8),
}
CUT_BANDWIDTHS = {7: 7.8, 10: 10.4, 15: 15.6, 20: 20.8, 31: 31.25, 41: 41.7, 62: 62.5}
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def slug(text: Column, fallback: Column) -> Column:
    """Lower-case letters and digits with single hyphens, 32 characters at most; fallback if nothing is left."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    out = F.rtrim(F.substring(F.btrim(out, F.lit("-")), 1, 32), F.lit("-"))
    return F.when(out == "", fallback).otherwise(out)


def place_key(name: Column) -> Column:
    """A place name folded for search: umlauts spelt out, other marks as blanks, spellings of the street ending made one."""
    s = name
    for letters, to in (("[äÄ]", "ae"), ("[öÖ]", "oe"), ("[üÜ]", "ue"), ("ß", "ss"), ("[éèê]", "e")):
        s = F.regexp_replace(s, letters, to)
    s = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", " ")
    s = F.regexp_replace(s, r"\s*(?:strasse|str |str)$", "strasse")
    return F.trim(F.regexp_replace(s, " +", " "))


def match_score(hay: Column, needle: Column) -> Column:
    """How well a folded name fits a folded query; null if it doesn't."""
    at = F.instr(hay, needle)
    base = F.when(at == 1, 700).when(F.substring(hay, at - 1, F.lit(1)) == " ", 500).otherwise(250)
    longer = F.least(F.octet_length(hay) - F.octet_length(needle), F.lit(200))
    return F.when((needle == "") | (at == 0), F.lit(None).cast("int")).when(hay == needle, 1000).otherwise(base - longer)


def preset(text: Column) -> Column:
    """struct(sf, bw, cr) of a modem preset, by numbers (SF8/BW62/CR8) or by name; null if unknown."""
    up = F.upper(text)
    number = lambda p: F.regexp_extract(up, p, 1)
    sf, raw, cr = number(r"(?:^|/)\s*SF(\d+)\s*(?:/|$)").try_cast("int"), number(r"(?:^|/)\s*BW(\d+(?:\.\d+)?)\s*(?:/|$)").try_cast("double"), number(r"(?:^|/)\s*CR(\d+)\s*(?:/|$)").try_cast("int")
    bw = raw
    for whole, exact in CUT_BANDWIDTHS.items():
        bw = F.when(F.floor(raw) == whole, F.lit(exact)).otherwise(bw)
    made = lambda a, b, c: F.struct(a.cast("int").alias("sf"), b.cast("double").alias("bw"), c.cast("int").alias("cr"))
    named = F.lit(None).cast("struct<sf:int,bw:double,cr:int>")
    key = F.regexp_replace(up, "[^A-Z0-9]", "")
    for name, (a, b, c) in PRESETS.items():
        named = F.when(key == name, made(F.lit(a), F.lit(b), F.lit(c))).otherwise(named)
    return F.when(up.startswith("SF") & text.contains("/"), F.when(sf.between(5, 12) & (bw > 0) & cr.between(5, 8), made(sf, bw, cr))).otherwise(named)


def rfc3339_seconds(text: Column) -> Column:
    """Seconds since 1970 of a stamp of exactly 24 characters; a leap second counts as the one before; null if it isn't one."""
    held = F.regexp_replace(F.substring(text, 1, 19), ":60$", ":59")
    return F.when(text.rlike(RFC3339), F.unix_timestamp(F.try_to_timestamp(held, F.lit("yyyy-MM-dd'T'HH:mm:ss"))))


def small_uint(v: Column) -> Column:
    return F.when((v == F.floor(v)) & v.between(0, 255), v.cast("int"))


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180.0) / 6.0).cast("int") + 1))


def tile_name(lat: Column, lon: Column) -> Column:
    """A tile's name by its south-west corner, like N52E013."""
    return F.concat(F.when(lat >= 0, "N").otherwise("S"), F.lpad(F.abs(lat).cast("string"), 2, "0"), F.when(lon >= 0, "E").otherwise("W"), F.lpad(F.abs(lon).cast("string"), 3, "0"))


def query_id(command: Column) -> Column:
    """A command's hash, 0x20 to 0xBF."""
    codes = F.transform(F.split(command, ""), lambda c: F.ascii(c))
    return F.lit(0x20) + F.aggregate(codes, F.lit(0), lambda h, c: (h * 31 + c) % 256) % 160


def level_height(text: Column) -> Column:
    """Metres of a height tag: a number with or without m, or feet and inches; null if unreadable."""
    metres = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*m?\s*$", 1).try_cast("double")
    feet, inches = F.regexp_extract(text, r"^\s*(\d+)'\s*(?:(\d+)\")?\s*$", 1).try_cast("double"), F.regexp_extract(text, r"^\s*(\d+)'\s*(?:(\d+)\")?\s*$", 2).try_cast("double")
    return F.coalesce(metres, feet * 0.3048 + F.coalesce(inches, F.lit(0.0)) * 0.0254)


def clock(us: Column) -> Column:
    """Microseconds as hh:mm:ss, or Nd + hh:mm from a day on; null counts as 0."""
    s = F.floor(F.coalesce(us, F.lit(0)) / 1_000_000)
    day, rest = F.floor(s / 86_400), s % 86_400
    h, m = F.floor(rest / 3600), F.floor(rest % 3600 / 60)
    return F.when(day > 0, F.format_string("%dd + %02d:%02d", day, h, m)).otherwise(F.format_string("%02d:%02d:%02d", h, m, rest % 60))


def share(part: Column, of: Column) -> Column:
    """part/of with its percentage to one digit; 0/0 of nothing. The digit is that nearest to the double, of two as near the even one."""
    x = 100.0 * part / of
    low = F.floor(x * 10)
    beyond = (x * 16 - (2 * low + 1)) + x * 4  # 20 x less the middle between two tenths; exact where it is small
    tenths = low + F.when((beyond > 0) | ((beyond == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.when(of > 0, F.format_string("%d/%d (%d.%d%%)", part, of, F.floor(tenths / 10), tenths % 10)).otherwise("0/0")


def hex_bytes(text: Column, n: int) -> Column:
    """The n bytes that text writes in hexadecimal, in either case; null for anything else."""
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{2 * n}}}$"), F.unhex(text))


def named_like(label: Column, only: str) -> Column:
    """Whether a label holds any of the words in a comma-separated list, whatever their case; an empty list lets all pass."""
    words = [w.strip().lower() for w in only.split(",") if w.strip()]
    out = F.lit(not words)
    for w in words:
        out = out | F.lower(label).contains(w)
    return out


def masked(line: Column) -> Column:
    """A log line without what differs from message to message: ids as an ellipsis, numbers as N."""
    return F.regexp_replace(F.regexp_replace(line, r"\b(o_\S+|[0-9a-f]{8,}|lxmf\.id\d\.\S+)", "…"), r"[0-9]+", "N")


def expanded(command: Column, name: Column, ident: Column, addresses: Column) -> Column:
    """A command line with {name}, {id} and {addr:<node>} filled in; addresses is a map by node. Unknown nodes stay as they are."""
    out = F.replace(F.replace(command, F.lit("{name}"), name), F.lit("{id}"), ident.cast("string"))
    put = lambda s, e: F.replace(s, F.concat(F.lit("{addr:"), e["key"], F.lit("}")), e["value"])
    return F.aggregate(F.map_entries(addresses), out, put)
