"""Classes of frames by their bytes, as Column expressions over a binary payload."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed by the protocols: first bytes of call frames, the power request, flag bits, contexts, and the names whose hashes announces carry.
CALLS = {0xC2: "HAIL", 0xC3: "ANNOUNCE", 0xC4: "GOT", 0xC5: "READY", 0xC6: "END", 0xC7: "BYE", 0xC8: "RESEND"}
#: What call frames are labelled with in results: a fixed value, as their users know it.
CALL_LABEL = "SUPE"
POWER_REQUEST, POWER_REQUEST_BYTES = 0x04, 4
PATH_RESPONSE, LINK_PROOF, LINK_CONTROL = 0x0B, 0xFF, [0xFA, 0xFB, 0xFC, 0xFE]
NAMES = [
    "lxmf.delivery", "lxmf.propagation", "lxmproxy.server", "nomadnetwork.node", "netgraph.discovery",
    "rnstransport.probe", "rnstransport.remote.management", "rnstransport.path.request", "rnstransport.tunnel.synthesize",
]


def name_hash(name: str) -> bytes:
    return hashlib.sha256(name.encode()).digest()[:10]


def plain_address(name: str) -> bytes:
    return hashlib.sha256(name_hash(name)).digest()[:16]


def byte(payload: Column, i: int | Column) -> Column:
    """The byte at i, from 0; null beyond the end."""
    at = (F.lit(i) if isinstance(i, int) else i) * 2 + 1
    return F.conv(F.nullif(F.substring(F.hex(payload), at, F.lit(2)), F.lit("")), 16, 10).try_cast("int")


def part_hex(payload: Column, start: Column, n: int) -> Column:
    return F.lower(F.substring(F.hex(payload), start * 2 + 1, F.lit(2 * n)))


def _header(payload: Column) -> tuple[Column, Column, Column]:
    """Flags, length of the packet after the frame's first byte, and length of its header."""
    flags = byte(payload, 1)
    return flags, F.octet_length(payload) - 1, F.when(flags.bitwiseAND(0x40) > 0, 35).otherwise(19)


def _named(hex_: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for digest, name in names.items():
        out = F.when(hex_ == digest, F.lit(name)).otherwise(out)
    return out


def kind_of(payload: Column, part: Column, calls: str = CALL_LABEL) -> Column:
    """One class of a frame; null for the second part of a split one, which counts as its first part does."""
    flags, size, header = _header(payload)
    first = byte(payload, 0)
    call = F.lit(None).cast("string")
    for b, name in CALLS.items():
        call = F.when(first == b, F.lit(f"{calls} {name}")).otherwise(call)
    context = byte(payload, header)
    announced = F.when(size - header >= 74, _named(part_hex(payload, header + 65, 10), {name_hash(n).hex(): n for n in NAMES}))
    address = _named(part_hex(payload, header - 16, 16), {plain_address(n).hex(): n for n in NAMES})
    kind = flags.bitwiseAND(3)
    packet = (
        F.when((kind == 1) & (context == PATH_RESPONSE), "path response")
        .when(kind == 1, F.concat(F.lit("announce "), F.coalesce(announced, F.lit("other"))))
        .when(kind == 2, "link request")
        .when((kind == 3) & (context == LINK_PROOF), "link proof")
        .when(kind == 3, "proof")
        .when(address == "rnstransport.path.request", "path request")
        .when(context.isin(LINK_CONTROL), "link control")
        .when(context.between(1, 7), "resource")
        .otherwise("data")
    )
    return (
        F.when(payload.isNull() | (F.octet_length(payload) == 0), "empty")
        .when(call.isNotNull(), call)
        .when((F.octet_length(payload) == POWER_REQUEST_BYTES) & (first == POWER_REQUEST), "power request")
        .when(F.coalesce(part, F.lit(0)) == 2, F.lit(None).cast("string"))
        .when((size < 19) | (flags.bitwiseAND(0x80) > 0) | (size < header), "other")
        .otherwise(packet)
    )


def calling_class(kind: Column, calls: str = CALL_LABEL) -> Column:
    """What a frame on the calling channel counts as in the split by role."""
    announces = kind.startswith("announce") | kind.isin(f"{calls} ANNOUNCE", "path request", "path response")
    return F.when(announces, "announces_and_path").when(kind == f"{calls} HAIL", "hails").when(kind.startswith(f"{calls} "), f"{calls.lower()}_other").otherwise("unicast")


def announced(payload: Column, part: Column) -> Column:
    """struct(dest, hops) of an announce; null of any other frame."""
    flags, size, header = _header(payload)
    fits = (F.coalesce(part, F.lit(0)) != 2) & ~byte(payload, 0).isin(list(CALLS)) & (size >= 19) & (flags.bitwiseAND(0x80) == 0) & (flags.bitwiseAND(3) == 1)
    return F.when(fits, F.struct(part_hex(payload, header - 16, 16).alias("dest"), byte(payload, 2).alias("hops")))


def is_announce(kind: Column, calls: str = CALL_LABEL) -> Column:
    return kind.startswith("announce") | (kind == f"{calls} ANNOUNCE")
