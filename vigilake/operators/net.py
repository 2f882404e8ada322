"""Addresses that a fetch must not reach. IPv4 stays in the JVM; IPv6 is parsed by an Arrow function."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.functions.columns import let

#: Refused ranges in order, as (first, prefix length, reason).
V4 = [
    ("169.254.169.254", 32, "cloud metadata endpoint (169.254.169.254)"),
    ("127.0.0.0", 8, "loopback address (127.0.0.0/8)"),
    ("10.0.0.0", 8, "RFC1918 private address (10/8, 172.16/12, 192.168/16)"),
    ("172.16.0.0", 12, "RFC1918 private address (10/8, 172.16/12, 192.168/16)"),
    ("192.168.0.0", 16, "RFC1918 private address (10/8, 172.16/12, 192.168/16)"),
    ("169.254.0.0", 16, "link-local address (169.254.0.0/16)"),
    ("0.0.0.0", 32, "unspecified address (0.0.0.0)"),
    ("0.0.0.0", 8, "0.0.0.0/8 address range"),
    ("100.64.0.0", 10, "RFC6598 Shared Address Space (100.64.0.0/10)"),
    ("198.18.0.0", 15, "RFC2544 benchmarking address (198.18.0.0/15)"),
    ("192.0.0.0", 24, "RFC6890 IETF protocol assignment (192.0.0.0/24)"),
    ("192.0.2.0", 24, "documentation address range (TEST-NET)"),
    ("198.51.100.0", 24, "documentation address range (TEST-NET)"),
    ("203.0.113.0", 24, "documentation address range (TEST-NET)"),
    ("224.0.0.0", 4, "multicast address (224.0.0.0/4)"),
    ("240.0.0.0", 4, "reserved/broadcast address (240.0.0.0/4)"),
]
V6 = [
    ("fd00:ec2::254", 128, "cloud metadata endpoint (fd00:ec2::254)"),
    ("::1", 128, "loopback address (::1)"),
    ("::", 128, "unspecified address (::)"),
    ("ff00::", 8, "multicast address (ff00::/8)"),
]
#: Behind what an address carries: ranges that are refused whatever they carry.
V6_LAST = [("fe80::", 10, "link-local address (fe80::/10)"), ("fc00::", 7, "RFC4193 unique-local address (fc00::/7)")]
#: Ranges that carry an IPv4 address (prefix, its length, by how many bits the address is shifted): those that count as this address alone, and others.
MAPPED = [("::ffff:0:0", 96, 0), ("::", 96, 0)]
CARRIERS = [("64:ff9b::", 96, 0), ("64:ff9b:1::", 48, 0), ("2002::", 16, 80)]


def v4_number(ip: Column) -> Column:
    """The address as a number; null unless it is four octets."""
    o = F.split(ip, r"\.")
    part = [F.try_element_at(o, F.lit(i)).cast("long") for i in range(1, 5)]
    number = ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3]
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|\z)){4}") & ~ip.endswith("."), number)


def v4_refused(ip: Column) -> Column:
    """Why an IPv4 address is refused, or null; the number is worked out once for all ranges."""

    def reason(n: Column) -> Column:
        ranges = [(int(ipaddress.IPv4Address(first)), bits, why) for first, bits, why in V4]
        return reduce(lambda out, r: out.when(n.between(r[0], r[0] + (1 << (32 - r[1])) - 1), r[2]), ranges, F.when(n.isNull(), F.lit(None).cast("string")))

    return let(v4_number(ip), reason)


def _within(n: int, first: str, bits: int) -> bool:
    ip = ipaddress.ip_address(first)
    return n >> (ip.max_prefixlen - bits) == int(ip) >> (ip.max_prefixlen - bits)


def _v4_reason(n: int) -> str | None:
    return next((why for first, bits, why in V4 if _within(n, first, bits)), None)


def _v6_reason(text: str) -> str | None:
    try:
        n = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if why := next((why for first, bits, why in V6 if _within(n, first, bits)), None):
        return why
    if any(_within(n, first, bits) for first, bits, _ in MAPPED):
        return _v4_reason(n & 0xFFFFFFFF)
    carried = [n >> shift & 0xFFFFFFFF for first, bits, shift in CARRIERS if _within(n, first, bits)]
    if n >> 32 & 0xFFFFFFFF in (0x5EFE, 0x02005EFE):  # ISATAP
        carried.append(n & 0xFFFFFFFF)
    if why := next(filter(None, map(_v4_reason, carried)), None):
        return why
    return next((why for first, bits, why in V6_LAST if _within(n, first, bits)), None)


@F.arrow_udf(T.StringType())
def v6_refused(ips: pa.Array) -> pa.Array:
    return pa.array([_v6_reason(x) if x and ":" in x else None for x in ips.to_pylist()], pa.string())


def refused(ip: Column) -> Column:
    """Why an address is refused, or null; only IPv6 enters Python."""
    return F.coalesce(v4_refused(ip), F.when(F.contains(ip, F.lit(":")), v6_refused(ip)))


def hosts_refused(resolutions: DataFrame) -> DataFrame:
    """host and whether any of its addresses is refused."""
    return resolutions.groupBy("host").agg(F.bool_or(refused(F.col("ip")).isNotNull()).alias("refused"))
