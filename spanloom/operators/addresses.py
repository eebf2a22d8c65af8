"""IP substitutes that keep networks together: two addresses share as many leading bits after the mapping as before.

A bit is turned over or not by a keyed hash of the bits before it, so the mapping of all addresses is a permutation. Bits on the way to a
special range (private, loopback, link-local, multicast and the like) stay, so special addresses stay in their range and no other gets into one.

Null and what is no address stay as they are. IPv6 addresses are read in full or shortened form and written without shortening; scopes and embedded IPv4 parts aren't read.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Special ranges of the public registries of IPv4 and IPv6 addresses.
SPECIAL = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24", "192.168.0.0/16", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/127", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32"]
V4, V6 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$", r"^(?i:[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7})$"


def kept_prefixes(version: int) -> list[str]:
    """The bits on the way to each special range, after which the next bit stays."""
    out = set()
    for net in map(ipaddress.ip_network, SPECIAL):
        if net.version == version:
            bits = f"{int(net.network_address):0{net.max_prefixlen}b}"
            out |= {bits[:i] for i in range(net.prefixlen)}
    return sorted(out, key=lambda b: (len(b), b))


def _turned(bits: Column, key: str, version: int) -> Column:
    """The bits of an address, each by the hash of those before it."""
    kept = F.array(*[F.lit(x) for x in kept_prefixes(version)])
    odd = lambda p: F.conv(F.substring(F.md5(F.concat(F.lit(f"{key}/"), p)), 1, 1), 16, 10).cast("int") % 2 == 1

    def bit(b: Column, i: Column) -> Column:
        before = F.substring(bits, F.lit(1), i)
        return F.when(~F.array_contains(kept, before) & odd(before), F.translate(b, "01", "10")).otherwise(b)

    return F.array_join(F.transform(F.split(bits, ""), bit), "")


def _groups(bits: Column, n: int, base: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.length(bits) / n).cast("int") - 1), lambda i: F.lower(F.conv(F.substring(bits, i * n + 1, F.lit(n)), 2, base)))


def mapped(address: Column, key: str) -> Column:
    """The address that stands for another one under a key."""
    four = F.array_join(F.transform(F.split(address, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0")), "")
    halves = F.split(address, "::", 2)
    half = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(half(0)) - F.size(half(1)), F.lit(0)))
    six = F.array_join(F.transform(F.concat(half(0), zeros, half(1)), lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), "")
    whole = (F.length(six) == 128) & (F.size(F.split(address, "::", -1)) <= 2) & ~F.contains(address, F.lit(":::")) & (F.contains(address, F.lit("::")) | (F.size(half(0)) == 8))
    return F.when(address.rlike(V4), F.array_join(_groups(_turned(four, key, 4), 8, 10), ".")).when(address.rlike(V6) & whole, F.array_join(_groups(_turned(six, key, 6), 16, 16), ":")).otherwise(address)
