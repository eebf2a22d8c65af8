"""Addresses keep their shared prefixes and their special ranges."""

import ipaddress
import random

from pyspark.sql import functions as F

from spanloom.operators import addresses


def shared(a, b):
    return a.max_prefixlen - (int(a) ^ int(b)).bit_length()


def test_prefixes_and_ranges(spark):
    r = random.Random(3)
    near = [ipaddress.IPv4Address((r.choice([0x0A000000, 0xC0A80100, 0x08080800, 0xDE000000, 0x7F000000, 0xE0000001]) + r.randint(0, 600)) % 2**32) for _ in range(60)] + [ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(60)]
    wide = [ipaddress.IPv6Address(b << 64 | r.getrandbits(r.choice([4, 64]))) for b in (0x20014860 << 32, 0xFE80 << 48, 0xFC00 << 48, 0) for _ in range(10)]
    odd = [None, "", "1.2.3", "999.1.1.1", "text", "1:2", "1:2:3:4:5:6:7", ":::"]
    asked = list({*near, *wide})
    rows = [(str(x),) for x in asked] + [(x,) for x in odd]
    got = [x.m for x in spark.createDataFrame(rows, "a string").coalesce(1).select(addresses.mapped(F.col("a"), "key").alias("m")).collect()]
    assert got[len(asked) :] == odd
    new = dict(zip(asked, map(ipaddress.ip_address, got), strict=False))
    assert len(set(new.values())) == len(asked) and sum(a != b for a, b in new.items()) > len(asked) / 2
    for a in asked:
        for b in asked:
            if a.version == b.version:
                assert shared(a, b) == shared(new[a], new[b])
        for net in map(ipaddress.ip_network, addresses.SPECIAL):
            assert net.version != a.version or (a in net) == (new[a] in net)
