"""Key hashes, hash ranges and a ring of nodes."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_hash(text: Column) -> Column:
    """The 31-polynomial over UTF-16 units with 32-bit wrap that the JVM gives strings; null stays null.

    Characters beyond the basic plane count as their two surrogates.
    """
    mod = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    units = F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"),
    )
    step = lambda acc, u: F.when(u < 65536, mod(acc * 31 + u)).otherwise(mod(mod(acc * 31 + F.shiftright(u, 16)) * 31 + u % 65536))
    return F.when(text.isNull(), None).otherwise(F.aggregate(units, F.lit(0).cast("long"), step).cast("int"))


def key_range(h: Column, n: int) -> Column:
    """Which of ``n`` contiguous parts of the 32-bit range a hash is in; the last takes the remainder."""
    width = (1 << 32) // n
    return F.least(F.floor((h.cast("long") + 2147483648) / F.lit(width)), F.lit(n - 1)).cast("int")


def channel(h: Column, n: int) -> Column:
    """The absolute value of the 32-bit remainder."""
    return F.abs(h % n).cast("int")


def ranges(n: int) -> list[tuple[int, int]]:
    """The inclusive bounds of ``key_range``'s parts."""
    width = (1 << 32) // n
    return [(-(1 << 31) + i * width, (1 << 31) - 1 if i == n - 1 else -(1 << 31) + (i + 1) * width - 1) for i in range(n)]


#: Offset and prime of the 32-bit FNV hash, and the shifts of its usual avalanche (left ones add, right ones xor).
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
AVALANCHE = (("left", 13), ("right", 7), ("left", 3), ("right", 17), ("left", 5))


def _signed(x: int) -> int:
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def ring_place(text: str) -> int:
    """Where on the ring of signed 32-bit numbers a text is: FNV over its UTF-16 units, then an avalanche."""
    raw = text.encode("utf-16-be", "surrogatepass")
    h = _signed(FNV_OFFSET)
    for i in range(0, len(raw), 2):
        h = _signed((h ^ int.from_bytes(raw[i : i + 2])) * FNV_PRIME)
    for way, n in AVALANCHE:
        h = _signed(h + (h << n)) if way == "left" else h ^ h >> n
    return h


def ring_hash(text: Column) -> Column:
    """``ring_place`` of a column, as a long; null stays null."""
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    unit = lambda x: F.conv(x, 16, 10).cast("long")
    coded = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(coded) - 3, F.lit(4)), lambda i: unit(F.substr(coded, i, F.lit(4))))
    fnv = lambda acc, u: wrap(acc.bitwiseXOR(u) * F.lit(FNV_PRIME))

    def spread(h: Column) -> Column:
        for way, n in AVALANCHE:
            h = wrap(h + F.shiftleft(h, n)) if way == "left" else h.bitwiseXOR(F.shiftright(h, n))
        return h

    empty = F.lit(_signed(FNV_OFFSET)).cast("long")
    return F.when(text.isNull(), None).when(text == "", spread(empty)).otherwise(F.aggregate(units, empty, fnv, spread))


class Ring:
    """Consistent hashing over named nodes, each at several places of the ring; a key belongs to the next place from its own on."""

    def __init__(self, replicas: int = 3):
        self.replicas, self.places, self.owner = replicas, [], {}

    def add(self, node: str) -> list[tuple[int, int]]:
        """Returns the ranges (after, up to) that move to the node."""
        moved = []
        for i in range(self.replicas):
            h = ring_place(f"{node}{i}")
            if h in self.owner:
                continue
            if self.places and self.owner[self.places[bisect_left(self.places, h) % len(self.places)]] != node:
                moved.append((self.places[bisect_left(self.places, h) - 1], h))
            insort(self.places, h)
            self.owner[h] = node
        return moved

    def remove(self, node: str) -> list[tuple[int, int]]:
        """Returns the ranges that the node gives up."""
        own = [h for h in self.places if self.owner[h] == node]
        out = [(self.places[self.places.index(h) - 1], h) for h in own]
        for h in own:
            self.places.remove(h)
            del self.owner[h]
        return out

    def lookup(self, key: str) -> str:
        if not self.places:
            raise LookupError("the ring is empty")
        return self.owner[self.places[bisect_left(self.places, ring_place(key)) % len(self.places)]]

    def owner_of(self, key: Column) -> Column:
        """The node of each key of a column. The ring is part of the expression: a few places for each node."""
        if not self.places:
            raise LookupError("the ring is empty")
        h = ring_hash(key)
        return F.when(h.isNull(), None).otherwise(F.coalesce(F.get(F.filter(F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(self.owner[p]).alias("node")) for p in self.places]), lambda x: x["p"] >= h), F.lit(0))["node"], F.lit(self.owner[self.places[0]])))
