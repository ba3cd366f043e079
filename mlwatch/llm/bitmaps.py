"""Sets of 64-bit hashes as bitmaps of bounded size: what is in the set is always found, other hashes now and then."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 26
SHIFTS = (0, 5, 9, 14)


class Bitmap:
    """Has the hashes it was made of, and by chance a share of others: about 0.3 percent while there is room for 16 bits a hash."""

    def __init__(self, bits: int, probes: int, slots: np.ndarray):
        self.bits, self.probes, self.slots = bits, probes, slots

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for shift in SHIFTS[: self.probes]:
            at = (hashes.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            found &= (self.slots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def bitmap(hashes: DataFrame, most_bits: int = MOST_BITS) -> Bitmap:
    """The bitmap of a settled column of well-mixed hashes of 40 bits or more, of 2 to the power of ``most_bits`` bits at most.

    Spark puts the bits together; the driver gets one number for each 64 of them, 8 MB in all at most, whatever the input.
    A hash sets up to four bits, fewer where they are short. Nulls are left out; no hashes give a bitmap that has none.
    """
    name = hashes.columns[0]
    n = hashes.count()
    bits = min(most_bits, max(10, (16 * n).bit_length()))
    probes = max(1, min(len(SHIFTS), round(0.69 * (1 << bits) / max(1, n))))
    places = F.array(*[F.shiftrightunsigned(F.col(name), s).bitwiseAND(F.lit((1 << bits) - 1)) for s in SHIFTS[:probes]])
    at = hashes.where(F.col(name).isNotNull()).select(F.explode(places).alias("at"))
    word = at.select(F.shiftright("at", 6).alias("slot"), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
    got = word.groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    slots = np.zeros(1 << (bits - 6), np.uint64)
    slots[got["slot"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return Bitmap(bits, probes, slots)
