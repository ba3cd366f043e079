"""Document fingerprints by winnowing, in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.llm.native import let, upto

K = 5
WINDOW = 8
PART = r"[^\x20\x09-\x0D]{1,16}"


def turned(h: Column, by: int) -> Column:
    """A 64-bit number turned left by some bits."""
    by %= 64
    return h if by == 0 else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def rolled(h: Column, k: int, use) -> Column:
    """``use`` of the cyclic polynomial of every ``k`` neighbours: the first turned by k-1 bits, ..., the last by none.

    The hash rolls in doubling steps: two runs of half the length, side by side, make one, whatever ``k`` is. Beyond the end
    of the array stand zeros.
    """
    if k == 1:
        return use(h)

    def doubled(half: Column) -> Column:
        size = k // 2
        two = F.transform(half, lambda x, i: turned(x, size).bitwiseXOR(F.coalesce(F.get(half, i + size), F.lit(0))))
        if k % 2 == 0:
            return let(two, use)
        return let(
            F.transform(two, lambda x, i: turned(x, 1).bitwiseXOR(F.coalesce(F.get(h, i + k - 1), F.lit(0)))), use
        )

    return rolled(h, k // 2, lambda half: let(half, doubled))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Selected grams of a text as an array of (hash, position), in order of position.

    Units are words, those of over 16 characters in parts. Every run of ``k`` units is hashed, and of every ``window`` runs
    in a row the smallest hash is selected, the rightmost of equal ones. Two texts that share ``k + window - 1`` units in a
    row have a selected gram of them in common, and the positions say where. A shorter text has one gram, its whole
    sequence; fewer grams than a window are one window. A null or blank text has no gram.
    """
    def hashed(units: Column) -> Column:
        return let(F.transform(units, lambda u: F.xxhash64(u)), lambda h: rolled(h, k, lambda g: minima(F.slice(g, 1, F.greatest(F.size(units) - k + 1, F.least(F.size(units), F.lit(1)))))))

    def minima(grams: Column) -> Column:
        # the smallest of equal hashes is then the one with the least negative place, the rightmost
        return let(F.transform(grams, lambda h, i: F.struct(h.alias("h"), (-i).alias("p"))), chosen)

    def chosen(marked: Column) -> Column:
        windows = F.when(F.size(marked) > 0, F.greatest(F.size(marked) - window + 1, F.lit(1))).otherwise(0)
        least = F.transform(upto(windows), lambda i: F.array_min(F.slice(marked, i + 1, window)))
        return let(least, lambda m: F.transform(
            F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["p"] != x["p"])),
            lambda x: F.struct(x["h"].alias("hash"), (-x["p"]).alias("position")),
        ))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PART), 0), hashed)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; 1 for two without any."""
    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return let(both, lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / (F.size(x) + F.size(y) - n)))

    own = [F.array_distinct(F.transform(c, lambda g: g["hash"])) for c in (a, b)]
    return let(own[0], lambda x: let(own[1], lambda y: of(x, y)))


def shown(prints: Column) -> Column:
    """A fingerprint as text: the leading 40 bits of each hash in hexadecimal digits, a colon, and the position."""
    return F.array_join(
        F.transform(prints, lambda g: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(g["hash"], 24))), 10, "0"), F.lit(":"), g["position"])), " "
    )


def following(docs: DataFrame, key: str, value: list[str], add: dict[str, Column]) -> DataFrame:
    """Rows with ``add`` computed beside them, and ``next``: value columns and added ones of the row with the next smaller key.

    Equal keys are ordered by the value columns, null keys come last, and after the last row comes the first. The keys
    alone are ranked to find bounds, one per task; every row then goes to the stretch between two bounds, the first row
    of a stretch also to the one before. So texts move once and no task holds more than a stretch.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / parts for i in range(1, parts + 1)]
    row = docs.agg(F.percentile_approx(key, at, 20 * parts), F.max(key)).first()
    bounds = sorted({*(row[0] or []), *([row[1]] if row[1] is not None else [])}, reverse=True)
    if bounds:
        listed = F.array(*[F.lit(b).cast(docs.schema[key].dataType) for b in bounds])
        place = F.when(F.col(key).isNull(), len(bounds)).otherwise(F.size(F.filter(listed, lambda b: b >= F.col(key))))
        halo = F.when(F.array_contains(listed, F.col(key)), F.when(place == 1, F.lit(len(bounds))).otherwise(place - 1))
    else:
        place, halo = F.lit(1), F.lit(1)
    placed = docs.withColumn("_to", F.explode(F.array_compact(F.array(F.struct(place.alias("at"), F.lit(False).alias("extra")), F.when(halo.isNotNull(), F.struct(halo.alias("at"), F.lit(True).alias("extra")))))))
    # a stretch that comes after itself has the wrapped row behind all others
    wraps = (F.col("_extra") & (F.col("_at") == len(bounds or [1]))).cast("int")
    dealt = placed.select("*", F.col("_to.at").alias("_at"), F.col("_to.extra").alias("_extra")).drop("_to").repartition(parts // 4, "_at")
    dealt = dealt.withColumns(add)
    stretch = W.partitionBy("_at").orderBy(wraps, F.col("_extra").cast("int"), F.desc_nulls_last(key), *value)
    out = dealt.withColumn("next", F.lead(F.struct(*value, *add)).over(stretch))
    return out.where(~F.col("_extra")).drop("_at", "_extra")
