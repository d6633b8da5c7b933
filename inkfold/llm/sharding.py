"""Shards of nearly equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by a 63-bit key: bits of the text's hash, then of the id's hash, then a row's own, so that equal texts
are neighbours and yet a group of copies of any size can be cut, even of rows that are equal. The cuts are found by counting
exact bytes below candidate boundaries: each round halves every open interval ``bits`` times, counts the bytes of its
parts over all partitions, and goes on in the part that holds the target, until a cut falls on a single key or
within ``tolerance`` of a shard. A round moves one row for each part of an interval and task. Then rows are
exchanged once, by piece (a shard has several pieces, so a task never holds a whole shard), and numbered.

A cut's key is the smallest one at which the running sum of bytes reaches the target. Where this cut would part a group
of equal texts that has no more bytes than ``slack`` of a shard or a quarter of the largest row, it moves to the nearer end of the group; larger groups
are parted, and their rows say so in ``group_split``. So a shard differs from the mean by less than such a group
and the largest row (with tolerance 0).

Nulls: a null text has no bytes (its row's size is the 16 of overhead) and the key of the empty text; null ids
are rows like others. Rows with the same id and text are told apart by their place in the table. Ties of the key are
numbered by id and text. A text of any length is one row. Other columns aren't read, so their names don't matter. An
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkfold.llm.common import materialise, octets

OVERHEAD = 16
#: Bits of the text's hash, of the id's, and of a row's own.
TEXT_BITS, ID_BITS, ROW_BITS = 30, 21, 12
KEY_BITS = TEXT_BITS + ID_BITS + ROW_BITS
GROUP_SHIFT = ID_BITS + ROW_BITS
#: Pieces of a shard: one for so many rows, within these bounds.
PIECE_ROWS, LEAST_PIECES, MOST_PIECES = 500_000, 4, 64


def order_key(text: Column, row_id: Column, row: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - TEXT_BITS)
    middle = F.shiftrightunsigned(F.xxhash64(row_id, F.lit(1)), 64 - ID_BITS)
    low = F.shiftrightunsigned(F.xxhash64(row, F.lit(2)), 64 - ROW_BITS)
    return F.shiftleft(high, GROUP_SHIFT).bitwiseOR(F.shiftleft(middle, ROW_BITS)).bitwiseOR(low)


def find_cuts(keyed: DataFrame, cuts: int, *, first_bits: int = 12, bits: int = 8, tolerance: float = 0.0) -> list[int]:
    """The keys at which cuts + 1 parts of nearly equal bytes end; keyed has (key long, size long).

    What comes to the driver is 2**first_bits sums, then at most cuts * 2**bits of each round.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    found: dict[int, int] = {}
    #: Of each open cut: its interval's number at this shift, and the bytes below the interval.
    open_cuts = dict.fromkeys(range(1, cuts + 1), (0, 0))
    shift = KEY_BITS
    while open_cuts:
        finer = max(0, shift - (first_bits if shift == KEY_BITS else bits))
        inside = sorted({interval for interval, _ in open_cuts.values()})
        part = F.shiftright("key", finer)
        rows = keyed if shift == KEY_BITS else keyed.where(F.shiftright("key", shift).isin(inside))
        counted = (
            rows.groupBy(part.alias("part"))
            .agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .orderBy("part")
            .collect()
        )
        by_interval: dict[int, list] = {}
        for r in counted:
            by_interval.setdefault(r["part"] >> (shift - finer), []).append(r)
        for cut, (interval, below) in list(open_cuts.items()):
            parts = by_interval[interval]
            ends = list(accumulate((r["bytes"] for r in parts), initial=below))
            # The first part whose end reaches total * cut / (cuts + 1), in integers.
            at = bisect_left(ends, -(-total * cut // (cuts + 1)), lo=1) - 1
            r = parts[at]
            if r["lo"] == r["hi"] or r["bytes"] <= tolerance * total / (cuts + 1):
                found[cut] = r["hi"]
                del open_cuts[cut]
            else:
                open_cuts[cut] = (r["part"], ends[at])
        shift = finer
    return [found[c] for c in range(1, cuts + 1)]


def at_group_ends(keyed: DataFrame, cuts: list[int], slack: int) -> tuple[list[int], list[int]]:
    """The cuts, moved out of groups of at most slack bytes to their nearer end, and the groups that are parted still."""
    if not cuts:
        return [], []
    group = F.shiftright("key", GROUP_SHIFT)
    inside = keyed.where(group.isin(sorted({c >> GROUP_SHIFT for c in cuts})))
    below = [F.sum(F.when(F.col("key") <= c, F.col("size")).otherwise(0)) for c in cuts]
    # One row for each group that a cut is in.
    rows = inside.groupBy(group.alias("part")).agg(F.sum("size").alias("bytes"), F.max("key").alias("hi"), F.array(*below).alias("below")).collect()
    groups = {r["part"]: r for r in rows}
    moved, parted = [], set()
    for i, c in enumerate(cuts):
        g = groups[c >> GROUP_SHIFT]
        left = g["below"][i]
        if left == g["bytes"]:
            moved.append(c)
        elif g["bytes"] > slack:
            moved.append(c)
            parted.add(g["part"])
        else:
            moved.append(g["hi"] if 2 * left >= g["bytes"] else (g["part"] << GROUP_SHIFT) - 1)
    return moved, sorted(parted)


def shard(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shards: int = 40,
    pieces: int | None = None,
    tolerance: float = 0.0,
    slack: float = 0.04,
) -> DataFrame:
    """(id, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, group_split boolean) for each row of df.

    law is "bytes". Slots of a shard count from 0 without gaps, in the order of the key.
    """
    text = F.col(text_col).cast("string")
    # Written once, so a row's own bits are fixed.
    keyed = materialise(
        df.select(
            F.col(id_col),
            (octets(text) + OVERHEAD).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            order_key(text, F.col(id_col), F.monotonically_increasing_id()).alias("key"),
        )
    )
    whole = keyed.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("most")).first()
    if pieces is None:
        pieces = min(MOST_PIECES, max(LEAST_PIECES, -(-whole["rows"] // (shards * PIECE_ROWS))))
    ends = find_cuts(keyed.select("key", "size"), shards * pieces - 1, tolerance=tolerance)
    parted: list[int] = []
    if ends:
        at = list(range(pieces - 1, len(ends), pieces))
        moved, parted = at_group_ends(keyed, [ends[i] for i in at], max(whole["most"] // 4, int(slack * whole["bytes"] / shards)))
        for i, (a, b) in enumerate(zip([-1, *moved], [*moved, 2**63 - 1], strict=True)):
            # Cuts within a shard stay between its ends.
            inner = range(i * pieces, min(len(ends), (i + 1) * pieces - 1))
            ends[inner.start : inner.stop] = [min(max(ends[j], a), b) for j in inner]
            if i < len(moved):
                ends[at[i]] = moved[i]
        by_shard = F.array(*[F.array(*[F.lit(k).cast("long") for k in ends[p : p + pieces - 1]]).cast("array<long>") for p in range(0, shards * pieces, pieces)])
        cuts = F.array(*[F.lit(k).cast("long") for k in moved])
        own = F.size(F.filter(cuts, lambda k: k < F.col("key")))
        piece = own * pieces + F.size(F.filter(F.element_at(by_shard, own + 1), lambda k: k < F.col("key")))
    else:
        piece = F.lit(0)
    placed = keyed.withColumn("piece", piece)
    # Rows before each piece within its shard: at most shards * pieces numbers.
    rows = {r["piece"]: r["count"] for r in placed.groupBy("piece").count().collect()}
    before = [sum(rows.get(q, 0) for q in range(p - p % pieces, p)) for p in range(shards * pieces)]
    number = F.row_number().over(Window.partitionBy("piece").orderBy("key", id_col, "text_crc32"))
    return placed.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("piece") / pieces).cast("int").alias("shard"),
        (number - 1 + F.element_at(F.array([F.lit(b).cast("long") for b in before]), F.col("piece") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.shiftright("key", GROUP_SHIFT).isin(parted).alias("group_split"),
    )
