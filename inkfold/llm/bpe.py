"""Byte-level BPE with Spark's higher-order functions.

A text is cut by a pattern; each piece of it ("word") is encoded by itself. Within a task, rows go through three steps
that are one stage, so nothing is shuffled, collected or written between them:

1. an Arrow step cuts the texts and numbers words: a word that is one token has its id, every other one its place
   among the words that the task has met, and goes out as a small row of its own when it is met first;
2. a fold of higher-order functions encodes each such word: the state is an array with the id of each piece (a byte at
   first) and the rank of the pair that it makes with the next one; each step joins the leftmost pair of least rank and
   looks up the two ranks that change. The ranks are the value of a scalar subquery, two arrays in which the rows of the
   pairs' table are laid over each other, so that a lookup is two accesses for any vocabulary. Plans name a subquery, but
   spell a literal out, megabytes that the driver keeps for each execution;
3. an Arrow step holds the ids of the words met and puts those of each document together.

Decoding looks up the bytes of each id and joins them, in an Arrow step.

Steps 1 and 3 hold at most about ``most_words`` words; a task that meets more forgets all of them and folds those that
come again once more. Besides them a task holds ``chunk`` words of documents, or one document. Ids have up to 20 bits.

A word of more than ``LONG`` bytes is folded in overlapping windows. Pieces only grow, and no merge crosses an end of a
piece of the result; so if the result of A + B has an end between A and B, it is that of A and that of B. And if that holds
for all neighbours in a row of parts, it holds for the row: the first merge across a border would have been made in its two
neighbours alone, too. A window begins where a part ends, and the next part ends where its result and the one of the window
before both have an end, which shows this for two neighbours each. So 100,000 letters take seconds. Where
windows agree on no end, wider ones are tried; then the word is folded whole, its state in blocks whose least entries are kept, so that a step costs about
the root of the word's length.

Nulls: a null text is an empty one and has no ids. Invalid UTF-8 counts as U+FFFD. Rows are encoded one by one, so
ties, repeated rows and other columns don't matter (those named like the new ones are replaced); other columns must be
of types that Arrow has. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.llm.common import lean, small_batches, trim

#: A task holds about so many words that aren't tokens, some 0.1 GB, and so many words of documents.
MOST_WORDS, CHUNK = 1 << 19, 1 << 17
#: Words of more bytes are folded in windows of so many bytes.
LONG, WINDOW = 256, 128
#: Bits of an id. An entry of the fold's state is the piece's id, above it (from this bit on) the rank of its pair with the next one.
_RANK = 20
#: A pair without a rank has a bit from here on.
_NONE = 41
#: The bit that marks the last piece of a word.
_LAST = 1 << 62
_ID = (1 << _RANK) - 1
#: White space as the reference implementation's regular expressions know it (Unicode's White_Space).
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by bytes from a file of lines "base64 rank"."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def spelled_out(pattern: str) -> str:
    """The pattern with its white space spelled out, as \\s differs between regular expressions."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == r"\S":
            if inside:
                raise ValueError(r"\S within brackets isn't supported")
            out.append(f"[^{_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


class PairTable:
    """Ranks of pairs of ids as two arrays.

    The entry of pair (a, b) lies in ``entries`` at shift[a] + b and names a, as entries of other ids lie between those
    of a: ``entries[shift[a] + b] ^ owner(a)`` is the pair's rank above the id a, or more than any rank.
    """

    #: owner(a) is a times this.
    OWNER = (1 << _NONE) + 1

    def __init__(self, ranks: dict[tuple[int, int], int], ids: int) -> None:
        rows: dict[int, list[int]] = {}
        for a, b in ranks:
            rows.setdefault(a, []).append(b)
        taken = np.zeros(2 * len(ranks) + 4 * ids + 8192, bool)
        taken[:ids] = True  # shift[a] isn't negative
        self.shift = np.zeros(ids, np.int64)
        free = ids
        for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            bs = np.array(sorted(row))
            free += int(np.argmin(taken[free:]))
            # The first place where all entries fit, looked for among 4,096 places at a time.
            at, fits = free, ~taken[free : free + 4096]
            while True:
                for b in (bs[1:] - bs[0]).tolist():
                    fits &= ~taken[at + b : at + b + 4096]
                if fits.any():
                    at += int(np.argmax(fits))
                    break
                at += 4096
                fits = ~taken[at : at + 4096]
            taken[at - bs[0] + bs] = True
            self.shift[a] = at - bs[0]
        size = int(self.shift.max()) + ids
        self.entries = np.full(size, ids << _NONE, np.int64)
        for (a, b), rank in ranks.items():
            self.entries[self.shift[a] + b] = (a << _NONE) + (rank << _RANK)

    def state(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.entries[self.shift[a] + b] ^ a * self.OWNER


def _let(value: Column, body) -> Column:
    """body(value), where value is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(start: Column, entries: Column, shift: Column, lengths: Column, long: int = LONG, window: int = WINDOW) -> Column:
    """The ids of a word from its first state; null for null. lengths: bytes of each id."""

    def state(a: Column, b: Column) -> Column:
        return F.get(entries, F.get(shift, a) + b).bitwiseXOR(a * F.lit(PairTable.OWNER))

    def merge(q: Column, least: Column) -> Column:
        def at(i: Column) -> Column:
            new = F.shiftright(F.get(q, i), _RANK)
            this = F.when(i + 2 < F.size(q), state(new, F.get(q, i + 2).bitwiseAND(_ID))).otherwise(new + F.lit(_LAST))
            before = state(F.get(q, i - 1).bitwiseAND(_ID), new)
            places = F.sequence(F.lit(0), F.size(q) - 2)
            # One pass is cheaper than slices that are put together again.
            return F.transform(places, lambda j: F.when(j < i - 1, F.get(q, j)).when(j > i, F.get(q, j + 1)).when(j == i, this).otherwise(before))

        return _let(F.array_position(q, least).cast("int") - 1, at)

    def step(q: Column, _: Column) -> Column:
        return F.when(F.array_min(q) < F.lit(1 << _NONE), merge(q, F.array_min(q))).otherwise(q)

    def blocks(q: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(q) - 1) / size).cast("int")), lambda j: F.slice(q, j * size + 1, size))

    def with_least(b: Column) -> Column:
        return _let(b, lambda x: F.struct(x.alias("blocks"), F.transform(x, F.array_min).alias("least")))

    def replaced(whole: Column, k: Column, part: Column) -> Column:
        return F.flatten(F.array(F.slice(whole, F.lit(1), k - 1), part, F.slice(whole, k + 4, F.lit(1 << 30))))

    def block_step(size: Column):
        def stepped(s: Column, _: Column) -> Column:
            def at(k: Column) -> Column:
                # The pair may end in the next block, and touches a piece of the one before and of the second next. Blocks are never empty.
                new = _let(F.flatten(F.slice(s["blocks"], k, F.lit(4))), lambda q: blocks(merge(q, F.array_min(s["least"])), size))
                return _let(with_least(new), lambda n: F.struct(
                    replaced(s["blocks"], k, n["blocks"]).alias("blocks"), replaced(s["least"], k, n["least"]).alias("least")
                ))

            first = F.greatest(F.lit(1), F.array_position(s["least"], F.array_min(s["least"])).cast("int") - 1)
            return F.when(F.array_min(s["least"]) < F.lit(1 << _NONE), _let(first, at)).otherwise(s)

        return stepped

    def in_blocks(size: Column) -> Column:
        return F.flatten(F.aggregate(start, with_least(blocks(start, size)), block_step(size))["blocks"])

    def in_windows(width: int) -> Column:
        """The state, if windows agree on ends of pieces; else null."""
        size, half = F.size(start), width // 2
        # The last window's result stands apart from out, since _let() copies what it returns.
        kind = "struct<last:struct<at:int,before:array<int>,part:array<bigint>>,out:array<array<bigint>>>"

        def stepped(s: Column, _: Column) -> Column:
            at, before = s["last"]["at"], s["last"]["before"]

            def of_window(w: Column) -> Column:
                last = F.array(F.element_at(w, -1).bitwiseAND(_ID) + F.lit(_LAST))
                alone = F.flatten(F.array(F.slice(w, F.lit(1), F.size(w) - 1), last))
                return _let(_let(alone, lambda q: F.aggregate(q, q, step)), with_ends)

            def with_ends(q: Column) -> Column:
                sizes = F.transform(q, lambda x: F.get(lengths, x.bitwiseAND(_ID).cast("int")))
                ends = _let(sizes, lambda z: F.transform(z, lambda _, i: F.aggregate(F.slice(z, F.lit(1), i + 1), at, lambda a, b: a + b)))
                return _let(ends, lambda e: cut(q, e))

            def cut(q: Column, ends: Column) -> Column:
                agreed = F.filter(ends, lambda e: ((e <= at + half) | (e == size)) & ((at == 0) | F.array_contains(before, e)))
                # Without a common end it stops behind the end.
                return _let(F.coalesce(F.array_max(agreed), size + 1), lambda to: F.struct(
                    to.alias("at"), ends.alias("before"), F.slice(q, F.lit(1), F.array_position(ends, to).cast("int")).alias("part")
                ))

            # slice() would go through the whole word.
            part = F.transform(F.sequence(F.lit(0), F.least(size - at, F.lit(width)) - 1), lambda i: F.get(start, at + i))
            return F.when(at < size, F.struct(_let(part, of_window).alias("last"), F.array_append(s["out"], s["last"]["part"]).alias("out"))).otherwise(s)

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"), F.array().cast("array<bigint>").alias("part"))
        begin = F.struct(none.alias("last"), F.array().cast("array<array<bigint>>").alias("out")).cast(kind)
        steps = F.sequence(F.lit(1), F.floor(size * 8 / width).cast("int") + 8)
        return F.aggregate(steps, begin, stepped, lambda s: F.when(s["last"]["at"] == size, F.flatten(F.array_append(s["out"], s["last"]["part"]))))

    root = F.greatest(F.lit(64), F.floor(F.sqrt(F.size(start).cast("double")) / 2).cast("int"))
    ids = F.when(F.size(start) <= long, F.aggregate(start, start, step)).when(F.size(start) > long, F.coalesce(in_windows(window), in_windows(8 * window), _let(root, in_blocks)))
    return F.transform(ids, lambda x: x.bitwiseAND(_ID).cast("int"))


#: What encode() can return of a text.
OUTPUTS: dict[str, T.DataType] = {"ids": T.ArrayType(T.IntegerType()), "count": T.LongType(), "written": T.StringType(), "decoded": T.BinaryType()}


class ByteBpe:
    """An encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        most = max(ranks.values())
        if most > _ID:
            raise ValueError(f"an id of more than {_RANK} bits: {most}")
        self.pattern = spelled_out(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)])
        # Every way to cut a token into two tokens.
        cuts = {(ranks[k[:i]], ranks[k[i:]]): v for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.pairs = PairTable(cuts, most + 1)
        # What is a word by itself: a whole token.
        self.whole: dict[str, int] = {}
        for k, v in ranks.items():
            try:
                self.whole[k.decode("utf-8")] = v
            except UnicodeDecodeError:
                continue
        self.pieces = [b""] * (most + 1)
        for k, v in ranks.items():
            self.pieces[v] = k
        del cuts
        trim()

    def encode(
        self, df: DataFrame, text_col: str = "text", out: dict[str, str] | None = None, *, drop: tuple[str, ...] = (),
        most_words: int = MOST_WORDS, chunk: int = CHUNK, long: int = LONG, window: int = WINDOW,
    ) -> DataFrame:
        """df without the columns of drop and with those of out, by name what they hold of a text (OUTPUTS): its ids (the
        default, as "ids"), their count, the ids written as decimal numbers with commas between, or the bytes decoded from the ids."""
        out = out or {"ids": "ids"}
        small_batches(df.sparkSession)
        kept = [c for c in df.columns if c not in (*out, *drop)]
        row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
        cut = df.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
        schema = T.StructType([
            T.StructField("row", cut.schema["row"].dataType),
            T.StructField("numbers", T.BinaryType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("start", T.ArrayType(T.LongType())),
        ])
        numbered = cut.mapInArrow(lean(_numbering(self.whole, self.pattern, self.bytes, self.pairs, most_words, chunk)), schema)
        start = F.col("start")

        def of_word(t: Column) -> Column:
            # Each array taken out of the row once.
            return _let(t["entries"], lambda e: _let(t["shift"], lambda s: _let(t["lengths"], lambda n: fold(start, e, s, n, long, window))))

        # A subquery has to be a column before it gets into higher-order functions. The optimiser puts it in for the column, whose one use this is.
        ranked = numbered.withColumn("ranks", self._ranks(df.sparkSession))
        folded = ranked.select("row", "numbers", "place", F.when(start.isNotNull(), _let(F.col("ranks"), of_word)).alias("ids"))
        fields = [T.StructField(f.name, f.dataType) for f in cut.schema["row"].dataType.fields] if kept else []
        fields += [T.StructField(c, OUTPUTS[what]) for c, what in out.items()]
        tables = {what: self._table(what) for what in ("written", "decoded") if what in out.values()}
        return folded.mapInArrow(lean(_joining(kept, out, tables, chunk)), T.StructType(fields))

    def _ranks(self, spark: SparkSession) -> Column:
        """What fold() looks up (entries, shift, lengths), by a subquery of one row."""
        lengths = np.array([len(x) for x in self.pieces], np.int32)
        made = {"entries": self.pairs.entries, "shift": self.pairs.shift, "lengths": lengths}
        row = spark.createDataFrame(pa.table({k: pa.array([v], pa.list_(pa.from_numpy_dtype(v.dtype))) for k, v in made.items()}))
        return row.select(F.struct(*made).alias("ranks")).scalar()

    def _table(self, what: str) -> tuple[list[bytes], bytes]:
        """What stands for each id, and between two of them."""
        return ([str(i).encode() for i in range(len(self.pieces))], b",") if what == "written" else (self.pieces, b"")

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids; an id of no token has none."""
        pieces, between = self._table("decoded")

        @F.arrow_udf("binary")
        def decoded(some: pa.Array) -> pa.Array:
            return pc.if_else(some.is_valid(), concatenated(some, pa.array(pieces, pa.binary()), between), None)

        return decoded(ids)


def concatenated(ids: pa.ListArray, pieces: pa.Array, between: bytes) -> pa.Array:
    """The pieces of each list of ids, joined."""
    flat = ids.flatten()
    if flat.null_count or len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(pieces):
        flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), flat, None)
    parts = pieces.take(flat)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(ends, pc.fill_null(parts, b"") if parts.null_count else parts), between)


def _numbering(whole: dict[str, int], pattern: str, first: np.ndarray, pairs: PairTable, most_words: int, chunk: int):
    """An Arrow step from rows with texts to rows of words (place, start) and of documents (row, numbers). A word's row
    comes before those that need it. Place 0 means that all words before are forgotten."""

    def states(words: list[bytes]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
        piece = first[np.frombuffer(b"".join(words), np.uint8)]
        out = piece + _LAST
        inner = np.ones(len(piece), bool)
        inner[ends[1:] - 1] = False
        at = np.flatnonzero(inner)
        out[at] = pairs.state(piece[at], piece[at + 1])
        return pa.ListArray.from_arrays(ends, pa.array(out))

    names = ["row", "numbers", "place", "start"]

    def of_words(words: list[bytes], place: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), 1 << 14):
            some = words[at : at + (1 << 14)]
            n = len(some)
            places = pa.array(np.arange(place + at, place + at + n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.binary()), places, states(some)], names)

    def of_documents(rows: pa.Array, numbers: list[bytes]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([rows, pa.array(numbers, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names)

    class Known(dict):
        """Numbers of words: a new one gets the next place."""

        def __init__(self) -> None:
            super().__init__(whole)
            self.met: list[str] = []

        def __missing__(self, word: str) -> int:
            self.met.append(word)
            n = self[word] = -len(self.met)
            return n

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        known = Known()
        told = held = 0  # words told of, words of documents that wait
        for batch in batches:
            rows, begin, numbers = batch.column("row"), 0, []
            texts = batch.column("text")
            for i in range(len(texts)):
                at = list(map(known.__getitem__, find((texts[i].as_py() or b"").decode("utf-8", "replace"))))
                numbers.append(np.array(at, np.int32).tobytes())
                held += len(at)
                full = len(known.met) >= most_words
                if held >= chunk or full or i + 1 == len(texts):
                    yield from of_words([w.encode() for w in known.met[told:]], told, rows.type)
                    yield of_documents(rows.slice(begin, i + 1 - begin), numbers)
                    begin, numbers, held, told = i + 1, [], 0, len(known.met)
                    if full:
                        known, told = Known(), 0

    return numbered


def _joining(kept: list[str], out: dict[str, str], tables: dict[str, tuple[list[bytes], bytes]], chunk: int):
    """An Arrow step from rows of words (place, ids) and of documents (row, numbers) to documents with ids and what out says."""

    class Words:
        """The ids of words by place."""

        def __init__(self) -> None:
            self.ids, self.ends = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
            self.n = 0

        def add(self, lists: pa.ListArray) -> None:
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = self.ends[self.n] + np.cumsum(sizes)
            while len(self.ends) <= self.n + len(sizes):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
            while len(self.ids) < ends[-1]:
                self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.int32)])
            self.ids[self.ends[self.n] : ends[-1]] = lists.flatten().to_numpy(zero_copy_only=False)
            self.ends[self.n + 1 : self.n + 1 + len(sizes)] = ends
            self.n += len(sizes)

        def of(self, numbers: pa.Array) -> pa.ListArray:
            at = np.frombuffer(b"".join(numbers.to_pylist()), np.int32)
            rare = at < 0
            place = -1 - at[rare].astype(np.int64)
            begin, count = self.ends[place], self.ends[place + 1] - self.ends[place]
            sizes = np.ones(len(at), np.int64)
            sizes[rare] = count
            ends = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(ends[-1], np.int32)
            out[ends[:-1][~rare]] = at[~rare]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out[np.repeat(ends[:-1][rare], count) + within] = self.ids[np.repeat(begin, count) + within]
            documents = np.concatenate([[0], np.cumsum(pc.binary_length(numbers).to_numpy(zero_copy_only=False) // 4)])
            return pa.ListArray.from_arrays(pa.array(ends[documents].astype(np.int32)), pa.array(out))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        stands = {what: (pa.array(pieces, pa.binary()), between) for what, (pieces, between) in tables.items()}

        def cell(ids: pa.ListArray, what: str) -> pa.Array:
            if what == "ids":
                return ids
            if what == "count":
                return pc.cast(pc.list_value_length(ids), pa.int64())
            made = concatenated(ids, *stands[what])
            return pc.cast(made, pa.string()) if what == "written" else made

        for batch in batches:
            place = pc.fill_null(batch.column("place"), -1).to_numpy(zero_copy_only=False)
            # Runs of words and of documents, and a new one where words are forgotten.
            cuts = np.flatnonzero((place[1:] == 0) | ((place[1:] < 0) != (place[:-1] < 0))) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if place[a] >= 0:
                    if place[a] == 0:
                        words = Words()
                    words.add(part.column("ids"))
                    continue
                rows, numbers = part.column("row"), part.column("numbers")
                for lo, hi in _slices(pc.binary_length(numbers).to_numpy(zero_copy_only=False) // 4, chunk):
                    ids = words.of(numbers.slice(lo, hi - lo))
                    cells = rows.slice(lo, hi - lo).flatten() if kept else []
                    yield pa.RecordBatch.from_arrays([*cells, *(cell(ids, what) for what in out.values())], [*kept, *out])

    return joined


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes come to about most."""
    group = np.cumsum(sizes) // most
    cuts = (np.flatnonzero(np.diff(group)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(sizes)], strict=True)
