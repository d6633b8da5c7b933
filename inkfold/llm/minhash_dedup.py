"""Near-duplicate texts: MinHash signatures joined by their Hamming distance through a multi-index.

A text's set is its distinct word shingles. A signature has ``SYMBOLS`` minhashes of ``b`` = 16 bits. Two
signatures are compared if at most ``MAX_DISTANCE`` of their symbols differ; of the ``CHUNKS`` chunks of a
signature, by the pigeonhole principle, at least one then differs in at most one symbol. So every chunk is
entered into the index once for each symbol that may be wrong, with that symbol masked: two signatures
within the distance share such an entry, always. At similarity 0.8 a symbol differs with probability 0.2
and the distance exceeds 15 of 32 with probability 0.0001.

Links are confirmed on full sets (64-bit hashes of all shingles) in integers. To lose no link without
comparing all pairs of a large group:

1. texts with equal sets are one vertex, so copies are never paired;
2. in each entry of the index, all members are confirmed against the least one (a star), and linked
   vertices become components;
3. in entries whose members still lie in different components, all pairs across components within the
   signature distance are found and their members tied together to clusters, and in a cluster all such pairs are
   confirmed. A pair inside one component changes nothing and is skipped. No pair is ever a row in this step.
   Blocks of a group's largest component aren't paired with each other.

Entries of more than ``BLOCK`` members and clusters of more than ``SET_BLOCK`` are dealt in pairs of blocks to
different tasks.

Nulls: a null text, an empty one and one without words have an empty set and link with nothing, whatever other rows
their id has. Rows with a null id link with nothing. Rows of one id are one document: their texts are linked, if not
empty, and have one component. Repeated rows stay rows. A text of any length is hashed whole. Columns of any other name
don't matter, as only id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import in_parts, label_join, lean, materialise, release, sized_join, small_batches
from inkfold.llm.components import connected_components
from inkfold.llm.runs import column, fixed_binary, key_runs, run_starts

CHUNKS, PER_CHUNK = 8, 4
SYMBOLS = CHUNKS * PER_CHUNK
#: The most symbols that may differ; every chunk may then have one error: 2 * CHUNKS - 1.
MAX_DISTANCE = 2 * CHUNKS - 1
BLOCK = 1024
#: Members of a cluster whose full sets one task compares with as many others.
SET_BLOCK = 512
#: Of the members of entries, one in SAMPLE is looked at to find entries worth dealing out. This moves work
#: between tasks and changes no result.
SAMPLE, HOT_ENTRIES = 64, 256
#: Tasks among which the members of a star of more than BLOCK are dealt.
PARTS = 64

_rng = np.random.default_rng(2)
_MULTIPLY = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0x9FB21C651E98DF25)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Longer words are hashed one by one.
LONG_WORD = 64
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all 64 bits; one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of raw, a step for each byte position over all words that long."""
    h = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    lens = ends - starts
    live = np.arange(len(starts))
    for k in range(min(int(lens.max(initial=0)), LONG_WORD)):
        live = live[lens[live] > k]
        x = (h[live] ^ _BYTE[raw[starts[live] + k]]) * np.uint64(0x9FB21C651E98DF25)
        h[live] = x ^ (x >> np.uint64(29))
    for i in np.flatnonzero(lens > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return h


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its word shingles; with fewer words, the whole
    sequence is the only one. Texts are hashed together, about a megabyte at a time."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass").lower())  # of bytes: A-Z only
        size += len(held[-1]) + 1
        if size >= 1 << 20:
            yield from _sets(held, words)
            held, size = [], 0
    yield from _sets(held, words)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.concatenate(([False], _IN_WORD[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    h = _word_hashes(raw, starts, ends)
    first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    window = np.full(max(0, len(h) - words + 1), words, np.uint64)
    for i in range(words):
        window = _mixed(window + h[i : i + len(window)] * _PLACE[i % 64])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            yield np.unique(window[a : b - words + 1])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for i in range(b - a):
                x = _mixed(x + h[a + i : a + i + 1] * _PLACE[i % 64])
            yield x
        else:
            yield np.empty(0, np.uint64)


def set_name(members: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    if not len(members):
        return 0, 0
    return int(_mixed(members).sum().view(np.int64)), int(_mixed(members ^ _SECOND).sum().view(np.int64))


def signature(members: np.ndarray) -> bytes:
    least = np.full(SYMBOLS, np.uint64(2**64 - 1))
    for at in range(0, len(members), 4096):
        np.minimum(least, (_MULTIPLY[:, None] * members[None, at : at + 4096]).min(axis=1), out=least)
    return (_mixed(least) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def signatures(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id long, n_shingles long, hi long, lo long, sig binary): hi and lo name the set, sig is null if empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "text"):
            sizes, hi, lo, sigs = [], [], [], []
            for s in shingle_sets(b["text"].to_pylist(), words):
                sizes.append(len(s))
                name = set_name(s)
                hi.append(name[0])
                lo.append(name[1])
                sigs.append(signature(s) if len(s) else None)
            yield pa.record_batch(
                [b["id"], pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sigs, pa.binary())],
                names=["id", "n_shingles", "hi", "lo", "sig"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(sign), "id long, n_shingles long, hi long, lo long, sig binary")


def index_entries(sig: np.ndarray) -> np.ndarray:
    """Keys of the index, shape (signatures, SYMBOLS): of each chunk with each one of its symbols masked."""
    s = sig.astype(np.uint64)
    keys = np.empty(s.shape, np.uint64)
    for c in range(CHUNKS):
        for masked in range(PER_CHUNK):
            h = np.full(len(s), c * PER_CHUNK + masked + 1, np.uint64)
            for i in range(PER_CHUNK):
                if i != masked:
                    h = _mixed(h ^ (s[:, c * PER_CHUNK + i] << np.uint64(20)))
            keys[:, c * PER_CHUNK + masked] = h
    return keys.view(np.int64)


def _entries(classes: DataFrame) -> DataFrame:
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                keys = index_entries(fixed_binary(b, "sig", np.uint16, SYMBOLS))
                yield pa.record_batch(
                    [pa.array(keys.ravel()), pa.array(np.repeat(column(b, "rep"), SYMBOLS))], names=["entry", "rep"]
                )

    return classes.select("rep", "sig").mapInArrow(lean(enter), "entry long, rep long")


def _shared(entries: DataFrame, hot: list[int]) -> DataFrame:
    """(entry, part, rep, centre): members of entries that have at least two; hot entries are dealt in many parts.

    The index is made once: its rows go through one exchange whether their entries are hot or not."""
    known = np.sort(np.array(hot, np.int64))
    parts = F.when(F.col("entry").isin(hot), F.pmod(F.xxhash64("rep"), F.lit(SAMPLE))) if hot else F.lit(0)
    dealt = entries.withColumn("part", F.coalesce(parts, F.lit(0)).cast("int"))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[int, int, int] | None = None  # the run that goes on: entry, part, its least member
        alone = False  # whether that member hasn't been returned yet
        for b in batches:
            if not b.num_rows:
                continue
            entry, part, rep = column(b, "entry"), column(b, "part"), column(b, "rep")
            starts = run_starts(b, ["entry", "part"])
            lens = np.diff(np.append(starts, len(rep)))
            centre = np.repeat(rep[starts], lens)
            goes_on = first is not None and first[:2] == (entry[0], part[0])
            # A part of a hot entry may have one member, whose partners are in other parts: all of them stay.
            many = np.isin(entry[starts], known)
            keep = np.repeat((lens > 1) | many, lens)
            extra = []
            if goes_on:
                centre[: lens[0]] = first[2]
                keep[: lens[0]] = True
                if alone:
                    extra = [(first[0], first[1], first[2], first[2])]
            still = len(lens) == 1 and goes_on
            # A lone last member waits: its partner may come with the next batch.
            alone = lens[-1] == 1 and not still and not many[-1]
            first = first if still else (entry[-1], part[-1], int(rep[starts[-1]]))
            cols = [entry[keep], part[keep], rep[keep], centre[keep]]
            if extra:
                cols = [np.concatenate([np.array([e], dtype=c.dtype), c]) for e, c in zip(extra[0], cols, strict=True)]
            if len(cols[0]):
                yield pa.record_batch([pa.array(c) for c in cols], names=["entry", "part", "rep", "centre"])

    return (
        dealt.repartition("entry", "part").sortWithinPartitions("entry", "part", "rep")
        .mapInArrow(lean(star), "entry long, part int, rep long, centre long")
    )


def _full_sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, members binary) of the classes whose rep is wanted: their shingles' hashes, sorted.

    A class's set is read from rows with its least id; where such an id has other texts too, their sets are left out."""
    mine = materialise(sized_join(classes.select("rep", "least", "hi", "lo"), wanted, "rep", "left_semi"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "text"):
            made = [s for s in shingle_sets(b["text"].to_pylist(), words)]
            names = [set_name(s) for s in made]
            cells = [pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)]
            yield pa.record_batch([*cells, pa.array([s.tobytes() for s in made], pa.binary())], names=["hi", "lo", "members"])

    ids = materialise(mine.select(F.col("least").alias("id")).distinct())
    found = sized_join(texts, ids, "id", "left_semi").mapInArrow(lean(sets), "hi long, lo long, members binary").where("octet_length(members) > 0")
    return sized_join(found, mine.select("rep", "hi", "lo"), ["hi", "lo"], "inner").select("rep", "members").dropDuplicates(["rep"])


def _stars(pairs: DataFrame, payload: DataFrame, check) -> DataFrame:
    """Of pairs (a, b) those that check() lets through; payload has a row for each rep.

    Rows of one a are dealt to a task, or to PARTS of them beyond BLOCK; a's payload goes to each of them once, before those
    of its b. check(rows, centre) gets a table with payloads and for each of its rows the index of its a's row."""
    hot = materialise(pairs.groupBy("a").count().where(F.col("count") >= BLOCK).select("a", F.lit(True).alias("hot")))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(PARTS))).otherwise(0).cast("int")
    dealt = sized_join(pairs, hot, "a", "left").select("a", part.alias("part"), "b")
    rows = dealt.unionByName(dealt.select("a", "part").distinct().withColumn("b", F.col("a")))
    rows = rows.join(payload.withColumnRenamed("rep", "b"), "b").withColumn("other", (F.col("a") != F.col("b")).cast("int"))
    keys = ["a", "part"]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the row of the a whose rows go on
        for b in batches:
            if not b.num_rows:
                continue
            starts = run_starts(b, keys)
            lens = np.diff(np.append(starts, b.num_rows))
            goes_on = held is not None and all(held[k][0].as_py() == b[k][0].as_py() for k in keys)
            first = int(goes_on)
            centre = np.repeat(starts + first, lens)
            if goes_on:
                centre[: lens[0]] = 0
            table = pa.Table.from_batches([held, b] if goes_on else [b])
            ok = np.zeros(table.num_rows, bool)
            ok[first:] = column(b, "other") == 1
            at = np.flatnonzero(ok)
            at = at[check(table, at, centre[at - first])]
            if len(at):
                yield from table.select(["a", "b"]).take(pa.array(at)).combine_chunks().to_batches()
            if not (goes_on and len(starts) == 1):
                held = b.slice(int(starts[-1]), 1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "other").mapInArrow(lean(checked), "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those within the signature distance whose full sets have 100 * both >= percent * either."""

    def near(rows: pa.Table, at: np.ndarray, centre: np.ndarray) -> np.ndarray:
        sig, n = fixed_binary(rows, "sig", np.uint16, SYMBOLS), column(rows, "n_shingles")
        ok = (sig[at] != sig[centre]).sum(axis=1) <= MAX_DISTANCE
        return ok & (100 * np.minimum(n[at], n[centre]) >= percent * np.maximum(n[at], n[centre]))

    close = materialise(_stars(pairs, classes.select("rep", "sig", "n_shingles"), near))
    wanted = materialise(close.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    full = materialise(_full_sets(texts, classes, wanted, words))

    def confirm(rows: pa.Table, at: np.ndarray, centre: np.ndarray) -> np.ndarray:
        members, ok = rows["members"].combine_chunks(), np.zeros(len(at), bool)
        of = -1
        for k, (i, c) in enumerate(zip(at.tolist(), centre.tolist(), strict=True)):
            if c != of:
                x, of = np.frombuffer(members[c].as_buffer(), np.uint64), c
            y = np.frombuffer(members[i].as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
        return ok

    links = materialise(_stars(close, full, confirm))
    for t in (close, wanted, full):
        release(t)
    return links


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable over the edges i - j."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _far_and_near(comp: np.ndarray, sig: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of different components within the signature distance; of different sides, if given."""
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(comp), 256):  # a strip of the block at a time
        to = min(len(comp), at + 256)
        far = comp[at:to, None] != comp[None, :]
        far &= np.arange(at, to)[:, None] < np.arange(len(comp))[None, :]
        if side is not None:
            far &= side[at:to, None] != side[None, :]
        i, j = np.nonzero(far)
        for k in range(0, len(i), 100_000):
            x, y = at + i[k : k + 100_000], j[k : k + 100_000]
            ok = (sig[x] != sig[y]).sum(axis=1) <= MAX_DISTANCE
            out_i.append(x[ok])
            out_j.append(y[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def _in_blocks(members: DataFrame, group: str, block: int) -> DataFrame:
    """members(group, rep, component, ...) of groups with several components, with own, lo, hi: a group of more than block
    members becomes pairs of its blocks. Members of a group's largest component have blocks of their own (of
    negative numbers), which aren't paired with each other, so that work grows with the others times all."""
    counted = members.groupBy(group, "component").agg(F.count("*").alias("n"))
    sizes = materialise(
        counted.groupBy(group).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components"))
        .where("components > 1").select(group, "n", "most", "main")
    )
    small = F.col("n") <= block
    blocks = F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / block)).cast("int")
    mains = F.when(small, 0).otherwise(F.ceil(F.col("most") / block)).cast("int")
    dealt = sized_join(members, sizes, group, "inner").withColumns({"blocks": blocks, "mains": mains})
    is_main = (F.col("mains") > 0) & (F.col("component") == F.col("main"))
    place = F.xxhash64("rep", F.lit(3))
    return (
        dealt.withColumn("own", F.when(is_main, -1 - F.pmod(place, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(place, F.col("blocks"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(F.col("own") < 0, 0).otherwise(-F.col("mains")), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .drop("blocks", "mains", "main", "n", "most", "other")
    )


def _left_open(shared: DataFrame, component: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that tie together all members of entries that have a partner in another component within
    the signature distance. A block returns a star for each group it finds, not its pairs."""
    members = shared.select("entry", "rep").join(component, "rep")
    dealt = _in_blocks(members, "entry", BLOCK).join(classes.select("rep", "sig"), "rep")
    keys = ["entry", "lo", "hi"]

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, keys):
            starts = np.append(run_starts(rows, keys), rows.num_rows)
            rep, comp, side = column(rows, "rep"), column(rows, "component"), column(rows, "own")
            sig = fixed_binary(rows, "sig", np.uint16, SYMBOLS)
            lo, hi = column(rows, "lo"), column(rows, "hi")
            a, b = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                i, j = _far_and_near(comp[s:e], sig[s:e], side[s:e] if lo[s] != hi[s] else None)
                root = _roots(e - s, i, j)
                mine = np.flatnonzero(root != np.arange(e - s))
                a.append(rep[s:e][root[mine]])
                b.append(rep[s:e][mine])
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return (
        dealt.select(*keys, "own", "rep", "component", "sig").repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(lean(tie), "a long, b long").distinct()
    )


def _links_across(
    shared: DataFrame, component: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int
) -> DataFrame:
    """Edges (a, b) that join all components between which there is a confirmed link.

    Members tied by _left_open() are a cluster; its full sets are compared in blocks, where a pair costs a few
    nanoseconds for each shingle and is never a row."""
    label = materialise(
        classes.select("rep").join(component.withColumnRenamed("id", "rep"), "rep", "left")
        .select("rep", F.coalesce("component", "rep").alias("component"))
    )
    cluster = materialise(connected_components(_left_open(shared, label, classes)).withColumnRenamed("component", "cluster"))
    wanted = materialise(cluster.select(F.col("id").alias("rep")))
    full = materialise(_full_sets(texts, classes, wanted, words))
    members = materialise(wanted.join(cluster.withColumnRenamed("id", "rep"), "rep").join(label, "rep"))
    keys = ["cluster", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, keys):
            starts = np.append(run_starts(rows, keys), rows.num_rows)
            rep, comp, side = column(rows, "rep"), column(rows, "component"), column(rows, "own")
            sig = fixed_binary(rows, "sig", np.uint16, SYMBOLS)
            lo, hi = column(rows, "lo"), column(rows, "hi")
            a, b = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                i, j = _far_and_near(comp[s:e], sig[s:e], side[s:e] if lo[s] != hi[s] else None)
                if not len(i):
                    continue
                held = [np.frombuffer(v, np.uint64) for v in rows["members"][s:e].to_pylist()]
                i, j = _similar(held, i, j, percent)
                root = _roots(e - s, i, j)
                mine = np.flatnonzero(root != np.arange(e - s))
                a.append(rep[s:e][root[mine]])
                b.append(rep[s:e][mine])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = _in_blocks(members, "cluster", SET_BLOCK).join(classes.select("rep", "sig"), "rep").join(full, "rep").select(*keys, "own", "rep", "component", "sig", "members")
    return materialise(
        dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(compare), "a long, b long").distinct()
    )


def _similar(held: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs i - j, those whose sets have 100 * both >= percent * either."""
    sizes = np.array([len(x) for x in held])
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    ok = 100 * small >= percent * large
    i, j = i[ok], j[ok]
    _, ids = np.unique(np.concatenate(held), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    flag = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    keep = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        if not len(group):
            continue
        x = i[group[0]]
        mine = ids[bounds[x] : bounds[x + 1]]
        flag[mine] = 1
        both = np.add.reduceat(flag[ids], bounds[:-1])[j[group]]
        flag[mine] = 0
        keep[group] = 100 * both >= percent * (sizes[x] + sizes[j[group]] - both)
    return i[keep], j[keep]


def near_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """A row for each row of df: id, n_shingles long, component_id long, kept boolean.

    Two texts are linked if their sets' similarity is at least percent / 100; component_id is the smallest id
    reachable by links. percent is 80 or more: the signature distance is made for that.
    """
    if percent < 80:
        raise ValueError("the signature distance is made for a similarity of 0.8 or more")
    small_batches(df.sparkSession)
    signed = materialise(signatures(df, id_col, text_col, shingle_words))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    filled = signed.where("n_shingles > 0 and id is not null")
    classes = filled.groupBy("hi", "lo").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")
    )
    # Numbered as they are written, so the numbers are fixed.
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()))
    sampled = _entries(classes.where(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(SAMPLE)) == 0))
    hot = [
        r["entry"]
        for r in sampled.groupBy("entry").count().where(F.col("count") >= BLOCK // SAMPLE).orderBy(F.desc("count")).limit(HOT_ENTRIES).collect()
    ]
    shared = materialise(_shared(_entries(classes), hot))
    stars = shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    if hot:  # the centres of a hot entry's parts are confirmed against the least of them
        centres = shared.where(F.col("entry").isin(hot)).select("entry", F.col("centre").alias("b")).distinct()
        stars = stars.unionByName(
            centres.join(centres.groupBy("entry").agg(F.min("b").alias("a")), "entry").where("a <> b").select("a", "b")
        )
    links = _confirmed(materialise(stars.distinct()), classes, texts, shingle_words, percent)
    links = links.unionByName(_of_one_id(filled, classes))
    component = materialise(connected_components(links))
    more = _links_across(shared, component, classes, texts, shingle_words, percent)
    if not more.isEmpty():
        grown = component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        component = materialise(connected_components(grown))
    component = component.withColumnRenamed("id", "rep")
    # A component's name is the least id in it.
    names = materialise(
        component.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"), F.count("*").alias("copies"))
    )
    named = label_join(component, names, ["component"]).select("rep", "name")
    labels = materialise(
        classes.select("hi", "lo", "rep", "least", "copies").join(named, "rep", "left").select("hi", "lo", "copies", F.coalesce("name", "least").alias("component"))
    )
    alone = signed.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component"))
    linked = label_join(filled.select("id", "n_shingles", "hi", "lo"), labels, ["hi", "lo"]).select("id", "n_shingles", "component")
    return (
        linked.unionByName(alone)
        .select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )


def _of_one_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of one id."""
    name = F.xxhash64("hi", "lo")
    several = materialise(filled.groupBy("id").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select("id"))
    sets = sized_join(filled.select("id", "hi", "lo"), several, "id", "left_semi").distinct()
    sets = materialise(sized_join(sets, classes.select("hi", "lo", "rep"), ["hi", "lo"], "inner").select("id", "rep"))
    first = materialise(sets.groupBy("id").agg(F.min("rep").alias("first"), F.count("*").alias("copies")))
    return label_join(sets, first, ["id"]).where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
