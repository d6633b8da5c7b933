"""Document quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

1. A document's own evidence is a logistic regression on shares of characters and words and on the log-odds of a second
   one on hashed n-grams of the whole text (four bytes, and words, as means). The second is fitted by stochastic
   gradients; the first sees only what it says of labelled documents that it wasn't fitted on (two folds), so it
   knows how far to trust it. Both are fitted on at most ``max_labelled`` labelled documents, those with the smallest hash
   of their id.
2. Grouped aggregation sums the evidence of all documents by host and by path (here: source, and source
   with language). A host's posterior is its mean shrunk towards the corpus's, with a prior worth
   ``k_host`` documents; a path's is shrunk towards its host's. The prior's worth is estimated from the spread of
   the means (the method of moments), so sparse sites stay near their prior, and large ones speak for themselves.
3. A document's final log-odds are its own plus what its path's posterior adds to the corpus's.

A text is read once: its evidence is written (with the whole row, if rows are to be kept) and read back. Only sums by
site leave the tasks that read documents, so a host with a third of all rows costs one row a task; sites are joined back
by broadcast if they were counted to be few, else hot sites by broadcast and the others by a shuffle.

Nulls: a null text is an empty one; it is judged by its evidence (an empty text has all shares 0). Null hosts
and paths are sites of their own. Labels that are null or not 0 or 1 are ignored, repeated labels count once
per pair of rows. Without labels of both kinds, or without documents, no evidence exists: every document's own
log-odds are 0 and it is kept. Repeated rows are documents of their own. Ties of the hash that chooses labelled documents
are broken by id and label. A text of any length is judged whole. Columns of any name stay as they are. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import label_join, lean, materialise, settle, small_batches, trim
from inkfold.llm.minhash_dedup import _IN_WORD, _word_hashes

#: Fitted on at most so many labelled documents.
MAX_LABELLED = 3_000
#: Buckets of hashed n-grams: four bytes in the first half, words in the second.
BUCKETS = 1 << 14
#: Bytes of texts that are looked at together.
TOGETHER = 1 << 18
EPOCHS, RATE = 6, 0.5

UPPER, LETTER, SYMBOL, BAR, SHOUT, DIGIT = (np.uint8(1 << i) for i in range(6))
_KIND = np.zeros(256, np.uint8)
for _kind, _members in ((UPPER, range(65, 91)), (LETTER, [*range(65, 91), *range(97, 123), *range(192, 256)]), (SYMBOL, b"%&$#*~^@<>{}\\=+_"), (BAR, b"|\t"), (SHOUT, b"!?"), (DIGIT, range(48, 58))):
    _KIND[list(_members)] |= _kind
_GRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
FEATURES = ("upper", "letters", "symbols", "bars", "shouts", "digits", "fresh", "word", "size", "rough")


@dataclass
class Texts:
    """Shares of some texts, and the buckets of their n-grams: those of text i at bounds[i]:bounds[i + 1]."""

    shares: np.ndarray
    grams: np.ndarray
    gram_bounds: np.ndarray
    words: np.ndarray
    word_bounds: np.ndarray


def look(texts: list[bytes]) -> Texts:
    """A letter is A-Z, a-z or a character beyond ASCII; a word is what lies between white space."""
    gap = b"\n\n\n\n"  # no n-gram reaches into the next text
    raw = np.frombuffer(gap.join(texts) + gap, np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens + 4)[:-1]])
    doc = np.repeat(np.arange(len(texts)), lens)
    inside = np.arange(lens.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    kind = _KIND[raw]

    def count(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flag[inside], len(texts))

    n = np.maximum(count((raw & 0xC0) != 0x80), 1.0)
    shout = (kind & SHOUT) > 0
    shout &= np.concatenate([[False], shout[:-1]]) | np.concatenate([shout[1:], [False]])
    share = {k: count((kind & f) > 0) / n for k, f in (("upper", UPPER), ("letters", LETTER), ("symbols", SYMBOL), ("bars", BAR), ("digits", DIGIT))}
    share["shouts"] = count(shout) / n
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[raw], [False]]).astype(np.int8)))
    hashes = _word_hashes(raw, edge[0::2], edge[1::2])
    word_bounds = np.searchsorted(edge[0::2], np.append(starts, len(raw)))
    word_doc = np.repeat(np.arange(len(texts)), np.diff(word_bounds))
    order = np.lexsort((hashes, word_doc))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
    many = np.maximum(np.diff(word_bounds), 1.0)
    distinct = np.bincount(word_doc[order][first], minlength=len(texts))
    shares = np.column_stack([
        share["upper"], share["letters"], share["symbols"] * 4, share["bars"] * 10, np.minimum(1.0, share["shouts"] * 10), share["digits"] * 4,
        distinct / many, np.minimum(2.0, n / many / 8), np.log1p(many) / 8, np.minimum(1.0, (share["symbols"] + share["bars"]) * n / many),
    ])
    shares[lens == 0] = 0.0
    mixed = np.zeros(len(raw) - 3, np.uint32)
    for i in range(4):
        mixed = (mixed ^ raw[i : len(raw) - 3 + i]) * _GRAM[i]
    half = BUCKETS // 2
    return Texts(
        shares, (mixed[inside] >> np.uint32(32 - half.bit_length() + 1)).astype(np.int32), np.concatenate([[0], np.cumsum(lens)]),
        ((hashes >> np.uint64(64 - half.bit_length() + 1)).astype(np.int32) + half), word_bounds,
    )


def looked(texts: Iterator[bytes]) -> Iterator[Texts]:
    """look() at about TOGETHER bytes at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield look(held)
            held, size = [], 0
    if held:
        yield look(held)


@dataclass(frozen=True)
class Model:
    """weights: of the shares, of the n-grams' log-odds and the constant; grams: of the buckets; constant: of the n-grams."""

    weights: np.ndarray
    grams: np.ndarray
    constant: float

    def log_odds(self, t: Texts) -> np.ndarray:
        """Of good quality, of a text by itself, within -12..12."""
        return np.clip(np.column_stack([t.shares, self.of_grams(t), np.ones(len(t.shares))]) @ self.weights, -12, 12)

    def of_grams(self, t: Texts) -> np.ndarray:
        out = np.full(len(t.shares), self.constant)
        for codes, bounds in ((t.grams, t.gram_bounds), (t.words, t.word_bounds)):
            n = np.diff(bounds)
            out += np.bincount(np.repeat(np.arange(len(n)), n), self.grams[codes], len(n)) / np.maximum(n, 1)
        return np.clip(out, -12, 12)


def _fit_grams(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets and a constant, from (buckets, means) of the labelled documents numbered in of."""
    w, b = np.zeros(BUCKETS), 0.0
    if not 0 < y[of].sum() < len(of):
        return w, b
    squares, square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        for i in of.tolist():
            at, x = rows[i]
            error = 1 / (1 + np.exp(-np.clip(b + w[at] @ x, -30, 30))) - y[i]
            slope = error * x
            squares[at] += slope * slope
            square += error * error
            w[at] -= RATE * slope / np.sqrt(squares[at])
            b -= RATE * error / np.sqrt(square)
    return w, float(b)


def fit(shares: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 60) -> Model | None:
    """None without labels of both kinds."""
    if not 0 < y.sum() < len(y):
        return None
    score, fold = np.zeros(len(y)), np.arange(len(y)) % 2
    for k in (0, 1):
        w, b = _fit_grams(rows, y, np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k).tolist():
            score[i] = np.clip(b + w[rows[i][0]] @ rows[i][1], -12, 12)
    x = np.column_stack([shares, score, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        change = np.linalg.solve(curve, slope)
        w += np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-8:
            break
    return Model(w, *_fit_grams(rows, y, np.arange(len(y))))


def fitted(labelled: DataFrame) -> Model | None:
    """A model from a bounded table of (id, text, y 0 or 1)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares, at, x = [], [], []
            for t in looked(v.as_py() or b"" for v in b["text"]):
                shares += t.shares.tolist()
                for i in range(len(t.shares)):
                    g, v = t.grams[t.gram_bounds[i] : t.gram_bounds[i + 1]], t.words[t.word_bounds[i] : t.word_bounds[i + 1]]
                    buckets, counts = np.unique(np.concatenate([g, v]), return_counts=True)
                    at.append(buckets.astype(np.uint16).tobytes())
                    x.append((counts / np.where(buckets < BUCKETS // 2, max(len(g), 1), max(len(v), 1))).astype(np.float32).tobytes())
            yield pa.record_batch([b["id"], b["y"], pa.array(shares, pa.list_(pa.float64())), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["id", "y", "shares", "at", "x"])

    kind = labelled.schema["id"].dataType.simpleString()
    rows = labelled.select("id", F.col("text").cast("binary").alias("text"), F.col("y").cast("int").alias("y")).mapInArrow(lean(counted), f"id {kind}, y int, shares array<double>, at binary, x binary")
    held = rows.orderBy(F.xxhash64("id"), "id", "y", "at", "x").collect()
    made = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["x"], np.float32)) for r in held]
    shares, y = np.array([r["shares"] for r in held]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in held], np.float64)
    model = fit(shares, made, y)
    del held, made
    trim()  # the driver's memory
    return model


def own_evidence(text: Column, model: Model | None) -> Column:
    """Log-odds of good quality of a document by itself, within -12..12."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        made = [model.log_odds(t) for t in looked(v.as_py() or b"" for v in texts)]
        settle()
        return pa.array(np.concatenate([*made, np.empty(0)]))

    return evidence(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _p(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _worth(means: DataFrame) -> float:
    """How many documents a prior is worth, from (n, p, prior): by the method of moments, within 1..10000."""
    r = means.agg(
        F.sum(F.col("n") * F.pow(F.col("p") - F.col("prior"), F.lit(2.0))).alias("spread"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("noise"), F.sum("n").alias("n"),
        F.avg(F.col("prior") * (1 - F.col("prior"))).alias("variance"),
    ).first()
    between = ((r["spread"] or 0) - (r["noise"] or 0)) / max(r["n"] or 1, 1)
    return 10_000.0 if between <= 0 else float(min(10_000.0, max(1.0, r["variance"] / between - 1)))


def site_posteriors(judged: DataFrame) -> DataFrame:
    """(host, path, n long, lift double) from (host, path, own): what a path's posterior adds to log-odds."""
    # Sums in units of 2**-40: integers, so that their order doesn't matter.
    unit = float(2**40)
    paths = materialise(
        judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(_p(F.col("own")) * unit).cast("decimal(38,0)")).alias("good"))
        .withColumn("good", F.col("good").cast("double") / unit)
    )
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if not whole["n"]:
        return paths.select("host", "path", "n", F.lit(0.0).alias("lift"))
    corpus = whole["good"] / whole["n"]
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    k = _worth(hosts.select(F.col("host_n").alias("n"), (F.col("host_good") / F.col("host_n")).alias("p"), F.lit(corpus).alias("prior")))
    hosts = hosts.select(
        F.col("host").alias("h"), ((F.col("host_good") + k * corpus) / (F.col("host_n") + k)).alias("host_p"),
    )
    both = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    k = _worth(both.select("n", (F.col("good") / F.col("n")).alias("p"), F.col("host_p").alias("prior")))
    posterior = (F.col("good") + k * F.col("host_p")) / (F.col("n") + k)
    return both.select("host", "path", "n", (_log_odds(posterior) - _log_odds(F.lit(corpus))).alias("lift"))


def judge(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_cols: tuple[str, ...] = ("lang",), *, quality_col: str = "quality", threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """(id, own_log_odds, site_log_odds, probability double, kept boolean) for each row of df."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_site(df, host_col, path_cols))
    judged = _judged(slim, "id", "text", labels, id_col, quality_col, max_labelled, threshold, drop=("text",))
    return judged.select(F.col("id").alias(id_col), F.col("own").alias("own_log_odds"), F.col("lift").alias("site_log_odds"), "probability", "kept")


def _site(df: DataFrame, host_col: str, path_cols: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{host_col}`").cast("string").alias("host"), F.array(*[F.col(f"`{c}`").cast("string") for c in path_cols]).cast("string").alias("path")]


def _judged(
    rows: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, quality_col: str, max_labelled: int, threshold: float, drop: tuple[str, ...] = ()
) -> DataFrame:
    """rows(host, path, ...) without drop, with own, lift, probability and kept."""
    small_batches(rows.sparkSession)
    truth = labels.where(F.col(quality_col).isin(0, 1)).select(F.col(label_id).alias("id"), F.col(quality_col).alias("y"))
    # Only the documents that the fit looks at get here with their texts.
    chosen = truth.orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)
    named = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Repeated ids may make more rows of the chosen ones.
    labelled = named.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "y", "text").limit(max_labelled)
    model = fitted(labelled)
    # A struct of both, as text, is never null.
    site = F.to_json(F.struct(F.col("host").alias("h"), F.col("path").alias("p")), {"ignoreNullFields": "false"})
    judged = materialise(rows.withColumn("own", own_evidence(F.col(text_col), model)).drop(*drop))
    lifts = materialise(site_posteriors(judged).select(site.alias("site"), F.col("n").alias("copies"), "lift"))
    probability = _p(F.col("own") + F.col("lift"))
    return label_join(judged.withColumn("site", site), lifts, ["site"]).withColumns({"probability": probability, "kept": probability >= threshold})


def good_documents(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), *,
    quality_col: str = "quality", threshold: float = 0.5, max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """The rows of df that judge() keeps, with df's columns."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_site(df, host_col, path_cols))
    rows = rows.withColumns({"id": F.col("row")[id_col], "text": F.col("row")[text_col]})
    judged = _judged(rows, "id", "text", labels, id_col, quality_col, max_labelled, threshold, drop=("id", "text"))
    return judged.where("kept").select(*[F.col("row")[c].alias(c) for c in df.columns])
