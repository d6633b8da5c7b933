import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken

from inkfold.llm.bpe import load_ranks
from inkfold.llm.mixing import mix
from inkfold.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"


def grams(text, n):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages_against_brute_force(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 3 or docs.columns == columns
        tables.append(docs.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in tables[0]}
    judged = [(d in kept) == bool(q) for d, q in labels.items()]
    assert sum(judged) / len(judged) > 0.95
    # Of each group of near-duplicates the smallest id stays.
    sets = {r.doc_id: grams(r.text, 5) for r in tables[0]}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in tables[1]} == {d for d in sets if find(d) == d}
    # Nothing is lost in the mixture, and no source's documents come more than twice.
    assert {r.doc_id for r in tables[2]} == {r.doc_id for r in tables[1]}
    counts: dict[int, int] = {}
    for r in tables[2]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    text = {r.doc_id: r.text for r in tables[2]}
    assert len(tables[3]) == len(tables[2])
    for r in tables[3]:
        ids = known.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_mixing_has_the_limit_of_op10(spark):
    rows = [(i, "large", "a b c d " * 10) for i in range(190)] + [(1000 + i, f"s{i % 19}", "a b c d " * 10) for i in range(380)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert corpus_pipeline.mixing(spark, docs, SF).count() == mix(docs).count() > mix(docs, max_epochs=1.25).count()


def test_edges(spark, tmp_path):
    """Nulls, empty texts, repeated ids, clashing names and an empty table go through all stages."""
    from pyspark.sql import functions as F

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (2, text + " more", "en", "a"), (2, "", None, "b"), (3, None, None, None), (4, "  ", "en", "b"), (None, text, "en", "a"), (5, "x " * 50_000, "de", "c"), (6, text, "en", None), (6, text, "en", None)]
    names = ["__own", "__site", "own", "kept", "gone", "mix_s", "whole", "cut", "rep", "key", "row", "ids", "copies"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("int"))
    docs = docs.withColumns({c: F.lit(c) for c in names})
    for source, want in ((docs, [(None, True), (1, True), (2, False), (3, False), (4, True), (5, True)]), (docs.limit(0), [])):
        now = source
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            path = str(tmp_path / f"{len(want)}-{i}")
            now.write.parquet(path)
            now = spark.read.parquet(path)
            if i == 1:
                left = {(r.doc_id, bool(r.text)) for r in now.collect()}
                assert left <= set(want) and (not want or (1, True) in left)
                assert all(r[c] == c for r in now.collect() for c in names)
            assert i == 3 or now.columns == docs.columns
        ids = [r.doc_id for r in now.collect()]
        assert (set(ids) <= {None, 1, 2, 3, 4, 5}) and bool(ids) == bool(want)
