import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkfold.llm import license_scan as LS
from inkfold.llm import progressive_jpeg as J
from inkfold.llm import queries as Q
from inkfold.llm.bpe import ByteBpe, load_ranks, spelled_out
from inkfold.llm import mixing
from inkfold.llm.chat_format import format_chats, masked_text, parse
from inkfold.llm.mixing import mix, mixture
from inkfold.llm.quality import good_documents, judge
from inkfold.llm.sharding import find_cuts, shard
from inkfold.llm.url_filter import Cascade, Rule, TooLarge, judge_urls
from inkfold.plans import shared

TEXTS = [
    "Hello world, it's  fine.\n\n  Tabs\tand\u00a0more \u2003 end   ", "", None, "a" * 3000, " " * 500 + "x", "日本語テキスト 123 ٣٤ é\u0301 😀😀 \x85 \x1c\x1d",
    "don't we'll THEY'VE 'S", "\u2028\ufeff\u200b zero", "Straße naïve coöperate çàñ", "{}[]<>|\\\"'`~!@#$%^&*()",
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


# ------------------------------------------------------------------ 5


def test_bpe_equals_the_library(spark, documents):
    ranks = load_ranks(public_tokenizers.path(Q.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = ByteBpe(ranks, public_tokenizers.PATTERN)
    for options in ({"most_words": 1, "chunk": 1}, {"most_words": 5, "chunk": 3, "long": 1}, {"chunk": 1000, "long": 4, "window": 8}, {"long": 40, "window": 30}, {}):
        got = bpe.encode(documents, **options).withColumn("raw", bpe.decode(F.col("ids")))
        for r in got.collect():
            assert r.ids == known.encode_ordinary(TEXTS[r.doc_id] or "") and bytes(r.raw) == (TEXTS[r.doc_id] or "").encode()
        assert got.columns == ["doc_id", "text", "ids", "raw"]
    assert bpe.encode(documents.limit(0)).collect() == []
    assert bpe.encode(documents, drop=("text",)).columns == ["doc_id", "ids"]
    assert bpe.encode(documents, drop=("text", "doc_id")).columns == ["ids"]
    told = bpe.encode(documents, out={"n": "count", "t": "written", "raw": "decoded", "ids": "ids"}, drop=("text",))
    assert told.columns == ["doc_id", "n", "t", "raw", "ids"]
    for r in told.collect():
        assert (r.n, r.t, bytes(r.raw)) == (len(r.ids), ",".join(map(str, r.ids)), (TEXTS[r.doc_id] or "").encode())
    odd = spark.createDataFrame([([64, None, -1, 1 << 30, 65],), ([],)], "ids array<int>")
    assert [bytes(r.raw) for r in odd.select(bpe.decode(F.col("ids")).alias("raw")).collect()] == [bpe.pieces[64] + bpe.pieces[65], b""]
    assert documents.select(bpe.decode(F.lit(None).cast("array<int>")).alias("raw")).first().raw is None
    inner = documents.select("doc_id", "text", "ids", *[F.col("doc_id").alias(c) for c in ("row", "numbers", "place", "start", "a.b")])
    assert [(r.doc_id, r.place, r["a.b"], r.ids) for r in bpe.encode(inner).collect()] == [(r.doc_id, r.doc_id, r.doc_id, r.ids) for r in bpe.encode(documents).collect()]
    broken = documents.limit(1).select("doc_id", F.expr("cast(x'61ff62' as string)").alias("text"))
    assert bpe.encode(broken).first().ids == known.encode_ordinary("a\ufffdb")
    two = np.array([(a, b) for a in range(0, 50_000, 997) for b in range(0, 50_000, 61)])
    made = {ranks[k[:i]] * 65_536 + ranks[k[i:]]: v for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
    two = np.concatenate([two, [divmod(k, 65_536) for k in made]])
    states = bpe.pairs.state(two[:, 0], two[:, 1])
    want = np.array([made.get(a * 65_536 + b, -1) for a, b in two.tolist()])
    assert (states & 0xFFFFF == two[:, 0]).all() and (np.where(states < 1 << 41, states >> 20, -1) == want).all()
    with pytest.raises(ValueError, match="rank"):
        ByteBpe({b"a": 0}, ".")
    with pytest.raises(ValueError, match="brackets"):
        spelled_out(r"[\S]")


def test_long_words(spark):
    rng = np.random.default_rng(4)
    ranks = load_ranks(public_tokenizers.path(Q.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a" * 100_000, "ab" * 700 + "aaab" * 300, "".join(map(chr, rng.integers(97, 123, 150_000))), "\u4e2d" * 2000, "e" * 257, "-" * 5000, "=" * 100_001, "ab" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bpe = ByteBpe(ranks, public_tokenizers.PATTERN)
    for r in bpe.encode(rows).collect():
        assert r.ids == known.encode_ordinary(r.text)
    # Windows so small that they agree on nothing, and windows of many sizes.
    few = spark.createDataFrame([(i, "".join(rng.choice(list("abn e"[:4]), 300))) for i in range(40)] + [(99, "internationalization" * 20)], "doc_id long, text string")
    for window in (2, 8, 16, 64):
        for r in bpe.encode(few, long=window, window=window).collect():
            assert r.ids == known.encode_ordinary(r.text)


def test_ids_of_20_bits(spark):
    ranks = {bytes([b]): 1_000_000 + b for b in range(256)} | {b"ab": 500_000, b"abc": 999_999, b"bc": 3, b"aab": 1_048_575}
    known = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    texts = ["abc", "aabcabab", "xaabbc", "abcabcaab" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bpe = ByteBpe(ranks, ".+")
    for long in (1, 256):
        for r in bpe.encode(rows, long=long).withColumn("raw", bpe.decode(F.col("ids"))).collect():
            assert r.ids == known.encode_ordinary(r.text) and bytes(r.raw).decode() == r.text
    with pytest.raises(ValueError, match="20 bits"):
        ByteBpe(ranks | {b"zz": 1 << 20}, ".+")


def test_parts_of_batches():
    import pyarrow as pa

    from inkfold.llm.common import in_parts

    texts = ["a" * n for n in (5, 0, 300, 2, 2, 2, 100, 1)] + [None]
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], names=["t", "i"])
    parts = list(in_parts(iter([batch, batch.slice(0, 0)]), "t", 100))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 2


# ------------------------------------------------------------------ 3


def test_media_round_trip(spark, documents):
    rows = {r.doc_id: r for r in J.media_digests(J.store_texts(documents)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = J.padded(raw)
        assert len(payload) % 576 == 0 and payload
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[1].media_sha256 == rows[2].media_sha256 and rows[1].feature == rows[2].feature


def test_media_edges(spark):
    texts = ["y" * 2_000_000, "same", "same", None]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes string")
    rows = {r.doc_id: r for r in J.media_digests(J.store_texts(df)).collect()}
    for i, t in enumerate(texts):
        assert rows[i].n_bytes == len(t or "") and rows[i].payload_sha256 == hashlib.sha256(J.padded((t or "").encode())).hexdigest()
    assert rows[1].media_sha256 == rows[2].media_sha256 != rows[3].media_sha256
    assert J.media_digests(J.store_texts(df.limit(0))).collect() == []
    stored = J.store_texts(df.where("doc_id = 1")).withColumn("image", F.lit("old"))
    read = J.read_images(stored)
    assert read.columns == ["doc_id", "n_bytes", "media", "image"] and len(read.first().image.rgb) == read.first().image.width * read.first().image.height * 3
    assert J.read_images(stored.limit(0)).collect() == []


def test_every_byte_survives():
    rng = np.random.default_rng(0)
    for n in (576, 576 * 7, 576 * 90):
        payload = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert J.payload_of(J.read_coefficients(J.write_payload(payload))) == payload


def _jvm_jpeg(spark, rgb, progressive):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(rgb.shape[1], rgb.shape[0], 1)
    for y in range(rgb.shape[0]):
        for x in range(rgb.shape[1]):
            image.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    options = writer.getDefaultWriteParam()
    options.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), options)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def _jvm_pixels(spark, data):
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data))
    return np.array([[[image.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(image.getWidth())] for y in range(image.getHeight())])


def test_files_of_another_writer(spark):
    y, x = np.mgrid[0:37, 0:45]
    rgb = np.stack([x * 5 % 256, y * 6 % 256, (x + y) * 3 % 256], axis=-1)
    data = _jvm_jpeg(spark, rgb, True)
    assert b"\xff\xc2" in data
    mine, theirs = J.to_rgb(J.read_coefficients(data)).astype(int), _jvm_pixels(spark, data)
    assert mine.shape == theirs.shape == rgb.shape
    # Chroma may be smoothed when it is upsampled; everything else agrees.
    assert np.abs(mine - theirs).mean() < 4
    with pytest.raises(ValueError, match="progressive"):
        J.read_coefficients(_jvm_jpeg(spark, rgb, False))


def test_own_files_in_another_reader(spark):
    data = J.write_payload(J.padded(b"some text of a few words " * 40))
    mine, theirs = J.to_rgb(J.read_coefficients(data)), _jvm_pixels(spark, data)
    # The other reader smooths the chroma, which is noise here.
    assert np.corrcoef(mine.reshape(-1), theirs.reshape(-1))[0, 1] > 0.8


def test_symbol_by_symbol_path_equals_the_fast_one(monkeypatch):
    data = J.write_payload(J.padded(bytes(range(256)) * 5))
    fast = J.read_coefficients(data)
    monkeypatch.setattr(J._Table, "only", None)
    slow = J.read_coefficients(data)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components.values(), slow.components.values(), strict=True))


def test_image_column(spark):
    good = J.write_payload(J.padded(b"x"))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (4, bytearray(good[:200]))], "k int, media binary")
    got = {r.k: r.image for r in J.read_images(df, broken_to_null=True).collect()}
    assert got[1].width * got[1].height * 3 == len(got[1].rgb) and got[2] is None and got[3] is None and got[4] is None
    with pytest.raises(Exception, match="JPEG|marker"):
        J.read_images(df.where("k = 3")).collect()


# ------------------------------------------------------------------ 4


def brute_licences(text, threshold=0.8):
    import re

    cut = re.split("\n[ \t\r]*\n", text) + text.split("\n") + re.sub("([.!?])[ \t]+", r"\1\n", text).split("\n")
    hits = set()
    for p in {" ".join(LS.normalised(c)) for c in cut}:
        w = p.split()
        a = set(zip(w, w[1:], strict=False))
        for name, t in LS.TEMPLATES.items():
            v = LS.normalised(t)
            b = set(zip(v, v[1:], strict=False))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold - 1e-12:
                hits.add((name, p, 2000 * len(a & b) // (len(a) + len(b))))
    return hits


def test_licences(spark):
    texts = [
        "Some prose. Released under the MIT License. More prose.", "x\nAll rights reserved.\ny", "Licensed under CC BY-NC 4.0.", "All rights", "", None,
        "Licensed under the Apache Licence, Version 2.0!", "RELEASED UNDER THE  MIT LICENSE", "MIT License. " + " ".join(f"w{i}" for i in range(9000)), "This work is licensed under the GNU General Public License, version 2.",
        LS.TEMPLATES["ISC"].replace(" ", "\n", 1) + "\n\nother", "the of and " * 5000,
    ]
    texts += ["Released under the MIT \u212aicense.", "Released\u0130under the MIT License", "word " * 100_000 + "\nAll rights reserved.\n" + "w" * 300_000]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], "doc_id int, text string, license_hits string, __clean string, license_text string")
    out = LS.scan_licenses(df)
    assert out.columns == ["doc_id", "text", "__clean", "license_text", "license_hits"]
    for r in out.collect():
        assert r["__clean"] == "y" and r.license_text == "z"
        assert {(h.license, h.passage, h.permille) for h in r.license_hits} == brute_licences(texts[r.doc_id] or "")
    assert LS.scan_licenses(df.limit(0)).collect() == []


def test_wrapped_licences(spark):
    import textwrap

    def commented(name, mark="# "):
        body = "\n".join(mark + line for line in textwrap.wrap((LS.TEMPLATES | LS.NOTICES)[name], 60))
        return f"{mark}Copyright 2020 Some Body\n{mark.strip()}\n{body}\n{mark.strip()}\n{mark}The rest of this long header is about something else " + " ".join(f"w{i}" for i in range(90))

    short = "This work is licensed under the GNU General\nPublic License, version 3."
    texts = [
        f"A first sentence of prose stands here. {short} And a last one, longer than the notice is, follows it at once.", commented("MIT-permission"),
        *[commented(n, "// ") for n in ("GPL-2.0-or-later", *LS.NOTICES)], f"{short} Prose in between, so that they are apart, goes on for a while.\nReleased under\nthe MIT License.",
        "No notice\nis in here, all\nrights aside.", "word\n" * 1000 + "All rights\nreserved\n" + "word\n" * 1000,
    ]
    wanted = [
        [("GPL-3.0", 1000)], [("MIT-permission", 1000)], *[[(n, 1000)] for n in ("GPL-2.0-or-later", *LS.NOTICES)], [("GPL-3.0", 1000), ("MIT", 1000)], [], [("All-rights-reserved", 1000)],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(h.license, h.permille) for h in r.license_hits] for r in LS.scan_licenses(df).collect()}
    assert got == dict(enumerate(wanted))
    assert not any(brute_licences(t) for t in texts)


def test_cover():
    anchors = ["the software", "of software", "a b", "public license", "license text"]
    cover = LS._cover(anchors)
    assert all(any(w in a for w in cover) for a in anchors) and cover[:2] == ["software", "license"] and "a b" in cover


# ------------------------------------------------------------------ 6


def test_chats(spark):
    rows = [
        (1, 0, "system", "be <s>good</s>"), (1, 1, "user", "[/INST] hi\\"), (1, 2, "assistant", "[\\INST] <\\\\/s>ok</s>"), (2, 1, "assistant", None), (2, 0, "user", ""),
        (3, 0, None, "x"), (3, 0, None, "x"), (3, None, "odd[/INST]</s>role", "y"), (None, 0, "user", "z"), (4, 0, "assistant", "ends in <"), (4, 1, "assistant", "/s>[INST"), (5, 0, "user", "[INST] only [/INST]"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = format_chats(df)
    got = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 6
    for r in got:
        mine = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")
    by_id = {r.conv_id: r.formatted for r in got}
    assert by_id[1].startswith("<s1>") and by_id[5].startswith("<s1>") and by_id[4].startswith("<s0>")
    many = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    long = spark.range(2).select(F.lit(2).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("[INST]é</s>"), 50_000).alias("text"))
    sizes = {r.conv_id: (r.n, r.loss) for r in format_chats(many.unionByName(long)).select("conv_id", F.size(parse(F.col("formatted"))).alias("n"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert sizes == {1: (3000, "".join(f"text {i}" for i in range(1, 3000, 2))), 2: (2, "[INST]é</s>" * 100_000)}
    clash = df.withColumns({c: F.lit("z") for c in ("plain", "fits", "turns", "row", "loss_spans")})
    assert sorted(r.formatted for r in format_chats(clash).collect()) == sorted(r.formatted for r in got)
    assert format_chats(df.limit(0)).collect() == []


# ------------------------------------------------------------------ 7


def test_shards(spark):
    rng = np.random.default_rng(0)
    data = [(int(i), "t" * int(rng.integers(0, 300))) for i in range(900)] + [(1000 + i, "same text") for i in range(450)] + [(5, None), (5, None), (None, "x"), (7, "L" * 3000)]
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, size int")
    got = shard(df, shards=40).collect()
    assert len(got) == len(data)
    total = sum(r["size"] for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(40))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 40) <= 3016
    text = dict(data)
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got if r.doc_id not in (5, 7))
    assert shard(df.limit(0)).collect() == []
    # Groups of equal texts that are small stay together; of the others it is told.
    together: dict = {}
    for r in got:
        together.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(r.group_split == (len(together[r.text_crc32]) > 1) for r in got)


def test_groups_that_are_cut(spark):
    hot = [(None, "hot text")] * 1500 + [(1, "equal rows")] * 700 + [(i, f"copies {i // 6}") for i in range(2, 1400)] + [(-i, None) for i in range(300)]
    df = spark.createDataFrame([(*h, "a", "b", 1) for h in hot], "doc_id long, text string, key string, piece string, group_split int").repartition(3)
    for pieces in (None, 1, 9):
        got = shard(df, shards=10, pieces=pieces, slack=0.05).collect()
        total, by, groups = sum(r["size"] for r in got), {}, {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
            groups.setdefault(r.text_crc32, set()).add(r.shard)
        assert len(got) == len(hot) and set(by) == set(range(10))
        for rows in by.values():
            assert sorted(r.slot for r in rows) == list(range(len(rows))) and abs(sum(r["size"] for r in rows) - total / 10) < 500
        assert all(r.group_split == (len(groups[r.text_crc32]) > 1) for r in got)
        assert {r.text_crc32 for r in got if r.group_split} <= {zlib.crc32(x) for x in (b"hot text", b"equal rows", b"")}
    long = spark.createDataFrame([(1, "x" * 2_000_000), (2, "y")], "doc_id long, text string")
    assert sorted((r.doc_id, r["size"]) for r in shard(long, shards=4).collect()) == [(1, 2_000_016), (2, 17)]


def test_cuts_are_exact(spark):
    rng = np.random.default_rng(1)
    keys, sizes = rng.integers(0, 2**63 - 1, 500), rng.integers(1, 50, 500)
    keys[:100] = keys[0]
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "key long, size long")
    order = np.argsort(keys)
    total, upto = sizes.sum(), np.cumsum(sizes[order])
    ends = {int(k): int(u) for k, u in zip(keys[order], upto, strict=True)}
    want = [min(k for k, u in ends.items() if u * 10 >= total * c) for c in range(1, 10)]
    assert find_cuts(df, 9) == want
    assert len(find_cuts(df, 9, tolerance=0.5)) == 9


# ------------------------------------------------------------------ 9


@pytest.mark.parametrize("n", [3000, 60_000])
def test_cascade_is_exact(spark, n):
    keys = [f"k{i}" for i in range(n)]
    listed = keys[::3]
    universe, members = (spark.createDataFrame([(k,) for k in x], "key string") for x in (keys, listed))
    cascade = Cascade.build(universe, members)
    assert len(cascade.levels) >= 2
    with pytest.raises(TooLarge):
        Cascade.build(universe, members, max_bits=1000)
    got = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == set(listed)
    assert Cascade.build(universe, members.limit(0)).levels == ()
    assert not spark.range(1).select(cascade.contains(F.lit(None).cast("string"))).first()[0]


def test_urls(spark):
    urls = [
        "https://Example.com/en/a?x", "http://www.example.com/en/", "http://a.b.www.example.com/en/x#y", "http://example.com/fr/", "http://example.com", "http://com/", "http://foo.net/es/1",
        "http://foo.net/de/1", "http://SPAM-farm.example.org/x", "http://m.spam-farm.example.org", "http://notspam-farm.example.org/", None, "no scheme/en/", "://example.com/en/", "http:///en/",
        "http://listed77.example/x", "http://a.listed9999.example", "http://listed10000.example", "http://listed01.example", "http://x.adult-x.example.net/de/", "http://x.adult-x.example.net/fr/",
        "http://" + "long." * 5000 + "adult-x.example.org/" + "y" * 100_000, "http://www.example.com/en/" + "z" * 100_000, "http://m.spam-farm.example.org",
        "http://example.com?/en/", "a://b://example.com/en/", "http://xexample.com/en/", "http://net/fr/", "http://é.net/fr/é",
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id int, url string, rule string, host string")

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [r for r in Q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.key), default=None)
        bad = any(host == d or host.endswith("." + d) for d in Q.BLOCKED_DOMAINS)
        return host, path, best and best.key, best.verdict if best else "block" if bad else "allow"

    rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in Q.URL_RULES] + [(None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    domains = spark.createDataFrame([(d,) for d in [*Q.BLOCKED_DOMAINS, None]], "domain string")
    for options in ({}, {"max_bits": 64}):  # by the cascade, and by joins beyond its size
        for lists in ((Q.URL_RULES, Q.BLOCKED_DOMAINS), (rules, domains)):
            out = judge_urls(df, "url", *lists, **options)
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
            assert got == {i: want(u) for i, u in enumerate(urls)} and sorted(out.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
            twice = judge_urls(df.unionByName(df).withColumns({c: F.lit(1) for c in ("key", "copies", "blocks", "banned", "block")}), "url", *lists, **options)
            assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.blocks, r.banned) for r in twice.na.fill("").collect()) == sorted((i, *(x or "" for x in want(u)), 1, 1) for i, u in enumerate(urls) for _ in "ab")
    assert {r.verdict for r in judge_urls(df, "url", [], []).collect()} == {"allow"}
    assert judge_urls(df.limit(0), "url", [Rule("com", "/", "block")], []).collect() == []


# ------------------------------------------------------------------ 10


def test_mixture_by_brute_force(spark):
    tokens = [1000, 300, 300, 50]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    p = np.array(tokens) / sum(tokens)

    def entropy(tau):
        w = p**tau / (p**tau).sum()
        return -(w * np.log(w)).sum()

    tau = mixture(df, entropy_share=0.5, max_epochs=1e9)
    assert entropy(tau) == pytest.approx((entropy(1) + np.log(4)) / 2, abs=1e-9)
    tau = mixture(df, entropy_share=0.9, max_epochs=2.0)
    assert (1000 / 50) ** (1 - tau) == pytest.approx(2.0, abs=1e-9)
    assert mixture(df, entropy_share=0.0, max_epochs=4.0) == pytest.approx(1.0)
    assert mixture(df.limit(1), entropy_share=0.5, max_epochs=4.0) == 1.0
    many = spark.range(200_000).select((F.col("id") % 1000 + 1).alias("tokens"))
    p = np.tile(np.arange(1, 1001), 200) / (500.5 * 200_000)
    tau = mixture(many, entropy_share=0.5, max_epochs=1e9)
    assert entropy(tau) == pytest.approx((entropy(1) + np.log(200_000)) / 2, abs=1e-9)


def test_mix(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = [(i, "big" if i % 3 else f"s{i % 9}", " ".join(["w"] * int(rng.integers(1, 30)))) for i in range(600)] + [(900, None, "a b"), (901, None, None), (902, "empty", ""), (903, "big", None)]
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, source string, text string, rank int")
    got = mix(df, max_epochs=3.0).collect()
    assert {r.doc_id for r in got} == {d[0] for d in data}  # nothing is lost
    own, used = Counter(), Counter()
    for _, s, t in data:
        own[s] += len((t or "").split())
    for r in got:
        used[r.source] += r.mix_tokens
        assert r.mix_tokens == len((r.text or "").split())
    tau = mixture(spark.createDataFrame([(v,) for v in own.values()], "tokens long"), entropy_share=0.5, max_epochs=3.0)
    scale = max(own.values()) ** (1 - tau)
    for s, n in own.items():
        if n:
            target = scale * n**tau
            assert target - 30 <= used[s] <= target + 1e-6
    epochs: dict = {}
    for r in got:
        epochs.setdefault(r.doc_id, []).append(r.mix_epoch)
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    # The permutation by brute force: blocks in the order of their hash, then documents, until the budget ends.
    ranks = {(r.doc_id, r.source): r.rank for r in df.select("doc_id", "source", mixing._rank(
        F.concat(F.when(F.col("source").isNull(), "").otherwise("="), F.coalesce("source", F.lit(""))), F.col("doc_id").cast("string"), 12, 1).alias("rank")).collect()}
    for s, n in own.items():
        epochs_of, upto = (scale * n ** (tau - 1) if n else 1.0), 0
        whole, rest = int(epochs_of + 1e-9), max(0, int((epochs_of - int(epochs_of + 1e-9)) * n + 1e-6))
        want = {}
        over = False
        for i, _, t in sorted((d for d in data if d[1] == s), key=lambda d: ranks[d[0], s]):
            upto += len((t or "").split())
            over = over or upto > rest
            want[i] = whole + (not over and rest > 0)
        assert {i: k for i, k in want.items() if k} == {i: len(e) for i, e in epochs.items() if (i, s) in ranks}
    hard = df.withColumnsRenamed({"rank": "whole"}).withColumns({c: F.lit(c) for c in ("cut", "mix_s", "mix_copies", "mix_whole", "mix_cut", "s", "t", "place", "copies", "mix_epoch")})
    again = mix(hard, max_epochs=3.0)
    assert again.columns == [c for c in hard.columns if c != "mix_epoch"] + ["mix_tokens", "mix_rank", "mix_epoch"]
    assert sorted((r.doc_id, r.mix_epoch, r.cut, r.mix_s, r.mix_copies) for r in again.collect()) == sorted((r.doc_id, r.mix_epoch, "cut", "mix_s", "mix_copies") for r in got)
    long = df.limit(3).withColumn("text", F.repeat(F.lit("word "), 200_000))
    assert {r.mix_tokens for r in mix(long).collect()} == {200_000}
    monkeypatch.setattr(mixing, "label_join", lambda *a, **k: shared.label_join(*a, **k, limit=1))
    monkeypatch.setattr(shared, "HOT_SHARE", 3)
    assert sorted((r.doc_id, r.mix_epoch) for r in mix(df, max_epochs=3.0).collect()) == sorted((r.doc_id, r.mix_epoch) for r in got)
    budget = mix(df, max_epochs=3.0, budget_tokens=1000).collect()
    assert 800 <= sum(r.mix_tokens for r in budget) <= 1000
    assert mix(df.limit(0)).collect() == []


# ------------------------------------------------------------------ 8


def test_looks_of_texts():
    from inkfold.llm.quality import FEATURES, look

    texts = [b"", b"One two two!! 12 |x|", "\u00c9t\u00e9 %".encode(), b"  ", b"abc", b"abcd"]
    together = look(texts)
    for i, t in enumerate(texts):  # what a text's neighbours are doesn't matter
        alone = look([t])
        assert (alone.shares[0] == together.shares[i]).all()
        assert alone.grams.tolist() == together.grams[together.gram_bounds[i] : together.gram_bounds[i + 1]].tolist() and len(alone.grams) == len(t)
        assert alone.words.tolist() == together.words[together.word_bounds[i] : together.word_bounds[i + 1]].tolist() and len(alone.words) == len(t.split())
    x = dict(zip(FEATURES, together.shares[1], strict=True))
    assert (x["upper"], x["letters"], x["bars"], x["shouts"], x["digits"], x["fresh"]) == pytest.approx((1 / 20, 10 / 20, 1.0, 1.0, 0.4, 1.0))
    assert together.shares[2][:3] == pytest.approx((0, 3 / 5, 4 / 5)) and not together.shares[0].any()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = judge(docs, train)
    got = judged.join(test, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.98
    # The posteriors by brute force, from the documents' own evidence.
    rows = judged.join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    p = np.array([1 / (1 + np.exp(-r.own_log_odds)) for r in rows])
    sites = {"host": [r.source for r in rows], "path": [(r.source, r.lang) for r in rows]}

    def shrunk(keys, prior):
        """Each site's mean, shrunk towards prior[key], by a worth from the method of moments."""
        groups = {k: p[[i for i, x in enumerate(keys) if x == k]] for k in set(keys)}
        spread = sum(len(g) * (g.mean() - prior(k)) ** 2 for k, g in groups.items())
        noise = [prior(k) * (1 - prior(k)) for k in groups]
        between = (spread - sum(noise)) / len(p)
        worth = 10_000 if between <= 0 else min(10_000, max(1, np.mean(noise) / between - 1))
        return {k: (g.sum() + worth * prior(k)) / (len(g) + worth) for k, g in groups.items()}

    hosts = shrunk(sites["host"], lambda _: p.mean())
    paths = shrunk(sites["path"], lambda k: hosts[k[0]])
    for r in rows:
        q = paths[r.source, r.lang]
        lift = np.log(q / (1 - q)) - np.log(p.mean() / (1 - p.mean()))
        assert r.site_log_odds == pytest.approx(lift, abs=1e-9)
        assert r.probability == pytest.approx(1 / (1 + np.exp(-r.own_log_odds - lift)), abs=1e-12) and r.kept == (r.probability >= 0.5)
    assert sum(not r.kept for r in got if r.quality) / sum(bool(r.quality) for r in got) < 0.01


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, "Plain good words here.", "en", "a"), (2, "BAD!! BAD!! BAD!!", "en", "a"), (3, None, None, None), (3, None, None, None), (4, "", "en", None)], "doc_id long, text string, lang string, source string"
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (9, 1)], "doc_id long, quality int")
    rows = judge(docs, labels).collect()
    assert len(rows) == 5 and {r.doc_id: r.kept for r in rows}[1] and not {r.doc_id: r.kept for r in rows}[2]
    assert all(r.kept and r.own_log_odds == 0 for r in judge(docs, labels.where("quality = 1")).collect())
    assert judge(docs.limit(0), labels).collect() == []
    names = ["__site", "__lift", "__own", "__kept", "own", "lift", "kept", "site", "host", "path", "row", "id", "probability", "copies", "n", "a.b"]
    hard = docs.withColumns({c: F.lit(c) for c in names})
    for r in good_documents(hard, labels).collect():
        assert all(r[c] == c for c in names)
    assert good_documents(hard, labels).columns == hard.columns
    long = docs.unionByName(spark.createDataFrame([(7, "Plain good words here. " * 100_000, "en", "a"), (8, "BAD!! " * 300_000, "en", "a")], docs.schema))
    assert {r.doc_id: r.kept for r in judge(long, labels).collect()} == {1: True, 2: False, 3: True, 4: True, 7: True, 8: False}
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1}
