"""URL filtering by Bloom filter cascades: exact membership in a list, without a join.

A cascade's first filter encodes the listed keys. The keys of the corpus that it lets through by mistake are
encoded in the second filter, the listed keys that this one lets through in the third, and so on until a
level lets nothing through by mistake. For each key of the universe (here: every key that any URL of
the corpus can ask for), the first level that doesn't hold it tells exactly whether it is listed.

Filters have ``BITS_PER_KEY`` bits a key; a level is as large as the list or as the last level's mistakes,
whichever it encodes, and none of it grows with the corpus but those mistakes (under one in a hundred of the
distinct keys, and far fewer in the next level). Every task needs all levels, so a level of more than ``max_bits`` isn't
sent out: then distinct hosts and paths are joined with the list by a shuffle of their keys instead, with the same result.

Lists are Python lists or tables, ``rules(host, path, verdict)`` and ``blocked_domains(domain)``, of any size; entries with a
null are ignored, and of equal rules with both verdicts "block" counts.

Nulls: a null URL or one without ``://`` has an empty host and path, which no rule fits. Rows are judged one by
one, so repeated ids or rows change nothing; one rule of the greatest length fits at most. URLs of any length are judged
whole. Columns of df named like the four of the result are replaced, others of any name stay. An empty table gives an
empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import fresh, label_join, materialise

BITS_PER_KEY, HASHES = 10, 5
#: 8 MB: what a level may send to each task.
MAX_BITS = 1 << 26
#: Words of 32 bits that come to the driver as one row.
SEGMENT = 1 << 12

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    # Halved, so that their sum doesn't overflow.
    a, b = F.shiftright(a, 8), F.shiftright(b, 8)
    return [F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(HASHES)]


@dataclass(frozen=True)
class Level:
    """A filter of some bits; its words of 32 bits as a JSON array."""

    bits: int
    words: str


class TooLarge(Exception):
    """A level has more bits than may be sent to every task."""


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @staticmethod
    def build(universe: DataFrame, listed: DataFrame, max_levels: int = 40, max_bits: int = MAX_BITS) -> Cascade:
        """universe and listed have one column, key string. Null keys are never members."""
        marked = materialise(
            universe.select("key", F.lit(0).alias("listed"))
            .unionByName(listed.select("key", F.lit(1).alias("listed")))
            .where("key is not null")
            .groupBy("key")
            .agg(F.max("listed").alias("listed"))
        )
        inside, outside = marked.where("listed = 1").select("key"), marked.where("listed = 0").select("key")
        levels: list[Level] = []
        while True:
            n = inside.count()
            if not n:
                break
            if len(levels) == max_levels:
                raise RuntimeError(f"mistakes are left after {max_levels} levels")
            bits = -(-n * BITS_PER_KEY // 32) * 32
            if bits > max_bits:
                raise TooLarge(f"{n} keys")
            levels.append(Level(bits, _words(inside, len(levels), bits)))
            mistakes = outside.where(_holds(F.col("key"), len(levels) - 1, levels[-1]))
            inside, outside = materialise(mistakes), inside
        return Cascade(tuple(levels))

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; a boolean, false for null."""
        # Beyond the last level: as the last one says.
        answer: Column = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(_holds(key, i, self.levels[i]), answer).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def _words(keys: DataFrame, level: int, bits: int) -> str:
    """The filter's words as JSON. What comes to the driver is one row for each SEGMENT of them."""
    at = F.explode(F.array(*_positions(F.col("key"), level, bits)))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("bits")
    )
    size = bits // 32

    def filled(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        begin = key[0].as_py() * SEGMENT
        dense = np.zeros(min(SEGMENT, size - begin), np.int64)
        dense[rows["word"].to_numpy() - begin] = rows["bits"].to_numpy()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "text": [",".join(map(str, dense.tolist()))]})

    segments = words.withColumn("segment", F.floor(F.col("word") / SEGMENT).cast("int")).groupBy("segment").applyInArrow(filled, "segment int, text string")
    held = {r["segment"]: r["text"] for r in segments.collect()}
    none = [",".join(["0"] * min(SEGMENT, size - begin)) for begin in range(0, size, SEGMENT)]
    return "[" + ",".join(held.get(i, text) for i, text in enumerate(none)) + "]"


def _holds(key: Column, level: int, filter_: Level) -> Column:
    # Optimised to a literal.
    words = F.from_json(F.lit(filter_.words), "array<long>")
    every = F.lit(True)
    for p in _positions(key, level, filter_.bits):
        word = F.element_at(words, F.floor(p / 32).cast("int") + 1)
        every = every & (F.call_function("shiftright", word, (p % 32).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return every


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or
    the end. Both empty for null or without "://"."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return (
        F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER),
        F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1),
    )


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _suffixes(host: Column, most_labels: int) -> Column:
    """The host's domains of up to most_labels labels; no longer one can be listed."""
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), F.lit(most_labels))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, -k, k), "."))


def _tables(spark, rules: list[Rule] | DataFrame, blocked_domains: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    if isinstance(rules, list):
        cells = json.dumps([{"host": r.host, "path": r.path, "verdict": r.verdict} for r in rules])
        rules = spark.sql("SELECT inline(from_json(:rows, 'array<struct<host:string,path:string,verdict:string>>'))", args={"rows": cells})
    if isinstance(blocked_domains, list):
        blocked_domains = spark.sql("SELECT explode(from_json(:rows, 'array<string>')) AS domain", args={"rows": json.dumps(blocked_domains)})
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path"), (F.col("verdict") == "block").alias("block")
    )
    # "#" can't be in a host or a path's key: it keeps domains and rule keys apart.
    domains = blocked_domains.where("domain is not null").select(F.concat(F.lit("#"), "domain").alias("key"), F.size(F.split("domain", r"\.")).alias("labels"))
    return materialise(rules), materialise(domains)


def judge_urls(
    df: DataFrame,
    url_col: str,
    rules: list[Rule] | DataFrame,
    blocked_domains: list[str] | DataFrame,
    *,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict (allow or block); such columns of df are replaced.

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest one decides. Where
    none fits, a URL is blocked if its host or a parent domain is in blocked_domains.
    """
    rule_rows, domain_rows = _tables(df.sparkSession, rules, blocked_domains)
    # The lengths of paths in rules are few, as paths are short.
    shape = rule_rows.agg(F.max("labels").alias("labels"), F.sort_array(F.collect_set("path")).alias("paths")).first()
    most_labels = domain_rows.agg(F.max("labels")).first()[0]
    none = F.array().cast("array<string>")

    def rule_keys(h: Column, p: Column) -> Column:
        """Every rule key that a URL can ask for."""
        if not shape["labels"]:
            return none
        heads = F.transform(F.array(*map(F.lit, shape["paths"])), lambda n: F.when(F.length(p) >= n, F.substring(p, F.lit(1), n)))
        heads = F.filter(heads, lambda x: x.isNotNull())
        return F.array_distinct(F.flatten(F.transform(_suffixes(h, shape["labels"]), lambda s: F.transform(heads, lambda x: F.concat(s, x)))))

    def domain_keys(h: Column) -> Column:
        return F.transform(_suffixes(h, most_labels), lambda d: F.concat(F.lit("#"), d)) if most_labels else none

    host, path = host_and_path(F.col(url_col))
    out = df.withColumns({"host": host, "path": path})
    # A host is compared whole: an empty one asks for nothing.
    sites = out.select("host", "path").where("host <> ''")
    keys = F.explode(F.concat(rule_keys(F.col("host"), F.col("path")), domain_keys(F.col("host"))))
    try:
        listed = Cascade.build(sites.select(keys.alias("key")).distinct(), rule_rows.select("key").unionByName(domain_rows.select("key")), max_bits=max_bits)
        blocks = Cascade.build(rule_rows.select("key"), rule_rows.where("block").select("key"), max_bits=max_bits)
    except TooLarge:
        return _by_join(out, sites.select("host", "path", keys.alias("key")), sites, rule_rows, domain_rows)
    known = F.col("host") != ""
    fitting = F.filter(rule_keys(F.col("host"), F.col("path")), listed.contains)
    rule = F.when(known, F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"])
    banned = known & F.exists(domain_keys(F.col("host")), listed.contains)
    return _with_verdict(out.withColumn("rule", rule), blocks.contains(F.col("rule")), banned)


def _with_verdict(out: DataFrame, rule_blocks: Column, banned: Column) -> DataFrame:
    block = F.when(F.col("rule").isNotNull(), rule_blocks).otherwise(banned)
    return out.withColumn("verdict", F.when(block, "block").otherwise("allow"))


def _by_join(out: DataFrame, asked: DataFrame, sites: DataFrame, rule_rows: DataFrame, domain_rows: DataFrame) -> DataFrame:
    """The same for lists of any size: each distinct host and path asks for its keys, by joins that keep hot keys apart."""
    entries = rule_rows.groupBy("key").agg(F.max("block").alias("block")).unionByName(
        domain_rows.select("key", F.lit(True).alias("block")).distinct()
    )
    asked = materialise(asked.distinct())
    counted = materialise(entries.join(asked.groupBy("key").agg(F.count("*").alias("copies")), "key"))
    hits = label_join(asked, counted, ["key"]).where("block is not null")
    of_rule = ~F.startswith("key", F.lit("#"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(of_rule, F.struct(F.length("key").alias("n"), "key", "block"))).alias("best"), F.max(~of_rule).alias("banned")
    )
    blocks, banned = fresh(out, "blocks"), fresh(out, "banned")
    copies = sites.groupBy("host", "path").agg(F.count("*").alias("copies"))
    labels = materialise(copies.join(best, ["host", "path"]).select(
        "host", "path", "copies", F.col("best")["key"].alias("rule"), F.col("best")["block"].alias(blocks), F.col("banned").alias(banned)
    ))
    judged = label_join(out.drop("rule"), labels, ["host", "path"])
    return _with_verdict(judged, F.col(blocks), F.coalesce(F.col(banned), F.lit(False))).drop(blocks, banned).select(*[F.col(f"`{c}`") for c in [*[c for c in out.columns if c not in ("rule", "verdict")], "rule", "verdict"]])
