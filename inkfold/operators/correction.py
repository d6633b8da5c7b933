"""Text correction with a dictionary, as joins on the distinct tokens of a table.

dictionary is (idx, word): idx orders it, which decides ties. A token that is no word gets the first of its
confusions that is one, else the nearest word by edit distance. Only distinct tokens meet the dictionary.

The nearest word is looked for by what is left of words after deletions: two words within distance d have such a rest of
at most d deletions each in common. Where none is that near, words are compared with those whose length allows
for less than the best distance seen. So only words that may be the nearest meet, in joins on rests and lengths.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkfold.functions.text import case_paragraph, fix_zeros, mostly_digits, tokens
from inkfold.plans.shared import label_join, materialise

# What is tried for a character, in this order.
CONFUSIONS: list[tuple[str, list[str]]] = [
    ("0", ["O", "o", "B", "8"]),
    ("5", ["S", "s"]),
    ("l", ["L", "1", "i", "!"]),
    ("S", ["5"]),
    ("o", ["D", "0"]),
    ("O", ["D", "0"]),
    ("!", ["T", "I", "i", "l", "1"]),
    ("@", ["A", "a"]),
]

#: Words up to so many characters have rests after so many deletions.
REST_LENGTHS = ((20, 2), (200, 1))


def _rests(word: Column) -> Column:
    """The word and what is left of it after deletions."""

    def shorter(w: Column) -> Column:
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    out = F.array(word)
    for most, deletions in reversed(REST_LENGTHS):
        rests = F.array(word)
        level = rests
        for _ in range(deletions):
            level = F.array_distinct(F.flatten(F.transform(level, shorter)))
            rests = F.concat(rests, level)
        out = F.when(F.length(word) <= most, rests).otherwise(out)
    return F.array_distinct(out)


def _surely(word: Column) -> Column:
    """Every word within this distance has a rest in common with the word, as its own length is within bounds too."""
    out = F.lit(0)
    for most, deletions in reversed(REST_LENGTHS):
        out = F.when(F.length(word) <= most - deletions, deletions).otherwise(out)
    return out


def nearest_words(words: DataFrame, dictionary: DataFrame, col: str = "word") -> DataFrame:
    """(word, nearest, distance) for each distinct word: the least edit distance, then the longer, then the earlier."""
    known = materialise(dictionary.select("idx", F.col("word").alias("known"), F.lower("word").alias("low")).where("low is not null"))
    unique = materialise(words.select(F.col(col).alias("word")).where("word is not null").distinct().withColumn("w", F.lower("word")))
    distance = F.levenshtein("w", "low")
    best = F.min_by(F.struct("known", "d"), F.struct("d", -F.length("known"), "idx")).alias("b")

    def of(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("d", distance).groupBy("word", "w").agg(best)

    rests = known.select("idx", "known", "low", F.explode(_rests(F.col("low"))).alias("rest"))
    met = unique.select("word", "w", F.explode(_rests(F.col("w"))).alias("rest")).join(rests, "rest").drop("rest").distinct()
    seen = materialise(of(met))
    near = F.col("b.d") <= _surely(F.col("w"))
    # The others may be as far from the nearest as the best one seen, or as the distance to some word of the dictionary.
    left = unique.join(seen.where(near).select("word"), "word", "left_anti").join(seen.select("word", F.col("b.d").alias("seen")), "word", "left")
    some = known.select(F.min("low").alias("some")).first()[0]
    if some is None:
        return seen.select("word", F.col("b.known").alias("nearest"), F.col("b.d").alias("distance"))
    reach = F.coalesce("seen", F.levenshtein("w", F.lit(some)))
    wide = left.withColumn("reach", reach).withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.length("w") - F.col("reach")), F.length("w") + F.col("reach"))))
    far = of(wide.join(known.withColumn("n", F.length("low")), "n"))
    return seen.where(near).unionByName(far).select("word", F.col("b.known").alias("nearest"), F.col("b.d").alias("distance"))


def with_casing(word: Column, suggestion: Column, compat: bool = True) -> Column:
    """The suggestion in the word's casing. A word in s gets an s put on: always (compat, T13), else if one is missing."""
    last = F.substring(word, -1, 1)
    missing = F.length(word) - 1 == F.length(suggestion)
    add = (last == "s") | ((last == "S") & missing) if compat else (F.lower(last) == "s") & missing
    s = F.when(add, F.concat(suggestion, last)).otherwise(suggestion)
    kept = F.array_join(F.zip_with(F.split(word, ""), F.split(s, ""), lambda a, b: F.when(F.lower(a) == F.lower(b), a).otherwise(b)), "")
    return F.when(F.length(word) == F.length(s), kept).otherwise(s)


def confusions(word: Column) -> Column:
    """array<string>: what the word may have been, in the order of trial."""
    tried = [F.when(F.contains(word, F.lit(k)), F.replace(word, F.lit(k), F.lit(s))) for k, subs in CONFUSIONS for s in subs]
    return F.filter(F.array(*tried), lambda w: w.isNotNull())


def _worth(compat: bool) -> Column:
    """Whether a token may be corrected."""
    worth = (F.length("token") > 1) & ~mostly_digits(F.col("token"))
    return worth if compat else worth & ~F.col("token").rlike(r"^\s+$")


def correct_tokens(found: DataFrame, dictionary: DataFrame, compat: bool = True) -> DataFrame:
    """(token, fixed) for the distinct tokens of found(token) that aren't words, numbers or single characters.

    compat: runs of two or more spaces are tokens to correct like others (T14)."""
    worth = _worth(compat)
    known = dictionary.select(F.lower("word").alias("known")).distinct()
    unique = found.select("token").distinct().where(worth)
    unknown = materialise(unique.join(known, F.lower("token") == F.col("known"), "left_anti"))
    tried = unknown.select("token", F.posexplode(confusions(F.col("token"))).alias("trial", "guess"))
    hit = tried.join(known, F.lower("guess") == F.col("known")).groupBy("token").agg(F.min_by("guess", "trial").alias("guess"))
    rest = unknown.join(hit, "token", "left_anti")
    near = nearest_words(rest.select(F.lower("token").alias("word")), dictionary)
    guessed = rest.withColumn("word", F.lower("token")).join(near, "word").select("token", with_casing(F.col("token"), F.col("nearest"), compat).alias("fixed"))
    return hit.select("token", F.col("guess").alias("fixed")).unionByName(guessed)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _replaced(lines: pa.Array, fixed: pa.Array) -> pa.Array:
    """Tokens of lines, with those of fixed(token, fixed) replaced."""
    out = []
    for row, pairs in zip(lines.to_pylist(), fixed.to_pylist(), strict=True):
        by = {p["token"]: p["fixed"] for p in pairs or []}
        out.append(None if row is None else [[by.get(t, t) for t in line] for line in row])
    return pa.array(out, pa.list_(pa.list_(pa.string())))


def apply_correction(df: DataFrame, text_col: str, out_col: str = "corrected", dictionary: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """df with the corrected text: zeros and digits line by line and, with a dictionary, words and casing.

    Rows need no key. The distinct tokens of a text that may be corrected leave it; what comes back are its corrections."""
    lines = F.transform(F.split(F.col(f"`{text_col}`"), "\n"), fix_zeros)
    if dictionary is None:
        return df.withColumn(out_col, F.array_join(lines, "\n"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # Written, as the generated keys must not change between the branches.
    rows = materialise(df.select(F.monotonically_increasing_id().alias("key"), row.alias("row"), F.transform(lines, tokens).alias("lines")))
    token = rows.select("key", F.explode(F.array_distinct(F.flatten("lines"))).alias("token")).where(_worth(compat))
    counted = token.groupBy("token").agg(F.count("*").alias("copies"))
    fixed = materialise(correct_tokens(counted, dictionary, compat).join(counted, "token"))
    hits = label_join(token, fixed, ["token"]).where("fixed is not null")
    of_row = hits.groupBy("key").agg(F.collect_list(F.struct("token", "fixed")).alias("pairs"))
    done = rows.join(of_row, "key", "left").withColumn("lines", _replaced("lines", "pairs"))
    cased = F.array_join(F.transform("lines", lambda x: case_paragraph(F.array_join(x, ""), compat)), "\n")
    kept = [c for c in df.columns if c != out_col]
    return done.select(*[F.col("row")[c].alias(c) for c in kept], cased.alias(out_col))


def words_of(df: DataFrame, text_col: str) -> DataFrame:
    """A dictionary from a corpus: its lower-case words of two letters or more of a-z, the frequent first. It stands in for a word list."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z]{2,})"), 1)).alias("word"))
    counted = words.groupBy("word").count()
    # Few enough for one sorted partition, as a dictionary is.
    return counted.select((F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1).alias("idx"), "word")
