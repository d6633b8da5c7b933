import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.operators import correction, evaluate

WORDS = "apple banana orange the of hello world good morning special case if".split()


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "idx int, word string")


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["r"] for r in df.select("i", f(F.col("t")).alias("r")).orderBy("i").collect()]


def test_stats_and_digits(spark):
    assert one(spark, T.char_stats, "A b 9")[0].asDict() == {"letters": 2, "digits": 1, "spaces": 2, "uppercase": 2, "lowercase": 1}  # T12
    assert one(spark, T.mostly_digits, "", "0123456789", "123O", "l23O") == [False, True, True, False]
    assert one(spark, T.digit_correction, "123O", "l23O", "O123456789", "ol23456789", "") == ["1230", "1230", "0123456789", "0123456789", ""]
    assert one(spark, T.zero_to_o, "Hell0", "W0RLD", "123") == ["Hello", "WORLD", "123"]


def test_casing(spark):
    assert one(spark, T.case_paragraph, "hello world", "HELLO WORLD", "hello. world", "", None) == ["Hello world", "HELLO WORLD", "Hello. World", "", None]
    assert one(spark, T.line_case, "HELLo", "HELLOWORLDo", "hello world", "Hello", "ab", "123 abc") == ["HELLo", "HELLOWORLDO", "Hello world", "Hello", "ab", "123 Abc"]


def test_post_processing(spark):
    assert one(spark, T.digit_segments, "1O5 abc S5", "OOO", "a1b") == ["105 abc 55", "OOO", "a1b"]
    assert one(spark, T.numeric_gaps, "1 2 3", "1]3 a", "x 1 O5", "a ] b") == ["123", "113 a", "x 1.05", "a ] b"]
    assert one(spark, lambda t: T.drop_noise_lines(F.split(t, "\n")), "a\n\nb", "l\n-\nhe", "|\nhe", "|\nHe", "x\n|", "il") == [
        ["a", "b"], ["The"], ["Ihe"], ["He"], ["x"], [],
    ]  # T16
    assert one(spark, T.punctuation_spacing, "a , b )", "a\n.") == ["a, b)", "a."]
    assert one(spark, T.close_heavy_punctuation, "a ... \n ...", "abc .", "") == ["a......", "abc .", ""]  # T17
    assert one(spark, T.letter_confusions, "aI]bI]c") == ["aHbI]c"]
    assert one(spark, T.post_process, "", None) == ["", None]


def test_nearest_word(spark, dictionary):
    words = spark.createDataFrame([("appie",), ("oronge",), ("xyz",), ("appie",), (None,)], "word string")
    got = {r.word: r.nearest for r in correction.nearest_words(words, dictionary.where("idx < 3")).collect()}
    assert got["appie"] == "apple" and got["oronge"] == "orange" and len(got) == 3


def test_casing_of_suggestions_trap_t13(spark):
    df = spark.createDataFrame([("appLe", "apple"), ("oranges", "orange"), ("helloz", "hello"), ("glaas", "glass")], "w string, s string")
    rows = df.select("w", correction.with_casing(F.col("w"), F.col("s")).alias("a"), correction.with_casing(F.col("w"), F.col("s"), False).alias("b")).collect()
    assert {r.w: (r.a, r.b) for r in rows} == {"appLe": ("appLe", "appLe"), "oranges": ("oranges", "oranges"), "helloz": ("hello", "hello"), "glaas": ("glasss", "glass")}


def test_correction(spark, dictionary):
    texts = ["Hell0 W0rld", "Hello World", "HellB W0rld", "Hell0 W0rld\nG00d M0rning", "5pecial Ca5e", "", None, "the  world"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = [r.corrected for r in correction.apply_correction(df, "t").orderBy("i").collect()]
    assert plain[0] == "Hello World" and plain[6] is None
    full = [r.corrected for r in correction.apply_correction(df, "t", "corrected", dictionary).orderBy("i").collect()]
    assert full[:7] == ["Hello World".capitalize(), "Hello world", "Hello world", "Hello world\nGood morning", "Special case", "", None]
    assert full[7] != "The  world"  # T14
    fixed = [r.corrected for r in correction.apply_correction(df, "t", "corrected", dictionary, compat=False).orderBy("i").collect()]
    assert fixed[7] == "The  world"


def test_accuracy(spark):
    lev = spark.createDataFrame([("apple", "oragne", 5), ("apple", "annas", 4), ("", "abc", 3), ("abc", "", 3), ("abc", "abc", 0)], "expected string, actual string, d int")
    rows = evaluate.per_case(lev).collect()
    assert all(r.distance == r.d for r in rows)
    assert {(r.expected, r.actual): r.char_accuracy for r in rows}[("", "abc")] == 0.0
    total = evaluate.overall(evaluate.per_case(lev.where("expected <> ''"))).first()
    assert total.n_edits == 12 and total.n_chars == 16
    pos = spark.createDataFrame([("abcd", "abxd"), ("a", "a"), ("", "x"), ("ab", "abc")], "a string, b string")
    assert [r[0] for r in pos.select(T.positional_similarity(F.col("a"), F.col("b"))).collect()] == [75.0, 100.0, 0.0, 100.0]
    a = spark.createDataFrame([(1, "abX")], "k int, text string")
    b = spark.createDataFrame([(1, "ab")], "k int, text string")
    assert [(r.found, r.expected) for r in evaluate.aligned(a, b, "k").orderBy("pos").collect()] == [("a", "a"), ("b", "b"), ("X", "!")]
