"""Column functions that repair recognised text: casing, digits, gaps, noise and punctuation.

All are built-in expressions, so they stay in the JVM. Lengths and positions count code points. A letter is a
character of the Unicode classes Lu, Ll and Lt. A null text gives null. compat=True keeps the quirks that
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LETTER = r"\p{Lu}\p{Ll}\p{Lt}"

# Confusions of digits with letters, and what noise is made of.
WORD_DIGITS = ("oOilsSB", "0011558")
SEGMENT_DIGITS = ("OoIlLtTZzAaSs", "0011111228855")
STROKES = r"\]\[|!"
NOISE = r"ilILtT*\-_|!'`.,"
VERTICAL, HORIZONTAL = r"[ilIL|!]", r"[*\-_]"
HEAVY_RATIO, MIN_LETTERS, DOMINANT = 0.3, 3, 0.9


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class (the inside of brackets in a regular expression) text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ------------------------------------------------------------------ characters


def is_upper(text: Column) -> Column:
    """Whether upper-casing changes nothing; so digits are upper case."""
    return text == F.upper(text)


def is_digit(char: Column) -> Column:
    return char.rlike("^[0-9]$")


def is_letter(char: Column) -> Column:
    """Whether case makes a difference."""
    return F.lower(char) != F.upper(char)


def char_stats(text: Column, compat: bool = True) -> Column:
    """struct(letters, digits, spaces, uppercase, lowercase). compat: what is neither a letter nor a space counts as
    upper case, digits and punctuation included (T12)."""
    letters, upper = count_of(text, LETTER), count_of(text, r"\p{Lu}")
    spaces = count_of(text, " ")
    others = F.length(text) - letters - spaces if compat else F.lit(0)
    return F.struct(
        letters.alias("letters"), count_of(text, "0-9").alias("digits"), spaces.alias("spaces"),
        (upper + others).alias("uppercase"), (letters - upper).alias("lowercase"),
    )


def mostly_digits(text: Column) -> Column:
    return count_of(text, "0-9") > count_of(text, LETTER)


def mostly_uppercase(text: Column, compat: bool = True) -> Column:
    return let(char_stats(text, compat), lambda s: (s["letters"] > 0) & (s["uppercase"] > s["lowercase"]))


# ------------------------------------------------------------------ words


def digit_correction(word: Column) -> Column:
    """Letters that look like digits become digits."""
    return F.translate(word, *WORD_DIGITS)


def zero_to_o(word: Column) -> Column:
    """Zeros become O if upper-case letters outnumber the others, else o."""
    upper = count_of(word, r"\p{Lu}")
    big = upper > count_of(word, LETTER) - upper
    return F.when(big, F.replace(word, F.lit("0"), F.lit("O"))).otherwise(F.replace(word, F.lit("0"), F.lit("o")))


def fix_zeros(sentence: Column) -> Column:
    """Of words between single spaces, numbers get digits and others get letters."""
    fixed = F.transform(F.split(sentence, " "), lambda w: F.when(mostly_digits(w), digit_correction(w)).otherwise(zero_to_o(w)))
    return F.array_join(fixed, " ")


def tokens(sentence: Column) -> Column:
    """Words, runs of white space, and single marks of punctuation, in order. The currency sign ends a token and is lost."""
    return F.regexp_extract_all(sentence, F.lit(f"([{SPACE}]+|[.,!?;:]|[^{SPACE}.,!?;:¤]+)"), 1)


# ------------------------------------------------------------------ casing


def _raised(text: Column, n: Column, lower_rest: bool) -> Column:
    """text with the character behind its first n raised, and the rest lowered."""
    rest = F.substring(text, n + 2, F.length(text))
    return F.concat(F.substring(text, F.lit(1), n), F.upper(F.substring(text, n + 1, F.lit(1))), F.lower(rest) if lower_rest else rest)


def case_sentence(sentence: Column, compat: bool = True) -> Column:
    """Mostly upper case: all of it; else the first letter is raised and what follows lowered."""

    def by_counts(s: Column) -> Column:
        text, letters, upper = s["text"], s["letters"], s["upper"]
        others = F.length(text) - letters - s["spaces"] if compat else F.lit(0)
        return (
            F.when(letters == 0, text).when(upper + others > letters - upper, F.upper(text))
            .otherwise(let(F.length(F.regexp_extract(text, f"^[^{LETTER}]*", 0)), lambda n: _raised(text, n, True)))
        )

    counts = F.struct(sentence.alias("text"), count_of(sentence, LETTER).alias("letters"), count_of(sentence, r"\p{Lu}").alias("upper"), count_of(sentence, " ").alias("spaces"))
    return let(counts, by_counts)


def case_paragraph(text: Column, compat: bool = True) -> Column:
    """Each sentence, up to and with . ! ? or a line's end, by case_sentence()."""
    cut = F.regexp_extract_all(text, F.lit("([^.!?\n]*[.!?\n]|[^.!?\n]+)"), 1)
    return F.array_join(F.transform(cut, lambda s: case_sentence(s, compat)), "")


def line_case(line: Column) -> Column:
    """A line of three letters or more, nine in ten of one case: all upper case, or its first letter raised if it is
    a small one. Letters here are A-Z and a-z."""

    def by_counts(s: Column) -> Column:
        text, letters = s["text"], s["upper"] + s["lower"]
        first = let(F.length(F.regexp_extract(text, "^[^A-Za-z]*", 0)), lambda n: F.when(F.substring(text, n + 1, F.lit(1)).rlike("^[a-z]"), _raised(text, n, False)).otherwise(text))
        return (
            F.when(letters < MIN_LETTERS, text).when(s["upper"] / F.greatest(letters, F.lit(1)) >= DOMINANT, F.upper(text))
            .when(s["lower"] / F.greatest(letters, F.lit(1)) >= DOMINANT, first).otherwise(text)
        )

    return let(F.struct(line.alias("text"), count_of(line, "A-Z").alias("upper"), count_of(line, "a-z").alias("lower")), by_counts)


# ------------------------------------------------------------------ digits, gaps, noise


def digit_segments(line: Column) -> Column:
    """Runs of A-Z, a-z, 0-9 with a digit and at least as many digits as letters get digits only, where they can."""

    def fixed(run: Column) -> Column:
        mostly = run.rlike("^[A-Za-z]*[0-9]") & (count_of(run, "0-9") >= count_of(run, "A-Za-z"))
        return F.when(mostly, F.translate(run, *SEGMENT_DIGITS)).otherwise(run)

    runs = F.regexp_extract_all(line, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), 1)
    return F.when(line.rlike("[0-9]"), F.array_join(F.transform(runs, fixed), "")).otherwise(line)


def numeric_gaps(line: Column) -> Column:
    """Strokes beside a digit become 1; a line of digits and white space closes up; elsewhere a gap between a
    digit and a character before a digit becomes a point."""
    # A private character marks what stood behind a gap until it is mapped.
    mark = "\ue000"

    def told(gaps: Column) -> Column:
        for digit in sorted(set(SEGMENT_DIGITS[1])):
            letters = "".join(a for a, b in zip(*SEGMENT_DIGITS, strict=True) if b == digit)
            gaps = F.regexp_replace(gaps, f"{mark}[{letters}]", digit)
        return F.replace(gaps, F.lit(mark), F.lit(""))

    def closed(mapped: Column) -> Column:
        gaps = F.regexp_replace(mapped, f"([0-9])[{SPACE}]+([A-Za-z0-9])(?=[0-9])", f"$1.{mark}$2")
        pointed = let(gaps, lambda g: F.when(F.contains(g, F.lit(mark)), told(g)).otherwise(g))
        return F.when(line.rlike("[^0-9 \t\n\r]"), pointed).otherwise(F.regexp_replace(mapped, f"[{SPACE}]+", ""))

    # Without a digit nothing changes but a line of white space, which closes up.
    mapped = F.regexp_replace(line, f"(?<=[0-9])[{STROKES}]|[{STROKES}](?=[0-9])", "1")
    return F.when(line.rlike("[0-9]") | ~line.rlike("[^ \t\n\r]"), let(mapped, closed)).otherwise(line)


def is_noise(line: Column) -> Column:
    """Blank, or one or two strokes and marks."""
    return line.rlike(rf"^[{SPACE}]*[{NOISE}]{{0,2}}[{SPACE}]*$")


def drop_noise_lines(lines: Column) -> Column:
    """array<string> without noise lines. Where noise stands before a line that begins with a-z, it was its first
    letter: T of an upright and a level stroke, I of an upright one."""

    def without(all_: Column) -> Column:
        def strokes(i: Column) -> Column:
            """Of the noise right before line i."""
            none = F.struct(F.lit(False).alias("up"), F.lit(False).alias("level"))
            either = lambda a, x: F.struct((a["up"] | x["text"].rlike(VERTICAL)).alias("up"), (a["level"] | x["text"].rlike(HORIZONTAL)).alias("level"))
            return F.aggregate(F.slice(all_, F.lit(1), i), none, lambda a, x: F.when(x["noise"], either(a, x)).otherwise(none))

        def told(x: Column, i: Column) -> Column:
            letter = let(strokes(i), lambda a: F.when(a["up"] & a["level"], "T").when(a["up"], "I").otherwise(""))
            after_noise = F.coalesce(F.get(all_, i - 1)["noise"], F.lit(False))
            return F.when(x["noise"], F.lit(None)).when(after_noise & x["text"].rlike("^[a-z]"), F.concat(letter, x["text"])).otherwise(x["text"])

        return F.filter(F.transform(all_, told), lambda x: x.isNotNull())

    return let(F.transform(lines, lambda x: F.struct(x.alias("text"), is_noise(x).alias("noise"))), without)


def close_heavy_punctuation(text: Column) -> Column:
    """If under three in ten visible characters are A-Z, a-z, 0-9, all white space goes, line ends too (T17)."""

    def by_counts(s: Column) -> Column:
        share = s["known"] / F.greatest(s["visible"], F.lit(1)).cast("double")
        return F.when((s["visible"] > 0) & (share < HEAVY_RATIO), F.regexp_replace(s["text"], f"[{SPACE}]+", "")).otherwise(s["text"])

    visible = F.length(F.regexp_replace(text, "[ \t\n\r]+", ""))
    return let(F.struct(text.alias("text"), visible.alias("visible"), count_of(text, "A-Za-z0-9").alias("known")), by_counts)


def letter_confusions(text: Column) -> Column:
    """I] between letters is an H."""
    return F.regexp_replace(text, r"([A-Za-z])I\]([A-Za-z])", "$1H$2")


def punctuation_spacing(text: Column) -> Column:
    """White space before punctuation and closing brackets goes."""
    return F.regexp_replace(F.regexp_replace(text, rf"[{SPACE}]+([,.;:!?])", "$1"), rf"[{SPACE}]+([)\]}}])", "$1")


def post_process(text: Column) -> Column:
    """All of the above, in the order of a reader: lines, noise, the whole text."""
    # Every step sees the one before as a value.
    line = lambda x: let(line_case(x), lambda a: let(numeric_gaps(a), digit_segments))
    joined = F.array_join(drop_noise_lines(F.transform(F.split(text, "\n"), line)), "\n")
    done = let(joined, lambda t: punctuation_spacing(letter_confusions(close_heavy_punctuation(t))))
    return F.when(text == "", text).otherwise(done)


# ------------------------------------------------------------------ accuracy


def char_accuracy(expected: Column, actual: Column) -> Column:
    """1 minus the edit distance per expected character; of an empty expectation 1 if met, else 0."""
    n = F.length(expected)
    exact = F.when(F.length(actual) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(n == 0, exact).otherwise(1.0 - F.levenshtein(expected, actual) / F.greatest(n, F.lit(1)))


def positional_similarity(a: Column, b: Column) -> Column:
    """Percent of a's characters that b has at the same place."""
    same = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))
    )
    return (
        F.when(a == b, F.lit(100.0)).when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(same * 100.0 / F.greatest(F.length(a), F.lit(1)))
    )


def reduce_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def contains_spaces(text: Column) -> Column:
    return F.contains(text, F.lit(" "))
