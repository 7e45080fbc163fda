"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` holds the metrics as expressions over a text, ``RULES`` the
thresholds; ``apply_rules`` compiles both into projections of a single scan,
with no user functions and no shuffle. Repeated three-word windows are found
inside the row: window hashes are sorted together with their positions, equal
neighbours mark the repeated windows, and the marked positions are counted.

Null text counts as empty: no words, so ``base_failed``. Repeated rows are
judged one by one. Extra columns are kept; a column
that clashes with an output column is replaced by the output. Names that begin with
``__quality`` are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that it for as with was on be by at are this from or an a not have had he his they you which "
    "der die das und ist nicht von den mit dem des ein eine im zu auf für sich auch als es an "
    "le la les de des et un une du que qui dans en pour par sur au avec il elle est pas plus "
    "el los las del que y en un una por con para se su al lo como más no"
).split()

#: A rule keeps a text when low <= measure <= high; None leaves a side open.
RULES = [
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_word_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
]

_SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures of each whole text to its row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("__quality_t", text).withColumn("__quality_w", F.array_remove(F.split("__quality_t", _SPACE), ""))
    hashed = split.withColumn("__quality_h", F.transform("__quality_w", lambda w: F.xxhash64(w))).withColumn("__quality_n", F.size("__quality_w"))
    # the low bits of each window's hash give way to its position, so that one sort of longs brings equal windows together
    bits = hashed.withColumn("__quality_b", F.length(F.bin("__quality_n")))
    packed = F.transform("__quality_h", lambda h, i: F.call_function("shiftleft", F.xxhash64(h, F.get("__quality_h", i + 1), F.get("__quality_h", i + 2)), F.col("__quality_b")).bitwiseOR(i.cast("long")))
    ordered = bits.withColumn("__quality_s", F.when(F.col("__quality_n") >= 4, F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.col("__quality_n") - 2, F.lit(0))))).otherwise(F.array().cast("array<bigint>")))

    def at(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__quality_b")) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        """Equal hashes and, so that no collision counts, equal words."""
        equal = F.call_function("shiftright", x.bitwiseXOR(y), F.col("__quality_b")) == 0
        for j in range(3):
            equal = equal & (F.get("__quality_w", at(x) + j) == F.get("__quality_w", at(y) + j))
        return F.coalesce(equal, F.lit(False))

    marked = F.filter("__quality_s", lambda e, i: same(e, F.get("__quality_s", i + 1)) | (i > 0) & same(e, F.get("__quality_s", F.greatest(i - 1, F.lit(0)))))
    repeated = ordered.withColumn("__quality_m", F.transform(marked, at))
    m = F.col("__quality_m")
    covered = F.when(F.size(m) > 0, F.size(F.array_union(F.array_union(m, F.transform(m, lambda i: i + 1)), F.transform(m, lambda i: i + 2)))).otherwise(0)
    lines = F.filter(F.split("__quality_t", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    stops = sorted({v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())})
    counted = repeated.select(
        "*",
        F.length(F.translate("__quality_t", _BLANKS, "")).cast("long").alias("__quality_chars"),
        (F.length("__quality_t") - F.length(F.translate("__quality_t", "#*$%&|<>", ""))).cast("long").alias("__quality_symbols"),
        lines.alias("__quality_lines"),
        covered.cast("long").alias("__quality_rep"),
        F.size(F.filter("__quality_h", lambda h: h.isin(*[F.xxhash64(F.lit(w)) for w in stops]))).alias("__quality_stop"),
    )

    def computed(x: Column) -> Column:
        """Keeps a later filter on this measure from being copied, with all that it needs, below the projections."""
        return F.when(F.monotonically_increasing_id() >= 0, x)

    n, n_lines = F.col("__quality_n").cast("double"), F.size("__quality_lines")
    dup = n_lines - F.size(F.array_distinct("__quality_lines"))
    out = {
        "n_words": computed(F.col("__quality_n").cast("long")), "word_chars": F.col("__quality_chars"), "n_symbols": F.col("__quality_symbols"),
        "n_dup_lines": dup.cast("long"), "n_repeat_words": computed(F.col("__quality_rep")),
        "mean_word_chars": _ratio(F.col("__quality_chars"), n), "symbol_word_ratio": _ratio(F.col("__quality_symbols"), n),
        "stop_word_ratio": _ratio(F.col("__quality_stop"), n), "dup_line_ratio": _ratio(dup, n_lines), "repeat_word_ratio": _ratio(F.col("__quality_rep"), n),
    }
    mine = {c.lower() for c in out}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine]
    return counted.select(*rest, *[e.alias(c) for c, e in out.items()])


def apply_rules(docs: DataFrame, rules=RULES, text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Measures, ``base_failed``, one ``fails`` array of rule names, and ``kept``."""
    measured = measures(docs, text_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tests = []
    for name, low, high in rules:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(name) >= low)
        if high is not None:
            ok = ok & (F.col(name) <= high)
        tests.append(F.when(~ok, F.lit(name)))
    out = measured.withColumn("base_failed", base).withColumn("fails", F.array_compact(F.array(*tests)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("fails") == 0))
