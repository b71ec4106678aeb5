"""Fill-in-the-middle: a text is cut in three by one regular expression, made for its row from two counted quantifiers.

The unit is a code point, `(?s).`. `regexp_count` counts a text's units, and the two cut points a <= b follow from that count and a hash of the
id. The pattern unit{a}, unit{b-a}, rest, each a possessive group, then captures prefix, middle and suffix in one match, without any
backtracking; the replacement puts the groups in the order of the form. All of it is column expressions in the scan's own stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "."
BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90
SPM_BELOW = 20

WRITE = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
READ = {
    "psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2"),
    "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1"),
}


def unit_count(text: Column) -> Column:
    """How many units a text has: whole blocks of units are counted first, so that a long text isn't taken apart into single ones."""
    blocks = F.regexp_count(text, F.lit(f"(?s){UNIT}{{{BLOCK}}}+"))
    rest = F.regexp_replace(text, rf"(?s)\A(?:{UNIT}{{{BLOCK}}}+)*+", "")
    return blocks.cast("long") * BLOCK + F.regexp_count(rest, F.lit(f"(?s){UNIT}")).cast("long")


def _hash_group(digest: Column, nth: int) -> Column:
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, restored for every row of `docs` (doc_id, text).

    A null text counts as empty. The cut points and the form come from the sha256 of `seed`, a colon and doc_id (nothing after the colon where
    that is null), so rows that repeat give the same result. `form` is plain for empty texts, texts that hold one of the three marks, and the share from
    `plain_from` hundredths on; then the output is the text and the two lengths are null. Otherwise the suffix comes first in `spm_below` hundredths
    (spm), else the prefix (psm). `restored` is read back from output and form alone. Other columns are not read; an empty table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.withColumn("n", unit_count(F.col("text")))
    cuts = [F.pmod(_hash_group(F.col("digest"), k), F.col("n") + 1) for k in (0, 1)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("n") == 0) | marked | (F.pmod(_hash_group(F.col("digest"), 2), F.lit(100)) >= plain_from)
    form = F.when(plain, "plain").when(F.pmod(_hash_group(F.col("digest"), 3), F.lit(100)) < spm_below, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    pattern = F.format_string(rf"(?s)\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)({UNIT}*+)\z", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "spm", WRITE["spm"]).otherwise(WRITE["psm"])
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    cut = rows.select(
        "doc_id", "n", "form", F.when(F.col("form") != "plain", F.col("a")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"),
    )
    return cut.withColumn("restored", restore(F.col("output"), F.col("form")))


def restore(output: Column, form: Column) -> Column:
    """The text that `output` was made from: the marks can't be part of it, so each is found at its first place."""
    read = {name: F.regexp_replace(output, pattern, order) for name, (pattern, order) in READ.items()}
    return F.when(form == "psm", read["psm"]).when(form == "spm", read["spm"]).otherwise(output)
