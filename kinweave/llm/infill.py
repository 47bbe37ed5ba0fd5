"""Fill-in-middle: texts cut into prefix, middle and suffix by a marker that is put after each unit. Columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import SPACE, text_of

#: White space and the word after it, or white space alone; a cut is never inside one.
UNIT = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: The marker after each unit, the escape, and what follows the escape for an escape and for a marker of the text itself.
MARK, ESCAPE, OWN_ESCAPE, OWN_MARK = "\x01", "\x02", "e", "m"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80


def escape(text: Column) -> Column:
    """The text without ``MARK``. Escape, marker and their stand-ins aren't white space, so units stay the same units."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + OWN_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + OWN_MARK))


def unescape(text: Column) -> Column:
    """Takes markers out, then undoes ``escape``: each escape is followed by its stand-in, so pairs can't be misread."""
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + OWN_MARK), F.lit(MARK)), F.lit(ESCAPE + OWN_ESCAPE), F.lit(ESCAPE))


def mark(text: Column) -> Column:
    """The escaped text with a marker after each unit."""
    return F.regexp_replace(escape(text), F.lit(f"({UNIT})"), F.lit("$1" + MARK))


def part(marked: Column, begin: Column, end: Column) -> Column:
    """Units begin .. end-1 of a marked text, unescaped."""
    return unescape(_index(_index(marked, end), begin - end))


def _index(text: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(MARK), count.cast("int"))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. A text that is cut has no marker of its own, and none arises where
    parts meet, as a marker begins with a character that no marker ends in; so each marker is there once."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    split = lambda x, by, side: F.substring_index(x, by, side)
    middle, head = split(body, MIDDLE, -1), split(body, MIDDLE, 1)
    psm = F.concat(split(head, SUFFIX, 1), middle, split(head, SUFFIX, -1))
    spm = F.concat(split(head, PREFIX, -1), middle, split(head, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output; a row for each document.

    Of 100 documents ``rate`` are cut, ``spm_rate`` of 100 of those with the suffix first; cuts lie between units, their
    places follow from the id and the seed. Null and empty texts, and those that hold a marker, are plain. Repeated rows
    are cut alike, a null id like an empty one; an empty table gives no rows. Only doc_id and text are read, so other
    columns can't clash. Nothing is shuffled, and memory is a few times the longest text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    h = _draws(F.col("doc_id"), seed)
    rows = rows.select("doc_id", "text", mark(F.col("text")).alias("marked"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    count = F.char_length("marked") - F.char_length(F.replace(F.col("marked"), F.lit(MARK), F.lit("")))
    rows = rows.withColumn("n", count.cast("long"))
    own = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | own | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumns({"form": form, "cut1": F.least(one, two), "cut2": F.greatest(one, two)})
    cut = F.col("form") != "plain"
    spans = {"prefix": (F.lit(0), F.col("cut1")), "middle": (F.col("cut1"), F.col("cut2")), "suffix": (F.col("cut2"), F.col("n"))}
    rows = rows.withColumns({name: F.when(cut, part(F.col("marked"), *span)) for name, span in spans.items()})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(~cut, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def digests(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 (of the text as rebuilt from the output)."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    chars = lambda name: F.char_length(name).cast("long").alias(f"{name}_chars")
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
