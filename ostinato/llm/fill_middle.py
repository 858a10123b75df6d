"""Fill-in-the-middle examples from relational units.

A text is a row of units: runs of letters, and every other code point by itself. Cuts are asked for by the number of a unit, so they never
fall into a word. Texts are exploded with their positions, window running sums of the units' lengths give each unit its place, the cut
requests are joined by the unit's number, their places are aggregated for each document, and the texts are cut there.

It goes in two steps, so that few units become rows. Texts are first exploded into blocks of some hundred characters that end where a unit
does, with running sums of the blocks' units and characters. A request meets the one block that holds its unit, and only that block is
exploded into units. Everything is keyed by the document, so one exchange of the texts serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.llm.common import require

#: Fixed values of the format: the markers, the units, and the shares of the forms in hundredths.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = "1:"
BLOCK_CHARS = 256


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four numbers under 2^32 from the SHA-256 of the seed and the decimal id (null: no digits)."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _blocks(text: Column) -> Column:
    """The text in parts of BLOCK_CHARS code points and the letters that follow them: no run of letters is parted."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}[A-Za-z]*+"), F.lit(0))


def _units(text: Column) -> Column:
    """How many units a text has: each run of letters counts as one character."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def with_requests(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs(key, doc_id, text) with n (units), form, and the units after which prefix and middle end (null if plain)."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return docs.withColumn("n", _units(F.col("text"))).withColumn("form", form).withColumns({"first": cut(F.least(a, b)), "second": cut(F.greatest(a, b))})


def cut_places(keyed: DataFrame, seed: str = SEED) -> DataFrame:
    """keyed(key, doc_id, text), partitioned by key -> (key, n, form, prefix_end, middle_end): one row a key, places in code points.

    The places are null where the form is plain. Equal keys are equal rows and are cut once.
    """
    # doc_id is a grouping column so that every step reads the same columns, and Spark reuses the one exchange.
    once = keyed.groupBy("key", "doc_id").agg(F.first("text").alias("text"))
    asked = with_requests(once, seed).select("key", "n", "form", F.posexplode(F.array("first", "second")).alias("which", "unit"))

    pieces = once.select("key", F.posexplode(_blocks(F.col("text"))).alias("block", "piece"))
    sized = pieces.withColumns({"units": _units(F.col("piece")), "chars": F.length("piece")})
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = sized.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), zero) for c in ("units", "chars")})

    held = (asked["key"] == placed["key"]) & (asked["unit"] > placed["units_before"]) & (asked["unit"] <= placed["units_before"] + placed["units"])
    met = asked.join(placed, held, "left").select(asked["key"], "n", "form", "which", "unit", "units_before", "chars_before", "piece")
    rows = met.select("key", "n", "form", "which", "unit", "units_before", "chars_before", F.posexplode_outer(F.regexp_extract_all("piece", F.lit(UNIT), F.lit(0))).alias("at", "match"))
    upto = Window.partitionBy("key", "which").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("chars", F.sum(F.length("match")).over(upto))
    # A request before all units, or of a plain document, has no block and stands at 0 or nowhere.
    found = summed.where("at is null or units_before + at + 1 = unit")
    place = F.when(F.col("unit").isNotNull(), F.coalesce(F.col("chars_before") + F.col("chars"), zero))
    return found.groupBy("key").agg(
        F.first("n").alias("n"), F.first("form").alias("form"), F.max(F.when(F.col("which") == 0, place)).alias("prefix_end"), F.max(F.when(F.col("which") == 1, place)).alias("middle_end")
    )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n, form, prefix_chars, middle_chars, output.

    Null texts are empty; empty texts, and those that hold a marker, are plain: their output is the text, their lengths are null. Texts
    without letters have a unit per code point; a text of one run of letters has one unit, and is the whole of one part. A null id draws
    as an empty one. Repeated rows each keep their row and have equal results. An empty table gives no rows. Very long texts are cut
    whole; output and markers together must fit a string of Spark (2 GB). Columns other than the two named are not read.
    """
    require(docs, id_col, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Copies of one row meet under as many keys as there were partitions that held them, so that they don't make one key hot.
    keyed = own.withColumn("key", F.xxhash64("doc_id", "text", F.spark_partition_id())).repartition("key")
    cuts = cut_places(keyed, seed)
    cut = keyed.join(cuts, "key")
    to, end = F.col("prefix_end").cast("int"), F.col("middle_end").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), to), F.substring("text", to + 1, end - to), F.substring("text", end + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return cut.select("doc_id", "text", "n", "form", F.col("prefix_end").alias("prefix_chars"), (F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. No part holds a marker, so each marker stands once."""
    psm, spm = (f"(?s)^{a}(.*){b}(.*){MIDDLE}(.*)$" for a, b in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    return F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2")).when(form == "spm", F.regexp_replace(output, spm, "$2$3$1")).otherwise(output)
