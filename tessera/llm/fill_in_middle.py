"""Fill-in-the-middle transformation by relational units.

1. Documents are dealt once, by a number for each row. All that follows keeps that partitioning, so texts cross
   the network once, whatever their units come to.
2. The units of each text that is to be rearranged are exploded with their ordinals; a window adds up their lengths.
3. A request for each text names two ordinals drawn from the hash of its id; the join with the units gives the places
   where these end, and an aggregate by document puts both beside the text.
4. Prefix, middle and suffix are substrings, joined in the order of the form.

All of it is DataFrame functions. A task streams its units in order; what it holds at once is one text with its units.

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays plain; a null id hashes
as the empty string and stays null; repeated rows are each transformed for themselves, to the same result; an empty table gives
an empty result; only the id and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free_name, named

#: A unit: a word with the blanks before it, or the blanks at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 42, 50, 80


def draws(id_: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of the id, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def units_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def form_of(text: Column, draw: list[Column], rate: int, spm_rate: int) -> Column:
    marked = F.lit(False)
    for s in SENTINELS:
        marked = marked | F.contains(text, F.lit(s))
    plain = (text == "") | marked | (draw[2] % 100 >= rate)
    return F.when(plain, "plain").when(draw[3] % 100 < spm_rate, "spm").otherwise("psm")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n (units), form, first_cut, last_cut (ordinals), prefix_chars, middle_chars (null if plain), output of every row.

    docs is read in a fixed order of rows in each partition, as a stored table is.
    """
    rows = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartition("row")
    draw = draws(F.col("id"), seed)
    form = form_of(F.col("text"), draw, rate, spm_rate)
    n = F.size(units_of(F.col("text"))).cast("long")
    requests = dealt.select("row", "id", "text", n.alias("n"), form.alias("form"))
    cuts = [h % (F.col("n") + 1) for h in draw[:2]]
    requests = requests.withColumns({"first_cut": F.least(*cuts), "last_cut": F.greatest(*cuts)})

    lengths = F.when(form != "plain", F.transform(units_of(F.col("text")), F.char_length))
    units = dealt.select("row", "id", F.posexplode_outer(lengths).alias("unit", "chars"))
    so_far = Window.partitionBy("row").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    units = units.select("row", "id", (F.col("unit") + 1).alias("ordinal"), F.sum("chars").over(so_far).alias("end"))
    asked = requests.select(F.col("row").alias("of"), "first_cut", "last_cut")
    met = units.join(asked, (F.col("row") == F.col("of")) & F.col("ordinal").isin(F.col("first_cut"), F.col("last_cut")))
    # the id is grouped by too, so that this reads the same columns of the dealt texts as all else and Spark deals them once
    ends = met.groupBy("row", "id").agg(*(F.max(F.when(F.col("ordinal") == F.col(f"{c}_cut"), F.col("end"))).alias(f"{c}_end") for c in ("first", "last")))

    out = requests.join(ends.drop("id"), "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in ("first_end", "last_end")})
    prefix = F.substring("text", F.lit(1), F.col("first_end"))
    middle = F.substring("text", F.col("first_end") + 1, F.col("last_end") - F.col("first_end"))
    suffix = F.substring("text", F.col("last_end") + 1, F.char_length("text"))
    rearranged = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    cut = F.col("form") != "plain"
    names = ["n", "form", "first_cut", "last_cut", "prefix_chars", "middle_chars", "output"]
    return out.select(
        F.col("id").alias(free_name(id_col, names)), "n", "form", F.when(cut, F.col("first_cut")).alias("first_cut"), F.when(cut, F.col("last_cut")).alias("last_cut"),
        F.when(cut, F.col("first_end").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("last_end") - F.col("first_end")).cast("long")).alias("middle_chars"), rearranged.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged: no part of it holds a sentinel, so they part the output."""
    part = F.split(output, "|".join(map(re.escape, SENTINELS)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
