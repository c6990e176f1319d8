"""Reshaping of datasets: repeats, selections, splits, envelopes and field fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_ID = "^[0-9a-f]{20,}$"


def repeated(df: DataFrame, n: int, out: str = "copy") -> DataFrame:
    """n adjacent copies of each row."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def evaluation_copies(df: DataFrame, n: int) -> DataFrame:
    """One uid for all copies of a row, and _sample_idx."""
    return repeated(df.withColumn("uid", F.uuid()), max(n, 1), "_sample_idx")


def selected(df: DataFrame, row_idx: str, indices: Sequence[int]) -> DataFrame:
    """Rows by index, in the order and as often as given; negative and too large ones drop out."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), "position int, __i long").where("__i >= 0")
    return df.join(wanted, F.col(row_idx) == F.col("__i")).drop("__i")


def prefix_split(df: DataFrame, row_idx: str, first: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(row_idx) < first), df.where(F.col(row_idx) >= first)


def shuffle_key(key: Column, seed: int) -> Column:
    """An order that depends on seed and row alone, whatever the partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ratio_split(df: DataFrame, key: str, part: int, of: int, seed: int, out: str = "train") -> DataFrame:
    """Exactly floor(n * part / of) rows are marked.

    Ranks come from counts by the first hex digits of the shuffle key, so no task sorts the whole table.
    """
    d = df.withColumn("__k", shuffle_key(F.col(key), seed)).withColumn("__b", F.substring("__k", 1, 3))
    per = d.groupBy("__b").agg(F.count("*").alias("__c"))
    per = per.withColumn("__before", F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).withColumn("__n", F.sum("__c").over(Window.partitionBy(F.lit(1))))
    ranked = d.join(per, "__b").withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__k", key)))
    return ranked.withColumn(out, F.col("__r") <= F.floor(F.col("__n") * part / of)).select(*df.columns, out)


def page(df: DataFrame, order: Sequence[Column], limit: int | None, offset: int = 0, zero_is_all: bool = False) -> DataFrame:
    """A page in order; zero_is_all: a limit of 0 means none."""
    out = df.orderBy(*order).offset(offset)
    return out if limit is None or (zero_is_all and limit == 0) else out.limit(limit)


def until_target(df: DataFrame, group: Sequence[str], order: Sequence[str], counted: Column, target: int) -> DataFrame:
    """Counted rows up to the target-th of each group."""
    done = F.sum(counted.cast("int")).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__done", done).where(counted & (F.col("__done") <= target)).drop("__done")


def training_envelope(df: DataFrame, truth: Column, style: str = "rule", placeholder: str = "placeholder") -> DataFrame:
    """prompt, reward_model and extra_info (the whole row)."""
    return df.select(
        F.array(F.struct(F.lit("user").alias("role"), F.lit(placeholder).alias("content"))).alias("prompt"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(*df.columns).alias("extra_info"),
    )


def with_extra(df: DataFrame, extra_json: str, fields: Sequence[str]) -> DataFrame:
    """Fields of the row, and where they are missing those of its extra JSON; bad JSON leaves the row as it is."""
    v = F.try_parse_json(extra_json)
    kinds = dict(df.dtypes)
    return df.withColumns({f: F.coalesce(F.col(f), F.try_variant_get(v, f"$.{f}", kinds[f])) if f in kinds else F.try_variant_get(v, f"$.{f}", "string") for f in fields})


def level_number(level: Column) -> Column:
    """The last word of a level as a number, else 0."""
    return F.coalesce(F.try_element_at(F.split(level, r"\s+"), F.lit(-1)).try_cast("double"), F.lit(0.0))


def starred_rating(tags: Column) -> Column:
    """The first tag with a star that is a whole number without it, else 0."""
    numbers = F.transform(F.filter(tags, lambda t: t.contains("*")), lambda t: F.replace(t, F.lit("*"), F.lit("")).try_cast("int"))
    return F.coalesce(F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0)), F.lit(0))


def judge_mean(outputs: Column) -> Column:
    """Mean of the outputs that are numbers, those with "error" left out; null without any."""
    numbers = F.filter(F.transform(F.filter(outputs, lambda o: ~F.lower(o).contains("error")), lambda o: o.try_cast("double")), lambda n: n.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def instance_id(given: Column, repo: Column, commit: Column, image: Column) -> Column:
    """The given id unless it is a bare hash; else repo and commit, the repo of the image, the commit, the hash, unknown."""
    from_image = F.regexp_replace(F.element_at(F.split(F.element_at(F.split(image, "/"), -1), ":"), 1), "_final$", "")
    plain = F.when(given.isNotNull() & (given != "") & ~given.rlike(HEX_ID), given)
    return F.coalesce(plain, F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit("__"), F.left(commit, F.lit(8))), F.when(image.isNotNull() & commit.isNotNull(), F.concat(from_image, F.lit("__"), F.left(commit, F.lit(8)))), F.left(commit, F.lit(12)), given, F.lit("unknown"))


def pool_name(name: Column) -> Column:
    """Lower case, other signs as dashes, at most 63, no dash at the ends."""
    dashed = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.left(dashed, F.lit(63)), F.lit("-"))


def mirrored_image(image: Column, registry: str, namespace: str) -> Column:
    """The image's last path part under another registry and namespace."""
    return F.concat(F.lit(f"{registry}/{namespace}/"), F.element_at(F.split(image, "/"), -1))


def flat_fields(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as top-level columns with joined names; lists give their length too."""
    from pyspark.sql import types as T

    out: list[Column] = []

    def walk(schema: T.StructType, path: list[str]) -> None:
        for f in schema.fields:
            here = [*path, f.name]
            col = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                out.append(col.alias(separator.join(here)))
                if isinstance(f.dataType, T.ArrayType):
                    out.append(F.size(col).alias(separator.join([*here, "list_len"])))

    walk(df.schema, [])
    return df.select(*out)


def merged_lists(df: DataFrame, key: Sequence[str], entries: str) -> DataFrame:
    """key, name, values of maps merged by name."""
    return df.select(*key, F.explode(entries).alias("name", "value")).groupBy(*key, "name").agg(F.collect_list("value").alias("values"))


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows found in both. Each side is made distinct first, so values that fill a table meet as one row a side."""
    return a.distinct().intersect(b.distinct())
