"""Mapping readiness and schema matching over catalog tables: every column of every dataset at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dictionary import ALIASES, FIELDS, REQUIRED, label
from ..functions.mapping import type_family

#: Scores of an exact id, alias and label; bound, parts and least of the token score; bonuses by type and profile.
EXACT, ALIAS, LABEL = 0.92, 0.88, 0.86
TOKENS, DICE, CONTAINS, GENERIC, LEAST_TOKENS = 0.76, 0.65, 0.35, 0.78, 0.26
TYPE_BONUS = {"exact": 0.08, "compatible": 0.04, "incompatible": -0.15, "unknown": 0.0}
PROFILE_BONUS = 0.02
#: Words that say little, and short words with what they stand for.
GENERIC_WORDS = "amount code date flag id name number rate status total value".split()
SHORT = {
    "acct": "account", "accts": "accounts", "amt": "amount", "ar": "accounts receivable", "bal": "balance", "bb": "borrowing base", "bps": "basis points", "ccy": "currency", "conc": "concentration", "curr": "current",
    "cust": "customer", "dt": "date", "eff": "effective", "elig": "eligible", "exp": "expiration", "fac": "facility", "flg": "flag", "grossar": "gross accounts receivable", "ind": "indicator", "inv": "inventory",
    "lim": "limit", "ln": "loan", "nbr": "number", "no": "number", "num": "number", "orig": "original", "pct": "rate", "perc": "rate", "prin": "principal", "qty": "quantity", "rcbl": "receivable", "recv": "receivable",
    "rpt": "reporting", "src": "source", "tot": "total", "val": "value",
}
#: Families of native types that a logical type takes as they are, and those that it can take by a safe cast.
TAKES = {"identifier": "text integer", "string": "text", "integer": "integer", "decimal": "decimal float", "currency": "decimal float", "percentage": "decimal float", "boolean": "boolean", "date": "date", "datetime": "datetime"}
CASTS = {"integer": "decimal float text", "decimal": "integer text", "currency": "integer text", "percentage": "integer text", "boolean": "text", "date": "datetime text", "datetime": "date text"}
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def plain_words(name: Column) -> Column:
    """The words of a name with one space between: no accents, camel case split, ``%`` reads rate and ``&`` and."""
    split = F.regexp_replace(F.translate(name, *_ACCENTS), "([a-z0-9])([A-Z])", "$1 $2")
    text = F.lower(F.replace(F.replace(split, F.lit("%"), F.lit(" rate ")), F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def tokens(words: Column) -> Column:
    """Distinct words, short ones spelt out."""
    table = F.create_map(*[x for k, v in SHORT.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    return F.array_distinct(F.flatten(F.transform(F.split(words, " "), lambda w: F.coalesce(F.try_element_at(table, w), F.array(w)))))


def compatibility(native: Column, logical: Column) -> Column:
    """exact, compatible, incompatible, or unknown for native types of no family."""
    family = type_family(native)
    fits = lambda table: F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v.split()]))]), logical), family), F.lit(False))
    return F.when(family == "unknown", "unknown").when(fits(TAKES), "exact").when(fits(CASTS), "compatible").otherwise("incompatible")


def variants(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """(target, logical_type, name, base): the names a field goes by and the score of each. Some hundred rows, as the dictionary."""
    more = ALIASES if aliases is None else aliases
    rows = [(n, k, v, base) for n, k in FIELDS for v, base in [(n, EXACT), (label(n), LABEL), *((a, ALIAS) for a in more.get(n, "").split())]]
    return spark.createDataFrame(rows, "target string, logical_type string, name string, base double")


def suggest(columns: DataFrame, k: int = 5, profile: str | None = None, least: float = 0.3, aliases: dict[str, str] | None = None) -> DataFrame:
    """The best ``k`` canonical fields of each (dataset, column_name, native_type): score from ``least`` to 1, and type_fit.

    An equal name scores by its kind; else the words in common count (dice and containment, less if all are generic), and too
    few of them give no candidate. The type moves the score, a field that ``profile`` needs raises it. Only pairs that share
    a word are formed: an equi-join on words with the small dictionary, not a product.
    """
    spark = columns.sparkSession
    src = columns.withColumn("norm", plain_words(F.col("column_name"))).where("norm <> ''").withColumn("words", tokens(F.col("norm")))
    names = variants(spark, aliases).withColumn("t_norm", plain_words(F.col("name"))).withColumn("t_words", tokens(F.col("t_norm")))
    pairs = src.withColumn("w", F.explode("words")).join(F.broadcast(names.withColumn("w", F.explode("t_words"))), "w").drop("w")
    shared = F.array_intersect("words", "t_words")
    n = F.size(shared)
    dice = 2.0 * n / (F.size("words") + F.size("t_words"))
    inside = n / F.least(F.size("words"), F.size("t_words"))
    generic = F.size(F.array_except(shared, F.array(*[F.lit(g) for g in GENERIC_WORDS]))) == 0
    alike = (DICE * dice + CONTAINS * inside) * F.when(generic, GENERIC).otherwise(1.0)
    best = pairs.groupBy("dataset", "column_name", "native_type", "target", "logical_type").agg(F.max(F.when(F.col("norm") == F.col("t_norm"), F.col("base"))).alias("equal"), F.max(alike).alias("alike"))
    by_name = F.coalesce("equal", F.when(F.col("alike") >= LEAST_TOKENS, F.least(F.lit(TOKENS), F.col("alike") * TOKENS)))
    fit = compatibility(F.col("native_type"), F.col("logical_type"))
    bonus = F.element_at(F.create_map(*[x for c, v in TYPE_BONUS.items() for x in (F.lit(c), F.lit(v))]), F.col("type_fit"))
    needed = F.when(F.col("target").isin(*REQUIRED[profile].split()), PROFILE_BONUS).otherwise(0.0) if profile else F.lit(0.0)
    scored = best.withColumn("type_fit", fit).withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), by_name + bonus + needed)), 4)).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("dataset", "column_name", "native_type").orderBy(F.col("score").desc(), "target"))
    return scored.select("dataset", "column_name", "native_type", "target", "type_fit", "score", rank.alias("rank")).where(F.col("rank") <= k)


def readiness(columns: DataFrame, mappings: DataFrame, required: list[str]) -> DataFrame:
    """(dataset, problem, item) for every dataset: unknown or repeated sources and targets, types that don't fit or need a cast,
    missing required fields and columns without a mapping."""
    spark = columns.sparkSession
    fields = F.broadcast(spark.createDataFrame(FIELDS, "target string, logical_type string"))
    problem = lambda df, name, item: df.select("dataset", F.lit(name).alias("problem"), F.col(item).alias("item"))
    source = columns.select("dataset", F.col("column_name").alias("source"), "native_type")
    out = problem(mappings.join(source, ["dataset", "source"], "left_anti"), "unknown_source", "source")
    out = out.union(problem(mappings.join(fields, "target", "left_anti"), "unknown_target", "target"))
    for c in ("source", "target"):
        out = out.union(problem(mappings.groupBy("dataset", c).count().where("count > 1"), f"duplicate_{c}", c))
    typed = mappings.join(source, ["dataset", "source"]).join(fields, "target").withColumn("fit", compatibility(F.col("native_type"), F.col("logical_type")))
    names = F.when(F.col("fit") == "incompatible", "type_mismatch").when(F.col("fit") == "compatible", "type_coercion").when(F.col("fit") == "unknown", "type_unknown")
    out = out.union(typed.where("fit <> 'exact'").select("dataset", names.alias("problem"), F.col("source").alias("item")))
    wanted = columns.select("dataset").distinct().withColumn("target", F.explode(F.array(*[F.lit(r) for r in required])))
    out = out.union(problem(wanted.join(mappings, ["dataset", "target"], "left_anti"), "missing_required", "target"))
    return out.union(problem(source.join(mappings, ["dataset", "source"], "left_anti"), "unmapped_column", "source"))
