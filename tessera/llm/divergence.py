"""Source divergence audit: how far the term distributions of a language's sources lie apart.

The distance of two sources is a sum over all kept terms, most of which
neither has often. It is priced by inclusion and exclusion over the supports:

* a term that neither source has costs a constant, so these terms are only counted;
* a term of one source is priced against the other's constant. That needs only how many
  terms have each count, a histogram per group, read as running sums;
* terms of both were priced twice that way; a join of the sparse postings corrects them.

So no table of sources times terms is ever made. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Letters A-Z, a-z and everything beyond ASCII make terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that must hold a term; added to each count; what probabilities are multiplied by; terms told per group.
LEAST_DOCS, ADDED, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50

GROUP = ("lang", "source")


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)); null without terms. Decimals hold the product."""
    whole = (count + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    per = (total + ADDED * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", whole, per) + 1)


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """How often each group uses each term that its language keeps: lang, source, term, n, total (in the language).

    A document's terms are exploded behind its distinct terms, so that one
    pass counts both occurrences and documents, combined before they are dealt.
    """
    terms = docs.select(*GROUP, F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    terms = terms.select("*", F.array_distinct("terms").alias("once"))
    flat = terms.select(*GROUP, F.size("once").alias("k"), F.posexplode(F.concat("once", "terms")).alias("pos", "term"))
    counted = flat.groupBy(*GROUP, "term").agg(F.count_if(F.col("pos") >= F.col("k")).alias("n"), F.count_if(F.col("pos") < F.col("k")).alias("in_docs"))
    of_lang = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"total": F.sum("n").over(of_lang), "in_docs": F.sum("in_docs").over(of_lang)})
    return counted.filter(F.col("in_docs") >= least_docs).select(*GROUP, "term", "n", "total")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Each group's size of support and words, its language's terms and words, and the price of a term that it lacks.

    lang, source, support, words, terms, lang_words, absent. A group without terms is there too.
    """
    of_lang = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_words"))
    of_group = kept.groupBy(*GROUP).agg(F.count("*").alias("support"), F.sum("n").alias("words"))
    groups = docs.select(*GROUP).distinct().join(of_group, list(GROUP), "left").join(of_lang, "lang", "left")
    groups = groups.fillna(0, ["support", "words", "terms", "lang_words"])
    return groups.withColumn("absent", price(F.lit(0), F.col("words"), F.col("terms")))


def mirrored(part: DataFrame) -> DataFrame:
    """A part of the distance of (source, item), given to (item, source) as well."""
    back = part.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return part.select("lang", "source", "item", "value").unionByName(back)


def pair_distances(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """The sum of differences over all kept terms of every two sources of a language, both ways: lang, source, item, value."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("item_absent"), F.col("support").alias("item_support"))
    pairs = groups.join(other, "lang").filter("source <> item")
    apart = F.abs(F.col("absent") - F.col("item_absent"))
    neither = pairs.select("lang", "source", "item", F.coalesce(apart * (F.col("terms") - F.col("support") - F.col("item_support")), F.lit(0)).alias("value"))

    # One source's terms against the other's constant: the bins of the histogram and the constants in one order of price.
    bins = priced.groupBy(*GROUP, F.col("p").alias("at")).agg(F.count("*").alias("bin")).withColumn("item", F.lit(None).cast("string"))
    probes = pairs.filter("terms > 0").select(*GROUP, F.col("item_absent").alias("at"), F.lit(0).cast("long").alias("bin"), "item")
    group = Window.partitionBy(*GROUP)
    below = group.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    mass = F.col("bin") * F.col("at")
    summed = bins.unionByName(probes).select("*", F.sum("bin").over(below).alias("n_below"), F.sum(mass).over(below).alias("below"), F.sum("bin").over(group).alias("n_all"), F.sum(mass).over(group).alias("all"))
    one_sided = summed.filter("item IS NOT NULL").select("lang", "source", "item", (F.col("at") * (2 * F.col("n_below") - F.col("n_all")) + F.col("all") - 2 * F.col("below")).alias("value"))

    # Terms of both: their own difference instead of the two one-sided prices and the constant that was taken off twice.
    one = priced.select("lang", "term", "source", "p", "absent")
    two = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("absent").alias("item_absent"))
    both = one.join(two, ["lang", "term"]).filter("source < item")
    corrected = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("item_absent")) - F.abs(F.col("q") - F.col("absent")) + apart
    overlap = both.groupBy("lang", "source", "item").agg(F.sum(corrected).alias("value"))

    parts = neither.unionByName(mirrored(one_sided)).unionByName(mirrored(overlap))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Where the sources of each language differ: lang, source, part, item, value, rank.

    A language keeps the terms that ``least_docs`` of its documents hold. A
    group (lang, source) and a language give each kept term the price
    1 + floor(10^9 (count + 5) / (N + 5 V)). Part ``pair`` has each other
    source of the language, with the summed differences of prices over all
    kept terms. Part ``term`` has the ``top_terms`` terms that a group uses and
    prices higher than its language, with the difference. Ranks are from 1 by
    value, descending, then by item in UTF-8 order.

    * Null texts, languages and sources count as empty; a document without terms still makes its group.
    * Each row is a document: repeated rows count each. Ties have ranks by item.
    * Without kept terms all pairs have value 0, and there are no ``term`` rows. An empty table gives no rows.
    * Texts are read whole. Other columns, whatever their names, are not read.
    """
    empty = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    kept = written(postings(docs, least_docs), "divergence-postings")
    groups = written(group_table(docs.select(*GROUP), kept), "divergence-groups")
    priced = kept.join(groups, list(GROUP)).withColumns({"p": price(F.col("n"), F.col("words"), F.col("terms")), "q": price(F.col("total"), F.col("lang_words"), F.col("terms"))})
    pairs = pair_distances(priced, groups).withColumn("part", F.lit("pair"))
    terms = priced.filter("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item"))
    columns = (*GROUP, "part", "item", F.col("value").cast("long").alias("value"), "rank")
    ranked = pairs.withColumn("rank", place).select(*columns)
    return ranked.unionByName(terms.withColumn("rank", place).filter(F.col("rank") <= top_terms).select(*columns))
