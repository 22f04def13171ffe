"""Corpus statistics: counts and their tops, naming, idioms, line scans, complexity and dependency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import base_name, lines, stem, tag_of

# Idioms by what must all be in a file's text.
ERROR_IDIOMS = {
    "raised exceptions": [["raise ", "Exception"]],
    "try blocks": [["try:"], ["try {"]],
    "result values": [["Result<"], ["Result::"]],
}
LOGGING_IDIOMS = {
    "logging module": [["import logging"], ["from logging"]],
    "named loggers": [["getLogger"], ["get_logger"]],
    "console": [["console.log"], ["console.error"]],
    "winston": [["winston"]],
    "pino": [["pino"]],
    "structlog": [["structlog"]],
    "loguru": [["loguru"]],
}


def counts(rows: DataFrame, *by: str, top: int | None = None) -> DataFrame:
    """Rows per key, largest first, ties by key; the first ``top``."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), *by).limit(top)


def naming_style(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: counts of snake, camel and kebab names and the style; kebab also where snake and camel tie."""
    name = stem(F.col(path))
    lower = F.substring(name, 1, 1).rlike(r"\p{Ll}")
    kind = F.when(name.contains("_") & lower, "snake").when(lower & F.substr(name, F.lit(2)).rlike(r"\p{Lu}"), "camel").when(name.contains("-"), "kebab")
    out = paths.select(kind.alias("k")).agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("snake", "camel", "kebab")])
    s, c, k = F.col("snake"), F.col("camel"), F.col("kebab")
    style = F.when(s + c + k == 0, "unknown").when((s > c) & (s > k), "snake_case").when((c > s) & (c > k), "camelCase").when(k > 0, "kebab-case").otherwise("mixed")
    return out.withColumn("style", style)


def test_patterns(paths: DataFrame, path: str = "path") -> DataFrame:
    """Counts of test file name patterns among names with test or spec."""
    low = F.lower(base_name(F.col(path)))
    kind = F.when(low.startswith("test_"), "test_*.py").when(low.endswith("_test.py") | low.endswith("_test.go"), "*_test.*").when(low.contains(".spec."), "*.spec.*").when(low.contains(".test."), "*.test.*")
    named = paths.filter(low.contains("test") | low.contains("spec")).select(kind.alias("pattern")).filter("pattern is not null")
    return counts(named, "pattern")


def _has(text: Column, forms: list[list[str]]) -> Column:
    out = F.lit(False)
    for form in forms:
        every = F.lit(True)
        for piece in form:
            every = every & text.contains(piece)
        out = out | every
    return out


def idioms(files: DataFrame, table: dict[str, list[list[str]]], text: str = "text", top: int = 3) -> DataFrame:
    """``idiom, n``: files that show each idiom, the most frequent first. All are counted in one pass."""
    flags = F.array_compact(F.array(*[F.when(_has(F.col(text), forms), F.lit(name)) for name, forms in table.items()]))
    return counts(files.select(F.explode(flags).alias("idiom")), "idiom", top=top)


def tagged_lines(files: DataFrame, path: str = "path", text: str = "text", tag: str | None = None) -> DataFrame:
    """``path, line_no, tag, text`` of marked comment lines, one per line at most."""
    rows = files.select(F.col(path).alias("path"), F.posexplode(lines(F.col(text))).alias("i", "line")).withColumn("t", tag_of(F.col("line")))
    out = rows.filter("t is not null").select("path", (F.col("i") + 1).alias("line_no"), F.col("t.tag").alias("tag"), F.col("t.text").alias("text"))
    return out if tag is None else out.filter(F.col("tag") == tag.upper())


def tag_counts(found: DataFrame) -> DataFrame:
    """Counts by tag, by file and in all, as grouping sets: ``tag, path, n``."""
    return found.groupingSets([[F.col("tag")], [F.col("path")], []], F.col("tag"), F.col("path")).agg(F.count("*").alias("n"))


def complexity_summary(functions: DataFrame) -> DataFrame:
    """One row of totals over ``path, language, name, line_start, complexity``; ``languages`` has the files of each."""
    each = functions.groupBy("language").agg(F.countDistinct("path").alias("files"), F.count("*").alias("functions"), F.sum("complexity").alias("total"), F.count_if(F.col("complexity") > 10).alias("complex"))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    languages = F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languages")  # a row for each language
    average = F.round(F.try_divide(F.sum("total"), F.sum("functions")), 2).alias("average")
    return each.agg(add("files"), add("functions"), add("total"), average, add("complex"), languages)


def version_classes(deps: DataFrame) -> DataFrame:
    """Counts of pinned, ranged and unpinned entries of ``name, version``; >= counts as ranged and unpinned."""
    v = F.coalesce("version", F.lit(""))
    return deps.agg(
        F.count("*").alias("total"), F.count_if(v.startswith("==")).alias("pinned"),
        F.count_if((v != "") & ~v.startswith("==") & ~v.isin(">", ">=")).alias("ranged"), F.count_if((v == "") | v.startswith(">")).alias("unpinned"),
    )


def test_folders(paths: DataFrame, path: str = "path", top: int = 3) -> DataFrame:
    """``folder``: the first ``top`` top folders, by name, that hold a file whose name has test or spec."""
    low = F.lower(base_name(F.col(path)))
    named = paths.filter((low.contains("test") | low.contains("spec")) & F.col(path).contains("/"))
    return named.select(F.split_part(F.col(path), F.lit("/"), F.lit(1)).alias("folder")).distinct().orderBy("folder").limit(top)


def in_prod_and_dev(deps: DataFrame) -> DataFrame:
    """Names that are among the prod and the dev entries."""
    return deps.filter(F.col("scope").isin("prod", "dev")).groupBy("name").agg(F.countDistinct("scope").alias("scopes")).filter("scopes = 2").select("name")


def duplicate_names(deps: DataFrame) -> DataFrame:
    return deps.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def version_strategy(deps: DataFrame) -> DataFrame:
    """Caret, tilde and exact versions of prod and dev entries (dev wins for a name in both)."""
    chosen = deps.filter(F.col("scope").isin("prod", "dev")).groupBy("name").agg(F.min_by("version", "scope").alias("v"))
    return chosen.agg(F.count_if(F.col("v").startswith("^")).alias("caret"), F.count_if(F.col("v").startswith("~")).alias("tilde"), F.count_if(F.col("v").rlike("^[0-9]")).alias("exact"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Percent of hits; 0 without any access."""
    return F.coalesce(F.try_divide(hits * 100.0, hits + misses), F.lit(0.0))
