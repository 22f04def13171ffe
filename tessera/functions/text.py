"""Column expressions on text: tokens, lines, patterns, relevance, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags of a line scan, in both comment styles.
TAGS = ("TODO", "FIXME", "HACK", "BUG", "XXX", "OPTIMIZE", "NOTE", "WARNING")
HASH_TAG = r"(?i)#\s*(" + "|".join(TAGS) + r")\b[:\s]*(.*)"
SLASH_TAG = r"(?i)//\s*(" + "|".join(TAGS) + r")\b[:\s]*(.*)"
PY_IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
JS_IMPORT = r"""import\s+.*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\)"""


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; no stemming, no stop words; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def tag_of(line: Column) -> Column:
    """(tag, text) of the first style that matches, or null: the # form before the // form."""
    found = lambda pattern: F.when(line.rlike(pattern), F.struct(F.upper(F.regexp_extract(line, pattern, 1)).alias("tag"), F.trim(F.regexp_extract(line, pattern, 2)).alias("text")))
    return F.coalesce(found(HASH_TAG), found(SLASH_TAG))


def python_imports(content: Column, whole: bool = False) -> Column:
    """Imported modules; by default the first dotted segment alone (a relative import gives '')."""
    both = F.transform(
        F.arrays_zip(F.regexp_extract_all(content, F.lit(PY_IMPORT), F.lit(1)).alias("a"), F.regexp_extract_all(content, F.lit(PY_IMPORT), F.lit(2)).alias("b")),
        lambda x: F.when(x["a"] != "", x["a"]).otherwise(x["b"]),
    )
    return F.array_distinct(both if whole else F.transform(both, lambda m: F.split_part(m, F.lit("."), F.lit(1))))


def js_imports(content: Column) -> Column:
    """Targets of import ... from and of require, in order of first appearance."""
    one = lambda k: F.regexp_extract_all(content, F.lit(JS_IMPORT), F.lit(k))
    return F.array_distinct(F.transform(F.arrays_zip(one(1).alias("a"), one(2).alias("b")), lambda x: F.when(x["a"] != "", x["a"]).otherwise(x["b"])))


def simple_relevance(distance: Column) -> Column:
    """max(0, int((1 - d) * 100))."""
    return F.greatest(F.lit(0), ((1 - distance) * 100).cast("int"))


def advanced_relevance(distance: Column) -> Column:
    """max(0, 1 - d / 2)."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("test") | low.contains("spec")


def is_config_path(path: Column) -> Column:
    return F.lower(path).rlike(r"config|settings|env|\.json|\.yaml|\.toml")


def readable_size(size: Column) -> Column:
    """Bytes as B, KB or MB, the last two with one decimal."""
    scaled = lambda unit, name: F.format_string(f"%.1f{name}", F.round(size / unit, 1))
    return F.when(size < 1024, F.format_string("%dB", size)).when(size < 1 << 20, scaled(1024, "KB")).otherwise(scaled(1 << 20, "MB"))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' without one or for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
