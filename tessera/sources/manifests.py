"""Dependency manifests as rows ``manifest, scope, name, version``; each file is one small text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def _between(rows: Column, starts, ends) -> Column:
    """Lines after the first that ``starts``, up to the first after it that ``ends``; none if nothing starts."""
    first = F.array_position(F.transform(rows, starts), True)
    rest = F.slice(rows, (first + 1).cast("int"), F.size(rows))
    last = F.array_position(F.transform(rest, ends), True)
    body = F.when(last > 0, F.slice(rest, 1, (last - 1).cast("int"))).otherwise(rest)
    return F.when(first > 0, body).otherwise(F.array().cast("array<string>"))


def _named(files: DataFrame, name: str) -> DataFrame:
    return files.filter(F.col("path") == name)


def _rows(files: DataFrame, entries: Column, scope: str, pattern: str) -> DataFrame:
    """Entries split into the name (up to the first character of ``pattern``) and what follows."""
    out = files.select(F.col("path").alias("manifest"), F.explode(entries).alias("e")).filter("e <> ''")
    name = strip(F.regexp_extract("e", f"^([^{pattern}]*)", 1))
    return out.select("manifest", F.lit(scope).alias("scope"), name.alias("name"), strip(F.substr("e", F.length(name) + 1)).alias("version"))


def pyproject(files: DataFrame) -> DataFrame:
    found = _between(_lines(F.col("text")), lambda x: x.startswith("dependencies") & x.contains("="), lambda x: x.startswith("]"))
    return _rows(_named(files, "pyproject.toml"), F.transform(found, lambda x: F.regexp_extract(x, '"([^"]+)"', 1)), "prod", r">=<!\s;")


def requirements(files: DataFrame) -> DataFrame:
    found = F.filter(_lines(F.col("text")), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    return _rows(_named(files, "requirements.txt"), found, "prod", r">=<!\s")


def package_json(files: DataFrame) -> DataFrame:
    one = "map<string,string>"
    parsed = _named(files, "package.json").select("path", F.from_json("text", f"dependencies {one}, devDependencies {one}, peerDependencies {one}").alias("j"))
    parts = [parsed.select(F.col("path").alias("manifest"), F.lit(scope).alias("scope"), F.explode(f"j.{field}").alias("name", "version")) for field, scope in (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def go_mod(files: DataFrame) -> DataFrame:
    """Lines inside all ``require (`` blocks with two tokens or more; comments are not stripped."""
    empty = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    fold = F.aggregate(
        _lines(F.col("text")),
        empty,
        lambda acc, x: F.struct(
            F.when(x.startswith("require ("), True).when(x == ")", False).otherwise(acc.inside).alias("inside"),
            F.when(acc.inside & (x != ")") & ~x.startswith("require (") & x.rlike(r"\S\s+\S"), F.array_append(acc.out, x)).otherwise(acc.out).alias("out"),
        ),
        lambda acc: acc.out,
    )
    out = _named(files, "go.mod").select(F.col("path").alias("manifest"), F.explode(fold).alias("e")).withColumn("t", F.split("e", r"\s+"))
    return out.select("manifest", F.lit("prod").alias("scope"), F.get("t", F.lit(0)).alias("name"), F.get("t", F.lit(1)).alias("version"))


def cargo(files: DataFrame) -> DataFrame:
    found = F.filter(_between(_lines(F.col("text")), lambda x: x == "[dependencies]", lambda x: x.startswith("[")), lambda x: x.contains("="))
    out = _named(files, "Cargo.toml").select(F.col("path").alias("manifest"), F.explode(found).alias("e"))
    bare = F.regexp_replace(strip(F.regexp_extract("e", r"^[^=]*=(.*)$", 1)), "^[\"']+|[\"']+$", "")
    return out.select("manifest", F.lit("prod").alias("scope"), strip(F.regexp_extract("e", r"^([^=]*)=", 1)).alias("name"), bare.alias("version"))


def all_dependencies(files: DataFrame) -> DataFrame:
    """Entries of all manifests at the root, as a bag."""
    out = pyproject(files)
    for part in (requirements, package_json, go_mod, cargo):
        out = out.unionByName(part(files))
    return out
