"""Reachability: occurrences, resolved references and the classes of what nothing resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
CLASSES = ("orphaned", "test-only", "unresolved", "decorated", "test-support")
TEST_SUPPORT = r"(_for_tests|_for_test|_for_testing)$"


def occurrence_index(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, line) of every line that holds a name as a whole word; files: (file, text)."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    words = lines.select("file", (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))).alias("name"))
    return words.join(names.select("name").distinct(), "name", "left_semi").select("name", "file", "line")


def unreferenced(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Definitions (file, symbol, line) to which no reference exists elsewhere; references: (symbol, file, line)."""
    d, r = definitions.alias("d"), references.alias("r")
    elsewhere = (F.col("d.file") != F.col("r.file")) | (F.col("d.line") != F.col("r.line"))
    return d.join(r, (F.col("d.symbol") == F.col("r.symbol")) & elsewhere, "left_anti")


def resolved(modules: dict[str, DataFrame], definitions: DataFrame) -> DataFrame:
    """(dotted, symbol) of definitions that some reference resolves to; four equi-joins, one union.

    Each relation is made distinct before it meets another, so that repeated references, however many, multiply nothing.

    modules: names (dotted, name), attributes (dotted, base, attr), from_imports (dotted, is_package,
    module, name, asname), stars (dotted, module), imports (dotted, module, asname).
    """
    defs = definitions.select("dotted", "symbol").distinct()
    names, attributes = modules["names"].select("dotted", "name").distinct(), modules["attributes"].select("dotted", "base", "attr").distinct()
    imports = modules["from_imports"].select("dotted", "is_package", "module", "name", "asname").distinct()
    # used inside its own module
    own = defs.join(names.select("dotted", F.col("name").alias("symbol")), ["dotted", "symbol"], "left_semi")
    own = own.union(defs.join(attributes.select("dotted", F.col("attr").alias("symbol")), ["dotted", "symbol"], "left_semi"))
    # imported by name from its module or from a package that exposes the name
    exposed = imports.where("is_package").select(F.col("asname").alias("symbol"), F.col("dotted").alias("source")).distinct()
    sources = defs.select("dotted", "symbol", F.col("dotted").alias("source")).union(defs.join(exposed, "symbol").select("dotted", "symbol", "source")).distinct()
    taken = imports.select(F.col("module").alias("source"), F.col("name").alias("symbol"), F.col("dotted").alias("user")).distinct()
    direct = sources.join(taken, ["source", "symbol"]).where("user <> dotted").select("dotted", "symbol")
    # an attribute of a local name bound to its module
    leaf, parent = F.regexp_extract("dotted", r"([^.]*)$", 1), F.regexp_replace("dotted", r"\.?[^.]*$", "")
    homes = defs.select("dotted").distinct().select("dotted", leaf.alias("leaf"), parent.alias("parent"))
    bound = homes.join(modules["imports"].select(F.col("module").alias("dotted"), F.col("dotted").alias("user"), "asname").distinct(), "dotted").select("dotted", "user", "asname")
    bound = bound.union(homes.where("parent <> ''").join(imports.select(F.col("module").alias("parent"), F.col("name").alias("leaf"), F.col("dotted").alias("user"), "asname"), ["parent", "leaf"]).select("dotted", "user", "asname")).distinct()
    uses = attributes.select(F.col("dotted").alias("user"), F.col("base").alias("asname"), F.col("attr").alias("symbol")).distinct()
    qualified = bound.join(uses, ["user", "asname"]).where("user <> dotted").join(defs, ["dotted", "symbol"], "left_semi").select("dotted", "symbol")
    # a star import whose module uses the bare name
    stars = modules["stars"].select(F.col("dotted").alias("user"), F.col("module").alias("dotted")).where("user <> dotted").distinct()
    starred = stars.join(names.select(F.col("dotted").alias("user"), F.col("name").alias("symbol")), "user").join(defs, ["dotted", "symbol"], "left_semi").select("dotted", "symbol")
    return own.union(direct).union(qualified).union(starred).distinct()


def verdict(decorated: Column, occurs: Column, tested: Column, name: Column, orphans_block: bool = False) -> Column:
    """Class of a definition without a resolved reference; `block` only where orphans block."""
    quiet = ~occurs & ~decorated
    hook = F.rlike(name, F.lit(TEST_SUPPORT))
    return (
        F.when(quiet & tested & hook, "test-support").when(quiet & tested, "test-only").when(quiet, "block" if orphans_block else "orphaned")
        .when(decorated, "decorated").otherwise("unresolved")
    )


def rank(label: Column) -> Column:
    out = F.lit(len(CLASSES))
    for k, name in enumerate(CLASSES):
        out = F.when(label == name, k).otherwise(out)
    return out


def classify(symbols: DataFrame, resolved_symbols: DataFrame, occurrences: DataFrame, test_names: DataFrame, entry_points: DataFrame, orphans_block: bool = False) -> DataFrame:
    """(dotted, file, symbol, line, class, rank) of definitions nothing resolves to.

    symbols: (dotted, file, symbol, line, decorated); occurrences: (name, file, line); entry_points: (dotted, symbol).
    """
    key = ["dotted", "symbol"]
    left = symbols.join(resolved_symbols, key, "left_anti").join(entry_points, key, "left_anti").alias("s")
    seen = occurrences.alias("o")
    elsewhere = (F.col("s.file") != F.col("o.file")) | (F.col("s.line") != F.col("o.line"))
    hits = left.join(seen, (F.col("s.symbol") == F.col("o.name")) & elsewhere, "left_semi").select("file", "line", "symbol", F.lit(True).alias("occurs"))
    tests = test_names.select(F.col("name").alias("symbol"), F.lit(True).alias("tested")).distinct()
    rows = left.join(hits, ["file", "line", "symbol"], "left").join(tests, "symbol", "left")
    no = F.lit(False)
    label = verdict(F.col("decorated"), F.coalesce("occurs", no), F.coalesce("tested", no), F.col("symbol"), orphans_block)
    return rows.select("dotted", "file", "symbol", "line", label.alias("class")).withColumn("rank", rank(F.col("class")))
