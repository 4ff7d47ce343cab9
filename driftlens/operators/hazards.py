"""What static references do not show: names in configuration, and archives that differ from what was declared.

Loops over all pairs of strings become equi joins: a name meets a package by the name's own prefixes, a path meets a
package by the path's own tails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.members import class_names, dotted
from .diff import three_way


def prefixes(name: Column, mark: str = ".") -> Column:
    """All proper and improper prefixes of a name that end at a mark: a, a.b, a.b.c."""
    parts = F.split(name, f"\\{mark}")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), mark))


def name_hits(entries: DataFrame, held: DataFrame) -> DataFrame:
    """app, pair, fqcn and found_in: dotted names in resources and string constants whose package is one of the
    library's, or below one. ``held``: pair and package (with slashes)."""
    texts = entries.where("kind = 'resource' AND text IS NOT NULL").select("app", F.concat(F.lit("resource:"), "entry").alias("place"), "text")
    strings = entries.where("kind = 'class'").select("app", F.concat(F.lit("string-constant in "), dotted(F.col("cls"))).alias("place"), F.explode("strings").alias("text"))
    names = texts.unionByName(strings).select("app", "place", F.explode(class_names(F.col("text"))).alias("fqcn")).distinct()
    of = F.regexp_extract("fqcn", r"^(.*)\.[^.]+$", 1)
    met = names.withColumn("package", F.explode(prefixes(of))).join(held.select("pair", dotted(F.col("package")).alias("package")), "package")
    return met.groupBy("app", "pair", "fqcn").agg(F.array_sort(F.collect_set("place")).alias("found_in"))


def judge_hits(hits: DataFrame, changes: DataFrame, classes: DataFrame) -> DataFrame:
    """The hits with intersects_change: the name is a changed or removed class, lies inside one, or is the beginning of one.

    The last case has no boundary on purpose, as the rule asks for: a.b.Conf also meets a.b.Config. All three are found by
    equi joins: a name's own prefixes against the changed classes, and a class's beginnings, as long as some hit is, against the names.
    """
    gone = changes.where("change = 'removed'").select("pair", "cls").unionByName(classes.where("status = 'changed'").select("pair", "cls")).select("pair", dotted(F.col("cls")).alias("changed")).distinct()
    inside = hits.select("pair", "fqcn", F.explode(prefixes(F.col("fqcn"))).alias("changed")).distinct().join(gone, ["pair", "changed"], "left_semi").select("pair", "fqcn")
    sizes = hits.groupBy("pair").agg(F.array_distinct(F.collect_set(F.length("fqcn"))).alias("sizes"))
    begins = gone.join(sizes, "pair").withColumn("n", F.explode(F.filter("sizes", lambda n: n <= F.length("changed")))).select("pair", F.expr("left(changed, n)").alias("fqcn"))
    found = inside.unionByName(begins.join(hits.select("pair", "fqcn").distinct(), ["pair", "fqcn"], "left_semi")).distinct().withColumn("intersects_change", F.lit(True))
    return hits.join(found, ["pair", "fqcn"], "left").withColumn("intersects_change", F.coalesce("intersects_change", F.lit(False)))


def embedded_coordinates(entries: DataFrame) -> DataFrame:
    """app, artifact and version of the build properties that an archive carries for what it bundles; a missing version is "?"."""
    files = entries.where(F.col("entry").startswith("META-INF/maven/") & F.col("entry").endswith("pom.properties") & F.col("text").isNotNull())
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: x.contains("=") & ~x.startswith("#"))
    last = lambda key: F.get(F.slice(F.transform(F.filter(lines, lambda x: x.startswith(f"{key}=")), lambda x: F.regexp_replace(x, f"^{key}=", "")), -1, 1), 0)
    rows = files.select("app", "entry", F.when(F.size(F.filter(lines, lambda x: x.startswith("artifactId="))) > 0, last("artifactId")).alias("artifact"), F.when(F.size(F.filter(lines, lambda x: x.startswith("version="))) > 0, last("version")).alias("version"))
    named = rows.where("artifact IS NOT NULL").select("app", "entry", "artifact", F.coalesce("version", F.lit("?")).alias("version"))
    return named.groupBy("app", "artifact").agg(F.max_by("version", "entry").alias("version"))


def shipped_by_class_path(entries: DataFrame, declared: DataFrame) -> DataFrame:
    """app and artifact of declared components whose classes an archive holds without saying so.

    ``declared``: app, grp, artifact. A class counts if its path contains the group as directories, or the artifact's name
    with hyphens as slashes, at any place (text, not whole directories: the group io also meets audio/).
    """
    slug = F.when(F.length("artifact") > 0, F.concat(F.replace("artifact", F.lit("-"), F.lit("/")), F.lit("/")))
    group = F.when(F.length("grp") > 0, F.concat(F.replace("grp", F.lit("."), F.lit("/")), F.lit("/")))
    wanted = declared.select("app", "artifact", F.explode(F.array_compact(F.array(group, slug))).alias("part"))
    sizes = wanted.groupBy("app").agg(F.collect_set(F.length("part")).alias("sizes"))
    # every end of a directory is the end of a possible match, as long as some part is
    folders = entries.where("kind = 'class'").select("app", F.regexp_extract("cls", "^(.*/)[^/]*$", 1).alias("folder")).where("folder <> ''").distinct().join(sizes, "app")
    ends = folders.select("app", "folder", "sizes", F.explode(F.filter(F.sequence(F.lit(1), F.length("folder")), lambda i: F.substring(F.col("folder"), i, F.lit(1)) == "/")).alias("end"))
    found = ends.withColumn("n", F.explode(F.filter("sizes", lambda n: n <= F.col("end")))).select("app", F.expr("substring(folder, end - n + 1, n)").alias("part")).distinct()
    return wanted.join(found, ["app", "part"], "left_semi").select("app", "artifact").distinct()


def inventory(entries: DataFrame, declared: DataFrame) -> DataFrame:
    """app, artifact and version of what the archives ship: embedded coordinates first, then declared components whose
    classes are there, with the declared version. ``declared``: app, grp, artifact, version."""
    embedded = embedded_coordinates(entries)
    silent = shipped_by_class_path(entries, declared.join(embedded, ["app", "artifact"], "left_anti"))
    return embedded.unionByName(declared.join(silent, ["app", "artifact"], "left_semi").select("app", "artifact", "version"))


def drift(shipped: DataFrame, declared: DataFrame) -> DataFrame:
    """app, artifact, declared and shipped version and kind of what differs, for applications that ship anything at all."""
    known = declared.join(shipped.select("app").distinct(), "app", "left_semi")
    kind = F.when(F.col("status") == "removed", "declared-not-shipped").when(F.col("status") == "added", "shipped-not-declared").otherwise("version-drift")
    met = three_way(known.select("app", "artifact", "version"), shipped.select("app", "artifact", "version"), ["app", "artifact"], "version").where("status <> 'same'")
    return met.select("app", "artifact", F.col("old_value").alias("declared"), F.col("new_value").alias("shipped"), kind.alias("kind"))


def relocated(entries: DataFrame, held: DataFrame) -> DataFrame:
    """app, pair, package and prefix: class files whose path holds a library's package behind some prefix.

    The first place at which the package (and a slash) stands in the path counts, as text, if that is not its beginning.
    """
    known = held.select("pair", "package").distinct()
    # the distinct lengths of package names: a few dozen numbers, whatever the number of packages
    sizes = F.array(*(F.lit(r[0]) for r in known.select(F.length("package")).distinct().collect())).cast("array<int>")
    paths = entries.where("kind IN ('class', 'unparsed')").select("app", "entry").distinct().withColumn("sizes", sizes)
    ends = paths.select("app", "entry", "sizes", F.explode(F.filter(F.sequence(F.lit(1), F.length("entry")), lambda i: F.substring(F.col("entry"), i, F.lit(1)) == "/")).alias("end"))
    parts = ends.withColumn("n", F.explode(F.filter("sizes", lambda n: n < F.col("end")))).select("app", "entry", F.expr("substring(entry, end - n, n)").alias("package")).distinct()
    at = F.expr("instr(entry, concat(package, '/'))")
    met = parts.join(known, "package").withColumn("at", at).where("at > 1")
    return met.select("app", "pair", "package", F.expr("left(entry, at - 1)").alias("prefix")).distinct()


def hazard_rows(drifted: DataFrame, moved: DataFrame, libraries: DataFrame) -> DataFrame:
    """app, kind and message of every hazard, each once."""
    said = F.when(F.col("kind") == "shipped-not-declared", F.format_string("%s %s ships with the archive but is not declared", "artifact", "shipped")).when(F.col("kind") == "version-drift", F.format_string("%s: %s is declared, %s ships; the declared tree is not the one that runs", "artifact", "declared", "shipped")).otherwise(F.format_string("%s %s is declared but no trace of it ships", "artifact", "declared"))
    copies = moved.join(libraries.select("pair", "library"), "pair").select("app", F.lit("relocated-copy").alias("kind"), F.format_string("%s: a copy of %s stands at %s%s, out of reach of a version change", "library", "package", "prefix", "package").alias("message"))
    return drifted.select("app", "kind", said.alias("message")).unionByName(copies).distinct()
