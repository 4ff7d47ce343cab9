"""How applications use libraries: one hop, through the library's own calls, and through a parent library.

Applications are ``entries`` of their archives with an ``app`` column; published deltas come as the three tables of
``delta.unpack``. An application that does not use a library has no row: nothing stands for "not used".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.members import display_key, dotted, package_of
from .delta import MEMBER, packages
from .graph import closure, dispatch

KEY = "struct<cls: string, name: string, desc: string>"


def references(entries: DataFrame) -> DataFrame:
    """app, owner, cls, name and desc of everything the classes of an application refer to; a class has null name and desc."""
    classes = entries.where("kind = 'class'").select("app", F.col("cls").alias("owner"), "refs", "class_refs")
    members = classes.select("app", "owner", F.explode("refs").alias("r")).select("app", "owner", "r.*")
    uses = classes.select("app", "owner", F.explode("class_refs").alias("cls"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("desc"))
    return members.unionByName(uses).distinct()


def without_bundled(entries: DataFrame, held: DataFrame) -> DataFrame:
    """The application's own view: classes in packages of any published library go, and with them, for an application
    that bundles some, what lies under META-INF/. ``held`` has package."""
    inside = held.select("package").distinct().withColumn("bundled", F.lit(True))
    marked = entries.withColumn("package", F.when(F.col("kind") == "class", package_of(F.col("cls")))).join(inside, "package", "left").withColumn("bundled", F.coalesce("bundled", F.lit(False)))
    bundles = marked.where("bundled").select("app").distinct().withColumn("bundles", F.lit(True))
    rows = marked.join(bundles, "app", "left").where(~F.col("bundled") & ~(F.coalesce("bundles", F.lit(False)) & (F.col("kind") == "resource") & F.col("entry").startswith("META-INF/")))
    return rows.select(*entries.columns)


def _keys(condition: Column) -> Column:
    """The distinct member keys that meet the condition, nulls sorted as empty text."""
    key = F.struct(F.col("cls").alias("a"), F.coalesce("name", F.lit("")).alias("b"), F.coalesce("desc", F.lit("")).alias("c"), F.struct(*MEMBER).alias("k"))
    return F.transform(F.array_sort(F.collect_set(F.when(condition, key))), lambda x: x["k"])


def _dotted(column: Column) -> Column:
    return F.array_sort(F.collect_set(dotted(column)))


def judged(used: DataFrame, changes: DataFrame, classes: DataFrame) -> DataFrame:
    """``used`` (pair, cls, name, desc, ...) with change, incompatible and the class's status, nulls where nothing changed."""
    c = changes.select(F.col("pair").alias("c_pair"), *(F.col(k).alias(f"c_{k}") for k in MEMBER), "change", "incompatible")
    same = (F.col("pair") == F.col("c_pair")) & (F.col("cls") == F.col("c_cls")) & F.col("name").eqNullSafe(F.col("c_name")) & F.col("desc").eqNullSafe(F.col("c_desc"))
    return used.join(c, same, "left").drop("c_pair", "c_cls", "c_name", "c_desc").join(classes, ["pair", "cls"], "left")


def _touch(rows: DataFrame, by: list[str]) -> DataFrame:
    """What each application touches of each pair, from judged references."""
    member, changed, broken = F.col("name").isNotNull(), F.col("change").isin("removed", "modified"), F.coalesce("incompatible", F.lit(False))
    key = F.struct(*MEMBER)
    return rows.groupBy(*by).agg(
        F.count_distinct(F.when(member, key)).alias("lib_call_sites"),
        _dotted(F.when(~member, F.col("cls"))).alias("lib_classes_used"),
        _keys(member & changed).alias("touched_changed"),
        _keys((member & broken) | (~member & (F.col("change") == "removed"))).alias("touched_incompatible"),
        _dotted(F.when(~member & (F.col("status") == "changed"), F.col("cls"))).alias("touched_impl_changed"),
        _dotted(F.col("owner")).alias("affected_app_classes"),
        _dotted(F.when(changed | broken, F.col("owner"))).alias("affected_app_classes_changed"),
    )


def intersect(refs: DataFrame, held: DataFrame, changes: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for every application and pair it uses: call sites, classes used, and what of the delta it touches.

    References meet libraries by the exact package of the class referred to.
    """
    used = refs.withColumn("package", package_of(F.col("cls"))).join(held, "package").select("app", "pair", "owner", *MEMBER).distinct()
    return _touch(judged(used, changes, classes), ["app", "pair"])


def calls(entries: DataFrame, key: str = "path") -> DataFrame:
    """key, owner, cls, name and desc of every call that a method makes, with the calling method as struct ``caller``."""
    members = entries.where("kind = 'class'").select(key, F.col("cls").alias("owner"), F.explode("members").alias("m"))
    return members.select(key, "owner", F.struct(F.col("owner").alias("cls"), "m.name", "m.desc").alias("caller"), F.explode("m.calls").alias("c")).select(key, "owner", "caller", "c.*")


def method_graph(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each archive: its methods (path, cls, name, desc), super edges (path, child, parent) and interface edges
    (path, cls, interface), the edges between the archive's own classes only."""
    classes = entries.where("kind = 'class'")
    defined = classes.select("path", "cls", F.explode("members").alias("m")).where("m.kind = 'method'").select("path", "cls", "m.name", "m.desc").distinct()
    own = classes.select("path", F.col("cls").alias("own")).distinct()
    supers = classes.select("path", F.col("cls").alias("child"), F.col("parent").alias("own")).join(own, ["path", "own"], "left_semi").withColumnRenamed("own", "parent").distinct()
    implements = classes.select("path", "cls", F.explode("interfaces").alias("own")).join(own, ["path", "own"], "left_semi").withColumnRenamed("own", "interface").distinct()
    return defined, supers, implements


def _inside(rows: DataFrame, held: DataFrame, scope: str = "path") -> DataFrame:
    """The rows whose class lies in a package of the same ``scope``."""
    return rows.withColumn("package", package_of(F.col("cls"))).join(held.select(scope, "package"), [scope, "package"], "left_semi").drop("package")


def reached_methods(app_calls: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(app, path, node) of the methods that calls into an archive lead to inside it, and (app, path, owner) of the callers
    that start it. ``app_calls``: app, owner, cls, name, desc; calls resolve by dispatch, at the entry and inside."""
    held = packages(entries)
    defined, supers, implements = method_graph(entries)
    entry = app_calls.withColumn("package", package_of(F.col("cls"))).join(held, "package").select("app", "path", "owner", *MEMBER).distinct()
    within = _inside(calls(entries).select("path", "caller", *MEMBER), held).distinct()
    asked = entry.select("path", *MEMBER).unionByName(within.select("path", *MEMBER)).distinct()
    targets = dispatch(asked, defined, supers, implements, ["path"], ["name", "desc"])
    node = F.struct(F.col("target").alias("cls"), "name", "desc")
    keys = ["path", *MEMBER]
    seeds = entry.join(targets, keys).select("app", "path", node.alias("node")).distinct()
    edges = within.join(targets, keys).select("path", F.col("caller").alias("src"), node.alias("dst")).distinct()
    return closure(seeds, edges, ["path"]), entry.select("app", "path", "owner").distinct()


def internal_chain(app_calls: DataFrame, entries: DataFrame, pairs: DataFrame, changes: DataFrame, classes: DataFrame) -> DataFrame:
    """What the library's own calls reach from the members an application calls: one row an application and pair, none
    where no call resolves. ``pairs``: pair and old_path, the archive whose calls are followed."""
    reached, owners = reached_methods(app_calls, entries)
    rows = reached.join(pairs.select("pair", F.col("old_path").alias("path")), "path").select("app", "pair", "node.*")
    member, broken = F.col("change").isin("removed", "modified"), F.coalesce("incompatible", F.lit(False))
    touched = judged(rows, changes, classes).groupBy("app", "pair").agg(
        F.count_distinct(F.struct(*MEMBER)).alias("closure_methods_reached"), _keys(member).alias("internal_touched_changed"), _keys(broken).alias("internal_touched_incompatible"),
        _dotted(F.when(F.col("status") == "changed", F.col("cls"))).alias("internal_touched_impl_changed"),
    )
    started = owners.join(pairs.select("pair", F.col("old_path").alias("path")), "path").groupBy("app", "pair").agg(_dotted(F.col("owner")).alias("internal_seed_owners"))
    return touched.join(started, ["app", "pair"])


def two_hop(app_entries: DataFrame, parent_entries: DataFrame, parents: DataFrame, held: DataFrame, changes: DataFrame, classes: DataFrame) -> DataFrame:
    """What applications reach of a library through its parent: one row an application and pair, none where an
    application uses nothing of the parent.

    ``parents``: pair and path, the parent's archive. Calls into the parent are followed inside it; the calls and
    class uses of the methods reached are what touches the library. ``via`` names the least calling class of each
    member; ``class_level_would_touch`` is what following whole classes would have touched.
    """
    app_calls = calls(app_entries, "app").select("app", "owner", *MEMBER).distinct()
    reached, _ = reached_methods(app_calls, parent_entries)
    inside = packages(parent_entries)
    refers = references(app_entries)
    uses = refers.where("name IS NULL").select("app", "owner", "cls").unionByName(app_calls.select("app", "owner", "cls")).distinct()
    entry = uses.withColumn("package", package_of(F.col("cls"))).join(inside, "package").select("app", "path", "owner", "cls").distinct()
    owners = entry.groupBy("app", "path").agg(_dotted(F.col("owner")).alias("affected_app_classes"))
    parent_classes = parent_entries.where("kind = 'class'")
    links = _inside(parent_classes.select("path", F.col("cls").alias("src"), F.explode("class_refs").alias("cls")), inside).join(parent_classes.select("path", "cls"), ["path", "cls"], "left_semi").select("path", "src", F.col("cls").alias("dst")).distinct()
    starts = entry.join(parent_classes.select("path", "cls"), ["path", "cls"], "left_semi").select("app", "path", F.col("cls").alias("node")).distinct()
    wide = closure(starts, links, ["path"])
    # from the methods reached into the library
    out_calls = calls(parent_entries).select("path", F.col("caller").alias("node"), *MEMBER)
    methods = parent_classes.select("path", "cls", F.explode("members").alias("m"))
    out_uses = methods.select("path", F.struct("cls", "m.name", "m.desc").alias("node"), F.explode("m.uses").alias("cls"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("desc"))
    into = held.join(parents, "pair").select("pair", "path", "package")
    hop = out_calls.unionByName(out_uses).withColumn("package", package_of(F.col("cls"))).join(into, ["path", "package"]).drop("package")
    used = reached.join(hop, ["path", "node"]).select("app", "pair", "path", F.col("node.cls").alias("owner"), *MEMBER).distinct()
    rows = judged(used, changes, classes)
    touched = _touch(rows, ["app", "pair", "path"]).drop("affected_app_classes", "affected_app_classes_changed")
    via = used.where("name IS NOT NULL").groupBy("app", "pair", "path", *MEMBER).agg(F.min("owner").alias("via"))
    named = via.groupBy("app", "pair", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(display_key(F.col("cls"), F.col("name"), F.col("desc")).alias("k"), dotted(F.col("via")).alias("v"))))).alias("via"))
    coarse_refs = parent_classes.select("path", F.col("cls").alias("node"), F.explode("refs").alias("r")).select("path", "node", "r.*").withColumn("package", package_of(F.col("cls"))).join(into, ["path", "package"]).drop("package")
    coarse = judged(wide.join(coarse_refs, ["path", "node"]).select("app", "pair", "path", *MEMBER).distinct(), changes, classes)
    would = coarse.where(F.col("change").isin("removed", "modified") | F.col("incompatible")).groupBy("app", "pair", "path").agg(F.array_sort(F.collect_set(display_key(F.col("cls"), F.col("name"), F.col("desc")))).alias("class_level_would_touch"))
    result = owners.join(parents.select("pair", "path"), "path")
    for part in (touched, named, would):
        result = result.join(part, ["app", "pair", "path"], "left")
    counts = reached.groupBy("app", "path").agg(F.count("*").alias("reachable_parent_methods"))
    wides = wide.groupBy("app", "path").agg(F.count("*").alias("reachable_parent_classes"))
    result = result.join(counts, ["app", "path"], "left").join(wides, ["app", "path"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return result.select(
        "app", "pair", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("lib_call_sites", "reachable_parent_methods", "reachable_parent_classes")),
        *(empty(c, "array<string>") for c in ("lib_classes_used", "touched_impl_changed", "class_level_would_touch")), *(empty(c, f"array<{KEY}>") for c in ("touched_changed", "touched_incompatible")),
        "affected_app_classes", F.array().cast("array<string>").alias("affected_app_classes_changed"), F.coalesce("via", F.create_map().cast("map<string,string>")).alias("via"),
    )


def third_party_packages(refs: DataFrame, entries: DataFrame, rated: DataFrame) -> DataFrame:
    """(app, package) that an application refers to members of and that are neither its own, nor the platform's, nor rated."""
    used = refs.where("name IS NOT NULL").select("app", package_of(F.col("cls")).alias("package")).where("package <> ''").distinct()
    platform = F.col("package").rlike("^(java|javax|jdk|sun)/")
    own = entries.where("kind = 'class'").select("app", package_of(F.col("cls")).alias("package")).distinct()
    return used.where(~platform).join(own, ["app", "package"], "left_anti").join(rated.select("package").distinct(), "package", "left_anti").select("app", "package")
