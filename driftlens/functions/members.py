"""Scalar functions over class members, names and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access bits of compiled classes and members.
PUBLIC, STATIC, FINAL, PROTECTED, ABSTRACT, SYNTHETIC = 0x0001, 0x0008, 0x0010, 0x0004, 0x0400, 0x1000


def has(access: Column, bit: int) -> Column:
    return access.bitwiseAND(F.lit(bit)) != 0


def modifiers(access: Column) -> Column:
    """The modifier names that matter to callers, in a fixed order."""
    named = (("public", PUBLIC), ("protected", PROTECTED), ("static", STATIC), ("final", FINAL), ("abstract", ABSTRACT))
    return F.array_compact(F.array(*(F.when(has(access, bit), name) for name, bit in named)))


def api_bits(access: Column) -> Column:
    """The access bits that callers can notice; two members differ for them if these differ."""
    return access.bitwiseAND(F.lit(PUBLIC | PROTECTED | STATIC | FINAL | ABSTRACT))


def is_api(class_access: Column, member_access: Column) -> Column:
    """Public class; public or protected member that no compiler made up."""
    return has(class_access, PUBLIC) & (has(member_access, PUBLIC) | has(member_access, PROTECTED)) & ~has(member_access, SYNTHETIC)


def narrowed(old: Column, new: Column) -> Column:
    """Lost public, gained final or abstract, or toggled static."""
    lost = has(old, PUBLIC) & ~has(new, PUBLIC)
    gained = (has(new, FINAL) & ~has(old, FINAL)) | (has(new, ABSTRACT) & ~has(old, ABSTRACT))
    return lost | gained | (has(old, STATIC) != has(new, STATIC))


def package_of(cls: Column) -> Column:
    return F.regexp_extract(cls, "^(.*)/[^/]+$", 1)


def display_key(cls: Column, name: Column, desc: Column) -> Column:
    """pkg.Cls#name desc, or class pkg.Cls for the class itself."""
    return F.when(name.isNull(), F.concat(F.lit("class "), dotted(cls))).otherwise(F.concat(dotted(cls), F.lit("#"), name, F.coalesce(F.concat(F.lit(" "), desc), F.lit(""))))


def dotted(cls: Column) -> Column:
    return F.replace(cls, F.lit("/"), F.lit("."))


def parameter_types(desc: Column) -> Column:
    """Simple names of the object types in a descriptor's parameters; primitive types are left out."""
    inside = F.regexp_extract(desc, r"^\(([^)]*)\)", 1)
    return F.array_join(F.transform(F.regexp_extract_all(inside, F.lit("L([^;]+);"), F.lit(1)), lambda t: F.regexp_extract(t, "([^/]+)$", 1)), ", ")


def humanize(cls: Column, name: Column, desc: Column) -> Column:
    """Simple.name(Types), or the simple class name for the class itself."""
    simple = F.regexp_extract(cls, "([^/]+)$", 1)
    return F.when(name.isNull(), simple).otherwise(F.concat(simple, F.lit("."), name, F.when(desc.startswith("("), F.concat(F.lit("("), parameter_types(desc), F.lit(")"))).otherwise(F.lit(""))))


def test_class_of(name: Column) -> Column:
    """The last part of a test's name that begins with a capital letter; else the last part but one, or the only part.

    Parts are parted by dots or hashes; a null or blank name gives the empty string.
    """
    parts = F.split(F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit("#"), F.lit(".")), r"\.")
    capital = F.filter(parts, lambda t: t.rlike(r"^\p{Lu}"))
    fallback = F.get(parts, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.coalesce(F.get(capital, F.size(capital) - 1), fallback))


# Fixed value: what counts as a fully qualified name.
CLASS_NAME = r"[a-zA-Z_$][\w$]*(?:\.[a-zA-Z_$][\w$]*){2,}"


def class_names(text: Column) -> Column:
    """Dotted names of three or more parts, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CLASS_NAME), F.lit(0))))
