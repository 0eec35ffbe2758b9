"""Path and reference spellings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer blanks of a reference: ASCII and Unicode white space.
_OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
#: Spellings that need folding: empty, '.' and '..' segments.
_ODD = r"(^|/)\.{0,2}/|/\.{0,2}$|^\.{1,2}$"


def strip_outer(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER, "")


def fold_path(c: Column) -> Column:
    """The plain spelling of a path: no empty, '.' or resolvable '..' segment.

    Null stays null. A leading '/' is kept; '..' above the start is kept in a
    relative path and dropped in an absolute one.
    """
    c = F.regexp_replace(c, r"\\", "/")
    absolute = c.startswith("/")

    def step(acc: Column, seg: Column) -> Column:
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        stuck = (F.size(acc) == 0) | (F.element_at(acc, -1) == "..")
        up = F.when(stuck, F.when(absolute, acc).otherwise(F.concat(acc, F.array(seg)))).otherwise(popped)
        return (
            F.when(seg.isin("", "."), acc)
            .when(seg == "..", up)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    # element_at(-1) of an empty array raises under ANSI mode, so the fold keeps a sentinel in front
    segs = F.split(c, "/")
    folded = F.aggregate(segs, F.array(F.lit("..")), step)
    body = F.array_join(F.slice(folded, 2, F.greatest(F.size(folded) - 1, F.lit(0))), "/")
    full = F.when(absolute, F.concat(F.lit("/"), body)).otherwise(body)
    return F.when(c.rlike(_ODD), full).otherwise(c)


def plain_path(c: Column) -> Column:
    """Outer blanks off, path folded; null stays null, blank becomes ''."""
    return fold_path(strip_outer(c))


def plain_ref(c: Column) -> Column:
    """A symbol reference ``path#name:L..C..`` with its path in plain spelling.

    A reference without ``#`` is taken as a path. Null stays null and a blank
    reference becomes the empty string.
    """
    c = strip_outer(c)
    cut = F.instr(c, "#")
    path = F.when(cut > 0, F.substring(c, F.lit(1), cut - 1)).otherwise(c)
    rest = F.when(cut > 0, F.substring(c, cut, F.length(c))).otherwise(F.lit(""))
    odd = c.contains("./") | c.contains("//") | c.contains("\\") | c.startswith("/") | path.endswith("/")
    return F.when(odd, F.concat(fold_path(path), rest)).otherwise(c)


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """Lower-case text after the last dot of the file name, '' when there is none."""
    return F.lower(F.regexp_extract(file_name(c), r"[^.]\.([^.]+)$", 1))


def parent_dir(c: Column) -> Column:
    """Path without its last segment, '' at the top."""
    return F.regexp_replace(c, r"(^|/)[^/]*$", "")


def path_depth(c: Column) -> Column:
    return F.size(F.split(c, "/")).cast("long")


def module_key(c: Column) -> Column:
    """The last two parent directories joined by '/', '(root)' when there is none."""
    segs = F.filter(F.split(fold_path(c), "/"), lambda x: x != "")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    last = F.slice(dirs, F.greatest(F.size(dirs) - 1, F.lit(1)), 2)
    return F.when(F.size(dirs) <= 0, "(root)").otherwise(F.array_join(last, "/"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading path segments that two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: p.isNotNull() & q.isNotNull() & p.eqNullSafe(q))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("long")
