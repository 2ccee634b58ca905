"""Path expressions: parts, temp/log/cache test and the seven lifting rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories (matched anywhere) and extensions of short-lived files.
TEMP_LOG_CACHE_DIRS = ("/tmp/", "/var/tmp/", "/var/log/", "/var/cache/")
TEMP_LOG_CACHE_EXTS = (".log", ".tmp", ".temp", ".cache", ".lock", ".pid")

# Roots of the lifting rules.
CONFIG_ROOTS = ("etc", "var")
BINARY_ROOTS = ("/bin", "/sbin", "/usr/bin", "/usr/sbin", "/usr/local/bin", "/usr/local/sbin")
LIBRARY_DIRS = ("lib", "lib32", "lib64")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    head = F.regexp_extract(p, r"(?s)^(.*/)", 1)
    return F.when(head.rlike(r"^/*$"), head).otherwise(F.regexp_replace(head, r"/+$", ""))


def extension(p: Column) -> Column:
    """Extension with its dot; leading dots of a hidden file are not an extension."""
    return F.regexp_extract(basename(p), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    b = basename(p)
    return F.substring(b, F.lit(1), F.length(b) - F.length(extension(p)))


def depth(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def strip_trailing_slash(p: Column) -> Column:
    return F.regexp_replace(p, r"/+$", "")


def is_temp_log_cache(p: Column) -> Column:
    hit = F.lit(False)
    for d in TEMP_LOG_CACHE_DIRS:
        hit = hit | p.contains(d)
    return hit | F.lower(extension(p)).isin(*TEMP_LOG_CACHE_EXTS)


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once for all places where ``then`` names it. Branches of a rule would each
    compute it anew."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lift_path(p: Column, root_files: bool = True) -> Column:
    """Generalised name of an absolute path, or null. ``root_files=False`` leaves out the rule for
    extension-less files directly under a configuration root, as the stand-alone path job does."""
    usable = p.startswith("/") & ~p.endswith("/")
    single_root = ~(p.startswith("//") & ~p.startswith("///"))
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    # a suffix needs one character before and one after the last dot
    suffix = lambda parts: F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"(?s)^.+\.([^.]+)$", 1)
    with_suffix = lambda parts: F.struct(parts.alias("parts"), suffix(parts).alias("suffix"))
    lifted = _once(_once(parts, with_suffix), lambda x: _lifted(x["parts"], x["suffix"], single_root, root_files))
    return F.when(usable, lifted)


def _lifted(parts: Column, suffix: Column, single_root: Column, root_files: bool) -> Column:
    """The seven rules in order on a path's parts and its last part's suffix."""
    n = F.size(parts)
    name = F.try_element_at(parts, F.lit(-1))
    bare = F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    has = F.length(suffix) > 0
    first = F.when(single_root, F.get(parts, F.lit(0)))
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))

    config = F.when(has & first.isin(*CONFIG_ROOTS) & (n >= 3), F.concat_ws(" ", first, second, suffix, F.lit("file")))
    config_root = F.when(~has & first.isin(*CONFIG_ROOTS) & (n == 2), F.concat(name, F.lit(" file")))
    parent = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), "/"), F.lit("/"))
    under_bin = F.lit(False)
    for root in BINARY_ROOTS:
        under_bin = under_bin | parent.startswith(root + "/")
    binary = F.when(has & single_root & under_bin, F.concat_ws(" ", bare, suffix, F.lit("file")))
    home = F.when(
        has & (first == "home") & (n >= 4), F.concat_ws(" ", F.lit("user"), third, bare, suffix, F.lit("file"))
    )
    root_home = F.when(
        has & (first == "root") & (n >= 3), F.concat_ws(" ", F.lit("root user"), second, bare, suffix, F.lit("file"))
    )
    flags = F.transform(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda x: x.isin(*LIBRARY_DIRS))
    from_end = F.array_position(F.reverse(flags), True)
    library = F.when(
        has & (from_end > 1), F.concat(F.try_element_at(parts, (n - from_end + 1).cast("int")), F.lit(" library file"))
    )
    other = F.when(has, F.concat(suffix, F.lit(" file")))
    rules = [config] + ([config_root] if root_files else []) + [binary, home, root_home, library, other]
    return F.when(n > 0, F.coalesce(*rules))
