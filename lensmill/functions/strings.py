"""String functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(c: Column) -> Column:
    """Sort key that folds A-Z only, as NOCASE does."""
    return F.translate(c, UPPER, LOWER)


def like_any(text: str, *columns: Column) -> Column:
    """Substring search without ASCII case in any column; % and _ in the text stay wildcards."""
    pattern = f"%{nocase_text(text)}%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(nocase(c).like(pattern), F.lit(False))
    return hit


def nocase_text(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def parent_directory(path: Column) -> Column:
    """Everything before the last slash; '' without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot of the file name; '' without one."""
    return F.lower(F.regexp_extract(base_name(name), r"\.([^.]*)$", 1))


def source_version(mtime: Column, size: Column) -> Column:
    """The key mtime:size of a file's version."""
    return F.concat_ws(":", mtime.cast("string"), size.cast("string"))


def fts_expression(text: Column) -> Column:
    """User text as a query of quoted prefix tokens joined by OR; '' without tokens."""
    tokens = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.regexp_replace(t, r'["*()\-]', "")), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), t, F.lit('"*'))), " OR ")


def masked_error(message: Column, default: str = "unknown error") -> Column:
    """An error text without URIs and paths, at most 160 characters."""
    hidden = F.regexp_replace(F.regexp_replace(message, r"[A-Za-z][A-Za-z0-9+.\-]*://\S+", "<uri>"), r"/\S+", "<path>")
    return F.coalesce(F.nullif(F.left(F.trim(hidden), F.lit(160)), F.lit("")), F.lit(default))


def byte_size(size: Column, mb_digits: int = 1, kb_digits: int = 0) -> Column:
    """Bytes as text in the largest fitting unit: GB with two digits, MB and KB as given."""
    n = size.cast("double")
    return (
        F.when(size >= 1 << 30, F.format_string("%.2f GB", n / float(1 << 30)))
        .when(size >= 1 << 20, F.format_string(f"%.{mb_digits}f MB", n / float(1 << 20)))
        .when(size >= 1 << 10, F.format_string(f"%.{kb_digits}f KB", n / 1024.0))
        .otherwise(F.format_string("%d B", size))
    )


def not_blank(c: Column) -> Column:
    """c, or null where it is blank."""
    return F.when(F.trim(c) != "", c)


def first_not_blank(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(not_blank(c) for c in columns))
