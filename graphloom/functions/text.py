"""Scalar functions over paths, identifiers and text, as columns that stay in code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Text before the last slash; '.' for a root-level path."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def first_segment(path: Column) -> Column:
    """First path segment; a root-level file's is its own name."""
    return F.substring_index(path, "/", 1)


def top_directory(path: Column) -> Column:
    """First directory; '.' for a root-level file."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    return F.substring_index(basename(path), ".", 1)


def extension(path: Column) -> Column:
    file = basename(path)
    return F.when(file.contains("."), F.lower(F.substring_index(file, ".", -1))).otherwise(F.lit("none"))


def normalize_path(path: Column) -> Column:
    """Slashes for backslashes, no leading ./ and no doubled slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(slashed, r"\A(\./)+", ""), "/+", "/")


def resolve_dots(path: Column) -> Column:
    """Resolve . and .. segments; null if the path leaves its root."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.array().cast("array<string>")
    fold = F.aggregate(
        parts,
        start,
        lambda acc, s: F.when(acc.isNull(), acc)
        .when((s == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(fold, "/")


def safe_path(path: Column) -> Column:
    """Whether a repository path is relative, plain and without empty, . or .. segments."""
    bad = path.rlike(r"\A/|/\z|\\|[\x00-\x1F\x7F]|\A\s|\s\z") | F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return path.isNotNull() & ~bad


def identity(prefix: str, *parts: Column, digits: int = 64) -> Column:
    """prefix:hash of NUL-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(NUL, *parts), 256), 1, digits))


def package_name(specifier: Column) -> Column:
    """Package of an import specifier: two segments if scoped, one if not."""
    n = F.when(specifier.startswith("@"), 2).otherwise(1)
    return F.array_join(F.slice(F.split(specifier, "/"), F.lit(1), n), "/")


def diagram_id(value: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(value, "[^a-zA-Z0-9_]", "_"))


def diagram_text(value: Column) -> Column:
    """Text in quotes: a backslash before quotes and backslashes, spaces for line breaks."""
    return F.replace(F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit("\n"), F.lit(" "))


def human_bytes(value: Column) -> Column:
    """B, KB, MB or GB; one decimal from KB on."""
    def scaled(power: int, unit: str) -> Column:
        tenth = F.floor(value * 10 / float(1024**power) + 0.5)
        return F.concat(F.floor(tenth / 10).cast("long").cast("string"), F.lit("."), (tenth % 10).cast("long").cast("string"), F.lit(f" {unit}"))

    small = F.concat(value.cast("long").cast("string"), F.lit(" B"))
    return F.when(value < 1024, small).when(value < 1024**2, scaled(1, "KB")).when(value < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def position(content: Column, offset: Column) -> Column:
    """Line and column (struct, both from 1) of the character at an offset from 0."""
    before = F.substring(content, F.lit(1), offset)
    line = F.regexp_count(before, F.lit("\n")) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return F.struct(line.alias("line"), column.alias("column"))
