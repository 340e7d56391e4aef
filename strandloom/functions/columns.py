"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; Spark's and Python's own classes differ on other characters.
SPACE = r"[ \t\n\x0B\f\r]+"


def trim_cr(c: Column) -> Column:
    """Without one trailing carriage return."""
    return F.when(F.endswith(c, F.lit("\r")), F.left(c, F.length(c) - 1)).otherwise(c)


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.btrim(F.regexp_replace(c, SPACE, " "), F.lit(" "))


def words(c: Column) -> Column:
    """The non-blank tokens of a string."""
    return F.array_remove(F.split(c, SPACE), "")


def key_value(c: Column) -> tuple[Column, Column]:
    """Split at the first ``=``; without one, all is key and the value is empty."""
    at = F.instr(c, "=")
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.substr(c, at + 1)).otherwise(F.lit(""))


def uri_id(c: Column, index: Column) -> Column:
    """A name as part of an IRI: other characters become ``_``; ``sample_<index>`` if nothing is left."""
    clean = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._~-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.concat(F.lit("sample_"), index.cast("string")))


def slug(c: Column, default: str = "vcf") -> Column:
    """A name that is safe in file names."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit("")), F.lit(default))


def output_prefix(c: Column) -> Column:
    """A file name without ``.vcf`` or ``.vcf.gz``."""
    return F.regexp_replace(c, r"\.vcf(\.gz)?$", "")


def elapsed_seconds(c: Column) -> Column:
    """Seconds of ``[h:]m:s`` or plain seconds; null if it isn't one."""
    t = F.btrim(c)
    part = F.split(t, ":")
    n = [F.try_element_at(part, F.lit(-k)).try_cast("double") for k in (1, 2)]
    size = F.size(part)
    return F.when(size == 1, n[0]).when(size == 2, n[1] * 60 + n[0]).when(size == 3, F.try_element_at(part, F.lit(1)).try_cast("double") * 3600 + n[1] * 60 + n[0])


def lenient_int(c: Column) -> Column:
    """``'3.9'`` gives 3; blank or anything else that isn't a number gives null."""
    return F.btrim(c.cast("string")).try_cast("double").try_cast("bigint")


def format_bytes(c: Column, largest: str = "PB") -> Column:
    """Bytes as they are, then two decimals up to the unit ``largest``; ties go to the even digit."""
    out, units = F.format_string("%d B", c.cast("bigint")), ("KB", "MB", "GB", "TB", "PB")
    for k, unit in enumerate(units[: units.index(largest) + 1], 1):
        out = F.when(c >= 1024**k, F.format_string(f"%.2f {unit}", F.bround(c / float(1024**k), 2))).otherwise(out)
    return out


def format_duration(c: Column) -> Column:
    """``1.50s``, ``2m 3.0s`` or ``1h 2m 3.0s``; negative counts as 0, ties go to the even digit."""
    s = F.greatest(c.cast("double"), F.lit(0.0))
    minutes, rest = F.floor(s / 60), s - F.floor(s / 60) * 60
    return (
        F.when(s < 60, F.format_string("%.2fs", F.bround(s, 2)))
        .when(minutes < 60, F.format_string("%dm %.1fs", minutes, F.bround(rest, 1)))
        .otherwise(F.format_string("%dh %dm %.1fs", F.floor(minutes / 60), minutes - F.floor(minutes / 60) * 60, F.bround(rest, 1)))
    )


def time_log(c: Column) -> dict[str, Column]:
    """Wall, user and system seconds and peak memory from the text of a GNU or POSIX time log."""

    def number(*patterns: str) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("double") for p in patterns])

    clock = F.nullif(F.btrim(F.regexp_extract(c, r"Elapsed \(wall clock\) time(?: \([^)\n]*\))?: *([^\n]+)", 1)), F.lit(""))
    return {
        "wall_seconds": F.coalesce(elapsed_seconds(clock), number(r"(?m)^real\s+([0-9.]+)$")),
        "user_seconds": number(r"User time \(seconds\): *([0-9.]+)", r"(?m)^user\s+([0-9.]+)$"),
        "sys_seconds": number(r"System time \(seconds\): *([0-9.]+)", r"(?m)^sys\s+([0-9.]+)$"),
        "max_rss_kb": number(r"Maximum resident set size.*: *([0-9]+)").cast("bigint"),
    }
