"""Times, names and log lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.geometry import col


def iso_ms(epoch, ms) -> Column:
    """2026-09-02T17:37:57.673Z from whole seconds and milliseconds, whatever the session's time zone."""
    at = F.timestamp_millis(col(epoch) * 1000 + col(ms))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def dms(degrees) -> Column:
    """Degrees, minutes and seconds of an absolute angle."""
    a = F.abs(col(degrees))
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    return F.struct(d.cast("long").alias("d"), m.cast("long").alias("m"), (((a - d) * 60 - m) * 60).alias("s"))


def exif_date(text) -> Column:
    """2026:09:02 17:37:57 with its date part written with hyphens."""
    return F.regexp_replace(col(text), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")


def frame_no(name) -> Column:
    """The digits of the last path part, as a number."""
    last = F.element_at(F.split(F.replace(col(name), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.nullif(F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), r"\D", ""), F.lit("")).cast("long")


def camera_of(name) -> Column:
    """The first part of a path, null for a bare name."""
    parts = F.split(F.replace(col(name), F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) > 1, parts[0])


def safe_name(name, camera: str) -> Column:
    """The path with forward slashes where it lies under the camera's folder, else null."""
    path = F.replace(col(name), F.lit("\\"), F.lit("/"))
    return F.when(path.startswith(f"{camera}/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.rlike(r"//|^/|:"), path)


def parse_stage(line) -> Column:
    """Stage, number of stages and progress (0 to 1) that a log line tells of; null where it doesn't."""
    number = lambda pattern, k: F.nullif(F.regexp_extract(col(line), pattern, k), F.lit("")).cast("double")
    return F.struct(
        number(r"\[STAGE (\d+)/(\d+)\]", 1).cast("int").alias("stage"),
        number(r"\[STAGE (\d+)/(\d+)\]", 2).cast("int").alias("of"),
        (number(r"(\d+(?:\.\d+)?)\s*%", 1) / 100).alias("progress"),
    )
