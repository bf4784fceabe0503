"""Column expressions on release tags, log lines and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(found: Column) -> Column:
    return F.when(found != "", found).try_cast("double")


def app_version(tag: Column) -> Column:
    """``v1.4-beta`` is 1.4; null for anything else."""
    return _number(F.regexp_extract(tag, r"^v(\d+(?:\.\d+)?)", 1))


def model_version(tag: Column) -> Column:
    """``model-v2.5`` is 2.5, white space around it aside."""
    return _number(F.regexp_extract(F.trim(tag), r"^model-v(\d+(?:\.\d+)?)", 1))


def local_version(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def display_name(version: Column) -> Column:
    """Trailing zeros go, but only behind a decimal point."""
    text = version.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def release_notes(body: Column) -> Column:
    """``struct(summary, credits)``: the first line with text, the first credits line."""
    lines = F.filter(F.transform(F.split(body, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    credit = F.filter(lines, lambda x: F.lower(x).startswith("credits:"))
    return F.struct(
        F.get(lines, F.lit(0)).alias("summary"),
        F.trim(F.regexp_replace(F.get(credit, F.lit(0)), r"(?i)^credits:", "")).alias("credits"),
    )


def first_asset(assets: Column, suffix: str = ".pt") -> Column:
    """Download address of the first asset of that suffix that has one."""
    fits = F.filter(
        assets,
        lambda a: F.lower(a["name"]).endswith(suffix) & (F.coalesce(a["browser_download_url"], F.lit("")) != ""),
    )
    return F.get(fits, F.lit(0))["browser_download_url"]


def first_known(*choices: Column) -> Column:
    """The first choice that is not null, by priority."""
    return F.coalesce(*choices)


def hms(seconds: Column) -> Column:
    """``1h 02m 03s``, or ``2m 03s`` below an hour; negative counts as 0."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s % 60)).otherwise(
        F.format_string("%dm %02ds", m, s % 60)
    )


def time_saved(trails: Column, seconds_each: int = 20) -> Column:
    """Manual work spared: quarter hours, half to even, or seconds below a minute."""
    s = trails * seconds_each
    minutes = F.greatest((F.bround(s / 900.0) * 15).cast("bigint"), F.lit(15))
    h, m = F.floor(minutes / 60), minutes % 60

    def counted(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""))

    long = (
        F.when((h >= 1) & (m == 0), counted(h, "hour"))
        .when(h >= 1, F.concat(counted(h, "hour"), F.lit(" "), counted(m, "minute")))
        .otherwise(counted(m, "minute"))
    )
    return F.concat(F.lit("~"), F.when(s >= 60, long).otherwise(counted(s, "second")))


def progress(line: Column) -> Column:
    """``struct(done, total)`` of the first ``n/m`` in a log line."""
    part = lambda i: F.regexp_extract(line, r"(\d+)/(\d+)", i)
    return F.struct(
        F.when(part(1) != "", part(1)).try_cast("int").alias("done"),
        F.when(part(2) != "", part(2)).try_cast("int").alias("total"),
    )


def overall_percent(index: Column, share: Column, frames: Column) -> Column:
    """Percent of a run, truncated and kept within 0 to 99."""
    return F.least(F.greatest(((index + share) / frames * 100).cast("int"), F.lit(0)), F.lit(99))


def phase_share(phase: Column, done: Column, total: Column, detect: float = 0.67) -> Column:
    """Work done within a frame or batch: detection first, repair after it."""
    ratio = done / total
    return F.when(phase == "detect", ratio * detect).otherwise(detect + ratio * (1 - detect))


def elided(lines: Column, keep: int = 50, mark: str = "...") -> Column:
    """The first and last ``keep`` lines with a mark between them, if there are more."""
    both = F.concat(F.slice(lines, 1, keep), F.array(F.lit(mark)), F.slice(lines, -keep, keep))
    return F.when(F.size(lines) > 2 * keep, both).otherwise(lines)


def windows_name(build: Column) -> Column:
    return F.when(build >= 22000, "11").otherwise("10")


#: Installers by system and machine (fixed kinds); whatever is not known gets the first.
INSTALLERS = {"windows": "windows", "linux": "linux", "darwin": "mac-arm", "darwin-intel": "mac-intel"}
INTEL = ("x86_64", "amd64", "i386", "i686")


def installer(system: Column, machine: Column) -> Column:
    """The kind of installer for a system and its machine."""
    system, intel = F.lower(system), F.lower(machine).isin(*INTEL)
    return (
        F.when((system == "darwin") & F.coalesce(intel, F.lit(False)), INSTALLERS["darwin-intel"])
        .when(system == "darwin", INSTALLERS["darwin"])
        .when(system.startswith("linux"), INSTALLERS["linux"])
        .otherwise(INSTALLERS["windows"])
    )


def xp_comment(about: Column) -> Column:
    """A comment as some file explorers read it: little-endian UTF-16 that ends with a null."""
    return F.concat(F.encode(about, "UTF-16LE"), F.unhex(F.lit("0000")))


def diagnosis(attempts: Column) -> Column:
    """``reader: why`` of every failed attempt, in order."""
    return F.array_join(F.transform(attempts, lambda a: F.concat(a["reader"], F.lit(": "), a["why"])), "; ")


def stamp(*parts: Column) -> Column:
    """The description written into output files; null parts are left out."""
    return F.concat_ws(" / ", *parts)
