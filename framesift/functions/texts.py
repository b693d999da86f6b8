"""Names, time codes and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<[^>]+>", ""))


def seconds_of(stamp: Column) -> Column:
    """HH:MM:SS,mmm (or with a point) to seconds; null if it is none."""
    pattern = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$"
    hours, minutes, secs, rest = (F.nullif(F.regexp_extract(stamp, pattern, i), F.lit("")) for i in range(1, 5))
    return hours.cast("double") * 3600 + minutes.cast("double") * 60 + F.concat(secs, F.lit("."), rest).cast("double")


def number_or_stamp(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), seconds_of(value))


def safe_name(text: Column, limit: int = 120) -> Column:
    """Letters, digits, point, underscore and hyphen only, no underscore at either end, `unknown` for nothing."""
    plain = F.substring(F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), 1, limit)
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown"))


def preview(text: Column, limit: int = 160) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def whole_number_text(value: Column) -> Column:
    """`12.0` to `12`; anything that isn't a number stays."""
    return F.coalesce(value.try_cast("double").try_cast("bigint").cast("string"), F.trim(value))


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def human_bytes(size: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    found = F.concat(F.format_number(size / 1024.0**5, 1), F.lit(f" {units[5]}"))
    for i in range(4, -1, -1):
        found = F.when(size < 1024.0 ** (i + 1), F.concat(F.format_number(size / 1024.0**i, 1), F.lit(f" {units[i]}"))).otherwise(found)
    return found


def string_list(text: Column) -> Column:
    """A list of strings from a JSON array, else from quoted strings, else from bullet lines."""
    as_json = F.from_json(text, "array<string>")
    quoted = F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1))
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    cleaned = F.filter(lines, lambda line: line != "")
    return F.when(F.size(as_json) > 0, as_json).when(F.size(quoted) > 0, quoted).otherwise(cleaned)


def distinct_ignoring_case(words: Column) -> Column:
    """First occurrences, in order."""
    folded = F.transform(words, lambda w: F.lower(F.trim(w)))
    return F.filter(words, lambda w, i: F.array_position(folded, F.lower(F.trim(w))) == i + 1)


def pipe_list(values: Column, digits: int = 6) -> Column:
    return F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v.cast("double"))), "|")


def allocation_text(values: Column) -> Column:
    """`[3, 2.5]`: whole numbers without a point, others with one digit."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.when(F.abs(v - F.rint(v)) < 1e-6, F.rint(v).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", v))), ", "), F.lit("]"))


def config_label(strength: Column, coverage: Column) -> Column:
    """`ws=2` and `cov=T` on two lines."""
    shown = F.when(strength == F.rint(strength), strength.cast("bigint").cast("string")).otherwise(strength.cast("string"))
    return F.concat(F.lit("ws="), shown, F.lit("\ncov="), F.when(coverage, "T").otherwise("F"))


def relative_path(path: Column, root: str) -> Column:
    """The path below root; the file's name where it isn't below it."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substr(path, F.lit(len(top) + 1))).otherwise(F.regexp_replace(path, r"^.*/", ""))


def hub_id(path: Column) -> Column:
    """`org/name` from the first folder `models--org--name` of a path, or null."""
    made = F.concat_ws("/", *[F.nullif(F.regexp_extract(path, r"(?:^|/)models--([^/]+?)--([^/]+)", i), F.lit("")) for i in (1, 2)])
    return F.nullif(made, F.lit(""))


def run_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def parse_run_stamp(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
