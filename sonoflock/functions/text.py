"""String, time and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO_SUFFIXES = (".wav", ".flac", ".mp3", ".ogg", ".m4a")
TAXON_ID = r"^([a-z]+:[a-zA-Z0-9_-]+|custom:[a-f0-9-]+)$"
NO_EVENT = "None"


def taxon_namespace(taxon_id: Column) -> Column:
    """the part before the colon of a valid id."""
    return F.when(taxon_id.rlike(TAXON_ID), F.split_part(taxon_id, F.lit(":"), F.lit(1)))


def taxon_key(taxon_id: Column) -> Column:
    return F.when(taxon_id.rlike(TAXON_ID), F.regexp_replace(taxon_id, "^[^:]*:", ""))


def valid_taxon(taxon_id: Column) -> Column:
    """P17"""
    return taxon_id.rlike(TAXON_ID)


def file_stem(name: Column) -> Column:
    """the name before its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def location(metadata_location: Column, name: Column) -> Column:
    """The location noted, or the first part of the file's stem."""
    noted = F.nullif(metadata_location, F.lit(""))
    return F.coalesce(noted, F.split_part(file_stem(name), F.lit("_"), F.lit(1)))


def species_of_path(path: Column, *roots: Column) -> Column:
    """the first component below the first root that holds the path."""
    out = F.lit(None).cast("string")
    for root in reversed(roots):
        below = path.substr(F.length(root) + 2, F.length(path))
        out = F.when(path.startswith(F.concat(root, F.lit("/"))), F.split_part(below, F.lit("/"), F.lit(1))).otherwise(out)
    return F.nullif(out, F.lit(""))


def relative_path(path: Column, root: Column) -> Column:
    """S5"""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), path.substr(F.length(root) + 2, F.length(path))).otherwise(path)


def slug(name: Column) -> Column:
    """F5"""
    return F.concat(F.lit("local:"), F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("_")), 1, 120))


def collapsed(text: Column, most: int = 2000) -> Column:
    """F6"""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def comma_list(text: Column) -> Column:
    """F12"""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def plain_number(t: Column) -> Column:
    """3.0 as 3, 3.5 as 3.5."""
    return F.when(t == F.floor(t), t.cast("long").cast("string")).otherwise(t.cast("string"))


def short_form_id(short: Column) -> Column:
    """F11"""
    return F.lower(F.regexp_replace(short, "^([^_]*)_", "$1:"))


def version(base: Column, kind: str, at: Column) -> Column:
    """F13"""
    joint = {"manual": "_manual_", "retrain": "_r"}[kind]
    return F.concat(base, F.lit(joint), F.unix_timestamp(at).cast("string"))


def family_name(species: Column) -> Column:
    """F14"""
    return F.concat(F.lit("wssed_"), F.replace(F.lower(species), F.lit(" "), F.lit("_")), F.lit("_segment"))


def scope_hash(labels: Column) -> Column:
    """12 hex digits of the md5 of sorted labels."""
    return F.substring(F.md5(F.array_join(F.sort_array(labels), ",")), 1, 12)


def model_file(metric: Column, segment: Column) -> Column:
    """F17"""
    return F.concat(F.lit("best_"), metric, F.lit("_model"), F.when(segment, "_segment").otherwise(""), F.lit(".pt"))


def contains_ci(text: Column, needle: str) -> Column:
    """F10"""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(needle.lower()))


def named_id(*parts: Column | str) -> Column:
    """F16: an id in the form of a UUID that follows from what it names; it is the same whenever a
    task runs again, as a random one wouldn't be."""
    columns = [F.lit(parts[0]), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts[1:]]]
    return F.regexp_replace(F.md5(F.concat_ws("/", *columns)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def checkpoint_path(folder: str, dataset_id: Column, family: Column, version: Column, checkpoint_id: Column, labels: bool = False) -> Column:
    """where a checkpoint lies, or the order of its labels."""
    form = "%s/%s/%s_%s_labels_%s.json" if labels else "%s/%s/%s_%s_ckpt_%s.pt"
    return F.format_string(form, F.lit(folder), dataset_id.cast("string"), family, version, checkpoint_id.cast("string"))


def is_stale(kind: Column, started: Column, created: Column, now: Column) -> Column:
    """retrain jobs after six hours, others after two."""
    since = F.coalesce(started, created)
    return F.when(kind == "retrain", since < now - F.expr("INTERVAL 6 HOURS")).otherwise(since < now - F.expr("INTERVAL 2 HOURS"))


def older_than(updated: Column, ttl_s: int, now: Column) -> Column:
    """F21"""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(updated) > ttl_s, F.lit(True))


def elapsed_s(started: Column, completed: Column) -> Column:
    """F23"""
    return F.unix_timestamp(completed) - F.unix_timestamp(started)


def expiry(now: Column) -> Column:
    """F24"""
    return now + F.expr("INTERVAL 2 DAYS")


def iso(at: Column) -> Column:
    """F22"""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def json_int(params: Column, path: str) -> Column:
    """C11: an integer of a JSON text, NULL where it isn't one."""
    return F.get_json_object(params, path).try_cast("long")


def invitation_valid(active: Column, expires: Column, uses: Column, most: Column, now: Column) -> Column:
    """P15"""
    open_ended = most.isNull() | (most == 0) | (uses < most)
    return active & (expires.isNull() | (expires >= now)) & open_ended


def band_error(low: Column, high: Column) -> Column:
    """What is wrong with a frequency band, NULL if nothing."""
    return (
        F.when(low < 0, "f_min must not be negative")
        .when(high <= 0, "f_max must be positive")
        .when(high <= F.coalesce(low, F.lit(0.0)), "f_max must exceed f_min")
    )
