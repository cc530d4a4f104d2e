"""Strict parsers of tool output and commands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names and their powers of 1024.
UNITS = {"B": 0, "KiB": 1, "MiB": 2, "GiB": 3, "TiB": 4, "PiB": 5, "EiB": 6}
TRIM = r"^.*: ([0-9]+)(?:\.([0-9]{1,6}))? (B|KiB|MiB|GiB|TiB|PiB|EiB)\b.*$"


def trim_bytes(line: Column) -> Column:
    """Bytes told by ``path: 1.5 MiB (...) trimmed``, floor of the fraction; null if not of that form."""
    unit = F.regexp_extract(line, TRIM, 3)
    scale = F.lit(None).cast("decimal(38,0)")
    for name, power in UNITS.items():
        scale = F.when(unit == name, F.lit(str(1024**power)).cast("decimal(20,0)")).otherwise(scale)
    whole = F.regexp_extract(line, TRIM, 1).try_cast("decimal(18,0)")
    part = F.rpad(F.regexp_extract(line, TRIM, 2), 6, "0").try_cast("decimal(6,0)")
    more = F.floor(F.coalesce(part, F.lit(0)) * scale / F.lit(1_000_000))
    return F.when(line.rlike(TRIM), (whole * scale + more).try_cast("long"))


def qgroup_fields(line: Column) -> Column:
    """struct(level, subvolume, referenced, exclusive, max_referenced, max_exclusive) of one table line; null if malformed. ``none`` limits are null."""
    f = F.split(F.trim(line), r"\s+")
    good = (F.size(f) == 5) & f[0].rlike(r"^[0-9]+/[0-9]+$") & f[1].rlike("^[0-9]+$") & f[2].rlike("^[0-9]+$") & f[3].rlike("^([0-9]+|none)$") & f[4].rlike("^([0-9]+|none)$")
    number = lambda c: c.try_cast("long")
    fields = F.struct(
        number(F.split_part(f[0], F.lit("/"), F.lit(1))).alias("level"), number(F.split_part(f[0], F.lit("/"), F.lit(2))).alias("subvolume"),
        number(f[1]).alias("referenced"), number(f[2]).alias("exclusive"), number(f[3]).alias("max_referenced"), number(f[4]).alias("max_exclusive"),
    )
    return F.when(good, fields)


def available_bytes(output: Column) -> Column:
    """The first number after the header line; null if there is none."""
    lines = F.slice(F.split(output, "\n"), F.lit(2), F.greatest(F.size(F.split(output, "\n")) - 1, F.lit(0)))
    found = F.filter(F.transform(lines, lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def uuid_bytes(value: Column) -> Column:
    """16 bytes of a 36-character id with dashes in their places; else null."""
    form = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"
    return F.when(value.rlike(form), F.unhex(F.replace(value, F.lit("-"), F.lit(""))))


def key_values(output: Column) -> Column:
    """map of KEY=VALUE lines; null on a malformed or repeated key."""
    lines = F.filter(F.split(output, "\n"), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.expr("null") if x is None else F.substr(x, F.instr(x, "=") + 1).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    good = F.forall(lines, lambda x: F.instr(x, "=") > 1) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(good, F.map_from_entries(pairs))


def command(request: Column) -> Column:
    """struct(variant, argument, error) of a one-line request; fields are parted by single spaces."""
    f = F.split(request, " ", -1)
    n = F.size(f)
    at = lambda i: F.get(f, F.lit(i))
    is_hex = lambda c, least: (F.length(c) % 2 == 0) & (F.length(c) >= least) & c.rlike(r"^[0-9A-Fa-f]*\z")
    job_id = at(2).rlike(r"^[0-9A-Fa-f]{32}\z")
    is_job = at(0) == "job"
    verb = at(1)
    malformed = (request == "") | request.rlike("[\n\r\t]") | F.exists(f, lambda x: x == "")
    simple = is_job & (n == 3) & verb.isin("get", "start", "succeed", "retry")
    fail = is_job & (n == 4) & (verb == "fail")
    enqueue = is_job & (n == 4) & (verb == "enqueue")
    pressure = (at(0) == "maintenance") & (n == 3) & (verb == "cache-pressure")
    variant = (
        F.when(malformed, F.lit(None)).when((n == 1) & (at(0) == "status"), "status").when((n == 2) & (at(0) == "maintenance") & (verb == "gc"), "gc")
        .when(pressure & at(2).rlike(r"^[0-9]+\z") & at(2).try_cast("decimal(20,0)").between(0, F.lit("18446744073709551615").cast("decimal(20,0)")), "cache-pressure")
        .when(simple & job_id, verb).when(fail & job_id & is_hex(at(3), 2), "fail").when(enqueue & is_hex(at(2), 2) & is_hex(at(3), 0), "enqueue")
    )
    known = simple | fail | enqueue | pressure
    error = F.when(variant.isNotNull(), F.lit(None)).when(malformed | known, "invalid").otherwise("unsupported")
    return F.struct(variant.alias("variant"), F.when(variant.isNotNull(), at(2)).alias("argument"), error.alias("error"))
