"""Log lines to records, from the published grammars of syslog and of web servers' access logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

FORMATS = ("rfc3164", "rfc5424", "access")
_FIELDS = {
    "rfc3164": (r"^<([0-9]{1,3})>([A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}) ([^ ]+) ([^:\[ ]+)(?:\[([^\]]*)\])?: ?(.*)$", ("priority", "timestamp", "host", "app", "pid", "message")),
    "rfc5424": (r"^<([0-9]{1,3})>[1-9][0-9]{0,2} ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?$", ("priority", "timestamp", "host", "app", "pid", "msgid", "data", "message")),
    "access": (r'^([^ ]+) ([^ ]+) ([^ ]+) \[([^\]]+)\] "([A-Z]+) ([^" ]+)(?: ([^"]*))?" ([0-9]{3}) ([0-9]+|-)(?: "([^"]*)" "([^"]*)")?$', ("host", "ident", "user", "timestamp", "method", "path", "protocol", "status", "bytes", "referer", "agent")),
}


def parse_line(format: str, line: Column | str) -> Column:
    """A struct of strings; null where the line isn't of the format, fields that are absent or ``-`` are null."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}: expected one of {', '.join(FORMATS)}")
    line = column(line)
    pattern, names = _FIELDS[format]
    parts = [F.regexp_extract(line, pattern, i + 1) for i in range(len(names))]
    fields = [F.when(~p.isin("", "-"), p).alias(n) for p, n in zip(parts, names)]
    if names[0] == "priority":
        code = parts[0].cast("int")
        fields += [F.floor(code / 8).cast("long").alias("facility"), F.pmod(code, F.lit(8)).cast("long").alias("severity")]
    return F.when(line.rlike(pattern), F.struct(*fields))
