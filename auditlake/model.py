"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SEVERITIES = ("info", "warning", "error")
RANK = {s: k for k, s in enumerate(SEVERITIES)}
STATUSES = ("new", "baselined", "suppressed")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _L = T.StringType(), T.LongType()
FILES = _struct(("path", _S), ("content", _S))
FINDING = _struct(
    ("rule_id", _S), ("severity", _S), ("message", _S), ("path", _S), ("line", _L), ("column", _L), ("column_utf16", _L), ("matched", _S), ("fingerprint", _S)
)
FINDING_COLUMNS = FINDING.names
IMPORTS = _struct(("path", _S), ("language", _S), ("position", _L), ("raw", _S), ("line", _L), ("column", _L), ("column_utf16", _L))
DECLARATIONS = _struct(("path", _S), ("name", _S), ("kind", _S), ("line", _L))
COVERAGE = _struct(("path", _S), ("lines_total", _L), ("lines_covered", _L))
BASELINE = _struct(("fingerprint", _S), ("rule_id", _S), ("path", _S))
#: The canonical order of findings.
ORDER = ("path", "line", "column", "rule_id")
