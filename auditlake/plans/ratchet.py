"""The dashboard's ratchet: verdicts on new findings, which accept them into the baseline or silence them in their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baseline, markers

VERDICTS = ("baseline", "ignore", "next", "prev", "back")


class RefusedError(ValueError):
    """The verdicts can't be carried out."""


def checked(verdicts: DataFrame) -> DataFrame:
    """(fingerprint, verdict), one for each finding; an unknown verdict or two different ones for a finding are refused."""
    bad = verdicts.where(F.col("verdict").isNull() | ~F.col("verdict").isin(*VERDICTS)).limit(1).collect()
    if bad:
        raise RefusedError(f"there is no verdict {bad[0]['verdict']!r}")
    once = verdicts.select("fingerprint", "verdict").distinct()
    if twice := once.groupBy("fingerprint").count().where("count > 1").limit(1).collect():
        raise RefusedError(f"finding {twice[0]['fingerprint']} has more than one verdict")
    return once


def _new(rows: DataFrame, verdicts: DataFrame, verdict: str) -> DataFrame:
    return rows.where("status = 'new'").join(verdicts.where(F.col("verdict") == verdict).select("fingerprint"), "fingerprint", "left_semi")


def accept(accepted: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The baseline with the new findings that were accepted."""
    return baseline.upsert(accepted, _new(rows, verdicts, "baseline"))


def silence(files: DataFrame, rows: DataFrame, verdicts: DataFrame, live: bool = True) -> DataFrame:
    """(path, content) of the files that get a marker, with all of their markers. A snapshot, whose files may have moved on, is refused."""
    if not live:
        raise RefusedError("a snapshot can't be silenced: its files may have changed since")
    places = _new(rows, verdicts, "ignore").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("line", "rule_id"))).alias("places"))
    marked = F.aggregate("places", F.col("content"), lambda text, x: markers.insert_marker(text, "path", x["line"], x["rule_id"]))
    return files.join(places, "path").select("path", marked.alias("content"))


def remaining(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New findings that nothing was decided on."""
    done = verdicts.where(F.col("verdict").isin("baseline", "ignore")).select("fingerprint")
    return rows.where("status = 'new'").join(done, "fingerprint", "left_anti")
