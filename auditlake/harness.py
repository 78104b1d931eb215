"""Rule self-tests: files announce the findings they expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import markers, matching, syntax
from .rulesets.loader import RuleSet


def run(files: DataFrame, rules: RuleSet, marker: str = markers.EXPECT) -> DataFrame:
    """(path, line, rule_id, outcome) for all that was expected or found."""
    expected = markers.expectations(files, marker)
    found = matching.findings(files, rules.of("regex", "secret"))
    if rules.of("ast"):
        found = found.unionByName(syntax.findings(files, rules.of("ast")))
    own = markers.numbered_lines(files.where(F.contains("content", F.lit(marker)))).where(F.contains("text", F.lit(f"{marker}:"))).select("path", "line")
    return markers.compare(expected, found, own)


def summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("matched", "missing", "unexpected")))


def recall_by_family(outcomes: DataFrame) -> DataFrame:
    """(family, expected, recall) by the first folder of the path."""
    from .functions.paths import family

    e = outcomes.where("outcome <> 'unexpected'")
    return e.groupBy(family("path").alias("family")).agg(F.count(F.lit(1)).alias("expected"), F.avg((F.col("outcome") == "matched").cast("double")).alias("recall"))
