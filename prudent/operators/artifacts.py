"""Stage artifacts as rows: every node of their JSON, statistics with their lineage, and gaps of knowledge.

An artifact is a VARIANT.  ``nodes`` walks all artifacts at once, one round a level of nesting: each round opens the
containers of the level before, so the number of Spark jobs is the depth of the deepest artifact, not the number of
artifacts.  Statistics and gaps are then filters and a join with a short table of rules on the shape of a node's path.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudent.session import cut_lineage

KEYS = ["run_id", "stage_index", "agent", "file_name"]
#: names under which the elements of a list of records are known
OWNER_FIELDS = ["id", "finding_id", "source_finding_id"]


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _kind(value: Column) -> Column:
    """object, array, string, null or scalar."""
    s = F.schema_of_variant(value)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
            .when(s == "VOID", "null").otherwise("scalar"))


def nodes(artifacts: DataFrame, column: str = "artifact") -> DataFrame:
    """Every node below the root of every artifact: its keys, ``spot`` (path with places), ``shape`` (path with ``[]`` for any place), ``kind``,
    ``value``, and ``owner``, the names that the nearest enclosing element of a list of records has.

    A null artifact has no node; an empty object or array is a node without others below it.
    """
    spark = artifacts.sparkSession
    no_owner = F.struct(*[F.lit(None).cast("string").alias(f) for f in OWNER_FIELDS])
    level = artifacts.where(F.col(column).isNotNull()).select(*KEYS, F.lit("").alias("spot"), F.lit("").alias("shape"), _kind(F.col(column)).alias("kind"),
                                                              F.col(column).alias("value"), no_owner.alias("owner"), no_owner.alias("own"))
    found: list[DataFrame] = []
    while True:
        open_ = level.where(F.col("kind").isin("object", "array"))
        down = spark.sql("SELECT n.*, e.pos, e.key, e.value AS child FROM {n} AS n, LATERAL variant_explode(n.value) AS e", n=open_)
        element = F.col("key").isNull()

        def below(parent: str, place: Column) -> Column:
            return F.when(element, F.concat(parent, F.lit("["), place, F.lit("]"))).when(F.col(parent) == "", F.col("key")) \
                .otherwise(F.concat_ws(".", parent, "key"))

        record = element & (_kind(F.col("child")) == "object")
        own = F.when(record, F.struct(*[_text(F.col("child"), f"$.{f}").alias(f) for f in OWNER_FIELDS])).otherwise(F.col("own"))
        level = cut_lineage(down.select(*KEYS, below("spot", F.col("pos").cast("string")).alias("spot"), below("shape", F.lit("")).alias("shape"),
                                        _kind(F.col("child")).alias("kind"), F.col("child").alias("value"), F.col("own").alias("owner"), own.alias("own")))
        found.append(level.drop("own"))
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def lineage(walked: DataFrame) -> DataFrame:
    """One row per statistic of every artifact, with the stage and agent that made it, and the number of the run's statistics."""
    s = walked.where((F.col("shape") == "payload.statistics[]") & (F.col("kind") == "object"))
    out = s.select("run_id", "stage_index", "agent", "spot", *[_text(F.col("value"), f"$.{c}").alias(c if c != "id" else "statistic_id") for c in ("id", "metric")],
                   F.try_variant_get("value", "$.value", "double").alias("value"), _text(F.col("value"), "$.unit").alias("unit"),
                   _text(F.col("value"), "$.computation").alias("computation"), F.try_variant_get("value", "$.sample_size", "bigint").alias("sample_size"),
                   _text(F.col("value"), "$.lineage").alias("lineage"))
    per = out.groupBy(F.col("run_id").alias("__run")).agg(F.count("*").alias("statistic_count"))
    return out.join(per, F.col("run_id").eqNullSafe(F.col("__run"))).drop("__run")


# Where artifacts of the six kinds of stage tell what they lacked.  Agent, path below the payload, may the list
# be a single value, name under which records say it (tried in order), category, default severity, shortest text, label.
_CAVEAT = ("text", "description", "caveat", "message", "note")
RULES = [
    ("question-framer", "caveats", True, _CAVEAT, "caveat", "n/a", 0, "caveats"),
    ("question-framer", "data_requirements.ideal_but_unavailable", True, (), "data-gap", "medium", 6, "data_requirements.ideal_but_unavailable"),
    ("question-framer", "data_requirements.limitations_from_gaps", True, (), "data-gap", "medium", 6, "data_requirements.limitations_from_gaps"),
    ("data-retrieval-agent", "load_warnings", True, _CAVEAT, "caveat", "n/a", 0, "load_warnings"),
    ("data-profiler", "mandatory_caveats", True, _CAVEAT, "caveat", "n/a", 0, "mandatory_caveats"),
    ("data-profiler", "quality_issues", True, _CAVEAT, "caveat", "n/a", 0, "quality_issues"),
    ("data-profiler", "data_integrity_risks", False, ("explanation", "description", "text"), "integrity-risk", "medium", 0, "data_integrity_risks"),
    ("pattern-discoverer", "generated_hypotheses[].data_gap_to_strengthen", None, (), "hypothesis-rationale", "medium", 6, "generated_hypotheses[{id}].data_gap_to_strengthen"),
    ("pattern-discoverer", "caveats", True, _CAVEAT, "caveat", "n/a", 0, "caveats"),
    ("findings-validator", "guardrail_check_results", False, ("guardrail",), "guardrail-pairing", "medium", 0, "guardrail_check_results"),
    ("findings-validator", "cross_cutting_issues", False, ("issue", "description"), "caveat", "medium", 0, "cross_cutting_issues"),
    ("findings-validator", "findings_review[].required_caveats", True, _CAVEAT, "caveat", "n/a", 0, "findings_review[{finding_id}].required_caveats"),
    ("communication-agent", "carried_caveats", True, _CAVEAT, "caveat", "n/a", 0, "carried_caveats"),
    ("communication-agent", "action_cards[].caveats", True, _CAVEAT, "caveat", "n/a", 0, "action_cards[{source_finding_id}].caveats"),
    ("communication-agent", "descriptive_summary.open_data_gaps", False, ("text", "description", "gap"), "data-gap", "medium", 0, "descriptive_summary.open_data_gaps"),
]
#: rules whose items may be plain strings although the list itself may not be a single value
_STRINGS_TOO = {"descriptive_summary.open_data_gaps"}


def _rule_table(spark) -> DataFrame:
    rows = []
    for n, (agent, path, single, fields, category, severity, least, label) in enumerate(RULES):
        shapes = [f"payload.{path}"] if single is None else [f"payload.{path}[]"] + [f"payload.{path}"] * bool(single)
        strings = single is not False or path in _STRINGS_TOO
        rows += [(n, agent, s, strings, bool(fields), list(fields), category, severity, least, label) for s in shapes]
    return spark.createDataFrame(rows, "rule int, r_agent string, r_shape string, strings boolean, records boolean, fields array<string>, category string, "
                                       "default_severity string, least int, label string")


def extract_gaps(walked: DataFrame) -> DataFrame:
    """One row per gap that an artifact of any of the six kinds tells: ``run_id, text, category, severity, source, field, spot``.

    A string is its own text; a record gives the first of its fields that says something, else itself as JSON, and its severity in lower
    case.  Only a single value where a list may be one counts as a list of one.  Strings of five characters or
    fewer are dropped where the rule says so.  A guardrail result is a gap when it is flagged ``missing_data``.
    """
    rules = F.broadcast(_rule_table(walked.sparkSession))  # fixed, some twenty rows
    hit = walked.join(rules, (F.col("agent") == F.col("r_agent")) & (F.col("shape") == F.col("r_shape")))
    record, string = F.col("records") & (F.col("kind") == "object"), F.col("strings") & (F.col("kind") == "string")
    hit = hit.where(record | string)
    names = sorted({f for r in RULES for f in r[3]} - {"guardrail"})
    said = F.create_map(*[x for n in names for x in (F.lit(n), F.nullif(_text(F.col("value"), f"$.{n}"), F.lit("")))])
    first = F.element_at(F.filter(F.transform("fields", lambda f: said[f]), lambda t: t.isNotNull()), 1)
    first = F.when(F.exists("fields", lambda f: said[f].isNotNull()), first)
    guardrail = F.array_contains("fields", "guardrail")
    pairing = F.concat(F.lit("No guardrail pairing computable for primary="), F.coalesce(_text(F.col("value"), "$.primary_metric"), F.lit("?")),
                       F.lit(" / paired="), F.coalesce(_text(F.col("value"), "$.paired_metric"), F.lit("?")))
    text = F.when(string, _text(F.col("value"))).when(guardrail, pairing).otherwise(F.coalesce(first, F.to_json("value")))
    severity = F.when(string | guardrail, F.col("default_severity")).otherwise(F.lower(F.coalesce(_text(F.col("value"), "$.severity"), F.col("default_severity"))))
    label = F.col("label")
    for f in OWNER_FIELDS:
        label = F.replace(label, F.lit("{" + f + "}"), F.coalesce(F.col(f"owner.{f}"), F.lit("?")))
    keep = F.when(guardrail, _text(F.col("value"), "$.flag").eqNullSafe(F.lit("missing_data"))).otherwise(F.lit(True))
    return (hit.where(keep).select("run_id", text.alias("text"), "category", severity.alias("severity"), F.col("agent").alias("source"), label.alias("field"), "spot", "least")
            .where(F.char_length("text") >= F.col("least")).drop("least"))


