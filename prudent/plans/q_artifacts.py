"""Queries of artifacts of six kinds of stage: statistics with lineage, gaps.

The artifacts are made from the findings, written by Spark as JSON files, one per run and stage, read back and walked;
the oracles derive the rows from the same findings without any JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.operators import artifacts as A
from prudent.plans.q_findings import FINDINGS_SQL, findings
from prudent.plans.registry import Tables, query
from prudent.sources import io as IO
from prudent.streaming.stream import staging


def _artifacts(spark, sf):
    f = findings(Tables(spark, sf)).withColumn("run", F.regexp_replace("run_id", " ", "_"))
    implausible, weak = F.col("plausibility") == "implausible", F.col("lenses") < 3
    caveat = F.transform("caveats", lambda c: F.struct(c["text"].alias("text"), F.initcap(c["severity"]).alias("severity")))

    def listed(cond, item):
        return F.sort_array(F.collect_list(F.when(cond, item)))

    every = F.lit(True)
    stat = F.struct(F.concat("finding_id", F.lit("#diff")).alias("id"), F.lit("mean_order_value_change").alias("metric"), F.round("diff", 4).alias("value"),
                    F.lit("currency").alias("unit"), F.lit("m1 - m0").alias("computation"), (F.col("n1") + F.col("n0")).alias("sample_size"),
                    F.struct(F.lit("orders").alias("dataset"), F.col("entity").alias("slice")).alias("lineage"))
    g = f.groupBy("run").agg(
        listed(implausible, F.concat(F.lit("history of "), "entity")).alias("ideal"), listed(weak, F.substring("entity", 1, 5)).alias("short"),
        listed(weak, F.concat("entity", F.lit(": few lenses"))).alias("notes"),
        listed(every, F.struct(F.concat(F.lit("rows of "), "entity").alias("description"), F.when(implausible, "HIGH").otherwise("low").alias("severity"))).alias("issues"),
        listed(implausible, F.struct(F.concat("entity", F.lit(" left its range")).alias("explanation"), F.lit("High").alias("severity"))).alias("risks"),
        listed(every, F.struct(F.col("finding_id").alias("id"), F.when(weak, F.concat(F.lit("more periods of "), "entity")).otherwise(F.lit("none")).alias("data_gap_to_strengthen"))).alias("hypotheses"),
        listed(every, F.struct(F.when(F.col("guardrail") == "no_concern", "ok").otherwise("missing_data").alias("flag"), F.col("entity").alias("primary_metric"))).alias("guardrails"),
        listed(implausible, F.struct(F.concat(F.lit("check "), "entity").alias("description"))).alias("issues_across"),
        listed(every, F.struct("finding_id", caveat.alias("required_caveats"))).alias("reviews"),
        listed(F.size("caveats") > 0, F.struct(F.col("finding_id").alias("source_finding_id"), F.col("caveats")[0]["text"].alias("caveats"))).alias("cards"),
        listed(every, stat).alias("statistics"), F.sum("n1").alias("n"))
    bodies = {
        "00-question-framer": F.struct(F.lit("one question").alias("caveats"), F.struct(F.col("ideal").alias("ideal_but_unavailable"), F.col("short").alias("limitations_from_gaps")).alias("data_requirements")),
        "01-data-retrieval-agent": F.struct(F.array(F.concat(F.col("n").cast("string"), F.lit(" rows read"))).alias("load_warnings")),
        "02-data-profiler": F.struct(F.col("notes").alias("mandatory_caveats"), F.col("issues").alias("quality_issues"), F.col("risks").alias("data_integrity_risks")),
        "03-pattern-discoverer": F.struct(F.col("hypotheses").alias("generated_hypotheses"), F.struct(F.lit("").alias("text"), F.lit("a pattern may be chance").alias("note")).alias("caveats")),
        "04-findings-validator": F.struct(F.col("guardrails").alias("guardrail_check_results"), F.col("issues_across").alias("cross_cutting_issues"),
                                          F.col("reviews").alias("findings_review"), F.col("statistics").alias("statistics")),
        "05-communication-agent": F.struct(F.array().cast("array<string>").alias("carried_caveats"), F.col("cards").alias("action_cards"),
                                           F.struct(F.col("ideal").alias("open_data_gaps")).alias("descriptive_summary")),
    }
    rows = F.array(*[F.struct(F.lit(name + ".json").alias("artifact"), F.to_json(F.struct(body.alias("payload"))).alias("body")) for name, body in bodies.items()])
    files = g.select(F.col("run").alias("run_id"), F.explode(rows).alias("a")).select("run_id", "a.artifact", "a.body")
    root = IO.write_stage_artifacts(files, staging(spark, "six-kinds"))
    return A.nodes(IO.read_artifacts(spark, root, max_stage=99))


_F = f"""WITH {FINDINGS_SQL}, f AS (SELECT *, replace(run_id, ' ', '_') AS run, plausibility = 'implausible' AS odd, lenses < 3 AS weak,
  list_filter([CASE WHEN rigor = 'partial' THEN {{'t': 'trivial effect behind a significant p', 's': 'medium'}} END,
               CASE WHEN guardrail = 'trade_off_present' THEN {{'t': 'completion share moved against order value', 's': 'high'}} END,
               CASE WHEN plausibility = 'implausible' THEN {{'t': 'change outside the historical range', 's': 'high'}} END,
               CASE WHEN lenses < 3 THEN {{'t': 'fewer than three lenses agree', 's': 'medium'}} END], lambda x: x IS NOT NULL) AS cav FROM findings)"""


@query("v09_lineage_from_artifacts", _F + """
SELECT run AS run_id, 4 AS stage_index, 'findings-validator' AS agent, finding_id || '#diff' AS statistic_id, 'mean_order_value_change' AS metric, round(diff, 4) AS value,
       'currency' AS unit, 'm1 - m0' AS computation, n1 + n0 AS sample_size, '{"dataset":"orders","slice":"' || entity || '"}' AS lineage,
       count(*) OVER (PARTITION BY run) AS statistic_count FROM f""")
def lineage(spark, sf):
    """One row per statistic of the artifacts, with what it was computed from."""
    return A.lineage(_artifacts(spark, sf)).drop("spot")


@query("v14_gaps_from_artifacts", _F + """
SELECT run AS run_id, 'one question' AS text, 'caveat' AS category, 'n/a' AS severity, 'question-framer' AS source, 'caveats' AS field FROM f GROUP BY run
UNION ALL SELECT run, 'history of ' || entity, 'data-gap', 'medium', 'question-framer', 'data_requirements.ideal_but_unavailable' FROM f WHERE odd
UNION ALL SELECT run, sum(n1) || ' rows read', 'caveat', 'n/a', 'data-retrieval-agent', 'load_warnings' FROM f GROUP BY run
UNION ALL SELECT run, entity || ': few lenses', 'caveat', 'n/a', 'data-profiler', 'mandatory_caveats' FROM f WHERE weak
UNION ALL SELECT run, 'rows of ' || entity, 'caveat', CASE WHEN odd THEN 'high' ELSE 'low' END, 'data-profiler', 'quality_issues' FROM f
UNION ALL SELECT run, entity || ' left its range', 'integrity-risk', 'high', 'data-profiler', 'data_integrity_risks' FROM f WHERE odd
UNION ALL SELECT run, 'more periods of ' || entity, 'hypothesis-rationale', 'medium', 'pattern-discoverer', 'generated_hypotheses[' || finding_id || '].data_gap_to_strengthen' FROM f WHERE weak
UNION ALL SELECT run, 'a pattern may be chance', 'caveat', 'n/a', 'pattern-discoverer', 'caveats' FROM f GROUP BY run
UNION ALL SELECT run, 'No guardrail pairing computable for primary=' || entity || ' / paired=?', 'guardrail-pairing', 'medium', 'findings-validator', 'guardrail_check_results'
          FROM f WHERE guardrail <> 'no_concern'
UNION ALL SELECT run, 'check ' || entity, 'caveat', 'medium', 'findings-validator', 'cross_cutting_issues' FROM f WHERE odd
UNION ALL SELECT run, c.t, 'caveat', c.s, 'findings-validator', 'findings_review[' || finding_id || '].required_caveats' FROM (SELECT run, finding_id, unnest(cav) AS c FROM f)
UNION ALL SELECT run, cav[1].t, 'caveat', 'n/a', 'communication-agent', 'action_cards[' || finding_id || '].caveats' FROM f WHERE len(cav) > 0
UNION ALL SELECT run, 'history of ' || entity, 'data-gap', 'medium', 'communication-agent', 'descriptive_summary.open_data_gaps' FROM f WHERE odd""")
def gaps(spark, sf):
    """What the six kinds of artifact say they lacked; strings of five characters or fewer are dropped from the framer's limitations."""
    return A.extract_gaps(_artifacts(spark, sf)).drop("spot")
