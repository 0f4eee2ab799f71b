"""Walked artifacts and gaps against a plain reading of the same JSON."""
import json

from pyspark.sql import functions as F

from prudent.operators import artifacts as A


def walked(spark, artifacts):
    rows = [("r1", i, name, f"{i:02d}-{name}.json", json.dumps(body) if body is not None else None) for i, (name, body) in enumerate(artifacts)]
    df = spark.createDataFrame(rows, "run_id string, stage_index int, agent string, file_name string, body string")
    return A.nodes(df.select("run_id", "stage_index", "agent", "file_name", F.try_parse_json("body").alias("artifact")))


def plain(value, spot=""):
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        at = f"{spot}[{k}]" if isinstance(value, list) else f"{spot}.{k}" if spot else k
        yield at, "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "null" if v is None else "scalar"
        yield from plain(v, at)


def test_every_node_of_any_depth_is_a_row(spark):
    body = {"payload": {"a": [1, [2, {"b": [[[{"c": {"d": {"e": [True, None, "x"]}}}]]]}]], "empty": {}, "none": [], "s": "t"}, "n": 1.5}
    got = sorted((r.spot, r.kind) for r in walked(spark, [("data-profiler", body), ("x", None), ("y", {}), ("z", [])]).collect())
    assert got == sorted(plain(body))


def test_gaps_of_the_six_kinds(spark):
    kinds = [
        ("question-framer", {"payload": {"caveats": ["short", {"message": "said so", "severity": "HIGH"}, 7, None],
                                         "data_requirements": {"ideal_but_unavailable": "a single string", "limitations_from_gaps": ["tiny", "long enough", {"text": "no"}]}}}),
        ("data-retrieval-agent", {"payload": {"load_warnings": {"note": "one record"}}}),
        ("data-profiler", {"payload": {"data_integrity_risks": [{"description": "d", "explanation": "", "severity": "Low"}, "a string", {"other": 1}], "mandatory_caveats": None}}),
        ("pattern-discoverer", {"payload": {"generated_hypotheses": [{"id": "h1", "data_gap_to_strengthen": "more weeks"}, {"data_gap_to_strengthen": "more days"}, {"id": "h3", "data_gap_to_strengthen": "few"}]}}),
        ("findings-validator", {"payload": {"guardrail_check_results": [{"flag": "missing_data", "primary_metric": "p"}, {"flag": "ok"}], "cross_cutting_issues": [{"issue": "i"}],
                                            "findings_review": [{"finding_id": "f1", "required_caveats": ["c", {"caveat": "k", "severity": "medium"}]}]}}),
        ("communication-agent", {"payload": {"carried_caveats": ["carried"], "action_cards": [{"source_finding_id": "f1", "caveats": "on the card"}],
                                             "descriptive_summary": {"open_data_gaps": ["g", {"gap": "named", "severity": "high"}]}}}),
        ("other", {"payload": {"caveats": ["not read"]}}),
    ]
    got = sorted((r.text, r.category, r.severity, r.source, r.field) for r in A.extract_gaps(walked(spark, kinds)).collect())
    assert got == sorted([
        ("short", "caveat", "n/a", "question-framer", "caveats"), ("said so", "caveat", "high", "question-framer", "caveats"),
        ("a single string", "data-gap", "medium", "question-framer", "data_requirements.ideal_but_unavailable"),
        ("long enough", "data-gap", "medium", "question-framer", "data_requirements.limitations_from_gaps"),
        ("one record", "caveat", "n/a", "data-retrieval-agent", "load_warnings"),
        ("d", "integrity-risk", "low", "data-profiler", "data_integrity_risks"), ('{"other":1}', "integrity-risk", "medium", "data-profiler", "data_integrity_risks"),
        ("more weeks", "hypothesis-rationale", "medium", "pattern-discoverer", "generated_hypotheses[h1].data_gap_to_strengthen"),
        ("more days", "hypothesis-rationale", "medium", "pattern-discoverer", "generated_hypotheses[?].data_gap_to_strengthen"),
        ("No guardrail pairing computable for primary=p / paired=?", "guardrail-pairing", "medium", "findings-validator", "guardrail_check_results"),
        ("i", "caveat", "medium", "findings-validator", "cross_cutting_issues"), ("c", "caveat", "n/a", "findings-validator", "findings_review[f1].required_caveats"),
        ("k", "caveat", "medium", "findings-validator", "findings_review[f1].required_caveats"), ("carried", "caveat", "n/a", "communication-agent", "carried_caveats"),
        ("on the card", "caveat", "n/a", "communication-agent", "action_cards[f1].caveats"),
        ("g", "data-gap", "medium", "communication-agent", "descriptive_summary.open_data_gaps"),
        ("named", "data-gap", "high", "communication-agent", "descriptive_summary.open_data_gaps")])


def test_lineage_and_nothing(spark):
    body = {"payload": {"statistics": [{"id": "s1", "metric": "m", "value": 1.5, "sample_size": 3, "lineage": {"file": "a"}}, "no record", {"id": "s2"}]}}
    got = sorted((r.statistic_id, r.metric, r.value, r.sample_size, r.lineage, r.statistic_count) for r in A.lineage(walked(spark, [("x", body)])).collect())
    assert got == [("s1", "m", 1.5, 3, '{"file":"a"}', 2), ("s2", None, None, None, None, 2)]
    assert A.extract_gaps(walked(spark, [])).collect() == []
