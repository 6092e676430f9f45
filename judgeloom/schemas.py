"""Explicit schemas of the data model; nothing is inferred, so that an article such as '8' stays a string."""

from pyspark.sql import types as T

_DDL = {
    "pair": "case_name string, article string, violation_label string, case_text string, step1_summary string, facts string, procedure string, relevant_law string, summary string",
    "case": "item_id string, case_name string, article string, violation_label string, full_case_text string, decision_date string, respondent string, full_case_text_no_verdict string, verdict_removal_method string, original_length int, verdict_free_length int, retention_percentage double, leakage_check_primary string, leakage_check_secondary string, excluded boolean, exclusion_reason string",
    "leakage": "leaks_verdict boolean, leaking_sentences array<string>, confidence string, error string",
    "search": "item_id string, case_name string, application_number string, decision_date string, respondent string, articles array<string>, conclusion string, language string, importance string, ecli string, doc_type_branch string, separate_opinion string",
    "hit": "columns struct<itemid:string,docname:string,appno:string,kpdate:string,respondent:string,article:string,conclusion:string,languageisocode:string,importance:string,ecli:string,doctypebranch:string,separateopinion:string>",
    "request": "custom_id string, model string, messages array<struct<role:string,content:string>>, backend string, temperature double, max_tokens int, max_completion_tokens int, reasoning_effort string",
    "response": "custom_id string, response string",
    "evaluation": "case_name string, article string, violation_label string, avg_rating double, is_accurate boolean, num_abstentions int, num_samples int, sample_ratings string",
    "framing": "evaluator string, framing string, case_name string, article string, is_violation boolean, avg_rating double, is_accurate boolean",
    "challenge_wide": "case_name string, article string, violation_label string, original_ratings string, challenged_ratings string, original_accurate boolean, challenged_accurate boolean, original_avg_rating double, challenged_avg_rating double, num_changed int, num_samples int",
    "challenge": "case_name string, article string, violation_label string, sample_idx int, initial_rating int, challenged_rating int, changed boolean, is_accurate_initial boolean, is_accurate_challenged boolean",
    "baseline": "case_name string, article string, violation_label string, prediction string, accurate boolean, abstained boolean, ratings array<int>, avg_rating double",
    "rq1": "case_name string, article string, violation_label string, summary_version int, prediction string, accurate boolean, aligned boolean, ratings array<int>",
    "rq2": "case_name string, article string, violation_label string, framing string, prediction string, accurate boolean, aligned_with_baseline boolean, ratings array<int>",
    "rq3": "case_name string, article string, violation_label string, original_prediction string, challenged_prediction string, original_accurate boolean, challenged_accurate boolean, prediction_changed boolean, change_rate double, original_ratings array<int>, challenged_ratings array<int>",
    "summary": "item_id string, article string, version int, summary string",
    "cell": "summary string, evaluator string, accuracy double, abstention_rate double",
    "model": "model string, backend string, model_id string, input_cost_per_mtok double, output_cost_per_mtok double",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


NAMES = tuple(_DDL)
