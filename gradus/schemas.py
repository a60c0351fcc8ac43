"""Explicit schemas of the logical tables. Sources never infer a schema."""

from __future__ import annotations




SMALL_QUESTIONS = "id string, domain string, question string, answer bigint"
QUESTIONS = (
    "id string, domain string, subtype string, source string, source_config string, official_split string, "
    "partition string, question string, question_hash string, "
    "metadata struct<level:string,type:string,automatic_answer_extraction:boolean,task_id:string,transfer_only:boolean>, target string"
)
GRADING_KEYS = (
    "id string, domain string, expected string, reference_solution string, "
    "tests struct<public:array<string>,hidden:array<string>,challenge:array<string>,setup:string,test:string,entry_point:string>"
)
GENERATIONS = "id string, response string, code string, tokens bigint, truncated boolean"
MATH_GRADES = "id string, domain string, status string, correct boolean, format_ok boolean, extraction string, extracted_answer string"
CODE_GRADES = "id string, status string, tests_passed bigint, tests_total bigint, error string"
RECHECK_DETAILS = "id string, domain string, truncated boolean, expected string, candidate string, last_line string, category string"
EVAL_RECORDS = (
    "id string, domain string, strategy string, stage int, correct boolean, status string, format_ok boolean, "
    "tokens bigint, truncated boolean, response string"
)
PREDICTIONS = (
    "id string, seed string, ratio string, domain string, subtype string, question string, expected string, prediction string, "
    "status string, strict_correct string, format_ok string, end_to_end string, conclusion_correct string, tokens string, "
    "truncated string, response string"
)
SUMMARY = (
    "total bigint, correct bigint, micro_accuracy double, average_domain_accuracy double, "
    "domains map<string,struct<total:bigint,correct:bigint,accuracy:double,truncated:bigint,statuses:map<string,bigint>>>"
)
STAGE_PLAN = (
    "strategy string, stage_index int, stage_name string, current_domain string, current_groups int, replay_groups int, "
    "replay_allocation map<string,int>, examples array<struct<id:string,domain:string,source_type:string>>"
)
REPLAY_MEMORY = "domain string, pos int, id string"
REWARD_EVENTS = (
    "step_before_update int, ids array<string>, domains array<string>, source_types array<string>, completions int, "
    "correct int, rewards array<double>, statuses map<string,bigint>"
)
SANDBOX_RESULTS = "id string, case_hash string, status string, tests_passed bigint, tests_total bigint, error string"

#: Order in which domains are learned; also the tie order of allocations.
CURRICULUM = ("maths_appliques", "algebre_avancee", "maths_competition", "programmation")
SMALL_DOMAINS = ("maths", "algebre", "code")
STRATEGIES = ("no_replay", "fixed_replay", "adaptive_replay")
