"""The concept registry: data, with a loader. Any registry of the same form can take its place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SLOT = "key:string,requirement:string,classes:array<string>,functions:array<string>,headings:array<string>,path_includes:array<string>,corpora:array<string>,required_text:array<string>,recovery_queries:array<string>,recovery_corpora:array<string>,gap:string,preferred_text:array<string>,contextual:array<struct<any:array<string>,all:array<string>,text:array<string>,bonus:int>>,most:int"
SCHEMA = f"concept string, ord int, aliases array<string>, planner_triggers array<string>, preferred_queries array<string>, supersedes array<string>, slots array<struct<{SLOT}>>, exclusions array<struct<headings:array<string>,path_includes:array<string>>>"

SO, SR = "standing_orders", "speakers_rulings"
RULE, QUALIFIES, APPLIED = ["governing_rule"], ["constraint_or_qualification"], ["rule", "application"]


def _slot(key, requirement, **own):
    return {"key": key, "requirement": requirement, "most": 1, **own}


# The ten concepts, in order.
CONCEPTS = [
    {
        "concept": "closure_motion",
        "aliases": ["question be put", "question to be put", "closure", "premature closure"],
        "planner_triggers": ["closure motion", "acceptance of closure motion"],
        "preferred_queries": ["closure motion", "acceptance of closure motion"],
        "slots": [
            _slot("closure_governing_rule", "required", headings=["closure motion"], classes=RULE, functions=APPLIED, corpora=[SO]),
            _slot("closure_qualification", "optional", headings=["acceptance of closure motion", "effect of carrying closure motion"], classes=QUALIFIES, functions=["constraint", "effect"], corpora=[SO]),
        ],
    },
    {
        "concept": "point_of_order",
        "aliases": ["point of order", "points of order"],
        "planner_triggers": ["point of order", "points of order"],
        "preferred_queries": ["point of order"],
        "slots": [
            _slot(
                "point_of_order_mechanism", "optional", headings=["points of order", "point of order"], classes=["procedural_mechanism"], functions=["procedure"], preferred_text=["speaker can take action"],
                contextual=[{"any": ["personal_reflection", "allegation_of_racism", "relevancy"], "text": ["transgressing the rules of debate", "breach of the rules", "call the attention of the speaker", "draw the speaker's attention"], "bonus": 260}],
            )
        ],
    },
    {
        "concept": "personal_reflection",
        "aliases": ["personal attack", "attack on member", "right to speak", "personal reflection", "personal reflections"],
        "planner_triggers": ["personal reflections", "against members"],
        "preferred_queries": ["personal reflections", "against members", "procedure"],
        "slots": [
            _slot("personal_reflection_rule", "required", path_includes=["personal reflections"], headings=["against members"], classes=RULE, functions=APPLIED, corpora=[SR]),
            _slot("personal_reflection_procedure", "optional", path_includes=["personal reflections"], headings=["procedure"], classes=QUALIFIES, functions=["procedure", "constraint"], corpora=[SR]),
        ],
    },
    {
        "concept": "allegation_of_racism",
        "aliases": ["racist", "racism", "country of origin", "ethnicity", "nationality"],
        "planner_triggers": ["allegations of racism"],
        "preferred_queries": ["allegations of racism"],
        "supersedes": ["personal_reflection_rule"],
        "slots": [_slot("racism_rule", "required", headings=["allegations of racism"], classes=RULE, functions=APPLIED, corpora=[SR])],
    },
    {
        "concept": "relevancy",
        "aliases": ["evasive", "evasiveness", "off topic", "not relevant", "relevancy"],
        "planner_triggers": ["relevancy"],
        "preferred_queries": ["relevancy"],
        "slots": [_slot("relevancy_rule", "required", headings=["relevancy"], classes=RULE, functions=APPLIED)],
    },
    {
        "concept": "chair_control",
        "aliases": ["chair", "chairperson", "speaker control"],
        "planner_triggers": ["chairperson"],
        "preferred_queries": ["chairperson"],
        "slots": [_slot("chair_control_rule", "required", headings=["chairperson"], classes=["chair_control"], corpora=[SR])],
    },
    {
        "concept": "committee_of_whole",
        "aliases": ["committee of the whole", "committee stage"],
        "planner_triggers": ["committee of the whole", "committee stage"],
        "preferred_queries": ["committee of the whole", "chairperson"],
        "slots": [_slot("committee_of_whole_context", "required", path_includes=["committees of the whole house"], corpora=[SO, SR])],
        "exclusions": [{"path_includes": ["chairpersons of select committees"]}],
    },
    {
        "concept": "withdrawal_and_apology",
        "aliases": ["withdraw", "apologise", "apology", "withdrawal"],
        "planner_triggers": ["withdrawal"],
        "preferred_queries": ["withdrawal", "procedure"],
        "slots": [
            _slot("withdrawal_rule", "required", headings=["withdrawal"], path_includes=["unparliamentary language"], classes=QUALIFIES + RULE, functions=["procedure", "constraint", *APPLIED], corpora=[SR]),
            _slot("withdrawal_procedure", "optional", headings=["procedure"], path_includes=["unparliamentary language"], classes=QUALIFIES, functions=["procedure", "constraint"], corpora=[SR]),
        ],
    },
    {
        "concept": "ministerial_accountability",
        "aliases": ["areas of responsibility", "avoid directly answering", "abdication of responsibility", "account to the house", "accountability to the house", "evasive answer", "non-answer"],
        "planner_triggers": ["accountability to the house", "form of reply"],
        "preferred_queries": ["accountability to the House", "form of reply", "point of order"],
        "slots": [
            _slot("ministerial_accountability_rule", "required", headings=["accountability to the house"], classes=RULE, functions=APPLIED, corpora=[SR]),
            _slot("ministerial_form_of_reply", "optional", headings=["form of reply"], classes=QUALIFIES, functions=["constraint", *APPLIED], corpora=[SR]),
        ],
    },
    {
        "concept": "retrospective_discipline",
        "aliases": ["yesterday", "previous sitting", "something that happened in the house yesterday", "require a member to apologise", "require an apology", "apology for something that happened"],
        "preferred_queries": ["withdrawal", "procedure", "point of order", "previous sitting"],
        "slots": [
            _slot(
                "retrospective_timing_rule", "required", path_includes=["rules of debate", "maintenance of order"], corpora=[SO, SR],
                required_text=["previous sitting", "earlier sitting", "previous day", "earlier day", "at an earlier sitting", "at a previous sitting"],
                recovery_queries=["previous sitting", "earlier sitting", "previous day"], recovery_corpora=[SR, SO],
                gap="whether the Speaker may require withdrawal or an apology for conduct from an earlier sitting",
            )
        ],
    },
]

# Phrases of a question that bring concepts up besides their aliases, in the order of their rules.
PHRASES = [
    (["question to be put", "question be put", "premature"], ["closure_motion"]),
    (["point of order"], ["point_of_order"]),
    (["committee of the whole", "committee stage"], ["committee_of_whole", "chair_control"]),
    (["racist", "racism", "country of origin", "right to speak", "ethnicity", "nationality"], ["personal_reflection", "allegation_of_racism"]),
    (["evasive", "relevancy", "relevant", "back on track"], ["relevancy"]),
    (["accountability to the house", "account to the house", "avoid directly answering", "non-answer"], ["ministerial_accountability"]),
    (["yesterday", "previous sitting", "require an apology", "require a member to apologise"], ["retrospective_discipline", "withdrawal_and_apology"]),
]

# What a query is searched as besides itself; and rules for queries that hold all of some words.
EXPANSIONS = {
    "question to be put": ["closure motion"],
    "question be put": ["closure motion"],
    "premature": ["closure motion", "acceptance of closure motion"],
    "evasive": ["relevancy"],
    "evasiveness": ["relevancy"],
    "back on track": ["relevancy"],
    "country of origin": ["personal reflections", "against members"],
    "nationality": ["personal reflections", "against members"],
    "ethnicity": ["personal reflections", "against members"],
    "racist": ["allegations of racism"],
    "racism": ["allegations of racism"],
    "borderline racist": ["allegations of racism"],
    "right to speak": ["against members", "personal reflections"],
    "chairperson relevancy committee of the whole": ["chairperson", "relevancy", "point of order"],
    "committee of the whole chairperson": ["chairperson"],
    "chairperson relevancy": ["chairperson", "relevancy"],
    "point of order relevancy": ["point of order", "relevancy"],
    "relevancy committee of the whole": ["relevancy", "chairperson"],
}
EXPANSION_RULES = [
    (["committee of the whole", "chairperson", "relevancy"], ["chairperson", "relevancy", "point of order"]),
    (["point of order", "relevancy"], ["point of order", "relevancy"]),
    (["chairperson", "relevancy"], ["chairperson", "relevancy"]),
]

# Searches that active concepts add to the plan, in order: (any of these concepts, searches).
ADDITIONS = [
    (["closure_motion"], ["closure motion", "acceptance of closure motion"]),
    (["personal_reflection", "allegation_of_racism"], ["personal reflections", "against members"]),
    (["allegation_of_racism"], ["allegations of racism"]),
    (["committee_of_whole"], ["chairperson"]),
    (["relevancy"], ["relevancy"]),
    (["point_of_order", "closure_motion", "committee_of_whole", "ministerial_accountability", "retrospective_discipline"], ["point of order"]),
    (["ministerial_accountability"], ["accountability to the House", "form of reply"]),
    (["retrospective_discipline"], ["withdrawal", "procedure"]),
]


def checked(concepts: list[dict]) -> list[dict]:
    """An exclusion without any list would leave out everything, so it is an error."""
    for c in concepts:
        for e in c.get("exclusions", ()):
            if not e.get("headings") and not e.get("path_includes"):
                raise ValueError(f"an exclusion of {c['concept']} is empty")
    return concepts


def registry(spark: SparkSession, concepts: list[dict] | None = None) -> DataFrame:
    """One row a concept, ord from 0."""
    given = checked(CONCEPTS if concepts is None else concepts)
    lines = [(json.dumps({"ord": i, **c}),) for i, c in enumerate(given)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(lines, "j string").select(F.from_json("j", SCHEMA).alias("c")).select("c.*")
