"""Fixed schemas of the tables that operators exchange."""

INTERACTIONS = "interaction_id string, learner_id string, question_id string, skill_id string, timestamp long, correct int, dataset string"
Q_MATRIX = "question_id string, skill_id string, source string, source_version string, is_train_only string"
_SKILL = ["skill_id", "kc_id", "concept_id", "skill", "concept"]
#: Alternative names of the columns of each kind of table, first choice first (fixed values).
CONTEXTS = {
    "prerequisite_scores": {"src": ["src", "source", "from", "pre", "skill_i"], "dst": ["dst", "target", "to", "post", "skill_j"], "score": ["score", "weight", "confidence", "pre_score"]},
    "co_occurrence": {"src": ["src", "source", "skill_i", "kc_i"], "dst": ["dst", "target", "skill_j", "kc_j"], "weight": ["weight", "pmi", "score"], "support_split": ["support_split", "split"]},
    "predictions": {"y_true": ["y_true", "label", "correct", "y"], "y_pred": ["y_pred", "prob", "prediction", "p_correct"], "skill_id": _SKILL},
    "interactions": {"learner_id": ["user_id", "student_id", "learner_id", "uid"], "question_id": ["question_id", "item_id", "problem_id", "qid"], "skill_id": _SKILL},
    "degree_edges": {"src": ["src_skill_id", "src", "source"], "dst": ["dst_skill_id", "dst", "target"]},
}
