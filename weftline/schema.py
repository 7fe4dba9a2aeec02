"""Record types and controlled vocabularies."""

from __future__ import annotations

SPAN = "struct<document_id:string,char_start:int,char_end:int,surface:string>"
SPANS = f"array<{SPAN}>"
TAGS = "struct<layer_A:array<string>,layer_B:array<string>,layer_C:array<string>,layer_D:array<string>>"
NODE = (
    f"session string, id string, label string, community_id string, evidence_span {SPANS}, onto_class string, "
    "claim_refs array<string>, mentions double, novelty double, origin string"
)
EDGE = (
    f"session string, id string, `from` string, `to` string, label string, glyph string, evidence_span {SPANS}, epistemic_status string, "
    f"confidence double, layer_tags {TAGS}, polarity string, claim_refs array<string>, "
    "causal_check struct<lexicon_hit:array<string>,verifier_verdict:string,demoted_from:string,reason:string>, causal_override string, "
    "validation struct<status:string,combined:double,scores:map<string,double>>, origin string"
)
COMMUNITY = "session string, id string, name string, is_gap boolean"
EDIT = "session string, edit_id string, ts string, user string, op string, target string, payload map<string,string>"
EVALUATION = (
    "map_id string, user_id string, created_at string, satisfaction int, relation_verdicts map<string,string>, "
    "operations array<struct<op:string,at:string>>, detail_level_at_start string, evidence_views int"
)
USAGE = "ts string, route string, input bigint, output bigint, calls bigint, cached boolean, session string, unknown boolean"
HISTORY = "ts string, message string, job_id string, status string, session string, route string"
REJECTION = f"ts string, session string, kind string, target_id string, text string, scores map<string,double>, combined double, evidence_span {SPANS}, reason string"
RELATION_GOLD = "from_label string, to_label string, verdict string, causal_ok boolean, session string, edge_id string, labeled_by string, ts string, note string"
GAP_GOLD = "gap_id string, session string, decision string, labeled_by string, ts string, note string"

# The vocabularies of the data model.
GLYPHS = ("arrow", "wave", "zigzag", "double", "hole", "tension", "isa", "partof", "precedes", "question")
EPISTEMIC = ("asserted", "hedged", "hypothesized", "observed", "concluded")
LAYERS = {
    "layer_A": ("is_a", "part_of", "participates_in", "has_property", "located_in", "has_role"),
    "layer_B": ("hypothesis_of", "method_of", "evidence_for", "result_of", "motivation_of", "limitation_of", "background_of", "conclusion_of"),
    "layer_C": ("causes", "correlates_with", "precedes", "co_occurs_with", "depends_on", "example_of", "precondition_of", "mechanism_of"),
    "layer_D": ("corroborates", "refutes", "refines", "extends", "questions", "agrees_with", "disagrees_with", "cites_as_source"),
}
POLARITIES = ("positive", "negative", "neutral")
CORESC = ("Hypothesis", "Motivation", "Goal", "Object", "Method", "Experiment", "Model", "Observation", "Result", "Conclusion", "Background")
AZ = ("AIM", "TEXTUAL", "OWN", "BACKGROUND", "CONTRAST", "BASIS", "OTHER")
CLAIM_ZONES = ("Result", "Conclusion", "Hypothesis", "Observation")
ONTO_CLASSES = ("MaterialEntity", "Process", "Quality", "Role", "InformationEntity")
RELATION_VERDICTS = ("correct", "incorrect", "undecidable")
GAP_STATUS = ("candidate", "confirmed", "dismissed")
EDIT_OPS = ("rename_node", "delete_node", "add_node", "relabel_edge", "retype_edge", "reverse_edge", "delete_edge", "add_edge")
LEVEL_BANDS = {"overview": (10, 20), "standard": (20, 50), "detailed": (50, 100)}
LEVEL_RATIO = {"overview": 0.35, "standard": 0.70, "detailed": 1.0}
IMPORTANCE_WEIGHTS = {"betweenness": 0.4, "frequency": 0.3, "novelty": 0.3}
VERIFIER_WEIGHTS = {"nli": 0.40, "llm": 0.35, "ontology": 0.25}
VALIDATED, UNCERTAIN = 0.75, 0.50
CORPUS_RESOLUTIONS = {"coarse": 0.4, "fine": 1.0}
ROUTES = ("basic", "vector", "map", "local", "global", "hybrid")

# Lexicons that the causal and claim rules look for.
CAUSAL_CUES = {
    "mechanism": (
        "機序", "メカニズム", "を介して", "を通じて", "経路により", "作用機構", "媒介して", "仕組みにより", "原理により",
        "mechanism by which", "mediates", "pathway through", "via the", "through which",
    ),
    "intervention": (
        "介入", "操作すると", "変化させると", "投与", "印加", "制御することで", "を加えると", "を除去すると", "阻害すると", "処理により",
        "intervening with", "when we intervene", "administering", "knockout", "ablation", "upon applying", "by removing",
    ),
    "counterfactual": (
        "なければ", "しなければ", "でなかったら", "仮に", "反事実", "生じなかった", "起こらなかった",
        "had x not", "would not have", "counterfactual", "if not for",
    ),
    "causal_verb": (
        "引き起こす", "もたらす", "誘発", "生じさせる", "招く", "起因", "によって決ま", "を決定づけ", "支配する",
        "causes", "induces", "leads to", "triggers", "results in", "gives rise to", "drives",
    ),
}
CORRELATION_ONLY = ("相関", "関連", "対応関係", "同時に", "併存", "傾向がある", "correlat", "associated with", "co-occur", "linked to")
NEGATION_CUES = (
    "ない", "なかった", "ません", "でない", "否定", "不可", "困難", "見られなかった", "認められなかった", "有意差はな", "変わらな",
    " not ", "n't", " no ", "fail", "without", "lack", "absence", "unable",
)
OPPOSITES = (
    ("増加", "減少"), ("上昇", "低下"), ("向上", "低下"), ("改善", "悪化"), ("促進", "抑制"), ("有効", "無効"), ("正の相関", "負の相関"),
    ("多い", "少ない"), ("高い", "低い"), ("速い", "遅い"), ("increase", "decrease"), ("improve", "worsen"), ("higher", "lower"),
    ("effective", "ineffective"), ("positive", "negative"),
)
# First tags of a relation by its glyph, and discourse tag by zone.
GLYPH_TAGS = {
    "arrow": ("layer_C", "causes"), "wave": ("layer_C", "correlates_with"), "precedes": ("layer_C", "precedes"), "isa": ("layer_A", "is_a"),
    "partof": ("layer_A", "part_of"), "double": ("layer_D", "corroborates"), "question": ("layer_D", "questions"), "zigzag": ("layer_D", "refutes"),
}
ZONE_TAGS = {
    "Hypothesis": "hypothesis_of", "Method": "method_of", "Experiment": "method_of", "Observation": "result_of", "Result": "result_of",
    "Motivation": "motivation_of", "Goal": "motivation_of", "Background": "background_of", "Conclusion": "conclusion_of",
    "BACKGROUND": "background_of", "AIM": "motivation_of",
}
