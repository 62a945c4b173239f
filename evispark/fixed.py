"""Word lists, patterns, rule tables and formats.

Everything in this module is a *fixed value* that has to be exactly what it
is for results to be right: clinical lexicons, detection patterns, rule tables
and label texts of the guideline domain.  Operators take them as parameters;
these are only the defaults.
"""

from __future__ import annotations

# Identifier of the public clinical guideline, used in chunk ids
# and citations, and the titles given to a document without one.
GUIDELINE = "NG12"
TITLE_DEFAULT = "NG12 Suspected Cancer Guidelines"
TITLE_RECOGNISED = "NG12 Suspected Cancer: Recognition and Referral"
TITLE_PATTERN = r"Suspected cancer.*recognition.*referral"
TITLE_SKIP_PREFIXES = ["Page", "ISBN", "Copyright", "www.", "©"]

# Clinical lexicons (lower case, matched as substrings).
CANCER_TYPES = [
    "lung cancer", "breast cancer", "colorectal cancer", "prostate cancer",
    "skin cancer", "melanoma", "pancreatic cancer", "ovarian cancer",
    "brain tumour", "brain tumor", "leukaemia", "leukemia", "lymphoma",
    "bladder cancer", "kidney cancer", "liver cancer", "oesophageal cancer",
    "esophageal cancer", "stomach cancer", "gastric cancer", "thyroid cancer",
    "head and neck cancer", "cervical cancer", "endometrial cancer",
    "testicular cancer", "bone cancer", "sarcoma", "myeloma", "mesothelioma",
    "laryngeal cancer", "upper gi cancer", "lower gi cancer",
]
SYMPTOMS = [
    "haemoptysis", "hemoptysis", "cough", "weight loss", "fatigue",
    "breathlessness", "shortness of breath", "chest pain", "hoarseness",
    "dysphagia", "difficulty swallowing", "abdominal pain", "bloating",
    "rectal bleeding", "blood in stool", "blood in urine", "haematuria",
    "breast lump", "nipple discharge", "skin lesion", "mole", "lump",
    "headache", "seizure", "night sweats", "fever", "jaundice",
    "lymphadenopathy", "swollen lymph nodes", "bone pain", "back pain",
    "unexplained bleeding", "persistent", "unexplained",
]
INVESTIGATIONS = [
    "chest x-ray", "chest x ray", "cxr", "ct scan", "ct", "mri",
    "ultrasound", "mammogram", "mammography", "colonoscopy", "endoscopy",
    "biopsy", "blood test", "psa test", "psa", "fbc", "full blood count",
    "lfts", "liver function", "ca125", "ca 125", "cea", "tumour markers",
    "tumor markers", "pet scan", "bone scan", "dermoscopy", "cystoscopy",
    "bronchoscopy", "gastroscopy", "sigmoidoscopy", "urine test",
    "faecal immunochemical test", "fit test",
]
RISK_FACTORS = [
    "smoking", "smoker", "tobacco", "family history", "previous cancer",
    "obesity", "overweight", "alcohol", "exposure", "radiation",
    "genetic", "hereditary", "hpv", "hepatitis", "ulcerative colitis",
    "crohn", "barrett", "h pylori", "asbestos", "occupational",
]

# Patterns of the tagger.
AGE_PATTERN = (r"(?:aged?\s*)?(\d+)\s*(?:years?)?\s*(?:and\s*)?(?:or\s*)?"
               r"(over|under|above|below|older|younger|\+|and over)")
AGE_UPWARD = ["over", "above", "older", "+", "and over"]
TIMEFRAME_PATTERN = r"(\d+)\s*[\-\s]*(week|day|month|year)s?"
URGENCY_PATTERNS = {
    "urgent_2_week": [
        r"suspected\s+cancer\s+pathway", r"2[\s\-]?week", r"two[\s\-]?week",
        r"within\s+2\s+weeks?", r"appointment\s+within\s+2\s+weeks?",
    ],
    "urgent": [
        r"refer\s+urgently", r"urgent\s+referral", r"immediate\s+referral",
        r"very\s+urgent",
    ],
    "consider": [
        r"consider\s+referral", r"consider\s+referring",
        r"consider\s+an?\s+urgent", r"consider\s+direct\s+access",
    ],
    "routine": [r"routine\s+referral", r"non[\-\s]?urgent\s+referral"],
}
URGENCY_LEVELS = ["urgent_2_week", "urgent", "consider", "routine", "monitor", "unknown"]
CONTENT_TYPES = ["recommendation", "table", "criteria", "background", "definition",
                 "pathway", "content"]
ACTION_PATTERNS = {
    "offer": r"\bOffer\b",
    "refer": r"\bRefer\b",
    "consider": r"\bConsider\b",
    "arrange": r"\bArrange\b",
    "discuss": r"\bDiscuss\b",
    "do_not_offer": r"\bDo\s+not\s+offer\b",
    "do_not_refer": r"\bDo\s+not\s+refer\b",
    "carry_out": r"\bCarry\s+out\b",
    "use": r"\bUse\b",
}

# Page and paragraph structure.
PAGE_MARKER = r"(?:<!-+\s*Page\s*(\d+)\s*-+>|^---$)"
SECTION_HEADER = r"^(#{1,3})\s+(\d+(?:\.\d+)*)\s+(.+)$"
RAW_SECTION = r"^(\d+(?:\.\d+)*)\s+([A-Z][A-Za-z\s]+)"
LINE_SECTION = r"^(\d+(?:\.\d+)*)\s+([A-Z][A-Za-z\s,]+)$"
PAGE_TABLE_ROW = r"\|.+\|"
LINE_RECOMMENDATION = r"\b(Offer|Consider|Refer urgently?|Do not offer|Discuss|Arrange)\b"
BULLETS = ["•", "-", "●", "○", "▪"]
PARAGRAPH_SECTION = r"^#{1,4}\s+(\d+(?:\.\d+)*)\s+(.+)$"
PARAGRAPH_RECOMMENDATION = (
    r"(?:^>\s*\*\*|^\*\*(?:Offer|Consider|Refer|Do not|Discuss|Arrange)"
    r"|^Offer\s|^Consider\s|^Refer\s)")
RECOMMENDATION_HINTS = ["**", "offer", "consider", "refer"]  # one of them is in every match
CHUNK_TABLE_ROW = r"^\|.*\|$"
NUMBERED_SECTION = r"^(\d+(?:\.\d+)*)\s+(.+)$"
CHARS_PER_PAGE = 2500

# Phrases that decide a chunk's content type, in order of test.
CRITERIA_PHRASES = ["refer urgently", "2 week", "urgent referral",
                    "if the patient", "years or over", "years and over"]
BACKGROUND_PHRASES = ["evidence shows", "studies have", "research indicates",
                      "the following factors", "risk factors include"]
DEFINITION_PHRASES = ["is defined as", "means", "refers to"]

# Query expansion.
SYMPTOM_SYNONYMS = {
    "cough": ["persistent cough", "chronic cough", "coughing"],
    "haemoptysis": ["hemoptysis", "coughing blood", "blood in sputum"],
    "weight loss": ["unexplained weight loss", "weight reduction", "losing weight"],
    "fatigue": ["tiredness", "exhaustion", "lethargy"],
    "dysphagia": ["difficulty swallowing", "swallowing problems"],
    "breathlessness": ["shortness of breath", "dyspnea", "breathing difficulty"],
    "lump": ["mass", "swelling", "nodule"],
    "pain": ["ache", "discomfort", "tenderness"],
}
CANCER_KEYWORDS = {
    "lung": ["lung cancer", "pulmonary", "respiratory", "thoracic"],
    "breast": ["breast cancer", "mammary"],
    "colorectal": ["colorectal cancer", "bowel cancer", "colon", "rectal"],
    "prostate": ["prostate cancer", "prostatic"],
    "skin": ["skin cancer", "melanoma", "dermatological"],
    "bladder": ["bladder cancer", "urological"],
    "lymphoma": ["lymphoma", "lymph nodes", "lymphatic"],
}
DEFAULT_ASSESSMENT_QUERY = "cancer referral criteria"

# Red-flag rules (flag, condition, note); all are urgent_2_week.
RED_FLAGS = [
    ("haemoptysis", "lung_cancer", "Coughing up blood - urgent chest X-ray needed"),
    ("unexplained weight loss", "multiple", "Unintentional weight loss >5% in 3 months"),
    ("persistent hoarseness", "laryngeal_cancer", "Voice changes lasting >3 weeks"),
    ("dysphagia", "oesophageal_cancer", "Difficulty swallowing - urgent endoscopy"),
    ("breast lump", "breast_cancer", "New breast lump - urgent referral"),
    ("rectal bleeding", "colorectal_cancer", "Rectal bleeding with change in bowel habit"),
    ("visible haematuria", "bladder_cancer", "Blood in urine - urgent urology referral"),
    ("testicular lump", "testicular_cancer", "Non-painful testicular enlargement"),
    ("post-menopausal bleeding", "endometrial_cancer", "Any bleeding after menopause"),
]
AGE_RED_FLAG = ("persistent cough in patient ≥40", "consider", "lung_cancer",
                "Consider chest X-ray if smoker or ex-smoker")
HIGH_RISK_FACTORS = ["smoker", "smoking", "family history", "previous cancer"]
# Fixed values: (lowest score, risk level, urgency, recommendation).
RISK_BANDS = [
    (60, "high", "urgent_2_week", "Consider suspected cancer pathway referral"),
    (40, "moderate", "urgent", "Urgent investigation recommended"),
    (20, "low", "routine", "Routine referral or monitoring"),
    (0, "low", "routine", "Monitor and review if symptoms persist"),
]
RED_FLAG_RECOMMENDATION = "Refer using suspected cancer pathway"
# Fixed values: (cancer, urgency, pathway, timeline, actions).
PATHWAYS = [
    ("lung", "urgent_2_week", "Suspected lung cancer pathway", "Appointment within 2 weeks",
     ["Request urgent chest X-ray", "Refer to respiratory physician",
      "Include smoking history in referral"]),
    ("breast", "urgent_2_week", "Suspected breast cancer pathway", "Appointment within 2 weeks",
     ["Refer to breast clinic", "Include examination findings", "Note any family history"]),
    ("colorectal", "urgent_2_week", "Suspected lower GI cancer pathway",
     "Appointment within 2 weeks",
     ["Request FIT test if appropriate", "Refer for colonoscopy",
      "Include bowel habit changes"]),
]
PATHWAY_DEFAULT_ACTIONS = ["Refer to appropriate specialist",
                           "Include full clinical history",
                           "Document examination findings"]
RISK_LEVELS = ["critical", "high", "moderate", "low", "insufficient_info"]
ASSESSMENT_URGENCIES = ["immediate", "urgent_2_week", "urgent", "soon", "routine", "monitor"]
AGENT_URGENCIES = ["immediate", "urgent_2_week", "urgent", "soon", "routine"]

# Display labels.
HIT_URGENCY_LABELS = {
    "urgent_2_week": "🔴 Urgent (2-week pathway)", "urgent": "🔴 Urgent",
    "soon": "🟡 Soon", "routine": "🟢 Routine", "": "⚪ Not specified",
}
ASSESSMENT_URGENCY_LABELS = {
    "immediate": "🔴 Immediate action required",
    "urgent_2_week": "🔴 2-week suspected cancer pathway",
    "urgent": "🟠 Urgent referral recommended",
    "soon": "🟡 Referral within 4-6 weeks",
    "routine": "🟢 Routine referral",
    "monitor": "⚪ Monitor and review",
}
AGENT_URGENCY_LABELS = {
    "immediate": "🔴 Immediate action required",
    "urgent_2_week": "🔴 2-week suspected cancer pathway",
    "urgent": "🟠 Urgent referral recommended",
    "soon": "🟡 Referral within 4-6 weeks",
    "routine": "🟢 Routine referral/monitoring",
}
URGENCY_DESCRIPTIONS = {
    "urgent_2_week": "Suspected cancer pathway - 2 week referral",
    "urgent": "Urgent referral (not 2-week pathway)",
    "consider": "Consider referral",
    "routine": "Routine referral",
    "unknown": "Urgency not specified",
}
ACTION_LABELS = {
    "search_guidelines": "🔍 Searched guidelines",
    "check_red_flags": "⚠️ Checked red flags",
    "calculate_risk": "📊 Calculated risk",
    "get_referral_pathway": "🏥 Retrieved referral pathway",
    "extract_symptoms": "📋 Extracted symptoms",
    "lookup_cancer_criteria": "📖 Looked up cancer criteria",
    "get_section": "📄 Retrieved guideline section",
}

# Words and patterns of the conversation rules.
ASSESSMENT_KEYWORDS = [
    "assess", "evaluate", "analyze", "analyse", "check risk",
    "what is the risk", "run assessment", "do assessment",
    "cancer risk", "referral", "should i refer",
    "give assessment", "provide assessment", "start assessment",
]
AFFIRMATIVE_KEYWORDS = [
    "yes", "yeah", "yep", "sure", "ok", "okay", "go ahead",
    "please", "proceed", "do it", "run it", "yes please",
]
CONTEXT_QUESTION_WORDS = ["what", "how", "tell", "remind", "summarize", "summary",
                          "show", "give"]
CONTEXT_PATTERNS = [
    r"what (is|was|are|were) the (patient'?s? )?age",
    r"what'?s the age",
    r"how old",
    r"what (is|was|are|were) the symptom",
    r"what symptom",
    r"what (is|was|are|were) the (patient'?s? )?(info|information|detail)",
    r"what do (you|we) (know|have)",
    r"what (is|are) in (the )?context",
    r"tell me (about )?the patient",
    r"summarize",
    r"summary",
    r"what have i told",
    r"what did i (say|tell)",
    r"remind me",
    r"show me (the )?(patient|info|details)",
    r"what (is|are|was|were) the (key )?(finding|result|conclusion|outcome)",
    r"(key )?finding",
    r"what did (you|the assessment) (find|conclude|determine)",
    r"give me (the )?(finding|result|summary|conclusion)",
    r"(show|tell) me (the )?(finding|result)",
]
PATIENT_AGE_PATTERN = r"\bage\s*:?\s*\d+|\b\d+\s*(year|yr|yo)\b|\baged\s*\d+"
PATIENT_SEX_PATTERN = r"\b(male|female)\b"
MY_PATIENT_PATTERN = (r"\b(my patient|this patient|the patient is|patient presents"
                      r"|i have a patient)\b")
ASSESS_COMMAND_PATTERN = r"\b(assess|evaluate|check risk|risk assessment)\b"
GUIDELINE_QUESTION_PHRASES = [
    "what does ng12", "what symptoms", "what are the criteria",
    "what referral", "does ng12", "according to ng12",
    "tell me about", "explain", "summarize the",
    "what is the threshold", "what age", "at what age",
    "which cancers", "which symptoms", "how is",
    "when should", "what investigations",
]
FOLLOW_UP_PHRASES = [
    "what about", "and for", "how about", "what if",
    "does that", "is that", "same for", "also",
    "what else", "any other", "besides that",
    "and what", "how does", "can you also",
]
QUESTION_STARTS = ["what", "which", "how", "when", "does", "is", "are", "can", "should"]
TURN_AGE_PATTERNS = [
    r"(?:age|aged)\s*(?:is|:)?\s*(\d{1,3})",
    r"(\d{1,3})\s*(?:year|yr|yo)",
    r"patient\s+(?:is\s+)?(\d{1,3})",
]
TURN_SYMPTOMS = {
    "cough": ["cough", "coughing"],
    "fever": ["fever", "febrile", "temperature"],
    "weight loss": ["weight loss", "losing weight"],
    "fatigue": ["fatigue", "tired", "tiredness"],
    "pain": ["pain", "ache"],
    "bleeding": ["bleeding", "blood"],
    "lump": ["lump", "mass", "swelling"],
    "breathlessness": ["breath", "dyspnea", "breathless"],
}
TURN_DURATION_PATTERN = r"(\d+)\s*(day|week|month|year)s?"

# Transcript format and lenient JSON.
THOUGHT_PATTERN = r"Thought(?:\s*\d*)?:\s*(.+?)(?=Action|Final Answer|$)"
FINAL_ANSWER_PATTERN = r"Final Answer:\s*(.+)$"
ACTION_NAME_PATTERN = r"Action(?:\s*\d*)?:\s*(\w+)"
ACTION_INPUT_PATTERN = r"Action Input(?:\s*\d*)?:\s*(\{.+?\})"
FENCED_JSON_PATTERN = r"```(?:json)?\s*([\s\S]*?)\s*```"
BRACED_JSON_PATTERN = r"\{[\s\S]*\}"
CITATION_PATTERN = r"\[NG12[^\]]+\]"

# Retrieval and evaluation limits.
DEFAULT_TOP_K = 5
SIMILARITY_THRESHOLD = 0.5
GROUNDED_THRESHOLD = 0.7
QUALITY_GATES = {"recall": 0.6, "hit_rate": 0.8, "mrr": 0.4, "ndcg": 0.5}
MAX_TOKENS_PER_BATCH = 15000

# The default evaluation queries
# (query, expected cancers, expected symptoms, expected urgency).
EVALUATION_QUERIES = [
    ("60 year old with weight loss and back pain", ["pancreatic_cancer"],
     ["weight_loss", "back_pain", "abdominal_pain"], "urgent_2_week"),
    ("55 year old with dysphagia and weight loss", ["stomach_cancer"],
     ["dysphagia", "weight_loss"], "urgent_2_week"),
    ("patient with upper abdominal mass", ["stomach_cancer", "liver_cancer"],
     ["abdominal_pain"], None),
    ("50 year old with rectal bleeding and weight loss", ["colorectal_cancer"],
     ["rectal_bleeding", "weight_loss", "abdominal_pain"], "urgent_2_week"),
    ("45 year old with change in bowel habit and abdominal pain", ["colorectal_cancer"],
     ["abdominal_pain", "weight_loss"], None),
    ("patient with unexplained anal mass", ["colorectal_cancer"], ["unexplained"], None),
    ("35 year old woman with unexplained breast lump", ["breast_cancer"],
     ["breast_lump", "lump"], "urgent_2_week"),
    ("50 year old with nipple discharge", ["breast_cancer"], ["breast_lump", "lump"], None),
    ("55 year old woman with persistent bloating and abdominal pain", ["ovarian_cancer"],
     ["bloating", "abdominal_pain", "persistent", "weight_loss"], None),
    ("58 year old woman with post-menopausal bleeding", ["endometrial_cancer"],
     ["unexplained", "persistent"], "urgent_2_week"),
    ("65 year old man with visible haematuria", ["bladder_cancer", "prostate_cancer"],
     ["haematuria"], "urgent_2_week"),
    ("55 year old man with raised PSA and urinary symptoms", ["prostate_cancer"],
     ["haematuria"], None),
    ("patient with unexplained weight loss and fatigue",
     ["ovarian_cancer", "pancreatic_cancer", "stomach_cancer", "colorectal_cancer"],
     ["weight_loss", "fatigue", "unexplained"], None),
    ("unexplained lump in the axilla", ["breast_cancer"], ["lump", "unexplained"], None),
    ("testicular enlargement in young man", ["testicular_cancer"],
     ["persistent", "unexplained"], None),
    ("woman with vulval lump and ulceration", ["vulval_cancer"], ["unexplained", "lump"], None),
]

# Terms counted by the document profile.
PROFILE_TERMS = ["lung cancer", "breast cancer", "hemoptysis", "haemoptysis",
                 "urgent referral", "2 week", "two week", "suspected cancer", "refer"]
