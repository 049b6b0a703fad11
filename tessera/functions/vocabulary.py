"""Fixed values of query normalisation, rewriting and expansion: word lists and tables that results depend on."""

from __future__ import annotations

# fixed values: abbreviations and spellings, by the word they stand for
ABBREVIATIONS = {
    "go": "government order", "gos": "government orders", "rte": "right to education", "fln": "foundational literacy numeracy", "ssa": "sarva shiksha abhiyan", "mdm": "mid day meal",
    "rmsa": "rashtriya madhyamik shiksha abhiyan", "npegel": "national programme for education of girls at elementary level", "niepa": "national institute of educational planning and administration",
    "ncert": "national council of educational research and training", "ncte": "national council for teacher education", "tet": "teacher eligibility test", "ctet": "central teacher eligibility test",
    "aptet": "andhra pradesh teacher eligibility test", "cse": "commissioner of school education", "dee": "director of elementary education", "dse": "director of school education",
    "spo": "state project office", "dpo": "district project office", "mpo": "mandal project office", "brcc": "block resource centre coordinator", "crc": "cluster resource centre",
    "pwds": "persons with disabilities", "cwsn": "children with special needs", "oosc": "out of school children", "ecce": "early childhood care and education", "npe": "national policy on education",
    "smdc": "school management and development committee", "vmc": "village monitoring committee", "pta": "parent teacher association", "ammavadi": "amma vodi", "amavodi": "amma vodi",
    "jagananna": "jagananna", "vidyakanuka": "vidya kanuka", "nadunedu": "nadu nedu", "manabadi": "mana badi", "gorumudda": "gorumudda",
}
# fixed values: spellings that are put right wherever they stand, in this order
SPELLINGS = [("goverment", "government"), ("govenment", "government"), ("committe", "committee"), ("recieve", "receive"), ("occured", "occurred"), ("right toeducation", "right to education")]
# fixed values: references and years that normalisation leaves as they are
PROTECTED = r"(?i:GO\.?\s*(?:Ms\.?|Rt\.?)?\s*No\.?\s*\d+)|(?i:Section\s+\d+(?:\([a-z0-9]+\))?)|\b(?:19|20)\d{2}\b"

# fixed values: vocabulary of each policy domain, in the order that breaks ties
DOMAINS = {
    "access_inclusion": [
        "admission", "enrollment", "enrolment", "dropout", "out-of-school children", "inclusion", "equity", "girl child education", "SC ST students", "minority education", "disabled children", "CWSN",
        "vulnerable children", "disadvantaged groups", "school mapping", "catchment area", "distance norms", "accessibility", "barrier-free education", "inclusive classroom", "special needs education",
    ],
    "infrastructure_safety": [
        "infrastructure", "nadu nedu", "facilities", "buildings", "classrooms", "toilets", "drinking water", "electricity", "boundary walls", "compound walls", "ramps", "furniture", "benches", "desks",
        "blackboards", "labs", "libraries", "playgrounds", "sports facilities", "kitchen", "construction", "maintenance", "CCTV", "security", "fire safety", "emergency exits", "TMF", "sanitation",
    ],
    "governance_administration": [
        "governance", "administration", "management", "inspection", "monitoring", "supervision", "compliance", "regulation", "DEO", "MEO", "DIET", "SCERT", "RJD", "CCE coordinator", "headmaster",
        "principal", "district collector", "authority", "responsibility", "accountability", "oversight", "quality assurance", "institutional framework", "policy implementation", "government orders",
    ],
    "welfare_schemes": [
        "amma vodi", "vidya kanuka", "vidya deevena", "gorumudda", "mid day meal", "midday meal", "school kit", "uniform", "scholarship", "financial assistance", "transport", "hostel",
        "residential school", "welfare scheme", "benefit", "incentive", "support", "assistance", "allowance", "stipend", "nutrition", "health checkup", "medical care", "student welfare", "social security",
    ],
    "curriculum_pedagogy": [
        "curriculum", "syllabus", "textbook", "subject", "course", "content", "learning material", "digital content", "e-content", "pedagogy", "teaching method", "learning outcome", "competency",
        "skill development", "FLN", "foundational literacy", "foundational numeracy", "lesson plan", "activity based learning", "project based learning", "experiential learning", "academic standards",
        "learning objectives", "educational technology",
    ],
    "assessment_evaluation": [
        "assessment", "evaluation", "examination", "test", "CCE", "continuous comprehensive evaluation", "grading", "marking", "scoring", "progress tracking", "learning assessment", "achievement",
        "performance", "result", "pass", "fail", "promotion", "measurement", "feedback", "report card", "academic performance", "learning level", "standardized test", "formative assessment",
        "summative assessment", "diagnostic assessment",
    ],
    "teacher_development": [
        "teacher", "teaching", "faculty", "staff", "recruitment", "appointment", "transfer", "posting", "training", "capacity building", "professional development", "in-service training",
        "pre-service training", "teacher education", "B.Ed", "TET", "DSC", "educator", "instructor", "human resource", "personnel", "qualification", "certification", "competency", "skill enhancement",
        "teacher welfare", "service conditions", "career progression",
    ],
}
# fixed values: domains of a query that names none, words that are no key terms, words of the rewrite over all domains
DEFAULT_DOMAINS = ["governance", "academic", "teacher", "infrastructure", "fln"]
REWRITE_STOPWORDS = ["what", "is", "are", "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "how", "do", "does", "can", "could", "should", "would", "will", "tell", "me", "about", "explain", "describe", "list"]
CROSS_DOMAIN = ["policy", "implementation"]
# fixed values: words added for sections of one act
SECTION_WORDS = {"12": ["25% admission", "weaker section", "disadvantaged group"], "13": ["no capitation fee", "admission procedures", "no screening"]}

# fixed values: phrases and what they are widened by, in order
PHRASES = {
    "school infrastructure": ["school facilities", "educational infrastructure", "school premises", "school buildings and facilities", "physical infrastructure of schools"],
    "teacher transfer": ["teacher posting", "teacher deployment", "teacher mobility", "transfer of teachers", "teacher relocation"],
    "learning outcomes": ["student achievement", "educational outcomes", "academic performance", "learning achievements", "student learning levels"],
    "quality education": ["educational quality", "quality of education", "education standards", "quality schooling", "quality learning"],
}
# fixed values: signs of questions on technology in teaching, and the words that these are widened by first
AI_SIGNS = ["ai", "artificial intelligence", "technology integration", "digital", "coding", "robotics", "innovation"]
CURRICULUM_SIGNS = ["curriculum", "syllabus", "school", "education"]
AI_TERMS = [
    "atal tinkering labs", "atl", "nep 2020", "national education policy", "technology integration", "digital education", "educational technology", "smart classroom", "stem education", "innovation labs",
    "coding education", "robotics education", "digital literacy", "computer education", "artificial intelligence curriculum", "technology enhanced learning",
]
# fixed values: terms of each category
CATEGORY_TERMS = {
    "infrastructure": ["infrastructure", "classroom", "toilet", "electricity", "water", "boundary", "furniture", "playground", "library", "lab"],
    "health": ["health", "safety", "medical", "first aid", "cctv"],
    "safety": ["safety", "cctv", "security", "health"],
    "fln": ["fln", "literacy", "numeracy", "reading", "learning outcomes"],
    "teacher": ["teacher", "training", "transfer", "recruitment", "tet"],
    "academic": ["curriculum", "textbook", "tlm", "assessment", "examination"],
    "monitoring": ["monitoring", "udise", "data", "compliance", "quality"],
    "welfare": ["mdm", "scholarship", "uniform", "bicycle"],
}
# fixed values: keyword lists of the first version's three rules: triggers, keywords
_PROGRAMS = [
    "Atal Tinkering Lab", "ATL", "Atal Innovation Mission", "NEP 2020", "National Education Policy 2020", "Samagra Shiksha", "Samagra Shiksha ICT", "Mana Badi Nadu-Nedu", "Mana Badi infrastructure",
    "DIKSHA platform", "DIKSHA digital platform", "PM eVIDYA", "smart classroom", "digital infrastructure",
]
V1_RULES = [
    (["ai", "artificial intelligence", "machine learning", "ml", "technology integration", "digital"], ["artificial intelligence", "machine learning", "AI", "ML", "technology integration", "digital education", "ICT", "information technology", "computer science", "coding", "robotics", "automation", "STEM", "STEAM", "innovation", "tinkering", "computational thinking", *_PROGRAMS]),
    (["syllabus", "curriculum", "course", "change", "integrate", "integrating"], ["curriculum framework", "NEP 2020", "educational standards", *_PROGRAMS]),
    (["coding", "programming", "computer", "robotics", "stem"], ["smart classroom", "digital infrastructure", "ICT lab", "computer lab", "technology lab", "innovation lab", "digital learning tools", "educational technology", *_PROGRAMS]),
]
V1_AI, V1_CURRICULUM = ["ai", "technology", "digital"], ["syllabus", "curriculum", "integrate", "change"]
V1_AI_TERMS = ["Atal Tinkering Lab", "ATL", "Atal Innovation Mission", "NEP 2020", "Samagra Shiksha ICT", "DIKSHA platform", "technology integration", "digital education", "ICT"]
# fixed values: synonyms of the first version, the first of each is used; words that a mode adds
V1_SYNONYMS = {
    "teacher": ["educator", "faculty", "instructor"], "student": ["pupil", "learner"], "school": ["educational institution"], "education": ["learning", "schooling"], "policy": ["guideline", "directive", "order"],
    "transfer": ["posting", "relocation"], "salary": ["pay", "remuneration", "wages"], "leave": ["absence", "time off"], "promotion": ["advancement", "elevation"], "GO": ["government order", "notification"],
    "section": ["provision", "clause"], "act": ["legislation", "law"], "amendment": ["modification", "revision"],
}
V1_MODE_WORDS = {"deep_think": "policy implications legal framework", "brainstorm": "innovative approaches solutions"}
