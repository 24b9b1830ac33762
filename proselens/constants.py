"""Fixed values that results depend on: labels, thresholds, word lists and patterns."""

LABELS = ("human", "ai", "paraphrased_ai")
WINDOW_SIZE, WINDOW_STRIDE, MIN_SENTENCE_CHARS = 3, 2, 15
MATTR_WINDOW = 50
TAU_SEMANTIC, DETECTGPT_THRESHOLD = 0.78, -0.02
COVERAGE_AI_THRESHOLD, COVERAGE_PARA_THRESHOLD, CONFIDENCE_THRESHOLD = 0.35, 0.30, 0.6
MAX_HEADING_WORDS, MAX_HEADING_CHARS = 8, 64
MAX_PAGES = 40

WORD = r"[A-Za-z][A-Za-z'\-]*|[0-9]+(?:\.[0-9]+)?"
VOWELS = r"[aeiouyAEIOUY]+"
NOT_SPOKEN = r"(https?://\S+)|(\w+@\w+\.\w+)|\d[\d\.\-]*"
MATH = r"(?s)(\$\$.*?\$\$|\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{equation\}.*?\\end\{equation\})"
CAPTION = r"(?i)^(figure|table)\s+\d+"
LIST_TOKEN = r"^\d+(?:\.\d+)*[\.)-]?$"

# Fixed word lists.
PRONOUNS = "i you he she it we they me him her us them my your his their our mine yours hers theirs ours".split()
DETERMINERS = "a an the this that these those each every some any".split()
CONJUNCTIONS = "and or nor but yet so".split()
ADPOSITIONS = "of in to for with on at from by about as into like through after over between out against during without before under around among".split()
ADJECTIVE_ENDS = ("ous", "ful", "able", "al", "ive", "ic")
POS_TAGS = ("noun", "verb", "adj", "adv", "pron", "det", "adp", "aux", "cconj", "other")

BULLETS = ("-", "*", "+", "•", "◦", "▪")
HEADING_STOP_WORDS = ("and", "the", "of", "on", "in", "for", "to", "a", "an", "chapter", "section", "part")
KNOWN_HEADINGS = (
    "abstract", "introduction", "background", "literature review", "literature survey", "related work", "related works",
    "problem statement", "approach", "model", "methodology", "methods", "materials and methods", "materials methods",
    "experimental setup", "experiments", "results", "results and discussion", "evaluation", "analysis", "discussion",
    "discussion and conclusion", "conclusion", "conclusions", "future work", "limitations", "acknowledgments", "acknowledgements",
    "references", "bibliography", "appendix", "supplementary materials", "supplementary material", "supplementary information",
)
NARRATIVE = ("PARA", "CAPTION")

# Canonical sections with their aliases; the first that fits counts.
SECTION_ALIASES = {
    "ABSTRACT": ("ABSTRACT", "SUMMARY"),
    "INTRODUCTION": ("INTRODUCTION", "BACKGROUND", "1 INTRODUCTION", "1. INTRODUCTION"),
    "METHODS": ("METHODS", "MATERIALS AND METHODS", "MATERIALS & METHODS", "METHODOLOGY", "EXPERIMENTAL SETUP"),
    "RESULTS": ("RESULTS", "FINDINGS", "EXPERIMENTS"),
    "DISCUSSION": ("DISCUSSION", "DISCUSSIONS", "ANALYSIS"),
    "CONCLUSION": ("CONCLUSION", "CONCLUSIONS", "SUMMARY AND CONCLUSION"),
    "REFERENCES": ("REFERENCES", "BIBLIOGRAPHY"),
    "ACKNOWLEDGMENTS": ("ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS"),
    "APPENDIX": ("APPENDIX", "APPENDICES", "SUPPLEMENTARY MATERIAL"),
}
REFERENCE_SECTIONS = ("REFERENCES", "ACKNOWLEDGMENTS", "APPENDIX")

# Section ontology of laid-out documents.
ONTOLOGY = {
    "TITLE": (),
    "ABSTRACT": ("abstract",),
    "KEYWORDS": ("keywords", "index terms"),
    "INTRODUCTION": ("introduction", "overview"),
    "BACKGROUND": ("background",),
    "RELATED_WORK": ("related work", "literature review", "previous work", "state of the art"),
    "METHODS": ("methods", "materials and methods", "methodology", "approach", "experimental setup"),
    "EXPERIMENTAL": ("experimental", "experiments"),
    "RESULTS": ("results", "findings"),
    "DISCUSSION": ("discussion", "analysis and discussion"),
    "CONCLUSION": ("conclusion", "conclusions", "concluding remarks", "summary and conclusion"),
    "LIMITATIONS": ("limitations", "threats to validity"),
    "FUTURE_WORK": ("future work", "outlook", "perspectives", "further research"),
    "ACKNOWLEDGMENTS": ("acknowledgment", "acknowledgments", "acknowledgements", "funding"),
    "REFERENCES": ("references", "bibliography", "works cited"),
    "APPENDIX": ("appendix", "supplementary"),
    "SUPPLEMENT": ("supplement",),
    "FIGURE_CAPTION": ("figure", "fig."),
    "TABLE_CAPTION": ("table",),
}
HEADING_NUMBER = r"(?i)^(?:[0-9IVX]+(?:\.[0-9]+)*)\s+"
BULLET_LINE = r"^\s*(?:[•\-–\*]|(?:\(?\d+[\)\.])|(?:[A-Za-z]\)))\s+"
SENTENCE_END = r"[.!?][\"')\]]?$"
# Table column names by header pattern, in order.
HEADER_PATTERNS = (
    ("SN", r"^\s*S/?N\b"),
    ("TITLE_YEAR", r"title\s*&?\s*author\(s\)[, ]*\s*year"),
    ("METHODOLOGY", r"^methodolog(y|ies)\b"),
    ("KEY_FINDINGS", r"^key\s*findings\b"),
    ("LIMITATIONS", r"^limitations\b"),
    ("OBSERVATIONS", r"^observations\b"),
    ("DATASET", r"^dataset\b"),
    ("CONTRIB", r"^contrib(ution)?s?\b"),
    ("OBS", r"^obs(ervations)?\b"),
)
CORE_HEADERS = frozenset(("TITLE_YEAR", "METHODOLOGY", "KEY_FINDINGS"))
HEADER_ALIASES = {"OBSERVATIONS": "LIMITATIONS", "OBS": "LIMITATIONS"}
HEADER_TITLES = {"TITLE_YEAR": "TITLE_AUTHOR_YEAR"}

# Report colours and titles.
LABEL_COLOURS = {"human": "#2ecc71", "ai": "#e74c3c", "paraphrased_ai": "#f39c12"}
LABEL_SYNONYMS = {"human-written": "human", "ai-generated": "ai", "machine": "ai", "paraphrased": "paraphrased_ai", "paraphrase": "paraphrased_ai"}

# Features of the trained document classifier, in order (fixed values).
META_FEATURES = (
    "span_start", "span_end", "n_sent", "n_words", "avg_word_len", "ttr", "mattr", "pos_noun", "pos_verb", "pos_adj", "pos_adv", "pos_pron", "pos_det",
    "pos_adp", "pos_aux", "pos_cconj", "pos_other", "burst_b", "burst_cv", "mean_slen", "flesch", "fk_grade", "gunning_fog", "ppl", "mean_entropy",
    "surprisal_mean", "surprisal_var", "avg_rank", "logprob", "detectgpt_score", "coverage", "max_sim", "top3_mean", "frac_above_tau", "num_windows",
    "top_nnfam_frac", "p_ai", "p_paraphrased", "p_human",
)
