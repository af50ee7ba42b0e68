"""Patterns, word lists and limits whose exact form decides results."""

# --- scripts -----------------------------------------------------------------------------------------------------------
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]"
LATIN = r"[A-Za-z\x{c0}-\x{24f}]"
NO_SIGNAL = r"[\s\d\p{P}\p{S}]"
HAN = r"[\x{4e00}-\x{9fff}]"
HAN_WIDE = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
LEAST_LETTERS, CJK_SHARE, LATIN_SHARE = 4, 0.25, 0.5

# --- front matter and page furniture -----------------------------------------------------------------------------------
BOILERPLATE = r"this copy is for personal use|for personal use only|to order (?:printed )?copies|reprints?@|contact reprints|downloaded (?:from|by)|all rights reserved|©\s*(?:[A-Za-z]+\s*)?(?:19|20)\d\d"
RECEIVED = r"\b(received|revised|accepted|published online|available online|publish-ahead-of-print)\b.{0,60}\b(20\d\d|19\d\d)\b"
META_LABEL = r"^(citation|(?:academic|handling|section|associate|guest)\s+editor|editor|received|accepted|published|posted|copyright|funding|competing interests?|conflicts? of interest|data availability(?: statement)?|abbreviations|author contributions?|provenance|peer review(?:er)?s?(?: information)?|ethics(?: statement)?|patient consent|trial registration)\s*[:：]"
ARTICLE_BANNER = r"^(research article|review(?: article)?|original (?:article|research|investigation)|open access|case report|short communication|brief report|editorial|systematic review|meta-analysis|clinical trial|letter to the editor|perspective|commentary|rapid communication|technical note|crossmark|check for updates)$"
GRANT = r"\bgrants?\s?(?:nos?|numbers?|#)\b\.?\s*:?\s*[\w-]"
LICENSE_TAIL = r"provided the original (?:work|author|source)|source are credited|reproduction in any medium|funders? had no role|decision to publish|preparation of the manuscript"
COPYRIGHT = r"©|\(c\)\s?20\d\d|\bcopyright\b|creative\s?commons|open access article|all rights reserved|licen[cs]e|\breuse\b.{0,40}\bdistribution\b|non-?commercial"
CORRESPONDENCE = r"\b(corresponding author|correspondence to|e-?mail|电子邮件|通讯作者)\b|@[a-z0-9.-]+\.[a-z]{2,}"
DOI_URL = r"\b(doi|https?):|doi\.org|academic\.oup\.com|downloaded from"
AFFILIATION_HEAD = r"^[\d¹²³⁴⁵*†‡§,\s]{0,8}(department|division|institute|university|hospital|center|centre|school|laboratory|faculty|clinic)\b"
DEGREES = r"\b(MD|PhD|MSc|MBBS|MBBCh|BChir|MB|DPhil|DrPH|FACC|FESC|FRCP|RN|MPH)\b"
AUTHOR_NOTES = r"contributed equally|authors.{0,3} affiliations|conflicts? of interest|funding (?:statement|sources?)|appendix paragraph|supplementary (?:data|material).{0,30}(?:online|published)"
INSTITUTION = r"\b(university|hospital|department|institute|center|centre|school|laboratory|clinic|college|academy)\b"
ORPHAN_MARKS = r"^[\d\s.,;:*†‡§()\-–—]+$"
NAME_LIKE = r"^[A-Z][a-zA-Z'’.-]*[\d,;*†‡§]*$"
JOURNAL_FOOT = r"\b[\w-]+\.(org|com|net|edu|gov|io|co|uk|de|fr)\b"

# --- paragraph shapes --------------------------------------------------------------------------------------------------
ENDS_SENTENCE = r"[.!?。！？][\"'”’」』)\]]*\s*$"
STARTS_CONTINUATION = r"^(?:[a-z]|[,;:)\]}、，；：）】」』])"
LEADER_DOTS = r"(?:\.{4,}|(?:\.\s){4,})"
LIST_START = r"^(\[\d{1,3}\]|[•▪◦‣·*–—-]\s|\(?\d{1,2}[.)]\s|[（(]\d{1,2}[）)]|[ivxIVX]{1,4}[.)]\s)"
ORDERED_LIST = r"^[（(]?\d{1,3}[.)）]\s+\S"
SECTION_PREFIX = r"^\d+(\.\d+)+"
SECTION_NUMBER = r"^\d+(\.\d+)+\s+\S"
FIGURE_OR_TABLE = r"^(figure|fig\.?|table|图|表|圖)\s*\d+"
BULLET = r"^[•▪◦‣·o*-]\s+"
SECTION_WORD = r"^(abstract|introduction|methods?|materials and methods|results|discussion|conclusions?|acknowledg(e)?ments?|references|摘要|引言|前言|方法|结果|讨论|结论|致谢)\s*$"
BARE_LABEL = r"^(figure|fig\.?|table|图|表|圖)\s*\d+[a-z]?\s*[.:：]?$"
REFERENCES = r"^(references|bibliography|works cited|literature cited|参考文献)\s*:?$"
LIGHT_FONT = r"(semilight|extralight|ultralight|thin|light|regular|roman|book|medium|-medi\b)"
BOLD_FONT = r"(bold|black|heavy|semibold|demibold|-bd\b|,bd\b|cmbx|-bx\b|[-_]b\b)"
MATH_FONT = r"(cmmi|cmsy|cmex|msam|msbm|math|symbol|stix|euler|mtmi|mtsy)"
CJK_EDGE = r"[\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]"
IDEOGRAPH = r"[\x{4e00}-\x{9fff}]"
#: ASCII word boundary.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
HYPHENS = "-­‐‑"

# --- formulas, citations, statistics -----------------------------------------------------------------------------------
MATH_SYMBOL = r"[∑∏∫√∞≈≠≤≥±×÷∂∇∈∉⊂⊃∪∩⇒⇔→←↔αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ]"
OPERATOR = r"[=+\-*/^_(){}\[\]|<>~]"
DELIMITED = (r"\$[^$]{1,200}\$", r"\\\((?:[^\\]|\\[^)]){1,200}\\\)", r"\\\[(?:[^\\]|\\[^\]]){1,200}\\\]")
CITATION_OR_STATISTIC = (
    r"\[\d{1,3}(?:\s*[,;–—-]\s*\d{1,3}){0,8}\]",
    r"\(\d{1,3}(?:\s*[,;–—-]\s*\d{1,3}){0,8}\)",
    r"\b[Pp]\s*[<>=≤≥]\s*\.?\d+(?:\.\d+)?",
    r"\b\d{1,2}(?:\.\d)?%\s*CIs?\s*[:=,]?\s*\d[\d.]*\s*(?:[–—-]|to)\s*\d[\d.]*",
    r"\d+(?:\.\d+)?\s*±\s*\d+(?:\.\d+)?",
    r"\b[nN]\s*=\s*\d[\d,]*",
)
EQUATION = r"(?:[A-Za-zα-ωΑ-Ω0-9)\]]|\S)[^,。;；.!?]{0,80}?[=≈≠≤≥][^,。;；.!?]{1,120}"
TOKEN = r"⟦PM\d+⟧"
TOKEN_VARIANT = r"(?:⟦|\[\[|\[|【)\s*[PpＰ]\s*[MmＭ]\s*([0-9０-９]{1,4})\s*(?:⟧|\]\]|\]|】)"
RISK_PHRASES = ("abbreviated as", "defined as", "denoted as", "is defined as", "can be defined as", "where ", "represented by", "expressed as", "written as", "calculated as", "corresponds to", "refers to", "stands for")

# --- quality of generated text -----------------------------------------------------------------------------------------
ENGLISH_WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)?"
RESIDUE_SEGMENT = r"[A-Za-z][A-Za-z0-9\s,;:()'./%+-]{30,}"
AUTHOR_TOKEN = r"\b(?:[A-Z]\.\s*)?[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`´.-]+\b"
TERM_PAIR = r"([\x{4e00}-\x{9fff}]{2,14})\s*[(（]\s*([A-Z][A-Za-z0-9-]{1,11})\s*[)）]"
STOP_ABBREVIATIONS = ("CI", "SD", "OR", "HR", "RR", "IQR", "AUC", "N", "P", "ID", "DOI", "URL", "PDF", "FIG", "EQ")
COPY_SIMILARITY, COPY_LEAST, TRUNCATED_SOURCE, TRUNCATED_SHARE = 0.82, 32, 200, 0.15
PROSE_WORDS, TARGET_SHARE, SHORT_SOURCE, RESIDUE_RUN = 6, 0.45, 80, 6

# --- secrets -----------------------------------------------------------------------------------------------------------
SECRETS = (  # pattern, whether case matters not, and what stays before the mark
    (r"(authorization\s*[:=]\s*)(\"?)(bearer\s+)?[a-z0-9._~+/-]{8,}={0,2}(\"?)", True, "$1"),
    (r"(x-api-key\s*[:=]\s*)(\"?)[a-z0-9._~+/-]{8,}(\"?)", True, "$1"),
    (r"(\"?api[_-]?key\"?\s*[:=]\s*)(\"?)[a-z0-9._~+/-]{8,}(\"?)", True, "$1"),
    (r"sk-ant-[a-zA-Z0-9_-]{10,}", False, ""),
    (r"sk-[a-zA-Z0-9_-]{16,}", False, ""),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(:fx)?\b", True, ""),
    (r"(bearer\s+)[a-z0-9._~+/-]{8,}={0,2}", True, ""),
)
REDACTED = "[REDACTED]"

# --- planning ----------------------------------------------------------------------------------------------------------
CHUNK_CHARS, CHUNK_BLOCKS, CHUNK_FILL, CONTEXT_CHARS = 8000, 24, 0.85, 600
HASH_PRIMES, HASH_SEEDS = (0x01000193, 0x01000197), (0x811C9DC5, 0xCBF29CE4)

# --- answers and errors of services --------------------------------------------------------------------------------------
ANSWER_LABEL = r"^(?:translation|译文|翻译)\s*[:：]\s*"
ASKS_FOR_INPUT = r"(?:请\s*(?:提供|输入|给出|粘贴|发送)|(?:please\s+)?(?:provide|send|enter|paste)\s)"
QUOTA = "quota|billing|insufficient|credit"
REJECTED = r"unsupported\s+value|unrecognized\s+request\s+argument|unknown\s+parameter|not\s+supported\s+with\s+this\s+model|only\s+the\s+default"
NETWORK = "network|fetch|dns|connect|refused|NS_ERROR"

# --- sentences, labels, cells --------------------------------------------------------------------------------------------
ABBREVIATION = r"(?:^|[\s(])(?:[A-Za-z]|al|Fig|fig|Eq|eq|No|no|vs|cf|resp|approx|Ref|ref|Sec|sec|Tab|tab|Dr|Mr|Ms|Mrs|Prof|St|Inc|Ltd|e\.g|i\.e|etc)\.$"
SENTENCE_STOP = r"([。！？；]|[.!?;])[\"'”’」』)\]】]*"
SENTENCE_START = r"[A-Z0-9“\"'(\[一-鿿]"
REGION_END = r"[.!?。！？][)\]\"'”’]?\s*$"
BARE_CITATION = r"[\[(]?\d+(\s*[,–—-]\s*\d+)*[\])]?[.,]?"
CELL_MARKS = r"[0-9±%.,;:()/<>=+\-·—–]"
NUMERIC_CELL = r"[\d\s.,%±()/<>=+\-·—–]+"
REGION_CHARS = 2600
