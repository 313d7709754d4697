"""Fixed values of the terminology engine: word lists, spelling pairs, weights."""

from __future__ import annotations

# --- fixed values: Chinese variant characters, variant then standard -----------
ZH_VARIANTS = "臺裏着綫峯衞爲啓痺疱菸麪羣歎眞脣"
ZH_STANDARD = "台裡著線峰衛為啟痹皰煙麵群嘆真唇"

# --- fixed values: British spellings and their American forms, in order --------
BRITISH = [
    ("oesophag", "esophag"),
    ("haemorrh", "hemorrh"),
    ("haemat", "hemat"),
    ("haem", "hem"),
    ("anaem", "anem"),
    ("aemia", "emia"),
    ("leukaem", "leukem"),
    ("paediatr", "pediatr"),
    ("paed", "ped"),
    ("(?<!angi)oedema", "edema"),
    ("foet", "fet"),
    ("tumour", "tumor"),
    ("colour", "color"),
    ("behaviour", "behavior"),
    ("diarrhoea", "diarrhea"),
    ("gynaecol", "gynecol"),
    ("orthopaed", "orthoped"),
    ("ischaem", "ischem"),
    ("coeliac", "celiac"),
    ("caesarean", "cesarean"),
    ("aetiolog", "etiolog"),
    ("sulph", "sulf"),
    ("fibre", "fiber"),
    ("centre", "center"),
    ("litre", "liter"),
]

# --- fixed values: stop words --------------------------------------------------
STOP_WORDS = ["of", "the", "a", "an", "and", "or", "in", "on", "to", "by", "for", "as", "at", "from", "into", "nos", "nec"]

# --- fixed values: the code points that count as Chinese characters ------------
CJK = "\u3400-\u9fff\uf900-\ufaff"
CJK_COMPATIBILITY = "\uf900-\ufaff"

# --- fixed values: vocabulary sources in order of priority, with weights -------
SOURCES = [
    ("title", 1.0),
    ("cdc-idx", 0.85),
    ("cdc-see", 0.8),
    ("cdc-incl", 0.85),
    ("cdc-neo", 0.6),
    ("doid", 0.75),
    ("doid-rel", 0.5),
    ("mesh", 0.7),
    ("zh14", 0.75),
    ("zh9", 0.55),
    ("naer", 0.7),
    ("cur-zh", 0.95),
    ("cur-abbr", 0.95),
    ("cms-idx", 0.8),
    ("en9", 0.5),
    ("wd", 0.7),
    ("wd-alias", 0.6),
    ("fix-zh", 0.95),
]
UNKNOWN_SOURCE_WEIGHT = 0.5
DIRECT_SOURCES = [1, 2]  # index and see-references name a term's default code
HELD_OUT_SOURCES = [1, 2, 8, 9]

# --- fixed values: ranking constants -------------------------------------------
K1, B = 1.2, 0.3
ENTRY_WEIGHT = 0.6
GAP_WEIGHT = 0.5
NODE, EXPLODE = 60.0, 25.0
SEGMENT_BONUS, SEGMENT_SHARE = 12.0, 0.75
MIN_COVERAGE = 0.5
DIRECT_BONUS, DEFAULT_CHILD = 1.08, 0.96
HEADER, MANIFESTATION, NEGATION, OBSTETRIC = 0.97, 0.9, 0.6, 0.85
CODE_EXACT, CODE_PREFIX, CODE_RANGE = 1000.0, 500.0, 800.0
LIMIT, FUZZY_MIN, PREFIX_MIN, PREFIX_MOST, SPAN_WORDS = 60, 4, 3, 40, 5
SIDE = {
    "match": 1.3,
    "other": 0.5,
    "unspecified": 0.8,
    "off_topic": 0.8,
    "none": 0.85,
    "site_miss": 0.75,
    "site_conflict": 0.5,
    "later": 0.9,
    "open": 0.9,
    "generic": 1.06,
    "member": 0.99,
    "top": 5,
}

# --- fixed values: Chinese phrases before a negated term, clause separators ----
ZH_NEGATIONS = ["未伴有", "未併有", "未合併", "無", "未", "非"]
ZH_SPLIT = "[，、,;；:：()（）\\[\\]［］〔〕「」\\s/]+|未伴有|伴有|併有|合併|所致|引起|及|與|或|之|的"

# --- fixed values: facet rules, first match wins -------------------------------
SIDES_UNSPECIFIED = "side|eye|ear|arm|leg|hand|foot|knee|hip|shoulder|elbow|wrist|ankle|thigh|lower leg|upper arm|forearm|finger|toe|kidney|ovary|breast|lung|limb|upper limb|lower limb"
FACETS = {
    "lat": [("bilateral", "雙側"), ("right", "右側"), ("left", "左側"), (f"unspecified ({SIDES_UNSPECIFIED})", "未明示側"), ("unilateral", "單側")],
    "enc": [("initial encounter", "初次照護"), ("subsequent encounter", "後續照護"), ("sequela", "後遺症")],
    "acu": [("acute on chronic", "慢性急性發作"), ("acute", "急性"), ("chronic", "慢性"), ("recurrent", "復發")],
    "cmp": [("without (complication|complications)", "未伴有併發症"), ("with (complication|complications)", "伴有併發症")],
    "fx": [("open fracture", "開放性"), ("closed fracture", "閉鎖性")],
    "dsp": [("nondisplaced", "無移位"), ("displaced", "移位")],
}
BILLABLE, TITLE_ONLY = "可申報", "標題碼"
LEFT, RIGHT, BOTH, ONE, SIDE_UNKNOWN = "左側", "右側", "雙側", "單側", "未明示側"
FIRST_VISIT, OPEN_FRACTURE = "初次照護", "開放性"

# --- fixed values: body sites: in a query, in a Chinese name, in an English name
SITE_CHARS = "膝腳腿手臂眼耳肺腎乳肩髖踝腕肘足趾指腋小大上下頸胸背臀股脛腓鎖肱橈尺跟"
SITES = [
    (r"\b(legs?|calf|shin|thighs?)\b|小腿|大腿|下肢|腿|腳(?![趾跟踝掌底])", "下肢|小腿|大腿|腿", r"\blower (limb|extremit|leg)|\blegs?\b|\bthigh\b"),
    (r"\b(arms?|forearm)\b|\bupper (limb|extremity)\b|手臂|上肢|前臂", "上肢|手臂|前臂", r"\bupper (limb|extremit|arm)|\barm\b|forearm"),
    (r"\baxilla(ry)?\b|腋", "腋", "axilla"),
    (r"\bknees?\b|膝", "膝", r"\bknee"),
    (r"\bhips?\b|髖", "髖|股骨", r"\bhip\b|femur|femoral"),
    (r"\bshoulders?\b|肩", "肩", "shoulder"),
    (r"\belbows?\b|肘", "肘", "elbow"),
    (r"\bwrists?\b|腕", "腕", "wrist"),
    (r"\bankles?\b|踝", "踝", "ankle"),
    (r"\bhands?\b|手(?![臂指術])", "手部|手(?![臂指])|上肢", r"\bhand\b|upper (limb|extremit)"),
    (r"\b(foot|feet)\b|足(?!跟)", "足|下肢", r"\bfoot\b|lower (limb|extremit)"),
    (r"\beyes?\b|眼", "眼", r"\beye\b"),
    (r"\bears?\b|耳", "耳", r"\bear\b"),
    (r"\bbreasts?\b|乳(?!糜)", "乳", "breast"),
    (r"\blungs?\b|肺", "肺", "lung"),
    (r"\b(fingers?|thumbs?)\b|手指|拇指", "指(?!甲)", "finger|thumb"),
    (r"\btoes?\b|趾", "趾", r"\btoes?\b"),
]
# subtypes not chosen unless the query names them: query words, English name
AVOID = [
    (r"\bmale\b|男", r"\bmale breast"),
    (r"\b(proximal|distal)\b|近端|遠端", r"\b(proximal|distal)\b"),
    (r"patholog|病理|stress|壓力性|疲勞性|osteopor|骨質疏鬆|neoplas|腫瘤", "pathological fracture|stress fracture"),
]
# details worded otherwise in official names: query, Chinese name, English name
HINTS = [
    (r"\bdistal\b|遠端", "下端|遠端", "lower end|distal"),
    (r"\bproximal\b|近端", "上端|近端", "upper end|proximal"),
    (r"\bshaft\b|骨幹", "骨幹", "shaft"),
]
GENERIC_NAME = r"\bunspecified\b|\bprimary\b|\bwithout\b"
GENERIC_PART = r"\bunspecified (part|site)s?\b"
UNSPECIFIED_SITE = r"\bunspecified site\b"
FOREIGN_BODY = r"\bwith foreign body\b"
CONTENT_STOP = "unspecified other specified without with classified elsewhere encounter initial subsequent sequela disease disorder condition part site unilateral bilateral".split()
SITE_STOP = "right left side shoulder knee hip elbow wrist ankle hand foot eye ear breast lung limb upper lower extremity extremities leg arm joint region finger thumb toe axilla".split()
PREGNANCY = "妊娠|懷孕|孕|產|胎|分娩|哺乳|pregnan|obstet|puerper|trimester|labou?r|deliver|gestation|partum|fetal|fetus|abortion|ectopic|placenta|eclampsia|lactation"

#: First part of a link's path, and the view it opens.
ROUTES = {
    "q": "search",
    "h": "heading",
    "c": "code",
    "p": "pcs",
    "m14": "map14",
    "m9": "map9",
    "cat": "cat",
    "changes": "changes",
    "about": "about",
    "fav": "fav",
    "derm": "derm",
    "batch": "batch",
}
#: Views without argument.
PLAIN_VIEWS = ["home", "changes", "about", "fav", "batch"]

#: What kinds of notes and changes are called.
NOTE_LABELS = {
    "incl": "包含（Inclusion terms）",
    "includes": "本類包含",
    "excl1": "Excludes1（不可與本碼同時編）",
    "excl2": "Excludes2（不屬本碼，但可同時編）",
    "codeFirst": "先編（Code first）",
    "useAdd": "另加編碼（Use additional code）",
    "codeAlso": "亦編（Code also）",
}
STATUS_LABELS = {"new": "2023 新增碼", "en": "英文名稱修改", "zh": "中文名稱修改"}
