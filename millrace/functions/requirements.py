"""Requirement items into atoms, and atoms into structured fields.

Rules go by grammar: closed classes (prepositions, conjunctions, introducers, names of languages and degrees) are listed,
open classes are not. Everything is a pure function of the text; `split_udf` and `decompose_udf` run it in Arrow batches and
are meant to be called once per distinct text (text.map_distinct).
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGE_NAMES = "English German French Spanish Italian Dutch Polish Portuguese Swedish Danish Norwegian Finnish Czech Russian Chinese Mandarin Japanese Arabic Turkish Hungarian Romanian Greek".split()
LANGUAGE = re.compile(r"\b(" + "|".join(LANGUAGE_NAMES) + r")\b")
#: The words for each degree (fixed values). A rank is also written as its letter and a subject: BSc, M.A., B. Eng.
RANKS = {"bachelor": "bachelor", "master": "master"}
SUBJECTS = ("sc", "a", "eng")
OTHER_DEGREES = {
    "phd": ("ph.d", "ph. d", "phd", "doctorate", "doctoral degree"), "mba": ("mba",), "student": ("ongoing studies", "enrolled student", "enrolled"),
    "degree": ("university degree", "college degree", "academic degree", "degree", "diploma", "completed university studies", "completed studies"),
}
#: How a degree is named in a core: by its word, except for the abbreviations.
SHORT_NAMES = {"phd": "PhD", "mba": "MBA"}


def _degree_patterns() -> dict[str, str]:
    """The pattern of each degree, put together from the words above; `years` is the French count after
    school (bac + n), of a range the lower end."""
    out = {"years": r"bac\s*\+\s*(?P<n>\d)(?:\s*(?:/|-|to|à|or)\s*(?:bac\s*)?\+?\s*\d)?"}
    for rank, word in RANKS.items():
        letters = "|".join(rf"{word[0]}\.?\s?{s}\.?" if len(s) > 1 else rf"{word[0]}\.?{s}\.?" for s in SUBJECTS)
        out[rank] = rf"{word}(?:'?s)?(?: of (?!{'|'.join(RANKS.values())})\w+)?|{letters}"
    for kind, words in OTHER_DEGREES.items():
        out[kind] = "|".join(re.escape(w) + r"\.?" if "." in w else re.escape(w) for w in words)
    return out


_KINDS = _degree_patterns()
_DEGREE = "|".join(f"(?:{p})" for p in _KINDS.values()).replace("?P<n>", "?:")


def degree_of(text: str) -> str:
    """Which degree a spelling names."""
    for kind, pattern in _KINDS.items():
        if m := re.fullmatch(pattern, text.strip(), re.I):
            if kind != "years":
                return kind
            n = int(m.group("n"))
            return "phd" if n >= 8 else "master" if n >= 5 else "bachelor" if n >= 3 else "degree"
    return "degree"


DEGREE = re.compile(rf"(?<![\w.])(?:{_DEGREE})(?![\w])", re.I)
DEGREE_LIST = re.compile(rf"^(?:an?\s+)?((?:{_DEGREE})(?:\s+degree)?(?:\s*(?:,|/|\bor\b|\band\b|\bof\b(?=\s+(?:{_DEGREE})))+\s*(?:an?\s+)?(?:{_DEGREE})(?:\s+degree)?)*)\s*(?:\bin\b|\bof\b)\s+(.+)$", re.I)
#: A degree beside an experience: another requirement, or another way to the same.
DEGREE_AND = re.compile(rf"^((?:an?\s+)?(?:{_DEGREE})\b.+?)\s+(?:with\s+(?:an?\s+)?(.+\bexperience)|or\s+(equivalent\s+experience))(?:\s+(?:required|is required|preferred))?$", re.I)

INTRODUCER = re.compile(r",?\s+(?:such as|like|including|e\.g\.|for example|for instance|namely)\s*:?\s+|:\s+", re.I)
PREPOSITION = r"with|in|of|on|for|using|at|across|within|about|around|under"
HEAD = re.compile(rf"^(.{{2,70}}?\b(?:{PREPOSITION}))\s+(.+)$", re.I)
OPENER = re.compile(
    r"^(?:(?:very\s+)?(?:good|strong|solid|excellent|sound|deep|basic|proven|practical|first|fluent|advanced|working)\s+)?(?:knowledge|experience|understanding|command|skills?|ability|abilities|willingness|openness|interest|familiarity|proficiency|expertise|degree|fluency|familiar|able|capable|proficient|fluent)\b", re.I
)
CONTAINER = re.compile(r"\b(?:languages?|frameworks?|tools?|technologies|libraries|platforms?|systems?|solutions?|products?|databases?|software)$", re.I)
OPTIONAL = re.compile(r"\b(?:ideally|preferably|nice to have|a plus|an advantage|desirable|optional(?:ly)?|would be (?:good|great))\b", re.I)
SIMILAR = re.compile(r"(?:,?\s*(?:and|or)\s+(?:an?\s+)?(?:similar|equivalent|comparable|related|other|others|the like)(?:\s+(?:field|fields|degree|qualification|technical qualification|subject|discipline|tools?|technolog\w+|solutions?|systems?|frameworks?|ones?|area|areas|experience))?|,?\s*etc\.?|\s+of\s+gelijkwaardig|\s*\(or (?:equivalent|similar|comparable)\))\s*$", re.I)
FILLER = re.compile(r"^(?:and|or|as well as|both|either|also|e\.g\.|such as|like)\s+", re.I)
MODES = re.compile(r"\b(?:written|spoken|verbal|oral|writing|speech|reading)\b(?:\s+(?:and|or)\s+|,\s*)(?:in\s+)?\b(?:written|spoken|verbal|oral|writing|speech|reading|speaking)\b", re.I)
MAX_WORDS, MAX_CHARS = 6, 48


def _top(text: str, pattern: str) -> list[str]:
    """Split at matches of a pattern outside brackets; a comma between digits or inside a number does not count."""
    depth, cut, last = 0, [], 0
    spans = {m.start(): m.end() for m in re.finditer(pattern, text, re.I)}
    i = 0
    while i < len(text):
        c = text[i]
        depth += (c in "([{") - (c in ")]}")
        if depth <= 0 and i in spans and spans[i] > i:
            cut.append(text[last:i])
            i = last = spans[i]
            continue
        i += 1
    cut.append(text[last:])
    return [p.strip(" ,;") for p in cut if p.strip(" ,;")]


LIST = r"\s*,\s*(?:and\s+|or\s+|as well as\s+)?(?!\d)|\s+(?:and|or|as well as|&)\s+|\s+/\s+"


def tidy(item: str) -> str:
    text = re.sub(r"\s+", " ", item or "").strip()
    text = re.sub(r"^(?:[-*•·–>]+|\d+[.)])\s*", "", text)
    return re.sub(r"[\s.;,]+$", "", text)


def _drop_similar(text: str) -> str:
    while (m := SIMILAR.search(text)) and m.start() > 3:
        text = text[: m.start()].rstrip(" ,")
    return text


def _pieces(tail: str) -> list[str]:
    """The members of a list, without fillers; one member if it is no list."""
    parts = [FILLER.sub("", p) for p in _top(_drop_similar(tail), LIST)]
    return [p for p in (_drop_similar(p) for p in parts) if p]


def _listlike(parts: list[str]) -> bool:
    return len(parts) > 1 and all(len(p.split()) <= MAX_WORDS and len(p) <= MAX_CHARS for p in parts)


def _degrees(text: str) -> list[str] | None:
    """Degrees times fields, if the text asks for degrees in fields."""
    text = re.sub(r"\s*\((?:or equivalent|or similar|or comparable|[^)]*(?:school|university)[^)]*)\)", "", text.replace("’", "'"), flags=re.I)
    if (m := DEGREE_AND.match(text)) and not re.search(r"\bwith\b", m.group(1), re.I):
        return [*(_degrees(m.group(1)) or [m.group(1)]), m.group(2) or m.group(3)]
    m = DEGREE_LIST.match(_drop_similar(text))
    if not m:
        return None
    names = [d.group(0).strip() for d in DEGREE.finditer(m.group(1))]
    named = [n for n in names if n.lower() != "degree"]
    names = named if named and (names[0].lower() != "degree" or re.match(r"(?:an?\s+)?degree\s+of\b", text, re.I)) else [n for i, n in enumerate(names) if n.lower() != "degree" or i == 0]
    fields = _pieces(m.group(2))
    fields = fields if _listlike(fields) else [_drop_similar(m.group(2))]
    suffix = " degree" if re.search(r"\bdegree\b", text, re.I) and not any("degree" in n.lower() for n in names) else ""
    return [f"{n}{suffix} in {f}" for n, f in product(names, fields)]


def _languages(text: str) -> list[str] | None:
    """One requirement per language where only languages are listed after the same words."""
    found = list(LANGUAGE.finditer(text))
    if len(found) < 2:
        return None
    parts = _top(text, r"\s*,?\s*(?:in combination with|combined with|plus)\s+|" + LIST)
    if not all(LANGUAGE.search(p) for p in parts) or len(parts) != len(found):
        return None
    head = text[: found[0].start()].strip()
    out = []
    for p in parts:
        alone = LANGUAGE.fullmatch(FILLER.sub("", p))
        fresh = re.search(r"in combination with|combined with", text, re.I)
        out.append(p if not alone or not head or fresh else f"{head} {alone.group(0)}")
    return out


def _brackets(text: str) -> list[str] | None:
    """A bracket of names after a phrase: the phrase with each name; explanations in brackets stay."""
    m = re.match(r"^(.*?)\s*\((?:e\.g\.|i\.e\.|such as|like|including)?:?\s*([^()]+)\)\s*(.*)$", text, re.I)
    if not m:
        return None
    head, inner, tail = m.groups()
    if re.search(r"\becosystem$", head, re.I):
        return [f"{head} {tail}".strip()]
    names = _pieces(inner)
    named = sum(bool(re.match(r"[A-Z0-9.]", n)) for n in names)
    if not _listlike(names) or named < len(names) or tail or MODES.search(inner):
        return None
    lead = HEAD.match(head)
    if lead and CONTAINER.search(head):
        return [f"{lead.group(1)} {n}" for n in names]
    return [f"{head} {n}" for n in names] if lead else None


def _introduced(text: str) -> list[str] | None:
    """Category and examples: the examples with the words before the category; a plain container is dropped."""
    parts = INTRODUCER.split(text, maxsplit=1)
    if len(parts) != 2 or len(parts[0]) < 3:
        return None
    head, names = parts[0].strip(), _pieces(parts[1])
    if not names or not all(len(n.split()) <= MAX_WORDS for n in names):
        return None
    lead = re.match(rf"^(.*\b(?:{PREPOSITION}))\s+(.+)$", head, re.I)
    if lead:
        keep = [] if CONTAINER.search(lead.group(2)) else [head]
        return keep + [f"{lead.group(1)} {n}" for n in names]
    return [] + names if CONTAINER.search(head) else [head, *names]


def _headed(text: str) -> list[str] | None:
    """Head with a preposition and a list: every member with the head; purposes after `for` stay whole."""
    if MODES.search(text) or re.search(r"\bbetween\b", text, re.I):
        return None
    m = re.match(r"^(.*\b(?:with|in|of|using|across))\s+both\s+(.+?)\s+and\s+(\S+)\s+(\S+)$", text, re.I)
    if m:
        head, a, b, noun = m.groups()
        return [f"{head} {a} {noun}", f"{head} {b} {noun}"]
    m = HEAD.match(text)
    if not m or re.search(r"\b(?:as|than|years? of)$", m.group(1), re.I) and not re.search(r"\bwith|in\b", m.group(1), re.I):
        return None
    head, tail = m.groups()
    if re.search(r"\bfor$", head, re.I) or re.search(r"\bfor\b", tail, re.I):
        return None
    if re.search(r"\band\s+use\s+of$", head, re.I):
        return [re.sub(r"\s+and\s+use\s+of$", " of", head, flags=re.I) + " " + tail]
    parts = _pieces(tail)
    if len(parts) > 1 and all(OPENER.match(p) for p in parts[1:]):
        return [f"{head} {parts[0]}", *parts[1:]]
    return [f"{head} {p}" if not OPENER.match(p) else p for p in parts] if _listlike(parts) else None


def _clauses(text: str) -> list[str] | None:
    """Requirements that each open with words of their own, joined by `and` or a comma."""
    parts = _top(text, r"\s*,\s*(?:and\s+)?(?!\d)|\s+and\s+|\s+as well as\s+")
    out: list[str] = []
    for p in parts:
        if out and not OPENER.match(p):
            return None
        out.append(p)
    return out if len(out) > 1 else None


def _traits(text: str) -> list[str] | None:
    """Short lists without a head: traits, or modifiers of one last noun."""
    if MODES.search(text) or re.search(rf"\b(?:{PREPOSITION}|to|as|work|between)\b", text, re.I):
        return None
    parts = _pieces(text)
    if not _listlike(parts):
        return None
    m = re.match(r"^(.*\S)\s+(skills?|abilities|citizenship)$", parts[-1], re.I)
    if m and all(len(p.split()) == 1 for p in parts[:-1]) and len(m.group(1).split()) == 1:
        return [f"{p} {m.group(2)}" for p in [*parts[:-1], m.group(1)]]
    return parts if len(parts) > 2 or all(len(p.split()) == 1 for p in parts) else None


def split_item(item: str | None) -> list[str]:
    """The atoms of an item, in order and without repeats; a text without anything to split is one atom."""
    text = tidy(item or "")
    if not text:
        return []
    parts = _top(text, r"\s*;\s*|\s*\n\s*|\s+[•·|]\s+")
    if len(parts) > 1:
        out = [a for p in parts for a in split_item(p)]
        return list(dict.fromkeys(out))
    m = re.match(r"^(.{3,}?),?\s+\(?(ideally|preferably)\s+(?!in\b|with\b|within\b|at\b|for\b)(.+?)\)?$", text, re.I)
    if m:
        names = _pieces(m.group(3))
        word = m.group(2) if LANGUAGE.search(m.group(3)) else m.group(2).capitalize()
        return list(dict.fromkeys([*split_item(m.group(1)), *[f"{word} {n}" for n in names]]))
    if re.search(r",?\s+(?:particularly|especially|preferably|ideally|if possible)\b", text, re.I):
        return [text]
    for rule in (_degrees, _languages, _brackets, _introduced, _clauses, _headed, _traits):
        if (found := rule(text)) is not None and found:
            return list(dict.fromkeys(p.strip() for p in found if p.strip()))
    return [_drop_similar(text)]


def route(item: str | None) -> tuple[list[str], str]:
    """Atoms and how they came about: rules, single, llm (looks compound, left whole) or damaged."""
    atoms = split_item(item)
    if not atoms:
        return [], "single"
    text = tidy(item or "")
    if any(re.match(r"^(?:and|or|but)\b", a, re.I) or a.count("(") != a.count(")") for a in atoms):
        return [text], "damaged"
    if len(atoms) > 1 or atoms[0] != text:
        return atoms, "rules" if len(atoms) > 1 else "single"
    compound = len(text) > 60 and re.search(r"\b(?:and|or)\b", text, re.I) and "," in text and not re.search(r"\bfor\b", text, re.I)
    return atoms, "llm" if compound else "single"


# ---- decomposing ---------------------------------------------------------------------------------------------------

YEARS = re.compile(r"\b(?:at least |min(?:imum|\.)? |more than |over )?(\d{1,2})\s*(?:(?:-|–|to)\s*(\d{1,2}))?\s*\+?\s*(?:or more\s+)?years?(?:['’])?(?:\s+(?:of|in))?\s*", re.I)
#: A scale of how well something is to be known, lowest step first, with the words for each step.
SCALE = (
    ("basic", "basic, first, initial"), ("good", "good, very good, solid, sound, proven"), ("strong", "strong, excellent, deep, profound, fluent, fluently, high level of"),
    ("advanced", "advanced, extensive"), ("expert", "expert, native"),
)
STEP = {w: step for step, words in SCALE for w in words.split(", ")}
LEVEL = re.compile(r"\b(" + "|".join(sorted(STEP, key=len, reverse=True)) + r")\b\s*", re.I)
FRAMES = [
    ("experience", r"(?:(?:multi-year|several years of|professional|practical|hands-on|relevant|related|previous|work(?:ing)?|proven)\s+)*experience(?:d)?(?:\s+(?:with|in|of|using|working with|developing|as))?"),
    ("competence", r"(?:programming\s+)?(?:knowledge|understanding|command|expertise|proficien\w+|competenc\w+|skills?|familiar(?:ity)?|well versed|know-how|use|mastery)(?:\s+(?:of|in|with|on|about))?"),
    ("ability", r"(?:ability|able|capable|capability|willing(?:ness)?|readiness|open(?:ness)?)\s*(?:to|of|for)?"),
    ("interest", r"(?:interest|interested|passion|passionate|enthusias\w+)\s*(?:in|for|about)?"),
]
_FRAMES = [(g, re.compile(rf"^(?:you\s+(?:have|bring)\s+|you\s+are\s+|are\s+|an?\s+|the\s+|with\s+an?\s+)*{p}\s*", re.I)) for g, p in FRAMES]
TAILS = re.compile(r"\s*(?:,?\s*(?:is|are|would be|will be)?\s*(?:an?\s+)?(?:plus|advantage|required|desirable|preferred|nice to have|must|minimum|min\.))\s*$|\s*\((?:min\.?\s*)?[ABC][12]\+?\)\s*$", re.I)
PURPOSE = re.compile(r"\s+for\s+.+$", re.I)
TRAIL_SKILL = re.compile(r"\s+(?:skills?|knowledge|experience|expertise)$", re.I)
#: Spellings of one thing (fixed values).
ALIASES = {
    "golang": "Go", "powerbi": "Power BI", "ms office": "Microsoft Office", "office package": "Microsoft Office", "microsoft excel": "Excel", "ms excel": "Excel", "microsoft azure": "Azure", "google cloud platform": "GCP",
    "google cloud": "GCP", "vue.js": "Vue", "vuejs": "Vue", "git version control": "Git", "driving licence b": "Driving licence", "valid driver's license": "Driving licence", "driver's license": "Driving licence", "driving license": "Driving licence",
}
DEBRIS = frozenset("of you have senior-level multi-year minimum ideally the a an and or with in level years".split()) | {"you have", "you are"}


def decompose(atom: str | None) -> dict:
    """The fields of an atom: years, level, head_group, degree, core, extra, space and key; core is '' for debris."""
    out = {"years_min": None, "years_max": None, "level": "", "head_group": "", "degree": "", "core": "", "extra": "", "space": "", "key": ""}
    text = tidy((atom or "").replace("’", "'"))
    text = OPTIONAL.sub("", text).strip(" ,")
    while TAILS.search(text):
        text = TAILS.sub("", text).strip(" ,")
    if m := YEARS.search(text):
        a, b = int(m.group(1)), int(m.group(2)) if m.group(2) else None
        if 1 <= a <= 25:
            out["years_min"], out["years_max"] = a, b
            text = (text[: m.start()] + " " + text[m.end() :]).strip(" ,")
    m = re.match(rf"^(?:an?\s+|completed\s+)?({_DEGREE})(?:\s+degree)?(?:\s*\([^)]*\))?(?:\s+(?:in|of)\s+(.+))?$", text, re.I)
    if m and not re.match(r"(?:m\.?a|b\.?a)\.?$", m.group(1), re.I) or (m and m.group(2)):
        kind = degree_of(m.group(1))
        field = _drop_similar(m.group(2)) if m.group(2) else ""
        name = SHORT_NAMES.get(kind, kind.capitalize())
        core = f"{name} in {field}" if field else f"{name} (any field)"
        return out | {"head_group": "education", "degree": kind, "core": core, "space": "education", "key": f"education: {core}"}
    found = list(LANGUAGE.finditer(text))
    rest = re.sub(r"[^\w\s]", " ", LANGUAGE.sub("", text))
    around = "very good well written spoken verbal oral both and or in a an the of level high current professional business technical fluent fluently speak speaks write writing speech reading knowledge command skills skill communication communicate you are have with is clear proficiency proficient language native excellent strong at least b1 b2 c1 c2 min"
    if len(found) == 1 and all(w.lower() in around.split() for w in rest.split()):
        if lv := LEVEL.search(text):
            out["level"] = STEP[lv.group(1).lower()]
        core = found[0].group(1)
        return out | {"head_group": "language", "core": core, "space": "language", "key": f"language: {core}"}
    if lv := LEVEL.match(re.sub(r"^(?:an?|the)\s+", "", text)):
        out["level"] = STEP[lv.group(1).lower()]
        text = re.sub(r"^(?:an?|the)\s+", "", text)[lv.end() :]
        while lv := LEVEL.match(text):
            text = text[lv.end() :]
    for group, pattern in _FRAMES:
        if (m := pattern.match(text)) and m.end() > 0:
            tail = text[m.end() :].strip(" ,")
            out["head_group"] = group if group != "interest" else ""
            if group == "interest" and tail:
                out["extra"] = "interest"
            text = tail
            break
    if not out["head_group"] and TRAIL_SKILL.search(text) and len(text.split()) > 1:
        out["head_group"] = "experience" if text.lower().endswith("experience") else "competence"
        text = TRAIL_SKILL.sub("", text)
    if PURPOSE.search(text):
        out["extra"] = (PURPOSE.search(text).group(0).strip() + " " + out["extra"]).strip()
        text = PURPOSE.sub("", text)
    text = re.sub(rf"^(?:{PREPOSITION}|the|an?|to)\s+", "", text, flags=re.I).strip(" ,.:;*!")
    core = ALIASES.get(text.lower(), text)
    if core.lower() in DEBRIS or not re.search(r"\w", core):
        core = ""
    return out | {"core": core, "key": core}


def canon(core: str) -> str:
    """A spelling that variants share: case, hyphens, British endings, plurals, REST forms."""
    t = re.sub(r"[-_/]+", " ", core.lower().replace("’", "'"))
    t = re.sub(r"restful", "rest", t)
    t = re.sub(r"isation\b", "ization", re.sub(r"ise\b", "ize", re.sub(r"our\b", "or", re.sub(r"elling\b", "eling", t))))
    return " ".join(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in t.split())


SPLIT_TYPE = T.StructType([T.StructField("atoms", T.ArrayType(T.StringType())), T.StructField("route", T.StringType())])
_TEXT_FIELDS = ["level", "head_group", "degree", "core", "extra", "space", "key"]
PARTS_TYPE = T.StructType([T.StructField(f, T.IntegerType()) for f in ("years_min", "years_max")] + [T.StructField(f, T.StringType()) for f in _TEXT_FIELDS])


@F.pandas_udf(SPLIT_TYPE)
def split_udf(items: pd.Series) -> pd.DataFrame:
    """Atoms and route of every item."""
    rows = [route(x) for x in items]
    return pd.DataFrame({"atoms": [r[0] for r in rows], "route": [r[1] for r in rows]})


@F.pandas_udf(PARTS_TYPE)
def decompose_udf(atoms: pd.Series) -> pd.DataFrame:
    """The fields of every atom."""
    out = pd.DataFrame([decompose(x) for x in atoms], columns=["years_min", "years_max", *_TEXT_FIELDS])
    return out.astype({"years_min": "Int32", "years_max": "Int32"})
