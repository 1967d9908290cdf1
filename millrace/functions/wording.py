"""Row functions on the wording of requirements and titles: bare heads, names for readers, variants, alternatives, inspection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nouns that say nothing without what they relate to, words that fill, last words that add nothing to a name.
RELATIONAL = ("experience", "knowledge", "skills", "skill", "ability", "interest", "understanding", "willingness", "familiarity", "command", "degree")
FILLERS = ("etc", "similar", "other", "others", "related", "relevant", "equivalent", "comparable")
GENERIC = "framework|frameworks|tool|tools|software|platform|platforms|library|system|systems|programming|language"
#: Word lists of further languages: enough to recognise them, not to read them.
FURTHER = {
    "sv": ("och", "att", "med", "erfarenhet", "kunskap", "inom"), "da": ("og", "til", "erfaring", "kendskab", "inden"), "cs": ("nebo", "znalost", "zkušenosti", "praxe"),
    "ro": ("sau", "cunostinte", "experienta", "pentru"), "fi": ("sekä", "kokemus", "taito", "osaaminen"),
}


def bare_head(text: Column) -> Column:
    """Why a one-word requirement says nothing: noun, filler, adjective (a German one without its noun); NULL for others."""
    word = F.lower(F.trim(text))
    one = F.size(F.split(word, r"\s+")) == 1
    adjective = word.rlike("^(gute|guten|guter|sehr|fundierte|fundierten|sichere|sicherer|erste|ersten|fließende|fließend)$")
    return F.when(one, F.when(word.isin(*RELATIONAL), "noun").when(word.isin(*FILLERS), "filler").when(adjective, "adjective"))


def display(space: Column, core: Column) -> Column:
    """How a reader names a requirement: degrees and languages as they are, `analytical` as `Analytical skills`, else a capital first."""
    capital = F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 1_000_000))
    trait = core.rlike(r"^\p{Ll}+al$")
    return F.when(F.coalesce(space, F.lit("")).isin("education", "language"), core).when(trait, F.concat(capital, F.lit(" skills"))).otherwise(capital)


def plain_requirement(text: Column) -> Column:
    """A requirement without the frame around it: `you are able to`, `must be`, `having`, and a doubled `experience of experience`."""
    out = F.regexp_replace(text, r"(?i)^\s*(?:(?:the\s+)?(?:candidate|applicant)s?\s+|you\s+|we\s+expect\s+)?(?:must\s+|should\s+|will\s+)?(?:be|are|is|have|has|having|bring)\s+(?:able\s+to\s+)?", "")
    out = F.regexp_replace(out, r"(?i)\b(experience|knowledge)\s+(?:of|with|in)\s+\1\b", "$1")
    return F.trim(F.regexp_replace(out, r"[\s\x{00a0}]+", " "))


#: Machine translations that change the kind of a requirement, and what stands in the original (fixed values).
CALQUES = {"mastery of": r"^\s*ma[iî]trise\s+d", "high school diploma": r"^\s*bachillerato\b", "driving licence": r"^\s*(?:führerschein|patente di guida|rijbewijs)\b"}


def repaired(original: Column, translated: Column) -> Column:
    """The translation with calques put right, where the original opens with a word that is known to be mistranslated."""
    out = translated
    for right, pattern in CALQUES.items():
        wrong = {"mastery of": r"(?i)^\s*master(?:'s)?(?:\s+degree)?\s+(?:of|in)", "high school diploma": r"(?i)^\s*bac(?:calaureate|helor)(?:'s degree)?", "driving licence": r"(?i)^\s*(?:leader|guide|patent)\s*\w*"}[right]
        out = F.when(F.lower(original).rlike(pattern), F.regexp_replace(out, wrong, right)).otherwise(out)
    return out


def role_alternatives(text: Column) -> Column:
    """`Data or Software engineer` as [`Data engineer`, `Software engineer`]; [] for a text that names one role."""
    role = r"(?i)^(.{2,40}?)\s+(?:or|/|and/or)\s+(.{2,40}?)\s+(engineer|developer|manager|analyst|consultant|specialist|architect|administrator)s?$"
    noun = F.regexp_extract(text, role, 3)
    return F.when(text.rlike(role), F.array(F.concat_ws(" ", F.regexp_extract(text, role, 1), noun), F.concat_ws(" ", F.regexp_extract(text, role, 2), noun))).otherwise(F.array().cast("array<string>"))


def title_variants(title: Column) -> Column:
    """Spellings that join a title to others: words in the singular, in order of the alphabet; its letters alone; developer as engineer."""
    low = F.lower(F.trim(title))
    single = F.array_join(F.array_sort(F.transform(F.split(low, r"[^\p{L}\p{N}+#]+"), lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w))), " ")
    letters = F.concat(F.lit("#"), F.regexp_replace(low, r"[^\p{L}\p{N}+#]+", ""))
    return F.array_distinct(F.array(single, letters, F.regexp_replace(single, r"\bdeveloper\b", "engineer")))


def core_variants(core: Column) -> Column:
    """[(kind, form)] that a core may be a spelling of: without its version, its bracket, a generic last word."""
    forms = [("version", r"\s+v?\d+(?:\.\d+)*\+?$"), ("bracket", r"\s*\([^()]*\)$"), ("generic", rf"(?i)\s+(?:{GENERIC})$")]
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_replace(core, p, "")).alias("form")) for k, p in forms])
    return F.filter(made, lambda x: (x["form"] != core) & (x["form"] != ""))


#: Tests of one requirement in the order in which they are made: name and pattern on the core (fixed values of our own).
INSPECTIONS = (
    ("empty", r"^\s*$"), ("address", r"@|https?://|www\."), ("open_bracket", r"^[^(]*\)|\([^)]*$"), ("figures_only", r"^[\d\s.,+/-]+$"), ("leads_with_joint", r"(?i)^(?:and|or|und|oder|et|ou|y|o|e)\s"),
    ("ends_with_joint", r"(?i)\s(?:and|or|with|in|of|for|the|und|oder|mit)$"), ("leads_with_preposition", r"(?i)^(?:with|in|of|for|to|at|on)\s"), ("years_left", r"(?i)\d+\s*\+?\s*years?"),
    ("level_left", r"(?i)^(?:good|very good|strong|solid|basic|advanced|excellent)\s"), ("said_twice", r"(?i)\b(\w{3,})\s+\1\b"), ("sentence", r"^(?:\S+\s+){9,}\S+$"), ("several", r";|\|"),
)


def inspection(core: Column) -> Column:
    """The first of the tests that a core fails, or NULL."""
    return F.coalesce(*[F.when(F.coalesce(core, F.lit("")).rlike(p), F.lit(n)) for n, p in INSPECTIONS])


def further_language(text: Column) -> Column:
    """(lang, hits) of the further language whose words occur most, if one of at least four letters is among them; NULL otherwise."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    found = [F.struct((-F.size(F.array_intersect(words, F.array(*map(F.lit, ws))))).alias("n"), F.lit(l).alias("lang"), F.exists(F.array_intersect(words, F.array(*map(F.lit, ws))), lambda w: F.length(w) >= 4).alias("long")) for l, ws in FURTHER.items()]
    best = F.array_min(F.filter(F.array(*found), lambda x: x["long"]))
    return F.when(best.isNotNull(), F.struct(best["lang"].alias("lang"), (-best["n"]).alias("hits")))
