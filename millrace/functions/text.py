"""Text functions as columns: normalising, cleaning, segments, language, titles, lexicon."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters and their plain ones (fixed values), for normalising without leaving the JVM.
ACCENTED = "áàâäãåāąçćčďđéèêëēęěíìîïīłľñńňóòôöõøōőřŕśšşťúùûüūůűýÿźżžÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØÚÙÛÜÝ"
PLAIN = "aaaaaaaacccddeeeeeeeiiiiillnnnoooooooorrssstuuuuuuuyyzzzAAAAAACEEEEIIIINOOOOOOUUUUY"


def normalise(text: Column) -> Column:
    """Lower case, no accents, only letters, digits, _ + # . and single blanks."""
    flat = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"[^\p{L}\p{N}_+#.\s]", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """Compatibility forms and combining marks folded, for scripts that the table of `normalise` does not list."""
    def one(x):
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(one)


def clean(text: Column) -> Column:
    """No leading bullets and commas, no trailing punctuation, single blanks."""
    t = F.regexp_replace(text, r"^[\s\-*•·–—,;:.]+", "")
    t = F.regexp_replace(t, r"[\s,;:.]+$", "")
    return F.regexp_replace(t, r"\s+", " ")


def segments(cell: Column) -> Column:
    """The parts of a '|' list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(cell, r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def cell_items(cell: Column) -> Column:
    """The items of a cell that is a JSON list, lines, ' | ' parts or ';' parts."""
    listed = F.from_json(cell, "array<string>")
    pick = F.when(cell.rlike(r"^\s*\["), listed).when(cell.contains("\n"), F.split(cell, "\n")).when(cell.contains(" | "), F.split(cell, r" \| ")).otherwise(F.split(cell, ";"))
    return F.filter(F.transform(pick, lambda s: F.trim(s)), lambda s: s != "")


#: Marker words of six languages (fixed values); those of three or more languages tell nothing and are left out.
MARKERS = {
    "en": "the and of with for you our your are will from this have that work they their can".split(),
    "de": "und der die das mit für von sie wir ist ein eine den auf bei zu im oder".split(),
    "fr": "le la les et des vous nous une dans pour est avec sur au votre notre qui du".split(),
    "es": "el la los las y de con una para del en por es su nuestro tus como al".split(),
    "it": "il di e con una per del della nel sono che gli i le da nostra tuo un".split(),
    "nl": "de het een en van met voor je wij zijn op aan bij naar ons dat is of".split(),
}
_COUNTS: dict[str, int] = {}
for _words in MARKERS.values():
    for _w in set(_words):
        _COUNTS[_w] = _COUNTS.get(_w, 0) + 1
DISTINCTIVE = {l: sorted(w for w in set(ws) if _COUNTS[w] < 3) for l, ws in MARKERS.items()}
MIN_HITS, MIN_MARGIN = 2, 1


def language_hits(text: Column) -> dict[str, Column]:
    """Distinct marker words of each language in a text."""
    tokens = F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " "))
    return {l: F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in ws]))) for l, ws in DISTINCTIVE.items()}


def detect_language(text: Column) -> Column:
    """The language with most distinct markers; NULL under 2 hits or without a lead of 1. Ties go to NULL by the margin."""
    hits = language_hits(text)
    ranked = F.sort_array(F.array(*[F.struct(h.alias("h"), F.lit(l).alias("l")) for l, h in hits.items()]), asc=False)
    return F.when((ranked[0]["h"] >= MIN_HITS) & (ranked[0]["h"] - ranked[1]["h"] >= MIN_MARGIN), ranked[0]["l"])


def script_code(text: Column) -> Column:
    """zh for Han script, mul for other non-Latin scripts, else NULL."""
    return F.when(text.rlike(r"\p{IsHan}"), "zh").when(text.rlike(r"[\p{IsCyrillic}\p{IsArabic}\p{IsHebrew}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsGreek}]"), "mul")


#: Requirement types by pattern, in order; the first that matches wins.
LEXICON = [
    ("language", r"\b(english|german|french|spanish|italian|dutch|polish|portuguese|language|fluent)\b"),
    ("credential", r"\b(degree|diploma|bachelor|master|certificat\w*|licen[cs]e|qualification)\b"),
    ("availability", r"\b(travel|shift|weekend|part time|full time|on site)\b"),
    ("soft", r"\b(team|communication|independent|structured|careful|leadership|presentation|problem solving|customer focus)\b"),
    ("domain", r"\b(insurance|logistics|accounting|health care|retail|energy|transport|engineering)\b"),
    ("technical", r"\b(development|scripting|interfaces|administration|reporting|sql|python|java|excel|cloud|data)\b"),
]


def classify(text: Column) -> Column:
    """The first lexicon type that matches, or NULL."""
    out = F.lit(None).cast("string")
    low = F.lower(text)
    for kind, pattern in reversed(LEXICON):
        out = F.when(low.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


YEARS = r"(\d{1,2})\s*\+?\s*(?:-\s*\d{1,2}\s*)?(?:\+\s*)?(?:years|year|jahre|ans|años|anni|jaar|anos|lata|lat)\b"


def first_years(text: Column) -> Column:
    """The first number of years from 1 to 25 in a text, or NULL."""
    n = F.regexp_extract(F.lower(text), YEARS, 1).try_cast("int")
    return F.when(n.between(1, 25), n)


OPTIONAL = r"(?:nice to have|a plus|an advantage|desirable|preferred|ideally|von vorteil|idealerweise|wünschenswert|serait un plus|de préférence|se valora|preferiblemente|gradit|preferibilmente|mooi meegenomen|bij voorkeur|mais-valia|dodatkowym atutem|najlepiej)"


def nice_to_have(text: Column) -> Column:
    """Whether a requirement is marked as optional."""
    return F.coalesce(F.lower(text).rlike(OPTIONAL), F.lit(False))


def counted(optional: Column) -> Column:
    """Which atoms of an item count: all if all are optional, else those that are not."""
    return F.when(F.forall(optional, lambda x: x), F.transform(optional, lambda x: F.lit(True))).otherwise(F.transform(optional, lambda x: ~x))


LEVELS = r"\b(?:senior|junior|sr|jr|lead|principal|trainee|mid[- ]?level|head of|intern|ii|iii)\b\.?"


def clean_title(title: Column) -> Column:
    """A title without reference numbers, gender marks, brackets, work time and place tails, in lower case."""
    t = F.lower(F.coalesce(title, F.lit("")))
    t = F.regexp_replace(t, r"\([^)]*\)|\[[^\]]*\]|#\d+|\bref\.?\s*:?\s*\d+\s*:?|\b[mfhwdxv](?:/[mfhwdxv])+\b|\d+-\d+\s*%|\*", " ")
    t = F.regexp_replace(t, r"\s[|–—-]\s.*$", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}+#./& -]", " "), r"\s+", " "))


def title_key(title: Column) -> Column:
    """Sorted distinct content words of a cleaned title, without level words."""
    t = F.regexp_replace(clean_title(title), LEVELS, " ")
    words = F.filter(F.split(t, r"[^\p{L}\p{N}+#]+"), lambda w: (w != "") & ~w.isin("for", "of", "the", "and", "in", "a"))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def title_level(title: Column) -> Column:
    """The level word of a title, folded to one spelling, or ''."""
    word = F.regexp_extract(F.lower(F.coalesce(title, F.lit(""))), r"\b(senior|junior|sr|jr|lead|principal|trainee|mid-level)\b", 1)
    return F.when(word == "sr", "senior").when(word == "jr", "junior").otherwise(word)


def shared_ngrams(text: Column, other: Column, n: int = 3) -> Column:
    """Whether two texts share a run of n words."""
    def grams(c: Column) -> Column:
        w = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.arrays_overlap(grams(text), grams(other))


def names_of(core: Column) -> Column:
    """Sorted distinct names, acronyms and numbers of a core: words with a digit, a sign or a capital inside."""
    words = F.regexp_extract_all(core, F.lit(r"[\p{L}\p{N}+#./]+"), F.lit(0))
    named = F.filter(words, lambda w: w.rlike(r"\p{N}|[+#./]|\p{Lu}"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda w: F.lower(w))))


def map_distinct(df: DataFrame, column: str, function, out: str) -> DataFrame:
    """Apply an expensive column function once per distinct value and join the result back."""
    done = df.select(column).distinct().withColumn(out, function(F.col(column)))
    return df.join(done.withColumnRenamed(column, "__v"), df[column].eqNullSafe(F.col("__v")), "left").drop("__v")
