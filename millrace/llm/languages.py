"""Languages of items and of their parts: Bayesian fusion of text likelihoods, declared label and host priors.

Text: every word has a log-likelihood ratio per language, learnt by grouped counts over all distinct parts whose language
is plain from function words; a rare word, or one that stands in every language alike (a product name), has a ratio near 0.
Declared markup: the language the row's label names; how far labels can be trusted is counted in the data. Address: the
language mix of the row's country. Host: the mix of the row's company. The mixes are grouped counts smoothed hierarchically
(company towards country, country towards all rows).

Fusion comes first and the decision after it: the sum of the logarithms gives, for every part in its row, a posterior over the
languages and "none" (the text is no language's own), and a part has a language if its posterior reaches POSTERIOR.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.joins import merged
from millrace.session import cut

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt", "pl")

#: Function words of the eight languages: articles, prepositions, pronouns, conjunctions, auxiliaries.
SEEDS = {
    "en": "the and with of to for you your our in on is are or from by be not an as at this that we can will have has into",
    "de": "und mit der die das des den dem du im vom von für zu zur zum auf auch bei als oder nicht kein eine einer einen sind ist wir dich dir deine unser unsere",
    "fr": "et avec le les des du dans vous votre pour sur est une au aux ou que qui nos notre mais pas serait par car ce cette sont",
    "es": "y con el los las del una para por en es que su tu pero no como o al se son está tus nuestro nuestra sus lo ha",
    "it": "e con il lo gli della delle del nel nella una per che di è ma non sono al ai tuo perché alla dei degli nostra nostro sarebbe",
    "nl": "en met het een van de op voor je bij naar niet maar zijn is aan dat ons onze over om te uit als wel jouw wij wordt",
    "pt": "e com o os as do da dos na no nas uma para por em é que não mas sua seu nossa nosso à ao das como se tem pelo",
    "pl": "i w z na do od jest są nie oraz lub się że jak przez dla po nasz naszego twój ale będzie co przy ze",
}

#: Codes and names of the languages, folded (names in English, in the language itself and in the seven others).
NAMES = {
    "en": "en eng english englisch anglais ingles inglese engels angielski",
    "de": "de deu ger german deutsch allemand aleman tedesco duits alemao niemiecki",
    "fr": "fr fra fre french francais franzosisch frances francese frans francuski",
    "es": "es spa esp spanish espanol castellano spanisch espagnol spagnolo spaans espanhol hiszpanski",
    "it": "it ita italian italiano italienisch italien italiaans wloski",
    "nl": "nl nld dut dutch nederlands niederlandisch neerlandais neerlandes olandese holandes holenderski niderlandzki vlaams flemish",
    "pt": "pt por portuguese portugues portugiesisch portugais portoghese portugees portugalski",
    "pl": "pl pol polish polski polnisch polonais polaco polacco pools polones",
}

#: In learning alone, what the text by itself is sure of: evidence for the best language, and before the next one.
EVIDENCE = 1.5
MARGIN = 0.7
#: Pseudo-counts: of a word's language mix, and of host and country mixes.
WORD_PRIOR = 6.0
HOST_PRIOR = 20.0
#: Weight of a part that only its row's label speaks for, in learning; and the least share of a word's main language.
LABEL_WEIGHT = 1.0
WORD_SHARE = 0.7
#: A word in fewer items than this says nothing; so product names that stand in few items do not vote.
LEAST_PARTS = 6
#: Weight of label and host against the text; logarithm of the odds of "none" before anything is read; least posterior.
PRIOR_WEIGHT = 0.5
NONE = 1.0
POSTERIOR = 0.6

SEPARATOR = r"\s+[/|–—-]+\s+|(?<=\p{L}\p{L}[.!?])\s+|[;|\n\r\t•·]+|\s*[()\[\]{}]\s*"


def _fold(c: Column) -> Column:
    plain = F.translate(F.lower(c), "áàâäãåąçćéèêëęíìîïłñńóòôöõøśúùûüýÿźżž", "aaaaaaacceeeeeiiiilnnoooooosuuuuyyzzz")
    return F.trim(F.regexp_replace(plain, r"[\s\x{00a0}]+", " "))


def declared(label: Column) -> Column:
    """The one language that a label names, or NULL: a code or a name in any spelling, with or without a region."""
    text = F.regexp_replace(_fold(F.coalesce(label, F.lit(""))), r"\(.*?\)|\[.*?\]", "")
    words = F.filter(F.split(F.regexp_replace(text, r"[^a-z]+", " "), " "), lambda w: w != "")
    first = words[0]
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)])
    # A second word is a region or an addition, unless it names another language.
    found = F.array_distinct(F.filter(F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: table[w]), lambda x: x.isNotNull()))
    return F.when(F.size(words) > 0, F.when(F.size(found) > 1, F.lit(None)).otherwise(F.coalesce(table[first], F.when(F.size(found) == 1, found[0])))).cast("string")


#: Versions, codes and names with signs inside, which have no language.
TERMS = r"[\p{L}\p{N}]+[/&_+#@][^\s,;]*|\p{L}+\.\p{Ll}[^\s,;]*|[\p{L}]*\p{N}[\p{L}\p{N}.,]*"


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, TERMS, " ")), F.lit(r"[\p{L}]+"), F.lit(0)))


def _seed_language(words: Column) -> Column:
    """The language with at least two seed words and more than any other, or NULL."""
    hits = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in SEEDS[l].split()]))) for l in LANGUAGES]
    ranked = F.array_sort(F.array(*[F.struct((-h).alias("h"), F.lit(l).alias("l")) for h, l in zip(hits, LANGUAGES, strict=True)]))
    return F.when((ranked[0]["h"] <= -2) & (ranked[0]["h"] < ranked[1]["h"]), ranked[0]["l"])


def _ranked() -> Column:
    return F.array_sort(F.array(*[F.struct((-F.col(f"t_{l}")).alias("t"), F.lit(l).alias("l")) for l in LANGUAGES]))


def _best() -> Column:
    return _ranked()[0]["l"]


def _sure() -> Column:
    r = _ranked()
    return (r[0]["t"] <= -EVIDENCE) & (r[1]["t"] - r[0]["t"] >= MARGIN) & (F.col("voters") >= F.when(F.col("size") >= 3, 1).otherwise(2))


def _word_table(learn: DataFrame) -> DataFrame:
    """(word, s_<language>) of words that stand mainly in one language; learn has words, lang, weight.

    s is the logarithm of the word's rate in a language over its mean rate in all of them, so that a language with more
    text has no advantage; WORD_PRIOR occurrences spread evenly are added.
    """
    words = learn.select("lang", "weight", F.explode("words").alias("word"))
    per = [F.sum(F.when(F.col("lang") == l, F.col("weight")).otherwise(0.0)).alias(l) for l in LANGUAGES]
    counts = words.groupBy("word").agg(*per)
    total = counts.agg(*[F.sum(l).alias(l) for l in LANGUAGES]).first()
    size = {l: (total[l] or 0.0) + 1.0 for l in LANGUAGES}
    whole = sum(size.values())
    rate = {l: (F.col(l) + F.lit(WORD_PRIOR * size[l] / whole)) / F.lit(size[l]) for l in LANGUAGES}
    mean = reduce(lambda a, b: a + b, rate.values()) / len(LANGUAGES)
    bare = {l: F.col(l) / F.lit(size[l]) for l in LANGUAGES}
    main = F.greatest(*bare.values()) / reduce(lambda a, b: a + b, bare.values())
    seen = reduce(lambda a, b: a + b, [F.col(l) for l in LANGUAGES])
    return cut(counts.filter((seen >= LEAST_PARTS) & (main >= WORD_SHARE)).select("word", *[F.log(rate[l] / mean).alias(f"s_{l}") for l in LANGUAGES]))


def _evidence(parts: DataFrame, table: DataFrame) -> DataFrame:
    """(k, part, t_<language> sums, voters = words that speak for the best language).

    The first words count half as much again: a sentence opens in its own language, foreign terms stand further inside.
    """
    top = F.greatest(*[F.col(f"s_{l}") for l in LANGUAGES])
    main = F.array_max(F.array(*[F.struct(F.col(f"s_{l}").alias("s"), F.lit(l).alias("l")) for l in LANGUAGES]))["l"]
    votes = parts.select("k", "part", F.size("words").alias("size"), F.posexplode("words").alias("at", "word")).join(table.withColumn("main", F.when(top >= 0.5, main)), "word")
    out = votes.groupBy("k", "part").agg(F.max("size").alias("size"), *[F.sum(F.col(f"s_{l}") * F.when(F.col("at") < 5, 1.5).otherwise(1.0)).alias(f"t_{l}") for l in LANGUAGES], *[F.count_if(F.col("main") == l).alias(f"v_{l}") for l in LANGUAGES])
    voters = F.coalesce(*[F.when(_best() == l, F.col(f"v_{l}")) for l in LANGUAGES])
    return cut(out.withColumn("voters", voters).drop(*[f"v_{l}" for l in LANGUAGES]))


def item_languages(df: DataFrame, row: str, items: str, label: str, country: str, host: str) -> DataFrame:
    """The language of each item and of each part of an item that mixes several.

    Result: row, item_idx INT, part INT (0 = the whole item), lang STRING, confidence DOUBLE, declared STRING. An item in one
    language gives one row, one in several a row per language (part = first part in it, from 1); one without a language
    none. NULL and empty lists, NULL and empty items give no row; repeated rows are treated alike; an empty table gives an
    empty result. Items of any length are read whole.
    """
    base = df.select(F.col(f"`{row}`").alias("row"), declared(F.col(f"`{label}`")).alias("declared"), F.upper(F.trim(F.coalesce(F.col(f"`{country}`"), F.lit("")))).alias("country"), F.upper(F.trim(F.coalesce(F.col(f"`{host}`"), F.lit("")))).alias("host"), F.col(f"`{items}`").alias("items"))
    rows = base.select("row", "declared", "country", "host", F.posexplode("items").alias("item_idx", "item")).filter("item IS NOT NULL AND trim(item) <> ''")
    rows = cut(rows.withColumn("k", F.xxhash64("item")))
    texts = rows.groupBy("k").agg(F.first("item").alias("item"))
    pieces = F.filter(F.split("item", SEPARATOR), lambda s: F.trim(s) != "")
    parts = texts.select("k", F.posexplode(pieces).alias("part", "text")).withColumn("words", words_of(F.col("text")))
    parts = cut(parts.withColumn("seed", _seed_language(F.col("words"))))
    # Parts of a list without function words of their own follow the list, if its other parts agree.
    agreed = parts.filter("seed IS NOT NULL").groupBy("k").agg(F.min("seed").alias("lo"), F.max("seed").alias("hi")).filter("lo = hi").select("k", F.col("lo").alias("agreed"))
    labels = rows.groupBy("k", "declared").agg(F.count(F.lit(1)).alias("n"))
    learn = merged(merged(parts, agreed, "k", "left"), labels, "k")
    plain = F.coalesce("seed", "agreed")
    learn = learn.select("words", F.coalesce(plain, "declared").alias("lang"), (F.col("n") * F.when(plain.isNotNull(), 1.0).otherwise(LABEL_WEIGHT)).alias("weight"))
    text = _evidence(parts, _word_table(learn.filter("lang IS NOT NULL")))
    # A second round: what the first one is sure of teaches the words that no function word stood beside.
    sure = text.filter(_sure()).select("k", "part", _best().alias("best"))
    learn = merged(merged(parts, sure, ["k", "part"], "left"), labels, "k")
    learn = learn.select("words", F.coalesce("best", "declared").alias("lang"), F.col("n").cast("double").alias("weight"))
    text = _evidence(parts, _word_table(learn.filter("lang IS NOT NULL")))
    # Host priors: what the text alone is sure of, counted by country and by company, each smoothed towards the wider one.
    sure = text.filter(_sure()).select("k", _best().alias("lang"))
    held = merged(rows.select("k", "country", "host", "declared"), sure, "k")
    tally = [F.count_if(F.col("lang") == l).alias(f"n_{l}") for l in LANGUAGES]
    right = [F.count_if(F.col("declared") == F.col("lang")).alias("right"), F.count("declared").alias("labelled")]
    by_host = cut(held.groupBy("country", "host").agg(*tally, *right))
    sums = by_host.agg(*[F.sum(f"n_{l}").alias(l) for l in LANGUAGES], F.sum("right").alias("right"), F.sum("labelled").alias("labelled")).first()
    counted = {l: sums[l] or 0 for l in LANGUAGES}
    prior = {l: (counted[l] + 1) / (sum(counted.values()) + len(LANGUAGES)) for l in LANGUAGES}
    trust = ((sums["right"] or 0) + 1) / ((sums["labelled"] or 0) + 2)
    total = lambda: reduce(lambda a, b: a + b, [F.col(f"n_{l}") for l in LANGUAGES])
    by_country = by_host.groupBy("country").agg(*[F.sum(f"n_{l}").alias(f"n_{l}") for l in LANGUAGES])
    by_country = by_country.select("country", *[((F.col(f"n_{l}") + HOST_PRIOR * prior[l]) / (total() + HOST_PRIOR)).alias(f"c_{l}") for l in LANGUAGES])
    hosts = by_host.join(by_country, "country").select("country", "host", *[((F.col(f"n_{l}") + HOST_PRIOR * F.col(f"c_{l}")) / (total() + HOST_PRIOR)).alias(f"h_{l}") for l in LANGUAGES])
    # Fusion, part by part in its row, and for an item of several parts as a whole (part -1), whose words speak together.
    item = text.groupBy("k").agg(*[F.sum(f"t_{l}").alias(f"t_{l}") for l in LANGUAGES], F.sum("voters").alias("voters"), F.lit(0).alias("size"), F.count(F.lit(1)).alias("several")).filter("several > 1").drop("several").withColumn("part", F.lit(-1))
    text = text.unionByName(item).filter(F.col("voters") >= F.when(F.col("size") >= 3, 1).otherwise(2))
    full = merged(rows.select("row", "item_idx", "k", "declared", "country", "host"), text, "k").join(hosts, ["country", "host"], "left")
    even = 1 / len(LANGUAGES)
    label_p = {l: F.when(F.col("declared").isNull(), F.lit(even)).when(F.col("declared") == l, F.lit(trust)).otherwise(F.lit((1 - trust) / (len(LANGUAGES) - 1))) for l in LANGUAGES}
    score = {l: F.col(f"t_{l}") + PRIOR_WEIGHT * (F.log(label_p[l] / even) + F.log(F.coalesce(F.col(f"h_{l}"), F.lit(prior[l])) / even)) for l in LANGUAGES}
    full = full.select("row", "item_idx", "part", "declared", *[score[l].alias(f"s_{l}") for l in LANGUAGES]).withColumn("best", F.greatest(*[F.col(f"s_{l}") for l in LANGUAGES]))
    norm = reduce(lambda a, b: a + b, [F.exp(F.col(f"s_{l}") - F.col("best")) for l in LANGUAGES], F.exp(F.lit(NONE) - F.col("best")))
    lang = F.coalesce(*[F.when(F.col(f"s_{l}") == F.col("best"), F.lit(l)) for l in sorted(LANGUAGES, reverse=True)])
    full = full.select("row", "item_idx", "part", lang.alias("lang"), (1 / norm).alias("confidence"), "declared").filter(F.col("confidence") >= POSTERIOR)
    # The whole item only speaks where none of its parts does.
    out = full.groupBy("row", "item_idx", "lang").agg(F.max(F.when(F.col("part") >= 0, F.col("confidence"))).alias("own"), F.max("confidence").alias("whole"), F.min(F.when(F.col("part") >= 0, F.col("part"))).alias("part"), F.first("declared").alias("declared"))
    every = out.groupBy("row", "item_idx").agg(F.collect_list(F.struct("lang", "own", "whole", "part", "declared")).alias("found"))
    parts_only = F.filter("found", lambda x: x["own"].isNotNull())
    every = every.withColumn("found", F.when(F.size(parts_only) > 0, parts_only).otherwise(F.col("found")))
    out = every.select("row", "item_idx", F.size("found").alias("n"), F.explode("found").alias("x"))
    return out.select("row", F.col("item_idx").cast("int").alias("item_idx"), F.when(F.col("n") > 1, F.coalesce("x.part", F.lit(0)) + 1).otherwise(0).cast("int").alias("part"), "x.lang", F.round(F.coalesce("x.own", "x.whole"), 6).alias("confidence"), "x.declared")
