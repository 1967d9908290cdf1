"""Free-entered values mapped to a reference list: BK-trees under an edit metric.

The forms of the reference entries stand in BK-trees; the triangle inequality prunes the search, which returns every form
within the threshold. A list of at most SHARD forms is one tree, sent to the workers; a longer list is cut into shards,
every value is searched in each of them and the winners are merged by the rank they have in one tree. Values are searched once each,
however often they occur.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

SHARD = 50_000
NONE = "nuovo"


def levenshtein(a: str, b: str) -> int:
    """Edit distance (a metric), bit-parallel over the characters of a."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    peq: dict[str, int] = {}
    for i, ch in enumerate(b):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    mask, last = (1 << len(b)) - 1, 1 << (len(b) - 1)
    pv, mv, score = mask, 0, len(b)
    for ch in a:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) | 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return score


def slips(a: str, b: str, most: int = 2) -> int:
    """Typing slips between a and b: edits, an exchange of neighbouring letters counting as one; most + 1 if there are more."""
    d = levenshtein(a, b)
    if d <= 1 or d > 2 * most or abs(len(a) - len(b)) > most:
        return min(d, most + 1)
    before, row = [], list(range(len(b) + 1))
    for i, ch in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, other in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (ch != other))
            if i > 1 and j > 1 and ch == b[j - 2] and a[i - 2] == other:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return min(row[-1], most + 1)


class BKTree:
    """Strings under a metric; children hang at their distance from the parent."""

    def __init__(self, forms: Iterable[str], metric: Callable[[str, str], int] = levenshtein):
        self.metric = metric
        self.nodes: list[tuple[str, dict[int, int]]] = []
        for form in sorted(set(forms)):
            self.add(form)

    def add(self, form: str) -> None:
        if not self.nodes:
            self.nodes.append((form, {}))
            return
        at = 0
        while (d := self.metric(self.nodes[at][0], form)) != 0:
            children = self.nodes[at][1]
            if d not in children:
                children[d] = len(self.nodes)
                self.nodes.append((form, {}))
                return
            at = children[d]

    def within(self, value: str, radius: int) -> list[tuple[int, str]]:
        """Every form at most `radius` from the value, as (distance, form)."""
        out, todo = [], [0] if self.nodes else []
        while todo:
            form, children = self.nodes[todo.pop()]
            d = self.metric(form, value)
            if d <= radius:
                out.append((d, form))
            todo += [k for e, k in children.items() if d - radius <= e <= d + radius]
        return sorted(out)


def fold(text: str | None) -> str:
    """Lower case without accents."""
    flat = unicodedata.normalize("NFKD", (text or "").casefold())
    return "".join(c for c in flat if not unicodedata.combining(c))


def allowed(form: str) -> int:
    """Slips that still leave a form recognisable."""
    return 0 if len(form) < 3 else 1 if len(form) < 7 else 2


# ---- phrases -----------------------------------------------------------------------------------------------------------

#: Words around a requirement that do not change what is asked for.
PHRASE_FRAMES = frozenset(
    "good basic solid strong deep sound excellent advanced proven practical some first initial very great knowledge "
    "experience experiences skills-in expertise proficiency of with in plus the a an handling-of explaining using".split()
)
_EXTRA = re.compile(r"[(\[](?:plus|advanced|basic|good|preferred|desired|a plus|nice to have|optional|required|must|[a-z]\d)[)\]]")
_GLUE = re.compile(r"[^\w+#]|_")


def glue(words: Iterable[str]) -> str:
    return "".join(_GLUE.sub("", w) for w in words)


def phrase_forms(core: str) -> set[str]:
    """Spellings of a reference phrase as they occur: as it stands and with its words rotated, without blanks."""
    words = fold(core).split()
    return {glue(words[i:] + words[:i]) for i in range(len(words))} - {""}


_FRAME_TREE = BKTree(w for w in PHRASE_FRAMES if len(w) > 3)


class PhraseMatcher:
    """Reference phrases by form; find() gives (distance, entry) of the closest one, or None."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.owner: dict[str, tuple[int, int, str]] = {}
        for core, n in entries:
            plain = glue(fold(core).split())
            for form in phrase_forms(core):
                # The own spelling goes before a rotation, then the commoner entry, then the alphabet.
                rank = (0 if form == plain else 1, -(n or 0), core)
                if form not in self.owner or rank < self.owner[form]:
                    self.owner[form] = rank
        self.tree = BKTree(self.owner)

    @staticmethod
    def probes(value: str | None) -> list[str]:
        """The value without marks, then without the words around it."""
        text = _EXTRA.sub(" ", fold(value).replace("_", " "))
        words = [w for w in re.split(r"[\s\-–]+", text) if glue([w])]
        bare, rough = list(words), list(words)
        while len(bare) > 1 and bare[0].strip(".,:;!*") in PHRASE_FRAMES:
            bare = bare[1:]
        while len(rough) > 1 and (len(rough[0]) > 3 and _FRAME_TREE.within(rough[0], 2) or rough[0] in PHRASE_FRAMES):
            rough = rough[1:]
        whole = glue(words)
        cut = [whole[len(w) :] for w in PHRASE_FRAMES if len(w) > 3 and whole.startswith(w) and len(whole) > len(w) + 4]
        plain = glue(re.sub(r"[(\[][^)\]]*[)\]]", " ", text).split())  # without any bracket
        return list(dict.fromkeys(p for p in (whole, glue(bare), glue(rough), plain, *sorted(cut)) if p))

    def ranked(self, value: str | None) -> tuple[list[int], str] | None:
        """The winner with its rank (stage, distance, order within it, ...): shards of one list merge by it as one tree would."""
        best = None
        probes = self.probes(value)
        for at, p in enumerate(probes):
            if p in self.owner:
                own, n, core = self.owner[p]
                return [0, 0, at, own, n], core
        for stage, radius in enumerate((2, 4), 1):
            for p in probes:
                for d, form in self.tree.within(p, radius):
                    if (d := slips(form, p) if d > 1 else d) <= min(allowed(form), allowed(p) + 1):
                        own, n, core = self.owner[form]
                        key = ([stage, d, 0, own, n], core)
                        best = key if best is None or key < best else best
            if best is not None:
                break
        return best

    def find(self, value: str | None) -> tuple[int, str] | None:
        best = self.ranked(value)
        return None if best is None else (best[0][1], best[1])


# ---- titles ------------------------------------------------------------------------------------------------------------

#: Short forms of words in titles.
TITLE_SHORT = {
    "dev": "developer", "devs": "developer", "eng": "engineer", "engs": "engineer", "spec": "specialist", "specs": "specialist",
    "coord": "coordinator", "coords": "coordinator", "cons": "consultant", "mgr": "manager", "mgrs": "manager", "mngr": "manager",
    "admin": "administrator", "admins": "administrator", "arch": "architect", "archs": "architect",
    "db": "database", "qa": "quality assurance", "ml": "machine learning", "ops": "operations", "bizdev": "business development",
}
TITLE_FILL = frozenset("for of the in and & senior sr junior jr lead principal trainee mid level ii iii iv i staff head chief".split())


class TitleMatcher:
    """Reference titles as (specialty, role); find() gives (distance, key) of the closest one, or None."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.key: dict[tuple[str, str], str] = {}
        for key, role in entries:
            words = fold(key).split()
            role = fold(role) or words[-1]
            specialty = [w for w in words if w != role]
            self.key[glue(specialty), glue([role])] = key
        self.specialty = BKTree({s for s, _ in self.key})
        self.roles = {r for _, r in self.key}
        self.role = BKTree(self.roles | {r + "s" for r in self.roles})
        # A specialty and its role written as one word, in one and in many.
        self.joined: dict[str, tuple[int, str]] = {}
        for (s, r), key in sorted(self.key.items(), key=lambda x: (-len(x[0][0]), x[1]), reverse=True):
            self.joined[s + r] = self.joined[s + r + "s"] = (-len(s), key)
        self.whole = BKTree(self.joined)
        self.seen: dict[tuple[str, str], list[tuple[int, str]]] = {}

    def _near(self, kind: str, text: str) -> list[tuple[int, str]]:
        if (kind, text) not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            tree = {"s": self.specialty, "r": self.role, "w": self.whole}[kind]
            near = [(slips(form, text) if d > 1 else d, form) for d, form in tree.within(text, 4)]
            self.seen[kind, text] = [(d, f) for d, f in near if d <= (1 if len(f) < 7 and kind != "w" else 2)]
        return self.seen[kind, text]

    @staticmethod
    def tokens(title: str | None) -> list[str]:
        words = re.findall(r"[^\W_]+", fold(title))
        out: list[str] = []
        for i, w in enumerate(words):
            if w == "biz" or (w == "bus" and words[i + 1 : i + 2] == ["dev"]):
                out.append("business")
            elif w in ("dev", "devel") and out[-1:] == ["business"]:
                out.append("development")
            else:
                out += TITLE_SHORT.get(w, w).split()
        return out

    def ranked(self, title: str | None) -> tuple[list[int], str] | None:
        """The winner with its rank (stage, distance, words between, ...): shards of one list merge by it as one tree would."""
        words = self.tokens(title)
        roles = []
        for i, w in enumerate(words):
            roles += [(i, d, f if f in self.roles else f[:-1]) for d, f in self._near("r", w)]
        best = None
        for size in (1, 2, 3):
            for i in range(len(words) - size + 1):
                text = "".join(words[i : i + size])
                if len(text) < 4:
                    continue
                for d, s in self._near("s", text):
                    for at, e, r in roles:
                        gap = words[i + size : at] if at >= i + size else words[at + 1 : i] if at < i else None
                        if gap is None or any(w not in TITLE_FILL for w in gap) or (s, r) not in self.key:
                            continue
                        found = ([0, d + e, len(gap), -len(s)], self.key[s, r])
                        best = found if best is None or found < best else best
        if best is None:
            for w in words:
                for d, form in self._near("w", w):
                    long, key = self.joined[form]
                    found = ([1, d, 0, long], key)
                    best = found if best is None or found < best else best
        return best

    def find(self, title: str | None) -> tuple[int, str] | None:
        best = self.ranked(title)
        return None if best is None else (best[0][1], best[1])


# ---- the operator ------------------------------------------------------------------------------------------------------


def match_reference(values: DataFrame, value: str, reference: DataFrame, columns: list[str], matcher: type, shard: int | None = None) -> DataFrame:
    """Every distinct value with its closest reference entry.

    values[value] is matched with the rows of reference[columns] (the first column is the entry) by `matcher`. Result:
    value, canon STRING (NONE where nothing is close), distance INT (NULL for NONE). NULL and blank values give NONE;
    repeated values give one row; `shard` is the greatest number of entries in one tree; ties go to the commoner or alphabetically first entry; an empty reference gives NONE.
    """
    spark = values.sparkSession
    distinct = spread(values.select(F.col(f"`{value}`").cast("string").alias("value")).distinct())
    entries = reference.select(*columns).distinct()
    shards = max(1, -(-entries.count() // (shard or SHARD)))
    out = None
    for b in range(shards):
        part = entries if shards == 1 else entries.filter(F.pmod(F.xxhash64(columns[0]), F.lit(shards)) == b)
        sent = spark.sparkContext.broadcast(matcher(sorted(tuple(r) for r in part.collect())))  # at most about SHARD entries

        def search(batches, sent=sent):
            for pdf in batches:
                hits = [sent.value.ranked(v) for v in pdf["value"]]
                yield pd.DataFrame({"value": pdf["value"], "canon": [h[1] if h else None for h in hits], "rank": [h[0] if h else None for h in hits]})

        found = distinct.mapInPandas(search, "value STRING, canon STRING, rank ARRAY<BIGINT>")
        out = found if out is None else out.unionByName(found)
    if shards > 1:
        out = out.groupBy("value").agg(F.min(F.when(F.col("canon").isNotNull(), F.struct("rank", "canon"))).alias("w")).select("value", "w.canon", "w.rank")
    out = out.select("value", "canon", F.col("rank")[1].cast("int").alias("distance"))
    return out.select("value", F.coalesce("canon", F.lit(NONE)).alias("canon"), "distance")
