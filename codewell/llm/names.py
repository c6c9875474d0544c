"""Linking variant spellings of names by noisy-channel attribution.

Every distinct spelling is ranked as a candidate canonical form by how much of the name it spells out and how often it
occurs. A variant is explained by a better ranked spelling through a channel of typing errors, sound-alike letters, dropped
accents, abbreviations, initials, nicknames, dropped middle names and reordered parts; the frequency of the canonical form
is the prior. Each variant is attached to the form of maximum posterior, unless standing alone is more likely. Where a fuller
form is too rare to be the source of a spelling, it is judged as that spelling's variant; the attachment still goes to the
fuller form, and to one only, as an initial would merge different people. Attachments form a forest, whose roots are the entities.

Candidates come from an equi-join on keys of two parts, the same for rare and frequent tokens. The first part is a token's
sound-alike skeleton, the token, or one of their single deletions, so that one insertion, deletion, substitution or transposition
still meets, and for long tokens the skeleton's first letters. The second part is another token of the name: its skeleton or those of its full forms, or, where one of the two
spellings abbreviates it, its first letter. Fully spelled names meet only where both parts agree, so a block holds the
spellings of few people however frequent a surname is; blocks counted to be large are joined in parts. The name without case
and accents is a key, too.

Defined results: NULL, empty and blank names are no names; blanks around are removed; repeated rows only raise the count;
ties of the posterior go to the better ranked form, ties of rank to the smaller string; names without any letter or of any
length link only to themselves; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewell.llm.plain import without_marks
from codewell.runtime import cut, keep, parallelism

#: Rows of a block that are joined at once.
BLOCK = 2000
#: log-odds below which a spelling stands alone.
ALONE = -9.0

# Words that say what kind of group it is, in one form.
KINDS = {
    "quartet": "quartet", "4tet": "quartet", "cuarteto": "quartet", "qrt": "quartet", "quart": "quartet", "orquesta": "orchestra",
    "orch": "orchestra", "orq": "orchestra", "orchestra": "orchestra", "coro": "choir", "choir": "choir", "brothers": "brothers",
    "bros": "brothers", "hermanos": "brothers", "hnos": "brothers", "trio": "trio", "sextet": "sextet",
}
# Words without weight in a name.
IDLE = {"the", "los", "las", "la", "el", "de", "del", "of", "and", "&", "+", "band", "banda"}
# Common nicknames of English and Spanish given names, accents removed.
NICKNAMES = {
    "alejandro": "alex jandro ale", "alexandra": "alex sandra lexi lexa", "andres": "andy", "anthony": "tony ant", "charles": "charlie chuck chas",
    "dolores": "lola loli", "eduardo": "lalo edu", "edward": "ed eddie ned ted teddy", "elizabeth": "beth liz betty lizzie eliza bess libby",
    "enrique": "quique kike", "fernando": "nando fer", "francisco": "paco pancho curro kiko fran", "gabriel": "gabe gabi",
    "guadalupe": "lupe lupita", "gustav": "gus", "henry": "harry hank hal", "hortensia": "tencha", "ignacio": "nacho", "james": "jim jimmy jamie",
    "john": "jack johnny jon", "jose": "pepe", "joseph": "joe joey jo", "katherine": "kate kathy katie kit kitty", "leonor": "nora leo",
    "luis": "lucho", "manuel": "manolo manny lolo manu", "margaret": "meg peggy maggie greta madge", "matilde": "mati", "mercedes": "merche meche",
    "michael": "mike mick mickey mikey", "octavio": "tavo", "patricia": "pat patty trish paty", "richard": "dick rick ricky rich richie",
    "robert": "bob bobby rob robbie bert", "roberto": "beto tito rober", "rosario": "charo", "susannah": "sue susie suzy susan",
    "teresa": "tere tess terry", "theodore": "ted teddy theo", "tomas": "tommy tom", "valeria": "vale", "victoria": "vicky vicki tori",
    "william": "bill billy will willy liam", "yolanda": "yoli", "ximena": "xime", "zacarias": "zac", "alfonso": "poncho", "jesus": "chuy chucho",
}
_FULL: dict[str, set[str]] = {}
for _full, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        _FULL.setdefault(_n, set()).add(_full)

# Further common given names of several languages, accents removed.
GIVEN = frozenset(NICKNAMES) | frozenset(_FULL) | frozenset(
    """adrian agnes alberto alice alicia ana angela anna anselm antonio beatriz bjorn bruno carlos carmen carolina catherine cecilia celeste chloe clara
    claudia cristina damian daniel david diana diego efrain elena emilia emma erik esteban eva fatima felipe felix gloria hector helena hugo ignes ines ingrid
    irene isabel ivan jacinta jacob jaime javier jorge juan julia julio karl kasper laura lucia luisa lukas maria mariana marisol mario marta martin mary mateo
    nadia natalia nicolas noemi nora olga oscar otilia pablo paul pedro peter petra quentin rafael ramiro raul ricardo rosa sabina samuel sara sarah sergio silvia
    simon sofia soren thomas ulises vera vicente victor wanda xavier zoe""".split()
)
_QUOTED = re.compile(r"[\"“”«][^\"“”»]*[\"“”»]|\([^)]*\)|'[^' ]+'(?= )")
_TOKEN = re.compile(r"[&+]|\w+\.?")


@lru_cache(50_000)
def _kind(word: str, dotted: bool) -> str | None:
    """The kind of group a word names, also abbreviated with a dot or, if long, mistyped."""
    if word in KINDS:
        return KINDS[word]
    if dotted and len(word) > 2:
        return next((k for w, k in KINDS.items() if w.startswith(word)), None)
    if len(word) >= 6:
        return next((k for w, k in KINDS.items() if len(w) >= 7 and edits(word, w, 1) <= 1), None)
    return None


@lru_cache(50_000)
def _is_idle(word: str) -> bool:
    """A word without weight, also written without its vowels."""
    return word in IDLE or (len(word) > 2 and any(w != word and "".join(c for c in w if c not in "aeiou") == word for w in IDLE))


def fold(text: str) -> str:
    """Lower case without accents."""
    return without_marks(text).casefold()


_SOUNDS = [(re.compile(a), b) for a, b in (
    ("oo", "u"), ("ph", "f"), ("th", "t"), ("sh|sch", "s"), ("qu|ck|q|k", "c"), ("gh?(?=[ei])", "j"), ("x", "s"), ("y", "i"), ("z", "s"), ("w|v", "b"), (r"(.)\1+", r"\1"), ("h", ""),
)]


@lru_cache(100_000)
def skeleton(token: str) -> str:
    """The token with letters that are heard or typed alike made the same."""
    for pattern, to in _SOUNDS:
        token = pattern.sub(to, token)
    return token


@lru_cache(200_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and adjacent transpositions between two tokens; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


@lru_cache(100_000)
def parse(name: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """Kinds of group, and the other tokens in spoken order; an abbreviated token keeps its dot."""
    text = _QUOTED.sub(" ", fold(name)).replace("_", " ").replace("-", " ").replace("’", "'").replace("'", "")
    head, comma, tail = text.partition(",")
    if comma and tail.strip():
        text = f"{tail} {head}" if not tail.strip().startswith(("jr", "sr")) else head
    kinds, rest = set(), []
    for t in _TOKEN.findall(text):
        bare = t.rstrip(".")
        kind = _kind(bare, t != bare)
        if kind:
            kinds.add(kind)
        elif t == "y" and rest:  # between two names; at the start it is an initial
            continue
        elif t != bare or not _is_idle(t):
            rest.append(t if t.endswith(".") and len(bare) > 1 else bare)
    return frozenset(kinds), tuple(rest)


def _is_short(token: str) -> bool:
    return len(token) == 1 or token.endswith(".")


def completeness(name: str) -> int:
    """How much of the name is spelled out: tokens that are no initials or abbreviations, nicknames counting less."""
    kinds, rest = parse(name)
    return 4 * len(kinds) + sum(0 if _is_short(t) else 3 if t in _FULL else 4 for t in rest)


def _core_loglik(v: str, c: str) -> float | None:
    if v == c:
        return 0.0
    if v in NICKNAMES and c in NICKNAMES:
        return None
    if skeleton(v) == skeleton(c):
        return -1.5
    d = edits(v, c)
    if d == 1:
        return -3.0 if len(c) >= 6 else -4.5
    if edits(skeleton(v), skeleton(c), 1) == 1 and min(len(v), len(c)) >= 6:
        return -4.5
    return -7.0 if d == 2 and min(len(v), len(c)) >= 8 else None


def _given_loglik(v: str, c: str) -> float | None:
    """A given name or other token beside the core; either side may be the shorter form."""
    if v == c:
        return 0.0
    for a, b in ((v, c), (c, v)):
        bare = a.rstrip(".")
        if _is_short(a) and b.rstrip(".").startswith(bare):
            return -2.0
        if b in _FULL.get(bare, ()):
            return -1.0
    if _is_short(v) or _is_short(c):
        return None
    if _FULL.get(v, set()) & _FULL.get(c, set()):
        return -1.5
    if skeleton(v) == skeleton(c):
        return -1.5
    if edits(v, c, 1) == 1 and min(len(v), len(c)) >= 3:
        # two different known names are no typing error of each other
        return None if v in NICKNAMES and c in NICKNAMES else -3.0
    if edits(skeleton(v), skeleton(c), 1) == 1 and min(len(v), len(c)) >= 5:
        return -4.0
    for a, b in ((v, c), (c, v)):  # a mistyped nickname or the nickname of a mistyped name
        if any(edits(a, n, 1) <= 1 for n in NICKNAMES.get(b, "").split() if len(n) > 3):
            return -4.0
    return None


def channel(variant: str, canonical: str) -> float | None:
    """log-likelihood that the canonical name is written as the variant; None if the channel cannot do it."""
    if (folded := fold(variant)) == fold(canonical) and any(c.isalpha() for c in folded):  # only case or accents differ
        return 0.0
    kv, tv = parse(variant)
    kc, tc = parse(canonical)
    penalty = 0.0
    if kv != kc:  # an initial may stand for the word that says the kind of group
        kv, tv, kc, tc, penalty = _spell_kinds(kv, tv, kc, tc)
    if kv != kc or not tv or not tc:
        return None
    best = _align(tv, tc, bool(kc))
    if best is None:  # an abbreviation may stand for a word without weight, which the other spelling has in full
        best = max((x - 1.5 for x in (_align(_without(tv, i), tc, bool(kc)) for i in _idle_places(tv)) if x is not None), default=None)
    if best is None:
        best = max((x - 1.5 for x in (_align(tv, _without(tc, i), bool(kc)) for i in _idle_places(tc)) if x is not None), default=None)
    return None if best is None else best + penalty


def _idle_places(tokens: tuple[str, ...]) -> list[int]:
    """Places of abbreviations that may stand for a word without weight."""
    return [i for i, t in enumerate(tokens) if _is_short(t) and any(w.startswith(t.rstrip(".")) for w in IDLE)]


def _without(tokens: tuple[str, ...], place: int) -> tuple[str, ...]:
    return tokens[:place] + tokens[place + 1 :]


def _spell_kinds(kv: frozenset[str], tv: tuple[str, ...], kc: frozenset[str], tc: tuple[str, ...]) -> tuple:
    penalty = 0.0
    for swap in (False, True):
        for k in kc - kv:
            at = next((i for i, t in enumerate(tv) if _is_short(t) and any(w.startswith(t.rstrip(".")) for w, x in KINDS.items() if x == k)), None)
            if at is not None:
                kv, tv, penalty = kv | {k}, tv[:at] + tv[at + 1 :], penalty - 3.0
        kv, tv, kc, tc = kc, tc, kv, tv
    return kv, tv, kc, tc, penalty


def _cores(tokens: tuple[str, ...]) -> list[int]:
    """Places of the tokens that may be the core of a name: spelled out, and no given name if there is any other."""
    full = [i for i, t in enumerate(tokens) if not _is_short(t)]
    return [i for i in full if tokens[i] not in GIVEN] or full


def _align(tv: tuple[str, ...], tc: tuple[str, ...], group: bool) -> float | None:
    """Best choice of the two core tokens, the others being compared in order."""
    best = None
    for i in _cores(tv):
        for j in _cores(tc):
            v, c = tv[i], tc[j]
            core = _core_loglik(v, c)
            if core is None or (min(len(v), len(c)) < 5 and core < 0):
                continue
            rest = _context(tv[:i] + tv[i + 1 :], tc[:j] + tc[j + 1 :], group)
            if rest is not None and (best is None or core + rest > best):
                best = core + rest
    return best


def _context(v: tuple[str, ...], c: tuple[str, ...], group: bool) -> float | None:
    if not v or not c:  # a lone surname means nobody in particular
        return 0.0 if group and not v and not c else None
    total, k = _given_loglik(v[0], c[0]), 1
    if total is None:
        return None
    for t in v[1:]:
        found = None
        while k < len(c) and found is None:
            found = _given_loglik(t, c[k])
            total -= 1.5 * (found is None)
            k += 1
        if found is None:
            return None
        total += found
    return total - 1.5 * (len(c) - k)


@lru_cache(100_000)
def _forms(token: str) -> frozenset[str]:
    """The token and its skeleton, and both without any one letter."""
    return frozenset(w[:k] + w[k + 1 :] for w in (skeleton(token), token) for k in range(len(w)) if len(w) >= min(4, max(3, len(token)))) | {skeleton(token), token}


@lru_cache(100_000)
def _classes(token: str) -> frozenset[str]:
    """Skeletons of the token and of the full forms of a nickname, also of one that is mistyped."""
    known = token in _FULL or token in NICKNAMES or len(token) < 4
    meant = set(_FULL.get(token, ())) if known else {f for n, full in _FULL.items() if len(n) > 3 and edits(token, n, 1) <= 1 for f in full}
    return frozenset(skeleton(w) for w in (token, *meant))


def keys_of(name: str) -> dict[str, bool]:
    """Blocking keys of a spelling; True where it abbreviates the second part or the key holds it whole.

    Two spellings are candidates where a key of both is True for at least one of them.
    """
    kinds, rest = parse(name)
    out = {"=" + fold(name): True}
    letters = {w[0] for w, k in KINDS.items() if k in kinds}  # an initial may stand for the kind
    for i, t in enumerate(rest):
        if _is_short(t):
            continue
        whole, short, first = {"/" + k for k in kinds}, set(), set(letters)
        for j, o in enumerate(rest):
            if j != i:
                (short if _is_short(o) else first).add(o[0])
                if not _is_short(o):
                    whole |= {"&" + c for c in _classes(o)}
        for f in _forms(t):
            for x in first:
                out.setdefault(f"{f}|{x}", False)
            for x in short:
                out[f"{f}|{x}"] = True
            for x in whole:
                out[f + x] = True
        if len(t) >= 8:  # two errors are possible
            out |= {f"{skeleton(t)[:5]}^{x}": True for x in whole}
    return out


def link_names(names: DataFrame, name: str = "name", weight: str | None = None) -> DataFrame:
    """``(name, n, canonical, log_posterior)`` for every distinct spelling; a root is its own canonical with a NULL posterior.

    Shuffles: the spellings' counts, the blocking keys (some 60 short rows a token), the candidate pairs, and the attachments,
    all over distinct spellings, not rows.
    """
    tasks = 2 * parallelism(names.sparkSession)
    trimmed = F.regexp_replace(F.col(name), "^[ \t\r\n]+|[ \t\r\n]+$", "")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    spellings = names.select(trimmed.alias("name"), *([weight] if weight else [])).where("name <> ''").groupBy("name").agg(n.cast("long").alias("n"))
    spellings = cut(spellings.repartition(tasks, "name"))  # a stated number, so that the Python stages behind use all cores

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, w, s, n, completeness(s)) for s, n in zip(b["name"], b["n"], strict=True) for k, w in keys_of(s).items()]
            yield pd.DataFrame(rows, columns=["key", "whole", "name", "n", "full"])

    keys = keep(spellings.mapInPandas(keyed, "key string, whole boolean, name string, n long, full int"))
    # blocks of one spelling, or of fully spelled ones that only share an initial, give no pair
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.max("whole").alias("_any")).where("_m > 1 and _any")
    sizes = sizes.select("key", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_parts"))
    live = cut(keys.join(sizes, "key"))
    keys.unpersist()
    v = live.withColumn("part", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int")).alias("v")
    c = live.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("c")
    better = F.struct(F.col("c.full"), F.col("c.n"), F.col("v.name")) > F.struct(F.col("v.full"), F.col("v.n"), F.col("c.name"))
    met = (F.col("v.key") == F.col("c.key")) & (F.col("v.part") == F.col("c.part")) & (F.col("v.whole") | F.col("c.whole"))
    pairs = (
        v.join(c, met & (F.col("v.name") != F.col("c.name")) & better)
        .select(F.col("v.name").alias("name"), F.col("v.n").alias("n"), F.col("c.name").alias("c"), F.col("c.n").alias("cn"), F.col("c.full").alias("cfull"))
        .distinct()
        .repartition(tasks, "name")
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, n, other, cn, full in b[["name", "n", "c", "cn", "cfull"]].itertuples(index=False):
                ll = channel(s, other)
                if ll is None:
                    continue
                odds = post = math.log(cn / n) + ll
                if post <= ALONE and cn < n:  # the fuller, rare spelling as a variant of the frequent one
                    back = channel(other, s)
                    odds = post if back is None else math.log(n / cn) + back
                if odds > ALONE:
                    rows.append((s, other, post, odds, full, cn))
            yield pd.DataFrame(rows, columns=["name", "parent", "post", "odds", "full", "cn"], dtype=object)

    scored = pairs.mapInPandas(score, "name string, parent string, post double, odds double, full int, cn long")
    attached = scored.groupBy("name").agg(F.max(F.struct("post", "full", "cn", "parent", "odds")).alias("best")).select(
        "name", F.col("best.parent").alias("parent"), F.col("best.odds").alias("log_posterior")
    )
    forest = cut(spellings.join(attached, "name", "left"))
    return _roots(forest)


def _roots(forest: DataFrame) -> DataFrame:
    """Follow the attachments to the roots by pointer doubling; ranks rise along them, so there are no cycles."""
    links = forest.select("name", "n", "log_posterior", F.coalesce("parent", "name").alias("canonical"))
    while True:
        up = links.select(F.col("name").alias("canonical"), F.col("canonical").alias("_up"))
        links = cut(links.join(up, "canonical").select("name", "n", "log_posterior", F.col("_up").alias("canonical"), (F.col("_up") != F.col("canonical")).alias("_moved")))
        moved = links.where("_moved").limit(1).count()
        links = links.drop("_moved")
        if not moved:
            return links
