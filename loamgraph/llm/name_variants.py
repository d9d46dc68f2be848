"""Problem 2: spellings that name the same person or organisation."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.components import connected_components
from loamgraph.plans.shared import materialize

#: A given name in use: this share of the distinct names of persons, and at least so many, begin with it, so that there are
#: at most 1 / GIVEN_SHARE of them.
GIVEN_SHARE, GIVEN_LEAST = 0.002, 3
#: Least Jaro-Winkler similarity of two spellings of a token that are one slip apart, as written and by sound.
SIMILAR, SIMILAR_SOUND = 0.85, 0.9

# Short forms of given names.
NICKNAMES = {
    "alexander": "alex al sandy sasha lex xander", "barbara": "babs barb barbie", "catherine": "cathy kate kathy katie cat kitty", "charles": "chuck charlie chas", "christopher": "chris kit topher",
    "daniel": "dan danny", "deborah": "deb debbie", "dmitri": "dima mitya", "dorothy": "dot dolly dottie", "edward": "ed eddie ted ned", "elena": "lena lenka", "elizabeth": "liz beth betty lizzie eliza bess libby",
    "esther": "essie hetty", "francisco": "paco pancho frank cisco", "frederick": "fred freddy", "gabriel": "gabe", "henry": "harry hank hal", "isabella": "bella izzy isa belle", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "johannes": "hannes hans jo", "john": "jack johnny", "joseph": "joe joey", "juliane": "jule", "juliana": "juli", "kenneth": "ken kenny", "leonard": "leo len lenny", "margaret": "maggie peg peggy meg", "michael": "mike mick mickey", "nicholas": "nick nicky klaus",
    "oliver": "ollie olly", "patricia": "pat patty trish tricia", "quentin": "quent", "richard": "dick rick rich richie", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve stevie", "susan": "sue susie", "theodore": "ted theo teddy", "thomas": "tom tommy",
    "ulrich": "uli ulli", "victoria": "vicky tori vic", "viktor": "vitya", "william": "will bill billy willy", "wanda": "wandi",
}
# Words of organisations and how they are shortened.
ORGANISATION = {
    "foundation": "fdn fnd found", "press": "pr", "university": "univ uni", "laboratory": "lab labs laboratories", "institute": "inst institut", "society": "soc", "research": "res", "centre": "ctr center cent", "instruments": "instr", "company": "co comp cie",
    "association": "assn assoc", "department": "dept", "academy": "acad", "college": "coll", "corporation": "corp", "museum": "mus", "library": "libr", "council": "cncl", "committee": "cttee", "group": "grp", "brothers": "bros", "international": "intl", "national": "natl", "technology": "tech",
}
# Legal forms written without a space before or after the name.
_GLUED_FORMS = re.compile("^(?:株式会社|有限会社|合同会社|주식회사)|(?:株式会社|有限会社|合同会社|주식회사|股份有限公司|有限公司|公司)$")
SUFFIXES = frozenset("gmbh ag sa ltd inc ev llc plc limited incorporated kg bv nv spa srl co".split()) - {"co"}
_CLEAR_FORMS = SUFFIXES - {"sa", "ag", "ev", "nv", "bv", "kg", "spa", "inc"} | {"inc"}
CONNECTORS = frozenset("the of for and in at on de der des du la le von & und et y".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame doctor phd md herr frau mme".split())
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
_DIGITS = str.maketrans("0134568", "oieasbb")
_FORMAL = {short: tuple(sorted(f for f, all_ in NICKNAMES.items() if short in all_.split())) for shorts in NICKNAMES.values() for short in shorts.split()}
_WORDS = {short: word for word, shorts in ORGANISATION.items() for short in (word, *shorts.split())}
#: Scripts written without spaces between words: Thai, Lao, Khmer, Kana, Han, Hangul.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_GLUED = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")


def fold(token: str) -> str:
    """Lower case without accents; digits among letters become the letters they look like."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", token.lower().translate(_LETTERS)) if not unicodedata.combining(c))
    if any(c.isalpha() for c in plain):
        plain = plain.translate(_DIGITS)
    return "".join(c for c in plain if c.isalnum())


@functools.lru_cache(200_000)
def phonetic(token: str) -> str:
    """The token spelled by sound: spellings that sound alike are equal."""
    s = token
    for old, new in (("oo", "u"), ("ou", "u"), ("ue", "u"), ("ae", "a"), ("oe", "o"), ("ph", "f"), ("ck", "k"), ("y", "i"), ("c", "k"), ("q", "k"), ("z", "s"), ("w", "v"), ("x", "ks")):
        s = s.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", s)


def codes(token: str) -> set[str]:
    """The phonetic code, the plain letters, and what one letter less leaves of each; two tokens one slip apart share one."""
    both = {phonetic(token), token}
    return both | {code[:i] + code[i + 1 :] for code in both if len(code) >= 4 for i in range(len(code))}


def edits(a: str, b: str, most: int = 1) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, as far as ``most``; beyond, most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        next_ = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, next_[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            next_.append(cost)
        before, row = row, next_
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                matched.append(x)
                break
    if not matched:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (y for j, y in enumerate(b) if taken[j]), strict=True)) / 2
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


@functools.lru_cache(200_000)
def alike(a: str, b: str) -> bool:
    """Two spellings of one token: equal by sound, or of five letters and more with one slip and close by Jaro-Winkler."""
    if a == b or phonetic(a) == phonetic(b):
        return True
    if min(len(a), len(b)) < 5 or not (a.isalpha() and b.isalpha()):
        return False
    least = SIMILAR if edits(a, b) <= 1 else SIMILAR_SOUND if edits(phonetic(a), phonetic(b)) <= 1 else 2.0
    return jaro_winkler(a, b) >= least


def _by_code(names: Iterable[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for name in names:
        for code in codes(name):
            found.setdefault(code, []).append(name)
    return found


class Names:
    """Reads names, knowing the given names in use."""

    def __init__(self, given: frozenset[str]):
        self.given = given | frozenset(NICKNAMES)
        self.near_given, self.near_short = _by_code(self.given), _by_code(short for short in _FORMAL if len(short) >= 4)
        self.resolve = functools.lru_cache(100_000)(self._resolve)

    def _resolve(self, token: str) -> tuple[str, ...]:
        """The given names a token may stand for."""
        if token in _FORMAL:
            return _FORMAL[token] + ((token,) if token in self.given else ())
        if token in self.given:
            return (token,)
        if len(token) < 4:
            return ()
        # names one slip away share a code, so only those are compared
        mine = codes(token)
        near = {g for c in mine for g in self.near_given.get(c, ()) if phonetic(g) == phonetic(token) or edits(g, token) <= 1}
        if near:
            return tuple(sorted(near))
        return tuple(sorted({f for c in mine for short in self.near_short.get(c, ()) if edits(short, token) <= 1 for f in _FORMAL[short]}))

    def read(self, name: str | None, kind: str | None) -> list[str]:
        """The readings of a name: ``p|surname|given names or start|middle|strength``, ``o|tokens|acronym`` or ``m|name``.

        A name with a word or legal form of organisations is one; else it is read as a person's, if it can be; else an
        entity of kind organization is read by its tokens, whatever they are, and a person of one word, or in a script
        without spaces, by that."""
        if not name or not name.strip():
            return []
        text = unicodedata.normalize("NFKC", name).replace("“", '"').replace("”", '"').strip().strip(",;").strip()
        if text.startswith('"') and text.endswith('"') and text.count('"') == 2:
            text = text[1:-1].strip()
        if _UNSPACED.search(text):
            return self._unspaced(text, kind)
        tokens, marked = self._tokens(text)
        if marked and len(tokens) >= 2:
            return ["o|" + " ".join(tokens) + "|"]
        if found := self._person(text, kind):
            # capitals that may be a legal form are read both ways
            formed = kind == "organization" and fold(text.split()[-1]) in SUFFIXES
            return [*found, "o|" + " ".join(tokens) + "|"] if formed and tokens else found
        if kind == "organization" and tokens:
            return ["o|" + " ".join(tokens) + "|"]
        if kind == "person" and len(tokens) == 1 and (word := fold(text)):
            return [f"m|{word}"]
        return []

    def _unspaced(self, text: str, kind: str | None) -> list[str]:
        """Names in scripts without spaces, whether or not someone put spaces or dots between their parts."""
        bare = "".join(fold(part) for part in re.split(r"[\W_]+", text))
        short = _GLUED_FORMS.sub("", bare)
        if kind == "organization" or short != bare:
            return [f"o|{short or bare}|"]
        return [f"m|{bare}"] if kind in (None, "person") and bare else []

    def _tokens(self, text: str) -> tuple[list[str], bool]:
        """The words of an organisation's name, and whether they or a legal form tell that it is one."""
        parts = [p for p in re.split(r"[\s,\-]+", text) if p]
        tokens, marked = [], "&" in parts
        for i, part in enumerate(parts):
            low = fold(part.replace(".", ""))
            if not low or low in CONNECTORS:
                continue
            if i and low in SUFFIXES and part.lower().strip(".") != "co":
                marked = marked or i == len(parts) - 1 and low in _CLEAR_FORMS
                continue
            word = _WORDS.get(low) or next((w for w in ORGANISATION if len(low) >= 6 and low[0] == w[0] and edits(low, w) <= 1), None)
            if word and not (low == "pr" and "." not in part):
                marked, low = True, word
            tokens.append(low)
        return tokens, marked

    def _person(self, text: str, kind: str | None) -> list[str]:
        comma = "," in text
        text = re.sub(r"\"[^\"]*\"|\([^)]*\)", " ", text)
        parts = [p for p in re.split(r"[\s,\-]+", text) if p]
        plain = [p for p in parts if fold(p) not in TITLES]
        parts = plain if len(plain) >= 2 else [p for p in parts if p in plain or p.isupper()]
        if len(parts) == 1 and (pieces := _GLUED.split(parts[0])) and len(pieces) == 2:
            parts = pieces
        if len(parts) == 1:
            word = fold(parts[0])
            if parts[0] == parts[0].lower() and len(word) >= 6:
                return [f"p|{word[1:]}|{word[0]}.||weak"]
            return []
        initials, starts, full = "", "", []
        order = []
        for part in parts:
            bare = part.replace(".", "")
            if (len(bare) == 1 and bare.isalpha()) or (2 <= len(bare) <= 3 and bare.isupper() and bare.isalpha() and not self.resolve(bare.lower())):
                initials += bare.lower()
                order.append("i")
            elif part.endswith(".") and 2 <= len(fold(bare)) <= 4:
                starts = fold(bare)
                order.append("s")
            else:
                full.append(fold(part))
                order.append("f")
        full = [t for t in full if t]
        if len(full) >= 2:
            known = [t for t in full if t in self.given or t in _FORMAL] or [t for t in full if self.resolve(t)]
            first = (full[-1] if comma and len(full) == 2 else full[0]) if not known or len(known) == len(full) else known[0]
            if kind not in (None, "person") and not any(t in _FORMAL or self.given.intersection(self.resolve(t)) and edits(t, self.resolve(t)[0]) <= 1 for t in full):
                return []
            rest = [t for t in full if t is not first]
            resolved = self.resolve(first) or (first,)
            return [f"p|{rest[-1]}|{'/'.join(resolved)}|{initials[:1]}|{'full' if len(resolved) == 1 else 'weak'}"]
        if len(full) == 1 and starts:
            return [f"p|{full[0]}|{starts}.|{initials[:1]}|weak"]
        if len(full) == 1 and initials:
            # capitals beside one word are initials of a person, or of the other words of an organisation
            person = f"p|{full[0]}|{initials[0]}.|{initials[1:2]}|weak"
            whole = next((p for p in parts if p.isupper() and p.isalpha() and len(p) >= 2), None)
            acronym = [f"o|{full[0]}|{whole.lower()}"] if whole and kind != "person" else []
            return acronym if kind == "organization" and acronym else [person, *acronym]
        return []


@functools.lru_cache(100_000)
def _sound(token: str) -> str:
    return phonetic(token)


def blocks(reading: str) -> list[tuple[str, bool]]:
    """(key, looks): readings can only be the same if they share a key under which one of them looks.

    Keys are the phonetic codes of the sorted tokens, with what one letter less leaves of one of them. A person has
    the surname's codes with each given name it may be (full readings look) and with the given name's letter (hints
    look, so full readings of one letter do not meet each other there). An organisation has all its tokens (whole names
    look) and each token with the first letters of the others (acronyms look)."""
    kind, tokens, *rest = reading.split("|")
    if kind == "m":
        return [(f"m {c}", True) for c in codes(tokens)]
    if kind == "p":
        full = rest[2] == "full"
        keys = [(f"g {c} {rest[0]}", True) for c in codes(tokens)] if full else []
        return keys + [(f"l {c} {letter}", not full) for letter in sorted({g[0] for g in rest[0].split("/") if g}) for c in codes(tokens)]
    words = tokens.split()
    if rest[0]:
        return [(f"a {c} {''.join(sorted(rest[0]))}", True) for c in codes(words[0])]
    keys = []
    for w in {w for w in words if w not in ORGANISATION} or {min(words)}:
        others = sorted(words)
        others.remove(w)
        sounds = " ".join(sorted(map(_sound, others)))
        keys += [(f"o {c} {sounds}", True) for c in codes(w)] + [(f"a {c} {''.join(sorted(t[0] for t in others))}", False) for c in codes(w)]
    return keys


def relation(a: str, b: str) -> int:
    """0: not the same; 1: the same; 2: may be the same, as one of them is only hinted at; 3: both are hinted at alike."""
    if a[0] != b[0]:
        return 0
    if a[0] == "m":
        return int(alike(a[2:], b[2:]))
    if a[0] == "p":
        _, last_a, given_a, middle_a, how_a = a.split("|")
        _, last_b, given_b, middle_b, how_b = b.split("|")
        if not alike(last_a, last_b) or (middle_a and middle_b and middle_a != middle_b):
            return 0
        if how_a == how_b == "full":
            return int(given_a == given_b)
        starts = [g[:-1] if g.endswith(".") else g for g in given_a.split("/")], [g[:-1] if g.endswith(".") else g for g in given_b.split("/")]
        open_a, open_b = given_a.endswith("."), given_b.endswith(".")
        fits = any((x.startswith(y) if open_b else False) or (y.startswith(x) if open_a else False) or x == y for x in starts[0] for y in starts[1])
        if not fits:
            return 0
        return 3 if how_a == how_b == "weak" else 2
    _, tokens_a, short_a = a.split("|")
    _, tokens_b, short_b = b.split("|")
    x, y = tokens_a.split(), tokens_b.split()
    if short_a and short_b:
        return 3 if short_a == short_b and alike(x[0], y[0]) else 0
    if short_a or short_b:
        base, short, whole = (x[0], short_a, y) if short_a else (y[0], short_b, x)
        for i, token in enumerate(whole):
            others = whole[:i] + whole[i + 1 :]
            if token not in ORGANISATION and alike(base, token) and sorted(t[0] for t in others) == sorted(short):
                return 2
        return 0
    if len(x) != len(y):
        return 0
    only_x, only_y = list(x), list(y)
    for t in x:
        if t in only_y:
            only_x.remove(t)
            only_y.remove(t)
    if not only_x:
        return 1
    return int(len(only_x) == 1 and only_x[0] not in ORGANISATION and only_y[0] not in ORGANISATION and alike(only_x[0], only_y[0]))


def given_names(entities: DataFrame) -> frozenset[str]:
    """The given names in use, from the names of persons: words that often come first and seldom last.

    Names with a comma are turned round before. Since a name begins with one word, there are at most 1 / GIVEN_SHARE."""
    tidy = F.lower(F.trim(F.regexp_replace("name", r"[\s\p{Zs}]+", " ")))
    persons = entities.where((F.col("kind") == "person") & F.col("name").isNotNull()).select(F.regexp_replace(tidy, "^([^,]+), ?(.+)$", "$2 $1").alias("name")).distinct()
    ends = persons.select(F.regexp_extract("name", r"^(\p{L}{3,}) ", 1).alias("first"), F.regexp_extract("name", r" (\p{L}{3,})$", 1).alias("last"))
    total = ends.count()
    words = ends.select(F.explode(F.array(F.struct(F.col("first").alias("w"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.col("last").alias("w"), F.lit(0).alias("f"), F.lit(1).alias("l")))).alias("x")).select("x.*")
    counted = words.where("w <> ''").groupBy("w").agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    often = counted.where((F.col("f") >= max(GIVEN_LEAST, GIVEN_SHARE * total)) & (F.col("f") > 2 * F.col("l")))
    return frozenset(fold(w) for w, *_ in often.collect() if w not in TITLES and w not in _FORMAL)


def read_names(entities: DataFrame, given: frozenset[str]) -> DataFrame:
    """(id, reading) of every entity whose name can be read as a person's or an organisation's."""
    sent = entities.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(sent.value)
        for batch in batches:
            rows = [(i, r) for i, n, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for r in names.read(n, k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(2)], names=["id", "reading"])

    return entities.where("id IS NOT NULL AND name IS NOT NULL").select("id", "name", "kind").mapInArrow(run, "id string, reading string")


def _keys(readings: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, *block) for r in batch.column(0).to_pylist() for block in set(blocks(r))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["reading", "key", "looks"])

    return readings.mapInArrow(run, "reading string, key string, looks boolean").select("reading", F.xxhash64("key").alias("key"), "looks")


def _related(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, y, r) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (r := relation(x, y))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["a", "b", "relation"])

    return pairs.mapInArrow(run, "a string, b string, relation int")


def candidate_pairs(readings: DataFrame) -> DataFrame:
    """(a, b) with a < b: readings that share a block, among them all that ``relation`` finds the same.

    A block holds distinct readings only, so a name that a third of all entities bear is one row in it; no block is cut
    or dropped.
    """
    keyed = materialize(_keys(readings), "blocked")
    left, right = keyed.where("looks").select(F.col("reading").alias("a"), "key"), keyed.select(F.col("reading").alias("b"), "key", "looks")
    joined = left.join(right, "key").where("a < b OR (a > b AND NOT looks)")
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(entities: DataFrame) -> DataFrame:
    """(id, component): entities that name the same person or organisation, for those that have another of their kind.

    Names are read as persons (surname, given name through the nickname table, initials, titles dropped, any order) or
    organisations (words with abbreviations written out, legal forms dropped). Equal readings are one from the start.
    Readings that share a block are compared by Jaro-Winkler and the table. Full readings that agree are linked and
    their connected components taken; a reading that only hints at a given name (initial, start, a short form of two
    names) or gives an acronym joins the one component it fits, and none where it fits several, since relatives share
    surnames and letters. Those that fit no full reading are linked among themselves where they agree. Persons of one
    word, and of scripts without spaces, are compared as they are.

    Null and empty names, and names of other things, are left alone; a repeated id is one entity. Hints in ``merges``
    and ``flags`` are not used, as some are wrong.
    """
    given = given_names(entities)
    read = materialize(read_names(entities, given).distinct(), "readings")
    readings = read.select("reading").distinct()
    found = materialize(_related(candidate_pairs(readings)), "related")
    weak = lambda c: F.col(c).endswith("|weak") | (F.col(c).startswith("o|") & ~F.col(c).endswith("|"))
    strong = found.where("relation = 1").select("a", "b")
    clusters = materialize(connected_components(strong), "clusters")
    hints = found.where("relation = 2").select(F.when(weak("a"), F.col("a")).otherwise(F.col("b")).alias("hint"), F.when(weak("a"), F.col("b")).otherwise(F.col("a")).alias("whole"))
    placed = hints.join(clusters, hints["whole"] == clusters["node"], "left").select("hint", "whole", F.coalesce("component", "whole").alias("component"))
    # of several, the one that spells the surname alike and has the same middle letter goes before
    part = lambda c, n: F.split_part(F.col(c), F.lit("|"), F.lit(n))
    middle = (part("hint", 4) != "") & (part("hint", 4) == part("whole", 4))
    score = F.when(F.col("hint").startswith("p|"), F.when(middle, 2).otherwise(0) + F.when(part("hint", 2) == part("whole", 2), 1).otherwise(0)).otherwise(0)
    ranked = placed.groupBy("hint", "component").agg(F.max(score).alias("score"), F.min("whole").alias("whole"))
    best = ranked.groupBy("hint").agg(F.max("score").alias("best"))
    chosen = ranked.join(best, "hint").where("score = best").groupBy("hint").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("whole"))
    joined = chosen.where("n = 1").select(F.col("hint").alias("a"), F.col("whole").alias("b"))
    fitted = chosen.select("hint")
    loose = found.where("relation = 3").select("a", "b").join(fitted, F.col("a") == fitted["hint"], "left_anti").join(fitted, F.col("b") == fitted["hint"], "left_anti")
    # an entity that may be a person or an organisation is the organisation whose acronym it has, if there is one
    fits = joined.where(F.col("a").startswith("o|")).select(F.col("a").alias("reading"), F.lit(True).alias("_fits")).distinct()
    marked = read.join(fits, "reading", "left").withColumn("_o", F.col("reading").startswith("o|"))
    either = marked.groupBy("id").agg(F.max(F.coalesce("_fits", F.lit(False))).alias("_organisation"), F.countDistinct("_o").alias("_ways"))
    one = marked.join(either, "id").where((F.col("_ways") == 1) | (F.col("_o") == F.col("_organisation")))
    same = one.select(F.concat(F.lit("="), "id").alias("a"), F.col("reading").alias("b"))
    # a component is a star here, so that its chains need not be walked again
    every = clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(joined).unionByName(loose).unionByName(same)
    parts = connected_components(every)
    ours = parts.where(F.col("node").startswith("=")).select(F.substring("node", 2, 1 << 30).alias("id"), "component")
    return ours.join(ours.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component"), "component").select("id", "component")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(entity_a, entity_b) with entity_a < entity_b: all pairs of entities that name the same."""
    members = materialize(variants(entities), "variants")
    left, right = members.withColumnRenamed("id", "entity_a"), members.withColumnRenamed("id", "entity_b")
    return left.join(right, "component").where("entity_a < entity_b").select("entity_a", "entity_b")
