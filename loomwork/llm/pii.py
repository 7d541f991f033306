"""Problem 9: personal information in free text, found and replaced by typed placeholders.

Bootstrapped contextual extraction.

1. One pass over the texts finds mentions that could be personal data: signs of
   e-mail addresses, runs of digits by their shape, pairs of capitalised words,
   streets beside numbers and postcodes; each with the words around it.
   Some are seeds: shapes that are nothing else, names that agree with the
   e-mail address beside them, streets with a postcode.
2. Mentions make a graph of patterns (words around) and instances (shapes,
   names, streets).  Spark scores it in rounds: a pattern is worth the mean of
   its instances, an instance the mean of its patterns, seeds keep 1.
3. Instances of high score, and patterns of high confidence, are looked for in
   all texts.  Patterns find names that no seed has; shapes, names and streets
   that were learned are found wherever they stand.

Scale.  Texts are read twice and not shuffled; what is shuffled are mentions
and the graph's pre-aggregated edges.  A learned lexicon of at most ``BLOCK``
entries goes to the tasks whole.  A larger one goes block by block over all
texts; what a block's words ask of the whole lexicon is answered by joins, and
each text that has any then meets its own part of the lexicon, for which these
texts are shuffled once.  The finds are the same whatever the size of a block.

Defined results.  Null and empty texts have no finds.  A find in a text that
stands twice is one row of ``finds``.  A text repeated under another doc_id
has its finds under each.  Overlapping finds are all reported; for the
placeholders the longer one wins, of equal ones the first kind by name.  An
empty table has no finds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import materialise

BLOCK = 500_000
ROUNDS = 3
#: Least score of an instance that no seed vouches for.
ACCEPT = {"phone": 0.28, "id_number": 0.28, "given": 0.6, "family": 0.6, "street": 0.5}
#: Least number of patterns of such an instance: one alone may be a coincidence.
BREADTH = {"phone": 2, "id_number": 2, "given": 3, "family": 2, "street": 2}
#: Least score of a pattern that may find names on its own.
CONFIDENT = 0.8
#: Least score of a pattern that announces an identity number.
ANNOUNCED = 0.15
#: A telephone number has at most 15 digits and an identity number at most 18, by their standards; six are the fewest.
FEWEST, DIGITS = 6, 18
MENTIONS = "doc_id long, kind string, found_text string, start int, part int, instance string, patterns array<string>, seed int, run int, before array<string>"
FINDS = "doc_id long, kind string, found_text string, start int"

#: Shapes (digits as 9, letters as A) that are telephone or identity numbers and nothing else; fixed values.
#: So is a number of 10 to 13 digits that begins with a plus sign, as a telephone number.
PHONE_SEEDS = {"(999) 999-9999", "99.99.99.99.99"}
ID_SEEDS = {"AA999999A", "AA 99 99 99 A", "99999999A", "A99999999", "999-99-9999", "9 99 99 99 999 999 99", "99999999-9999"}
#: Between given and family name.
PARTICLES = r"(?:van|von|de|der|den|da|di|do|dos|del|della|la|le|al|bin|ben|ter|ten|zu|zum|zur)"

_A = "A-ZÀ-ÖØ-ÞŁŚŻŽČŠŐŰĐ"
WORD = r"[^\W\d_]+(?:['’-](?![sS]\b)[^\W\d_]+)*"
CAP = rf"[{_A}][^\W\d_]*(?:['’-](?!s\b)[^\W\d_]+)*"

_AT = r"(?:@|\s@\s|\s?&#0*64;\s?|\s?＠\s?|\s?[(\[{<]\s?(?:at|AT|At|@|arroba|ät)\s?[)\]}>]\s?)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|Dot|punto|punkt|point|\.)\s?[)\]}>]\s?|&#0*46;)"
_LOCAL = r"[^\W_](?:[\w.+%'-]*[\w+%-])?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(rf"(?<![\w.+%@-]){_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}|\s(?:at|AT|arroba)\s{_LABEL}(?:\s(?:dot|DOT|punto|punkt|point)\s{_LABEL})*\s(?:dot|DOT|punto|punkt|point)\s[^\W\d_]{{2,}})(?![\w@])")
_QUOTE = re.compile("'")
EMAIL_SIGN = re.compile(r"(?=[@＠&(\[{<\s])(?:@|＠|&#0*64;|[(\[{<]\s?(?:at|AT|At|arroba|ät)\s?[)\]}>]|\s(?:at|AT|arroba)\s(?=[\w-]+\s(?:dot|DOT|punto|punkt|point)\s))")

NUMBER = re.compile(r"(?=[\dA-Z+(])(?<![\w+.,/#(-])(?=[\dA-Z+(][\d ()+./\nA-Z-]{6})(?!\d{4}-\d\d-\d\d[ T\n])(?:[A-Z]{2}[ \n]\d\d[ \n]\d\d[ \n]\d\d[ \n][A-Z]|(?:\(?\+|\(|[A-Z]{1,2}(?=\d))?\d+\)?(?:(?:[ .\n/-]\(?(?!\d{4}-\d\d-\d\d[ T\n])|(?<=\)))\d+\)?)*[A-Z]?)(?![\w])")
PAIR = re.compile(rf"(?=[{_A}])(?<![\w@./-])({CAP}) ({CAP})(?![\w@_]|\.\w)")
_TOWN = rf"(?:{CAP})(?:[ -]{CAP}){{0,2}}"
_STREET = r"[^\W\d_][^\W\d_.'’/-]*(?:['’/.-][^\W\d_]+)*\.?/?(?: [^\W\d_][\w'’-]*\.?){0,4}"
POSTCODE = re.compile(r"(?=\d)(?<![\w-])\d{5}(?![\w-])")
_FLAT = r"(?:(?i:flat|apt|apartment|unit|suite)\.?\s\w+,\s)?"
_NUMBER_FIRST = re.compile(rf"(?=\w)(?<![\w.,/-]){_FLAT}(\d{{1,4}}[A-Za-z]?)(\s(?i:bis|ter))?,?\s({_STREET})(?:,\s|\n)(?:({_TOWN})\s\d{{5}}|\d{{5}}\s({_TOWN}))(?![\w-])")
_NUMBER_LAST = re.compile(rf"(?<![\w/])({CAP}\.?/?(?:\s(?:{CAP}|de|del|la|las|los|el|der|den|dem|am|im|zum|zur))*),?\s(\d{{1,4}}[a-z]?)(?:,\s|\n)\d{{5}}\s({_TOWN})(?![\w-])")
_CAPS_BESIDE = re.compile(rf"(?=\d)(?<![\w.,/-])\d{{1,4}}[A-Z]? ({CAP}(?: {CAP}){{1,3}}\.?)")
_WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def lower_same_length(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def left_of(text: str, at: int) -> list[str]:
    """Patterns of the words before a mention: the last one with its signs, and the one before."""
    before = text[max(0, at - 40) : at]
    words = list(_WORDS.finditer(before))[-2:]
    if not words:
        return ["l1:" + ("\n" if "\n" in before else before.strip()[-2:])]
    gap = before[words[-1].end() :]
    if "\n" in gap or sum(c.isdigit() for c in gap):
        return ["l1:\n"]
    out = ["l1:" + words[-1].group().lower() + gap.strip()]
    if len(words) > 1 and "\n" not in before[words[0].end() : words[1].start()]:
        out.append("l2:" + words[0].group().lower())
    return out


def announced_by(text: str, at: int) -> list[str]:
    """Left patterns of a number; where it begins a line, those of the end of the line before."""
    begin = max(0, at - 40)
    head = text[begin:at].rstrip(" \t")
    if head.endswith("\n"):
        at = begin + len(head[:-1].removesuffix("\r"))
    return informative(left_of(text, at))


def right_of(text: str, at: int) -> str:
    after = text[at : at + 24]
    word = _WORDS.search(after)
    return "r:" + re.sub(r"\s+|\d", " ", after[: word.end()] if word else after[:3]).strip().lower()


def shape_of(text: str) -> str:
    return re.sub(r"\s", " ", re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", text)))


def could_be_number(text: str) -> bool:
    """At least eight signs, six to eighteen of them digits, and no decimal fraction."""
    return len(text) >= 8 and FEWEST <= sum(map(str.isdigit, text)) <= DIGITS and not (text.count(".") == 1 and not re.search(r"[ \n()/-]", text))


def _local_starts(text: str, at: int, done: int) -> Iterator[int]:
    """Where a local part that ends before the sign can begin, the earliest first."""
    k = at - 1 if at > done and text[at - 1].isspace() else at
    low = k
    while low > done and (text[low - 1].isalnum() or text[low - 1] in "_.+%'-"):
        low -= 1
    yield low
    yield from (m.end() for m in _QUOTE.finditer(text, low, k))


def emails(text: str) -> Iterator[tuple[int, str]]:
    """E-mail addresses of any length, however their signs are written."""
    done = 0
    for sign in EMAIL_SIGN.finditer(text):
        if sign.start() < done:
            continue
        for begin in _local_starts(text, sign.start(), done):
            m = EMAIL.match(text, begin)
            if m and sign.start() < m.end():
                yield begin, m.group()
                done = m.end()
                break


def _agrees(given: str, family: str, local: str) -> bool:
    """Whether an address's local part is made of the two names."""
    g, f, parts = fold(given), fold(family), re.split(r"[._+-]|(?<=\D)\d+$", fold(local))
    squeezed = fold(local).replace(".", "").replace("_", "").replace("-", "")
    g_, f_ = g.replace("-", ""), f.replace("-", "")
    return squeezed in (g_ + f_, f_ + g_, g_[:1] + f_) or (len(parts) > 1 and f in parts and (g in parts or g[:1] in parts))


def street_key(street: str, number_first: bool) -> str:
    """What a street is known by: its last word, its first, or all of it."""
    words = street.split()
    if not number_first:
        return "full:" + " ".join(words).lower()
    if words[0][:1].islower() or (len(words) > 2 and any(w.islower() for w in words[1:-1])):
        return "first:" + words[0].lower()
    return "last:" + words[-1].lower()


def informative(patterns: list[str]) -> list[str]:
    """Without those that only say that a line begins or ends."""
    return [p for p in patterns if p not in ("l1:\n", "l1:", "r:")]


def number_runs(start: int, text: str) -> Iterator[tuple[int, str, int]]:
    """(start, text, part) of a run of digit groups: whole lines as parts 0 and 1, shorter runs of groups as part 2."""
    ends = [m.end() for m in re.finditer(r"[^\s]+", text)]
    begins = [m.start() for m in re.finditer(r"[^\s]+", text)]
    seen = set()
    lines = [(0, len(text), 0 if "\n" not in text else 3)]
    if "\n" in text:
        at = 0
        for piece in text.split("\n"):
            lines.append((at, at + len(piece), 1))
            at += len(piece) + 1
    for a, b, part in lines:
        if could_be_number(text[a:b]):
            seen.add((a, b))
            yield start + a, text[a:b], part
    digits = [sum(map(str.isdigit, text[a:b])) for a, b in zip(begins, ends, strict=True)]
    for i, a in enumerate(begins):
        n = 0
        for k in range(i, len(ends)):
            n += digits[k]
            if n > DIGITS:
                break
            if n >= FEWEST and (a, ends[k]) not in seen and could_be_number(text[a : ends[k]]):
                yield start + a, text[a : ends[k]], 2


def mentions(text: str) -> Iterator[tuple[str, str, int, int, str, list[str], int, int, list[str]]]:
    """(kind, found text, start, part, instance, patterns, seed, run, words before a number) of all that could be personal data."""
    found = list(emails(text))
    for at, address in found:
        yield "email", address, at, 0, "", [], 1, at, []
    near = {}
    for at, address in found:  # the names just before an address
        local = re.split(_AT + r"|\s(?:at|AT)\s", address)[0]
        window = max(0, at - 70)
        for m in PAIR.finditer(text, window, at):
            if _agrees(m.group(1), m.group(2), local):
                near[m.start()] = 1
    for m in PAIR.finditer(text):
        key = f"{m.group(1).lower()}|{m.group(2).lower()}"
        left, right = left_of(text, m.start())[0], right_of(text, m.end())
        both = [left + " _ " + right[2:]] if informative([left]) and informative([right]) else []
        yield "name", m.group(), m.start(), 0, key, [*both, *informative([left])], near.get(m.start(), 0), m.start(), []
    for m in NUMBER.finditer(text):
        for at, piece, part in number_runs(m.start(), m.group()):
            shape = shape_of(piece)
            # shorter runs and those over a line end stay out of the graph, but words can announce them
            yield "number", piece, at, part, shape, informative([*left_of(text, at), right_of(text, at + len(piece))]) if part < 2 else [], 0, m.start(), [] if "A" in shape else announced_by(text, at)
    taken = set()
    before = 0
    for code in POSTCODE.finditer(text):
        # an address is within the line of its postcode, the one before and the one after
        begin = text.rfind("\n", 0, max(0, text.rfind("\n", 0, code.start()))) + 1
        end = text.find("\n", code.end())
        end = len(text) if end < 0 else text.find("\n", end + 1) if text.find("\n", end + 1) > 0 else len(text)
        # and begins after the postcode before it
        begin, before = max(begin, before), code.end()
        for pattern, first in ((_NUMBER_FIRST, True), (_NUMBER_LAST, False)):
            for m in pattern.finditer(text, begin, end):
                if not m.start() <= code.start() < m.end() or m.start() in taken:
                    continue
                street, town = (m.group(3), m.group(4) or m.group(5)) if first else (m.group(1), m.group(3))
                if first and not (street[0].isupper() or " " in street):
                    continue
                taken.add(m.start())
                left = left_of(text, m.start())
                key = street_key(street, first)
                yield "street", m.group(), m.start(), 0, key, informative(left), 1, m.start(), []
                if key.startswith("first:"):
                    yield "street", m.group(), m.start(), 0, "phrase:" + " ".join(street.split()).lower(), informative(left), 1, m.start(), []
                yield "town", town, m.start(), 0, town.lower(), [], 1, m.start(), []
    for m in _CAPS_BESIDE.finditer(text):
        if m.start() not in taken:
            yield "street", m.group(), m.start(), 0, street_key(m.group(1).rstrip("."), True), informative(left_of(text, m.start())), 0, m.start(), []


def _mention_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in MENTIONS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.list_(pa.string())]
    for batch in batches:
        rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for m in mentions(text)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def find_mentions(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", "text").mapInArrow(_mention_batches, MENTIONS), "mentions")


def graph_types(found: DataFrame) -> DataFrame:
    """(kind, instance, patterns, n, seed): mentions that look alike, counted.

    Numbers stand in two graphs, as telephone and as identity numbers, names
    in two, by their given and by their family name.
    """
    flat = found.filter("kind IN ('name', 'number', 'street') AND part < 2").groupBy("kind", "instance", "patterns").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    numbers, names = flat.filter("kind = 'number'"), flat.filter("kind = 'name'").withColumn("w", F.split("instance", "\\|"))
    phone = F.col("instance").isin(sorted(PHONE_SEEDS)) | (F.col("instance").rlike(r"^\(?\+") & F.regexp_count("instance", F.lit("9")).between(10, 13))
    cols = ["kind", "instance", "patterns", "n", "seed"]
    out = flat.filter("kind = 'street'").select(cols)
    out = out.unionByName(numbers.withColumn("kind", F.lit("phone")).withColumn("seed", phone.cast("int")).select(cols))
    out = out.unionByName(numbers.withColumn("kind", F.lit("id_number")).withColumn("seed", F.col("instance").isin(sorted(ID_SEEDS)).cast("int")).select(cols))
    for i, kind in enumerate(("given", "family")):
        out = out.unionByName(names.select(F.lit(kind).alias("kind"), F.col("w")[i].alias("instance"), "patterns", "n", "seed"))
    grouped = out.groupBy("kind", "instance", "patterns").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    return materialise(grouped.withColumn("type_id", F.xxhash64("kind", "instance", "patterns")), "types")


def score_graph(types: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of instances and of patterns: (kind, instance, score, seed, breadth), (kind, pattern, p_score, n_instances)."""
    edges = types.select("kind", "instance", "n", "type_id", F.explode("patterns").alias("pattern"))
    breadth = edges.groupBy("kind", "instance").agg(F.countDistinct("pattern").alias("breadth"))
    seeds = types.groupBy("kind", "instance").agg(F.max("seed").alias("seed")).join(breadth, ["kind", "instance"], "left").fillna(0, ["breadth"])
    scores = seeds.withColumn("score", F.col("seed").cast("double"))
    patterns = None
    for _ in range(rounds):
        # what a pattern with a single instance says is only what is known of that instance
        n_instances = F.countDistinct("instance")
        mean = F.sum(F.col("n") * F.col("score")) / F.sum("n") * (n_instances - 1) / n_instances
        patterns = materialise(edges.join(scores.select("kind", "instance", "score"), ["kind", "instance"]).groupBy("kind", "pattern").agg(mean.alias("p_score"), n_instances.alias("n_instances")), "patterns")
        # a mention is as good as the best of its patterns
        best = edges.join(patterns.select("kind", "pattern", "p_score"), ["kind", "pattern"]).groupBy("kind", "instance", "type_id").agg(F.max("p_score").alias("best"), F.first("n").alias("n"))
        mean = best.groupBy("kind", "instance").agg((F.sum(F.col("best") * F.col("n")) / F.sum("n")).alias("mean"))
        scores = materialise(seeds.join(mean, ["kind", "instance"], "left").withColumn("score", F.when(F.col("seed") > 0, 1.0).otherwise(F.coalesce("mean", F.lit(0.0)))).drop("mean"), "scores")
    return scores, patterns


def accepted(scores: DataFrame) -> DataFrame:
    """Instances that count as known: seeds, and others of high score in several patterns."""
    of = lambda table: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in table.items()])
    return scores.filter((F.col("seed") > 0) | ((F.col("score") >= of(ACCEPT)) & (F.col("breadth") >= of(BREADTH)))).select("kind", "instance", "score")


def number_finds(found: DataFrame, scores: DataFrame, patterns: DataFrame) -> DataFrame:
    """Numbers of accepted shapes, of two kinds the one of higher score; of overlapping runs the longer.

    A shape of digits only that no seed vouches for is an identity number only
    where a word announces it, on its line or at the end of the line before:
    plain groups of digits stand in many a list.
    """
    best = accepted(scores.filter("kind IN ('phone', 'id_number')")).join(scores.select("kind", "instance", "seed"), ["kind", "instance"]).groupBy("instance").agg(F.max(F.struct("score", "kind", "seed")).alias("b")).select("instance", F.col("b.kind").alias("as_kind"), ((F.col("b.seed") > 0) | F.col("instance").contains("A")).cast("int").alias("sure"))
    hits = found.filter("kind = 'number'").select("doc_id", "run", "found_text", "start", "instance", "before").join(best, "instance").withColumn("end", F.col("start") + F.length("found_text"))
    hits = materialise(hits.dropDuplicates(["doc_id", "start", "end"]), "number-hits")
    plain = hits.filter((F.col("as_kind") == "phone") | (F.col("sure") > 0))
    announcing = patterns.filter((F.col("kind") == "id_number") & (F.col("p_score") >= ANNOUNCED) & F.col("pattern").startswith("l")).select("pattern")
    told = hits.filter((F.col("as_kind") == "id_number") & (F.col("sure") == 0)).withColumn("pattern", F.explode("before")).join(announcing, "pattern", "left_semi").drop("pattern").distinct()
    cols = ["doc_id", "run", "found_text", "start", "end", "as_kind"]
    hits = materialise(plain.select(cols).unionByName(told.select(cols)), "number-kept")
    o = hits.select(F.col("doc_id").alias("_d"), F.col("run").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    mine, its = F.col("end") - F.col("start"), F.col("_e") - F.col("_s")
    longer = (F.col("_d") == F.col("doc_id")) & (F.col("_r") == F.col("run")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")) & ((its > mine) | ((its == mine) & (F.col("_s") < F.col("start"))))
    return hits.join(o, longer, "left_anti").select("doc_id", F.col("as_kind").alias("kind"), "found_text", "start")


def facts_of(kind: str, value: str) -> Iterator[tuple[str, str]]:
    """(kind, key) of what a learned entry says: the forms that are searched for, and what is asked of them."""
    sort = ""
    if kind == "street":
        sort, _, value = value.partition(":")
    if kind == "context":
        yield kind, value
    elif kind == "town" or sort == "phrase":
        yield sort or kind, fold(value)
    else:
        if not sort:
            yield kind, fold(value)
        forms = {value, value.replace("straße", "strasse")} if sort == "full" else {value} if sort else {value, fold(value)}
        for form in forms:
            if len(form) > 1:
                yield f"form:street_{sort}" if sort else f"form:{kind}", form


class Lexicon:
    """What was learned, as one automaton over lower-case text.

    Of entries, or of the facts that a single text asks for; then the words
    that are put together like family names are among the facts.
    """

    def __init__(self, entries: list[tuple[str, str]], facts: list[tuple[str, str]] | None = None, phrase_words: int = 0) -> None:
        known: dict[str, set[str]] = {k: set() for k in ("given", "family", "town", "context", "phrase", "like")}
        words: dict[str, set[str]] = {}
        for kind, key in facts if facts is not None else (f for e in entries for f in facts_of(*e)):
            if kind.startswith("form:"):
                words.setdefault(key, set()).add(kind.removeprefix("form:"))
            else:
                known[kind].add(key)
        self.given, self.family, self.towns, self.contexts, self.phrases = (known[k] for k in ("given", "family", "town", "context", "phrase"))
        #: Words of the longest known phrase of a street, its signs counted as borders too.
        self.phrase_words = max([phrase_words, *[len(re.findall(r"\w+", p)) for p in self.phrases]])
        self.machine = ahocorasick.Automaton()
        for form, kinds in words.items():
            self.machine.add_word(form, (len(form), frozenset(kinds)))
        if words:
            self.machine.make_automaton()
        self.empty = not words
        self.alike = None if facts is None else known["like"]
        heads: dict[str, set[str]] = {}
        tails: dict[str, set[str]] = {}
        for word in self.family if facts is None else ():
            for k in range(3, len(word) - 2):
                heads.setdefault(word[:k], set()).add(word[k:])
                tails.setdefault(word[k:], set()).add(word[:k])
        #: Beginnings and ends that several family names share.
        self.heads = {h for h, x in heads.items() if len(x) >= 3}
        self.tails = {t for t, x in tails.items() if len(x) >= 3}

    def like_family(self, word: str) -> bool:
        """Whether the word is put together from parts that known family names share."""
        low = fold(word)
        if self.alike is not None:
            return low in self.alike
        return any(low[:k] in self.heads and low[k:] in self.tails for k in range(3, len(low) - 2))


_FAMILY = rf"(?:{PARTICLES}\s){{0,2}}(?P<family>{WORD})"
_AFTER_GIVEN = re.compile(rf"(?:\s[^\W\d_]\.?(?=\s))?(?:\s[^\W\d_]\.)?\s{_FAMILY}(?![\w@]|[.][\w])", re.I)
_FAMILY_BEFORE = re.compile(rf"(?:^|(?<=[^\w@./+-]))(?:{PARTICLES}\s){{0,2}}(?P<family>{WORD})(?P<comma>,?)\s$", re.I)
_COMPOUND = re.compile(rf"-{WORD}")
_INITIAL_AFTER_GIVEN = re.compile(r"\s[^\W\d_]\.(?=[^\w]|$)")
_INITIALS_BEFORE = re.compile(rf"(?:^|(?<=[^\w@./+-]))(?:[^\W\d_]\.[ -]?){{1,3}}(?<=[ .])\n?(?:{PARTICLES}\s){{0,2}}$", re.I)
_INITIALS_AFTER = re.compile(r",\s(?:[^\W\d_]\.[\s-]?)*[^\W\d_]\.(?![\w])", re.I)
_INITIALS_AND_NAME = re.compile(rf"(?=[{_A}])(?<![\w@./+-])(?:[{_A}]\.\s){{1,2}}(?:{PARTICLES}\s){{0,2}}({CAP})(?![\w@_]|\.\w)")
_GIVEN_BEFORE = re.compile(rf"(?:^|(?<=[^\w@./+-]))(?P<given>{CAP})(?:\s[{_A}]\.)?\s(?:{PARTICLES}\s){{0,2}}$")
_HOUSE_BEFORE = re.compile(rf"(?:^|(?<=[^\w.,/-])){_FLAT}\d{{1,4}}(?:[A-Za-z]|\s(?i:bis|ter|quater))?,?\s$")
_HOUSE_AND_NAME_BEFORE = re.compile(rf"(?:^|(?<=[^\w.,/-])){_FLAT}\d{{1,4}}[A-Za-z]?,?\s(?:{CAP}\s){{1,3}}$")
_REST_OF_STREET = re.compile(rf"(?:\s(?:de|du|des|la|le|les|aux|au|à|del|las|los|el))*(?: ?[dl]['’])? ?{CAP}")
_HOUSE_AFTER = re.compile(r",?\s\d{1,4}(?:\s?[a-z](?![\w]))?(?:,\s\d{1,2}\.?[ºª°](?:\s[A-Z](?![\w]))?)?")
_TAIL_CODE = re.compile(rf"(?:,\s|\n)(?:(?P<a>{CAP}(?:[ -]{CAP}){{0,2}}?)\s\d{{5}}|\d{{5}}\s(?P<b>{CAP}(?:[-]{CAP})?))(?![\w-])")
_WORD_END = re.compile(r"(?<=\w)(?=\W|$)")
_TAIL_TOWN = re.compile(rf",\s(?P<a>{CAP}(?:[ -]{CAP}){{0,2}})")


def _back(text: str, at: int, words: int, signs: int = 60) -> int:
    """A place before which nothing belongs to the ``words`` words that end at ``at``, however long they are."""
    begin = max(0, at - signs)
    while begin and len(text[begin:at].split()) <= words:
        signs *= 4
        begin = max(0, at - signs)
    return begin


def _tail(text: str, end: int, lexicon: Lexicon) -> int:
    """Where an address ends that has reached ``end``: after postcode and town, or a known town."""
    m = _TAIL_CODE.match(text, end)
    if m:
        return m.end()
    m = _TAIL_TOWN.match(text, end)
    if m:
        words = m.group("a")
        while words:
            if fold(words) in lexicon.towns:
                return m.start("a") + len(words)
            words = words.rpartition(" ")[0]
    return end


def _word_ends(text: str, end: int, words: int) -> list[int]:
    """The next places where a word ends, as many as the longest known phrase has words."""
    out: list[int] = []
    for m in _WORD_END.finditer(text, end):
        out.append(m.start())
        if len(out) > words:
            break
    return out


def _phrase(text: str, start: int, stop: int) -> str:
    return fold(" ".join(text[start:stop].split()))


def _street_end(text: str, start: int, end: int, lexicon: Lexicon) -> int | None:
    """Where a street that begins with its type ends: at the longest known phrase, else after its first name."""
    for stop in reversed(_word_ends(text, end, lexicon.phrase_words)):
        if _phrase(text, start, stop) in lexicon.phrases:
            return stop
    m = _REST_OF_STREET.match(text, end)
    return m.end() if m else None


def _bare(word: str) -> str:
    return re.sub(r"['’]s$", "", word, flags=re.I)


def _known_family(word: str, lexicon: Lexicon) -> str | None:
    """The part of the word that is a family name: all of it, or a compound of known ones."""
    word = _bare(word)
    parts = word.split("-")
    if fold(word) in lexicon.family or any(fold(p) in lexicon.family or lexicon.like_family(p) for p in parts):
        return word
    return None


def _in_context(text: str, start: int, lexicon: Lexicon) -> bool:
    return any(p in lexicon.contexts for p in left_of(text, start))


def _hits(text: str, low: str, lexicon: Lexicon) -> Iterator[tuple[int, int, str, str, frozenset[str]]]:
    """(start, end, sign before, sign after, kinds) of the lexicon's forms that stand as words."""
    n = len(text)
    for last, (size, kinds) in lexicon.machine.iter(low) if not lexicon.empty else ():
        start, end = last - size + 1, last + 1
        before, after = text[start - 1] if start else " ", text[end] if end < n else " "
        if before.isalnum() or before in "@_/+" or ((after.isalnum() or after in "_@") and low[last] != "/"):
            continue
        yield start, end, before, after, kinds


def asked(text: str, lexicon: Lexicon) -> set[tuple[str, str]]:
    """Facts of a block's forms in the text, and all that ``learned_finds`` could ask of the whole lexicon on meeting them."""
    low = lower_same_length(text)
    out: set[tuple[str, str]] = set()

    def family(word: str) -> None:
        word = _bare(word)
        out.add(("family", fold(word)))
        out.update((kind, fold(p)) for p in word.split("-") for kind in ("family", "like"))

    def context(at: int) -> None:
        out.update(("context", p) for p in left_of(text, at))

    def tail(end: int) -> None:
        m = _TAIL_TOWN.match(text, end)
        words = m.group("a") if m else ""
        while words:
            out.add(("town", fold(words)))
            words = words.rpartition(" ")[0]

    for start, end, _, _, kinds in _hits(text, low, lexicon):
        out.update((f"form:{kind}", low[start:end]) for kind in kinds)
        if "given" in kinds:
            context(start)
            for m in (_AFTER_GIVEN.match(text, end), _FAMILY_BEFORE.search(text, _back(text, start, 3), start)):
                if m:
                    family(m.group("family"))
        if "family" in kinds:
            m = _COMPOUND.match(text, end)
            if m:
                family(m.group()[1:])
            g = _GIVEN_BEFORE.search(text, _back(text, start, 4), start)
            if g:
                out.add(("given", fold(g.group("given"))))
                context(g.start())
        if "street_last" in kinds:
            tail(end)
            tail(end + 1)
        if "street_first" in kinds and _HOUSE_BEFORE.search(text, _back(text, start, 4), start):
            for stop in _word_ends(text, end, lexicon.phrase_words):
                out.add(("phrase", _phrase(text, start, stop)))
                tail(stop)
            m = _REST_OF_STREET.match(text, end)
            if m:
                tail(m.end())
        if "street_full" in kinds:
            m = _HOUSE_AFTER.match(text, end)
            if m:
                tail(m.end())
    for m in _INITIALS_AND_NAME.finditer(text):
        out.update(("like", fold(p)) for p in m.group(1).split("-"))
    return out


def learned_finds(text: str, lexicon: Lexicon) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of names and addresses that the lexicon leads to."""
    low = lower_same_length(text)
    n = len(text)
    spans: set[tuple[str, int, int]] = set()
    for start, end, before, after, kinds in _hits(text, low, lexicon):
        if "given" in kinds and before not in ".-" and after not in "-+" and not (after == "." and end + 1 < n and text[end + 1].isalnum()):
            m = _AFTER_GIVEN.match(text, end)
            family = _known_family(m.group("family"), lexicon) if m else None
            if m and not family and text[start].isupper() and re.match(rf"{CAP}$", m.group("family")) and _in_context(text, start, lexicon):
                family = m.group("family")
            if family:
                spans.add(("name", start, m.start("family") + len(family)))
            else:
                b = _FAMILY_BEFORE.search(text, _back(text, start, 3), start) if before in " \n" else None
                if b and _known_family(b.group("family"), lexicon) and (b.group("comma") or "\n" not in text[b.start() : start]):
                    i = _INITIAL_AFTER_GIVEN.match(text, end) if b.group("comma") else None
                    spans.add(("name", b.start(), i.end() if i else end))
        if "family" in kinds and before not in ".":
            whole = end
            m = _COMPOUND.match(text, end)
            if m and _known_family(m.group()[1:], lexicon):
                whole = m.end()
            if whole == n or not (text[whole] in "-@_+" or (text[whole] == "." and whole + 1 < n and text[whole + 1].isalnum())):
                b = _INITIALS_BEFORE.search(text, _back(text, start, 5), start) if before in " \n-" else None
                g = _GIVEN_BEFORE.search(text, _back(text, start, 4), start) if before in " \n" else None
                if b and (text[b.start()].isupper() or text[start].islower()):
                    spans.add(("name", b.start(), whole))
                elif g and fold(g.group("given")) not in lexicon.given and _in_context(text, g.start(), lexicon):
                    spans.add(("name", g.start(), whole))
                else:
                    a = _INITIALS_AFTER.match(text, whole)
                    if a and before not in "-":
                        spans.add(("name", start, a.end()))
        if "street_last" in kinds:
            b = _HOUSE_AND_NAME_BEFORE.search(text, _back(text, start, 6), start)
            if b:
                stop = end + 1 if after == "." and low[start:end] in _DOTTED else end
                spans.add(("address", b.start(), _tail(text, stop, lexicon)))
        if "street_first" in kinds:
            b = _HOUSE_BEFORE.search(text, _back(text, start, 4), start)
            stop = _street_end(text, start, end, lexicon) if b else None
            if stop:
                spans.add(("address", b.start(), _tail(text, stop, lexicon)))
        if "street_full" in kinds:
            m = _HOUSE_AFTER.match(text, end)
            if m:
                spans.add(("address", start, _tail(text, m.end(), lexicon)))
    for m in _INITIALS_AND_NAME.finditer(text):  # initials before a name that is put together like a known one
        if all(lexicon.like_family(p) for p in m.group(1).split("-")):
            spans.add(("name", m.start(), m.end()))
    kept = sorted(spans, key=lambda s: (s[0], s[1] - s[2], s[1]))
    done: list[tuple[str, int, int]] = []
    for kind, a, b in kept:
        if not any(k == kind and a < y and x < b for k, x, y in done):
            done.append((kind, a, b))
            yield kind, a, b


#: Abbreviations of streets that keep their own full stop; fixed values.
_DOTTED = {"st", "rd", "ave", "dr", "ln", "ct", "pl", "sq", "ter"}


def _learned_batches(entries: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            rows = []
            if not lexicon.empty:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc_id, kind, text[a:b], a) for kind, a, b in learned_finds(text or "", lexicon)] if text else []
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int32()], strict=True)], names=["doc_id", "kind", "found_text", "start"])

    return run


def learn(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores of instances, scores of patterns) after the rounds."""
    return score_graph(graph_types(found))


def lexicon(found: DataFrame, scores: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kind, value) of all that was learned."""
    known = accepted(scores.filter("kind IN ('given', 'family', 'street')")).select("kind", F.col("instance").alias("value"))
    towns = found.filter("kind = 'town'").select("kind", F.col("instance").alias("value")).distinct()
    contexts = patterns.filter((F.col("kind") == "given") & (F.col("p_score") >= CONFIDENT) & (F.col("n_instances") >= 5) & ~F.contains("pattern", F.lit(" _ "))).select(F.lit("context").alias("kind"), F.col("pattern").alias("value"))
    return materialise(known.unionByName(towns).unionByName(contexts), "lexicon")


def lexicon_blocks(entries: DataFrame, most: int = BLOCK) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """(whether it is all, entries): the lexicon where it is small, else what is searched for in it, in blocks of bounded size."""
    total = entries.count()
    if total <= most:
        yield True, [tuple(r) for r in entries.collect()]
        return
    searched = entries.filter("kind IN ('given', 'family') OR (kind = 'street' AND value NOT LIKE 'phrase:%')")
    slices = max(1, -(-2 * searched.count() // most))
    for i in range(slices):
        yield False, [tuple(r) for r in searched.filter(F.pmod(F.xxhash64("value"), F.lit(slices)) == i).collect()]


def _asked_batches(entries: list[tuple[str, str]], phrase_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Lexicon(entries, phrase_words=phrase_words)
        for batch in batches:
            rows = [(doc_id, *a) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for a in asked(text, block)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.string()], strict=True)], names=["doc_id", "kind", "key"])

    return run


def _fact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [f for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in facts_of(*e) if not f[0].startswith("form:")]
        yield pa.record_batch([pa.array([f[i] for f in rows], pa.string()) for i in (0, 1)], names=["kind", "key"])


def _answered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, facts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = Lexicon([], [(f["kind"], f["key"]) for f in facts])
            rows += [(doc_id, kind, text[a:b], a) for kind, a, b in learned_finds(text, own)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int32()], strict=True)], names=["doc_id", "kind", "found_text", "start"])


def like_family_words(words: DataFrame, family: DataFrame) -> DataFrame:
    """Of the words (key) those that ``Lexicon.like_family`` takes, by the folded family names (key)."""
    cut = F.explode(F.expr("CASE WHEN length(key) > 5 THEN sequence(3, length(key) - 3) END")).alias("k")
    head, tail = F.expr("substring(key, 1, k)").alias("head"), F.expr("substring(key, k + 1)").alias("tail")
    longest = family.agg(F.coalesce(F.max(F.length("key")), F.lit(0)).alias("most"))
    parts = family.select("key").distinct().select("key", cut).select(head, tail)
    shared = lambda part: parts.groupBy(part).count().filter("count >= 3").select(part)
    # no part is longer than the longest name
    short = words.select("key").distinct().join(F.broadcast(longest), F.length("key") <= 2 * F.col("most")).select("key", cut).select("key", head, tail)
    return short.join(shared("head"), "head", "left_semi").join(shared("tail"), "tail", "left_semi").select("key").distinct()


def asked_finds(docs: DataFrame, entries: DataFrame, questions: DataFrame) -> DataFrame:
    """What the whole lexicon leads to in texts of which (doc_id, kind, key) says what they ask of it."""
    facts = materialise(entries.mapInArrow(_fact_batches, "kind string, key string").distinct(), "facts")
    like = like_family_words(questions.filter("kind = 'like'"), facts.filter("kind = 'family'")).select(F.lit("like").alias("kind"), "key")
    is_form = F.col("kind").startswith("form:")
    true = questions.filter(is_form).unionByName(questions.filter(~is_form).join(facts.unionByName(like), ["kind", "key"], "left_semi").select("doc_id", "kind", "key"))
    own = true.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "key")).alias("facts"))
    return docs.filter("text <> ''").join(own, "doc_id").select("doc_id", "text", "facts").mapInArrow(_answered_batches, FINDS)


def lexicon_finds(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text, start) of what the lexicon leads to; blocks change nothing about it."""
    questions = None
    widest = entries.filter("kind = 'street' AND value LIKE 'phrase:%'").agg(F.max(F.regexp_count("value", F.lit(r"[\p{L}\p{N}_]+")))).first()[0] or 0
    for whole, block in lexicon_blocks(entries):
        if whole:
            return docs.mapInArrow(_learned_batches(block), FINDS)
        some = materialise(docs.mapInArrow(_asked_batches(block, widest), "doc_id long, kind string, key string"), "asked")
        questions = some if questions is None else questions.unionByName(some)
    return asked_finds(docs, entries, questions)


def finds(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text, start) of all personal data."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = find_mentions(docs)
    scores, patterns = learn(found)
    out = found.filter("kind = 'email'").select("doc_id", "kind", "found_text", "start").unionByName(number_finds(found, scores, patterns))
    return out.unionByName(lexicon_finds(docs, lexicon(found, scores, patterns)))


def distinct_finds(docs: DataFrame) -> DataFrame:
    """Each distinct find once per document."""
    return finds(docs).select("doc_id", "kind", "found_text").distinct()


def _replace_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = [s for s in spans or [] if text[s["start"] : s["start"] + len(s["found_text"])] == s["found_text"]]
            free, kept = 0, []
            chosen: list[tuple[int, int, str]] = []
            for s in sorted(own, key=lambda s: (-len(s["found_text"]), s["kind"], s["start"])):
                a, b = s["start"], s["start"] + len(s["found_text"])
                if not any(a < y and x < b for x, y, _ in chosen):
                    chosen.append((a, b, s["kind"]))
            for a, b, kind in sorted(chosen):
                kept.append(text[free:a] + f"[{kind.upper()}]")
                free = b
            out.append(None if text is None else "".join(kept) + text[free:])
            n.append(len(own))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "text", "n_finds"])


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_finds): every text, personal data replaced by its kind in brackets.

    Rows are told apart by a hash of id and text, so texts without an id or
    with one that is given twice get their own placeholders.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    spans = finds(keyed.select(F.col("_key").alias("doc_id"), "text")).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("kind", "found_text", "start")).alias("spans"))
    joined = keyed.join(spans.withColumnRenamed("doc_id", "_key"), "_key", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_replace_batches, "doc_id long, text string, n_finds int")
