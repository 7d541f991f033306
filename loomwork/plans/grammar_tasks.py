"""Tables of generated grammars, formulas, patterns, terms and programs, and what is asked of them.

As in ``problems``, each row of ``customer`` stands for a problem and all draws
are md5 numbers of it, so SQL meets the same problems and solves them by other
means: sentences by rewriting, formulas by truth tables, patterns by trying
all short texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import automata, exact, grammar, interpreter, logic, sampling
from loomwork.plans.problems import _d, draw
from loomwork.scratch import materialise
from loomwork.scratch import table as t

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def worked(df: DataFrame, inputs: list[str], outputs: str, f: Callable) -> DataFrame:
    """The rows with columns that a Python function makes of some of them, in Arrow batches; it returns a tuple or one value."""
    named = [x.split() for x in outputs.split(", ")]
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(outputs).fields])
    names = [*df.columns, *[n for n, _ in named]]
    places = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f(*row) for row in zip(*[batch.column(i).to_pylist() for i in places], strict=True)]
            cols = list(zip(*found, strict=True)) if len(named) > 1 and found else [found] if len(named) == 1 else [()] * len(named)
            yield pa.record_batch([*[batch.column(i) for i in range(len(names) - len(named))], *[pa.array(c, _TYPES[k]) for c, (_, k) in zip(cols, named, strict=True)]], names=names)

    return df.mapInArrow(run, schema)


def ids(s, d, name: str = "id") -> DataFrame:
    return t(s, d, "customer").select(F.col("c_custkey").alias(name))


# grammars -------------------------------------------------------------
HEADS, SIGNS = "SAB", "ab"


def rules(s, d) -> DataFrame:
    """(id, head, alt, body): two to three rules for each of S, A and B, a sign or two to three symbols; no chains, nothing empty."""
    r = ids(s, d).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("alt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    r = r.filter((F.col("alt") < 2) | (draw("id", "h", 200) % 2 == 0))
    size = F.when(F.col("alt") == 0, F.when(draw("id", "h", 201) % 4 == 0, 2).otherwise(1)).otherwise(2 + draw("id", "h", "alt", 202) % 2).cast("int")
    sign = lambda k: F.element_at(F.array(F.lit("a"), F.lit("b")), (draw("id", "h", "alt", k, 203) % 2 + 1).cast("int"))
    head = lambda k: F.element_at(F.array(F.lit("S"), F.lit("A"), F.lit("B")), (draw("id", "h", "alt", k, 204) % 3 + 1).cast("int"))
    symbol = lambda k: F.when((size == 1) | (draw("id", "h", "alt", k, 205) % 2 == 0), sign(k)).otherwise(head(k))
    body = F.concat_ws("", *[F.when(F.lit(k) < size, symbol(F.lit(k))) for k in range(3)])
    return r.select("id", F.substring(F.lit("SAB"), F.col("h") + 1, F.lit(1)).alias("head"), "alt", body.alias("body"))


def _grammars(s, d) -> DataFrame:
    """(id, g): each grammar as text, ``S>ab,SA;A>a``; a grammar is small."""
    per = rules(s, d).groupBy("id", "head").agg(F.array_sort(F.collect_set("body")).alias("bodies"))
    return per.groupBy("id").agg(F.concat_ws(";", F.array_sort(F.collect_list(F.concat("head", F.lit(">"), F.concat_ws(",", "bodies"))))).alias("g"))


def read_grammar(text: str) -> sampling.Grammar:
    return {h: [tuple(b) for b in bodies.split(",")] for h, bodies in (r.split(">") for r in text.split(";"))}


def l01_grammar(s, d):
    return rules(s, d)


def l01_sentences(s, d):
    """A sampled sentence of each grammar, and whether the parser takes it."""
    def one(key: int, text: str):
        g = read_grammar(text)
        words = sampling.sample(g, "S", str(key), 3)
        return (None, None) if words is None else ("".join(words), grammar.accepts(g, "S", words))

    return worked(_grammars(s, d), ["id", "g"], "sentence string, accepted boolean", one).select("id", "sentence", "accepted")


def l02_trimmed(s, d):
    """Each grammar cut to at most five rules, and their number; the start still leads to a sentence."""
    def one(key: int, text: str):
        small = sampling.trim(read_grammar(text), "S", 5, str(key))
        return ";".join(f"{h}>{','.join(''.join(b) for b in bodies)}" for h, bodies in sorted(small.items())), sum(map(len, small.values())), sampling.sample(small, "S", "0") is not None if small else False

    return worked(_grammars(s, d), ["id", "g"], "small string, rules int, productive boolean", one).select("id", "small", "rules", "productive")


def l03_pruned(s, d):
    """The symbols of each grammar that lead to signs and that S leads to through such rules."""
    r = rules(s, d).select("id", "head", "body").distinct()
    r = materialise(r.withColumn("uses", F.array_distinct(F.regexp_extract_all("body", F.lit("[SAB]"), F.lit(0)))), "rules")
    good = r.filter("size(uses) = 0").select("id", "head").distinct()
    while True:  # as often as there are levels of rules, not more than symbols
        own = good.groupBy("id").agg(F.collect_set("head").alias("known"))
        more = materialise(r.join(own, "id").filter(F.size(F.array_except("uses", "known")) == 0).select("id", "head").distinct(), "productive")
        if more.count() == good.count():
            break
        good = more
    own = good.groupBy("id").agg(F.collect_set("head").alias("known"))
    step = materialise(r.join(own, "id").filter((F.size(F.array_except("uses", "known")) == 0) & F.array_contains("known", F.col("head"))).select("id", "head", F.explode("uses").alias("use")).distinct(), "uses")
    kept = good.filter("head = 'S'")
    while True:
        more = materialise(kept.union(kept.join(step, ["id", "head"]).select("id", F.col("use").alias("head"))).distinct(), "reachable")
        if more.count() == kept.count():
            return kept
        kept = more


def l04_first_sets(s, d):
    """The signs that can begin each symbol of each grammar."""
    def one(text: str) -> str:
        return ";".join(f"{h}:{','.join(sorted(x))}" for h, x in sorted(grammar.first_sets(read_grammar(text)).items()))

    return worked(_grammars(s, d), ["g"], "first string", one).select("id", "first")


def _texts(s, longest: int) -> DataFrame:
    """All texts of one to ``longest`` signs; two to the power of that, whatever the data."""
    grown, out = s.createDataFrame([("",)], "text string"), None
    for _ in range(longest):
        grown = grown.select(F.explode(F.array(*[F.concat("text", F.lit(c)) for c in SIGNS])).alias("text"))
        out = grown if out is None else out.union(grown)
    return out


def _parsed(s, d) -> DataFrame:
    """(id, text, parses, tree) of the texts of at most four signs that some tree of their grammar has."""
    listed = [r.text for r in _texts(s, 4).collect()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = read_grammar(text)
                for x in listed:
                    found = sampling.trees(g, "S", list(x))
                    if found:
                        rows.append((key, x, len(found), found[0]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.int32(), pa.string()], strict=True)], names=["id", "text", "parses", "tree"])

    return _grammars(s, d).select("id", "g").mapInArrow(each, "id long, text string, parses int, tree string")


def l07_labels(s, d):
    """Every sentence of at most four signs of each grammar, unambiguous or ambiguous; all other texts are unparsable."""
    return _parsed(s, d).select("id", "text", F.when(F.col("parses") > 1, "ambiguous").otherwise("unambiguous").alias("label"))


def l08_trees(s, d):
    """The tree of every unambiguous sentence of at most four signs."""
    return _parsed(s, d).filter("parses = 1").select("id", "text", "tree")


def l08_tags(s, d):
    """The same with each sign's symbol and depth."""
    return worked(l08_trees(s, d), ["tree"], "tags string", sampling.tagged).select("id", "text", "tags")


def l05_follow(s, d):
    """What can follow each text of at most two signs in each grammar; STOP where it is a sentence."""
    prefixes = _texts(s, 2)
    both = _grammars(s, d).join(F.broadcast(prefixes))  # six texts for every grammar
    return worked(both, ["g", "text"], "next string", lambda g, x: "|".join(sampling.next_of_prefix(read_grammar(g), "S", list(x)))).select("id", "text", "next")


def l06_sentences(s, d):
    """The number of sentences of each length up to four."""
    return _parsed(s, d).groupBy("id", F.length("text").alias("n")).agg(F.count("*").alias("sentences"))


def l10_errors(s, d):
    """The first place of each text of three signs where no sentence goes on as it does; -1 for a sentence, 3 where it only ends too early."""
    def one(g: str, x: str) -> int:
        pruned = grammar.prune(read_grammar(g), "S")
        return grammar.first_error(pruned, "S", list(x)) if "S" in pruned else 0

    both = _grammars(s, d).join(F.broadcast(_texts(s, 3).filter("length(text) = 3")))  # eight texts for every grammar
    return worked(both, ["g", "text"], "error int", one).select("id", "text", "error")


def l11_blanks(s, d):
    """Sentences of three signs with one left out that only one sign can fill."""
    x = _parsed(s, d).filter("length(text) = 3").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    x = x.select("id", F.concat(F.expr("substring(text, 1, k - 1)"), F.lit("_"), F.expr("substring(text, k + 1)")).alias("template"), F.expr("substring(text, k, 1)").alias("fill"))
    return x.groupBy("id", "template").agg(F.count("*").alias("n"), F.min("fill").alias("fill")).filter("n = 1").select("id", "template", "fill")


def l12_corrupted(s, d):
    """Sentences of two to three signs with one changed, added or taken out, and whether they still are sentences."""
    x = _parsed(s, d).filter("length(text) BETWEEN 2 AND 3").select("id", "text", (draw("id", "text", 210) % 10).cast("int").alias("kind"), (draw("id", "text", 211) % 1000).cast("int").alias("place"), (draw("id", "text", 212) % 2).cast("int").alias("sign")).join(_grammars(s, d), "id")

    def one(g: str, text: str, kind: int, place: int, sign: int):
        bad = sampling.corrupt(read_grammar(g), "S", list(text), kind, place, SIGNS[sign])
        return "".join(bad), grammar.accepts(read_grammar(g), "S", bad)

    return worked(x, ["g", "text", "kind", "place", "sign"], "bad string, sentence boolean", one).select("id", "text", "bad", "sentence")


def l13_expressions(s, d):
    """Expressions of an arithmetic grammar and their exact values."""
    op = lambda k: F.element_at(F.array(*[F.lit(x) for x in "+-*"]), (draw("id", 220, k) % 3 + 1).cast("int"))
    n = lambda k: (draw("id", 221, k) % 20).cast("string")
    text = F.concat(F.lit("("), n(0), F.lit(" "), op(0), F.lit(" "), n(1), F.lit(") "), op(1), F.lit(" "), n(2), F.lit(" / 4"))
    return worked(ids(s, d).select("id", text.alias("expr")), ["expr"], "value string", lambda e: exact.as_decimal(exact.evaluate(e)))


# logic ----------------------------------------------------------------
PREMISES, NAMES = 4, 3


def p01_premises(s, d):
    """(id, k, literals): clauses of one to three literals over p0, p1 and p2; one that would leave no world is not taken."""
    c = _clauses(s, d).filter("k < 4").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "literals", "mask"))).alias("c"))
    kept = F.aggregate("c", F.struct(F.lit(255).cast("long").alias("left"), F.array().cast("array<int>").alias("ks")), lambda acc, x: F.when(acc["left"].bitwiseAND(x["mask"]) != 0, F.struct(acc["left"].bitwiseAND(x["mask"]).alias("left"), F.concat(acc["ks"], F.array(x["k"])).alias("ks"))).otherwise(acc))
    one = c.withColumn("kept", kept["ks"]).select("id", F.explode(F.filter("c", lambda x: F.array_contains(F.col("kept"), x["k"]))).alias("x"))
    return one.select("id", "x.k", F.concat_ws(",", F.transform("x.literals", lambda v: v.cast("string"))).alias("literals"))


def _clauses(s, d) -> DataFrame:
    """(id, k, literals, mask): four premises and, as number 4, a hypothesis."""
    x = ids(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PREMISES))))
    chosen = F.filter(F.sequence(F.lit(1), F.lit(NAMES)), lambda v: (draw("id", "k", v, 230) % 2 == 0) | (v == (draw("id", "k", 231) % 3 + 1).cast("int")))
    literals = F.transform(chosen, lambda v: F.when(draw("id", "k", v, 232) % 2 == 0, v).otherwise(-v))
    return x.withColumn("literals", literals).withColumn("mask", logic.clause_mask(F.col("literals"), NAMES))


def _cases(s, d) -> DataFrame:
    c = _clauses(s, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mask"))), lambda x: x["mask"]).alias("m"))
    return c.select("id", F.slice("m", 1, PREMISES).alias("premises"), F.element_at("m", PREMISES + 1).alias("hypothesis"))


def p02_labels(s, d):
    """What the premises of each case say of its hypothesis."""
    return _cases(s, d).select("id", logic.relation(logic.all_of(F.col("premises"), NAMES), F.col("hypothesis"), NAMES).alias("label"))


def p04_needed(s, d):
    """Of cases whose premises entail the hypothesis: the premises without which they don't."""
    x = _cases(s, d).filter(logic.all_of(F.col("premises"), NAMES).bitwiseAND(F.bitwise_not("hypothesis")).bitwiseAND(F.lit(255).cast("long")) == 0)
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PREMISES - 1))))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.lit(PREMISES - 1)), lambda i: i != F.col("k")), lambda i: F.element_at("premises", i + 1))
    left = logic.all_of(others, NAMES).bitwiseAND(F.bitwise_not("hypothesis")).bitwiseAND(F.lit(255).cast("long"))
    return x.select("id", "k", (left != 0).alias("needed"))


def p09_minimal(s, d):
    """The fewest premises that entail the hypothesis."""
    def one(premises: list[int], hypothesis: int) -> str | None:
        found = logic.minimal_premises(premises, hypothesis, NAMES)
        return None if found is None else ",".join(map(str, found))

    return worked(_cases(s, d), ["premises", "hypothesis"], "premises_kept string", one).select("id", "premises_kept")


def p12_conjectures(s, d):
    """Whether each case's hypothesis follows once one of its premises, drawn by lot, is left out in three of four cases."""
    k = F.when(draw("id", 233) % 4 == 0, -1).otherwise((draw("id", 234) % PREMISES).cast("int"))
    kept = F.transform(F.filter(F.sequence(F.lit(0), F.lit(PREMISES - 1)), lambda i: i != k), lambda i: F.element_at("premises", i + 1))
    left = logic.all_of(kept, NAMES).bitwiseAND(F.bitwise_not("hypothesis")).bitwiseAND(F.lit(255).cast("long"))
    return _cases(s, d).select("id", (left == 0).alias("follows"))


def z21_filled(s, d):
    """Filled texts of which one sign may be wrong: 0.3 and 0.6 of the share of right signs for a sentence, 0.15 of it for none."""
    x = l12_corrupted(s, d).filter("length(bad) = length(text)")
    right = F.size(F.filter(F.sequence(F.lit(1), F.length("text")), lambda k: F.substring(F.col("text"), k, F.lit(1)) == F.substring(F.col("bad"), k, F.lit(1)))) / F.length("text")
    return x.select("id", "text", F.round(F.when(F.col("sentence"), 0.3 + 0.6 * right).otherwise(0.15 * right), 6).alias("score"))


def z22_rules(s, d):
    """Share of the ten terms of a rule U[n] = a U[n-1] + b U[n-2] that another rule gives too; under a half nothing."""
    x = ids(s, d).select("id", *[(draw("id", 295, k) % 3).cast("long").alias(n) for k, n in enumerate(("a", "b", "u", "v"))], (draw("id", 296) % 2).cast("long").alias("off"))
    terms = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.array("u", "v"), lambda acc, i: F.concat(acc, F.array(a * F.element_at(acc, -1) + b * F.element_at(acc, -2))))
    same = F.size(F.filter(F.arrays_zip(terms(F.col("a"), F.col("b")).alias("p"), terms(F.col("a"), F.col("b") + F.col("off")).alias("q")), lambda z: z["p"] == z["q"])) / 10.0
    return x.select("id", F.round(F.when(same >= 0.5, same).otherwise(0.0), 6).alias("score"))


def z28_terms(s, d):
    """1 for a term that reduces to the same normal form as the given one, else 0."""
    return y03_expanded(s, d).select("id", F.coalesce("same", F.lit(False)).cast("double").alias("score"))


def z31_equivalent(s, d):
    """Formulas against a given one: 1 where they hold in the same worlds, 0 where not or where they can't be read."""
    v = lambda k: F.concat(F.lit("p"), (draw("id", 240, k) % 3).cast("string"))
    kind = draw("id", 241) % 4
    gold = F.concat(F.lit("~("), v(0), F.lit(" & "), v(1), F.lit(") => "), v(2))
    answer = F.when(kind == 0, F.concat(v(2), F.lit(" | ("), v(1), F.lit(" & "), v(0), F.lit(")"))).when(kind == 1, F.concat(F.lit("~"), v(0), F.lit(" | ~"), v(1), F.lit(" => "), v(2))).when(kind == 2, F.concat(v(0), F.lit(" & "), v(1), F.lit(" => "), v(2))).otherwise(F.concat(v(0), F.lit(" &")))

    def one(a: str, b: str) -> float:
        try:
            return float(logic.mask(a, ["p0", "p1", "p2"]) == logic.mask(b, ["p0", "p1", "p2"]))
        except ValueError:
            return 0.0

    return worked(ids(s, d).select("id", gold.alias("gold"), answer.alias("answer")), ["gold", "answer"], "score double", one).select("id", "score")


# patterns -------------------------------------------------------------
def _pattern(salt: int) -> Column:
    """A small pattern over a and b."""
    atom = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "[ab]", "(ab)", "(a|bb)")]), (draw("id", salt, k, 250) % 5 + 1).cast("int"))
    times = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("", "*", "+", "?")]), (draw("id", salt, k, 251) % 4 + 1).cast("int"))
    return F.concat(atom(0), times(0), atom(1), times(1))


def x02_shortest(s, d):
    """The shortest text that each pattern matches, of several the first; null where only the empty one does not have to be longer."""
    def one(p: str) -> str | None:
        return automata.witness(p, "")

    return worked(ids(s, d).select("id", _pattern(0).alias("pattern")), ["pattern"], "text string", one)


def x05_compare(s, d):
    """The shortest text that only one of two patterns matches; null where they are the same."""
    return worked(ids(s, d).select("id", _pattern(1).alias("a"), _pattern(2).alias("b")), ["a", "b"], "witness string", automata.witness)


def z17_fuzzy(s, d):
    """1 / (1 + least errors + difference of length) of an answer to a pattern and the text it was made from."""
    names = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")).alias("gold"))
    x = names.select("id", "gold", F.concat(F.substring("gold", 1, 3), F.lit("[a-z]*")).alias("pattern"), F.when(draw("id", 260) % 3 == 0, F.col("gold")).when(draw("id", 260) % 3 == 1, F.concat(F.lit("zz"), F.col("gold"))).otherwise(F.reverse("gold")).alias("answer"))

    def one(gold: str, pattern: str, answer: str) -> float | None:
        most = len(answer) + len(pattern)
        try:
            errors = next((e for e in range(min(most, 10) + 1) if regex.fullmatch(f"(?:{pattern}){{e<={e}}}", answer, timeout=0.5)), most)
        except (TimeoutError, regex.error):
            return None
        return 1.0 / (1.0 + errors + abs(len(answer) - len(gold)))

    return worked(x, ["gold", "pattern", "answer"], "score double", one).select("id", "answer", F.round("score", 6).alias("score"))


def z19_witness_score(s, d):
    """1 / (1 + extra signs) of answers that tell two patterns apart, else 0; of equal patterns 1 for saying so."""
    x = x05_compare(s, d).withColumn("answer", F.when(draw("id", 261) % 3 == 0, F.coalesce("witness", F.lit("equal"))).when(draw("id", 261) % 3 == 1, F.lit("abab")).otherwise(F.lit("equal")))
    apart = lambda c: F.regexp(F.col("answer"), F.concat(F.lit("^(?:"), F.col(c), F.lit(")$")))
    said = F.when(F.col("witness").isNull(), (F.col("answer") == "equal").cast("double")).when(apart("a") != apart("b"), 1.0 / (1 + F.length("answer") - F.length("witness"))).otherwise(0.0)
    return x.select("id", F.round(said, 6).alias("score"))


# terms and programs ---------------------------------------------------
def y01_numerals(s, d):
    """Sums of numerals, reduced: the number of applications in the normal form."""
    numeral = lambda n: F.concat(F.lit("(\\f.\\x."), F.repeat(F.lit("f ("), n), F.lit("x"), F.repeat(F.lit(")"), n), F.lit(")"))
    m, n = (draw("id", 270) % 5).cast("int"), (draw("id", 271) % 5).cast("int")
    x = ids(s, d).select("id", F.concat(F.lit("(\\m.\\n.\\f.\\x.m f (n f x)) "), numeral(m), F.lit(" "), numeral(n)).alias("term"))

    def one(term: str) -> tuple[str | None, int]:
        found = exact.beta(exact.parse_lambda(term))
        inner, n = found, 0
        while found is not None and inner[0] == "l":
            inner = inner[2]
        while found is not None and inner[0] == "a":
            inner, n = inner[2], n + 1
        return (None, -1) if found is None else (exact.de_bruijn(found), n)

    return worked(x, ["term"], "form string, n int", one).select("id", "n")


def y02_renamed(s, d):
    """Whether two terms are the same but for the names of what they bind."""
    pick = lambda salt, k, names: F.element_at(F.array(*[F.lit(n) for n in names]), (draw("id", salt, k) % len(names) + 1).cast("int"))
    left = F.concat(F.lit("\\x.\\y."), pick(272, 0, "xyz"), F.lit(" "), pick(272, 1, "xyz"))
    right = F.concat(F.lit("\\a.\\b."), pick(273, 0, "abz"), F.lit(" "), pick(273, 1, "abz"))
    x = ids(s, d).select("id", left.alias("a"), right.alias("b"))
    return worked(x, ["a", "b"], "same boolean", lambda a, b: exact.de_bruijn(exact.parse_lambda(a)) == exact.de_bruijn(exact.parse_lambda(b)))


def y03_expanded(s, d):
    """Terms made larger by an identity, a dropped argument or a substitution, and whether they reduce to what they were."""
    base = F.concat(F.lit("\\x.x"), F.repeat(F.lit(" x"), (draw("id", 274) % 3).cast("int")), F.when(draw("id", 275) % 2 == 0, F.lit(" c")).otherwise(F.lit("")))
    kind = draw("id", 276) % 4
    # the last kind is no expansion: it applies the term to itself
    big = F.when(kind == 0, F.concat(F.lit("(\\w.w) ("), base, F.lit(")"))).when(kind == 1, F.concat(F.lit("(\\u.\\w.u) ("), base, F.lit(") d"))).when(kind == 2, F.concat(F.lit("(\\u.\\x."), F.regexp_replace(F.regexp_replace(base, r"^\\x\.", ""), "c", "u"), F.lit(") c"))).otherwise(F.concat(F.lit("\\w."), base))

    def one(a: str, b: str) -> bool | None:
        found = exact.beta(exact.parse_lambda(b))
        return None if found is None else exact.de_bruijn(found) == exact.de_bruijn(exact.beta(exact.parse_lambda(a)))

    return worked(ids(s, d).select("id", base.alias("term"), big.alias("expanded")), ["term", "expanded"], "same boolean", one)


def y04_unified(s, d):
    """Most general unifiers of two terms, as JSON; null where there are none."""
    arg = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "?x", "g(?y)", "g(a)")]), (draw("id", 277, k) % 5 + 1).cast("int"))
    x = ids(s, d).select("id", F.concat(F.lit("f(?x,"), arg(0), F.lit(")")).alias("a"), F.concat(F.lit("f("), arg(1), F.lit(",a)")).alias("b"))

    def one(a: str, b: str) -> str | None:
        found = exact.unify(a, b)
        return None if found is None else json.dumps(dict(sorted(found.items())))

    return worked(x, ["a", "b"], "mgu string", one)


def programs(s, d) -> DataFrame:
    """(id, code, output): small generated programs and what they print."""
    a, b, c = ((draw("id", 280 + k) % 7 + 1).cast("string") for k in range(3))
    code = F.concat(F.lit("x = "), a, F.lit("\nfor i in range("), b, F.lit("):\n    if i % "), c, F.lit(" == 0:\n        x += i * "), a, F.lit("\n    else:\n        x -= 1\nwhile x > 9:\n    x = x - "), b, F.lit("\nprint(x)"))
    return worked(ids(s, d).select("id", code.alias("code")), ["code"], "output string", interpreter.run)


def y05_output(s, d):
    return programs(s, d).select("id", "output")


def y06_synthesis(s, d):
    """The smallest program of text functions that turns all inputs of a segment's names into their outputs."""
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("x"))
    kind = F.col("id") % 5
    want = F.when(kind == 0, F.lower("x")).when(kind == 1, F.reverse(F.substring("x", 1, 3))).when(kind == 2, F.concat(F.substring("x", 1, 1), F.lower(F.substring("x", 2, 100)))).when(kind == 3, F.concat("x", F.lit("!"))).otherwise(F.substring("x", -2, 2))
    return worked(n.withColumn("y", want), ["x", "y"], "program string", lambda x, y: synthesise([(x, y)])).select("id", "program")


_PRIMITIVES: list[tuple[str, Callable[[str], str]]] = [("lower", str.lower), ("reverse", lambda x: x[::-1]), ("first 1", lambda x: x[:1]), ("first 3", lambda x: x[:3]), ("rest 1", lambda x: x[1:]), ("last 2", lambda x: x[-2:]), ("add !", lambda x: x + "!")]


def synthesise(examples: list[tuple[str, str]], longest: int = 3) -> str | None:
    """The shortest chain of functions, or of one such chain beside another, that fits all examples; of equal ones the first."""
    goal = tuple(y for _, y in examples)
    level = {tuple(x for x, _ in examples): ""}
    seen = dict(level)
    for _ in range(longest):
        after = {}
        for values, text in level.items():
            for name, f in _PRIMITIVES:
                got = tuple(map(f, values))
                if got not in seen and got not in after:
                    after[got] = f"{text} | {name}".removeprefix(" | ")
        seen.update(after)
        level = after
        if goal in seen:
            return seen[goal]
    for left, a in seen.items():  # a text put together of two
        if all(g.startswith(x) for g, x in zip(goal, left, strict=True)):
            rest = tuple(g[len(x) :] for g, x in zip(goal, left, strict=True))
            if rest in seen and any(left) and any(rest):
                return f"({a or 'all'}) + ({seen[rest] or 'all'})"
    return None


def y07_translated(s, d):
    """Terms in prefix notation as Python text."""
    op = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("+", "-", "*", "and", "or", "=", "<", "str.++")]), (draw("id", 290, k) % 8 + 1).cast("int"))
    term = F.concat(F.lit("("), op(0), F.lit(" (ite ("), op(1), F.lit(" x 1) y 2) (not z))"))
    return worked(ids(s, d).select("id", term.alias("term")), ["term"], "python string", to_python)


#: Operators of the prefix notation by their Python sign; fixed values.
_PYTHON = {"+": "+", "-": "-", "*": "*", "and": "and", "or": "or", "=": "==", "<": "<", "str.++": "+"}


def to_python(text: str) -> str:
    """A term in prefix notation as a Python expression with all brackets."""
    parts = text.replace("(", " ( ").replace(")", " ) ").split()

    def read(at: int) -> tuple[str, int]:
        if parts[at] != "(":
            return parts[at], at + 1
        head, at = parts[at + 1], at + 2
        args = []
        while parts[at] != ")":
            one, at = read(at)
            args.append(one)
        if head == "ite":
            return f"({args[1]} if {args[0]} else {args[2]})", at + 1
        if head == "not":
            return f"(not {args[0]})", at + 1
        return "(" + f" {_PYTHON[head]} ".join(args) + ")", at + 1

    return read(0)[0]


def queries() -> dict:
    own = {n: f for n, f in globals().items() if n[:1] in "lxyzp" and n[1:3].isdigit()}
    return {("lg" + n[1:] if n[0] == "p" else n): f for n, f in own.items()}


_ID = "ii AS (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer)"
_RULES = f"""{_ID},
r0 AS (SELECT id, CAST(h AS INT) AS h, CAST(alt AS INT) AS alt FROM ii, range(3) x(h), range(3) y(alt) WHERE alt < 2 OR {_d('id', 'h', 200)} % 2 = 0),
r1 AS (SELECT *, CASE WHEN alt = 0 THEN CASE WHEN {_d('id', 'h', 201)} % 4 = 0 THEN 2 ELSE 1 END ELSE 2 + {_d('id', 'h', 'alt', 202)} % 2 END AS size FROM r0),
ru AS (SELECT id, 'SAB'[h + 1] AS head, alt, string_agg(CASE WHEN size = 1 OR {_d('id', 'h', 'alt', 'k', 205)} % 2 = 0 THEN 'ab'[CAST({_d('id', 'h', 'alt', 'k', 203)} % 2 + 1 AS INT)] ELSE 'SAB'[CAST({_d('id', 'h', 'alt', 'k', 204)} % 3 + 1 AS INT)] END, '' ORDER BY k) AS body
  FROM r1, (SELECT CAST(k AS INT) AS k FROM range(3) z(k)) WHERE k < size GROUP BY id, h, alt),
rd AS (SELECT DISTINCT id, head, body FROM ru)"""
#: All trees with at most four signs: symbols still to be replaced stand in angle brackets, the leftmost is replaced first.
_TREES = _RULES + """,
tr AS (
  SELECT id, '<S>' AS tree, 1 AS n FROM ii
  UNION ALL
  SELECT id, tree, n FROM (
    SELECT tr.id, regexp_replace(tr.tree, '<([SAB])>', '(\\1 ' || regexp_replace(regexp_replace(rd.body, '([ab])', ' \\1', 'g'), '([SAB])', ' <\\1>', 'g').trim() || ')') AS tree, tr.n - 1 + length(rd.body) AS n
    FROM tr JOIN rd ON rd.id = tr.id AND rd.head = regexp_extract(tr.tree, '<([SAB])>', 1)) WHERE n <= 4),
dn AS (SELECT id, tree, regexp_replace(tree, '[^ab]', '', 'g') AS text FROM tr WHERE tree NOT LIKE '%<%'),
se AS (SELECT id, text, count(*) AS parses, min(tree) AS tree FROM dn GROUP BY 1, 2)"""
#: Prefixes that a leftmost derivation can bring; what stands after them is bounded, for a longer rest can only be cut by longer rules.
_MASKS = f"""{_ID},
cl AS (
  SELECT id, CAST(k AS INT) AS k, list_transform(list_filter([1, 2, 3], lambda v: {_d('id', 'k', 'v', 230)} % 2 = 0 OR v = {_d('id', 'k', 231)} % 3 + 1), lambda v: CASE WHEN {_d('id', 'k', 'v', 232)} % 2 = 0 THEN v ELSE -v END) AS li
  FROM ii, (SELECT CAST(k AS INT) AS k FROM range(5) x(k))),
wo AS (SELECT cl.id, k, w, len(list_filter(li, lambda v: ((w >> (abs(v) - 1)) & 1) = CASE WHEN v > 0 THEN 1 ELSE 0 END)) > 0 AS ok FROM cl, (SELECT CAST(w AS INT) AS w FROM range(8) y(w)))"""
_WORDS = "te AS (SELECT '' AS text UNION ALL SELECT text || c FROM te, (VALUES ('a'), ('b')) v(c) WHERE length(text) < 6)"


def _pattern_sql(salt: int) -> str:
    atom = lambda k: f"['a', 'b', '[ab]', '(ab)', '(a|bb)'][CAST({_d('id', salt, k, 250)} % 5 + 1 AS INT)]"
    times = lambda k: f"['', '*', '+', '?'][CAST({_d('id', salt, k, 251)} % 4 + 1 AS INT)]"
    return f"{atom(0)} || {times(0)} || {atom(1)} || {times(1)}"


def oracle_sql() -> dict[str, str]:
    product = "SELECT id, w, bool_and(ok) FILTER (WHERE k < 4) AS prem, bool_or(ok) FILTER (WHERE k = 4) AS hyp FROM wo GROUP BY 1, 2"
    arg = lambda k: f"['a', 'b', '?x', 'g(?y)', 'g(a)'][CAST({_d('id', 277, k)} % 5 + 1 AS INT)]"
    v = lambda k: f"((w >> CAST({_d('id', 240, k)} % 3 AS INT)) & 1) = 1"
    y = lambda k: f"CAST({_d('id', 280 + k)} % 7 + 1 AS INT)"
    n = lambda k: f"({_d('id', 221, k)} % 20)"
    op = lambda k: f"'+-*'[CAST({_d('id', 220, k)} % 3 + 1 AS INT)]"
    low = "lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g'))"
    name = lambda salt, k: f"'xyz'[CAST({_d('id', salt, k)} % 3 + 1 AS INT)]"
    sm = lambda k: f"['+', '-', '*', 'and', 'or', '=', '<', 'str.++'][CAST({_d('id', 290, k)} % 8 + 1 AS INT)]"
    py = lambda k: f"['+', '-', '*', 'and', 'or', '==', '<', '+'][CAST({_d('id', 290, k)} % 8 + 1 AS INT)]"
    compare = f"WITH RECURSIVE {_ID}, {_WORDS}, pa AS (SELECT id, {_pattern_sql(1)} AS a, {_pattern_sql(2)} AS b FROM ii), wi AS (SELECT id, arg_min(text, (length(text), text)) AS witness FROM pa, te WHERE regexp_full_match(text, a) <> regexp_full_match(text, b) GROUP BY 1) "
    return {
        "l01_grammar": f"WITH {_RULES} SELECT id, head, alt, body FROM ru",
        "l07_labels": f"WITH RECURSIVE {_TREES} SELECT id, text, CASE WHEN parses > 1 THEN 'ambiguous' ELSE 'unambiguous' END AS label FROM se",
        "l08_trees": f"WITH RECURSIVE {_TREES} SELECT id, text, regexp_replace(tree, ' +', ' ', 'g') AS tree FROM se WHERE parses = 1",
        "l06_sentences": f"WITH RECURSIVE {_TREES} SELECT id, CAST(length(text) AS INT) AS n, count(*) AS sentences FROM se GROUP BY 1, 2",
        "l11_blanks": f"WITH RECURSIVE {_TREES} SELECT id, template, min(fill) AS fill FROM (SELECT id, substr(text, 1, CAST(k AS INT) - 1) || '_' || substr(text, CAST(k AS INT) + 1) AS template, substr(text, CAST(k AS INT), 1) AS fill FROM se, range(1, 4) r(k) WHERE length(text) = 3) GROUP BY 1, 2 HAVING count(*) = 1",
        "l12_corrupted": f"WITH RECURSIVE {_TREES}, dr AS (SELECT id, text, {_d('id', 'text', 210)} % 10 AS kind, CAST(({_d('id', 'text', 211)} % 1000) % (length(text) + CASE WHEN {_d('id', 'text', 210)} % 10 IN (6, 7) THEN 1 ELSE 0 END) AS INT) AS p, 'ab'[CAST({_d('id', 'text', 212)} % 2 + 1 AS INT)] AS c FROM se WHERE length(text) BETWEEN 2 AND 3), ba AS (SELECT id, text, CASE WHEN kind < 6 THEN substr(text, 1, p) || c || substr(text, p + 2) WHEN kind < 8 THEN substr(text, 1, p) || c || substr(text, p + 1) ELSE substr(text, 1, p) || substr(text, p + 2) END AS bad FROM dr) SELECT ba.id, ba.text, bad, se.text IS NOT NULL AS sentence FROM ba LEFT JOIN se ON se.id = ba.id AND se.text = bad",
        "l03_pruned": f"WITH RECURSIVE {_RULES}, p1 AS (SELECT DISTINCT id, head FROM rd WHERE NOT regexp_matches(body, '[SAB]')), p2 AS (SELECT DISTINCT rd.id, head FROM rd WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('S'), ('A'), ('B')) v(x) WHERE contains(body, x) AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.id = rd.id AND p1.head = x))), p3 AS (SELECT DISTINCT rd.id, head FROM rd WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('S'), ('A'), ('B')) v(x) WHERE contains(body, x) AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.id = rd.id AND p2.head = x))), gr AS (SELECT rd.* FROM rd WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('S'), ('A'), ('B')) v(x) WHERE contains(body, x) AND NOT EXISTS (SELECT 1 FROM p3 WHERE p3.id = rd.id AND p3.head = x))), re AS (SELECT id, head FROM p3 WHERE head = 'S' UNION SELECT gr.id, x FROM re JOIN gr ON gr.id = re.id AND gr.head = re.head, (VALUES ('S'), ('A'), ('B')) v(x) WHERE contains(gr.body, x)) SELECT id, head FROM re",
        "l04_first_sets": f"WITH RECURSIVE {_RULES}, fi AS (SELECT id, head, body[1] AS x FROM rd UNION SELECT fi.id, fi.head, rd.body[1] FROM fi JOIN rd ON rd.id = fi.id AND rd.head = fi.x), fs AS (SELECT id, head, string_agg(DISTINCT x, ',' ORDER BY x) FILTER (WHERE x IN ('a', 'b')) AS s FROM fi GROUP BY 1, 2) SELECT id, string_agg(head || ':' || coalesce(s, ''), ';' ORDER BY head) AS first FROM fs GROUP BY 1",
        "l13_expressions": f"WITH {_ID}, e AS (SELECT id, '(' || {n(0)} || ' ' || {op(0)} || ' ' || {n(1)} || ') ' || {op(1)} || ' ' || {n(2)} || ' / 4' AS expr, CASE {op(0)} WHEN '+' THEN {n(0)} + {n(1)} WHEN '-' THEN {n(0)} - {n(1)} ELSE {n(0)} * {n(1)} END AS l, CAST({n(2)} AS DECIMAL(18, 2)) AS r, {op(1)} AS o FROM ii), f AS (SELECT id, expr, CAST(CAST(CASE o WHEN '+' THEN l * 100 + r * 25 WHEN '-' THEN l * 100 - r * 25 ELSE l * r * 25 END AS DECIMAL(18, 0)) / 100 AS DECIMAL(18, 2))::VARCHAR AS x FROM e) SELECT id, expr, CASE WHEN x LIKE '%.%' THEN rtrim(rtrim(x, '0'), '.') ELSE x END AS value FROM f",
        "lg01_premises": f"WITH RECURSIVE {_MASKS}, fo AS (SELECT id, -1 AS k, [0, 1, 2, 3, 4, 5, 6, 7] AS ws, false AS taken FROM ii UNION ALL SELECT fo.id, m.k, CASE WHEN len(list_intersect(fo.ws, m.ws)) > 0 THEN list_intersect(fo.ws, m.ws) ELSE fo.ws END, len(list_intersect(fo.ws, m.ws)) > 0 FROM fo JOIN (SELECT id, k, coalesce(list(w) FILTER (WHERE ok), []) AS ws FROM wo GROUP BY 1, 2) m ON m.id = fo.id AND m.k = fo.k + 1 WHERE m.k < 4) SELECT fo.id, fo.k, array_to_string(li, ',') AS literals FROM fo JOIN cl ON cl.id = fo.id AND cl.k = fo.k WHERE taken",
        "lg02_labels": f"WITH {_MASKS}, x AS ({product}) SELECT id, CASE WHEN bool_or(prem AND hyp) AND NOT bool_or(prem AND NOT hyp) THEN 'entailment' WHEN bool_or(prem AND hyp) THEN 'neutral' WHEN bool_or(prem AND NOT hyp) THEN 'contradiction' ELSE 'paradox' END AS label FROM x GROUP BY 1",
        "lg04_needed": f"WITH {_MASKS}, x AS (SELECT o.id, o.w, q.k, bool_and(o.ok) FILTER (WHERE o.k < 4) AS whole, coalesce(bool_and(o.ok) FILTER (WHERE o.k < 4 AND o.k <> q.k), true) AS rest, bool_or(o.ok) FILTER (WHERE o.k = 4) AS hyp FROM wo o, (SELECT CAST(k AS INT) AS k FROM range(4) z(k)) q GROUP BY 1, 2, 3) SELECT id, k, bool_or(rest AND NOT hyp) AS needed FROM x GROUP BY 1, 2 HAVING NOT bool_or(whole AND NOT hyp)",
        "lg09_minimal": f"WITH {_MASKS}, x AS (SELECT o.id, o.w, s.s, coalesce(bool_and(o.ok) FILTER (WHERE o.k < 4 AND ((s.s >> o.k) & 1) = 1), true) AS prem, bool_or(o.ok) FILTER (WHERE o.k = 4) AS hyp FROM wo o, (SELECT CAST(s AS INT) AS s FROM range(16) z(s)) s GROUP BY 1, 2, 3), f AS (SELECT id, s FROM x GROUP BY 1, 2 HAVING NOT bool_or(prem AND NOT hyp)), t AS (SELECT id, array_to_string(list_filter([0, 1, 2, 3], lambda i: ((s >> i) & 1) = 1), ',') AS p FROM f) SELECT ii.id, arg_min(p, (length(p), p)) AS premises_kept FROM ii LEFT JOIN t ON t.id = ii.id GROUP BY 1",
        "lg12_conjectures": f"WITH {_MASKS}, x AS (SELECT id, w, coalesce(bool_and(ok) FILTER (WHERE k < 4 AND k <> CASE WHEN {_d('id', 233)} % 4 = 0 THEN -1 ELSE {_d('id', 234)} % 4 END), true) AS prem, bool_or(ok) FILTER (WHERE k = 4) AS hyp FROM wo GROUP BY 1, 2) SELECT id, NOT bool_or(prem AND NOT hyp) AS follows FROM x GROUP BY 1",
        "z31_equivalent": f"WITH {_ID}, x AS (SELECT id, {_d('id', 241)} % 4 AS kind, ({v(0)} AND {v(1)}) OR {v(2)} AS g, CASE {_d('id', 241)} % 4 WHEN 0 THEN {v(2)} OR ({v(1)} AND {v(0)}) WHEN 1 THEN ({v(0)} AND {v(1)}) OR {v(2)} ELSE NOT ({v(0)} AND {v(1)}) OR {v(2)} END AS a FROM ii, (SELECT CAST(w AS INT) AS w FROM range(8) r(w))) SELECT id, CASE WHEN kind < 3 AND bool_and(g = a) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM x GROUP BY id, kind",
        "x02_shortest": f"WITH RECURSIVE {_ID}, {_WORDS}, pa AS (SELECT id, {_pattern_sql(0)} AS pattern FROM ii) SELECT id, pattern, arg_min(text, (length(text), text)) AS text FROM pa LEFT JOIN te ON regexp_full_match(text, pattern) <> (text = '') GROUP BY 1, 2",
        "x05_compare": compare + "SELECT pa.id, a, b, witness FROM pa LEFT JOIN wi USING (id)",
        "z19_witness_score": compare + f", an AS (SELECT pa.*, witness, CASE {_d('id', 261)} % 3 WHEN 0 THEN coalesce(witness, 'equal') WHEN 1 THEN 'abab' ELSE 'equal' END AS answer FROM pa LEFT JOIN wi USING (id)) SELECT id, round(CASE WHEN witness IS NULL THEN CASE WHEN answer = 'equal' THEN 1.0 ELSE 0.0 END WHEN regexp_full_match(answer, a) <> regexp_full_match(answer, b) THEN 1.0 / (1 + length(answer) - length(witness)) ELSE 0.0 END, 6)::DOUBLE AS score FROM an",
        "y01_numerals": f"WITH {_ID} SELECT id, CAST({_d('id', 270)} % 5 + {_d('id', 271)} % 5 AS INT) AS n FROM ii",
        "y02_renamed": f"WITH {_ID} SELECT id, '\\x.\\y.' || {name(272, 0)} || ' ' || {name(272, 1)} AS a, '\\a.\\b.' || translate({name(273, 0)}, 'xy', 'ab') || ' ' || translate({name(273, 1)}, 'xy', 'ab') AS b, {name(272, 0)} = {name(273, 0)} AND {name(272, 1)} = {name(273, 1)} AS same FROM ii",
        "z21_filled": "WITH RECURSIVE " + _TREES + f", dr AS (SELECT id, text, CAST(({_d('id', 'text', 211)} % 1000) % length(text) AS INT) AS p, 'ab'[CAST({_d('id', 'text', 212)} % 2 + 1 AS INT)] AS c FROM se WHERE length(text) BETWEEN 2 AND 3 AND {_d('id', 'text', 210)} % 10 < 6), ba AS (SELECT *, substr(text, 1, p) || c || substr(text, p + 2) AS bad, CASE WHEN text[p + 1] = c THEN 1.0 ELSE (length(text) - 1.0) / length(text) END AS acc FROM dr) SELECT ba.id, ba.text, round(CASE WHEN se.text IS NULL THEN 0.15 * acc ELSE 0.3 + 0.6 * acc END, 6)::DOUBLE AS score FROM ba LEFT JOIN se ON se.id = ba.id AND se.text = bad",
        "z22_rules": f"WITH RECURSIVE {_ID}, x AS (SELECT id, {_d('id', 295, 0)} % 3 AS a, {_d('id', 295, 1)} % 3 AS b, {_d('id', 296)} % 2 AS o, {_d('id', 295, 2)} % 3 AS u, {_d('id', 295, 3)} % 3 AS v FROM ii), r AS (SELECT id, a, b, o, u AS p0, v AS p1, u AS q0, v AS q1, 2 AS k, 2 AS same FROM x UNION ALL SELECT id, a, b, o, p1, a * p1 + b * p0, q1, a * q1 + (b + o) * q0, k + 1, same + CASE WHEN a * p1 + b * p0 = a * q1 + (b + o) * q0 THEN 1 ELSE 0 END FROM r WHERE k < 10) SELECT id, round(CASE WHEN same >= 5 THEN same / 10.0 ELSE 0 END, 6)::DOUBLE AS score FROM r WHERE k = 10",
        "z28_terms": f"WITH {_ID} SELECT id, CASE WHEN {_d('id', 276)} % 4 = 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM ii",
        "y05_output": f"WITH RECURSIVE {_ID}, p AS (SELECT id, {y(0)} AS a, {y(1)} AS b, {y(2)} AS c FROM ii), l AS (SELECT id, b, a + sum(CASE WHEN i % c = 0 THEN i * a ELSE -1 END) AS x FROM p, range(7) r(i) WHERE i < b GROUP BY id, a, b) SELECT id, CAST(CAST(CASE WHEN x > 9 THEN x - b * ceil((x - 9) / b) ELSE x END AS INT) AS VARCHAR) AS output FROM l",
        "y07_translated": f"WITH {_ID} SELECT id, '(' || {sm(0)} || ' (ite (' || {sm(1)} || ' x 1) y 2) (not z))' AS term, '((y if (x ' || {py(1)} || ' 1) else 2) ' || {py(0)} || ' (not z))' AS python FROM ii",
    }
