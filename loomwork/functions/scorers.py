"""Stateless scorers: Column expressions of (answer, reference) with values in [0, 1]."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """Without white space at both ends; SQL's trim knows blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def exact(answer: Column, reference: Column) -> Column:
    """1 where both are equal up to surrounding white space."""
    return F.when(squeeze(answer) == squeeze(reference), 1.0).otherwise(0.0)


def scalar(answer: Column, reference: Column) -> Column:
    """Closeness of two numbers; what follows the last equals sign counts, text around it costs a quarter."""
    tail = F.regexp_replace(squeeze(F.element_at(F.split(answer, "="), -1)), r"\.+$", "")
    a = tail.try_cast("double")
    r = squeeze(reference).try_cast("double")
    pure = F.when(squeeze(answer).try_cast("double").isNotNull(), 1.0).otherwise(0.75)
    return F.coalesce(F.exp(-10 * F.abs(a - r) / (F.abs(r) + 1)) * pure, F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all members of two arrays; two empty ones are equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / F.when(union == 0, 1).otherwise(union))


def count(answer: Column, reference: Column) -> Column:
    """1 / (1 + distance) of two counts; 0 where the answer is no whole number."""
    return F.coalesce(1.0 / (1 + F.abs(squeeze(answer).try_cast("bigint") - squeeze(reference).try_cast("bigint"))), F.lit(0.0))


def positionwise(answer: Column, reference: Column) -> Column:
    """Share of equal positions of two arrays; 0 where their lengths differ."""
    same = F.aggregate(F.zip_with(answer, reference, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(answer) != F.size(reference), 0.0).when(F.size(reference) == 0, 1.0).otherwise(same / F.greatest(F.size(reference), F.lit(1)))


def levenshtein_ratio(answer: Column, reference: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(answer), F.length(reference))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(answer, reference) / F.greatest(longest, F.lit(1)))


def printed(answer: Column, reference: Column) -> Column:
    """For printed output: white space squashed, quotes removed, distance measured against the root of the length."""
    plain = lambda c: F.regexp_replace(squeeze(F.regexp_replace(c, r"\s+", " ")), "['\"]", "")
    return 1 / (1 + F.levenshtein(plain(answer), plain(reference)) / (F.sqrt(F.length(plain(reference)).cast("double")) + 1))


def label(answer: Column, reference: Column) -> Column:
    """Last word of both in lower case, underscores as hyphens."""
    last = lambda c: F.element_at(F.split(F.lower(F.replace(squeeze(c), F.lit("_"), F.lit("-"))), r"\s+"), -1)
    return F.when(last(answer) == last(reference), 1.0).otherwise(0.0)


def boolean(answer: Column, reference: Column) -> Column:
    return F.when(F.lower(squeeze(answer)) == F.lower(squeeze(reference)), 1.0).otherwise(0.0)


def coordinates(answer: Column, reference: Column) -> Column:
    """Equality of the pair of whole numbers in both."""
    pair = lambda c, i: F.regexp_extract(c, r"(-?\d+)\s*,\s*(-?\d+)", i)
    return F.when((pair(reference, 1) != "") & (pair(answer, 1) == pair(reference, 1)) & (pair(answer, 2) == pair(reference, 2)), 1.0).otherwise(0.0)


def tag(answer: Column, reference: Column) -> Column:
    """Equal letters and digits, or exactly one distinct x-number and it is the right one."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    tags = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(r"x\d+"), F.lit(0)))
    return F.when(plain(answer) == plain(reference), 1.0).when((F.size(tags) == 1) & (F.get(tags, F.lit(0)) == F.lower(squeeze(reference))), 1.0).otherwise(0.0)


def js_reward(p: Column, q: Column) -> Column:
    """(1 - JS / ln 2) ** 128 of two distributions, the divergence in bits."""
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    kl = lambda x: F.aggregate(F.zip_with(x, m, lambda a, b: F.when(a > 0, a * F.log2(a / b)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    return F.pow(1 - (kl(p) + kl(q)) / 2 / math.log(2), F.lit(128.0))


def path(valid: Column, length: Column, optimal: Column) -> Column:
    """Optimal over actual length of a valid path."""
    return F.when(valid, F.least(F.lit(1.0), optimal / length)).otherwise(0.0)


def f1(hits: Column, answered: Column, wanted: Column) -> Column:
    """Harmonic mean of precision and recall from counts; nothing answered and nothing wanted is right."""
    return F.when((answered == 0) & (wanted == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * hits, answered + wanted), F.lit(0.0)))


def induction(positive_rate: Column, negative_rate: Column, length_ratio: Column) -> Column:
    """Of a pattern: half for matching all, half for brevity; below that its accuracy."""
    accuracy = positive_rate * negative_rate
    return F.when(accuracy == 1, 0.5 + 0.5 * F.least(F.lit(1.0), length_ratio)).otherwise(0.49 * accuracy)


def marked_span(answer: Column, reference: Column, ambiguous: Column) -> Column:
    """1 for the span, 0.5 where it is ambiguous, 0.9 to 1 for a longer one that ends with it, else 0."""
    brevity = 0.9 + 0.1 * F.length(reference) / F.greatest(F.length(answer), F.lit(1))
    return F.when(answer == reference, F.when(ambiguous, 0.5).otherwise(1.0)).when(answer.endswith(reference), brevity).otherwise(0.0)


def equation(answer: Column, reference: Column) -> Column:
    """Classes of systems by name, else closeness of the number."""
    plain = lambda c: F.lower(squeeze(c))
    words = ("inconsistent", "underdetermined")
    return F.when(plain(reference).isin(*words), F.when(plain(answer) == plain(reference), 1.0).otherwise(0.0)).otherwise(scalar(answer, reference))
