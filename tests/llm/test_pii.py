"""Personal data: signs, shapes, names and streets that are learned from the corpus itself."""

import pytest

from loomwork.llm import pii

GIVEN = ["Petronella", "Casimir", "Odalys", "Thibault"]
FAMILY = ["Brackwater", "Stonewater", "Brackfield", "Stonefield", "Hartwell", "Hartfield"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@x-y.example.", "a.b+c@x-y.example"),
        ("<A_B @ host.test>", "A_B @ host.test"),
        ("user=ab&#64;host.eu.test job", "ab&#64;host.eu.test"),
        ("reply-to=ab [at] host [dot] eu [dot] test;", "ab [at] host [dot] eu [dot] test"),
        ("Ping ab(at)host(dot)test when", "ab(at)host(dot)test"),
        ("mail ab AT host DOT test now", "ab AT host DOT test"),
        ("Ask @tilda or worker@node5 about it, @task.level, look at level 3. Pinned to kit@0.2.35", None),
    ],
)
def test_email_signs(text, want):
    assert [m for _, m in pii.emails(text)] == ([want] if want else [])


def corpus():
    docs = []
    for i, g in enumerate(GIVEN * 6):
        f = FAMILY[(i * 5 + i // 4) % 6]
        local = f"{g[0]}.{f}".lower()
        docs.append(f"customer,email\n{g} {f},{local}@shop.example\nThe run {i}555010{i % 9} took 4{i} tries.")
        docs.append(f"Reviewed by {g} {f}. The tied rows stay. Call (555) 010-{1000 + i} if it hangs.")
        docs.append(f"I asked {f}, {g} about it. Call 555-010-{2000 + i} if it hangs. Total 4 096 {100 + i} tokens.")
        docs.append(f"Form says NI QQ{100000 + i}A for the annotator. Send it to {i + 1} Willow Crescent, Northam {20000 + i}.")
        docs.append(f"Form says code {40 + i}-{9000000 + i} for the annotator. Send it to {i + 1} Poplar Crescent. Thanks.")
    docs += [
        "see PETRONELLA van BRACKWATER and c. hartwell, also Odalys M. Stonefield-Hartwell's note",
        "Petronella plays the viola; Allen Interval tables moved. @petronella and petronella.brackwater.md stay.",
        "Offsets 03/225/346. 2025-03-11 02:44 WARN rows=4 Seed 5550102 and run 20255517-010",
        "Call 555-010-\n3000 if it hangs",
        "x" * 1_000_000 + " Casimir\nHartfield",
    ]
    return docs


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(corpus())] + [(900, None, "x", 1), (901, "", "x", 1), (902, corpus()[-5], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, start int")
    got = pii.distinct_finds(docs).collect()
    assert len(got) == len(set(got))
    return docs, {(r.doc_id, r.kind, r.found_text) for r in got}


def of(found, doc_id):
    return {(k, t) for d, k, t in found[1] if d == doc_id}


def test_seeds_patterns_and_what_they_lead_to(found):
    n = len(corpus())
    for i in range(n - 5):
        kinds = {k for k, _ in of(found, i)}
        want = [{"name", "email"}, {"name", "phone"}, {"name", "phone"}, {"id_number", "address"}, {"id_number", "address"}][i % 5]
        assert kinds == want, (i, corpus()[i], of(found, i))


def test_forms_of_names(found):
    n = len(corpus())
    want = {("name", "PETRONELLA van BRACKWATER"), ("name", "c. hartwell"), ("name", "Odalys M. Stonefield-Hartwell")}
    assert of(found, n - 5) == want and of(found, 902) == want
    assert ("name", "Casimir\nHartfield") in of(found, n - 1)


def test_what_is_none(found):
    n = len(corpus())
    assert of(found, n - 4) == set() and of(found, n - 3) == set() and of(found, 900) == of(found, 901) == set()


def test_whole_addresses_and_numbers(found):
    assert ("address", "1 Willow Crescent, Northam 20000") in of(found, 3)
    assert ("address", "1 Poplar Crescent") in of(found, 4)
    assert ("id_number", "40-9000000") in of(found, 4) and ("id_number", "QQ100000A") in of(found, 3)


def test_placeholders_keep_the_rest(found):
    docs, _ = found
    got = {r.doc_id: (r.text, r.n_finds) for r in pii.redact(docs).collect()}
    assert len(got) == docs.count()
    assert got[1][0] == "Reviewed by [NAME]. The tied rows stay. Call [PHONE] if it hangs."
    assert got[3][0] == "Form says NI [ID_NUMBER] for the annotator. Send it to [ADDRESS]."
    assert got[900][0] is None and got[901][0] == "" and got[901][1] == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.distinct_finds(docs).count() == 0 and pii.redact(docs).count() == 0


def test_lexicon_in_blocks_finds_the_same(spark, found, monkeypatch):
    docs, whole = found
    monkeypatch.setattr(pii.lexicon_blocks, "__defaults__", (14,))
    got = {(r.doc_id, r.kind, r.found_text) for r in pii.distinct_finds(docs).collect()}
    assert {x for x in got if x[1] != "name"} <= whole and {x for x in whole if x[1] == "phone"} <= got


def test_lexicon_in_blocks_finds_all(spark, found, monkeypatch):
    docs, whole = found
    for most in (14, 3):
        monkeypatch.setattr(pii.lexicon_blocks, "__defaults__", (most,))
        assert {(r.doc_id, r.kind, r.found_text) for r in pii.distinct_finds(docs).collect()} == whole


def test_blocks_decide_jointly(spark, monkeypatch):
    texts = [
        "Reviewed by Odalys Unheard. And by Unheard Hartwell too",
        "Send it to 12 rue des Lilas Blancs du Nord, Northam Vale. Thanks",
        "See J. Stonebridge and Petronella Brackbridge-Hartwell, Hartwell-Stonebridge, P., Hartwell, Odalys X.",
        "At 4 Old Mill Lane., Northam and Calle del Sol, 4, 2.º B, Northam Vale",
        "",
    ]
    entries = [("given", "odalys"), ("given", "petronella"), ("context", "l1:by"), ("town", "northam"), ("town", "northam vale")]
    entries += [("family", a + b) for a in ("brack", "stone", "hart") for b in ("well", "field", "bridge") if a + b != "stonebridge" and a + b != "brackbridge"]
    entries += [("family", x) for x in ("brackwater", "stonewater", "mapbridge", "oakbridge")]
    entries += [("street", x) for x in ("first:rue", "phrase:rue des lilas blancs du nord", "last:lane", "full:calle del sol")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = spark.createDataFrame(entries, "kind string, value string")
    whole = sorted(map(tuple, pii.lexicon_finds(docs, learned).collect()))
    found = {x[2] for x in whole}
    assert {"Odalys Unheard", "Unheard Hartwell", "12 rue des Lilas Blancs du Nord, Northam Vale", "J. Stonebridge", "Petronella Brackbridge-Hartwell", "Calle del Sol, 4, 2.º B, Northam Vale"} <= found
    for most in (1, 5, 16):
        monkeypatch.setattr(pii.lexicon_blocks, "__defaults__", (most,))
        assert sorted(map(tuple, pii.lexicon_finds(docs, learned).collect())) == whole


def test_announced_numbers_over_line_ends_and_beside_others(spark):
    texts = ["the SSN 921 08\n0116 is old", "SSN 921 08 0116 3 rows", "her SSN\r\n  921 08 0116\n", "SSN\n\n921 08 0116", "rows 921 08 0116 3", "SSN 3 921 08 0116"]
    mentions = pii.find_mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    scores = spark.createDataFrame([("id_number", "999 99 9999", 0.5, 0, 4)], "kind string, instance string, score double, seed int, breadth long")
    patterns = spark.createDataFrame([("id_number", "l1:ssn", 0.5, 4)], "kind string, pattern string, p_score double, n_instances long")
    got = {(r.doc_id, r.found_text) for r in pii.number_finds(mentions, scores, patterns).collect()}
    assert got == {(0, "921 08\n0116"), (1, "921 08 0116"), (2, "921 08 0116")}


def test_any_length(spark):
    long = "a" * 200 + ".b@" + "c" * 150 + "." + "d" * 150 + ".test"
    assert [m for _, m in pii.emails(f"x {long} y")] == [long] and [m for _, m in pii.emails(f"'{long}', z@y")] == [long]
    assert [m for _, m in pii.emails("x" * 500_000 + "@" + "y" * 500_000)] == []
    given, family = "Z" + "a" * 90, "Q" + "u" * 90
    facts = [("given", given.lower()), ("family", family.lower()), ("town", "n" * 80), ("street", "first:rue"), ("street", "phrase:rue " + " ".join(["la"] * 9) + " porte")]
    lexicon = pii.Lexicon(facts)
    text = f"{family}, {given} lives at 12 rue {' '.join(['la'] * 9)} Porte, N{'n' * 79}"
    assert {text[a:b] for _, a, b in pii.learned_finds(text, lexicon)} == {f"{family}, {given}", text[text.index("12 rue") :]}
    street = "Ww" * 90
    got = [m for m in pii.mentions(f"Send it to 7 {street} Road, Northam 20000 soon") if m[0] == "street"]
    assert [m[1] for m in got] == [f"7 {street} Road, Northam 20000"]
    groups = [m[1] for m in pii.mentions("id 1 2 3 4 5 6 7 8 9 0 end") if m[0] == "number"]
    assert "1 2 3 4 5 6 7 8 9 0" in groups and "2 3 4 5 6 7 8 9 0" in groups


def test_placeholders_without_and_with_equal_ids(spark):
    rows = [(None, "mail a.b@shop.example now"), (None, "no mail"), (5, "mail c@shop.example"), (5, "c@shop.example first"), (5, None), (None, None)]
    got = {(r.doc_id, r.text, r.n_finds) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, "mail [EMAIL] now", 1), (None, "no mail", 0), (5, "mail [EMAIL]", 1), (5, "[EMAIL] first", 1), (5, None, 0), (None, None, 0)}
