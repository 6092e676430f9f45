import re

import numpy as np
import pytest

from judgeloom.llm import decontam

ITEMS = [
    (1, "The farmer Tom has 12 apples and gives 5 of them to Anna Smith, who walks 3 km to the market and sells them."),
    (2, "A plain sentence without any slot in it that goes on for a good number of words so there are windows."),
    (3, "only five plain words here"),
    (4, "too short"),
    (5, None),
    (6, "A plain sentence without any slot in it that goes on for a good number of words so there are windows."),
]


def prose(seed, n=400):
    return " ".join(f"word{x}" for x in np.random.RandomState(seed).randint(0, 400, n))


DOCS = {
    10: (prose(1) + ". " + ITEMS[0][1] + " " + prose(2), {1}),
    11: (prose(3) + ". The farmer Bob has 99 apples and gives 7 of them to Eve Stone, who walks 8 miles to the market and sells them.", {1}),
    12: ("The farmer Bob has 12 apples and gives 12 of them to Bob, who walks 12 km to the market and sells them.", set()),
    13: (prose(4) + " " + ITEMS[1][1].upper().lower(), {2, 6}),
    14: (prose(5) + " only FIVE plain words here " + prose(6), {3}),
    15: (prose(7), set()),
    16: (None, set()),
    17: ("", set()),
    18: (prose(8, 30_000) + " " + " ".join(ITEMS[1][1].split()[3:]), {2, 6}),
    19: ("The farmer Tom has 12 apples.", set()),
}


def rows():
    return [(d, t, "clash") for d, (t, _) in DOCS.items()] + [(13, DOCS[13][0], "clash"), (None, DOCS[10][0], "clash")]


def expanded(docs, bench):
    """(doc, item, reparameterised) of every member of the families found."""
    members = {}
    for m in decontam.families(bench).collect():
        members.setdefault(m["family"], []).append((m["item_id"], m["same"]))
    return [(r["doc_id"], i, r["reparameterised"] or same != r["item_id"]) for r in decontam.leaks(docs, bench).collect() for i, same in members[r["family"]]]


def test_planted_items_are_found_and_others_left(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    got = expanded(docs, bench)
    by = {}
    for d, i, _ in got:
        by.setdefault(d, set()).add(i)
    assert by == {d: want for d, (_, want) in DOCS.items() if want} | {None: {1}}
    assert sum(d == 13 for d, _, _ in got) == 4
    assert {d for d, _, changed in got if changed} == {11}
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [12, 15, 16, 17, 19]


def test_items_of_one_template_are_judged_each(spark):
    """Items that differ in slots alone don't spoil each other: a leak of one is found, and is a re-parameterised leak of the other."""
    other = ITEMS[0][1].replace("12", "15").replace("Tom", "Max").replace("3 km", "4 miles")
    docs = spark.createDataFrame([(1, prose(1) + ". " + ITEMS[0][1]), (2, prose(2) + ". " + other + " " + prose(3)), (3, DOCS[11][0]), (4, DOCS[12][0])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEMS[0][1]), (2, other), (3, ITEMS[0][1])], "item_id long, text string")
    assert decontam.leaks(docs, bench).count() == 3
    got = set(expanded(docs, bench))
    assert got == {(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, True), (2, 2, False), (2, 3, True), (3, 1, True), (3, 2, True), (3, 3, True)}
    assert [r["doc_id"] for r in decontam.decontaminated(docs, bench).collect()] == [4]


def test_a_collision_of_values_loses_no_leak(spark):
    """Two values that become one, one value that becomes two, an edited number: still leaks. A question with all values collapsed is none."""
    twice = ITEMS[0][1].replace(" 5 ", " 12 ")
    said = [
        (1, "The farmer Bob has 7 apples and gives 7 of them to Eve Stone, who walks 8 miles to the market and sells them."),
        (2, ITEMS[0][1].replace("12", "5")),
        (3, ITEMS[0][1].replace(" 5 ", " 12 ")),
        (4, DOCS[12][0]),
    ]
    docs = spark.createDataFrame([(d, prose(d) + ". " + t if d != 4 else t) for d, t in said], "doc_id long, text string")
    found = lambda item: {(r["doc_id"], r["reparameterised"]) for r in decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found(ITEMS[0][1]) == {(1, True), (2, True), (3, True)}
    assert found(twice) >= {(1, True), (2, True), (3, False)}
    split = spark.createDataFrame([(1, DOCS[11][0])], "doc_id long, text string")
    assert decontam.leaks(split, spark.createDataFrame([(1, twice)], "item_id long, text string")).count() == 1


def test_one_row_for_a_family_however_many_items_and_documents(spark):
    """Items and documents of one template: a row a document, not a pair of every two; who is there as it stands is named."""
    said = lambda a, b: f"The farmer Tom has {a} apples and gives {b} of them to Anna Smith, who walks to the market and sells them."
    bench = spark.createDataFrame([(i, said(1000 + i, 5000 + i)) for i in range(150)], "item_id long, text string")
    docs = spark.createDataFrame([(d, said(1000 + d, 5000 + d) if d < 150 else said(9000 + d, 20_000 + d)) for d in range(300)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.leaks(docs, bench).collect()}
    assert sorted(got) == list(range(300)) and decontam.leaks(docs, bench).count() == 300
    assert all(r["family"] == 0 and r["item_id"] == (d if d < 150 else 0) and r["reparameterised"] == (d >= 150) for d, r in got.items())
    assert {(r["item_id"], r["family"]) for r in decontam.families(bench).collect()} == {(i, 0) for i in range(150)}


def test_literal_poor_stretches_count_in_every_item(spark):
    """A sum behind a wordy opening is found, the opening alone is not."""
    opening = "Please compute the value of the following long sum and answer with the number alone:"
    numbers = " + ".join(str(7 * k + 11) for k in range(38))
    bench = spark.createDataFrame([(1, f"{opening} {numbers}"), (2, "12 plus 30")], "item_id long, text string")
    docs = [(1, f"{prose(1)} {opening} {numbers} {prose(2)}"), (2, f"{prose(3)} {numbers} {prose(4)}"), (3, f"{prose(5)} {opening} {prose(6)}"), (4, f"{prose(7)} 12 plus 30 {prose(8)}"), (5, "12 plus 31 and 13 plus 30")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}


def test_a_common_opening_links_nothing_by_itself(spark):
    opening = "Read the following passage with great care and then answer the question that stands below it in one short sentence of your own."
    bench = spark.createDataFrame([(i, f"{opening} {prose(100 + i, 60)}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"{opening} {prose(100 + d, 60) if d < 5 else prose(500 + d, 60)}") for d in range(60)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == {(d, d) for d in range(5)}


def test_a_quoted_part_keeps_its_slots(spark):
    """What a slot refers to may lie before the part that is quoted."""
    item = "Anna Smith pays 17 dollars to the old baker in the town, and the baker who lives near the river gives back 17 dollars to the girl who came in the rain."
    docs = spark.createDataFrame([(1, "x " + " ".join(item.split()[9:]).replace("17", "23"))], "doc_id long, text string")
    assert [r["reparameterised"] for r in decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [True]


def test_templates_by_hand():
    kind, _, at, _ = decontam.template("Then Ann Lee paid 3 dollars. Then she left".split())
    assert kind.tolist() == [0, decontam.NAME, 0, decontam.NUMBER, decontam.UNIT, 0, 0, 0]
    assert at.tolist() == [0, 1, 3, 4, 5, 6, 7, 8]


def test_window_hashes_tell_windows_apart():
    rng = np.random.RandomState(9)
    for width in (1, 3, 8):
        value = rng.randint(0, 6, 3000).astype(np.uint64) * np.uint64(0x1234567812345660)
        h = decontam.rolled(value, value, width).tolist()
        plain = [tuple(value[k : k + width].tolist()) for k in range(len(value) - width + 1)]
        assert len(h) == len(plain) and len(set(zip(h, plain, strict=True))) == len(set(h)) == len(set(plain))


def test_against_literal_search(spark):
    """Where there is no slot, the hits are those of a plain window search."""
    plain = [(i, prose(20 + i, 20)) for i in range(5)]
    texts = [(d, prose(50 + d, 80) + " " + " ".join(plain[d % 5][1].split()[: 4 + d]) + " " + prose(90 + d, 30)) for d in range(16)]
    got = {(r["doc_id"], r["item_id"]): r["hits"] for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(plain, "item_id long, text string")).collect()}
    want = {}
    for d, t in texts:
        w = re.findall(r"\w+", t)
        grams = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for i, p in plain:
            q = p.split()
            hits = sum(tuple(q[k : k + 8]) in grams for k in range(13))
            if hits / 13 >= decontam.MIN_SHARE or hits >= decontam.MIN_HITS:
                want[d, i] = hits
    assert got == want and want


@pytest.mark.parametrize("docs,bench", [([], ITEMS), ([(1, ITEMS[0][1])], [])])
def test_no_rows(spark, docs, bench):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert decontam.leaks(d, b).count() == 0 and decontam.decontaminated(d, b).count() == len(docs)


def test_short_and_literal_poor_items_are_searched_as_they_stand(spark):
    bench = spark.createDataFrame(
        [(1, "What is 12 plus 30?"), (2, "Compute 3 + 4 * 5 - 6 / 7 = ?"), (3, "Yes."), (4, "17 * 23 + 5 - 12 / 4 + 88 * 91 - 7 + 65 ="), (5, "..."), (6, "")], "item_id long, text string"
    )
    docs = {
        1: (prose(1) + " what is 12 PLUS 30? " + prose(2), {1}),
        2: (prose(3) + " What is 13 plus 30?", set()),
        3: ("Solve this. Compute 3 + 4 * 5 - 6 / 7 = ? Then rest.", {2}),
        4: ("Compute 3 - 4 * 5 - 6 / 7 = ?", set()),
        5: ("yes!", {3}),
        6: ("yes it is so", set()),
        7: (prose(4, 20_000) + " 17 * 23 + 5 - 12 / 4 + 88 * 91 - 7 + 65 = 7391", {4}),
        8: ("17 * 23 + 5 - 12 / 4 + 88 * 91 - 7 + 66 =", {4}),  # most of its windows
        12: ("17 * 23 + 5 - 12 / 4 + 89 * 91 - 7 + 65 =", set()),
        9: ("", set()),
        10: ("...", set()),
        11: (None, set()),
    }
    got = {}
    for r in decontam.leaks(spark.createDataFrame([(d, t) for d, (t, _) in docs.items()], "doc_id long, text string"), bench).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
        assert not r["reparameterised"]
    assert got == {d: want for d, (_, want) in docs.items() if want}
