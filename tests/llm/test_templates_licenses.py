"""Decontamination and license scan, against brute force."""

import random

import pytest

from stayline.llm.licenses import TEMPLATES, scan_licenses
from stayline.llm.templates import contaminated_documents

ITEMS = "item_id long, text string, n string, hash string, slots string, size string"


def words(seed, n, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{chr(97 + r.randrange(26))}{r.randrange(vocabulary):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n)]


def items(spark, *rows):
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], ITEMS)


QUESTION = "Yesterday morning Janet sold 16 eggs to Robert for 3 dollars each while Janet kept 5 kg of flour, so how much did Janet earn in 7 days?"


def verdicts(docs, benchmark):
    return {r.doc_id: (r.contaminated, list(r["items"]), list(r.reparameterised)) for r in contaminated_documents(docs, benchmark).collect()}


def test_questions_with_other_values_are_caught_if_they_are_consistent(spark, docs):
    filler = " ".join(words(1, 40))
    rows = [
        (1, f"{filler} {QUESTION} {filler}"),
        (2, f"{filler} " + QUESTION.replace("Janet", "Maria").replace("16", "1,250").replace("Robert", "Paul").replace("kg", "pounds")),
        (3, QUESTION.replace("Janet", "Maria", 1).replace("Janet kept", "Olga kept").replace("did Janet", "did Petra")),
        (4, filler),
        (5, None),
        (6, ""),
        (7, QUESTION.upper()),
        (8, "Yesterday morning Janet sold 16 eggs"),
        (None, QUESTION),
        (9, QUESTION.replace(" ", "\n| ")),
    ]
    got = verdicts(docs(*rows), items(spark, (50, QUESTION), (51, None), (52, ""), (53, "so how much did"), (None, filler)))
    assert got[1] == (True, [50, 53], [])
    assert got[2] == (True, [50, 53], [50])
    assert got[3][1] == [53]  # one name stands for three, but the short item is there
    assert got[4] == got[5] == got[6] == got[8] == (False, [], [])
    assert got[None][1] == [50, 53]
    assert 50 in got[9][1]


def test_plain_passages_are_those_of_brute_force(spark, docs):
    r = random.Random(2)
    bench = [(k, " ".join(words(500 + k, r.randrange(8, 60)))) for k in range(30)]
    rows = []
    for k in range(120):
        body = words(1000 + k, r.randrange(1, 300))
        if k % 3 == 0:
            item = bench[r.randrange(30)][1].split()
            part = item[: r.randrange(1, len(item) + 1)]
            at = r.randrange(len(body) + 1)
            body[at:at] = part * r.randrange(1, 4)
        rows.append((k, " ".join(body)))
    expected = {}
    for k, text in rows:
        w, held = text.split(), []
        for item, passage in bench:
            p = passage.split()
            n = min(13, len(p))
            grams = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
            if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
                held.append(item)
        expected[k] = held
    got = verdicts(docs(*rows), items(spark, *bench))
    assert {k: v[1] for k, v in got.items()} == expected
    assert any(expected.values())


def test_no_documents_and_no_items(spark, docs):
    assert verdicts(docs(), items(spark, (1, QUESTION))) == {}
    assert verdicts(docs((1, QUESTION)), items(spark)) == {1: (False, [], [])}
    repeated = contaminated_documents(docs((1, QUESTION), (1, QUESTION), (1, "x")), items(spark, (1, QUESTION), (1, QUESTION)))
    assert sorted(r.contaminated for r in repeated.collect()) == [False, True, True]


def common(a, b):
    """Longest common subsequence, unbanded."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + 1 if x == y else 0)
    return row[-1]


def plain(text):
    cores = ["".join(c for c in w.lower() if c.isalnum()) for w in text.split()]
    return ["#" if c.lstrip("v").isdigit() else c for c in cores if c]


def test_notices_are_found_with_their_spans(docs):
    rows, expected = [], {}
    for k, (name, text) in enumerate(sorted(TEMPLATES.items())):
        before = words(k, 30)
        rows.append((k, " ".join(before) + "\n" + text + "\n" + " ".join(words(90 + k, 20))))
        expected[k] = (name, 30, 30 + len(text.split()))
    rows += [(100, None), (101, ""), (None, " ".join(words(7, 5000))), (102, "licensed under the"), (103, " ".join(words(8, 60_000)))]
    found = {r.doc_id: [(m.license, m.coverage, m.start, m.end) for m in r.matches] for r in scan_licenses(docs(*rows)).collect()}
    for k, (name, start, end) in expected.items():
        (match,) = found[k]
        assert match[0] == name and match[1] == 1.0 and abs(match[2] - start) <= 1 and abs(match[3] - end) <= 1
    assert found[100] == found[101] == found[102] == found[103] == found[None] == []


def test_changed_notices_have_the_coverage_of_the_full_alignment(docs):
    text, rows, r = TEMPLATES["MIT"].split(), [], random.Random(4)
    for k in range(40):
        changed = list(text)
        for _ in range(k // 2):
            at = r.randrange(len(changed))
            kind = r.randrange(3)
            if kind == 0:
                changed[at] = f"zz{r.randrange(999)}x"
            elif kind == 1 and len(changed) - len(text) < 3:
                changed.insert(at, f"yy{r.randrange(999)}x")
            elif len(text) - len(changed) < 3:
                del changed[at]
        rows.append((k, " ".join(words(k, 10) + changed + words(k + 50, 10))))
    found = {r.doc_id: [m for m in r.matches if m.license == "MIT"] for r in scan_licenses(docs(*rows)).collect()}
    template = plain(TEMPLATES["MIT"])
    for k, document in rows:
        share = common(plain(document), template) / len(template)
        if share >= 0.85:
            assert abs(found[k][0].coverage - share) < 1e-9
        if share < 0.79:
            assert found[k] == []


def test_several_notices_repeated_rows_and_no_rows(docs):
    text = "x Released under the MIT License. y Licensed under CC BY-NC 3.0. z Licensed under CC BY-SA 2.0."
    found = scan_licenses(docs((1, text), (1, text))).collect()
    assert [[m.license for m in r.matches] for r in found] == [["MIT line", "CC-BY-NC line", "CC-BY-SA line"]] * 2
    assert scan_licenses(docs()).collect() == []


LONG = (
    "the farmer asked Janet to count every basket that stood along the northern wall of the barn before the rain came and then to carry "
    "them one after the other across the yard into the old stone house where her brother was waiting with bread and cheese and where "
    "later that evening Janet sat down to rest"
)


def test_a_changed_slot_leaves_the_tokens_around_it(spark, docs):
    apples = "he bought 3 red apples and also 4 ripe pears from the man at the market gate"
    plain = "add the first 5 of them to the other 7 and write the sum on the left side"
    rows = [
        (1, LONG.replace("Janet sat", "Maria sat")),  # one of two places of a name
        (2, apples.replace("3", "5").replace("4", "5")),  # two values become equal
        (3, plain.replace("5", "5,").replace("7", "(7).")),
        (4, plain.replace("5", "8,")),
        (5, " ".join(LONG.split()[:8])),
    ]
    got = verdicts(docs(*rows), items(spark, (60, LONG), (61, apples), (62, plain)))
    assert got[1] == (True, [60], [])
    assert got[2] == (True, [61], [61])
    assert got[3] == (True, [62], [])
    assert got[4] == (True, [62], [62])
    assert got[5] == (False, [], [])


def test_copies_are_found_whatever_they_are_made_of(spark, docs):
    filler = " ".join(words(1, 40))
    texts = {
        70: "Compute 12 * (7 + 5) - 3 / 9",
        71: "1 1 2 3 5 8 13 21 34 55 89 144 233 377 610",
        72: "then Anna Berta Carla Doris Erika Frida Greta Hanna Ilona Julia Karla Laura",
        73: "Janet 12 Robert",  # fewer than four tokens
        74: "Paul met Olga near Rome",  # its first word is a name only inside a sentence
    }
    rows = [(k, f"{filler} {text} {filler}") for k, text in texts.items()]
    rows += [(80, f"{filler} {texts[70].replace('12', '13')}"), (81, filler), (82, texts[71].replace(" 21 ", " 22 ")), (83, "12 Robert")]
    got = verdicts(docs(*rows), items(spark, *texts.items()))
    for k in texts:
        assert got[k] == (True, [k], [])
    assert got[80] == got[81] == got[82] == got[83] == (False, [], [])


@pytest.mark.parametrize("times", [2, 3, 5, 40])
@pytest.mark.parametrize("between", ["", "and also", "x y z"])
def test_notices_side_by_side_are_all_found(docs, times, between):
    notice = "Released under the MIT License."
    text = f" {between} ".join([notice] * times)
    (row,) = scan_licenses(docs((1, f"Intro words here. {text} The end."))).collect()
    step = 5 + len(between.split())
    assert [(m["license"], m["start"], m["end"]) for m in row["matches"]] == [("MIT line", 3 + i * step, 8 + i * step) for i in range(times)]


def test_a_text_of_many_notices_ends_soon(docs):
    text = " ".join("Released under the MIT License. Some other words follow here." for _ in range(4000))
    (row,) = scan_licenses(docs((1, text))).collect()
    assert len(row["matches"]) == 4000
