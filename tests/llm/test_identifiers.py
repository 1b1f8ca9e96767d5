"""Personal data against brute force with plain regular expressions."""

import random
import re
import time

from stayline.llm.identifiers import find_identifiers

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        v = int(c) * (1 + place % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def by_force(text):
    return sorted(
        (m.start(), place, m.end(), kind)
        for place, (kind, pattern) in enumerate(PLAIN.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    )


def base(rows):
    return {r.doc_id: [tuple(s) for s in r.base] for r in rows}


def test_base_spans_are_those_of_plain_patterns(docs):
    r = random.Random(7)
    parts = [
        "a@b.c", "x.y+z@mail-1.example.com", "a@b", "@", "..@a..b", "a@b.c%d@e.f", "é@ü.de", "1.2.3.4", "255.255.255.255",
        "256.1.1.1", "1.2.3", "001.002.003.0004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112",
        "4111  1111 1111 1111", "+1 (415) 555-0100", "+49.30.123456", "+1", "+12345678901234567", "++1 415 555 01 00", "007", " ", "\n", "𝒳", "-", ".", "5",
    ]
    rows = [(k, "".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randrange(1, 25)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "7 " * 30_000), (1003, "1." * 30_000), (1004, "a" * 200_000 + "@"), (1005, "a@" + "b." * 20_000 + "c"), (1006, "9" * 100_000)]
    found = base(find_identifiers(docs(*rows)).collect())
    assert found == {k: by_force(t) for k, t in rows}


def contexts():
    r = random.Random(3)
    rows = []
    for k in range(12):  # seeds teach the contexts
        rows.append((k, f"please call me at +1 415 555 {1000 + 37 * k} or write. The build took {r.randrange(90)} seconds today."))
    rows.append((50, "ä please call me at 555-0199x today"))
    rows.append((51, "the build took 17 seconds today"))
    rows.append((52, "you may call me at (555-0142)."))
    return rows


def test_contexts_of_seeds_find_what_no_pattern_fits(docs):
    rows = contexts()
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in find_identifiers(docs(*rows)).collect()}
    texts = dict(rows)
    assert found[50] == [(20, 4, 29, "context")] and texts[50][20:29] == "555-0199x"
    (span,) = found[52]
    assert texts[52][span[0] : span[2]] == "555-0142"
    assert found[51] == []
    for k in range(12):
        assert found[k] == by_force(texts[k])


def test_long_words_and_words_beside_digits_are_found(docs):
    rows = contexts()
    # 200 characters; and seeds and words next to other words with digits
    rows.append((60, "please call me at 5" + "a" * 199 + " today"))
    rows += [(70 + k, f"box 7 id user{k}@mail.example.com 9") for k in range(8)] + [(90, "box 7 id AB12 99 box")]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in find_identifiers(docs(*rows)).collect()}
    assert found[60] == [(18, 4, 218, "context")]
    assert found[90] == [(9, 4, 13, "context")]


def test_words_like_keys_are_judged_by_their_contexts(docs):
    r = random.Random(5)
    keys = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(9)]
    rows = [(k, f'the token = "{key}" was sent') for k, key in enumerate(keys[:8])]
    rows += [(20, "the token = hunter2 was sent"), (21, f"one word alone: {keys[8]}"), (22, "a token with 3 parts")]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in find_identifiers(docs(*rows)).collect()}
    assert all(found[k] == [(13, 4, 53, "context")] for k in range(8))
    assert found[20] == [(12, 4, 19, "context")]
    assert found[21] == found[22] == []


def test_a_text_with_very_many_spans(docs):
    n = 100_000
    text = " ".join(f"10.{k // 250 % 250}.{k % 250}.7 {k}x" for k in range(n))
    began = time.monotonic()
    (row,) = find_identifiers(docs((1, text))).collect()
    assert len(row.base) == n
    assert [tuple(s) for s in row.base[-3:]] == by_force(text)[-3:]
    assert time.monotonic() - began < 90


def test_too_few_seeds_find_nothing(docs):
    rows = contexts()[:2] + contexts()[12:]
    found = {r.doc_id: len(r.spans) for r in find_identifiers(docs(*rows)).collect()}
    assert found[50] == found[52] == 0


def test_repeated_and_null_ids_and_no_rows(docs):
    rows = find_identifiers(docs((1, "a@b.c"), (1, "a@b.c"), (None, "1.2.3.4"))).collect()
    assert sorted((r.doc_id or 0, len(r.base)) for r in rows) == [(0, 1), (1, 1), (1, 1)]
    assert find_identifiers(docs()).collect() == []


def test_no_python_runs_on_the_executors(docs):
    plan = find_identifiers(docs((1, "a@b.c")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
