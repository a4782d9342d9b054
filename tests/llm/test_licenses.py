import random
import re
import time

from coterie.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.decode().split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def distance(a, b):
    """Least edits between a and any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


TEXTS = [
    None, "", "Released under the MIT License.", "x under-the\nMIT  license, CC BY-NC 4.0 and cc by nc", "Licensed under the Apache License, Version 2.0.",
    "apache license version 20", "Redistributions and use of source and binary forms", "GNU Generall Public Licence v3", "All right reserved", "all the rights we reserved",
    "under the mit license " * 50, "Permission is herby granted, free of charge, to any persons obtaining copy", "été under the mit licenseé", "creative commons attribution sharalike",
]


def test_base_against_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x", 1), (None, TEXTS[2], "x", 1), (99, "word " * 100000 + "cc by nc", "", 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, score int")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == sorted([(i, *brute_base(t)) for i, t, *_ in rows], key=str)
    by = {r.doc_id: r for r in got}
    assert by[6].labels == "bsd" and by[7].labels == "gpl" and by[11].labels == "mit" and by[13].labels == "cc-by-sa"
    assert by[8].labels == "all-rights-reserved" and by[9].labels == "" and by[0].score == 0.0
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fuzzy_search_against_edit_distance():
    """Seeds must not lose a notice that is within its edits."""
    rng = random.Random(4)
    scanner = licenses.Scanner()
    letters = "abcdefghijklmnopqrstuvwxyz  "
    for _ in range(400):
        notice, label = rng.choice(licenses.NOTICES)
        s = list(f" {notice} ")
        for _ in range(rng.randint(0, licenses.edits(notice) + 2)):
            at, kind = rng.randrange(1, len(s) - 1), rng.randrange(3)
            if kind == 0:
                s[at] = rng.choice(letters)
            elif kind == 1:
                del s[at]
            else:
                s.insert(at, rng.choice(letters))
        noise = lambda: " ".join("".join(rng.choice(letters[:26]) for _ in range(5)) for _ in range(20))
        text = " " + " ".join((noise() + "".join(s) + noise()).split()) + " "
        got = {x for x, *_ in scanner.spans(text)}
        want = {x for n, x in licenses.NOTICES if distance(f" {n} ", text) <= licenses.edits(n)}
        assert got == want, (text, got, want)


def test_spans():
    text = " foo released under the mit licence bar "
    assert ("mit", 1, 5, 1, 30) in licenses.Scanner().spans(text)


def aligned(pattern, text):
    """All (start, stop, least edits) of substrings of text within one edit distance table per start."""
    out = []
    for i in range(len(text)):
        row = list(range(len(pattern) + 1))
        for j in range(i, min(len(text), i + len(pattern) + 8)):
            new = [row[0] + 1]
            for a, x in enumerate(pattern, 1):
                new.append(min(row[a] + 1, new[a - 1] + 1, row[a - 1] + (x != text[j])))
            row = new
            out.append((i, j + 1, row[-1]))
    return out


def test_all_spans_against_brute_force():
    """Every place within its edits is covered by a span; spans are true, and of one notice share no word."""
    rng = random.Random(9)
    notices = (("released under the mit license", "mit"), ("gnu general public license", "gpl"), ("all rights reserved", "arr"))
    scanner = licenses.Scanner(notices)
    fixed = [" the gnu general public licence gnu general public license x ", " released undr the mit license and so on released under the mit license "]
    for case in range(30):
        if case < len(fixed):
            text = fixed[case]
        else:
            parts = []
            for _ in range(rng.randint(1, 3)):
                s = list(rng.choice(notices)[0])
                for _ in range(rng.randint(0, 3)):
                    at = rng.randrange(len(s))
                    s[at : at + rng.randint(0, 1)] = rng.choice(["", "e", " "])
                parts += ["".join(s), rng.choice(["", "some words", "x"])]
            text = " " + " ".join(" ".join(parts).split()) + " "
        got = scanner.spans(text)
        word_at = lambda k: text.count(" ", 0, k + 1) - 1
        for notice, label in notices:
            whole, k = f" {notice} ", licenses.edits(notice)
            own = sorted((f, e, c) for lab, f, e, c, _ in got if lab == label)
            assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
            close = [(word_at(i), word_at(j - 1 - (text[j - 1] == " ")), d) for i, j, d in aligned(whole, text) if d <= k]
            for f, e, d in close:
                assert any(a <= e and f <= b for a, b, _ in own), (text, label, f, e, own)
            for a, b, c in own:
                assert c == min(d for f, e, d in close if a <= f and e <= b), (text, label, a, b, c)


def test_repeated_notices_take_linear_time():
    text = "under the mit license " * 230_000
    began = time.time()
    n_words, n_base, first, last, base, labels, score, spans = licenses.scan_text(text, licenses.Scanner())
    assert time.time() - began < 5
    assert (n_words, n_base, first, last, base, score) == (920_000, 230_000, 0, 919_996, "mit", 1.0)
    text = "licensed under the mit license " * 1000
    assert len([1 for x in licenses.scan_text(text, licenses.Scanner())[-1] if x["edits"] == 0 and x["label"] == "mit"]) >= 1000


def test_query_gives_spans(spark):
    out = licenses.op6_license_scans(spark, "/root/testdata/sf0.001")
    assert out.columns[-1] == "spans"
    assert all(set(r.labels.split(",")) - {""} == {x.label for x in r.spans} | (set(r.base_labels.split(",")) - {""}) for r in out.collect())
