import re
from collections import Counter
from itertools import permutations

import duckdb
import pandas as pd

from coterie.llm import interactions

WORDS = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, WORDS, "a", 9), (2, WORDS, "a", 9), (3, WORDS, "b", 9), (4, None, None, 9), (5, "", "", 9), (6, "\t\n \x0b\f\r", "a", 9), (7, "same " * 300, "a", 9), (8, WORDS + " $", "a", 9), (9, "ABC " * 250, "b", 9),
    (10, "ABC " * 250 + "|", "b", 9), (11, "a b c é É", None, 9), (12, "Word " + WORDS, "b", 9), (13, "w " * 199 + "x", "b", 9), (13, "w " * 199 + "x", "b", 9), (13, WORDS, "b", 9), (14, " ".join(f"v{i} v{i}" for i in range(100)), "c", 9),
    (15, " ".join(f"v{i} v{i} v{i % 50}" for i in range(100)), "c", 9), (16, "long word " * 200_000, "c", 9), (17, "x" * 1_000_000, "c", 9), (18, "A" + "b" * 49, "c", 9), (19, "A" + "b" * 48, "c", 9), (0, "x" * 1_000_000, "d", 9),
]
LABELS = [(1, 1, 0, "z"), (2, 0, 1, "z"), (3, 1, 1, "z"), (3, 0, 0, "z"), (4, None, 1, "z"), (7, 1, None, "z"), (10, 1, 1, "z"), (99, 1, 1, "z"), (None, 1, 1, "z"), (13, 1, 0, "z")]


def brute(docs, labels):
    """Runs every order over every document, one filter after the other."""
    good, toxic = {i for i, q, _, _ in labels if q == 1 and i is not None}, {i for i, _, t, _ in labels if t == 1 and i is not None}
    fails = []
    for i, text, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        bad["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _, _ in docs)
        fails.append((source or "", i, bad))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(i, bad) for p, i, bad in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(b[f] for _, b in own) - len(gone), sum(b[f] and sum(b.values()) == 1 for _, b in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for key in out:
            if key[0] == part:
                out[key] = [*out[key][:6], shapley[out[key][6]]]
    return sorted((*k, *v) for k, v in out.items())


def test_against_brute_force_and_sql(spark):
    docs = spark.createDataFrame(DOCS + [(None, WORDS, "a", 9), (None, None, "a", 9)], "doc_id long, text string, source string, failed int").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, part string")
    got = sorted(map(tuple, interactions.audit(docs, labels).collect()))
    assert got == brute(DOCS + [(None, WORDS, "a", 9), (None, None, "a", 9)], LABELS)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in DOCS] + [None] * 2, "Int64"), "text": [r[1] for r in DOCS] + [WORDS, None], "source": [r[2] for r in DOCS] + ["a"] * 2}))
    con.register("labels", pd.DataFrame({"doc_id": pd.array([r[0] for r in LABELS], "Int64"), "quality": pd.array([r[1] for r in LABELS], "Int32"), "toxic": pd.array([r[2] for r in LABELS], "Int32")}))
    assert sorted(con.execute(interactions.OP12_ORACLE).fetchall()) == got
    assert len(got) == 600 * len({r[0] for r in got})
    assert interactions.audit(docs.limit(0), labels).count() == 0
    assert {(r.good, r.toxic) for r in interactions.flags(docs, labels.limit(0)).collect()} == {(0, 0)}


def test_words_need_one_exchange(spark):
    """The texts are dealt by document; neither word aggregate shuffles again."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string, failed int").select("doc_id", "text")
    plan = interactions.word_counts(docs.where("text is not null"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.doc_id, r.words, r.distinct_words) for r in interactions.word_counts(docs.where("text is not null")).collect()}
    assert {(1, 250, 250), (5, 0, 0), (6, 0, 0), (7, 300, 1), (13, 200, 2), (13, 250, 250), (16, 400_000, 2), (17, 1, 1)} <= got


def test_one_text_in_a_third_of_all_rows(spark):
    docs = [(i, WORDS if i % 3 == 0 else f"{i} {WORDS}", f"s{i % 2}", 0) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, n int").repartition(8)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, part string")
    assert sorted(map(tuple, interactions.audit(frame, labels).collect())) == brute(docs, LABELS)
