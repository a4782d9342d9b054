import hashlib

import duckdb

from coterie.llm import preferences

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "a"), (2, 2, "user", "other"), (2, 3, "assistant", "x"), (2, 4, "user", "bye"),
    (3, 0, "user", "hi"), (64, 0, "user", "hi"), (64, 1, "assistant", "only"), (65, 0, "user", "hi"), (65, 1, "assistant", "only"), (65, 1, "assistant", "only"),
    (10, None, "system", None), (10, 0, "user", ""), (11, None, "system", None), (11, 0, None, ""), (12, 5, "user", "x"), (12, 5, "user", "y"),
    (None, 0, "user", "hi"), (20, 0, "user", "alone"), (-5, 0, "user", "é" * 5000), (-6, 0, "user", "é" * 5000), (-6, 1, "assistant", "ü"),
]


def test_against_sql_and_by_hand(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in ROWS], "conv_id long, turn long, role string, text string, side string, part int")
    turns = preferences.turns_of(df)
    out = preferences.format_pairs(turns, preferences.opening_pairs(turns))
    got = sorted(map(tuple, out.collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.execute(preferences.OP3_ORACLE).fetchall(), key=str) == got
    pairs = {(r[0], r[1]) for r in got}
    # ranks in the opening "hi": 64, 1, 65, 2, 3; of each two the one with more assistant characters is chosen
    assert pairs == {(1, 64), (65, 2), (10, 11), (-6, -5)}
    first = [r for r in got if 1 in r[:2]]
    prompt = [r for r in first if r[2] == "prompt"]
    assert len(prompt) == 1 and prompt[0][6] == "<|user|>\nhi<|end|>\n" and prompt[0][7:9] == (0, 0)
    for r in got:
        assert (r[8] > 0) == (r[2] != "prompt" and r[5] == "assistant")
    empty = preferences.turns_of(df.limit(0))
    assert preferences.format_pairs(empty, preferences.opening_pairs(empty)).count() == 0


def test_whole_covers_every_conversation(spark):
    for rows in (ROWS, [r for r in ROWS if r[0] != 20], ROWS[:4]):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        turns = preferences.turns_of(df)
        pairs, alone = preferences.whole_pairs(turns)
        got = sorted(map(tuple, preferences.format_pairs(turns, pairs).union(preferences.format_alone(turns, alone)).collect()), key=str)
        con = duckdb.connect()
        con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        assert sorted(con.execute(preferences.OP3_WHOLE_ORACLE).fetchall(), key=str) == got
        ids = {r[0] for r in rows if r[0] is not None}
        couples = {r[:2] for r in got}
        assert sorted(i for c in couples for i in c if i is not None) == sorted(ids)
        assert sum(c[1] is None for c in couples) == len(ids) % 2
        assert len(rows) == 4 or {(1, 64), (65, 2), (10, 11), (-6, -5)} <= couples
    empty = turns.limit(0)
    pairs, alone = preferences.whole_pairs(empty)
    assert pairs.count() == 0 and alone.count() == 0


def test_whole_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = preferences.op3_preference_formatting_whole(spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert len(got) > 0 and sorted(con.execute(preferences.OP3_WHOLE_ORACLE).fetchall(), key=str) == sorted(map(tuple, got), key=str)


def test_paired_rows_against_sql_and_the_longer_form(spark):
    """One row per turn of a pair holds what the longer form spreads over a row for each side."""
    for rows in (ROWS, [r for r in ROWS if r[0] != 20], ROWS[:4]):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        turns = preferences.turns_of(df)
        pairs, alone = preferences.whole_pairs(turns)
        both = pairs.union(alone.selectExpr("conv_id", "CAST(NULL AS bigint)"))
        got = preferences.format_paired(turns, both).collect()
        con = duckdb.connect()
        con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        assert sorted(con.execute(preferences.OP3_PAIRED_ORACLE).fetchall(), key=str) == sorted(map(tuple, got), key=str)
        spread = []
        for r in got:
            ids, at = (r.chosen_id, r.rejected_id), (r.turn, r.turn_part)
            if r.segment == "prompt":
                assert r.chosen is None and r.rejected is None and r.chosen_loss_end == r.rejected_loss_end == 0
                spread.append((*ids, "prompt", *at, r.prompt, 0, 0, r.n_prompt_turns))
            if r.chosen is not None:
                spread.append((*ids, "chosen", *at, r.chosen, r.chosen_loss_start, r.chosen_loss_end, r.n_prompt_turns))
            if r.rejected is not None:
                spread.append((*ids, "rejected", *at, r.rejected, r.rejected_loss_start, r.rejected_loss_end, r.n_prompt_turns))
        longer = [(*r[:5], *r[6:]) for r in preferences.format_pairs(turns, pairs).union(preferences.format_alone(turns, alone)).collect()]
        assert sorted(spread, key=str) == sorted(longer, key=str)
    assert preferences.format_paired(turns.limit(0), both.limit(0)).count() == 0


def by_hand(rows):
    """Branches, prefixes and rows of the query, told conversation by conversation."""
    convs = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
    for r in sorted({r for r in rows if r[0] is not None}, key=key):
        convs.setdefault(r[0], []).append(r)
    placed = {}
    for i, turns in convs.items():
        count = {}
        placed[i] = []
        for _, turn, role, text in turns:
            count[turn] = count.get(turn, 0) + 1
            placed[i].append(((turn, count[turn]), role, text))
    last = {i: max(k for k, t in enumerate(turns) if t[1] == "assistant") for i, turns in placed.items() if any(t[1] == "assistant" for t in turns)}
    ring = sorted(last, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    out = []
    show = lambda t: f"<|{t[1] or ''}|>\n{t[2] or ''}<|end|>\n"

    def side(t):
        learns = t is not None and t[1] == "assistant"
        return (None if t is None else show(t), len(f"<|{t[1]}|>\n") if learns else 0, len(show(t)) if learns else 0)

    for i, turns in placed.items():
        donor = ring[(ring.index(i) + 1) % len(ring)] if i in last and len(ring) > 1 else None
        other = [] if donor is None else [*turns[: last[i]], (turns[last[i]][0], "assistant", placed[donor][last[donor]][2])]
        a, b = {t[0]: t for t in turns}, {t[0]: t for t in other}
        places = [t[0] for t in turns]
        n = next((k for k, p in enumerate(places) if a.get(p) != b.get(p)), len(places))
        for k, p in enumerate(places):
            if k < n:
                out.append((i, donor, "prompt", *p, show(a[p]), None, 0, 0, None, 0, 0, n))
            else:
                out.append((i, donor, "completion", *p, None, *side(a[p]), *side(b.get(p)), n))
    return sorted(out, key=str)


def test_branches_against_sql_and_by_hand(spark):
    long = [(30, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * (50_000 if k == 7 else 3)) for k in range(400)]
    for rows in (ROWS, ROWS + long, ROWS[:4], [(9, 0, "user", "a"), (9, 1, "assistant", "same"), (8, 0, "user", "b"), (8, 3, "assistant", "same"), (8, 4, "user", "thanks")]):
        df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rejected_id string").repartition(3)
        got = preferences.format_sides(preferences.branched(preferences.turns_of(df))).collect()
        con = duckdb.connect()
        con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        want = con.execute(preferences.OP3_BRANCHED_ORACLE)
        order = [[d[0] for d in want.description].index(c) for c in got[0].__fields__]
        assert sorted([tuple(r[k] for k in order) for r in want.fetchall()], key=str) == sorted(map(tuple, got), key=str) == by_hand(rows)
    empty = preferences.turns_of(df.limit(0))
    assert preferences.format_sides(preferences.branched(empty)).count() == 0


def test_query_has_prompts(spark):
    """On the given table every conversation with a reply has a partner, and prompts are what was said before."""
    sf = "/root/testdata/sf0.001"
    got = preferences.op3_preference_formatting(spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
    replied = {r[0] for r in rows if r[2] == "assistant"}
    assert {r.chosen_id for r in got} == {r[0] for r in rows} and {r.chosen_id for r in got if r.rejected_id is not None} == replied
    assert {r.chosen_id for r in got if r.segment == "prompt"} == {r.chosen_id for r in got if r.rejected_id is not None and r.n_prompt_turns > 0} != set()
