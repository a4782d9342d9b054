import math
import random

import pytest
import sentencepiece
from public_tokenizers import path

from coterie.llm import quality


def brute(text):
    text = text or ""
    words = text.encode().split()
    covered = set()
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    syllables = ["er", "on", "the", "an", "ing", "tion", "re", "st", "ou", "é"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    rows = [(i, prose(rng, words, rng.randint(40, 900)), "en", 1) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "&%$#" for w in prose(rng, words, 200).split()), "en", 1) for i in range(5)]
    rows += [(1100 + i, prose(rng, words, 200).upper().replace(" ", "!! "), "en", 1) for i in range(5)]
    rows += [(1200, None, "en", 1), (1201, "", None, 1), (1202, "nine words are not enough for this rule here", "en", 1), (1203, "a b c d e " * 50, "en", 1)]
    rows += [(1204, "x\nx\n\n \nx\ty\nx", "de", 1), (1205, "漢字 " * 30, None, 1), (None, rows[0][1], "en", 1), (0, rows[0][1], "en", 1), (1206, "word" * 200000, "en", 1), (1207, " a b\x1cc " * 12, "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    return rows, quality.judge(docs).collect()


def test_base_counts(judged):
    rows, out = judged
    want = sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out], key=str) == want
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_verdicts(judged):
    rows, out = judged
    kept = {r.doc_id: r.kept for r in out}
    assert sum(kept[i] for i in range(200)) >= 198
    assert not any(kept[1000 + i] or kept[1100 + i] for i in range(5))
    assert not kept[1200] and not kept[1201] and not kept[1203]


def test_fertility_of_a_whole_text(judged):
    rows, out = judged
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    texts = {i: t for i, t, *_ in rows if i is not None and i < 200}
    for r in out:
        if r.doc_id in texts:
            assert r.n_tokens == len(sp.encode(texts[r.doc_id]))
            assert r.chars_per_token == pytest.approx(r.word_chars / r.n_tokens)


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_copies_and_junk_do_not_shape_the_bands(spark):
    rng = random.Random(5)
    plain, long = ["the", "house", "and", "water", "over", "people", "green", "time"], ["zxqv", "qwrtk", "vbnmz", "kjhgf", "xzcvb"]
    # the share of rare words runs from none to a half, so the measures spread widely
    rows = [(i, " ".join(rng.choice(long if rng.random() < i / 400 else plain) for _ in range(300)), "en") for i in range(200)]
    rows += [(1000 + i, prose(rng, plain + long, 300), "de") for i in range(200)]
    copies = [(2000 + i, rows[100][1], "en") for i in range(200)]
    junk = [(3000 + i, " ".join(["house"] * (300 + i)), "en") for i in range(300)]
    verdicts = []
    for more in ([], copies, junk):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
        verdicts.append({r.doc_id: r.kept for r in quality.judge(docs).where("doc_id < 1000").collect()})
    assert sum(verdicts[0].values()) >= 195
    assert verdicts[1] == verdicts[0] and verdicts[2] == verdicts[0]


def test_verdicts_against_brute_force(spark):
    """Bands and verdicts recomputed from the measures, over all rows of a table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = quality.judge(docs).collect()
    names = list(quality.LEAST_SPREAD)
    groups = {}
    for r in out:
        if not r.base_failed:
            groups.setdefault(r.lang, {})[r.text_hash] = [math.floor(r[c] / quality.GRID + 0.5) for c in names]
    quart = {}
    for g, own in groups.items():
        for k, c in enumerate(names):
            v = sorted(x[k] for x in own.values())
            quart[g, c] = [v[max(0, math.ceil(q * len(v)) - 1)] * quality.GRID for q in (0.25, 0.5, 0.75)]
    wrong = 0
    for r in out:
        want = not r.base_failed
        for c in names if want else ():
            low, mid, high = quart[r.lang, c]
            room = max(high - low, quality.LEAST_SPREAD[c]) * (quality.WIDTH + quality.SHORT_WIDTH * math.sqrt(quality.SHORT_TOKENS / max(r.n_tokens, 1)))
            want &= r[c] - mid >= -room and (c == "entropy" or r[c] - mid <= room)
        wrong += want != r.kept
    assert wrong == 0
    assert sorted(map(str, quality.judge(docs.repartition(7)).collect())) == sorted(map(str, out))


def test_a_row_of_another_language_stays(spark):
    """The same id and text may be kept in one language and rejected in another."""
    rng = random.Random(8)
    plain, other = ["the", "house", "and", "water", "over", "people", "green", "time"], ["zxqv&%", "qwrtk##", "vbnmz$$", "kjhgf**", "xzcvb%%"]
    rows = [(i, prose(rng, plain, 200), "en") for i in range(60)] + [(100 + i, prose(rng, other, 200), "xx") for i in range(60)]
    rows += [(500, rows[70][1], "en"), (500, rows[70][1], "xx"), (500, rows[70][1], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang) for r in quality.keep_rows(docs).collect()]
    assert [x for x in got if x[0] == 500] == [(500, "xx")] * 2


def test_short_texts_are_judged(spark):
    rng = random.Random(8)
    plain = ["the", "house", "and", "water", "over", "people", "green", "time"]
    rows = [(i, prose(rng, plain, 200), "en") for i in range(60)] + [(900, "ǅ♞☃ ⛄♜♝ ♟♚♛ ☂☁☀ ✈✉✂ ♠♡♢ ⚀⚁⚂ ⚃⚄⚅ ♔♕♖ ♗♘♙ ☕☘☠", "en"), (901, "the house and water over people of the green time house", "en")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[900] and kept[901]
