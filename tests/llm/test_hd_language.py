import random
import zlib

import numpy as np

from tallyloom.llm import hd_language as h


def plain_vector(text, dim):
    """The sum of trigram vectors, letter by letter."""
    out, symbols = np.zeros(dim), [0]
    for c in text.lower():
        if c.isalpha():
            symbols.append(ord(c))
        elif symbols[-1]:
            symbols.append(0)
    if symbols[-1]:
        symbols.append(0)
    if len(symbols) > 2:
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            out += np.roll(h._letter(a, dim), 2) * np.roll(h._letter(b, dim), 1) * h._letter(c, dim)
    return out


def test_vectors_like_a_plain_loop():
    texts = ["", "Hello, World!", "12 34", "ÉÉ éé", "漢字かな " * 3, "a", "x y", "İ ß"]
    assert np.array_equal(h.document_vectors(texts, 64), np.stack([plain_vector(t, 64) for t in texts]))
    wide = "".join(chr(0x4E00 + k) for k in range(400))
    assert np.array_equal(h.document_vectors([wide, "abc"], 64), np.stack([plain_vector(wide, 64), plain_vector("abc", 64)]))


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    kinds = {"aa": "eta ion shr", "bb": "aou lnd mmi", "cc": "zkq wyx jvv"}
    rows = []
    for k in range(300):
        lang = rng.choice(list(kinds))
        rows.append((k, "".join(rng.choice(kinds[lang]) for _ in range(200)), lang if k % 3 else None, lang))
    rows += [(1000, None, "aa", None), (1001, "12 !", "aa", None), (None, "eta ion shr eta", None, "aa"), (5, "zkqw" * 50, "cc", "cc"), (1002, "zkq wyx jvv " * 5000, None, "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = h.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    for i, _, _, truth in rows[:300]:
        if i != 5:
            assert by_id[i][0].lang_pred == truth
    assert [by_id[i][0].lang_pred for i in (1000, 1001, None, 1002)] == ["und", "und", "aa", "cc"]
    kept = h.keep_known(df)
    assert kept.columns == df.columns and kept.count() == sum(r.lang_pred != "und" and r.score >= h.MIN_SCORE for r in got) < len(rows) - 1


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in h.identify(df).collect()] == [("und", 0.0)]
    assert h.identify(df.limit(0)).collect() == []


def test_texts_with_letters_stay_if_nothing_is_learnt(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in h.keep_known(df).collect()) == [1, 4]
    assert sorted(r.doc_id for r in h.keep_known(df, 0.5).collect()) == [1, 4]
