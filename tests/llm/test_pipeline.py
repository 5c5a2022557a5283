import random

import corpus_pipeline
from tests.llm.test_minmax_dedup import brute as near_brute
from tests.llm.test_spaced_seeds import brute as leak_brute


def cut(rows, length=100):
    """Rows (id, text) without strings that start earlier."""
    seen, out = set(), []
    for i, text in sorted(rows):
        data, gone = text.encode(), set()
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone.update(range(s, s + length))
            seen.add(data[s : s + length])
        rest = bytes(b for k, b in enumerate(data) if k not in gone).decode("utf-8", "ignore")
        if rest:
            out.append((i, rest))
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(25)) for k in range(6)]
    shared, rows = [line(60) for _ in range(3)], []
    for k in range(80):
        parts = [line(rng.choice([20, 80, 200]))]
        if rng.random() < 0.3:
            parts.append(rng.choice(shared))
        if rng.random() < 0.15:
            parts.insert(0, rng.choice(items)[1])
        rows.append((k, " ".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(8)] + [(300 + k, rows[k][1] + " tail") for k in range(20, 26)] + [(400, "12 34 !!"), (401, None), (402, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    known = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    single = {i for i, _, _, kept in near_brute(known, 5, 80) if kept}
    left = cut([(i, t) for i, t in known if i in single])
    leaked = {i for i, _ in leak_brute(left, items)}
    wanted = {i: t for i, t in left if i not in leaked}
    assert 0 < len(leaked) and len(single) < len(known)

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(wanted)
    from tallyloom.llm import bpe_stream

    tok = bpe_stream.Tokenizer(bpe_stream.default_vocabulary())
    for i, r in got.items():
        assert b"".join(x.to_bytes(4, "little") for x in r.token_ids) == b"".join(tok.encode(wanted[i]))
        assert (r.lang, r.source, r.n_chars, r.n_tokens) == ("en", "s", len(wanted[i]), len(r.token_ids))


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == []


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    names = ["ranges", "cuts", "other_id", "gone", "again", "place", "id", "v", "lang_pred", "score", "seed", "key", "shifts", "component", "kept", "held_out", "n_tokens"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    text = "some words that are long enough to be repeated as a passage of more than one hundred bytes, again and again and again"
    rows = [(1, text), (2, text), (2, text + " x"), (None, text), (None, None), (3, None), (4, ""), (5, "12 34"), (6, "\u0436\u0449\u044f " * 9), (7, "more words of another kind " * 4000)]
    docs = spark.createDataFrame([(i, t, None if i == 6 else "en", "s", len(t or ""), *names) for i, t in rows], schema).repartition(3)
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left[name] = sorted((r.doc_id or 0, len(r.text or "")) for r in out.collect())
        assert all(r[c] == c for r in out.collect() for c in names)
    assert [i for i, _ in left["language_id"]] == [0, 1, 2, 2, 7]
    assert [i for i, _ in left["near_dedup"]] == [0, 0, 1, 3, 4, 5, 6, 7]
    assert dict(left["suffix_dedup"])[1] == len(text) and dict(left["suffix_dedup"])[7] < 200 and not {3, 4} & set(dict(left["suffix_dedup"]))
    assert len(left["decontamination"]) == len(rows)
    last = corpus_pipeline.tokens(spark, docs, str(tmp_path))
    assert set(names) <= {*last.columns} and last.count() == len(rows)
