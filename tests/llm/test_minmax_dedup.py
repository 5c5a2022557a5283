import random

import numpy as np

from tallyloom.llm import minmax_dedup, words


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, width, percent):
    """(id, n, component, kept) of rows with distinct ids, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "one"), (2005, "ONE two"), (2006, "É a"), (2007, "é a")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (4, 5):
        assert rows_of(minmax_dedup.near_duplicates(df, width=width)) == brute(rows, width, 80)


def test_chain_through_members_of_one_bucket(spark):
    # 1-2 and 2-3 are linked, 1-3 is not: the leader of a shared bucket does not reach all its members.
    rng = random.Random(1)
    w = [f"x{rng.random()}" for _ in range(200)]
    rows = [(1, " ".join(w[:160])), (2, " ".join(w[12:172])), (3, " ".join(w[24:184])), (4, " ".join(w[36:196]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(minmax_dedup.near_duplicates(df, width=4)) == brute(rows, 4, 80)


def test_odd_rows(spark):
    text = "a b c d e f g h i j"
    schema = "doc_id long, text string, n long, keys string, kept int"
    df = spark.createDataFrame([(None, text, 1, "k", 0), (7, text, 1, "k", 0), (7, text, 1, "k", 0), (9, text + " k", 1, "k", 0), (3, None, 1, None, 0)], schema)
    got = sorted((tuple(r) for r in minmax_dedup.near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(None, 9, None, True), (7, 9, 7, True), (7, 9, 7, True), (9, 10, 7, False), (3, 0, 3, True)], key=str)
    kept = minmax_dedup.deduplicate(df, width=2)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, None]
    empty = df.limit(0)
    assert minmax_dedup.near_duplicates(empty).collect() == [] and minmax_dedup.deduplicate(empty).collect() == []


def test_id_with_two_texts_links_both_groups(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (8, b)], "doc_id long, text string")
    assert {r.component_id for r in minmax_dedup.near_duplicates(df).collect()} == {1}


def test_words_that_collide_modulo_a_power_of_two_differ():
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = (bytes(97 + (b ^ flip) for b in bits) for flip in (0, 1))
    data = np.frombuffer(one + b" " + other + b" " + one.upper(), np.uint8)
    hashes, _, _, _ = words.word_hashes(data, np.array([0, len(data)]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_recall_of_bands_at_the_bound():
    """Of pairs of sets of likeness 0.8, at most one in a thousand may share no band."""
    rng = np.random.default_rng(3)
    missed = 0
    for size in (20, 60, 300):
        for _ in range(700):
            common = rng.integers(0, 1 << 63, size * 8 // 10 * 2, np.uint64)
            own = rng.integers(0, 1 << 63, (2, len(common) // 8), np.uint64)
            _, _, _, keys = minmax_dedup._set_columns([np.unique(np.concatenate([common, o])) for o in own], minmax_dedup.BANDS, minmax_dedup.ROWS)
            missed += not (keys[0] == keys[1]).any()
    assert missed <= 2


def test_long_texts(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = [w if k % 60 else "x" for k, w in enumerate(long)]  # each change breaks five shingles of 60
    far = [w if (k + 7) % 24 else "y" for k, w in enumerate(long)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((long, near, far, long[::-1]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(df).collect()}
    assert {k: c for k, (_, c) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 3} and got[0][0] == 59_996
