import itertools
import random

from tallyloom.llm import spaced_seeds


def test_masks_find_every_way_to_substitute():
    for least, family in spaced_seeds.MASKS.items():
        masks = [[j for j, c in enumerate(m) if c == "1"] for m in family]
        for size in {least, 20} if least == 15 else {least}:
            for bad in itertools.combinations(range(size), size // 5):
                assert any(all(i + j not in bad for j in m) for m in masks for i in range(size - m[-1])), (size, bad)
    assert all("0" in m for m in spaced_seeds.ALL_MASKS if len(m) > 2)


def runs(d, q, shift):
    """Of one shift: (n_same, item_start, doc_start, n_tokens) of every stretch of places that a passing window covers."""
    w, found, covered = min(20, len(q)), [], set()
    places = [j for j in range(len(q)) if 0 <= j + shift < len(d)]
    for s in range(min(places) - w, max(places) + 1) if places else ():
        inside = [j for j in range(s, s + w) if j in places]
        if len(inside) == min(w, len(places)) and 100 * sum(d[j + shift] == q[j] for j in inside) >= 80 * w:
            covered.update(inside)
    for j in sorted(covered):
        if j - 1 not in covered:
            found.append([])
        found[-1].append(j)
    for part in found:
        same = [j for j in part if d[j + shift] == q[j]]
        yield len(same), same[0], same[0] + shift, same[-1] + 1 - same[0]


def best_of(docs, items):
    """(doc, item) to the run with most agreeing tokens, the earliest in the item and the document, by trying every shift."""
    out = {}
    for i, text in docs:
        d = (text or "").encode().lower().split()
        for k, item in items:
            q = (item or "").encode().lower().split()
            if i is None or k is None:
                continue
            for shift in range(-len(q) + 1, len(d)):
                for same, at, start, n in runs(d, q, shift):
                    out[i, k] = max(out.get((i, k), (0,)), (same, -at, -start, n))
    return out


def brute(docs, items):
    return set(best_of(docs, items))


def test_against_all_shifts(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 11, 15, 30, 50])))) for k in range(25)] + [(90, None), (None, "a b c d e f g"), (91, ""), (3, "A b C d E f"), (92, "w1 w2 W3"), (93, "w1 w2 W3")]
    docs = [(1000, None), (1001, ""), (None, items[5][1])]
    for k in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 10, 100]))]
        part = items[rng.randrange(25)][1].upper().split()
        part = part[rng.choice([0, 0, 5]) :]
        for _ in range(rng.choice([0, 1, 3, 6, 10])):
            if part:
                part[rng.randrange(len(part))] = "zz"
        at = rng.randrange(len(text) + 1)
        docs.append((k, "\n".join(text[:at] + part + text[at:])))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = spaced_seeds.overlaps(d, q).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id): (r.n_same, -r.item_start, -r.doc_start, r.n_tokens) for r in got} == best_of(docs, items)
    kept = spaced_seeds.decontaminate(d, q)
    assert kept.columns == d.columns
    leaked = {i for i, _ in brute(docs, items)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in leaked), key=str)


def test_passages_cut_by_an_edge(spark):
    long, short = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(15)]
    other = [f"z{k}" for k in range(30)]
    docs = {1: other + long[:16], 2: long[-17:] + other, 3: long[10:26], 4: other + short[:14], 5: short[3:] + other, 6: other + long[:15], 7: other + short[:11], 8: long[:10] + ["zz"] + long[11:16], 9: other + long[:9] + ["zz"] + long[10:17]}
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id long, text string")
    q = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    got = {tuple(r) for r in spaced_seeds.overlaps(d, q).collect()}
    assert got == {(1, 1, 30, 0, 16, 16), (2, 1, 0, 23, 17, 17), (3, 1, 0, 10, 16, 16), (4, 2, 30, 0, 14, 14), (5, 2, 0, 3, 12, 12), (9, 1, 30, 0, 17, 16)}


def test_two_stretches_are_two_runs(spark):
    item = [f"a{k}" for k in range(100)]
    doc = item[:20] + [f"z{k}" for k in range(60)] + item[80:]
    d = spark.createDataFrame([(1, " ".join(["x"] * 7 + doc)), (2, " ".join(item[:20] + ["z"] * 4 + item[24:44]))], "doc_id long, text string")
    q = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(tuple(r) for r in spaced_seeds.overlaps(d, q).collect()) == [(1, 1, 7, 0, 20, 20), (2, 1, 0, 0, 44, 40)]


def test_hot_seeds_and_long_texts(spark, monkeypatch):
    from tallyloom.llm import hot

    monkeypatch.setattr(hot, "SLICE_ROWS", 20)
    monkeypatch.setattr(spaced_seeds, "ITEMS", 3)
    line = [f"c{k}" for k in range(20)]
    items = [(k, " ".join(line + [f"i{k}x{j}" for j in range(k)])) for k in range(8)]
    docs = [(k, " ".join([f"d{k}y{j}" for j in range(5)] + line + [f"e{k}"])) for k in range(100)] + [(500, " ".join(line + [f"n{j}" for j in range(60_000)] + line))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = spaced_seeds.overlaps(d, q).collect()
    assert {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_tokens, r.n_same) for r in got} == {(i, k): (5 if i < 500 else 0, 0, 20, 20) for i, _ in docs for k in range(8)} and len(got) == 808


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert len(spaced_seeds.overlaps(d, q).collect()) == 1
    assert spaced_seeds.overlaps(d.limit(0), q).collect() == [] and spaced_seeds.overlaps(d, q.limit(0)).collect() == []
