import random

import numpy as np

from wattspark.llm.components import components
from wattspark.llm.embedding_dedup import embedding_dedup
from wattspark.llm.jaccard_join import RTree, _meeting, _packed, _unpacked, bound, count_vector, groups_for, jaccard_classes, need, one_of_each, size_codes, spanning_links


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(600, edges)
    assert got == {x: want[x] for x in {y for e in edges for y in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f"]
    passage = [r.choice(words) for _ in range(60)]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([8, 30, 120, 900]))]
        out.append(" ".join(base))
        for _ in range(r.randrange(5)):
            copy = list(base)
            for _ in range(r.randrange(1, max(2, len(base) // 25))):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
        if r.random() < 0.5:
            out.append(" ".join(base[: len(base) // 2] + passage))
    group = [r.choice(words) for _ in range(80)]
    for _ in range(40):
        copy = list(group)
        for _ in range(2):
            copy[r.randrange(80)] = r.choice(words)
        out.append(" ".join(copy))
    return out + out[5:25]


def test_jaccard_classes_against_brute_force(spark, monkeypatch):
    from wattspark.llm import jaccard_join

    data = texts()
    sets = [shingles(t) for t in data]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(len(data), edges)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(data)], "doc_id long, text string, sig int, n int").repartition(3)
    for most, few in ((512, 8), (3, 2)):  # whole clusters; clusters held against one of theirs; most documents tied
        monkeypatch.setattr(jaccard_join, "MOST_IN_TASK", most)
        monkeypatch.setattr(jaccard_join, "FEW", few)
        got = {r.doc_id: r for r in jaccard_classes(docs).collect()}
        assert len(got) == len(data)
        for i, s in enumerate(sets):
            assert (got[i].n_shingles, got[i].component_id) == (len(s), want[i])
    kept = one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_jaccard_links_of_documents_that_others_stand_for(spark):
    left, right, rest = [], [], []
    for f in range(3):  # ten texts of a task share a passage rare enough for their prefixes; each links only with its turned copy in another task
        passage = " ".join(f"f{f}t{i}" for i in range(12))
        for k in range(10):
            body = " ".join(f"f{f}k{k}p{i}" for i in range(37))
            left.append(f"{passage} {body}")
            right.append(f"{body} {passage}")
            rest += [body + "".join(f" f{f}k{k}u{u}x{i}" for i in range(20)) for u in range(40)]
    data = left + right + rest
    n = len(left)
    sets = [shingles(t) for t in data[: 2 * n + 40]]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert sorted(edges) == [(n + i, i) for i in range(n)]
    rows = spark.sparkContext.parallelize([list(enumerate(left)), list(enumerate(right, n)), list(enumerate(rest, 2 * n))], 3).flatMap(lambda part: part)
    got = {x.doc_id: x.component_id for x in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(data))] == [*range(n), *range(n), *range(2 * n, len(data))]


def test_jaccard_of_little(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in jaccard_classes(docs).collect()]
    assert got.count((3, 3)) == 2 and got.count((None, None)) == 1
    assert jaccard_classes(docs.limit(0)).count() == 0


def test_points_bound_overlaps_and_the_tree_misses_nothing():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 2**63, r.integers(5, 200), dtype=np.uint64)) for _ in range(150)]
    for s in list(sets):
        keep = s[r.random(len(s)) < 0.95]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, 3, dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    both = [(i, j) for i in range(300) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= need(sizes[i], sizes[j])]
    points = np.stack([count_vector(s, 32) for s in sets])
    tree = RTree(points, sizes, leaf=8)
    for i, j in both:
        assert j in tree.partners(points[i], sizes[i])
        a, b = (count_vector(sets[x], groups_for(sizes[x])) for x in (i, j))
        assert bound(a, b) >= len(np.intersect1d(sets[i], sets[j]))
    found = spanning_links(points, sizes, sets)
    assert len({*map(tuple, map(sorted, found))} - {*map(lambda p: tuple(sorted(p)), both)}) == 0
    def join(links):
        root = roots(300, links)
        return sorted([x for x in range(300) if root[x] == c] for c in set(root))

    assert join(found) == join(both)
    allowed = spanning_links(points, sizes)
    root = roots(300, allowed)
    assert len(set(root)) <= len(join(both)) and all(root[i] == root[j] for i, j in both)
    rest = r.random(300) < 0.2  # only links between the sides
    assert join(spanning_links(points, sizes, sets, rest)) == join([(i, j) for i, j in both if rest[i] != rest[j]])


def test_embedding_links_against_brute_force(spark, monkeypatch):
    from wattspark.llm import embedding_dedup as module

    r = np.random.default_rng(7)
    base = r.standard_normal((120, 16))
    vectors = [*base, *(base[:60] + 0.1 * r.standard_normal((60, 16))), *base[:10], *(3 * base[:5]), *(base[0] + 0.05 * r.standard_normal((40, 16)))]
    vectors = [v.astype(np.float32) for v in vectors]
    unit = np.stack([v.astype(float) / np.linalg.norm(v.astype(float)) for v in vectors])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(len(vectors), list(zip(*np.nonzero(near))))
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows = [(i, v.tolist(), 3) for i, v in enumerate(vectors)] + [(1000 + i, v, 3) for i, v in enumerate(odd)] + [(None, vectors[0].tolist(), 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    for homes, radii in ((2048, None), (16, 2.01)):  # plain cells, and full cells dealt over salts in a finer grid
        monkeypatch.setattr(module, "MOST_HOMES", homes)
        got = {x.vec_id: x for x in embedding_dedup(table, cell_radii=radii).collect()}
        for i in range(len(vectors)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(near[i].sum()), want[i], want[i] == i)
        assert all((got[1000 + i].n_links, got[1000 + i].component_id) == (0, 1000 + i) for i in range(len(odd)))
        assert got[None].n_links == 0 and got[None].component_id is None and len(got) == len(rows)
    assert embedding_dedup(table.limit(0)).count() == 0


def test_rows_of_a_shingle_are_parted_by_size():
    def meeting(sigs, least, most, stands):
        low, high = size_codes(np.array(least)).astype(np.int32), size_codes(np.array(most)).astype(np.int32) + 1
        return _meeting(np.full(len(sigs), 7, np.int64), np.array(sigs), low, high, np.zeros(len(sigs), np.uint8), np.array(stands), (75, 100))

    sizes = [100, 120, 60, 58, 20, 20, 21, 22, 23, 24, 25, 26, 27, 28]
    kept, low, high, stands, near, ties = meeting(range(14), sizes, sizes, [False] * 14)
    assert near.tolist() == [[0, 1], [2, 3]]
    assert len(ties) == 9 and {*ties.ravel()} == {*range(4, 14)} and stands.sum() == 1 and len(kept) == 5
    # a row that stands for sizes from 20 to 28 ties one of 35, and one of 15, but not one of 60
    more = meeting([50, 51, 52, 53], [20, 35, 15, 60], [28, 35, 15, 60], [True, False, False, False])
    assert sorted(map(tuple, more[5].tolist())) == [(50, 52), (51, 52)] and not len(more[4])


def test_rows_of_shingles_are_packed_and_places_leave_room():
    r = np.random.default_rng(4)
    n = 300
    rows = [r.integers(0, 2**40, n), r.integers(0, 2**40, n), r.integers(0, 9000, n).astype(np.int32), r.integers(9000, 9999, n).astype(np.int32), r.integers(0, 255, n).astype(np.uint8), r.random(n) < 0.3]
    got = _unpacked(_packed(*rows))
    assert all((a == b).all() for k, (a, b) in enumerate(zip(got, rows)) if k != 3)
    assert (got[3] == np.where(rows[5], rows[3], rows[2] + 1)).all()
    code = np.full(2, size_codes(np.array([100]))[0], np.int32)
    pairs = lambda place: len(_meeting(np.full(2, 7), np.arange(2), code, code + 1, np.array([0, place * 1020 // 100], np.uint8), np.zeros(2, bool), (75, 100))[4])
    assert [pairs(x) for x in (0, 14, 16, 24)] == [1, 1, 0, 0]  # 86 of 100 must be common


def test_one_of_each_of_rows_that_share_an_id(spark):
    a, b = "u v w x y z a b c d", "k l m n o p q r s t"
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (1, b, "x"), (0, b, "x"), (None, a, "x"), (4, "", "x"), (5, None, "x")], "doc_id long, text string, own_mark string").repartition(2)
    got = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (0, b), (None, a), (4, ""), (5, None)], key=str)
    assert one_of_each(docs).columns == docs.columns and one_of_each(docs.limit(0)).count() == 0


def test_order_counts_shingles_and_not_what_else_is_in_their_slots(spark):
    import pyarrow as pa

    from wattspark.llm.jaccard_join import ORDER_SLOTS, _order_table, _outlines
    from wattspark.llm.shingles import sets_of

    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    found = [" ".join(str(r.getrandbits(40)) for _ in range(4000)) + (" " + passage if i % 2 else "") for i in range(60)]
    found += found[:3] + [None, ""]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(found)], "id long, mark long, text string").repartition(3)
    table = _order_table(_outlines(rows))
    every, times = np.unique(np.concatenate(list(sets_of(pa.array(found[:60])))), return_counts=True)
    slots = (every & np.uint64(ORDER_SLOTS - 1)).astype(int)
    rare = np.setdiff1d(slots[times == 1], slots[times > 1])
    # of the copies' own shingles some tasks see two; no slot of other rare shingles is classed, however many share it
    copies = np.unique(np.concatenate(list(sets_of(pa.array(found[:3])))) & np.uint64(ORDER_SLOTS - 1)).astype(int)
    assert len(np.unique(slots[times == 1])) < (times == 1).sum() and not table[np.setdiff1d(rare, copies)].any()
    common = slots[times == 30]
    assert len(common) == 56 and (table[common] >= np.round(4 * np.log2(31))).all()
