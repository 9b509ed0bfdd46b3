"""Verified near copies against brute force, and the odd rows."""

import numpy as np

from lexispark.llm.near_copies import near_copies, strata_keys
from lexispark.llm.simhash import keep_first, shingle_hashes

SCHEMA = "doc_id long, text string, fp string, n string, least string, key string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "u", "v", "w", "x", "y") for i, t in rows], SCHEMA)


def brute(rows):
    sets = {i: frozenset(shingle_hashes(t, 5).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            shared, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both == 0 or shared >= 0.8 * both - 1e-9:
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: root(i) for i in ids}


def made(seed=3, n=150):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 3000)}"
    shared = [word() for _ in range(60)]
    bases = [[word() for _ in range(int(rng.integers(12, 250)))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(bases[i % 12])
        for _ in range(int(rng.integers(0, 1 + len(words) // 40 + 1))):
            words[int(rng.integers(0, len(words)))] = word()
        if i % 5 == 0:
            words += shared
        rows.append((i, " ".join(words)))
    return rows + [(900 + i, " ".join([*shared, *[word() for _ in range(100)]])) for i in range(12)]


def test_near_copies_match_brute_force(spark):
    rows = made()
    for hot in (3,):  # small enough that groups go the way of hot ones
        got = {r.doc_id: r.component_id for r in near_copies(frame(spark, rows), hot_rows=hot).collect()}
        want = brute(rows)
        assert {i for i in want if got[i] != want[i]} == set()


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, None), (3, ""), (4, " \t "), (5, text.upper()), (5, text.upper()), (None, text), (None, "a lone line of other words here"), (6, "word " * 30_000), (7, "two words"), (8, "two words")]
    got = sorted(((r.doc_id, r.component_id) for r in near_copies(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 2), (4, 2), (5, 1), (5, 1), (None, 1), (None, None), (6, 6), (7, 7), (8, 7)], key=str)
    assert near_copies(frame(spark, [])).count() == 0


def test_equal_sets_share_all_keys():
    u = np.unique(shingle_hashes(" ".join(map(str, range(500))), 5))
    assert (strata_keys(u, 0.8, 16) == strata_keys(u.copy(), 0.8, 16)).all()
    assert len(strata_keys(u, 0.8, 16)) <= 32 and len(strata_keys(u[:0], 0.8, 16)) == 0


def copies_of_copies(n=3000, seed=5):
    """Each text is a changed copy of one drawn from all before it, so one group has no common head."""
    rng = np.random.default_rng(seed)
    rows = [[f"w{k}" for k in range(80)]]
    for i in range(1, n):
        words = list(rows[int(rng.integers(0, i))])
        for k in rng.integers(0, 80, int(rng.integers(1, 4))):
            words[int(k)] = f"x{rng.integers(0, 10**9)}"
        rows.append(words)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute_matrix(rows, similarity=0.8):
    """Components over all pairs, whose shared shingles are counted by a product of matrices."""
    sets = [np.unique(shingle_hashes(t, 5)) for _, t in rows]
    size = np.array([len(u) for u in sets])
    seen, n = np.unique(np.concatenate(sets), return_counts=True)
    seen, up = seen[n > 1], np.arange(len(rows))
    x = np.zeros((len(rows), len(seen)), np.float32)
    for i, u in enumerate(sets):
        x[i, np.searchsorted(seen, np.intersect1d(u, seen))] = 1
    shared = x @ x.T
    alike = shared >= similarity * (size[:, None] + size - shared) - 1e-9
    np.fill_diagonal(alike, True)
    while True:
        least = np.array([up[a].min() for a in alike])
        if (least == up).all():
            return {i: int(rows[k][0]) for (i, _), k in zip(rows, up)}
        up = least


def test_large_group_of_copies_of_copies(spark):
    rows = copies_of_copies()
    want = brute_matrix(rows)
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, rows)).collect()}
    assert {i for i in want if got[i] != want[i]} == set()


def test_repeats_and_short_texts(spark):
    rng = np.random.default_rng(8)
    words = lambda k: " ".join(f"w{rng.integers(0, 10**9)}" for _ in range(k))
    rows = []
    for i in range(60):  # one set of shingles, other numbers of repeats
        text, line = words(300), words(12) + " "
        rows += [(10 * i, f"{text} {line * 60}"), (10 * i + 1, f"{text} {line * 2}")]
    for i in range(200):  # 4 of 5 shingles
        text = words(9)
        rows += [(5000 + 2 * i, text), (5001 + 2 * i, text.rsplit(" ", 1)[0])]
    want = brute_matrix(rows)
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, rows)).collect()}
    assert {i for i in want if got[i] != want[i]} == set() and len(set(want.values())) == 260


def test_one_row_of_each_class_stays(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(20)) for k in "abcd")
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (5, c), (6, d + " more"), (7, a.upper() + " x"), (None, None), (None, "")]
    df = frame(spark, rows)
    kept = keep_first(df, near_copies(df))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted([(None, b), (5, c), (5, d), (7, a.upper() + " x"), (None, "")], key=str)


def test_batches_for_python_are_bounded(spark, monkeypatch):
    from lexispark.llm import near_copies as module

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before, seen, write = [spark.conf.get(k) for k in keys], set(), module.materialise

    def noted(df, name, **options):
        seen.add(tuple(spark.conf.get(k) for k in keys))
        return write(df, name, **options)

    monkeypatch.setattr(module, "materialise", noted)
    rows = made(n=30)
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, rows), batch_rows=4, batch_size="64k").collect()}
    assert seen == {("4", "64k")}
    assert [spark.conf.get(k) for k in keys] == before
    assert got == brute(rows)
