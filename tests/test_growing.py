import time

import numpy as np
import pytest

from cellweave.operators import matching
from cellweave.operators.matching import FamilyLog, assign, assign_links, best_assignment, families, sparse_assignment


def test_sparse_equals_dense():
    """The same choice, ties included: scores are few, so many choices are equally good."""
    rng = np.random.default_rng(1)
    for n, m, k in ((1, 1, 1), (2, 5, 4), (6, 6, 14), (9, 4, 20), (12, 15, 60), (20, 20, 200)):
        for values in (3, 10_000):
            for _ in range(20):
                gain = np.full((n, m), -np.inf)
                gain.flat[rng.choice(n * m, min(k, n * m), replace=False)] = rng.integers(1, values, min(k, n * m)) / values
                rows, columns = np.nonzero(np.isfinite(gain))
                mixed = rng.permutation(len(rows))
                rows, columns = rows[mixed], columns[mixed]
                got = np.full(n, -1)
                for at in sparse_assignment(rows, columns, gain[rows, columns]):
                    got[rows[at]] = columns[at]
                assert (got == best_assignment(gain)).all()


def test_many_links_of_one_frame():
    """10^5 links, one chain of them a component of 20,001 objects: no matrix, and no search over what isn't reached."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.integers(20_000, 60_000, 80_000), np.arange(10_000), np.arange(10_000)])
    c = np.concatenate([p[:80_000] + rng.integers(0, 2, 80_000), np.arange(10_000), np.arange(1, 10_001)])
    begin = time.time()
    chosen = assign(p, c, rng.random(len(p)), 0.0)
    assert time.time() - begin < 60
    assert len(set(p[chosen])) == len(set(c[chosen])) == len(chosen) > 30_000
    assert assign([], [], [], 0.5) == [] and assign([1, 1], [2, 2], [0.5, 0.7], 0.6) == [1]


def test_links_of_frames(spark):
    rng = np.random.default_rng(4)
    rows = [(int(t), int(p), int(c), float(s)) for t, p, c, s in zip(rng.integers(0, 3, 60), rng.integers(1, 12, 60), rng.integers(1, 12, 60), rng.random(60))]
    rows += [(0, None, 1, 0.9), (0, 1, 1, None), rows[0]]
    links = spark.createDataFrame(rows, "t long, parent_label int, child_label int, score double")
    got = {tuple(r) for r in assign_links(links, 0.3, ("t",)).collect()}
    want = set()
    for t in range(3):
        best: dict = {}
        for _, p, c, s in (r for r in rows if r[0] == t and None not in r):
            best[p, c] = max(s, best.get((p, c), 0.0))
        (ps, cs), ss = np.array(list(best)).T, np.array(list(best.values()))
        want |= {(t, int(ps[k]), int(cs[k]), float(ss[k])) for k in assign(ps, cs, ss, 0.3)}
    assert got == want
    assert assign_links(links.limit(0), 0.3, ("t",)).isEmpty()


def test_families_grow(spark, tmp_path):
    """Parts with links to old branches give the families of all at once; old roots move more than once."""
    log = FamilyLog(spark, str(tmp_path / "log"))
    parts = [([1, 2, 3, 4, 5, 9], [(4, 5)]), ([5, 10, 11], [(3, 4), (10, 11), (9, 11)]), ([20], [(20, 11), (2, 5), (2, 2)]), ([], [(20, 1)]), ([30], [])]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    branches, links = [], []
    for k, (b, pairs) in enumerate(parts):
        b, pairs = [("s", x) for x in b], [("s", *x) for x in pairs]
        log.add(k, frame(b, "sequence_id string, branch_id long"), frame(pairs, "sequence_id string, a long, b long"))
        branches, links = branches + b, links + pairs
    got = {r.branch_id: r.family_id for r in log.families().collect()}
    whole = families(frame(branches, "sequence_id string, branch_id long"), frame(links, "sequence_id string, a long, b long"))
    assert got == {r.branch_id: r.family_id for r in whole.collect()} and got[11] == 1 and got[4] == 2 and log.families().count() == len(got)
    with pytest.raises(ValueError, match="next"):
        log.add(0, frame([], "sequence_id string, branch_id long"), frame([], "sequence_id string, a long, b long"))
    with pytest.raises(ValueError, match="unknown"):
        log.add(5, frame([], "sequence_id string, branch_id long"), frame([("s", 1, 99)], "sequence_id string, a long, b long"))
    assert len(log) == 5 and matching.event_kind(1, 1) is None
