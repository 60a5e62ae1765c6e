"""What a task of the class-conditional models holds at once."""

import tracemalloc

import numpy as np

from mirrorlake.llm import kneser_ney, toxicity


def entries(n, seed):
    keys = np.random.default_rng(seed).integers(0, 1 << 62, n).astype(np.uint64)
    return keys, np.stack([keys % np.uint64(3), keys, keys], axis=1), np.ones((n, 2), np.int64)


def test_a_run_of_counts_is_held_less_than_twice():
    tally = kneser_ney.Tally()
    tracemalloc.start()
    try:
        for k in range(12):
            tally.add(*entries(kneser_ney.RUN // 13, k))
        blocks = list(tally.blocks(1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 110 * kneser_ney.RUN  # bytes an entry, 48 of them in key, ids and plain counts
    ids = np.concatenate([kneser_ney.unpack(data)[0] for _, data in blocks])
    counts = np.concatenate([kneser_ney.unpack(data)[1] for _, data in blocks])
    assert sorted(ids[:, 1].tolist()) == sorted(np.concatenate([entries(kneser_ney.RUN // 13, k)[0] for k in range(12)]).tolist()) and (counts == 1).all()


def test_counts_pass_a_byte_when_runs_are_summed(monkeypatch):
    monkeypatch.setattr(kneser_ney, "RUN", 8)
    tally, key = kneser_ney.Tally(), np.array([5, 9], np.uint64)
    for n in (200, 100, 70_000, 1 << 33, 1):
        tally.add(key, np.stack([key % np.uint64(2), key, key], axis=1), np.array([[n, 0], [0, n]]))
    want = 200 + 100 + 70_000 + (1 << 33) + 1
    found = [kneser_ney.unpack(data) for _, data in tally.blocks(1)]
    assert sorted((int(i[0, 1]), c.sum(0).tolist()) for i, c in [(np.concatenate([f[0] for f in found])[[k]], np.concatenate([f[1] for f in found])[[k]].astype(np.int64)) for k in range(2)]) == [(5, [want, 0]), (9, [0, want])]
    assert list(tally.blocks(1)) == []


def test_the_filter_scores_a_part_of_a_batch_at_once():
    class Model:
        held = []

        def scores(self, hashes, ends):
            self.held.append(len(hashes))
            return np.diff(ends, prepend=-1) / 1e6

    texts = ["", *[f"{'word ' * k}end" for k in range(0, 4000, 10)], "w " * 200_000]
    assert toxicity.below(texts, Model(), 0.002).tolist() == [len(t.split()) + 1 < 2000 for t in texts]
    assert sum(Model.held[:-1]) > 2 * max(Model.held[:-1]) and max(Model.held[:-1]) < toxicity.SCORED_BYTES // 4
    assert toxicity.below([], Model()).tolist() == []
