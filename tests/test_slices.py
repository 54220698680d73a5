import numpy as np
import pytest

from strandmill.functions import kmers
from strandmill.operators import slices


@pytest.mark.parametrize("domain", [1, 7, 300, 10_000, 70_000, 1 << 20])
def test_slices_round_trip(domain):
    rng = np.random.default_rng(domain)
    own = []
    for n in (1, 2, domain // 100, domain // 9, domain // 3, domain // 2, domain - domain // 50, domain - 1, domain):
        own.append(np.sort(rng.permutation(domain)[: max(1, min(n, domain))]))
    own += [np.arange(3 * domain // 4, domain), np.arange(0, (domain + 1) // 2), np.array([domain - 1])]
    cuts = np.cumsum([0, *map(len, own)])
    forms, lengths, data = slices.encode(np.concatenate(own), cuts, domain)
    counts = np.diff(cuts)
    assert (slices.lengths_of(forms, counts, np.int64(domain)) == lengths).all() and lengths.sum() == len(data)
    assert (lengths <= np.minimum(counts * 4, -(-domain // 8))).all()
    held = slices.Slices(forms, counts, np.full(len(own), domain), data)
    back, n = held.samples(np.arange(len(own)))
    assert (back == np.concatenate(own)).all() and (n == counts).all()
    some = rng.permutation(len(own))[:5]
    assert (held.samples(some)[0] == np.concatenate([own[i] for i in some])).all()
    asked = np.repeat(np.arange(len(own)), 50), np.tile(rng.integers(0, domain, 50), len(own))
    sets = [set(x.tolist()) for x in own]
    assert (held.hold(*asked) == [s in sets[i] for i, s in zip(*(a.tolist() for a in asked))]).all()
    if domain == 10_000:
        assert set(forms.tolist()) >= {0, 1, slices.BITS, slices.LACKING}


def test_narrow_numbers():
    for top in (0, 255, 256, 70_000, 1 << 33):
        values = np.array([0, top // 2, top])
        assert (slices.widened(slices.narrow(values)) == values).all()
    assert len(slices.widened(slices.narrow(np.zeros(0, np.int64)))) == 0


@pytest.mark.parametrize("canonical", [False, True])
@pytest.mark.parametrize("piece", [16, 37, 1 << 20])
def test_batch_equals_each_record(canonical, piece):
    import pyarrow as pa

    rng = np.random.default_rng(piece)
    records = ["".join(rng.choice(list("ACGTNacgz"), n)) for n in (0, 3, 10, 11, 60, 0, 12, 200, 10, 11)] + [None, "ÄÖ" * 9]
    data, begins = kmers.joined(pa.array(["xx", *records])[1:])
    found = [[] for _ in records]
    for at, record in kmers.batch_positions(data, begins, 11, 2, 1_000_003, canonical, piece):
        for r in np.unique(record).tolist():
            found[r].append(at[:, record == r])
    for own, text in zip(found, records):
        expected = kmers.positions((text or "").encode(), 11, 2, 1_000_003, canonical)
        assert (np.concatenate(own, axis=1) == expected).all() if own else expected.shape[1] == 0
    assert list(kmers.batch_positions(*kmers.joined(pa.array([], pa.string())), 11, 2, 8, canonical, piece)) == []


def test_rice_codes_take_little_room():
    rng = np.random.default_rng(4)
    for mean in (0.3, 5, 343, 10_900, 1 << 20, 1 << 45):
        values = rng.exponential(mean, 2700).astype(np.int64)
        code = slices.rice(values)
        assert (slices.of_rice(code) == values).all()
        # The gaps' entropy is log2(e * mean) about; their bytes take 16 bits for 343, 32 for 10,900.
        assert (len(code) - 6) * 8 <= 2700 * (max(np.log2(np.e * mean), 1.2) + 0.15)
    for values in ([], [0], [0, 0, 0], [(1 << 61) + 5], [0, 1 << 40, 1]):
        assert slices.of_rice(slices.rice(np.array(values, np.int64))).tolist() == values
    assert slices.of_rice(slices.rice(np.append(np.zeros(4000, np.int64), 1 << 30)))[-1] == 1 << 30


def test_lowest_bytes_are_parted_and_woven():
    rng, domain = np.random.default_rng(5), 70_000
    own = [np.sort(rng.permutation(domain)[:n]) for n in (1, 1, 300, domain, 1, 40_000, domain - 3, 2, domain)] + [np.array([domain - 1])]
    forms, lengths, data = slices.encode(np.concatenate(own), np.cumsum([0, *map(len, own)]), domain)
    assert len(set(forms.tolist())) > 3 and not lengths.all()
    rows = np.array([0, 3, 4, 8, 9, 10])  # the row of one slice that all samples have is empty
    low, low_cuts, high, high_cuts = slices.parted(forms, lengths, data, rows)
    places = np.append(0, np.cumsum(lengths))[rows]
    for i, (a, b) in enumerate(zip(rows, rows[1:])):
        back = slices.woven(forms[a:b], lengths[a:b], low[low_cuts[i] : low_cuts[i + 1]].tobytes(), high[high_cuts[i] : high_cuts[i + 1]].tobytes())
        assert (back == data[places[i] : places[i + 1]]).all()
