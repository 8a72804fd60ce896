import hashlib
import random

import pytest

from cohortspan.llm import fingerprints
from tests.llm.conftest import documents


def text(seed, n=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgéß", k=rng.randint(1, 9))) for _ in range(n))


def plain_hash(data, i):
    return sum(int(fingerprints.GEAR[data[i - k]]) << k for k in range(16) if i >= k) % 2**32


def test_gear_hashes():
    data = text(1, 30).encode()
    assert [int(h) for h in fingerprints.gear_hashes(data)] == [plain_hash(data, i) for i in range(len(data))]


@pytest.mark.parametrize("n", [0, 1, 5, 100, 3000])
def test_chunks(n):
    data = text(2, n).encode()
    ends = fingerprints.chunk_ends(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and all(0 < s <= fingerprints.LONGEST for s in sizes)
    assert all(s >= fingerprints.SHORTEST for s in sizes[:-1])
    at = 0
    for end in ends[:-1]:
        h, size = plain_hash(data, end - 1), end - at
        bits = fingerprints.STRICT_BITS if size < fingerprints.USUAL else fingerprints.LOOSE_BITS
        assert h < 2 ** (32 - bits) or size == fingerprints.LONGEST
        at = end


def test_a_shift_changes_chunks_nearby_only():
    whole = text(3, 2000)
    a, b = fingerprints.chunk_weights(whole), fingerprints.chunk_weights("some words before " + whole)
    assert fingerprints.containment(a, b) > 0.97
    assert fingerprints.containment(a, fingerprints.chunk_weights(text(4, 2000))) < 0.02
    assert fingerprints.read(fingerprints.written(a)) == a


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        w, e, f = (fingerprints.chunk_weights(x) for x in (t, changed, following))
        digest = hashlib.sha256(changed.encode()).hexdigest()
        out.append((d, len(t), digest, fingerprints.written(w), fingerprints.written(e), fingerprints.containment(w, e), fingerprints.containment(w, f)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("cells", [1, 3, 16])
def test_against_plain_python(spark, odd, none, cells):
    found = fingerprints.compare_with_next(odd, cells).collect()
    assert sorted(repr(tuple(r)) for r in found) == expected([tuple(r) for r in odd.select("doc_id", "text").collect()])
    rows = {i * 7 % 101: text(i, i) for i in range(100)}
    found = fingerprints.compare_with_next(documents(spark, rows), cells).collect()
    assert sorted(repr(tuple(r)) for r in found) == expected(rows.items())
    assert fingerprints.compare_with_next(none, cells).count() == 0


def test_one_document_follows_itself(spark):
    row = fingerprints.compare_with_next(documents(spark, {3: text(9)}), 4).first()
    assert row.near_next == 1.0 and 0.3 < row.near_edited < 0.7
