import hashlib

from hypothesis import given, settings, strategies as st

from tillroll.llm import fingerprint as fp


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = (text[:len(text) - half] + after[:half]).encode()
        a, b, c = fp.digest(text.encode()), fp.digest(edited), fp.digest(after.encode())
        out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), a.hex(), b.hex(),
                    fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def test_neighbours_across_partitions(docs, odd_rows):
    got = [tuple(r) for r in fp.fingerprints(docs(odd_rows)).collect()]
    assert sorted(got, key=str) == brute(odd_rows)


def test_one_row_and_none(docs):
    assert [tuple(r) for r in fp.fingerprints(docs([(1, "abcd")])).collect()] == brute([(1, "abcd")])
    assert fp.fingerprints(docs([(1, "a")]).limit(0)).count() == 0


@given(st.binary(max_size=400), st.binary(max_size=400))
@settings(max_examples=100, deadline=None)
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = fp.digest(a), fp.digest(b)
    assert 0 <= fp.likeness(x, y) <= 1 and fp.likeness(x, y) == fp.likeness(y, x) and fp.likeness(x, x) == 1


def test_counts_do_not_depend_on_blocks(monkeypatch):
    data = bytes(range(256)) * 40
    whole = fp.bucket_counts(data)
    monkeypatch.setattr(fp, "_BLOCK", 97)
    assert (fp.bucket_counts(data) == whole).all() and whole.sum() == len(data) - 2
