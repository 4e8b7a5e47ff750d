import gzip

import pytest

from tillroll.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(1, "http://a\r\n b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", "WARC/1.1\r\n é"),
         (5, "u", "WARC/1.1\r\n é"), (6, "u", "y" * 100000)], "page_id long, url string, html string")


def test_round_trip_and_revisits(pages):
    rows = warc.archive_round_trip(pages).collect()
    assert {r["kind"] for r in rows} == {"record"}
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows), key=str)
    name = "<urn:page:{}>".format
    assert got == sorted([(name(1), "revisit", name(2), 1), (name(2), "response", None, 1), (name(3), "revisit", name(4), 0),
                          (name(4), "response", None, 0), (name("null"), "revisit", name(2), 1), (name(5), "response", None, 13),
                          (name(5), "response", None, 13), (name(6), "response", None, 100000)], key=str)


def test_least_and_empty(pages):
    rows = warc.archive_round_trip(pages, least=2).collect()
    assert {r["record_type"] for r in rows} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_headers_of_any_length(spark):
    url = "data:text/plain," + "é" * 120_000
    rows = [(1, url, "x"), (2, "u", "x"), (3, url, "y"), (4, url, "y")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    name = "<urn:page:{}>".format
    assert sorted((r["kind"], r["record_id"], r["uri"], r["refers_to"]) for r in got if r["refers_to"]) == [
        ("record", name(1), url, name(2)), ("record", name(3), url, name(4))]
    assert sorted((r["kind"], r["record_id"], r["uri"], r["payload"]) for r in got if not r["refers_to"]) == [
        ("record", name(2), "u", b"x"), ("record", name(4), url, b"y")]


def test_version_lines_among_headers(tmp_path, pages):
    data, whole = records(tmp_path, pages)
    for ahead, end in ((b"x:WARC/1.1\r\n", b""), (b"x:WARC/1.1\r\n", b"\r\n"), (b"x:WARC/1.1\r\n", b"x\r\n"), (b"WARC/1.1\r\n", b"")):
        junk = b"WARC/1.1\r\n" + ahead * 100_000 + end
        got = list(warc.salvage(junk + data))
        assert [g[3] for g in got if g[0] == "record"][-len(whole) + 1:] == [w[3] for w in whole][1:]
        assert sum(g[0] == "record" for g in got) == len(whole)
        assert got[0][1] == 0 and got[-1][2] == len(junk + data) and all(a[2] == b[1] for a, b in zip(got, got[1:]))


def records(tmp_path, pages):
    warc.write_warc(pages.where("page_id <> 6").coalesce(1), f"file://{tmp_path}/w")
    files = [f.read_bytes() for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    data = b"".join(files)
    return data, [w for w in warc.salvage(data)]


def test_salvage_covers_every_byte(tmp_path, pages):
    data, whole = records(tmp_path, pages)
    second, third = whole[1], whole[2]
    broken = data[:second[1] + 40] + b"?" + data[second[1] + 41:]
    cases = {"flip in header": broken, "junk ahead": b"junk" + data, "cut": data[:-7], "lost start": data[10:],
             "flip in block": data[:third[2] - 6] + b"~" + data[third[2] - 5:]}
    for name, bad in cases.items():
        got = list(warc.salvage(bad))
        assert got[0][1] == 0 and got[-1][2] == len(bad), name
        assert all(a[2] == b[1] for a, b in zip(got, got[1:])), name
        assert sum(g[0] == "gap" for g in got) == 1, name
        assert sum(g[0] == "record" for g in got) >= len(whole) - 1 - (name == "junk ahead") + (name == "junk ahead"), name


def test_salvage_of_members(tmp_path, pages):
    data, whole = records(tmp_path, pages)
    members = [gzip.compress(data[a:b]) for _, a, b, _ in whole]
    assert [w[3] for w in warc.salvage(b"".join(members))] == [w[3] for w in whole]
    members[1] = members[1][:20] + b"\0\0\0\0" + members[1][24:]
    got = list(warc.salvage(b"".join(members)))
    assert [g[3] for g in got if g[0] == "record"] == [w[3] for i, w in enumerate(whole) if i != 1]
    gap = next(g for g in got if g[0] == "gap")
    assert (gap[1], gap[2]) == (len(members[0]), len(members[0]) + len(members[1]))


@pytest.mark.parametrize("level", [0, 9])
def test_salvage_inside_a_member(tmp_path, pages, level):
    data, whole = records(tmp_path, pages)
    at = whole[2][2] - 6
    broken = data[:at] + b"~" + data[at + 1:]
    sound = [w[3] for i, w in enumerate(whole) if i != 2]
    member = gzip.compress(broken, level)
    got = list(warc.salvage(b"junk" + member + data))
    assert [g[3] for g in got if g[0] == "record"] == sound + [w[3] for w in whole]
    assert [g[1:3] for g in got if g[0] == "gap"] == [(0, 4), (4, 4 + len(member))]
    assert f"bytes {whole[2][1]} to {whole[2][2]} of its content" in [g[3] for g in got if g[0] == "gap"][1]
    for bad in (member[:-4], member[:-8] + b"\0" * 8, gzip.compress(data + b"x", level)[:-9]):
        want = sound if bad[:-8] == member[:-8] or bad == member[:-4] else [w[3] for w in whole]
        got = list(warc.salvage(bad + gzip.compress(data)))
        found = [g[3] for g in got if g[0] == "record"]
        assert found[-len(whole):] == [w[3] for w in whole] and found[:-len(whole)] == want
        assert got[0][1] == 0 and got[-1][2] == len(bad) + len(gzip.compress(data))
