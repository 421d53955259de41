"""op1: round trip, and salvage of damaged archives."""

import gzip
import hashlib
import io
import random

import pytest

from stavelake.llm import warc

random.seed(2)


def record(i, size=300):
    return warc.make_record("response", f"urn:page:{i}", f"http://x/{i}", random.randbytes(size), None)


def read(data):
    got = list(warc.salvage(io.BytesIO(data)))
    ends = [(a, b) for a, b, _ in got]
    return [int(x["record_id"][9:]) for _, _, x in got if isinstance(x, dict)], [(a, b, x) for a, b, x in got if isinstance(x, str)], ends


@pytest.fixture
def members():
    return [warc.gzip_member(record(i, random.randint(0, 5000))) for i in range(20)]


def test_whole_archives(members):
    assert read(b"".join(members))[:2] == (list(range(20)), [])
    assert read(b"".join(record(i) for i in range(5)))[:2] == (list(range(5)), [])
    mixed = members[0] + record(1) + members[2] + gzip.compress(record(3) + record(4)) + members[5]
    assert read(mixed)[:2] == ([0, 1, 2, 3, 4, 5], [])
    assert read(b"")[:2] == ([], [])


@pytest.mark.parametrize("spot", ["flip", "cut", "junk", "magic", "head", "tail", "two"])
def test_salvage_resumes_after_damage(members, spot):
    place = sum(map(len, members[:7]))
    data = b"".join(members)
    after = place + len(members[7])
    want = [i for i in range(20) if i != 7]
    if spot == "flip":
        data = data[: place + 40] + bytes([data[place + 40] ^ 255]) + data[place + 41 :]
    elif spot == "cut":
        data = data[: place + 25] + data[after:]
        after = place + 25
    elif spot == "junk":
        data, after, want = data[:place] + b"junk \x1f\x8b\x08 WARC/1.0 junk" * 3 + data[place:], place + 66, list(range(20))
    elif spot == "magic":
        data = data[:place] + b"\0" + data[place + 1 :]
    elif spot == "head":
        data, place, after, want = data[9:], 0, len(members[0]) - 9, list(range(1, 20))
    elif spot == "tail":
        place, after, want = len(data) - len(members[19]), len(data) - 9, list(range(20))  # its block is whole
        data = data[:-9]
    else:
        first = sum(map(len, members[:3]))
        data = data[: first + 30] + b"??" + data[first + 32 : place + 30] + b"??" + data[place + 32 :]
        got, gaps, _ = read(data)
        assert got == [i for i in range(20) if i not in (3, 7)] and [g[:2] for g in gaps] == [(first, first + len(members[3])), (place, after)]
        return
    got, gaps, _ = read(data)
    assert got == want and [g[:2] for g in gaps] == [(place, after)]


def test_plain_records_and_broken_digests():
    parts = [record(i) for i in range(6)]
    parts[2] = parts[2].replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:AA", 1)
    parts[4] = parts[4][:100]
    got, gaps, _ = read(b"".join(parts))
    assert got == [0, 1, 3, 5] and len(gaps) == 2
    assert "digest" in gaps[0][2]


def test_broken_member_keeps_its_readable_records():
    whole = gzip.compress(b"".join(record(i, 60_000) for i in range(8)))
    cut = whole[: len(whole) // 2]
    got, gaps, _ = read(cut + warc.gzip_member(record(9)))
    assert got[0] == 0 and got[-1] == 9 and 2 < len(got) < 8 and len(gaps) == 1


def test_round_trip(spark):
    big, other = "x" * 1200, "é" * 600
    rows = [(1, "u", big), (2, None, big), (3, "a b\n", other), (4, "u", None), (5, "u", ""), (6, "u", "s" * 999), (7, "u", "s" * 999), (9, "u", big), (8, "u", other), (None, "u", "n")]
    pages = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, key_ string").repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        to = {1: 9, 2: 9, 3: 8}.get(i)
        assert (got[i].record_type, got[i].refers_to) == ("revisit" if to else "response", to)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_members_are_single(spark, tmp_path):
    """Files as written are gzip once, a member for each record."""
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "d" * 2000)], "page_id long, url string, html string").coalesce(1)
    file = warc.write_archives(warc.plan_records(pages).coalesce(1), str(tmp_path / "out")).first().file
    data = open(file, "rb").read()
    assert gzip.decompress(data).startswith(b"WARC/1.1") and len({e for _, e in read(data)[2]}) == 2


def test_gaps_are_logged_in_the_frame(spark, tmp_path):
    data = b"".join(warc.gzip_member(record(i)) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(data[:10] + b"!" + data[11:])
    got = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "file string")).orderBy("offset").collect()
    assert [r.status for r in got] == ["gap", "record", "record"] and got[0].reason and got[1].payload is not None


def test_lost_records_and_gaps_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(6)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages.withColumn("refers_to", pages.page_id * 0).selectExpr("page_id", "url", "html", "nullif(refers_to, 0) as refers_to"), str(tmp_path / "out"))
    warc.whole(warc.read_archives(manifest), manifest)
    file = manifest.first().file
    data = open(file, "rb").read()
    for broken in (data[:-20], data[: len(data) // 2] + b"\0\0" + data[len(data) // 2 + 2 :], data + b"junk"):
        open(file, "wb").write(broken)
        with pytest.raises(ValueError, match="not whole"):
            warc.whole(warc.read_archives(manifest), manifest)


def test_very_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (3, None, "x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(spark, pages).collect()}
    assert (got[1].payload_bytes, got[1].refers_to, got[2].record_type, got[2].payload_digest) == (6_000_000, 2, "response", hashlib.sha1(("é" * 3_000_000).encode()).hexdigest())
