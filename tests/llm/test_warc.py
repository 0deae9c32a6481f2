import base64
import hashlib
import io
import struct

import pytest
import zstandard

from switchyard.llm import warc as R

SCHEMA = "page_id long, url string, html string, same string, salt int, path string"
ROWS = [
    (1, "http://a/1", "<p>one</p>" * 30), (2, "http://a/2", "<p>one</p>" * 30), (9, "http://a/9", "<p>one</p>" * 30),
    (3, None, None), (4, "http://b/ \né", ""), (None, "http://c", "<p>one</p>" * 30), (None, None, "only null"),
    (5, "x", "short"), (6, "x", "short"), (7, "y", "löng \U0001F600 \x00\r\n\r\nWARC/1.1\r\n" * 50_000), (7, "y", "short"),
    (8, "z", "twice"), (8, "z", "twice"), (8, "w", "twice"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", 3, "p") for r in rows], SCHEMA)


def brute(rows, least=0):
    """Sorted (page_id, bytes, digest, type, refers_to)."""
    groups, out = {}, []
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if len(body) < least:
            out += [(i, len(body), digest, "response", None) for i in ids]
            continue
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out.append((ids[0], len(body), digest, "response", None))
        out += [(i, len(body), digest, "revisit", ids[0]) for i in ids[1:]]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 1, 6, 10_000])
def test_odd_pages(spark, least):
    assert got(R.round_trip(pages(spark).repartition(3), least=least)) == brute(ROWS, least)


def test_hot_payloads_are_salted(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 4)
    rows = [(i, f"u{i % 5}", "hot") for i in range(300)] + [(299, "u4", "hot")] * 20 + [(None, None, "hot")] * 20
    rows += [(1000 + i, "v", f"cold {i // 2}") for i in range(60)]
    dealt = R.dealt_by_payload(pages(spark, rows).repartition(4))
    assert dealt.where("salt > 0").select("salt").distinct().count() > 10
    assert got(R.round_trip(pages(spark, rows).repartition(4))) == brute(rows)


def test_restored_payloads_equal_the_table(spark, tmp_path):
    folder = str(tmp_path / "archives")
    archives = R.write_archives(pages(spark).repartition(2), folder, archive_bytes=2000)
    assert archives.count() > 2
    want = sorted((str(i), (h or "").encode()) for i, _, h in ROWS)
    assert sorted((str(r.page_id), bytes(r.payload)) for r in R.restore(archives, folder).collect()) == want


def test_a_file_opens_with_its_own_dictionary(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><head><title>Page {i}</title></head><body>{'words and ' * (i % 9)}</body></html>") for i in range(4000)]
    folder = tmp_path / "archives"
    (archive,) = R.write_archives(pages(spark, rows).coalesce(1).repartition(1), str(folder)).limit(1).collect()
    data = (folder / archive.path).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == bytes.fromhex("37a430ec")  # a trained dictionary
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    records, rest = [], data[8 + size :]
    while rest:
        frame = opener.decompressobj()
        records.append(frame.decompress(rest))
        rest = frame.unused_data
    assert len(records) == archive.records + 1 and records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    plain = len(zstandard.ZstdCompressor(level=R.LEVEL).compress(records[5]))
    assert len(data) - size < plain * len(records) / 2
    assert records == list(R.read_records(io.BytesIO(data)))
    fields, block = R.parse(records[7])
    assert fields["warc-type"] == "response" and block.startswith(b"HTTP/1.1 200 OK")


def test_damage_is_noticed():
    out = io.BytesIO()
    archive = R.Archive(out)
    archive.add(R.page_record(1, "u", b"payload " * 100, "", None))
    archive.close()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(R.read_records(io.BytesIO(out.getvalue()[:-3])))
    bad = R.page_record(1, "u", b"payload", "", None).replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        R.page_row(*R.parse(bad))


def test_no_pages(spark):
    assert R.round_trip(pages(spark, [])).count() == 0
