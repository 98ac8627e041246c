"""Archives: directories with and without ZIP64, ranges, round trip."""

import hashlib
import io
import zipfile

import pytest

from hearthstat.llm import archives


def test_directory_and_zip64(monkeypatch):
    for limit in (None, 100):
        if limit:  # the writer then needs ZIP64 records for a small file
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w") as z:
            z.comment = b"some comment"
            for name in ("a", "archive/é.warc", "c"):
                z.writestr(name, name.encode() * 70)
        members = archives.directory(file, len(file.getvalue()))
        assert list(members) == ["a", "archive/é.warc", "c"]
        for name, (method, header, size, _) in members.items():
            assert method == 0
            assert archives.read_at(file, archives.data_start(file, header), size) == name.encode() * 70
    with pytest.raises(ValueError, match="central directory"):
        archives.directory(io.BytesIO(b"no zip at all" * 9), 117)


def test_records_parse_back():
    raw = archives.record(7, "http://a/ü b\n", "é".encode(), "d", None)
    fields, block = archives.parse_record(raw)
    assert fields["warc-type"] == "response" and block.endswith("é".encode())
    assert "\n" not in fields["warc-target-uri"]
    with pytest.raises(ValueError, match="damaged"):
        archives.parse_record(raw[:-1])


def test_round_trip(spark):
    long = "x" * 100
    rows = [(5, "u", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (3, "u", long), (None, "u", "y" * 200), (8, "u", "é" * 50)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, bytes int, digest string")
    found = archives.round_trip(pages).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = 3 if html == long and i != 3 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert archives.round_trip(pages.limit(0)).count() == 0
