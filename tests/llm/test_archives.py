"""Archives of others: several WARC members and indexes under any names, plain and gzipped."""

import gzip
import hashlib
import zipfile

import pytest

from loadlens.llm import zip_warc

PLAIN = "path string"


def archive(path, files, indexes, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in {**files, **indexes}.items():
            z.writestr(name, data)


def record(page, payload):
    return zip_warc.warc_record(page, f"http://a b/{page}", payload, hashlib.sha256(payload).hexdigest(), None)


def two_members(tmp_path):
    """One member with gzipped records, one plain; a gzipped index of the first, and one with a header line of the second."""
    packed, plain, lines = b"", b"", {"rec-1.warc.gz": [], "crawl/Part.WARC": []}
    for page in range(40):
        r = record(page, f"payload {page} ".encode() * (page + 1))
        if page % 2:
            g = gzip.compress(r)
            lines["rec-1.warc.gz"].append(zip_warc.cdxj_line(f"http://x.org/{page}", "rec-1.warc.gz", len(packed), len(g), "d"))
            packed += g
        else:
            lines["crawl/Part.WARC"].append(f'org,x)/{page} 2024 {{"offset": {len(plain)}, "length": {len(r)}, "filename": "archive/crawl/Part.WARC"}}')
            plain += r
    indexes = {"indexes/main.cdxj.gz": gzip.compress("\n".join(lines["rec-1.warc.gz"][:7]).encode()) + gzip.compress(("\n" + "\n".join(lines["rec-1.warc.gz"][7:])).encode()), "indexes/other.cdx": "!meta 1\n\n" + "\n".join(lines["crawl/Part.WARC"]) + "\n"}
    return {"archive/rec-1.warc.gz": packed, "archive/crawl/Part.WARC": plain}, indexes


def test_all_members_come_back(spark, tmp_path):
    files, indexes = two_members(tmp_path)
    archive(tmp_path / "a.wacz", {**files, "datapackage.json": "{}", "pages/pages.jsonl": ""}, indexes)
    rows = zip_warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], PLAIN), keep_payload=True).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in rows) == [(p, f"payload {p} ".encode() * (p + 1)) for p in range(40)]


@pytest.mark.parametrize(("drop", "why"), [("archive/", "no stored WARC member"), ("indexes/", "no stored index"), ("indexes/other", "no index names"), ("archive/crawl", "which is not there")])
def test_what_is_missing_is_told(tmp_path, drop, why):
    files, indexes = two_members(tmp_path)
    archive(tmp_path / "a.wacz", *({n: d for n, d in part.items() if not n.startswith(drop)} for part in (files, indexes)))
    data = (tmp_path / "a.wacz").read_bytes()
    read = lambda at, n: data[at : at + n]
    with pytest.raises(ValueError, match=why):
        zip_warc.index_entries(zip_warc.members(read, len(data)), read)


def test_index_lines_are_sorted_by_address():
    assert zip_warc.cdxj_line("http://WWW.Ex.org/a b", "f", 1, 2, "d").startswith("org,ex,www)/a%20b 19700101000000 {")
    assert zip_warc.cdxj_line(None, "f", 1, 2, "d").startswith(")/ 19700101000000 {")
