import gzip
import hashlib
import pathlib

import pytest

from declarium.llm import warc

SAME = "<html>" + "the same page " * 20 + "</html>"
PAGES = [
    (5, "http://Example.com/a", SAME),
    (2, "http://example.com:80/b?x=1#frag", SAME),
    (7, None, SAME),
    (1, "https://other.org", "short"),
    (3, "https://other.org", "short"),
    (8, "not a url", None),
    (9, "http://[bad", ""),
    (10, "http://example.com/a", "é" * 80),
    (11, "http://example.com/ä ö\r\nX: y", "line\r\n\r\nline" * 20),
    (12, "http://big.example/", "0123456789" * 300_000),
    (None, "http://example.com/n", SAME),
    (13, "http://example.com/twice", SAME + "2"),
    (13, "http://example.com/twice", SAME + "2"),
    (None, "http://example.com/nulls", SAME + "3"),
    (None, "http://example.com/nulls", SAME + "3"),
]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in "key digest size row file place name refers_to revisit first shared".split()}).cache()


@pytest.fixture(scope="module")
def folder(pages):
    return warc.write(pages, block=2)


def test_read_back(pages, folder):
    rows = sorted(map(tuple, warc.read_back(pages, folder).collect()), key=repr)
    want, done = [], set()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "")]
        first = min((p for p in ids if p is not None), default=None)
        shared, me = len(raw) >= 100 and len(ids) > 1, (i, html)
        revisit = shared and (i != first or me in done)
        if i == first:
            done.add(me)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert rows == sorted(want, key=repr)


def test_archives_are_warc(folder):
    seen = 0
    for path in pathlib.Path(folder.removeprefix("file:")).glob("*.warc.gz"):
        raw = gzip.decompress(path.read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert rest[size : size + 4] == b"\r\n\r\n"
            raw, seen = rest[size + 4 :], seen + 1
    assert seen == len(PAGES)


def test_lookup_by_url(folder):
    index = warc.CaptureIndex(folder)
    for url in {u for _, u, _ in PAGES} | {"http://nowhere.example/"}:
        key = warc.reversed_key(url)
        want = sorted((i for i, u, _ in PAGES if warc.reversed_key(u) == key), key=repr)
        assert sorted((r["page_id"] for r in index.lookup(url)), key=repr) == want
    big = index.lookup("http://big.example/")[0]
    assert big["payload"] == PAGES[9][2].encode()


def test_keys():
    assert warc.reversed_key("http://www.Example.com:80/A?b#c") == "com,example,www)/A?b"
    assert warc.reversed_key("https://example.com:80") == "com,example:80)/"
    assert warc.reversed_key(None) == warc.reversed_key("") == ""


def test_empty(pages):
    none = pages.limit(0)
    assert warc.read_back(none, warc.write(none)).collect() == []
    assert warc.CaptureIndex(warc.write(none)).lookup("http://example.com/a") == []
