"""op5: archives of others, predicates against headers, splits, damage, and a plain reader of what is written."""

import gzip
import io
import random

import pytest

from graphloom.llm import warc

PLAIN = (
    b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Date: 2014-03-02T10:00:00Z\r\nWARC-Record-ID: <urn:uuid:0>\r\ncontent-length: 9\r\n\r\nsoft: x\r\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a.example/\r\n  ?q=1\r\nContent-Type: application/http;\r\n\tmsgtype=response\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 44\r\n\r\nHTTP/1.1 200 OK\r\nServer: s\r\n\r\nbody\r\n\r\nof a page\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Refers-To: <urn:uuid:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nr\r\n\r\n\r\n\r\n",
)
WANT = [
    ("urn:uuid:0", "warcinfo", None, None, None, 9, b"soft: x\r\n"),
    ("urn:uuid:1", "response", "http://a.example/ ?q=1", None, "sha1:ABC", 15, b"body\r\n\r\nof a pa"),
    ("urn:uuid:2", "revisit", None, "urn:uuid:1", None, 0, b""),
    ("urn:uuid:3", "resource", None, None, None, 5, b"r\r\n\r\n"),
]


def rows(df):
    return sorted((r.record_id, r.type, r.uri, r.refers_to, r.digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in df.collect())


def fixed():
    # The second record's length is that of its block.
    head, block = PLAIN[1].split(b"\r\n\r\n", 1)
    block = block[:-4][: 28 + 4 + 15]
    head = head.replace(b"Content-Length: 44", b"Content-Length: %d" % len(block))
    return [PLAIN[0], head + b"\r\n\r\n" + block + b"\r\n\r\n", *PLAIN[2:]]


@pytest.mark.parametrize("form", ["plain", "members", "one member"])
def test_archives_of_others(spark, tmp_path, form):
    records = fixed()
    want = [list(w) for w in WANT]
    want[1][5], want[1][6] = len(records[1]) - records[1].index(b"body") - 4, records[1][records[1].index(b"body") : -4]
    data = b"".join(records) if form == "plain" else b"".join(gzip.compress(r) for r in records) if form == "members" else gzip.compress(b"".join(records))
    name = "a.warc" if form == "plain" else "a.warc.gz"
    (tmp_path / name).write_bytes(data)
    (tmp_path / "_b.warc").write_bytes(b"not committed")
    path = f"file://{tmp_path}"
    assert rows(warc.read(spark, path)) == [tuple(w) for w in want]
    assert rows(warc.read(spark, f"{path}/{name}", payload=False)) == [(*w[:6], None) for w in want]
    assert rows(warc.read(spark, path, kind="response")) == [tuple(want[1])]


def made(spark, path, n=300):
    r = random.Random(4)
    html = lambda i: "<p>" + " ".join(str(r.random()) for _ in range(r.choice([1, 30, 300])))
    pages = [(i, f"http://e.example/{i}" if i % 7 else None, html(i)) for i in range(n)]
    pages += [(n + i, "u", pages[i][2]) for i in range(20)] + [(None, None, "x" * 150), (5, "again", pages[5][2]), (9_000, "long", "long " * 400_000)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, type string, payload_bytes long")
    warc.archive(frame.repartition(3), path)
    return pages


def plain_reader(folder):
    """Records of archives by the specification alone: members, header lines, block."""
    for path in sorted(folder.glob("*.warc.gz")):
        f = io.BytesIO(gzip.decompress(path.read_bytes()))
        while line := f.readline():
            assert line == b"WARC/1.1\r\n"
            head = {}
            while (line := f.readline()) != b"\r\n":
                name, value = line[:-2].decode().split(": ", 1)
                head[name] = value
            block = f.read(int(head["Content-Length"]))
            assert f.read(4) == b"\r\n\r\n"
            yield head, block


def test_written_archives_follow_the_format(spark, tmp_path):
    pages = made(spark, f"file://{tmp_path}/a")
    got = list(plain_reader(tmp_path / "a"))
    assert len(got) == len(pages)
    html = {p: t for p, _, t in pages}
    for head, block in got:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length"} <= set(head)
        http, body = block.split(b"\r\n\r\n", 1)
        if head["WARC-Record-ID"].startswith("<urn:page:"):
            text = html[int(head["WARC-Record-ID"][10:-1])]
            assert body.decode() == ("" if head["WARC-Type"] == "revisit" else text)
            assert f"Content-Length: {len(text)}".encode() in http
        assert (head["WARC-Type"] == "revisit") == ("WARC-Refers-To" in head)


def test_predicates_and_splits_agree_with_headers(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    pages = made(spark, path)
    every = warc.read(spark, path).toPandas()
    assert len(every) == 323 and (every.type == "revisit").sum() == sum(len(t) >= 100 for i, _, t in pages[300:320])
    frame = warc.read(spark, path, payload=False)
    for where in ("type = 'revisit'", "record_id = 'urn:page:7'", "uri is null", "uri is not null and payload_bytes > 700", "refers_to in ('urn:page:1', 'urn:page:2')", "payload_bytes <= 30", "refers_to <=> null", "digest = 'none'", "type = 'response' and uri >= 'http://e.example/2'"):
        plan = frame.where(where)
        want = spark.createDataFrame(every.drop(columns="payload").astype(object).where(every.drop(columns="payload").notna(), None), frame.drop("payload").schema).where(where)
        assert sorted(map(str, plan.drop("payload").collect())) == sorted(map(str, want.collect())), where
    for split in (1, 999, 20_000, 0):
        part = spark.read.format("warc").option("path", path).option("splitBytes", split if split != 1 else 3_000).load()
        assert sorted(part.toPandas().record_id) == sorted(every.record_id)


def test_empty_and_damaged(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(empty, f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0 and warc.read(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(PLAIN[0])[:-20])
    with pytest.raises(Exception, match="d.warc.gz at 0"):
        warc.read(spark, f"file://{tmp_path}/d.warc.gz").collect()
