import os
import random

import numpy as np
import pyarrow as pa
import pytest

import graphloom
from graphloom.sources import codec, datasource, turtle
from graphloom.terms import XSD, literal

TTL = '''@prefix ex: <http://e/> .
PREFIX : <http://d#>
ex:alice ex:knows ex:bob , [ ex:name "N\\u00e9"@EN-us ; ] ; a :P ; .
ex:bob ex:age 30 ; ex:w 1.5 , -2e3 ; ex:ok true ; ex:note """two
"lines" """ ; ex:list ( 1 ex:x ) ; ex:d "5"^^ex:t .
_:b ex:p <rel> . # end
[ ex:q ex:r.s ] .
'''


def test_turtle():
    t = list(turtle.parse(TTL, "http://base/"))
    by = {(s.rpartition("/")[2], p.rpartition("/")[2]): o for s, p, o in t}
    assert by["bob", "age"] == f'"30"^^<{XSD}integer>' and by["bob", "ok"] == f'"true"^^<{XSD}boolean>'
    assert by["bob", "note"] == literal('two\n"lines" ') and by["bob", "d"] == '"5"^^<http://e/t>'
    assert ("_:b", "http://e/p", "http://base/rel") in t
    assert [o for _, p, o in t if p == "http://e/name"] == ['"Né"@en-us']
    assert len(t) == 17 and t == list(turtle.parse(TTL, "http://base/"))
    assert set(turtle.parse("".join(turtle.serialize(sorted(t))))) == set(t)


@pytest.mark.parametrize("text", ["<a> <b>", "<a> b:c <d> .", '<a> <b> "x .', '"x" <b> <c> .', "<a> <b> <c>", "@prefix ex <u> ."])
def test_bad_turtle(text):
    with pytest.raises(ValueError):
        list(turtle.parse(text))


def test_crc():
    assert codec.crc32c(b"123456789") == 0xE3069283 and codec.crc16(b"123456789") == 0xBB3D and codec.crc8(b"123456789") == 0xF4
    data = random.Random(1).randbytes(20001)
    c = 0xFFFFFFFF
    for n, x in enumerate(data, 1):
        c = c >> 8 ^ int(codec._C32[(c ^ x) & 255])
        if n in (8191, 8192, 8193, 16384, 16385, 20001):
            assert codec.crc32c(data[:n]) == c ^ 0xFFFFFFFF


def test_codec_round_trip_and_patterns():
    r = random.Random(2)
    term = lambda k: r.choice(["u:é%d", "_:b%d", "u:%d"]) % r.randrange(k)
    rows = {(term(40), f"u:p{r.randrange(5)}", r.choice([term(40), literal("x\ny" * r.randrange(9), None, "en")])) for _ in range(900)}
    g = codec.decode(codec.encode([*rows, *rows]))
    assert len(g) == len(rows) and set(zip(*g.search({}))) == rows
    s, p, o = sorted(rows)[100]
    for fixed in ({"s": s}, {"p": p}, {"o": o}, {"s": s, "p": p}, {"p": p, "o": o}, {"s": s, "o": o}, {"s": s, "p": p, "o": o}, {"s": "none"}):
        want = {t for t in rows if all(t["spo".index(k)] == v for k, v in fixed.items())}
        assert set(zip(*g.search(fixed))) == want
    for k in (0, 1, 127, 128, 300, 1 << 40):
        assert codec.Reader(codec.vbyte(k)).number() == k


def _section(terms):
    body, _ = codec.strings(pa.array(terms, pa.large_binary()))
    return codec.Reader(body).strings()


@pytest.mark.parametrize("long", [1, 120, 127, 128, 129, 16383, 16384, 40000])
def test_sections_of_long_prefixes(long):
    r = random.Random(long)
    terms = sorted({("é" * (long // 2) + "x" * (long % 2) + r.choice(["", "a", "ab"]) + str(r.randrange(90))).encode() for _ in range(70)} | {b"", b"a", b"zz"})
    g = _section(terms)
    assert len(g) == len(terms) and [g.at(i) for i in range(len(terms))] == terms
    assert g.terms(np.array([0, 2])).to_pylist() == [t.decode() for t in (*terms[:16], *terms[32:48])]
    assert [g.find(t.decode()) for t in terms] == list(range(len(terms)))
    assert all(g.find(t.decode() + "!") == -1 for t in terms) and g.find("zzz") == -1
    shared, offsets = [len(os.path.commonprefix(pair)) for pair in zip(terms, terms[1:])], np.cumsum([0, *map(len, terms)])
    assert codec.shared_prefixes(np.frombuffer(b"".join(terms), np.uint8), offsets).tolist() == [0, *shared]


def test_sections_empty_and_damaged():
    g = _section([])
    assert len(g) == 0 and g.find("a") == -1
    starts, body = np.array([0, 4]), np.frombuffer(b"abc\0\x84d\0", np.uint8)  # shares 4 bytes of 3
    with pytest.raises(ValueError):
        codec.Section(2, 16, starts, body).terms(np.array([0]))
    for n, block, at, held in ((2, 0, [0], body), (20, 16, [0], body), (1, 16, [3], body), (17, 16, [0, 99], body), (17, 16, [0, 0], body), (9, 16, [0], body), (1, 16, [0], body[:2]), (1, 16, [0], np.frombuffer(b"\xff\0", np.uint8))):
        with pytest.raises(ValueError):
            section = codec.Section(n, block, np.array(at), held)
            section.terms(np.arange(len(section.starts)))


def test_constant_decodes_one_block(monkeypatch):
    g = codec.decode(codec.encode([(f"u:s{i:04}", "u:p", f'"{i}"') for i in range(2000)]))
    seen, terms = [], codec.Section.terms
    monkeypatch.setattr(codec.Section, "terms", lambda self, blocks: (seen.append(len(blocks)), terms(self, blocks))[1])
    assert list(zip(*g.search({"s": "u:s0777"}))) == [("u:s0777", "u:p", '"777"')] and max(seen) == 1
    seen.clear()
    assert not len(g.search({"s": "u:none"})[0]) and sum(seen) <= 1


def test_damage():
    data = codec.encode([("u:a", "u:p", f'"{i}"') for i in range(50)])
    for bad in (b"", data[:4], data[:-1], b"x" * 99, data[:-6] + b"\xff\xff" + data[-4:]):
        with pytest.raises(ValueError):
            codec.decode(bad)
    for rows in ([], [("u:a", "u:p", '"\0"')]):
        with pytest.raises(ValueError):
            codec.encode(rows)


def test_convert(tmp_path):
    a, b, c, d = (tmp_path / x for x in ("a.ttl", "a.hdt", "b.ttl", "c.hdt"))
    a.write_text(TTL, encoding="utf-8")
    graphloom.ttl2hdt(a, b, base_uri="http://base/")
    graphloom.hdt2ttl(b, c)
    assert set(turtle.parse(c.read_text("utf-8"))) == set(turtle.parse(TTL, "http://base/"))
    graphloom.hdtcat([b, b], d)
    assert d.read_bytes() == b.read_bytes()
    for call in (lambda: graphloom.hdtcat([b], d), lambda: graphloom.hdt2ttl(a, c), lambda: graphloom.ttl2hdt(tmp_path / "none", b), lambda: graphloom.ttl2hdt(b, d)):
        with pytest.raises(ValueError):
            call()


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a.ttl").write_text(TTL, encoding="utf-8")
    rows = spark.read.format("ttl").option("base", "http://base/").load(str(tmp_path / "a.ttl")).select("s", "p", "o")
    out = str(tmp_path / "out")
    for mode in ("append", "overwrite"):
        rows.union(rows).repartition(3, "s").write.format("hdt").mode(mode).save(out)
    files = datasource.listing(out)
    back = datasource.read(spark, "hdt", files, verify="true")
    assert sorted(map(tuple, back.select("s", "p", "o").collect())) == sorted(map(tuple, rows.collect()))
    assert datasource.read(spark, "hdt", [["urn:g", f] for f in files], s="http://e/bob").select("g", "s").distinct().collect() == [("urn:g", "http://e/bob")]
