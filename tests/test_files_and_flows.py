"""Readers, the sink that leaves equal tables alone, and the streaming flows."""

import io
import json
import zipfile

from lexispark.sources.files import feed_entries, key_values, library_files, opf_metadata, opf_spine, write_if_changed, zip_entries
from lexispark.streaming.flows import last_opened, log_lines, refresh, upload_states

OPF = '<package xmlns:dc="x"><metadata><dc:title> A\n Tale</dc:title><dc:title>Two</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bo</dc:creator></metadata><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="zz"/><itemref idref="a"/></spine></package>'
FEED = '<feed><entry><title>T</title><link href="/x" type="text/html"/><link href="/t.epub" type="application/epub+zip"/></entry><entry><title>No link</title></entry></feed>'


def test_library_and_containers(spark, tmp_path):
    deep = tmp_path / "a/b/c/d/e/f"
    deep.mkdir(parents=True)
    for p in (tmp_path / "a/one.epub", tmp_path / "a/.two.epub", tmp_path / "a/b/three.TXT", tmp_path / "a/x.xtch", deep / "far.txt"):
        p.write_bytes(b"data")
    (tmp_path / "a/empty.md").write_bytes(b"")
    assert {r.path for r in library_files(spark, str(tmp_path)).collect()} == {"a/one.epub", "a/b/three.TXT"}
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("content.opf", OPF)
        z.writestr("a.html", "x" * 10)
    (tmp_path / "a/one.epub").write_bytes(made.getvalue())
    got = {r.entry: (r.size, r.content) for r in zip_entries(spark, str(tmp_path), r"\.opf$").collect()}
    assert got["a.html"] == (10, None) and bytes(got["content.opf"][1]).decode() == OPF and len(got) == 2


def test_semistructured(spark, tmp_path):
    df = spark.createDataFrame([(1, OPF), (2, None)], "id int, xml string")
    assert {(r.id, r.title, r.author) for r in opf_metadata(df).collect()} == {(1, "A Tale", "Ann, Bo"), (2, None, None)}
    assert [(r.idx, r.href) for r in opf_spine(df, ["id"]).orderBy("idx").collect()] == [(0, "b.html"), (2, "a.html")]
    assert [(r.title, r.href) for r in feed_entries(spark.createDataFrame([(1, FEED)], "id int, xml string"), ["id"]).collect()] == [("T", "/t.epub")]
    (tmp_path / "en.yaml").write_text('A_KEY: "a value"\n# note\nB: "x"\n')
    assert {tuple(r) for r in key_values(spark, str(tmp_path)).collect()} == {("A_KEY", "a value"), ("B", "x")}


def test_write_if_changed(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "t")
    assert [write_if_changed(df, path), write_if_changed(df, path), write_if_changed(spark.range(6), path)] == [True, False, True]
    assert spark.read.parquet(path).count() == 6


def run(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_flows(spark, tmp_path):
    logs, msgs = tmp_path / "logs", tmp_path / "msgs"
    logs.mkdir(), msgs.mkdir()
    (logs / "a.txt").write_text("Error one\nerror noise\nfine\n")
    assert [r.line for r in run(spark, log_lines(spark, str(logs), "error", "noise"), "l", "append")] == ["Error one"]
    rows = [("a", 1, "START", 10), ("a", 2, "BIN", 4), ("a", 3, "BIN", 6), ("b", 1, "BIN", 1), ("c", 1, "START", 3), ("c", 2, "BIN", 9), ("d", 1, "START", 5)]
    (msgs / "m.json").write_text("\n".join(json.dumps(dict(zip(("client", "seq", "kind", "size"), r))) for r in rows))
    stream = spark.readStream.schema("client string, seq long, kind string, size long").json(str(msgs))
    assert {(r.client, r.state) for r in run(spark, upload_states(stream), "u", "update")} == {("a", "DONE"), ("b", "ERROR"), ("c", "ERROR"), ("d", "RECEIVING")}
    assert {(r.client, r.seq) for r in run(spark, last_opened(stream, "client", "seq"), "r", "complete")} == {("a", 3), ("b", 1), ("c", 2), ("d", 1)}
    books = stream.selectExpr("client AS path", "seq AS mtime", "size")
    refresh(books, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {(r.path, r.mtime) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 3), ("b", 1), ("c", 2), ("d", 1)}


def test_containers_with_faults(spark, tmp_path):
    import zipfile

    from lexispark.sources.files import zip_entries

    with zipfile.ZipFile(tmp_path / "a.epub", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", "x" * 500)
        z.writestr("bad.txt", "some other text " * 50)
    raw = bytearray((tmp_path / "a.epub").read_bytes())
    at = raw.find(b"bad.txt") + len("bad.txt")
    raw[at : at + 8] = b"\xff" * 8
    (tmp_path / "a.epub").write_bytes(bytes(raw))
    (tmp_path / "b.epub").write_bytes(b"no container")
    got = {r["entry"]: r["content"] for r in zip_entries(spark, str(tmp_path), "txt").collect()}
    assert bytes(got["good.txt"]) == b"x" * 500 and got["bad.txt"] is None and len(got) == 2


def test_repeated_manifest_ids(spark):
    from lexispark.sources.files import opf_spine

    xml = '<package><manifest><item id="a" href="1.x"/><item id="a" href="2.x"/><item id="b" href="3.x"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="zz"/></spine></package>'
    rows = opf_spine(spark.createDataFrame([(1, xml), (2, None)], "id int, xml string"), ["id"]).collect()
    assert [(r["idx"], r["href"]) for r in rows] == [(0, "3.x"), (1, "1.x")]


def test_stardict(spark, tmp_path):
    import struct

    from lexispark.sources.files import stardict

    (tmp_path / "d.ifo").write_text("wordcount=2\n")
    (tmp_path / "d.idx").write_bytes(b"".join(w.encode() + b"\0" + struct.pack(">II", a, n) for w, a, n in [("apple", 0, 5), ("été", 5, 7)]) + b"cut")
    (tmp_path / "d.syn").write_bytes(b"apples\0" + struct.pack(">I", 0))
    (tmp_path / "e.ifo").write_text("idxoffsetbits=64\n")
    (tmp_path / "e.idx").write_bytes(b"x\0" + struct.pack(">QI", 0, 1))
    index, synonyms = stardict(spark, str(tmp_path))
    assert [(r["ordinal"], r["headword"], r["at"], r["size"]) for r in index.orderBy("ordinal").collect()] == [(0, "apple", 0, 5), (1, "été", 5, 7)]
    hop = synonyms.join(index, ["path", "ordinal"]).first()
    assert (hop["word"], hop["headword"]) == ("apples", "apple")


def test_compose_and_repair(spark):
    from pyspark.sql import functions as F

    from lexispark.functions.unicode import compose_nfc, repair_utf8

    rows = [("e\u0301 U\u031b\u0301", b"ab\xffc"), ("plain", b"\xed\xa0\x80"), (None, None), ("\u1112\u1161\u11ab", b"\xc3\xa9")]
    got = spark.createDataFrame(rows, "t string, b binary").select(compose_nfc(F.col("t")), repair_utf8(F.col("b"))).collect()
    assert [r[0] for r in got] == ["\u00e9 \u1ee8", "plain", None, "\ud55c"] and got[0][1] == "ab\ufffdc" and got[3][1] == "\u00e9" and "\ufffd" in got[1][1]
