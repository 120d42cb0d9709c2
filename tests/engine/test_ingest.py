"""Sources, extraction, chunking, incremental state, and the command line."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone import cli, schema
from quillstone.plans import chunk, compat, config, embed, ingest, render, sync, vision
from quillstone.plans.chunk import Folder, WordTokens, chunk_id_column, chunk_segments, text_segments
from quillstone.plans.embed import HashingEmbedder
from quillstone.schema import ConfigurationError, IngestParams, SchemaError
from quillstone.sources import corpus, discover, extract
from quillstone.sources.store import Snapshots, without
from quillstone.streaming.ingest import record_stream, upsert_stream

DOCUMENT = """---
title: "Fixture Title"
---
# Overview

First *paragraph* with ![pic](img.png) after it.

<div>
dropped
</div>

## Foo

- item one
- item two

### Bar

```python
code here
```

| Name | Value |
| --- | --- |
| alpha | 1 |
| beta | 2 |

Last ![two](b.png)
"""


def segments_of(content, kind=extract.markdown):
    title, segments, omitted = kind(content if isinstance(content, bytes) else content.encode())
    return title, [(s["kind"], s["text"]) for s in segments], segments, omitted


def test_markdown():
    title, shown, segments, _ = segments_of(DOCUMENT)
    assert title == "Fixture Title"
    assert shown == [("prose", "First paragraph with"), ("image", "pic"), ("prose", "after it."), ("prose", "item one"), ("prose", "item two"), ("prose", "code here"), ("table", "Name Value alpha 1 beta 2"), ("prose", "Last"), ("image", "two")]
    assert segments[6]["heading_path"] == ["Overview", "Foo", "Bar"] and json.loads(segments[6]["locator_json"])["line_range"] == [23, 26]
    assert segments_of("# Only *Head*\n\ntext")[0] == "Only Head" and segments_of("Head\n====\n\nx")[0] == "Head"
    assert segments_of("")[1] == [] and segments_of("---\ntitle: a\nno end")[0] is None
    assert segments_of("a [l](u) `c` **b** \\* <http://x.y>\n")[1] == [("prose", "a l c b * http://x.y")]


def test_text():
    assert segments_of("é\t x\n\n y", extract.text)[1] == [("prose", "é x y")]
    assert segments_of("  \n", extract.text)[1] == []
    with pytest.raises(UnicodeDecodeError):
        extract.text(b"\xff\xfe\x00")


def workbook():
    sheet = lambda rows, merge="": f'<worksheet xmlns="{extract._NS["m"]}"><sheetData>' + "".join(f'<row r="{r}">{"".join(cells)}</row>' for r, cells in rows) + f"</sheetData>{merge}</worksheet>"
    s = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    n = lambda ref, v, f="": f'<c r="{ref}">{f"<f>{f}</f>" if f else ""}{f"<v>{v}</v>" if v != "" else ""}</c>'
    one = sheet([(1, [s("A1", "Revenue"), s("B1", "Q1"), s("C1", "Q2")]), (2, [s("A2", "Product"), n("B2", 10), n("C2", 2.5)]), (3, [s("A3", "Total"), n("B3", 10, "B2*1"), n("C3", "", "C2*1")]), (5, [s("A5", "Costs"), s("B5", "Q1")]), (6, [s("A6", "COGS"), n("B6", 4.0)])])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{extract._NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", one)
    return out.getvalue()


def test_workbook():
    _, _, segments, omitted = segments_of(workbook(), extract.workbook)
    blocks = [s for s in segments if s["kind"] == "block"]
    assert [(b["label"], b["header_row"], b["rows"]) for b in blocks] == [("Revenue", ["Revenue", "Q1", "Q2"], [["Product", "10", "2.5"], ["Total", "10", ""]]), ("Costs", ["Costs", "Q1"], [["COGS", "4"]])]
    assert [s["text"] for s in segments if s["kind"] == "formula"] == ["S!B3: =B2*1 -> 10"]
    assert sorted(c for c, _ in omitted) == ["hidden_sheet", "value_unavailable"]


def test_image_headers():
    assert extract.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 20)) == (30, 20)
    assert extract.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    with pytest.raises(ValueError):
        extract.image_size(b"nope")
    webp = lambda kind, data: b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + data
    assert extract.image_size(webp(b"VP8 ", b"\x30\1\0\x9d\x01\x2a" + struct.pack("<HH", 640 | 0x4000, 480))) == (640, 480)
    assert extract.image_size(webp(b"VP8L", b"\x2f" + struct.pack("<I", 639 | 479 << 14 | 1 << 28))) == (640, 480)
    assert extract.image_size(webp(b"VP8X", b"\0\0\0\0" + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"))) == (640, 480)
    assert extract.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x11\x08" + struct.pack(">HH", 48, 64) + bytes(12)) == (64, 48)
    for broken in (webp(b"VP8 ", b"\x30\1\0abc"), webp(b"VP8L", b"\x2f"), webp(b"????", bytes(20)), webp(b"VP8X", b"")):
        with pytest.raises(ValueError):
            extract.image_size(broken)


def test_globs_and_routes(spark):
    for glob, yes, no in (("**/*.md", ["a.md", "x/y/a.md"], ["a.txt"]), ("a?c/*", ["abc/x"], ["abc/x/y", "a/c/x"]), ("x/**", ["x/a/b"], ["y/a"]), ("a+b.md", ["a+b.md"], ["aab.md"])):
        import re

        assert all(re.match(discover.glob_regex(glob), p) for p in yes) and not any(re.match(discover.glob_regex(glob), p) for p in no)
    rows = [("a.MD", b"x", "markdown"), ("b.pdf", b"plain", "pdf"), ("c.txt", b"%PDF-1.4", "pdf"), ("d.docx", b"PK\x03\x04", "excel"), ("e.bin", b"\xff\xd8\xff\xe0", "image"), ("f.webp", b"RIFF\x00\x00\x00\x00WEBP", "image"), ("g.html", b"<p>", None), ("h", b"", None)]
    frame = spark.createDataFrame([(p, bytearray(c), r) for p, c, r in rows], "path string, content binary, want string")
    assert all(r["route"] == r["want"] for r in discover.routed(frame).collect())


def folded(params, *segments, title=None):
    f = Folder(title, params.token_budget, params.prose_overlap_tokens, WordTokens())
    for n, (kind, text, path) in enumerate(segments):
        f.add(extract.segment(n, kind, "markdown", {"line_range": [n + 1, n + 1], "ordinal": n}, text=text, heading_path=path))
    f.flush(False)
    return f


def test_chunker():
    p = IngestParams(token_budget=15, prose_overlap_tokens=3)
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    f = folded(p, ("prose", words("a", 6), ["h"]), ("prose", words("b", 6), ["h"]), ("prose", words("c", 6), ["k"]), ("table", words("t", 40), ["k"]), ("prose", words("d", 40), ["k"]))
    texts = [(d.kind, d.truncated) for d in f.drafts]
    assert texts == [("prose", False), ("prose", False), ("prose", False), ("table", True), ("prose", True)]
    assert f.drafts[1].text.startswith("a3 a4 a5\n\nb0") and not f.drafts[2].text.startswith("b")
    assert all(f.size(d.text) <= 15 for d in f.drafts)
    whole = folded(p, ("prose", "x", []), ("prose", "y", []))
    assert whole.drafts[0].text == "x\n\ny" and whole.drafts[0].locator["line_range"] == [1, 2]
    tight = folded(IngestParams(token_budget=14, prose_overlap_tokens=6), ("prose", words("a", 7), []), ("prose", words("b", 6), []))
    assert tight.drafts[1].text.endswith(words("b", 6)) and tight.size(tight.drafts[1].text) <= 14


def test_block_split():
    f = Folder(None, 16, 0, WordTokens())
    row = lambda n: [f"r{n}", "v"]
    block = extract.segment(0, "block", "sheet", {"sheet": "S"}, label="L", header_row=["h", "g"], rows=[row(i) for i in range(5)] + [["w"] * 30])
    pieces = f.split_block(block)
    assert all(t.startswith("L\nh | g\n") and f.size(t) <= 16 for t, _ in pieces) and pieces[-1][1]
    assert [x for t, cut in pieces if not cut for x in t.split("\n")[2:]] == [f"r{i} | v" for i in range(5)]


def test_identities(spark):
    p = IngestParams()
    assert p.fingerprint() != replace(p, token_budget=100).fingerprint()
    place = {"page": 1}
    one = schema.chunk_id("r", 'a"b\\c.md', "prose", place, 3, "p")
    assert one == spark.range(1).select(chunk_id_column(F.lit("r"), F.lit('a"b\\c.md'), F.lit("prose"), F.lit('{"page":1}'), F.lit(3), F.lit("p")).alias("x")).first()["x"]
    assert schema.model_identity("m", 64) == "m:64" and schema.storable_identity("") == ""
    for bad in ("m", ":3", " :3", "m:x"):
        with pytest.raises(SchemaError):
            schema.storable_identity(bad)


def test_snapshots(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), schema.VISION_CACHE)
    rows = lambda *xs: spark.createDataFrame([(x, "m", "1", f"text {x}", "now") for x in xs], schema.VISION_CACHE)
    assert t.read().count() == 0 and t.bytes() == 0
    t.append(rows("a", "b"))
    t.append(rows("c"))
    keys = ["image_sha256", "model_id", "prompt_version"]
    t.upsert(rows("b", "d").withColumn("text", F.lit("new")), keys)
    assert {r[0]: r[3] for r in t.read().collect()} == {"a": "text a", "b": "new", "c": "text c", "d": "new"}
    assert t.delete("text = 'new'") == 2 and t.delete_ids(rows("a", "zz"), "image_sha256") == 1
    assert t.compact() == 1 and t.read().count() == 1 and t.bytes() > 0
    t.drop()
    assert t.version() is None
    assert without(rows("a").withColumn("text", F.lit(None).cast("string")), "text = 'x'").count() == 1


def test_compatibility(spark):
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "model_identity string")
    compat.verify(of(), "m:3")
    compat.verify(of("m:3", "m:3"), "m:3")
    for chunks, identity in ((of("m:3", "n:3"), "m:3"), (of("m:3", None), "m:3"), (of("", ""), "m:3"), (of("m:3"), None), (of("m:3"), "n:3"), (of("m:3"), ""), (of(), "")):
        with pytest.raises(ConfigurationError):
            compat.verify(chunks, identity)
    with pytest.raises(ConfigurationError):
        compat.verify(spark.range(2), "m:3")


def files(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_incremental_runs(spark, tmp_path):
    root, state, params = tmp_path / "archive", ingest.State(spark, str(tmp_path / "state")), IngestParams(token_budget=60, prose_overlap_tokens=8)
    files(root, ann__a_DOT_md="# T\n\nalpha text here", bob__b_DOT_txt="beta text", top_DOT_txt="top text", bad_DOT_pdf=b"%PDF-1.4 broken", odd_DOT_html="<p>", broken_DOT_xlsx=b"PK\x03\x04 broken")
    go = lambda: ingest.run(spark, [str(root), str(tmp_path / "missing")], state, params)
    one = go()
    assert {r["author"] for r in one.records.collect()} == {"ann", "bob", ""} and one.records.count() == 3
    assert {r["category"]: r["n"] for r in one.omission_counts().collect()} == {"root_unavailable": 1, "unsupported": 2, "failed": 1}
    ids = {r["relative_path"]: r["chunk_id"] for r in one.records.collect()}
    index = Snapshots(spark, str(tmp_path / "index"), schema.CHUNKS)
    terms = Snapshots(spark, str(tmp_path / "terms"), __import__("pyspark").sql.types.StructType.fromDDL("term string, chunk_id string, tf long, doc_len long"))
    done = sync.sync(one.records, one.removed, index, HashingEmbedder(), terms)
    assert (done.added, done.updated, done.deleted, done.total, done.documents) == (3, 0, 0, 3, 3) and terms.read().count() > 5
    two = go()
    done = sync.sync(two.records, two.removed, index, HashingEmbedder(), terms)
    assert (done.added, done.updated, done.unchanged, done.deleted) == (0, 0, 3, 0)
    files(root, ann__a_DOT_md="# T\n\nalpha changed")
    (root / "bob/b.txt").unlink()
    three = go()
    assert {r["chunk_id"] for r in three.removed.collect()} == {ids["bob/b.txt"]} and three.files.get("changed", 0) >= 1
    done = sync.sync(three.records, three.removed, index, HashingEmbedder(), terms)
    assert (done.updated, done.deleted, done.total) == (1, 1, 2)
    assert index.read().where("text LIKE '%changed%'").count() == 1
    four = ingest.run(spark, [str(root)], state, replace(params, token_budget=50))
    assert ids["ann/a.md"] in {r["chunk_id"] for r in four.removed.collect()} and four.records.count() == 2


def test_extraction_isolates_failures(spark):
    rows = [("r", "a.md", "", "h", "markdown", bytearray(b"ok")), ("r", "b.txt", "", "h", "text", bytearray(b"\xff")), ("r", "c.pdf", "", "h", "pdf", bytearray(b""))]
    out = extract.extract(spark.createDataFrame(rows, "root_id string, relative_path string, author string, file_hash string, route string, content binary"))
    assert extract.segments(out).count() == 1
    assert {(r["path"], r["category"]) for r in extract.omissions(out).collect()} == {("r/b.txt", "failed"), ("r/c.pdf", "unsupported")}


def test_text_segments_chunk(spark):
    t = spark.createDataFrame([("r", "a.txt", "", "one two\n\nthree four"), ("r", "b.txt", "", "")], "root_id string, relative_path string, author string, text string")
    got = chunk_segments(text_segments(t, by_paragraph=True), IngestParams(token_budget=50, prose_overlap_tokens=4)).collect()
    assert [(r["text"], r["chunk_index"], r["locator_json"]) for r in got] == [("one two\n\nthree four", 0, '{"line_range":[1,3],"ordinal":0}')]
    with pytest.raises(ConfigurationError):
        chunk_segments(text_segments(t), IngestParams(token_budget=4, prose_overlap_tokens=4))


def test_vision(spark):
    rows = [("s1", 100, 300, None, bytearray(b"a")), ("s2", 300, 300, "values: x", bytearray(b"b")), ("s3", 300, 300, None, bytearray(b"c")), ("s4", 300, 300, None, bytearray(b"d")), ("s4", 300, 300, None, bytearray(b"d")), ("s5", 300, 300, None, bytearray(b"e"))]
    images = spark.createDataFrame(rows, "image_sha256 string, width int, height int, chart_text string, content binary")
    cache = spark.createDataFrame([("s3", "m", "1", "known", "now")], schema.VISION_CACHE)

    def describe(content):
        if content == b"e":
            raise RuntimeError("no")
        return "seen " + content.decode()

    out = vision.resolve(images, cache, describe, "m", "1")
    assert sorted((r["image_sha256"], r["outcome"], r["text"]) for r in out.where("text IS NOT NULL").collect()) == [("s2", "chart", "values: x"), ("s3", "cached", "known"), ("s4", "described", "seen d"), ("s4", "described", "seen d")]
    assert {r["image_sha256"]: r["outcome"] for r in out.collect()}["s5"] == "vision_failed"
    assert vision.cache_rows(out, "m", "1").count() == 1
    assert vision.resolve(images, cache, None, "m", "1").where("outcome = 'vision_unavailable'").count() == 3


def test_profiles(spark):
    p = embed.profile_for("embeddinggemma-300m")
    assert p.max_tokens == 512 and spark.range(1).select(p.document(F.lit("x")).alias("x")).first()["x"] == "title: none | text: x"
    with pytest.raises(ConfigurationError):
        embed.profile_for("nope")


def test_corpus_loader(spark, tmp_path):
    lines = lambda name, rows: (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
    chunk = {"chunk_id": "p/a#1", "publication": "p", "article_id": "a", "article_title": "A", "text": "t"}
    lines("chunks.jsonl", [chunk])
    lines("relevance.jsonl", [{"query_id": "q", "text": "x", "relevant_chunk_ids": ["p/a#1"]}])
    chunks, judged = corpus.load(spark, str(tmp_path))
    assert (chunks.count(), judged.count()) == (1, 1)
    lines("relevance.jsonl", [{"query_id": "q", "text": "x", "relevant_chunk_ids": ["zz"]}])
    with pytest.raises(SchemaError, match="unknown zz"):
        corpus.load(spark, str(tmp_path))


def test_config(tmp_path):
    (tmp_path / config.FILE).write_text('mode = "fts"\ntop_k = 7\n[tags]\na = ["x"]\n')
    c = config.load({"top_k": 3}, {"QUILLSTONE_MODE": "dense"}, tmp_path)
    assert (c.mode, c.top_k, c.tags) == ("dense", 3, {"a": ("x",)})
    for text in ('nope = 1', 'top_k = 0', 'mode = "x"', "tags = 3", "color = 3"):
        (tmp_path / config.FILE).write_text(text)
        with pytest.raises(ConfigurationError):
            config.load({}, {}, tmp_path)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    root = tmp_path / "archive"
    files(root, ann__part_one_DOT_md="# T\n\nmatrix multiplication on accelerators", bob__b_DOT_md="quantum qubits", bob__c_DOT_txt="relational databases")
    monkeypatch.chdir(tmp_path)
    (tmp_path / config.FILE).write_text(f'index_path = "{tmp_path}/ix"\n[tags]\nb = ["bob"]\n')
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["search", "matrix"]) == 1 and "no index" in capsys.readouterr().err
    assert cli.main(["index", "--archive-path", str(root), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["chunks"]["added"] == 3
    assert cli.main(["search", "matrix multiplication", "--json", "--top-k", "2", "--group-by-folder", "--context", "1"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["results"][0]["folder"] == "ann" and tuple(got["results"][0]) == render.RESULT_KEYS and got["results"][0]["locator"]["line_range"] == [3, 3]
    assert cli.main(["search", "qubits", "--tag", "b", "--mode", "fts"]) == 0
    text = capsys.readouterr().out
    assert "[Folder: bob] -> [Doc 1/1: b.md] -> [Chunk #0 | Line 1]" in text and '"quantum qubits"' in text
    assert cli.main(["search", "zzz", "--mode", "fts"]) == 0 and "No results." in capsys.readouterr().out
    assert cli.main(["status", "--json"]) == 0 and json.loads(capsys.readouterr().out)["chunks"] == 3
    assert cli.main(["tags"]) == 0 and capsys.readouterr().out == "b: bob\n"
    assert cli.main(["search", "x", "--tag", "nope"]) == 1
    for bad in (["search", "x", "--top-k", "0"], ["search", "x", "--mmr", "2"], ["nope"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 1


def test_stream_upserts(spark, tmp_path):
    params = IngestParams(token_budget=50, prose_overlap_tokens=4)
    texts = lambda *rows: spark.createDataFrame([("r", p, "", t) for p, t in rows], "root_id string, relative_path string, author string, text string")
    records = lambda *rows: chunk_segments(text_segments(texts(*rows)), params)
    source, index = str(tmp_path / "in"), Snapshots(spark, str(tmp_path / "ix"), schema.CHUNKS)
    shape = records(("a", "x")).schema
    for rows in ((("a.txt", "one"), ("b.txt", "two")), (("a.txt", "one changed"),)):
        records(*rows).write.mode("append").parquet(source)
        upsert_stream(record_stream(spark, source, shape), index, HashingEmbedder(), str(tmp_path / "cp")).awaitTermination()
    assert {r["relative_path"]: r["text"] for r in index.read().withColumn("relative_path", F.element_at(F.split("file_path", "/"), -1)).collect()} == {"a.txt": "one changed", "b.txt": "two"}


def test_nothing_else_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(schema.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and ("quillstone.llm" in p.read_text() or "from .llm" in p.read_text())]


def test_paths_that_differ_by_case_are_two_files(spark, tmp_path):
    for name in ("Note.txt", "note.txt"):
        (tmp_path / name).write_text(name)
    found, _ = discover.discover(spark, [str(tmp_path), str(tmp_path) + "/"])
    assert sorted(r[0] for r in found.select("relative_path").collect()) == ["Note.txt", "note.txt"]


def test_a_title_alone_is_no_change(spark):
    index = spark.createDataFrame([("a", "x", "old"), ("b", "y", "old")], "chunk_id string, text string, title string")
    new = spark.createDataFrame([("a", "x", "new"), ("b", "z", "old"), ("c", None, None)], "chunk_id string, text string, title string")
    assert {r["chunk_id"]: r["change"] for r in sync.diff(new, index).collect()} == {"a": "unchanged", "b": "updated", "c": "added"}


def test_a_chunk_of_many_pages_stands_at_the_first():
    page = lambda n: {"kind": "prose", "text": f"word{n}", "locator_type": "page", "locator_json": f'{{"page":{n}}}', "heading_path": [], "provenance_json": None}
    f = Folder(None, 50, 0, WordTokens())
    for segment in (page(3), page(4)):
        f.add(segment)
    f.flush(False)
    assert [d.locator for d in f.drafts] == [{"page": 3}]


class Plain(WordTokens):
    """The same tokens, counted in whole texts."""

    additive = False


def test_counting_parts_equals_counting_wholes():
    import random

    r = random.Random(4)
    rows = [{"seg_no": i, "kind": r.choice(("prose", "prose", "prose", "table")), "text": " ".join(r.choices(("one", "two,", "three.", "x" * 9), k=r.randint(1, 60))), "locator_type": "markdown", "locator_json": f'{{"line_range":[{i},{i}],"ordinal":{i}}}', "heading_path": [str(i // 9)], "provenance_json": None, "root_id": "r", "relative_path": "p", "author": "", "title": "T t", "file_hash": "h"} for i in range(60)]
    for budget, overlap in ((20, 0), (40, 8), (70, 30), (500, 16)):
        params = IngestParams(token_budget=budget, prose_overlap_tokens=overlap)
        assert list(chunk.fold_file(rows, params, WordTokens())) == list(chunk.fold_file(rows, params, Plain()))


def test_ranked_tokens_fill_a_model():
    import public_tokenizers

    t = chunk.RankTokens(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids, mask, cut = t.padded(["a few words", "longer " * 40], 16, start=1, end=2)
    assert [len(x) for x in ids] == [16, 16] and cut == [1] and mask[1] == [1] * 16 and sum(mask[0]) == 2 + len(t.encode("a few words"))
    assert ids[0][0] == 1 and ids[1][-1] == 2 and t.decode(t.encode("né words")) == "né words"
    f = chunk.Folder(None, 24, 4, t)
    for n in range(6):
        f.add({"kind": "prose", "text": f"a paragraph of words {n}", "locator_type": "markdown", "locator_json": f'{{"line_range":[{n},{n}],"ordinal":{n}}}', "heading_path": [], "provenance_json": None})
    f.flush(False)
    assert len(f.drafts) > 1 and all(f.size(d.text) <= 24 for d in f.drafts)


def test_truncation_is_reported(spark):
    from quillstone.plans import embed

    rows = spark.createDataFrame([("one two",), ("w " * 200,), (None,)], "text string")
    out = embed.measured(rows, "text", WordTokens(), 50)
    assert [r["n_tokens"] for r in out.collect()] == [8, 206, None] and tuple(embed.truncation_report(out).first()) == (3, 1, 206)
    assert embed.progress(rows, 2).collect() == [(2, 3), (3, 3)] and embed.progress(rows.limit(0), 2).count() == 0


def png(width, height, mark=b""):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + bytes(9) + mark


def drawn_book():
    """A workbook with one cell, a picture at B3 and a chart at D1."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006/relationships"
    rels = lambda **t: f'<Relationships xmlns="{pack}">' + "".join(f'<Relationship Id="{k}" Type="x" Target="{v}"/>' for k, v in t.items()) + "</Relationships>"
    d, a, c = (f"http://schemas.openxmlformats.org/drawingml/2006/{x}" for x in ("spreadsheetDrawing", "main", "chart"))
    anchor = lambda col, row, inner: f"<d:twoCellAnchor><d:from><d:col>{col}</d:col><d:row>{row}</d:row></d:from>{inner}</d:twoCellAnchor>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(r1="worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="inlineStr"><is><t>cell</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", rels(r1="../drawings/drawing1.xml"))
        z.writestr("xl/drawings/drawing1.xml", f'<d:wsDr xmlns:d="{d}" xmlns:a="{a}" xmlns:c="{c}" xmlns:r="{rel}">{anchor(1, 2, "<d:pic><d:blipFill><a:blip r:embed=" + chr(34) + "p1" + chr(34) + "/></d:blipFill></d:pic>")}{anchor(3, 0, "<d:graphicFrame><c:chart r:id=" + chr(34) + "c1" + chr(34) + "/></d:graphicFrame>")}</d:wsDr>')
        z.writestr("xl/drawings/_rels/drawing1.xml.rels", rels(p1="../media/image1.png", c1="../charts/chart1.xml"))
        z.writestr("xl/media/image1.png", png(400, 300, b"book"))
        z.writestr("xl/charts/chart1.xml", f'<c:chartSpace xmlns:c="{c}"><c:ser><c:cat><c:strRef><c:f>S!A1:A3</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>S!B1:B3</c:f></c:numRef></c:val></c:ser></c:chartSpace>')
    return out.getvalue()


def test_pictures_and_charts_of_a_workbook():
    _, found, omitted = extract.workbook(drawn_book())
    assert [(s["kind"], s["image_ref"], s["text"], s["locator_json"]) for s in found[1:]] == [("image", "xl/media/image1.png", None, '{"sheet":"S","cell_range":"B3"}'), ("image", "chart", "values: S!B1:B3; categories: S!A1:A3", '{"sheet":"S","cell_range":"D1"}')]
    assert not omitted and extract.member(drawn_book(), "xl/media/image1.png").endswith(b"book")


def test_images_become_figures_once(spark, tmp_path):
    root, state = tmp_path / "archive", ingest.State(spark, str(tmp_path / "state"))
    (root / "ann/img").mkdir(parents=True)
    (root / "ann/img/big.png").write_bytes(png(300, 300, b"big"))
    (root / "ann/img/small.png").write_bytes(png(20, 300))
    (root / "ann/a.md").write_text("# T\n\nbefore ![x](./img/big.png) after\n\n![y](../ann/img/small.png)\n\n![z](img/none.png)\n")
    (root / "b.xlsx").write_bytes(drawn_book())

    def describe(content: bytes) -> str:
        if content.endswith(b"book"):
            raise ValueError("blurred")
        return "seen " + content[-3:].decode()

    params = IngestParams(token_budget=60, prose_overlap_tokens=8, vision_model="m", prompt_version="1")
    one = ingest.run(spark, [str(root)], state, params, describe=describe)
    figures = {(r["relative_path"], r["text"]) for r in one.records.where("chunk_kind = 'figure'").collect()}
    assert figures == {("ann/a.md", "seen big"), ("ann/img/big.png", "seen big"), ("b.xlsx", "values: S!B1:B3; categories: S!A1:A3")}
    order = [r["text"] for r in one.records.where("relative_path = 'ann/a.md'").orderBy("chunk_index").collect()]
    assert order == ["before", "seen big", "after"]
    assert {r["category"]: r["n"] for r in one.omission_counts().collect()} == {"below_threshold": 2, "unreadable": 1, "vision_failed": 1}
    assert (one.vision_requests, one.vision_cache_hits) == (3, 0)
    assert state.tables.read("vision_cache").count() == 1 and len(state.tables._names("CURRENT-")) == 1
    (root / "ann/a.md").write_text("# T\n\nchanged ![x](img/big.png)\n")
    two = ingest.run(spark, [str(root)], state, params, describe=None)
    assert ("ann/a.md", "seen big") in {(r["relative_path"], r["text"]) for r in two.records.where("chunk_kind = 'figure'").collect()}
    assert two.vision_cache_hits == 1 and len(state.tables._names("CURRENT-")) == 2
    assert [json.loads(r["record_json"])["chunk_kind"] for r in ingest.records_of(state.tables.read("chunk_registry"), str(root), "ann/a.md").collect()] == ["prose", "figure"]
    without_one = ingest.run(spark, [str(root)], ingest.State(spark, str(tmp_path / "other")), params)
    assert {r["category"]: r["n"] for r in without_one.omission_counts().collect()} == {"below_threshold": 1, "vision_unavailable": 3}


def test_a_commit_moves_all_tables_or_none(spark, tmp_path):
    from quillstone.schema import StoreError
    from quillstone.sources.store import Bundle

    shape = StructType.fromDDL("a long")
    both = Bundle(spark, str(tmp_path / "both"), {"x": shape, "y": shape})
    row = lambda n: spark.createDataFrame([(n,)], "a long")
    both.commit({"x": row(1), "y": row(1)})
    both.commit({"x": row(2)})
    assert [both.read(n).first()[0] for n in ("x", "y")] == [2, 1]
    bad = row(3).select(F.raise_error(F.lit("no")).cast("long").alias("a"))
    with pytest.raises(StoreError):
        both.commit({"x": row(3), "y": bad})
    assert [both.read(n).first()[0] for n in ("x", "y")] == [2, 1]


def test_styles_are_for_terminals(spark):
    rows = spark.createDataFrame([(0, 0, "f\x1b[31m", ["t"], "[x\x1b7]", 0.5, "text", None)], "query_id int, position int, folder string, tags array<string>, breadcrumb string, score double, text string, expanded_context string")
    plain, bright = (render.search_text(rows, "q", "dense_only", "cpu", True, color) for color in (False, True))
    assert "\x1b" not in plain and "Folder: f [t]" in plain and "[x] [Score: 0.500]" in plain
    from quillstone.functions import text as X

    assert "\x1b[36mFolder: f\x1b[0m" in bright and spark.range(1).select(X.strip_ansi(F.lit(bright)).alias("x")).first()["x"] == plain
    assert render.may_color(False, True, {}) and not any(render.may_color(*x) for x in ((True, True, {}), (False, False, {}), (False, True, {"NO_COLOR": "1"})))


def test_workbooks_by_rows_equal_a_scan_of_each(spark):
    from quillstone.sources import workbook as books

    other = io.BytesIO()
    r = __import__("random").Random(3)
    with zipfile.ZipFile(other, "w") as z:
        cells = [(row, "".join(f'<c r="{extract.column_letters(c)}{row}" t="inlineStr"><is><t>{r.choice(["a", "b c", "", "9"])}</t></is></c>' for c in sorted(r.sample(range(1, 60), 4)))) for row in range(1, 40) if r.random() < 0.7]
        merged = '<mergeCells><mergeCell ref="A41:B44"/><mergeCell ref="C50:D52"/></mergeCells>'
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{extract._NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="M" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        top = '<row r="41"><c r="A41" t="inlineStr"><is><t>top</t></is></c></row><row r="45"><c r="B45"><v>1.5</v></c></row>'
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{extract._NS["m"]}"><sheetData>' + "".join(f'<row r="{n}">{c}</row>' for n, c in cells) + top + f"</sheetData>{merged}</worksheet>")
    contents = {"a.xlsx": workbook(), "b.xlsx": drawn_book(), "c.xlsx": other.getvalue()}
    files = [("r", name, "", "h", "excel", c) for name, c in contents.items()] + [("r", "d.xlsx", "", "h", "excel", b"PK\x03\x04 broken"), ("r", "e.txt", "", "h", "text", b"plain")]
    frame = spark.createDataFrame(files, "root_id string, relative_path string, author string, file_hash string, route string, content binary")
    out = extract.extract(frame).collect()
    names = ("kind", "text", "label", "header_row", "rows", "locator_json", "image_ref")
    for name, content in contents.items():
        got = [tuple(x[n] for n in names) for x in sorted((x for x in out if x["relative_path"] == name and x["omission"] is None), key=lambda x: x["seg_no"])]
        want = [tuple(s[n] for n in names) for s in extract.workbook(content)[1]]
        order = {"B3": 1, "D1": 0}
        if name == "a.xlsx":  # a formula without a stored value is a formula too
            got = [g for g in got if g[1] != "S!C3: =C2*1"]
        if name == "b.xlsx":
            want[1:] = sorted(want[1:], key=lambda w: order[w[5].split('"')[-2]])
        assert got == want, name
    assert sorted((x["relative_path"], x["omission"]) for x in out if x["omission"]) == [("a.xlsx", "hidden_sheet"), ("a.xlsx", "value_unavailable"), ("d.xlsx", "failed")]
    assert [x["text"] for x in out if x["relative_path"] == "e.txt"] == ["plain"]
    named = spark.createDataFrame([(c,) for c in (1, 26, 27, 52, 53, 702, 703, 16384)], "c int").select(books.cell_name(F.lit(7), F.col("c"))).collect()
    assert [x[0] for x in named] == [f"{extract.column_letters(c)}7" for c in (1, 26, 27, 52, 53, 702, 703, 16384)]


def test_folders_that_globs_rule_out_are_not_listed(spark, tmp_path):
    for name in ("a/one.txt", "a/deep/er/two.txt", "b/three.txt", "b/skip/four.txt", "skip/five.txt", "top.txt", "c [x]/six?.txt", "a/deep/er/and/deeper/seven.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda *globs: sorted(r["relative_path"] for r in discover.discover(spark, [str(tmp_path)], *globs)[0].collect())
    everything = ["a/deep/er/and/deeper/seven.txt", "a/deep/er/two.txt", "a/one.txt", "b/skip/four.txt", "b/three.txt", "c [x]/six?.txt", "skip/five.txt", "top.txt"]
    assert names() == everything
    assert sorted(discover.listed(spark, str(tmp_path))[1]) == ["", "a", "a/deep", "b", "b/skip", "c [x]", "skip"]
    _, seen = discover.listed(spark, str(tmp_path), (), ["skip/**", "**/skip/**"])
    assert "skip" not in seen and "b/skip" not in seen and "a" in seen
    assert names([], ["skip/**", "**/skip/**"]) == [n for n in everything if "skip" not in n]
    _, seen = discover.listed(spark, str(tmp_path), ["a/*.txt", "b/**"])
    assert sorted(seen) == ["", "a", "b", "b/skip"]
    assert names(["a/*.txt", "b/**"]) == ["a/one.txt", "b/skip/four.txt", "b/three.txt"]
    assert names(["none/*"]) == [] and names(["*.txt"]) == ["top.txt"]
    for folder, include, exclude, gone in (("a", [], [], False), ("a", ["a/b"], [], False), ("a/b", ["a/b"], [], True), ("a/b", ["**/x"], [], False), ("x/y", ["a/**"], [], True), ("a", [], ["**"], True), ("a", [], ["a/*"], False), ("a/b", [], ["a/**"], False)):
        assert discover.hopeless(folder, include, exclude) == gone, (folder, include, exclude)


def test_a_table_function_chunks_as_the_plan_does(spark):
    from quillstone.plans import tables
    from quillstone.plans.chunk import chunk_segments, text_segments

    words = [" ".join(f"w{i}{k}" for k in range(n)) for i, n in enumerate((3, 40, 90, 7, 260))]
    files = spark.createDataFrame([("r", f"{i}.txt", "a", "\n".join(words[i % 5 :] + words[: i % 3])) for i in range(7)], "root_id string, relative_path string, author string, text string")
    segments = text_segments(files, by_paragraph=True)
    tables.register(spark)
    segments.createOrReplaceTempView("segments_to_chunk")
    got = spark.sql("SELECT * FROM chunk_segments(row => TABLE(segments_to_chunk) PARTITION BY (root_id, relative_path) ORDER BY seg_no, token_budget => 64, overlap => 8)")
    want = chunk_segments(segments, IngestParams(token_budget=64, prose_overlap_tokens=8))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 14
    with pytest.raises(Exception, match="larger than the overlap"):
        spark.sql("SELECT * FROM chunk_segments(row => TABLE(segments_to_chunk) PARTITION BY (root_id, relative_path) ORDER BY seg_no, token_budget => 4, overlap => 8)").collect()
