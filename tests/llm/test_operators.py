"""Inner parts of the operators: parsers, sorters, formats, bounds."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import anchors, chat, html, packing, suffixsort, tokens, warc
from corpusloom.llm.queries import byte_bpe, tokenizer_path


def test_chat_round_trip(spark):
    texts = ["plain", "", None, r"\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\", "\\\\/", "a\\#b", "####", "<\\/turn>", "### ", ": :", "x</turn", "\n", "</turn>" * 3, "\\:\\/\\#", "🙂 </turn>\n"]
    rows = [(k, t, "assistant" if t % 2 else "us: er\\", x) for k in range(2) for t, x in enumerate(texts)]
    rows += [(9, None, None, None), (9, 1, "assistant", "y"), (9, 1, "assistant", "y"), (None, 1, "user", "no id")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: r for r in chat.format_chat(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for k in range(2):
        got = [(t["role"], t["text"]) for t in out[k]["parsed"]]
        assert got == [("assistant" if t % 2 else "us: er\\", x or "") for t, x in enumerate(texts)]
        assert out[k]["loss"] == "".join(x or "" for t, x in enumerate(texts) if t % 2)
    assert out[9]["n_turns"] == 3 and out[9]["loss"] == "yy" and out[None]["n_turns"] == 1
    assert chat.format_chat(df.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.digest(chat.format_chat(df)).first()
    assert r["n_turns"] == 20_000 and r["loss_chars"] == sum(len(str(k)) for k in range(1, 20_000, 2))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" ▁abthe<s>/\n\té梦🙂\x00\xa0", max_size=60))
def test_counts_equal_the_librarys(text):
    import sentencepiece

    global _model
    try:
        _model
    except NameError:
        _model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert tokens.counter(tokenizer_path("piece_bpe_32k.model")).count(text) == len(_model.encode(text))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc 'sté梦ⅷ²🙂\x85‍　<|endoftext|>", max_size=80))
def test_ids_equal_the_librarys(text):
    e = packing.encoder(*byte_bpe())
    assert e.ids(text).tolist() == e.slow.encode(text, add_special_tokens=False).ids


def test_best_fit_and_its_bound():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 65, int(rng.integers(1, 300)))
        bins, offsets, fill = packing.best_fit(n, 64)
        assert fill.max() <= 64 and np.bincount(bins, n).tolist() == fill.tolist()
        bound = packing.lower_bound(np.bincount(n, minlength=65), 64)
        assert bound <= len(fill) <= 1.3 * bound + 1
    assert packing.lower_bound(np.bincount([33] * 7, minlength=65), 64) == 7  # no two fit


def test_difference_cover_sort():
    rng = np.random.default_rng(0)
    for t in range(60):
        text = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 300))).astype(np.uint8)
        if t % 3 == 0:
            text = np.tile(text[:20], 15)
        depth = int(rng.integers(32, 100))
        places = np.flatnonzero(rng.random(len(text)) < 0.8)
        if len(places):
            s = suffixsort.SuffixSorter(text, depth)
            got = np.concatenate(list(s.buckets(places, bucket=40)))
            keys = [(text.tobytes() + bytes(depth))[i : i + depth] for i in got]
            assert sorted(got.tolist()) == places.tolist() and keys == sorted(keys)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=150), min_size=1, max_size=4), st.integers(8, 60))
def test_equal_windows_have_equal_anchors(texts, length):
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw])
    key, anchor, first, last = anchors.runs(data, ends, length)
    seen, count = {}, 0
    for k, a, i, j in zip(key.tolist(), anchor.tolist(), first.tolist(), last.tolist(), strict=True):
        for p in range(i, j + 1):
            count += 1
            assert seen.setdefault(data[p : p + length].tobytes(), (k, a - p)) == (k, a - p)
    assert count == sum(max(0, len(t) - length + 1) for t in raw)


@pytest.mark.parametrize("most", [warc.BROADCAST_PAYLOADS, 0])
def test_warc_files(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", most)
    page = "<html>" + "x" * 200
    rows = [(3, "http://a", page), (1, "http://b\r\nc", page), (2, None, page), (4, "http://d", "tiny"), (5, "http://e", "tiny"), (6, None, None), (6, None, None), (None, "http://f", page), (1, "http://b", page), (7, "http://g", "é" * 99)]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "page_id long, url string, html string, kind string, n int")
    manifest = warc.write_archives(df, archive_bytes=900)
    out = warc.read_archives(manifest).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out), key=repr)
    want = [(3, "revisit", 1, 206), (1, "response", None, 206), (1, "response", None, 206), (2, "revisit", 1, 206), (None, "revisit", 1, 206), (4, "response", None, 4), (5, "response", None, 4), (6, "response", None, 0), (6, "response", None, 0), (7, "response", None, 198)]
    assert got == sorted(want, key=repr) and manifest.count() > 1
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_a_large_payload_and_what_a_revisit_names(spark):
    big = "<p>é" * (4 << 20)
    df = spark.createDataFrame([(1, "http://a b", big), (2, "http://c", big), (3, None, "x" * 100), (4, "http://d", "x" * 100)], "page_id long, url string, html string")
    manifest = warc.write_archives(df)
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_archives(manifest).collect()}
    assert got == {1: ("response", 5 * (4 << 20), None), 2: ("revisit", 5 * (4 << 20), 1), 3: ("response", 100, None), 4: ("revisit", 100, 3)}
    heads = {}
    for r in manifest.collect():
        with open(r["archive"].removeprefix("file://"), "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.DICTIONARY_MAGIC  # the file itself, not compressed once more
            f.seek(0)
            heads |= {int(h["WARC-Record-ID"].strip("<>").rpartition(":")[2]): h for h, _ in warc.parse(f.read())}
    assert heads[2]["WARC-Refers-To-Target-URI"] == "http://a%20b" and "WARC-Refers-To-Date" in heads[2] and "WARC-Refers-To-Target-URI" not in heads[4]


def test_an_archive_is_frames_behind_a_dictionary():
    import zstandard

    records = [warc.record(k, f"http://h/{k}", b"<p>" + f"some words of page {k} ".encode() * 40, 0, "00", None, None, "response", "2024-01-01T00:00:00Z") for k in range(300)]
    data = warc.archive(records, 16 << 10, 3)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(data[8 + size :])
    assert one == records[0]  # a record is a frame
    assert [int(h["WARC-Record-ID"].strip("<>").rpartition(":")[2]) for h, _ in warc.parse(data)] == list(range(300))
    with pytest.raises(ValueError):
        list(warc.parse(warc.archive([b"nonsense\r\n"], 1024, 3)))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_an_archive_of_few_records_has_a_dictionary(n):
    records = [warc.record(k, f"http://h/{k}", b"", 0, "00", 1, "http://h", "revisit", "2024-01-01T00:00:00Z") for k in range(n)]
    data = warc.archive(records, 16 << 10, 3)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert [int(h["WARC-Record-ID"].strip("<>").rpartition(":")[2]) for h, _ in warc.parse(data)] == list(range(n))


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head</h1>a  b<br>c<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>
<p>foo<p hidden>no</p><div style="display: none">no</div><table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple &amp; pear<td>10<tr><td rowspan=2>r<td>1<tr><td>2</table>
<pre>
 x  y
   z
</pre>end <b>bold</b><i> it</i>.<script>var a="</p>"</script><!-- no --> &copy; done"""
SHOWN = """Head

a b
c

- one
- two
  3. x
  4. y

foo

Cap
Name          Qty
apple & pear  10
r             1
              2

 x  y
   z

end bold it. © done"""


def test_layout():
    assert html.render(PAGE) == SHOWN


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\n\nb"),
        ("a<div>b</div>c", "a\nb\nc"),
        ("<dl><dt>T<dd>D</dl>", "T\n    D"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("a < b <1", "a < b <1"),
        ("x<p title='a>b'>y", "x\n\ny"),
        ("x <b", "x"),
        ("<select><option>1<option>2</select>", "1\n2"),
        ("<td>cell</td>", "cell"),
        ("<table><td>a<td>b<table><td>c<td>d</table></table>", "a  b\n\n   c  d"),
        ("<textarea> a &lt; </textarea>", "a <"),
    ],
)
def test_markup(page, shown):
    assert html.render(page) == shown


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("so (<math><mi>x</mi><mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac></math>) holds", "so (x = 1 2) holds"),
        ("<math><semantics><mi>y</mi><annotation encoding='application/x-tex'>\\y</annotation></semantics></math>", "y"),
        ("a <svg><title>no</title><desc>no</desc><defs/><g>no<circle r=1 /><text x=1>Label<tspan> one</tspan></text><text>two</text></g></svg> b", "a Label one two b"),
        ("<svg display='none'><text>no</text></svg><svg><defs><text>no</text></defs><text visibility='hidden'>no</text><foreignObject><p>in</p></foreignObject></svg>", "in"),
        ("a<object data=x><param name=y>instead</object>", "ainstead"),
        ("a<xmp>if <b> &amp; c\n  d</xmp>e", "a\n\nif <b> &amp; c\n  d\n\ne"),
        ("a<noscript>no</noscript><canvas>no</canvas>", "a"),
    ],
)
def test_formulas_drawings_objects_and_listings(page, shown):
    assert html.render(page) == shown


def test_deep_and_broken_markup_ends():
    assert html.render("<div>" * 50_000 + "x") == "x"
    assert html.render("<p " * 20_000) == "" and html.render("<td>" * 3_000 + "y").strip() == "y"


def test_html_of_nulls(spark):
    df = spark.createDataFrame([(1, None, 2), (2, "", 2), (2, "", 2), (None, "<p>x", 2)], "page_id long, html string, text int")
    assert sorted((tuple(r) for r in html.extract_text(df).collect()), key=repr) == sorted([(1, None, None, None), (2, "", 0, 0), (2, "", 0, 0), (None, "x", 1, 1)], key=repr)
    assert html.extract_text(df.limit(0)).count() == 0
