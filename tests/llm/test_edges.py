"""Defined results for nulls, empty texts and tables, repeated rows and clashing names; round trips; the pipeline."""

import base64
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from meshloom.llm import chat, decontaminate, htmltext, langid, mixing, neardup, pii, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\c <\\cs> \\e \\\\", "<s<s>>", "", None, " [TEXT] [ROLE] "]
    rows = [(c, i, r, t) for c, t in enumerate(texts) for i, r in enumerate(("user", "assistant", "tool [TEXT] x", None))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    read = out.select("conv_id", "valid", chat.turns_of(F.col("formatted"), chat.DEFAULT).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    for r in read.collect():
        text = texts[r.conv_id] or ""
        assert [(t.role, t.text) for t in r.turns] == [(x, text) for x in ("user", "assistant", "tool [TEXT] x", "")]
        assert r.loss == text and not r.valid


def test_chat_order_of_roles(spark):
    rows = [(1, 0, "user"), (1, 1, "assistant"), (2, 0, "assistant"), (3, 0, "system"), (3, 1, "user")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string").withColumn("text", F.lit("x")))
    assert {r.conv_id: r.first_error for r in out.collect()} == {1: None, 2: 1, 3: 3}


def test_warc_round_trip(spark):
    html = {1: "<p>same é</p>", 2: None, 3: "<p>same é</p>", 4: "x" * 300_000, 5: "", 6: "a\r\n\r\nb"}
    pages = spark.createDataFrame([(i, f"http://h/{i}?é", t) for i, t in html.items()], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read(warc.write(pages, warc.new_folder(spark))).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 5), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for i, r in got.items():
        payload = (html[i] or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.url == f"http://h/{i}?é" and (r.record_type == "revisit" or bytes(r.payload) == payload)


def test_main_text(spark):
    body = "<article><h1>Title &amp; more</h1><p>First  part\nof a text that goes on for some words.</p><p>Second <b>part</b>.</p></article>"
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{body}<footer>Copyright</footer><script>x()</script></body></html>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div><p")], "page_id long, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r.text for r in htmltext.main_text(rows).collect()}
    assert got == {1: "Title & more\n\nFirst part of a text that goes on for some words.\n\nSecond part.", 2: "", 3: "", 4: ""}


def test_language(spark):
    train = [(i, "the cat and the dog went home", "en") for i in range(5)] + [(i, "кот и собака пошли домой", "ru") for i in range(5)] + [(9, None, "en"), (9, "text", None)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, "the dog went and кот и собака пошли домой"), (2, None), (3, "123 !"), (4, "the cat")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["ru", "und", "und", "en"] and got[2].lang_score == 0
    assert [(s.lang, s.start, s.end) for s in got[1].lang_spans] == [("en", 0, 16), ("ru", 17, 41)]
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(rows, nothing).filter("lang_pred <> 'und'").count() == 0


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id string, text string")
    assert mixing.emit(mixing.mix(docs)).count() == 0
    assert neardup.near_duplicates(docs).count() == neardup.keep_one(docs).count() == 0
    assert pii.find(docs).count() == pii.redact(docs).count() == 0
    assert quality.statistics(docs).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    for most in (1000, 0):
        assert decontaminate.decontaminate(docs, bench, max_index_words=most).count() == 0
        assert [(r.n_words, r.n_hit) for r in decontaminate.decontaminate(one, bench, max_index_words=most).collect()] == [(2, 0)]


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now"), (2, None), (3, ""), (1, "mail a.b@c.de now")], "doc_id long, text string")
    assert sorted(r.text or "" for r in pii.redact(docs).collect()) == ["", "", "mail <EMAIL> now", "mail <EMAIL> now"]


def test_pipeline_stages(spark, tmp_path):
    plain = [" ".join(f"{w}{chr(97 + (i * 7 + j) % 26)}{chr(97 + (i + j * 5) % 26)}" for j, w in enumerate(("stone river house cloud light table " * 6).split())) for i in range(8)]
    item = " ".join(f"bench{chr(97 + i)}" for i in range(20))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)]
    rows += [(20, plain[0], "en", "s", 1), (21, item, "en", "s", 1), (22, None, "en", "s", None), (23, plain[1][:60] + " write to a.b@c.de today", None, None, 1), (24, "", "en", "s", 0), (25, "42", "en", "s", 2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = {i: len(t.split()) for i, t in enumerate(plain)}
    taken = {i for i in (r.doc_id for r in out)}
    assert taken <= {*range(8), 23} and len(taken) >= 6
    assert all(r.size == size.get(r.doc_id, r.size) and r["copy"] <= 3 for r in out)
    assert all("<EMAIL>" in r.text and "@" not in r.text for r in out if r.doc_id == 23)
