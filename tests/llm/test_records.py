"""PII, archives and preference pairs."""

import hashlib
import random
import re
import time

import pytest

from torusflow.llm import pii, preference, warc

from ..compare import oracle, spark_rows

SF = "/root/testdata/sf0.01"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in pii.BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(0)
    tokens = ["a", "bc.d", "@", "x@y.z", "@q.r", ".", "+", "-", "%", " ", "1", "22", "333", "4444", "255", "256", "192.168.1.1", "+1 (017) 555-7713", "4845168114407329", "4845 1681 1440 7329", "4845-1681-1440-7329", "é", "😀", "\n", "\x01", "\x02", "(", ")", "  ", "00001"]
    rows = [(i, "".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 20000), (1003, "1 " * 20000), (1004, "a." * 20000 + "@"), (1005, "a@" + "b." * 20000), (1006, "x" * 200000)]
    df = pii.find(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, pii_x int"))
    got = {r[0]: r[1] for r in df.select("doc_id", pii.joined("email", "ip", "card", "phone")).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}
    assert pii.find(spark.createDataFrame([], "text string")).count() == 0


def test_checksums_context_and_redaction(spark):
    texts = ["my iban DE89 3704 0044 0532 0130 00 ok", "iban DE89 3704 0044 0532 0130 01 ok", "call 555-123-4567 now", "part 555-123-4567", "token = " + "0a" * 20, "commit " + "0a" * 20, "mail a@b.cd or +1 (132) 555-1352", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.find(rows).select("doc_id", pii.joined(*pii.KINDS)).collect()}
    assert [bool(got[i]) for i in range(6)] == [True, False, True, False, True, False]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert clean[6] == "mail <EMAIL> or <PHONE>" and clean[7] is None and clean[0] == "my iban <IBAN> ok"


def test_iban_ends_before_capitals(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "BE68 5390 0754 7034", "CH93 0076 2011 6238 5295 7", "LC55HEMM000100010012001200023015"]
    after = [" Deutsche Bank", " The end", " BIC COBADEFF", " A", " 12 OF MAY", " ok", ". Next", ""]
    texts = [f"IBAN {i}{a}" for i in ibans for a in after] + ["bank AB12 DE89 3704 0044 0532 0130 00 NOW"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [f"iban:5:{5 + len(i)}" for i in ibans for _ in after] + ["iban:10:37"]
    got = {r[0]: r[1] for r in pii.find(rows).select("doc_id", pii.joined("iban")).collect()}
    assert [got[n] for n in range(len(texts))] == want


def test_overlapping_spans_leave_nothing_in_clear(spark):
    card = "4845168114407329"
    rows = spark.createDataFrame([(1, f"at 10.0.0.{card[0]} {card[1:4]} {card[4:]} end")], "doc_id long, text string")
    assert pii.redact(rows).first()["text"] == "at <IP><CARD> end"


def test_many_spans_in_one_text(spark):
    """Spans are put together in about linear time: this took minutes when arrays grew one by one."""
    text = "".join(f"a{i}@b.cd " for i in range(40_000)) + "é😀 10.0.0.1"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.find(rows).select(pii.joined("email", "ip", "card", "phone")).first()[0]
    assert got == plain_spans(text)
    assert pii.redact(rows).first()["text"] == "<EMAIL> " * 40_000 + "é😀 <IP>"
    assert time.time() - began < 40


def test_redaction_equals_brute_force(spark):
    rnd = random.Random(1)
    tokens = ["a", "x@y.z", "@q.r", "+1 (017) 555-7713", "4845168114407329", "192.168.1.1", " ", "é", "😀", "filler " * 40, "\n", "10.0.0.4845168114407329", "DE89370400440532013000 bank"]
    texts = ["".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for k in pii.KINDS for s in r[f"pii_{k}"]] for r in pii.find(df).collect()}
    for r in pii.redact(df).collect():
        text, at, out = texts[r["doc_id"]], 0, []
        for kind, start, stop, _ in sorted(found[r["doc_id"]], key=lambda s: (s[1], -s[2], s[0])):
            if stop > at:
                out += [text[at:start], f"<{kind.upper()}>"]
                at = stop
        assert r["text"] == "".join(out) + text[at:]


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(1, "a@b.cd", "mine", "own", "s")], "doc_id long, text string, __clean string, pii_email string, __spans string")
    assert [tuple(r) for r in pii.redact(rows).collect()] == [(1, "<EMAIL>", "mine", "own", "s")]
    assert pii.redact(rows).columns == rows.columns
    found = pii.find(rows).first()
    assert found["__clean"] == "mine" and found["pii_email"][0]["stop"] == 6


def test_documents_hash(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op5(spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(plain_spans(docs[r["doc_id"]]).encode()).hexdigest()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a/b c", "1.2.3.4", "20010203040506", "text/html", warc.HTTP + "é\n\nx".encode()), ("http://c/", "1.2.3.4", "2001", "text/plain", b"")]
    got = list(warc.parse_arc(warc.write_arc(records, version)))
    assert [(g["URL"], g["block"]) for g in got] == [(r[0], r[4]) for r in records]
    data = b"".join(warc.to_warc(g) for g in got)
    back = list(warc.read_warc(data))
    assert [warc.payload_of(b) for _, b in back] == ["é\n\nx".encode(), b""]
    assert back[1][0]["warc-date"] == "2001-01-01T00:00:00Z" and [b[0]["warc-type"] for b in back] == ["response", "resource"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.write_arc(records, version)[:-5]))
    with pytest.raises(ValueError):
        list(warc.read_warc(data[:-10]))


def test_pages_and_revisits(spark):
    long = "<p>é\r\n\r\nWARC/1.1</p>" * 100
    pages = [(1, "http://a", long), (2, "http://b b", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (3, None, long), (None, "u", long)]
    got = sorted((tuple(r) for r in warc.convert(spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, keep int")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=lambda r: r[0] or 0)
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    n = len(long.encode())
    assert got == sorted([(1, n, digest(long), "revisit", 3), (2, n, digest(long), "revisit", 3), (3, n, digest(long), "response", None), (3, n, digest(long), "response", None), (None, n, digest(long), "revisit", 3), (4, 5, digest("short"), "response", None), (5, 5, digest("short"), "response", None), (6, 0, digest(""), "response", None), (7, 0, digest(""), "response", None)], key=lambda r: r[0] or 0)
    assert warc.convert(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_binary_archives(spark, tmp_path):
    """Images and other bytes pass, through Spark's writer and reader, as gzip members that any reader can open."""
    image = bytes(range(256)) * 50 + b"\n\r\n\xff\xfe" + warc.SPLIT + b"\x1f\x8b"
    records = [("http://a/i.png", "1.2.3.4", "20010203040506", "image/png", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + image), ("ftp://b/raw", "1.2.3.4", "20010203040506", "application/octet-stream", image)]
    (tmp_path / "arcs").mkdir()
    (tmp_path / "arcs" / "a.arc").write_bytes(warc.write_arc(records, 1, "a.arc"))
    (tmp_path / "arcs" / "b.arc").write_bytes(warc.write_arc(records[::-1], 2, "b.arc"))
    warc.write(warc.arc_records(spark, str(tmp_path / "arcs")), str(tmp_path / "out"))
    rows = warc.read(spark, str(tmp_path / "out")).collect()
    assert sorted(r["record_type"] for r in rows) == ["resource"] * 2 + ["response"] * 2 + ["warcinfo"] * 2
    assert {r["payload_digest"] for r in rows if r["uri"]} == {hashlib.sha1(image).hexdigest()}
    import gzip

    whole = [b for f in sorted((tmp_path / "out").glob("part-*")) for _, b in warc.read_warc(gzip.decompress(f.read_bytes()))]
    assert sum(image in b for b in whole) == 4 and len(whole) == 6


def test_a_stored_separator_does_not_split(spark):
    assert warc.SPLIT not in warc.member(warc.SPLIT * 3) and warc.unpacked(warc.member(warc.SPLIT * 3)) == warc.SPLIT * 3
    assert warc.unpacked(warc.SPLIT) == b""


def test_revisits_refer_to_their_record(spark):
    long = "<p>long</p>" * 300
    rows = {r["page_id"]: r for r in warc.convert(spark.createDataFrame([(1, "http://a", long), (9, "http://b", long)], "page_id long, url string, html string")).collect()}
    assert rows[1]["refers_to_id"] == rows[9]["record_id"] and rows[9]["refers_to_id"] is None


def test_a_page_of_many_megabytes(spark):
    big = "".join(f"{i:x}" for i in range(4_000_000))
    rows = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in warc.convert(spark.createDataFrame([(1, "u", big), (2, "u", big)], "page_id long, url string, html string")).collect()}
    assert rows == {1: (len(big), "revisit"), 2: (len(big), "response")}


def test_sql_agrees(spark):
    assert spark_rows(warc.op9(spark, SF)) == oracle(SF, warc.ORACLE)
    assert spark_rows(preference.op8(spark, SF)) == oracle(SF, preference.ORACLE)


def test_preference_edges(spark):
    schema = "pair_id long, turn long, role string, text string, k int"
    a = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (2, 0, "user", "x", 0), (3, 0, None, None, 0), (4, 0, "user", "only", 0), (None, 0, "user", "n", 0)]
    b = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "no", 0), (2, 0, "user", "x", 0), (3, 0, "", "", 0), (3, 1, "assistant", "more", 0)]
    got = {r["pair_id"]: r for r in preference.preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert set(got) == {1, 2, 3}
    full = got[1]["prompt"] + got[1]["chosen"]
    start, stop = map(int, got[1]["chosen_mask"].split(":"))
    assert full[start:stop] == "yes" + preference.CLOSE and got[1]["prompt_turns"] == 1 and got[1]["trainable"]
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"], got[2]["trainable"]) == (1, "", "", False)
    assert got[3]["prompt_turns"] == 1 and got[3]["rejected_mask"] and not got[3]["chosen_mask"]
    none = spark.createDataFrame([], schema)
    assert preference.preferences(none, none).count() == 0


def test_every_answered_conversation_has_a_row(spark, tmp_path):
    assert spark_rows(preference.op8_all(spark, SF)) == oracle(SF, preference.ORACLE_ALL)
    assert preference.op8_all(spark, SF).count() == 98
    rows = [(i, n, role, f"{role} {i}") for i in (2, 4, 10, 12, 40) for n, role in enumerate(("user", "assistant"))] + [(6, 0, "user", "none"), (None, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["pair_id"]: re.search(r"assistant (\d+)", r["rejected"])[1] for r in preference.op8_all(spark, str(tmp_path)).collect()}
    assert got == {2: "4", 4: "10", 10: "12", 12: "40", 40: "12"}


def test_repeated_tied_and_very_long_turns(spark):
    schema = "pair_id long, turn long, role string, text string"
    long = "word " * 400_000
    a = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "assistant", "tie"), (1, 1, "assistant", long)]
    b = [(1, 0, "assistant", "tie"), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "short")]
    got = preference.preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).first()
    assert got["prompt_turns"] == 3 and got["prompt"].count("hi") == 2 and got["prompt"].count("tie") == 1
    start, stop = map(int, got["chosen_mask"].split(":"))
    assert (got["prompt"] + got["chosen"])[start:stop] == long + preference.CLOSE
