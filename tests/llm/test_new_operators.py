"""Fill-in-the-middle, token alignment and WARC archives against brute force, and their defined cases."""

import gzip
import hashlib
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.llm import fill_middle, registry, token_alignment, warc

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|[ \t\n\v\f\r]+", "char": r"(?s:.)"}
ODD = [
    "", None, "a", "\n", "\n\n\n", "no end", "one\ntwo\n", "é日本😀\nsecond 🎉\n\nlast", "has <P> in it\nx", "<M>", "a\r\nb\x0bc\n", " lead", "trail \n ", "<S\n>P>\n<", "x" * 5000 + "\n" + "y\n" * 3000,
]


def drawn(i):
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute_middle(i, text, unit, rate, spm):
    t = text or ""
    u = re.findall(UNITS[unit], t)
    h = drawn(i)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_fill_in_middle(spark, unit):
    rows = [(i, t, "kept", "clash") for i, t in enumerate(ODD * 8)] + [(None, "no id\nat all\n", "kept", "clash"), (3, ODD[7], "again", "clash"), (3, ODD[7], "again", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string, fim_form string")
    for rate, spm in ((100, 50), (40, 0)):
        out = fill_middle.transformed(docs, unit, rate, spm)
        assert out.columns == ["doc_id", "text", "more", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
        got = out.withColumn("back", fill_middle.restored(F.col("fim_text"), F.col("fim_form"))).collect()
        key = lambda x: tuple(map(repr, x))
        want = [(i, t, more, *brute_middle(i, t, unit, rate, spm), t or "") for i, t, more, _ in rows]
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert fill_middle.transformed(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="no unit"):
        fill_middle.transformed(docs, "page").count()


def test_other_sentinels(spark):
    docs = spark.createDataFrame([(i, "one\ntwo (S)\nthree\n" if i else "a [P| b") for i in range(20)], "doc_id long, text string")
    marks = ("[P|", "|S]", "(M)")
    rows = fill_middle.transformed(docs, sentinels=marks).withColumn("back", fill_middle.restored(F.col("fim_text"), F.col("fim_form"), marks)).collect()
    assert all(r["back"] == r["text"] for r in rows) and {r["fim_form"] for r in rows} == {"plain", "psm", "spm"}


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for n, share in ((1, 1.0), (511, 0.5), (512, 0.01), (513, 0.9), (20_000, 0.003), (70_000, 0.4)):
        marks = rng.random(n) < share
        bits = fill_middle.Bits(marks)
        at = np.arange(n + 1)
        assert (bits.rank(at) == np.concatenate(([0], np.cumsum(marks)))).all()
        assert (bits.select(np.arange(marks.sum())) == np.flatnonzero(marks)).all()


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    "Hello world, it's fine. I'll go", "", None, " ", "  ", "\n", "a  b   c \n\n d\t\te\r\n  f ", "naïve café déjà vu…  ok", "日本語 テキスト　全角 space", "😀 emoji 👩‍👩‍👧 join", "<|endoftext|> and <s> </s> <unk> <0x0A>",
    "a ▁ b", "▁", "no break em  line  ogham\u0085nel x", "1234567 12,345.67 x=y+z;", "x" * 3000, "tail   ", "\tlead", " two", "ends.\n", "don't 'tis 'RE we're", "\x00\x01 ctrl \x7f del",
    "the same words and the same words and the same words", "ﬁ ligature Ａ full ½", "mixed ünïcödé wörds und mehr wörds",
]


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path(A))
    first.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    second = SentencePieceProcessor(model_file=public_tokenizers.path(B))
    sides, all_links = [], Counter()
    for _, text in rows:
        ends, whole = [], (" " + (text or "")).encode()
        a = first.encode(whole.decode(), add_special_tokens=False)
        a = [(i, len(bytes(letters[c] for c in t))) for i, t in zip(a.ids, a.tokens)]
        ids = second.encode(text or "")
        b = []
        said = b""
        for i in ids:
            p = second.id_to_piece(i)
            part = bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            said += part
            b.append((i, len(part)))
        if not text or said != whole or sum(n for _, n in a) != len(whole):
            sides.append(None)
            continue
        for side in (a, b):
            at, out = 0, []
            for i, n in side:
                at += n
                out.append((i, at))
            ends.append(out)
        common = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        links = [(dict((e, i) for i, e in ends[0])[c], dict((e, i) for i, e in ends[1])[c]) for c in common]
        all_links.update(links)
        groups, low = [], 0
        for c in common:
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= c) for side in ends))
            low = c
        sides.append((len(a), len(b), links, ";".join(groups)))
    most = {}
    for (_, y), n in all_links.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (i, _), x in zip(rows, sides):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = x
            out.append((i, n_a, n_b, len(links), len(links), sum(all_links[x] == most[x[1]] for x in links), sum(all_links[x] for x in links), groups))
    return out


def of_alignment(df):
    return sorted((tuple(r) for r in df.select("doc_id", *token_alignment.NUMBERS, "groups").collect()), key=repr)


@pytest.mark.parametrize(("most", "cut"), [(500_000, True), (1, True), (500_000, False)])
def test_token_alignment(spark, monkeypatch, most, cut):
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", most)
    files = public_tokenizers.path(A), public_tokenizers.path(B)
    assert token_alignment.can_cut(*files)
    if not cut:
        monkeypatch.setattr(token_alignment, "can_cut", lambda *_: False)
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, slice string").repartition(3)
    assert of_alignment(token_alignment.align(docs, *files)) == sorted(brute_alignment(rows), key=repr)
    assert token_alignment.align(docs.limit(0), *files).count() == 0
    blank = token_alignment.align(docs.where("coalesce(text, '') = ''"), *files)
    assert of_alignment(blank) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_token_alignment_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeiourstlné"), rng.integers(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 400))))) for i in range(60)] + [(60, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.op12_token_alignment(spark, str(tmp_path)).select("doc_id", *token_alignment.NUMBERS, "groups_sha256").collect())
    assert got == [(*x[:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for x in brute_alignment(rows)]


def test_cuts():
    text = "ab cd  e　 f\té \ng… h  i".encode()
    at = token_alignment.cuts(np.frombuffer(text, np.uint8)).tolist()
    assert [text[i - 1 : i + 1] for i in at] == [b"b ", "é ".encode()[1:], b"h "]


PAGES = [
    (5, "http://a/x", "p" * 150), (2, "http://a/y", "p" * 150), (9, None, "p" * 150), (3, "http://b/\r\nBad: 1", "short"), (4, "http://b/é z", "short"), (6, "", ""), (7, "u", None),
    (8, "u", "q" * 99), (10, "u", "q" * 99), (11, "u", "é" * 50), (12, "u", "é" * 50), (13, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 400), (14, "u", "HTTP/1.1\r\n\r\n" * 50),
]


def brute_pages(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"fileBytes": 2000}])
def test_warc_round_trip(spark, options):
    rows = [*PAGES, (2, "again", "p" * 150), (None, "n", "p" * 150), (None, "n", "r" * 200), (1, None, "s" * 100), (1, None, "s" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.round_trip(pages, **options)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_pages(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0
    named = pages.withColumn("page_id", F.concat(F.lit("a b<>:"), "page_id"))
    assert {r["refers_to"] for r in warc.round_trip(named).where("record_type = 'revisit'").collect()} == {"a b<>:2", "a b<>:11"}


@pytest.mark.parametrize("heavy", [1, 10**9])
def test_warc_heavy_payloads(spark, monkeypatch, heavy):
    """Digests over one in `heavy` of the pages are broadcast, the others joined by shuffle."""
    monkeypatch.setattr(warc, "HEAVY", heavy)
    monkeypatch.setattr(warc, "small", lambda df: df)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr) == brute_pages(PAGES)


def archive(spark, path, **options):
    rows = [(f"<urn:x:{i}>", "response" if i % 3 else "request", f"http://h{i % 2}/{i}", None, bytes([65 + i % 26]) * i * 3000) for i in range(40)]
    warc.write(spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, date string, payload binary").repartition(2), f"file://{path}", **options)
    return rows


def test_warc_files_are_gzip_and_parse_by_hand(spark, tmp_path):
    rows = archive(spark, f"{tmp_path}/w", fileBytes=5000)
    files = [f for f in os.listdir(f"{tmp_path}/w") if f.endswith(".warc.gz")]
    assert len(files) > 2 and not [f for f in os.listdir(f"{tmp_path}/w") if f.startswith("_")]
    found = {}
    for name in files:
        with gzip.open(f"{tmp_path}/w/{name}") as f:
            data = f.read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block, data = rest[: int(named["Content-Length"])], rest[int(named["Content-Length"]) + 4 :]
            assert rest[len(block) : len(block) + 4] == b"\r\n\r\n"
            found[named["WARC-Record-ID"]] = block.partition(b"\r\n\r\n")[2]
    assert found == {r[0]: r[4] for r in rows}


def test_warc_predicates_skip_payloads(spark, tmp_path, monkeypatch):
    """Predicates on headers reach the reader, which decodes only the records that pass."""
    rows = archive(spark, f"{tmp_path}/w")
    archive(spark, f"{tmp_path}/w", compression="none")
    df = warc.read(spark, f"file://{tmp_path}/w")
    some = df.where("record_type = 'response' AND target_uri LIKE 'http://h1/%' AND payload_bytes > 30000")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and ") Filter" not in plan
    want = sorted(r[0] for r in rows if r[1] == "response" and r[2].startswith("http://h1/") and len(r[4]) > 30000)
    assert sorted(r["record_id"] for r in some.collect()) == sorted(want * 2)
    assert df.where(F.col("record_id").isin("<urn:x:7>", "<urn:x:8>")).count() == 4 and df.where("refers_to IS NOT NULL").count() == 0
    assert df.where("octet_length(payload) = 6000").count() == 2  # tested by Spark
    full = {(r["record_id"], bytes(r["payload"])) for r in df.collect()}
    assert full == {(r[0], r[4]) for r in rows}
    assert df.where("headers['warc-type'] = 'request'").count() == 2 * len([r for r in rows if r[1] == "request"])
    none = warc.read(spark, f"file://{tmp_path}/w", payload=False)
    assert none.where("payload IS NULL").count() == 80 and none.agg(F.sum("payload_bytes")).first()[0] == 2 * sum(len(r[4]) for r in rows)

    # in the reader itself: what is inflated for records that don't pass
    took = []
    inflate = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self, *a: took.append(len(out := inflate(self, *a))) or out)
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"})
    reader.pushed = [("record_id", warc.D.EqualTo, "<urn:x:1>")]
    out = pa.Table.from_batches([b for p in reader.partitions() for b in reader.read(p)])
    assert out.num_rows == 2 and 0 < sum(took) < sum(len(r[4]) for r in rows) // 2


def test_warc_foreign_files(spark, tmp_path):
    """Members without a length of their own, names in members, other record types, folded headers; broken files are errors."""
    body = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nX-Long: one\r\n two\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    page = warc.record({"record_type": "response", "record_id": "<urn:p>", "payload": b"z" * 100_000})
    with open(f"{tmp_path}/a.warc.gz", "wb") as f:
        for x in (body, page, body):
            with gzip.GzipFile("name.warc", "wb", fileobj=f) as g:
                g.write(x)
    (tmp_path / "b.warc").write_bytes(b"\r\n" + body + page)
    (tmp_path / "notes.txt").write_text("no archive")
    df = warc.read(spark, f"file://{tmp_path}")
    info = df.where("record_type = 'warcinfo'").collect()
    assert len(info) == 3 and {bytes(r["payload"]) for r in info} == {b"software:"} and info[0]["headers"]["x-long"] == "one two"
    assert [len(r["payload"]) for r in df.where("record_id = '<urn:p>'").collect()] == [100_000] * 2
    (tmp_path / "c.warc").write_bytes(b"not a record\r\n\r\n")
    with pytest.raises(Exception, match="has no record at 0"):
        warc.read(spark, f"file://{tmp_path}").count()
    (tmp_path / "c.warc").write_bytes(page[:5000])
    with pytest.raises(Exception, match="has no end"):
        warc.read(spark, f"file://{tmp_path}").select(F.octet_length("payload")).collect()


def test_warc_packs_files(tmp_path):
    for i, n in enumerate((50, 10, 40, 30, 20, 5)):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * n)
    parts = warc.WarcReader({"path": f"file://{tmp_path}", "partitionbytes": "60"}).partitions()
    sizes = sorted(sum(os.path.getsize(n) for n in p.names) for p in parts)
    assert sizes == [50, 50, 55] and sum(len(p.names) for p in parts) == 6
