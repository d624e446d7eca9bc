"""Operators of the llm subpackage against brute force, and their defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import components, context_tree, cotraining, decontamination, lm_scoring, mixing, ngram_join, quality_rules, sharding, substring_dedup, token_files, url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int"


def texts(seed=1, n=120):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeiourstln"), rng.integers(1, 6))) for _ in range(400)] + ["Été,", "x.", "A-b", "日本"]
    make = lambda k: " ".join(rng.choice(words, k))
    out = [make(int(rng.integers(3, 300))) for _ in range(n)]
    passage = make(70)
    for i in range(0, n, 6):
        out[i] = out[i] + "\n" + passage + " " + make(20)
    for i in range(3, n, 9):  # near copies
        w = out[i - 1].split(" ")
        for j in range(0, len(w), 40):
            w[j] = "changed"
        out[i] = " ".join(w)
    out[5], out[7], out[11] = out[4], out[4], out[4].upper()
    return [*out, "", None, "one", "one two", "a b c d e", "same same same same " * 40, "  \n\t ", make(9000)]


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t or ""), "clash", 1) for i, t in enumerate(texts())]
    return [*rows, rows[0], rows[4]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return SPACED.findall(t or "")


def test_decontamination(spark, corpus, docs, empty):
    pick = [(1, " ".join(words(corpus[0][1])[3:40])), (2, "one two"), (3, ""), (4, None), (None, corpus[2][1]), (5, corpus[4][1]), (5, "a b c d e")]
    items = spark.createDataFrame(pick, "item_id long, text string")
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in pick:
        w = alnum.findall((t or "").translate(LOWER)) if i is not None else []
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    for block in (1_000_000, 20):  # one block, and a pass for every few
        got = sorted(tuple(r) for r in decontamination.scan(docs, items, keep=["doc_id"], block_words=block).drop("spans").collect())
        want = []
        for row in corpus:
            w, hit, ids = alnum.findall((row[1] or "").translate(LOWER)), set(), set()
            for x, owners in windows.items():
                for j in range(len(w) - len(x) + 1):
                    if tuple(w[j : j + len(x)]) == x:
                        hit |= set(range(j, j + len(x)))
                        ids |= owners
            want.append((row[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
        assert got == sorted(want)
        fewer = decontamination.scan(docs, items, keep=["doc_id"], block_words=block, spans=False)
        assert sorted(tuple(r) for r in fewer.drop("spans").collect()) == got and fewer.where(F.size("spans") > 0).isEmpty()
    # the longest matches, from those of each pair of starts
    texts_of = {str(i): [] for i, _ in pick}
    for i, t in pick:
        if i is not None:
            texts_of[str(i)].append(alnum.findall((t or "").translate(LOWER)))
    for r in decontamination.scan(docs.where("doc_id IN (0, 2, 4, 12)"), items, keep=["doc_id"]).collect():
        w, want_spans = alnum.findall((corpus[r["doc_id"]][1] or "").translate(LOWER)), set()
        for i, lists in texts_of.items():
            for x in lists:
                for a in range(len(w)):
                    for b in range(len(x)):
                        if w[a] == x[b] and (not a or not b or w[a - 1] != x[b - 1]):
                            k = 0
                            while a + k < len(w) and b + k < len(x) and w[a + k] == x[b + k]:
                                k += 1
                            if k >= min(10, len(x)):
                                want_spans.add((i, b, a, k))
        assert {(s["item_id"], s["item_start"], s["doc_start"], s["n_words"]) for s in r["spans"]} == want_spans
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {w[0] for w in want if not w[5]}
    assert decontamination.clean(empty, items).count() == 0
    assert decontamination.scan(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_repeats():
    """A text of two million equal words against an item of 200, in bounded memory."""
    import tracemalloc

    import pyarrow as pa

    from glosswork.llm.words import Words

    items = decontamination.Items(["1", "2"], [" ".join("a" * 200), " ".join("ab" * 100)], 10)
    words = Words(pa.array([" ".join("a" * 2_000_000), "a b " * 40 + "a " * 12]), alnum=True)
    tracemalloc.start()
    found = decontamination.Found(words, items, pa.array(items.vocabulary, pa.large_string()), 10)
    row, item, start, end = found.hit()
    spans = [len(p) for p, _, _ in found.longest()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(row.tolist(), item.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1)]
    assert (end - start).tolist() == [2_000_000, 92] and sum(spans) > 0 and peak < 500e6


def brute_components(corpus):
    sets = {}
    for row in corpus:
        w = words((row[1] or "").translate(LOWER))
        sets[row[0]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark, corpus, docs, empty):
    want = brute_components(corpus)
    got = ngram_join.joined(docs).collect()
    assert len(got) == len(corpus) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    kept = {r["doc_id"] for r in ngram_join.representatives(docs).collect()}
    assert kept == {c for _, c in want.values()} | {i for i, (n, _) in want.items() if not n}
    assert ngram_join.joined(empty).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.joined(null).collect()} == {(None, None), (3, 2), (2, 2)}


def test_signatures_meet():
    """Any two sets that are similar enough share a signature that the larger one may or must probe, on every choice
    of as many segments as it needs credits."""
    rng = np.random.default_rng(5)
    import pyarrow as pa

    pairs = []
    for n in [*range(5, 40), 64, 65, 90, 130, 257, 700]:
        for _ in range(4):
            a = [f"w{x}" for x in rng.integers(0, 10**6, n + 4)]
            b = list(a)
            for j in rng.choice(len(b), max(1, n // 40), replace=False):
                b[j] = "z"
            pairs.append((" ".join(a), " ".join(b)))
    s = ngram_join.Sets(pa.array([t for p in pairs for t in p]), 5)
    upper = ngram_join.bands(s)
    own = ngram_join.signatures(s, upper, True, 75)
    nxt = ngram_join.signatures(s, np.where(s.size * 100 // 75 > upper, 2 * upper, 0), False, 75)
    sig, row, flag = (np.concatenate((x, y)) for x, y in zip(own[:3], nxt[:3], strict=True))
    need, every, _ = ngram_join.credits(s, ngram_join.Segments(s, upper), 75)
    for i in range(len(pairs)):
        x, y = 2 * i, 2 * i + 1
        hx, hy = (set(s.h[s.bounds[k] : s.bounds[k + 1]].tolist()) for k in (x, y))
        if 100 * len(hx & hy) >= 75 * len(hx | hy) and not {x, y} & set(own[3].tolist()):
            big, small = (x, y) if len(hx) >= len(hy) else (y, x)
            held = set(sig[(row == small) & ((flag & ngram_join.INDEXED) > 0)].tolist())
            free = [z for z in sig[(row == big) & ((flag & ngram_join.MAY_PROBE) > 0)].tolist() if z not in held]
            must = set(sig[(row == big) & ((flag & ngram_join.PROBES) > 0)].tolist()) & held
            assert must or len(free) < need[big]  # segments that don't meet can't fill the credits


def test_ngram_join_with_common_passages(spark):
    """Passages that most sets hold, in parts from a third to nearly all of a text, and clusters of near copies."""
    rng = np.random.default_rng(11)
    make = lambda k: [f"w{x}" for x in rng.integers(0, 10**7, k)]
    passage, line, rows = make(120), make(9), []
    for i in range(260):
        share = (20, 60, 110, 120)[i % 4]
        rows.append((i, " ".join([*line, *passage[:share], *make(int(rng.integers(3, 140)))])))
    for i in range(260, 420):  # a large cluster, some of it under the similarity
        w = rows[2][1].split(" ")
        for j in rng.choice(len(w), int(rng.integers(0, 9)), replace=False):
            w[j] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(line + make(i % 5))) for i in range(420, 470)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(df).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 400


def test_against_all(spark, docs, corpus, monkeypatch):
    """Every link of the sets given, and no other, in blocks of two sets."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    import pyarrow as pa

    some = [corpus[k] for k in (2, 3, 4, 20, 122)]
    short = spark.createDataFrame([(row[0], row[1]) for row in some], "node long, text string")
    got = {tuple(r) for r in ngram_join.against_all(docs.select(F.col("doc_id").alias("doc"), "text"), short, 5, 75).collect()}
    keys = ngram_join.Sets(pa.array([row[1] for row in corpus]), 5).key.view(np.int64).tolist()
    grams = lambda t: (lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())(words((t or "").translate(LOWER)))
    sets = [grams(row[1]) for row in corpus]
    want = {(keys[x], keys[corpus.index(row)]) for row in some for x in range(len(corpus)) for a, b in [(sets[x], grams(row[1]))] if a & b and 100 * len(a & b) >= 75 * len(a | b)}
    assert got == want and len(want) > 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules(spark, corpus, docs, empty):
    got = quality_rules.judged(docs).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept").collect()
    assert len(got) == len(corpus)
    by = {row[0]: row for row in corpus}
    for r in got:
        text = by[r["doc_id"]][1] or ""
        w = words(text)
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {p for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in text.split("\n") if words(x)]
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns and quality_rules.kept(empty).count() == 0
    bad = spark.createDataFrame([(i, "x " * 10, "junk") for i in range(400)] + [(1000 + i, " ".join(f"w{i}x{j}" for j in range(60)), f"h{i % 4}" if i else "junk") for i in range(4000)], "doc_id long, text string, source string")
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judged(bad).collect()}
    assert not out[1000] and out[1001]  # a good document of a bad host goes, others stay


def host_verdicts(rows):
    """(rejected, watched rules) by host, from rows (host, failures by rule), in plain numbers."""
    out, total = {}, len(rows)
    by = {}
    for host, fails in rows:
        by.setdefault(host, []).append(fails)
    for r in quality_rules.RULES:
        m = sum(f[r] for _, f in rows) / total
        counts = {h: (len(x), sum(f[r] for f in x)) for h, x in by.items()}
        within = m * (1 - m)
        spread = sum(f * f / n for n, f in counts.values()) - total * m * m - (len(counts) - 1) * within
        room = total - sum(n * n for n, _ in counts.values()) / total
        between = spread / room if room else 0
        strength = max(within / between - 1, 1.0) if between > 0 else total
        for h, (n, f) in counts.items():
            p = (f + strength * m) / (n + strength)
            low = p - 2 * math.sqrt(p * (1 - p) / (n + strength + 1))
            bad, watched = out.setdefault(h, [False, set()])
            out[h][0] = bad or low > 4 * m
            if low > m:
                watched.add(r)
    return out


def test_host_verdicts_decide(spark):
    """A host of symbol junk is rejected, one that is somewhat worse loses its failing documents only; all against
    plain numbers."""
    rng = np.random.default_rng(2)
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    share = {**{f"h{k}": 0.05 for k in range(12)}, "worse": 0.2, "junk": 0.8}
    rows = []
    for host, p in share.items():
        for _ in range(300):
            i = len(rows)
            rows.append((i, plain(i) + (" " + "|" * 60 if rng.random() < p else ""), host))
    rows += [(len(rows) + i, f"{plain(i)}\nsame line", None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}

    def fails(i):
        r = got[i]
        return {"short": r["n_words"] < 50, "repeats": 100 * r["n_repeat_words"] > 50 * r["n_words"], "symbols": 100 * r["n_symbols"] > 10 * r["word_chars"], "lines": False}

    verdicts = host_verdicts([(h, fails(i)) for i, _, h in rows])
    assert verdicts["junk"][0] and not verdicts["worse"][0] and verdicts["worse"][1] == {"symbols"} and not verdicts["h0"][1]
    for i, _, h in rows:
        f = fails(i)
        assert got[i]["kept"] == (not got[i]["base_failed"] and not verdicts[h][0] and not any(f[r] for r in verdicts[h][1]))
    assert any(f["symbols"] and got[i]["kept"] for i, _, h in rows for f in [fails(i)])  # junk of hosts that are not watched stays


def test_cotraining(spark, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = " ".join(f"w{x}" for x in rng.integers(0, 60, 40)) + (" awful" if bad else "")
        rows.append((i, t, "en", "shady" if bad and i % 8 == 0 else "fine"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    out = {r["doc_id"]: r for r in cotraining.classified(df, lab, good).collect()}
    held = [i for i in range(600) if i % 2]
    assert np.mean([out[i]["kept"] == (i % 4 != 0) for i in held]) > 0.95
    assert cotraining.classified(empty, lab, good).count() == 0
    none = cotraining.classified(df, lab.limit(0), good)
    assert none.count() == 600 and none.select("score").distinct().count() == 1


def brute_ctw(counts, depth, token):
    """ln of a token's probability, from a dictionary of nodes."""
    nodes, kids = {}, {}

    def steps(t):
        for j in range(len(t)):
            ctx = bytes(t[j - 1 - x] if j - 1 - x >= 0 else 0 for x in range(depth))
            for bit in range(8):
                yield ctx, bit, t[j] >> (8 - bit), (t[j] >> (7 - bit)) & 1

    for t, k in counts.items():
        for ctx, bit, prefix, one in steps(t):
            for d in range(depth + 1):
                nodes.setdefault((ctx[:d], bit, prefix), [0, 0])[one] += k
                if d:
                    kids.setdefault((ctx[: d - 1], bit, prefix), set()).add((ctx[:d], bit, prefix))
    weight, stop = {}, {}
    for key in sorted(nodes, key=lambda x: -len(x[0])):
        a, b = nodes[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        if len(key[0]) == depth:
            weight[key] = own
            continue
        below = sum(weight[x] for x in kids[key])
        top = np.logaddexp(own, below)
        stop[key], weight[key] = math.exp(own - top), top - math.log(2)
    total = 0.0
    for ctx, bit, prefix, one in steps(token):
        p = 0.5
        for d in range(depth, -1, -1):
            n = nodes.get((ctx[:d], bit, prefix), (0, 0))
            w = 1.0 if d == depth else stop.get((ctx[:d], bit, prefix), 0.5)
            p = w * (n[one] + 0.5) / (n[0] + n[1] + 1) + (1 - w) * p
        total += math.log(p)
    return total


@pytest.mark.parametrize("sent", [(500_000, 4_000_000), (3, 5)])  # all looked up; nearly all joined
def test_lm_scoring(corpus, docs, empty, monkeypatch, sent):
    monkeypatch.setattr(lm_scoring, "SENT_WORDS", sent[0])
    monkeypatch.setattr(lm_scoring, "SENT_CONTEXTS", sent[1])
    held = {row[0]: zlib.crc32(str(row[0]).encode()) % 7 == 2 for row in corpus}
    tokens = lambda t: [*words((t or "").translate(LOWER)), None]
    count = Counter(w for row in corpus if not held[row[0]] for w in tokens(row[1]))
    total, distinct = sum(count.values()), len(count)
    raw = {b"\n" if w is None else w.encode() + b" ": k for w, k in count.items()}
    out = lm_scoring.score(docs).collect()
    assert len(out) == len(corpus)
    by = {row[0]: tokens(row[1]) for row in corpus}
    for r in out:
        t = by[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t))
    for r in sorted(out, key=lambda r: r["n_tokens"])[:4]:
        t = [b"\n" if w is None else w.encode() + b" " for w in by[r["doc_id"]]]
        assert r["score"] == pytest.approx(sum(brute_ctw(raw, lm_scoring.DEPTH, x) for x in t) / math.log(10))
    assert lm_scoring.score(empty).count() == 0


def test_context_tree_sums_to_one():
    grams = np.sort(np.array([(97 << 8) | 98, (97 << 8) | 99, (98 << 8) | 97], np.uint64))
    every = np.array([(97 << 8) | b for b in range(256)], np.uint64)
    counts = np.array([5 if g in set(grams.tolist()) else 0 for g in every])
    tree = context_tree.levels(every, counts, 1)
    stop, _ = context_tree.weighted(tree)
    assert np.exp(context_tree.predicted(tree, stop)).sum() == pytest.approx(1)


def test_encoder_on_odd_words():
    import random

    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    bits = ["a", "B", "é", "É", "ŉ", "İ", "ß", "Σ", "ς", "1", "२", ".", "!", "#", "'", "'s", "'S", "\x01", "\u0301", "\u00a0", "\u2028", "<|endoftext|>", "中", "😀", "_", "-", "ǅ", "ª", "×", "ſ", "\u212a", "\u200d", "</w>", "\ufffd", "ﬁ"]
    words = ["".join(draw.choices(bits, k=draw.randint(1, 5))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)] + ["", "\x01", " \x01 a ", "a" * 5000, "The the THE. the."]
    bounds, ids = token_files.Encoder(path).encoded(pa.array(texts, pa.large_string()), 2)
    tokenizer = Tokenizer.from_file(path)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_token_files(spark, corpus, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(900, "don't. it's! <|endoftext|>, a—, İstanbul x1. ΟΔΟΣ n̈o. ¿qué? éa  b", None, None, 0, "", 0)]
    df = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.encoded_digests(df, path).collect())
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for row in sorted([*corpus, *odd], key=lambda r: r[0]):
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
        want.append((at, row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.encoded_digests(empty, path).count() == 0


def test_substring_dedup(spark, corpus, docs, empty):
    first = {}
    for row in corpus:
        w = words(row[1])
        for j in range(len(w) - 49):
            x = tuple(w[j : j + 50])
            first[x] = min(first.get(x, row[0]), row[0])
    want = []
    for row in corpus:
        w = words(row[1])
        gone = {p for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < row[0] for p in range(j, j + 50)}
        want.append((row[0], len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.removed(docs).drop("spans").collect()]
    assert sorted(got) == sorted(want) and any(n for _, _, n, _ in want)
    assert substring_dedup.removed(empty).count() == 0


def brute_split(children, given):
    """Whole tokens for children (name, weight over 0, capacity): water-filling in fractions, one saturated child after
    another; what rounding leaves goes to the first with room, by capacity / weight and name."""
    from fractions import Fraction

    order = sorted(children, key=lambda c: (Fraction(c[2]) / Fraction(c[1]), c[0]))
    if given >= sum(c for _, _, c in children):
        return {n: c for n, _, c in children}
    full = 0
    while True:
        left = given - sum(c for _, _, c in order[:full])
        level = Fraction(left) / sum(Fraction(w) for _, w, _ in order[full:])
        if Fraction(order[full][2]) / Fraction(order[full][1]) > level:
            break
        full += 1
    got = {n: c if i < full else min(c, math.floor(Fraction(w) * level)) for i, (n, w, c) in enumerate(order)}
    for n, _, c in order:
        got[n] += (more := min(c - got[n], given - sum(got.values())))
        assert more >= 0
    return got


def brute_budgets(leaves, budget, weights, epochs):
    """{leaf path: tokens} down a tree of any depth."""

    def down(prefix, given):
        here = {p: t for p, t in leaves.items() if p[: len(prefix)] == prefix}
        if list(here) == [prefix]:
            return {prefix: given}
        names = sorted({p[len(prefix)] for p in here})
        kids = [(n, weights.get(n, 1.0), epochs * sum(t for p, t in here.items() if p[len(prefix)] == n)) for n in names]
        out = {}
        for n, got in brute_split(kids, given).items():
            out |= down((*prefix, n), got)
        return out

    return down((), min(budget, epochs * sum(leaves.values())))


def test_budgets(spark):
    rng = np.random.default_rng(1)
    for budget in (37, 900, 4000, 11_111, 10**9):
        leaves, weights = {}, {f"n{k}": float(rng.integers(1, 9)) for k in range(30)}
        for i in range(40):
            leaves[f"n{i % 3}", f"n{3 + int(rng.integers(0, 4))}", f"n{7 + int(rng.integers(0, 20))}"] = int(rng.integers(0, 600))
        rows = [(*p, t) for p, t in leaves.items()]
        df = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
        by_level = {c: weights for c in ("domain", "lang", "source")}
        got = {(r["domain"], r["lang"], r["source"]): r["allocation"] for r in mixing.budgets(df, budget, weights=by_level, epochs=2).collect()}
        assert got == brute_budgets(leaves, budget, weights, 2)


def brute_mix(rows, levels, budget, weights, epochs, seed=mixing.SEED):
    """{(id, tokens): copies} of rows (id, text, level values)."""
    leaves, members = {}, {}
    for i, t, *values in rows:
        p = tuple("\x00none" if v is None else v for v in values)
        leaves[p] = leaves.get(p, 0) + len(words(t))
        members.setdefault(p, []).append((i, len(words(t))))
    out = {}
    for p, got in brute_budgets(leaves, budget, weights, epochs).items():
        full, rest = divmod(got, leaves[p]) if leaves[p] else (0, 0)
        key = lambda i: (int(hashlib.md5(f"{seed}:{full}:{i}".encode()).hexdigest()[:15], 16), str(i))  # noqa: E731,B023
        ranked, upto = sorted({(*key(i), n) for i, n in members[p]}), 0
        same = Counter((*key(i), n) for i, n in members[p])
        taken = set()
        for x in ranked:
            upto += x[2] * same[x]
            if upto > rest or not leaves[p]:
                break
            taken.add(x)
        out |= {(i, n): full + ((*key(i), n) in taken) for i, n in members[p]}
    return out


@pytest.mark.parametrize("ordered", [100_000, 1])  # one slicing; slices down to single keys
def test_mixing(spark, corpus, docs, empty, monkeypatch, ordered):
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": {"en": 3.0}, "source": {"s1": 2.0}}
    rows = [(r[0], r[1], r[2], r[3]) for r in corpus]
    clash = docs.withColumnsRenamed({"kept": "rest", "n_words": "full"}).withColumn("__order", F.lit("x")).withColumn("mix_tokens", F.lit("x")).withColumn("cut", F.lit(1))
    for budget in (9000, 41_000) if ordered > 1 else (9000,):
        mixed = mixing.mix(clash, budget, levels, weights, epochs=3)
        assert mixed.columns == [*[c for c in clash.columns if c != "mix_tokens"], "mix_tokens", "mix_copies"]
        got = mixed.collect()
        want = brute_mix(rows, levels, budget, {"en": 3.0, "s1": 2.0}, 3)
        assert len(got) == len(rows) and all(r["mix_copies"] == want[r["doc_id"], r["mix_tokens"]] and r["__order"] == "x" for r in got)
        assert sum(r["mix_copies"] for r in got) == mixing.expanded(mixed).count() > 0
    assert mixing.mix(empty, 0.5, levels).count() == 0


def brute_templates(pages):
    """{(host, segments): (template, rejected)} of pages (host, segments, bad or None), by recursion over each host."""
    out, z_of = {}, lambda a, n: (a + 0.5) / (n + 1)
    hosts = {}
    for h, segs, bad in pages:
        n = hosts.setdefault(h, {}).setdefault(segs, [0, 0, 0])
        n[0], n[1], n[2] = n[0] + 1, n[1] + (bad is not None), n[2] + (bad or 0)

    def grow(host, paths, level, template):
        kids = {}
        for segs, n in paths.items():
            if len(segs) < level:
                out[host, segs] = template
            else:
                kids.setdefault(segs[level - 1], {})[segs] = n
        total = np.sum([n for k in kids.values() for n in k.values()], axis=0) if kids else None
        branches = {}
        for seg, inside in kids.items():
            n, lab, bad = np.sum(list(inside.values()), axis=0)
            p = z_of(total[2], total[1])
            gap = abs(z_of(bad, lab) - z_of(total[2] - bad, total[1] - lab))
            z = gap / math.sqrt(p * (1 - p) * (1 / (lab + 1) + 1 / (total[1] - lab + 1)))
            own = n == total[0] or (lab >= url_filters.SUPPORT and z >= url_filters.Z)
            branches.setdefault(f"{template}/{seg if own else '*'}", {}).update(inside)
        for t, inside in branches.items():
            grow(host, inside, level + 1, t)

    for h, paths in hosts.items():
        grow(h, paths, 1, "")
    labelled = [(h, out[h, segs], bad) for h, segs, bad in pages]
    count = lambda keep: (sum(bad is not None for h, t, bad in labelled if keep(h, t)), sum(bad or 0 for h, t, bad in labelled if keep(h, t)))
    lab, bad = count(lambda h, t: True)
    base = 1 - (bad + 0.5) / (lab + 1)
    scores = {}
    for h, t in {(h, t) for h, t, _ in labelled}:
        lab, bad = count(lambda x, _: x == h)  # noqa: B023
        host = (lab - bad + 10 * base) / (lab + 10)
        lab, bad = count(lambda x, y: (x, y) == (h, t))  # noqa: B023
        p = (lab - bad + 10 * host) / (lab + 10)
        scores[h, t] = (p, p + 2 * math.sqrt(p * (1 - p) / (lab + 11)) < base)
    return {k: (t, *scores[k[0], t]) for k, t in out.items()}


def test_url_templates_against_recursion(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        host = f"h{min(int(rng.integers(0, 12)), 5)}.com"
        depth = int(rng.integers(0, 5))
        segs = [str(rng.choice(["a", "b", "c", "spam", "7"])) for _ in range(depth)]
        if i % 97 == 0:
            segs = ["deep"] * (30 + i % 2) + segs  # deeper than any usual path
        bad = None if rng.random() < 0.4 else int(rng.random() < (0.9 if "spam" in segs[:1] or host == "h1.com" else 0.1))
        rows.append((i, f"http://{host}/{'/'.join(segs)}", bad))
    rows += rows[:9]
    rows += [(9000, "http://h0.com/" + "y" * 100_000, None), (9001, None, 1), (9002, "no host", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int").withColumn("host", F.lit("clash"))
    got = url_filters.judged(df, F.col("bad") == 1, rules=(), keep=("page_id", "host"))
    assert got.columns == ["page_id", *url_filters.ADDED]
    parts = lambda u: ("", ()) if not u or "://" not in u else (u.split("/")[2], tuple("<n>" if x.isdigit() else x for x in u.split("/")[3:] if x))
    want = brute_templates([(*parts(u), bad) for _, u, bad in rows])
    url = {i: u for i, u, _ in rows}
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        template, purity, rejected = want[parts(url[r["page_id"]])]
        assert (r["template"], r["verdict"]) == (template, "block" if rejected else "allow") and r["purity"] == pytest.approx(purity)
    assert 50 < sum(r["verdict"] == "block" for r in out) < 1000


def test_url_filters(spark):
    urls = [f"https://a.example.com/{'bad' if i % 2 else 'good'}/{i}.html?x" for i in range(400)] + ["HTTP://WWW.Example.NET/de/8x#t", "http://x.org/es/", None, "nothing", "http://example.com/en/7", "http://b.com/en/1", "http://h"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    bad = F.when(F.col("page_id") < 300, F.col("page_id") % 2 == 1)
    out = {r["page_id"]: r for r in url_filters.judged(df, bad).collect()}
    assert len(out) == len(urls)
    assert [out[i]["verdict"] for i in (398, 399)] == ["allow", "block"] and out[399]["template"] == "/bad/<n>.html"
    at = len(urls) - 7
    assert [(out[at + i]["host"], out[at + i]["path"], out[at + i]["rule"], out[at + i]["verdict"]) for i in range(7)] == [
        ("www.example.net", "/de/8x", "example.net/de/8", "block"), ("x.org", "/es/", "org/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.com", "/en/7", "example.com/en/7", "allow"), ("b.com", "/en/1", "com/en/", "block"), ("h", "", None, "allow"),
    ]
    assert url_filters.judged(df.limit(0), bad).count() == 0


def test_sharding(spark, docs, empty):
    shards = [f"s{i}" for i in range(5)]
    table = sharding.lookup(shards, 101)
    counts = np.bincount(table)
    assert counts.sum() == 101 and counts.max() - counts.min() <= 1
    # brute force: whole preference lists, claimed in turns
    start = [sharding._number(s, "offset") % 101 for s in shards]
    skip = [sharding._number(s, "skip") % 100 + 1 for s in shards]
    lists = [iter([(a + j * b) % 101 for j in range(101)]) for a, b in zip(start, skip, strict=True)]
    want = {}
    while len(want) < 101:
        for i, x in enumerate(lists):
            if len(want) < 101:
                want[next(y for y in x if y not in want)] = i
    assert [want[i] for i in range(101)] == table.tolist()
    assert sharding.moved(shards, shards[:-1], 101) < 0.5
    out = sharding.assign(docs.withColumn("shard", F.lit("clash")), shards=shards, size=101)
    assert out.count() == docs.count() and all(shards[table[r["slot"]]] == r["shard"] for r in out.collect())
    assert sharding.assign(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup(shards, 100)


def brute_kept(rows):
    """Ids that the quality rules keep, of rows (id, text, lang, source, ...)."""
    fails = {}
    for i, t, _, source, *_ in rows:
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {p for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        fails[i] = source, {
            "short": len(w) < 50, "repeats": 100 * len(covered) > 50 * len(w), "symbols": 100 * len(re.findall(r"[#*$%&|<>]", t or "")) > 10 * sum(map(len, w)),
            "lines": 100 * (len(lines) - len(set(lines))) > 30 * len(lines),
        }
    verdicts = host_verdicts(list(fails.values()))
    return {i for i, (h, f) in fails.items() if not (f["short"] or f["repeats"] or verdicts[h][0] or any(f[r] for r in verdicts[h][1]))}


def test_pipeline(spark, tmp_path, corpus):
    """The pipeline's rows against brute force for every stage; the shard by the operator's table."""
    import corpus_pipeline
    from glosswork.llm.registry import MIX_WEIGHTS

    unique = list({row[0]: row for row in corpus}.values())
    spark.createDataFrame([row[:5] for row in unique], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(words(corpus[12][1])[-15:])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    good = brute_kept(unique)
    single = {c for _, c in brute_components([row for row in unique if row[0] in good]).values()}
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = alnum.findall(item.translate(LOWER))
    windows = {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
    touched = {i for i, t, *_ in unique if any(tuple(x[j : j + 10]) in windows for x in [alnum.findall((t or "").translate(LOWER))] for j in range(len(x) - 9))}
    left = [row for row in unique if row[0] in single - touched]
    number = lambda s: int((re.findall(r"[0-9]+", s or "") or ["0"])[0]) % 4
    rows = [(i, t, f"domain{number(source)}", lang, source) for i, t, lang, source, *_ in left]
    budget = int(corpus_pipeline.MIX_BUDGET * sum(len(words(r[1])) for r in rows))
    weights = {k: v for level in MIX_WEIGHTS.values() for k, v in level.items()}
    copies = brute_mix(rows, None, budget, weights, 1)
    want = {i for (i, _), n in copies.items() if n}
    assert len(out) == len(set(out)) and set(out) == want and 12 not in want and len(want) >= len(left) / 2


def test_pipeline_on_empty_and_repeated_rows(spark, tmp_path, corpus):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("repeated", [corpus[0][:5]] * 2 + [corpus[9][:5], (None, corpus[10][1], None, None, None)])):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = [r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()]
        assert set(out) <= {r[0] for r in rows} and (name != "empty" or not out)
