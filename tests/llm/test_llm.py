"""The operators against brute force, and on empty, null, repeated and clashing input."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import (
    common, embedding_dedup as ED, html_extract as HE, language_model as LM, licenses as LI, mixing as MX, near_dedup as ND, packing as PK, quality_classifier as QC,
    quality_rules as QR, toxicity as TX,
)

WORDS = [f"w{i}" for i in range(60)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rid string, h string"


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    texts = [text(rng, n) for n in (3, 80, 400, 60, 90)]
    texts += [texts[2] + " extra", texts[2], "", None, " \n\t ", "x", "über straße\nüber straße\n\nüber  straße", "long " * 30000, texts[1] + ".", "A b\x0bc"]
    return [(i if i != 3 else None, t, "en", ["a", "b", None, "c"][i % 4], 1, 0.5, "r", "h") for i, t in enumerate(texts)] + [(4, texts[4], "en", "a", 1, 0.5, "r", "h")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules_statistics(spark, docs, rows):
    def want(t):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))

    got = QR.with_stats(docs).select("text", "st.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want(r.text)
    more = spark.createDataFrame([("a # b ## c | d ** e",), ("x y z\nx y z\n \nx y z q",), ("\r\na\tb  c a\tb  c\f",)], "text string")
    for r in QR.with_stats(more).select("text", "st.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want(r.text)


@pytest.mark.parametrize("blank", ["\r", " \r", "\x0b", "\t"])
def test_rules_blank_lines(spark, blank):
    texts = [f"a b\r\n{blank}\nc d\r\n{blank}\ne f\r\n{blank}\ng", f"{blank}\na\na\n{blank}", f"a\n\n{blank}", f"a{blank}\nb", f"{blank}", "\n"]
    for r in QR.with_stats(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "st.*").collect():
        lines = [x for x in r.text.split("\n") if words(x)]
        assert (r.n_lines, r.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))


def test_rules_model():
    clean, junk = (1,) * len(QR.RULES), tuple(-1 if r.name in ("symbols", "marked_words") else 1 for r in QR.RULES)
    model = QR.fit([(clean, 900), (junk, 100)])
    post = lambda v: 1 / (1 + math.exp(-model.prior - sum(w[x + 1] for w, x in zip(model.weight, v, strict=True))))
    assert post(clean) > 0.9 and post(junk) < 0.01
    assert QR.fit([]).weight  # no votes at all


def test_mixing(spark, docs, rows):
    sizes, cuts = MX.mix(docs)
    got = MX.apply_mix(sizes, cuts).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {}
    for _, t, _, s, *_ in rows:
        by[s] = by.get(s, 0) + len(words(t))
    order = sorted((s for s in by if s is not None)) + [None]
    weight, budget, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(by.values()), set()
    while True:
        left = (budget - sum(2 * by[s] for s in full)) / max(sum(weight[s] for s in order if s not in full), 1e-9)
        over = {s for s in order if s not in full and left * weight[s] >= 2 * by[s]}
        if not over:
            break
        full |= over
    for r in got:
        s = r.skey[1:] if r.skey[0] == "0" else None
        assert r.source_size == by[s] and r.target == pytest.approx(2 * by[s] if s in full else left * weight[s], abs=1e-5)
        assert r.taken_times <= 2
    large = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    sizes, cuts = MX.mix(large)
    for r in MX.apply_mix(sizes, cuts).groupBy("skey").agg(F.sum(F.col("size") * F.col("taken_times")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 3
    assert MX.apply_mix(*MX.mix(docs.limit(0))).count() == 0


def test_licenses(spark, docs, rows):
    extra = ["Released under the MIT License.", "under the mit licence", "Apache License, Version 2.0; apache LICENSE version 2", "CC-BY NC cc by nc", "gnu general public license version 3",
             "Permission is hereby granted, free of charge, to any person (or body) obtaining a copy of this software and associated documentation files"]
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    many = many.unionByName(many.where("doc_id = 100"))
    found = LI.scan(many).collect()
    assert len(found) == len(rows) + len(extra) + 1
    of = {r.doc_id: r for r in found}
    labels = lambda i, base=None: sorted({p.label for p in of[i].places if base is None or p.base == base})
    assert [labels(100 + i) for i in range(6)] == [["mit"], [], ["apache-2"], ["cc-by-nc"], ["gpl", "gpl-3"], ["mit"]]
    assert [p["first"] for p in sorted(of[102].places, key=lambda p: p["first"]) if p["base"]] == [0, 5]
    assert sum(r.doc_id == 100 for r in found) == 2 and labels(105, True) == []
    assert LI.scan(docs.limit(0)).count() == 0


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(PK.default_tokenizer())
    got = PK.pack(docs, keep_ids=True).collect()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        ids = encode.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cut = [(0, min(first, len(ids))), *((a, 2048) for a in range(first, len(ids), 2048))]
        mine = [r for r in of[i] if r.piece < len(cut)]
        assert {(r.piece, r.start, r.length) for r in mine} == {(n, *c) for n, c in enumerate(cut)}
        for r in mine:
            own = np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(own) and bytes(r.ids) == own
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert PK.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(int(x) for x in rng.integers(1, 101, 700) ** (1 + seed % 2) // (100 ** (seed % 2)) + (seed % 2))
    counts = {min(k, 100): v for k, v in counts.items() if k}
    placed = PK.plan(counts, 100)
    bins, seen = {}, Counter()
    for n, first, end, per, sequence, offset in placed:
        for rank in range(first, end):
            bins.setdefault(sequence + (rank - first) // per, []).append((offset + (rank - first) % per * n, n))
            seen[n, rank] += 1
    assert seen == Counter((n, r) for n, c in counts.items() for r in range(c))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    assert len(bins) <= 1.06 * math.ceil(sum(n * c for n, c in counts.items()) / 100) + max(sum(c for n, c in counts.items() if n > 50) - sum(n * c for n, c in counts.items()) // 100, 0) + 1


def test_chunked_encoding_equals_whole(monkeypatch):
    enc = PK.Encoder(PK.default_tokenizer())
    odd = ["a  b", "x \n y", "\ta b", "don't. stop's, it's", "end ", "  lead", "a.\nB c,\nd", "a\n\nb", "é. ü, 12. 3,", "\0 x y", "<|endoftext|> hi", "w" * 100 + " " + "v" * 60 + ". z", "", "\n",
           "a .\nb ,", "Hi,\r\nyou", "x\x1cy z", "İx. ① a. b².", " x  y", "á. b", None, " ", "\n a", "q \x85 z\x85\ny"]
    letters = ["a", " ", "\n", "\t", ".", "\u3000", "é", "1", "'s"]
    odd += ["".join(x) for n in range(5) for x in itertools.product(letters, repeat=n)]
    for _ in range(2):  # the second time from what is remembered
        for texts in (odd, odd[::-1]):
            ids, many = enc.encode(pa.array(texts))
            ends = np.cumsum(many)
            for x, e, n, want in zip(texts, ends, many, enc.raw([x or "" for x in texts]), strict=True):
                assert ids[e - n : e].tolist() == [*want.tolist(), 0], x
    monkeypatch.setattr(PK, "KEPT_CHUNKS", 3)
    assert enc.encode(pa.array(["a b. c"]))[0].tolist() == [*enc.raw(["a b. c"])[0].tolist(), 0] and len(enc.kept) < 9
    assert not len(enc.encode(pa.array([], pa.string()))[0])


def test_packing_of_other_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(PK, "BUNDLE", 2)
    texts = [" ".join(f"v{i}" for i in range(n)) for n in (3, 5000, 0, 1200, 3, 3)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string").repartition(5)
    rows = rows.select(F.col("k").cast("decimal(20,2)").alias("doc_id"), "text", F.lit(1).alias("task"), F.lit("x").alias("length"))
    got = PK.pack(rows).collect()
    assert {int(r.doc_id) for r in got} == set(range(6)) and len({(r.sequence_id, r.offset) for r in got}) == len(got)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, docs, rows, monkeypatch, order):
    monkeypatch.setattr(LM, "RANGE_TOKENS", 2000)  # more ranges of pairs and triples than of words
    monkeypatch.setattr(LM, "RANGE_TRIPLES", 2000)
    held = F.coalesce(F.col("doc_id") % 3 == 2, F.lit(False))
    model = LM.train(docs.where(~held), "text", 5, order)
    got = LM.score(docs, model, held_out=held).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[*words((t or "").translate(lower)), None] for _, t, *_ in rows]
    train = [x for x, r in zip(toks, rows, strict=True) if not (r[0] is not None and r[0] % 3 == 2)]
    uni = Counter(w for x in train for w in x)
    n, v = sum(uni.values()), len(uni)

    def grams_of(x):
        padded = [""] * (order - 1) + x  # "" begins a text
        return [tuple(padded[i : i + order]) for i in range(len(x))]

    level = {order: Counter(g for x in train for g in grams_of(x))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    times = {k: Counter(c.values()) for k, c in level.items()}
    disc = {k: LM.discounts(np.asarray([0, *(c[i] for i in (1, 2, 3, 4))])) for k, c in times.items()}
    after = {}
    for k, c in level.items():
        for g, x in c.items():
            after.setdefault((k, g[:-1]), []).append(x)

    def p(*gram):
        k = len(gram)
        shorter = p(*gram[1:]) if k > 1 else 1 / (v + 1)
        if (k, gram[:-1]) not in after:
            return shorter
        some, d = after[k, gram[:-1]], disc[k]
        c = level[k][gram]
        return max(c - d[min(c, 3)], 0) / sum(some) + sum(d[min(x, 3)] for x in some) / sum(some) * shorter

    want = {}
    for x, (_, t, *_) in zip(toks, rows, strict=True):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x)
        want[t] = (len(x), sum(uni[w] > 0 for w in x), base, sum(math.log10(p(*g)) for g in grams_of(x)))
    texts = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r.train_tokens == n for r in got)
    for r in got:
        w = want[texts[r.doc_id]]
        assert (r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) and r.score == pytest.approx(w[3])
    assert max(level[order].values()) > 255  # more than a byte holds
    for context in ([""] * (order - 1), ["w1", "w2"][-order + 1 :], ["long"] * (order - 1)):
        assert sum(p(*context, w) for w in uni) + p(*context, "unseen") == pytest.approx(1)
    empty = LM.train(docs.limit(0), "text", 2, order)
    assert {round(r.score, 6) for r in LM.score(docs.where("doc_id = 10"), empty).collect()} == {0.0}
    with pytest.raises(ValueError, match="order"):
        LM.train(docs, "text", 2, 4)


def test_language_model_parts():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for width in (8, 13, 22, 31, 32):
        some = np.unique(x & np.uint64(2 ** (2 * width) - 1))
        mixed = LM.mix(some, width)
        assert (LM.unmix(mixed, width) == some).all() and (mixed <= np.uint64(2 ** (2 * width) - 1)).all()
        parts = LM.part_of(np.sort(mixed), 7, width)
        assert (np.diff(parts.astype(int)) >= 0).all() and set(parts.tolist()) == set(range(7))
    rng = np.random.default_rng(3)
    values = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 30, 2, 50)])
    ends = np.cumsum([0, 1, 30, 2, 50])
    lo, hi = np.repeat(ends - [0, 1, 30, 2, 50], 60), np.repeat(ends, 60)
    asked = np.tile(np.arange(-5, 55), 5)
    want = [next((i for i in range(a, b) if values[i] == q), -1) for a, b, q in zip(lo, hi, asked, strict=True)]
    assert LM.within(values, lo, hi, asked).tolist() == want
    keys, left, counts = rng.integers(0, 9, 400).astype(np.uint64), rng.integers(0, 9, 400).astype(np.uint32), rng.integers(0, 3, 400)
    want = Counter()
    for k, w, c in zip(keys.tolist(), left.tolist(), counts.tolist(), strict=True):
        want[k, w] += c
    k, w, c = LM.summed_triples(keys, left, counts)
    assert list(zip(zip(k.tolist(), w.tolist()), c.tolist())) == sorted(want.items())


def test_near_duplicates(docs, rows):
    got = ND.classified(docs).collect()
    assert len(got) == len(rows)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(t):
        w = words((t or "").translate(lower))
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    of = [grams(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(of):
            for j, b in enumerate(of):
                same = a == b or sum((a & b).values()) >= 0.8 * max(sum((a | b).values()), 1)
                if same:
                    label[j] = min(label[i], label[j])
    classes = Counter(label)
    sizes = {rows[i][0]: classes[label[i]] for i in range(len(rows))}
    assert all(r.members == sizes[r.id] for r in got)
    assert sum(r.rid == r["first"]["rid"] for r in got) == len(classes)
    assert ND.classified(docs.limit(0)).count() == 0


def test_weighted_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**52, 300).astype(np.uint64)
    a = rng.integers(1, 40, 300)
    b = np.maximum(a + rng.integers(-20, 21, 300), 0)
    doc, times = np.repeat([0, 1], 300), np.concatenate([a, b])
    k = times > 0
    s = ND.signatures(doc[k], np.concatenate([base, base])[k], times[k], 3, slots=4096)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)
    assert (s[2] == 0).all()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[50:120] = x[50] + rng.normal(scale=0.05, size=(70, 24))
    x[200:210] = x[200]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(300, None), (301, [0.0] * 24), (302, [float("nan")] + [1.0] * 23), (303, [None, 1.0]), (304, []), (305, [float("inf")] * 24), (None, rows[50][1]), (306, rows[50][1][:12])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("h", F.lit(2)).repartition(5)
    got = {r.vec_id: r for r in ED.dedup(df, tile=32).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(near, label[None, :], 999).min(1))
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    for i in range(300, 307):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert ED.dedup(df.limit(0)).count() == 0


def test_pages(spark):
    assert HE.blocks('<div id="nav-main">Home</div><div class="content"><h1>T &amp; x</h1><p>one <b>two<p>three&nbsp;four</div><div class=sidebar>s</div><p>last<script>"<p>"</script>') == [
        (0, "Home"), (1, "T & x"), (1, "one two"), (1, "three four"), (0, "s"), (1, "last")
    ]
    page = '<header>h</header><main><article><header><h1>Title</h1><p>by me</p></header><p>a<br>b</p><ul><li>x<li>y</ul><div class="ad">buy</div><aside>q</aside><p>z</article></main><footer>f'
    assert [t for k, t in HE.blocks(page) if k == 2] == ["Title", "a b", "x", "y", "z"]
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, f"http://h.org/{i}", f"<body><div>Welcome to the one and only portal of all good things today</div><p>{own(i)}</p>") for i in range(6)]
    rows += [(6, None, None), (7, "x", ""), (8, "http://h.org/8", "<article><p>kept</p></article><p>" + own(8)), (8, "http://h.org/8", "<p>" + "very long " * 20000), (9, "http://h.org/9", "<!-- open <p>x")]
    got = HE.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)).collect()
    of = {r.page_id: r for r in got if r.page_id != 8}
    assert len(got) == len(rows) and all(of[i].text == own(i) for i in range(6))
    assert of[6].text == "" and of[7].text == "" and of[9].text == "" and all(r.n_chars == len(r.text) for r in got)
    assert "kept" in {r.text for r in got}
    group = HE.suffix_groups(np.asarray([1, 2, 3, 1, 2, 3, 9, 1, 2], np.uint64), 2)
    same = {}
    for a, g in enumerate(group):
        same.setdefault(g, []).append(a)
    assert sorted(same.values()) == [[0, 3, 7], [1, 4], [2], [5], [6], [8]]


def test_pages_with_odd_attributes_and_ordinary_names():
    texts = lambda page: [t for k, t in HE.blocks(page) if k != 0]
    assert texts("<div><a title=don't>hi</a><p>It's fine</p><p>more</p></div>") == ["hi", "It's fine", "more"]
    assert texts("<p a='x>y' b=\"p>q\" c = d>one</p><p '>two</p><p a=\"open>three") == ["one", "two", "three"]
    for name in ("share-price", "related-work", "modal-verbs", "notice-of-hearing", "search-theory", "header-file", "social_history", "ad-hoc", "comment-on-hegel"):
        assert texts(f"<article><section class='{name}'><p>kept</p></section></article>") == ["kept"], name
        assert texts(f"<div class={name} id={name}><article><p>kept</p></article></div>") == ["kept"], name
    for name in ("share", "share-buttons", "related-posts", "modal", "cookie-notice", "site-header", "ad-300x250", "comment-list", "newsletter_signup_form", "nav-main", "sidebar-left"):
        assert texts(f"<article><div class='x {name}'><p>gone</p></div><p>kept</p></article>") == ["kept"], name
    long = "<p a=" + "'" * 50000 + "=" * 50000
    assert HE.blocks(long) == [] and texts(long + ">x") == ["x"]


def test_pages_repeats_against_brute_force(spark):
    """Runs of several lengths planted in pages without an article; what stays is what no three pages of a host share."""
    rng = np.random.default_rng(9)
    shared = [" ".join(f"s{i}k{j}" for j in range(n)) for i, n in enumerate((2, 5, 8, 9, 30, 70))]
    rows, parsed = [], {}
    for i in range(60):
        parts = []
        for b in range(5):
            own = [f"o{i}b{b}w{j}" for j in range(int(rng.integers(0, 12)))]
            if rng.random() < 0.6:
                own.insert(int(rng.integers(0, len(own) + 1)), shared[int(rng.integers(0, 6))])
            parts.append(" ".join(own).split())
        host = ["a.org", "b.org", ""][0 if i % 3 else i % 7 % 3]
        rows.append((i, f"http://{host}/{i}" if host else None, "<body>" + "".join(f"<p>{' '.join(p)}</p>" for p in parts)))
        parsed[i] = (host, [p for p in parts if p])

    def runs(p):
        return {(k, tuple(p[k : k + HE.RUN])) for k in range(len(p)) if k + HE.RUN <= len(p) or not k}

    pages = Counter()
    for host, parts in parsed.values():
        pages.update({(host, len(r) < HE.RUN, r) for p in parts for _, r in runs(p)})
    want = {}
    for i, (host, parts) in parsed.items():
        left = []
        for p in parts:
            gone = {k + d for k, r in runs(p) if pages[host, len(r) < HE.RUN, r] >= HE.PAGES for d in range(len(r))}
            left.append(" ".join(w for k, w in enumerate(p) if k not in gone))
        want[i] = "\n".join(x for x in left if x)
    got = {r.page_id: r.text for r in HE.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == want and sum(t.count("s5k9 ") for t in want.values()) < 5


def test_pages_with_articles_go_through_the_suffix_array(spark, monkeypatch):
    """Every page's blocks outside the article are held against the host's repeats, whole hosts or dealt to several arrays; articles stay whole."""
    rng = np.random.default_rng(4)
    menus = [" ".join(f"m{i}k{j}" for j in range(n)) for i, n in enumerate((1, 4, 9, 20))]
    rows, streams = [], {}
    for i in range(90):
        host, menu = f"h{i % 2}.org", menus[int(rng.integers(0, 4))]
        outside = [menu, f"only{i} {menus[3]} end{i}" if i % 5 == 0 else f"own words of page {i}"]
        rows.append((i, f"http://{host}/{i}", f"<nav>{outside[0]}</nav><article><p>{menu} text {i}</p></article><footer>{outside[1]}</footer>"))
        streams[i] = (host, [x.split() for x in outside])
    rows += [(100 + i, "http://h0.org/copy", rows[0][2].replace("text 0", "text copy").replace("only0", "once")) for i in range(4)]
    runs = lambda p: {(k, len(p) < HE.RUN, tuple(p[k : k + HE.RUN])) for k in range(len(p)) if k + HE.RUN <= len(p) or not k}
    streams |= {100 + i: ("h0.org", [x.split() for x in (rows[0][2][5:].split("</nav>")[0], f"once {menus[3]} end0")]) for i in range(4)}
    pages = Counter()
    for i, (host, parts) in streams.items():
        if i <= 100:  # the copies are one page
            pages.update({(host, *r[1:]) for p in parts for r in runs(p)})
    want = {i: sum(len({k + d for k, short, r in runs(p) if pages[host, short, r] >= HE.PAGES for d in range(len(r))}) for p in parts) for i, (host, parts) in streams.items()}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for host_pages, words in ((1000, 1_000_000), (7, 1_000_000), (1000, 40), (7, 20)):
        monkeypatch.setattr(HE, "HOST_PAGES", host_pages)
        monkeypatch.setattr(HE, "ARRAY_WORDS", words)
        got = HE.extract(df).collect()
        assert {r.page_id: r.n_covered for r in got} == want and len(got) == 94
        assert all(r.text == r_html.split("<p>")[1].split("</p>")[0] for r in got for i, _, r_html in rows if i == r.page_id)
    assert 0 < sum(v > 0 for v in want.values()) and HE.extract(df.limit(0)).count() == 0


def test_pages_lose_only_what_repeats(spark):
    own = lambda i, n=6: " ".join(f"w{i}x{j}" for j in range(n))
    menu = "one menu of ten words that all the pages share"
    rows = [(i, f"http://h.org/{i}", f"<body><p>{menu} {own(i)}</p>") for i in range(5)]
    rows += [(10 + i, f"http://copy.org/{i}", f"<body><p>{own(10, 30)}</p>") for i in range(3)] + [(20 + i, None, f"<body><p>{own(20, 30)}</p>") for i in range(3)]
    got = {r.page_id: r.text for r in HE.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {i: own(i) for i in range(5)} | {10 + i: own(10, 30) for i in range(3)} | {20 + i: own(20, 30) for i in range(3)}


def test_toxicity():
    rng = np.random.default_rng(2)
    sample = []
    for i in range(600):
        t = [text(rng, 12) for _ in range(6)]
        if i % 3 == 0:
            t[i % 6] += f" grumm{'abcdefgh'[i % 8]}{i % 7}"
        sample.append((". ".join(t) + ".", int(i % 3 == 0)))
    scorer = TX.Scorer(TX.fit(sample))
    score, found, _ = scorer.document("w1 w2 w3. w5 grummzz w9. w4")
    assert score > 0.5 and found == [1] and scorer.document("w1 w2 w3. w5 w9.")[0] < 0.5
    assert scorer.document(None)[0] == scorer.document("")[0] == 0.0
    assert TX.Scorer(TX.fit([])).document("w1")[0] == 0.0


def test_toxicity_of_long_clean_texts():
    rng = np.random.default_rng(3)
    sample = [(". ".join([text(rng, 12) for _ in range(6)] + [f"grumm{'abcdefgh'[i % 8]}{i % 7}"] * (i % 3 == 0)), int(i % 3 == 0 or i % 50 == 1)) for i in range(600)]
    scorer = TX.Scorer(TX.fit(sample))
    long = ". ".join(text(rng, 12) for _ in range(20000))
    assert scorer.document(long)[0] < 0.5 < scorer.document(long + ". a grummzz")[0]


def test_sample_has_texts_of_every_length(spark):
    texts = [(i, "w1 w2. " * (20000 if i % 5 == 0 else 5)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    taught = [t for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    got = common.labelled_sample(docs, labels, "toxic", TX.SAMPLE, 10**8)
    assert Counter(t for t, _ in got) == Counter(taught) and max(len(t) for t, _ in got) == 140000
    some = common.labelled_sample(docs, labels, "toxic", TX.SAMPLE, 400000)
    assert 400000 <= sum(len(t) for t, _ in some) < 400000 + 140000 and not Counter(t for t, _ in some) - Counter(taught)
    assert common.labelled_sample(docs.limit(0), labels, "toxic", TX.SAMPLE, 10**8) == []


@pytest.mark.parametrize("most", [TX.SAMPLE, QC.SAMPLE])
def test_sample_keeps_the_shares_of_labels(spark, most):
    shares = []
    for n in (3000, 30000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
        labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
        got = [y for _, y in common.labelled_sample(docs, labels, "toxic", most, 10**8)]
        shares.append(sum(got) / len(got))
    assert len(got) == 6000 and shares == pytest.approx([1 / 9, 1 / 9], abs=0.015)


def test_toxicity_rows(docs, rows):
    got = TX.score(docs, TX.fit([])).collect()
    assert len(got) == len(rows) and all(r.score == 0 for r in got)


def test_quality_trees(docs, rows):
    rng = np.random.default_rng(4)
    good = [QC.statistics(text(rng, 80) + ".") for _ in range(300)]
    bad = [QC.statistics(" ".join([WORDS[i % 60]] * 50)) for i in range(100)]
    x, y = np.asarray(good + bad), np.asarray([1.0] * 300 + [0.0] * 100)
    forest = QC.fit(x[::2], y[::2])
    assert ((forest.predict(x[1::2]) >= 0.3) == (y[1::2] == 1)).all()
    assert QC.fit(x[:0], y[:0]).predict(x[:2]) == pytest.approx([0.5, 0.5])
    assert QC.fit(x[:9], y[:9]).predict(x[:1])[0] > 0.9
    got = QC.with_score(docs, forest, "text", ["doc_id", "score"]).collect()
    assert len(got) == len(rows) and all(0 <= r["__score"] <= 1 for r in got)
    assert len(QC.statistics(None)) == len(QC.FEATURES)


def test_cell_links_join_what_brute_force_joins():
    rng = np.random.default_rng(11)
    base = rng.choice(10**6, 60, replace=False)
    sets = []
    for i in range(80):
        own = base.copy()
        own[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(10**6, 2 * 10**6)
        sets.append(np.unique(own).astype("<u4"))
    keys = [bytes([i]) * 16 for i in range(80)]
    comps = [keys[0] if i % 3 else keys[i] for i in range(80)]
    minor = np.asarray([c != keys[0] for c in comps])
    rows = np.flatnonzero(minor).tolist() + list(range(80))
    flags = np.asarray([True] * int(minor.sum()) + [False] * 80)
    got = ND.cell_links([keys[r] for r in rows], [comps[r] for r in rows], [sets[r].tobytes() for r in rows], flags, 0.8)

    def joined(links):
        up = {k: k for k in keys}

        def find(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in [*zip(keys, comps, strict=True), *links]:
            up[find(a)] = find(b)
        return {frozenset(j for j in keys if find(j) == find(k)) for k in keys}

    real = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = [(keys[i], keys[j]) for i in range(80) for j in range(80) if minor[i] and i != j and real(sets[i], sets[j])]
    assert want and joined(got) == joined(want) and len(got) < 80


def test_hot_buckets(spark, monkeypatch):
    """Groups of near copies that the leaders of their buckets do not join, in cells of a few rows."""
    monkeypatch.setattr(ND, "MINORS", 3)
    monkeypatch.setattr(ND, "OTHERS", 5)
    rng = np.random.default_rng(12)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for i in range(60):
        own = list(base)
        for p in rng.choice(120, rng.integers(0, 4), replace=False):
            own[p] = f"x{i}y{p}"
        texts.append(" ".join(own))
    got = ND.classified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    grams = [Counter(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if sum((grams[i] & grams[j]).values()) >= 0.8 * sum((grams[i] | grams[j]).values()):
                    label[i] = label[j] = min(label[i], label[j])
    first = {r["class"]: r["first"]["id"] for r in got}
    assert {r.id: first[r["class"]] for r in got} == dict(enumerate(label))
