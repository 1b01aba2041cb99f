import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramframe.llm import decontam, html_text, line_dedup, near_dup, packing, quality, resampling, toxicity, url_filter, warc
from gramframe.llm import textvec as tv

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, node string, label int, words string"
BASE = "the quick brown fox jumps over the lazy dog while seven bright stars watch above the quiet river bank tonight".split()


def frame(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 3, "w") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "a b"), (5, "a b"), (6, "é ü\x1c<|endoftext|>")]


def test_words_and_shingles():
    data, offs = tv.utf8(pa.array(["a bb  a", None, "", "bb\n a", "a bb"]))
    w = tv.Words(data, offs)
    assert w.count.tolist() == [3, 0, 0, 2, 2] and w.hash[0] == w.hash[2] == w.hash[4] and len(set(w.hash.tolist())) == 2
    doc, h = w.shingles(3)
    assert doc.tolist() == [0, 3, 4] and len(set(h.tolist())) == 3


def test_line_dedup(spark):
    line = " ".join(BASE)
    edited, longer, far = " ".join(["x", *BASE[1:]]), " ".join([*BASE, "y"]), " ".join(["x", "y", *BASE[2:]])
    docs = frame(spark, [*ODD, (10, f"{line}\nfirst"), (11, f"{edited}\n{line}"), (12, longer), (13, far), (14, "short\nfirst")])
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert (10, f"{line}\nfirst") in got and (11, "") in got and (12, "") in got and (14, "short") in got and (1, None) in got and (2, "") in got
    assert (13, "") in got  # within one word of the earlier edited line
    assert line_dedup.dedup_lines(docs).count() == docs.count() and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [(i, "\n".join(" ".join(rng.choice(["a", "b", "c"], rng.integers(8, 10))) for _ in range(4))) for i in range(60)]
    got = {r["doc_id"]: r["n_dropped_lines"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}

    def near(a, b):
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        j = next((k for k, (x, y) in enumerate(zip(a[i:][::-1], b[i:][::-1])) if x != y), min(len(a), len(b)) - i)
        return max(len(a), len(b)) - i - j <= 1

    seen, want = [], {}
    for i, t in texts:
        want[i] = 0
        for line in (x.split() for x in t.split("\n")):
            want[i] += any(near(line, x) for x in seen)
            seen.append(line)
    assert got == want


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    p = packing.Packing(capacity=64, partition_rows=40, rounds=3)
    texts = [*ODD, (7, "a <|endoftext|> b"), (8, "x<|endoftext|>"), *((100 + i, " ".join(BASE[: i % 18])) for i in range(200))]
    rows = packing.pack_documents(frame(spark, texts), p).toPandas()
    for doc, text in texts:
        ids = np.append(plain.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
        own = rows[rows.doc_id == doc].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 64).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert packing.bound(spark.createDataFrame(rows[["length"]]), p) == packing.lower_bound(rows.length.to_numpy(), 64) <= rows.sequence_id.nunique()
    full = rows.groupby("sequence_id").length.sum() == 64
    assert rows.groupby("sequence_id").certified.first()[full].all()
    assert rows.sequence_id.nunique() <= 1.02 * packing.lower_bound(rows.length.to_numpy(), 64) + 1
    assert packing.pack_documents(frame(spark, []), p).count() == 0


def test_gaps_are_packed_again(spark):
    rng, p = np.random.default_rng(14), packing.Packing(capacity=64, partition_rows=20, rounds=3)
    lengths = rng.integers(10, 40, 300).tolist()
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows, p).toPandas()
    assert sorted(got.length) == sorted(lengths) and (got.groupby("sequence_id").length.sum() <= 64).all()
    assert len({x // (1 << 56) for x in got.sequence_id}) > 1  # some went to a later round
    alone = packing.pack(rows, packing.Packing(capacity=64, partition_rows=20, rounds=1)).select("sequence_id").distinct().count()
    assert packing.bound(rows, p) <= got.sequence_id.nunique() <= alone


@pytest.mark.parametrize("seed", range(5))
def test_lower_bound_is_one(seed):
    lengths = np.random.default_rng(seed).integers(1, 21, 7)
    best = next(k for k in range(1, 8) if any(all(sum(x for x, b in zip(lengths, where) if b == c) <= 20 for c in range(k)) for where in itertools.product(range(k), repeat=7))) if seed < 3 else packing.best_fit(lengths, 20)[2]
    assert packing.lower_bound(lengths, 20) <= best <= packing.best_fit(lengths, 20)[2]


def test_url_filter(spark):
    entries = spark.createDataFrame([("bad.org", "deny", 10), ("ok.bad.org", "allow", 20), ("bad.org", "remove", 30), ("bad.org", "remove", 30), ("good.net/x/", "deny", 0), (None, "deny", 0)], "key string, action string, since long")
    asked = [(1, "http://bad.org/", 5, False), (2, "http://a.BAD.org/p", 10, True), (3, "http://ok.bad.org/", 25, False), (4, "http://bad.org/", 30, False), (5, "https://u:p@good.net:80/x/y?q", 1, True), (6, "https://good.net/xy", 1, False), (7, None, 1, False), (8, "http://bad.org", None, False), (8, "http://bad.org", None, False), (9, "", 1, False)]
    pages = spark.createDataFrame([(*x, "z") for x in asked], "page_id long, url string, time long, want boolean, key string")
    got = url_filter.evaluate(pages, entries)
    assert sorted((r["id"], r["blocked"]) for r in got.collect()) == sorted((x[0], x[3]) for x in asked)
    assert url_filter.evaluate(pages, entries.limit(0)).where("blocked").count() == 0 and url_filter.evaluate(pages.limit(0), entries).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(None, "http://c.org/", "same", 1), (None, "http://c.org/", None, 1), (7, "http://a.org/long", "long é " * 200_000, 1), (3, "http://b.org/", "same", 1), (1, "http://a.org/\r\nX: y", "same", 1), (2, None, None, 1), (4, "http://a.org/1", "", 1), (5, "http://www.a.org/1", "é\r\n\r\nWARC/1.1\r\n" * 3, 1), (5, "http://www.a.org/1", "é\r\n\r\nWARC/1.1\r\n" * 3, 1)], "page_id long, url string, html string, digest int")
    warc.write_archives(pages, str(tmp_path / "w"), warc.Warc(file_bytes=900), time=F.lit("2024-01-01T00:00:00Z"))
    rows = warc.index(spark, str(tmp_path / "w")).orderBy("position").collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows} == {(1, "response", None), (3, "revisit", 1), (2, "response", None), (4, "revisit", 2), (5, "response", None), (7, "response", None), (None, "response", None)} and len(rows) == 9
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    files = [r["archive"] for r in rows]
    assert len(set(files)) > 2 and [f for r, f in zip(rows, files) if r["page_id"] == 7][0] not in [f for r, f in zip(rows, files) if r["page_id"] != 7]
    assert all(r["page_id"] is None or r["payload_bytes"] == len(want[r["page_id"]]) and r["payload_digest"] == base64.b32encode(hashlib.sha1(want[r["page_id"]]).digest()).decode() for r in rows)
    keys = [(r["url_key"], r["time"], r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.index(spark, str(tmp_path / "e")).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(2)
    runs = [sorted(rng.integers(0, 50, n).tolist()) for n in (0, 5, 1, 9, 30)]
    assert list(warc.LoserTree(runs)) == sorted(sum(runs, [])) and list(warc.LoserTree([])) == []


def test_decontamination(spark):
    item = " ".join(BASE)
    edited = " ".join(w if i % 6 else "changed" for i, w in enumerate(BASE))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "two words")], "item_id long, text string")
    docs = frame(spark, [*ODD, (10, f"before {item.upper()}, after"), (11, f"before {edited} after"), (12, " ".join(BASE[:3]) + " and then nothing like it"), (13, "has two, words here")])
    got = {(r["id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(10, 1), (11, 1), (13, 3)}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("copies", [0, 3])
@pytest.mark.parametrize("every", [4, 5])
def test_decontamination_of_edited_copies(spark, every, copies):
    words = [f"w{i}" for i in range(40)]
    edited = " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(words))
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = frame(spark, [(10, f"before {edited} after"), *((20 + k, " ".join(words)) for k in range(copies))])
    assert {r["id"] for r in decontam.leaks(docs, bench).collect()} == {10, *range(20, 20 + copies)}


def test_alignment_against_the_plain_recurrence():
    rng, p = np.random.default_rng(3), decontam.Decontam()
    for _ in range(30):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 12)
        h = np.zeros((10, 13), int)
        for i in range(9):
            for j in range(12):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b, p)[0] == h.max()


def test_resampling(spark):
    good, bad = " ".join(BASE), " ".join(f"{w}###" for w in BASE)
    texts = [(i, f"{good} {i}") for i in range(40)] + [(100 + i, f"{bad} {i}") for i in range(10)] + [(999, None), (998, "")]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    rows = resampling.resample(frame(spark, texts), labels).collect()
    kept = {r["id"] for r in rows if r["kept"]}
    assert len(kept & set(range(40))) >= 35 and len(kept & set(range(100, 110))) <= 1 and not kept & {998, 999} and {r["log_ratio"] for r in rows if r["id"] in (998, 999)} == {None}
    assert resampling.resample(frame(spark, texts), labels, resampling.Resampling(take=7, exact_rows=3)).where("kept").count() == 7
    assert resampling.resample(frame(spark, []), labels).count() == 0


def test_html():
    page = """<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><header>site</header><div class="cookie-notice">cookies</div>
<article><header><h1>Title</h1><span>by</span></header><p>One <b>two</b>&amp;<p>three<br>four<script>bad()</script><ul><li>a<li>b</ul><div class="comments"><p>me first</div><aside>side</aside></article><footer>&copy;</footer><p"""
    own = html_text.Html()
    assert html_text.Page(page).main(None, own) == "Title\n\nOne two&\n\nthree four\n\na\n\nb"
    assert html_text.Page("").main(None, own) == "" and html_text.Page("just text").main(None, own) == "just text"


def test_html_that_once_lost_its_text(spark):
    own, say = html_text.Html(), " ".join(["some words of an article"] * 10)
    read = lambda x: html_text.Page(x).main(None, own)
    assert read(f'<div class="wrapper has-sidebar"><article><p>{say}</p></article><div class="sidebar">side</div></div>') == say
    assert read(f'<div class="page-sidebar-wrapper"><main><p>{say}</p></main></div>') == say
    assert read(f'<article><div class="post-header"><h1>Title</h1><span>by</span></div><p>{say}</p></article>') == f"Title\n\n{say}"
    assert read(f"<article><video src=x><p>{say}</p></article>") == say
    pages = [(i, f"http://h/{i}", f"<body><div class=a><p>{say}</p></div></body>") for i in range(5)] + [(9, "http://h/9", f"<body><div class=a><p>two words</p></div><div class=b><p>{say}</p></div></body>")]
    got = {r["id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9].endswith(say) and got[0] == say


def test_html_of_great_depth():
    import time

    page = html_text.Page("<div>" * 100_000 + "<p>deep text</p>" + "</div>" * 100_000)
    began = time.time()
    assert page.main(None, html_text.Html()) == "deep text" and time.time() - began < 20
    many = html_text.Page("".join(f"<div><p>word{i}</p>" for i in range(30_000)))
    assert many.main(None, html_text.Html()).startswith("word0\n\nword1\n\n")


def test_html_article_of_sections_with_long_comments(spark):
    say = lambda w, n: " ".join([w] * (n // (len(w) + 1)))
    page = f"<body><nav><a href=x>menu</a></nav><article><h1>Title</h1><section class=intro><p>{say('intro', 300)}</p></section><section class=body><p>{say('body', 600)}</p><blockquote><p>{say('quoted', 200)}</p></blockquote></section><div class=comments><p>{say('me', 900)}</p></div></article></body>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page) for i in range(3)], "page_id long, url string, html string")
    want = "\n\n".join(["Title", say("intro", 300), say("body", 600), say("quoted", 200)])
    assert [r["text"] for r in html_text.extract(pages).collect()] == [want] * 3


def test_html_query_form(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<body><div class=c1><p>text one here</p></div><div class=x><a href=y>z</a></div></body>", 1), (2, None, None, 1), (2, None, None, 1), (3, "http://h/2", "<p>loose</p>", 1)], "page_id long, url string, html string, host int")
    assert sorted((r["id"], r["text"]) for r in html_text.extract(pages).collect()) == [(1, "text one here"), (2, ""), (2, ""), (3, "loose")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(4)
    clean = lambda: " ".join(rng.choice(["the", "of", "and", "river", "stone", "cloud", "apple", "window", "garden", "to", "in"], 80))
    texts = [*ODD, *((100 + i, clean()) for i in range(40)), (200, " ".join(f"{w}***" for w in clean().split()))]
    got = {r["id"]: r for r in quality.judge(frame(spark, texts)).collect()}
    assert all(got[100 + i]["kept"] for i in range(40)) and not got[200]["kept"] and not got[200]["base_failed"]
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
    assert got[4]["n_repeat_words"] == 30_000 and got[1]["base_failed"]
    assert quality.filter(frame(spark, texts)).count() == 40 and quality.judge(frame(spark, [])).count() == 0


def test_quality_of_a_language_with_few_documents(spark):
    rng = np.random.default_rng(9)
    say = lambda common, n: " ".join(rng.choice([*common, "river", "stone", "cloud"], n))
    docs = frame(spark, [(i, say(["the", "of", "and", "to", "in"], 300)) for i in range(40)]).unionByName(frame(spark, [(100 + i, say(["de", "la", "que", "el", "los"], 3000)) for i in range(5)]).withColumn("lang", F.lit("es")))
    got = {r["id"]: r for r in quality.judge(docs, quality.Quality(repeat_percent=100)).collect()}
    assert all(r["kept"] for r in got.values()) and got[100]["word_distance"] is None and got[0]["word_distance"] is not None


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [(i, " ".join([word() for _ in range(30)] + (["zonker"] if i % 5 == 0 else []))) for i in range(400)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    held = lambda c: c % 3 == 0
    rows = toxicity.score(frame(spark, texts), labels, held).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["id"] % 5 == 0) for r in rows if r["id"] < 400]) > 0.97 and len(rows) == 402 and all(r["score"] < 0.5 for r in rows if r["id"] >= 1000)
    assert toxicity.score(frame(spark, texts), labels.limit(0), held).where("score > 0").count() == 0 and toxicity.score(frame(spark, []), labels, held).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng, texts = np.random.default_rng(6), list(ODD)
    for g in range(12):
        base = [f"w{g}_{i}" for i in range(60)]
        for k in range(5):
            own = list(base)
            for j in rng.integers(0, 60, k):
                own[j] = f"x{j}"
            texts.append((100 + 10 * g + k, " ".join(own)))
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else {("", t or "")} for i, t in texts}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(frame(spark, texts), near_dup.NearDup(block=3)).collect()}
    assert got == root
    kept = near_dup.keep_one(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(7)
    a, b = {int(x): 1 + rng.random() for x in range(60)}, {int(x): 1 + rng.random() for x in range(20, 80)}
    want = sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in {*a, *b}) for d in {*a} & {*b})
    ids = np.array([*a, *b], np.uint64) + np.uint64(1)
    sig = near_dup.prob_minhash(np.repeat([0, 1], 60), ids, np.array([*a.values(), *b.values()]), 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)


def test_near_duplicates_share_bands_whatever_their_repeats():
    p, once = near_dup.NearDup(), [f"w{i}" for i in range(304)]
    missed = 0
    for k in range(60):
        own = [f"{w}_{k}" for w in once]
        passage = [f"p{i}_{k}" for i in range(40)]
        key, sig, _ = near_dup.band_keys(pa.array([" ".join(own), " ".join(own + passage * 50)]), p)
        a, b = ({tuple(t[i : i + p.words]) for i in range(len(t) - p.words + 1)} for t in (own, own + passage * 50))
        assert p.similarity <= len(a & b) / len(a | b) < 0.9
        missed += not (key[0] == key[1]).any()
    assert missed == 0


def test_null_ids_have_near_matches(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "x"])
    docs = frame(spark, [(None, " ".join(words)), (1, near), (2, "quite another text of some words that is longer")])
    assert {(r["id"], r["class_id"]) for r in near_dup.near_duplicates(docs, near_dup.NearDup(block=3)).collect()} == {(None, 1), (1, 1), (2, 2)}
    assert sorted(r["doc_id"] for r in near_dup.keep_one(docs).collect()) == [1, 2]
    assert {r["doc_id"]: r["n_dropped_lines"] for r in line_dedup.dedup_lines(docs).collect()} == {None: 0, 1: 1, 2: 0}


def test_decontamination_against_brute_force(spark):
    """Every document and item, with no seeds."""
    rng, p = np.random.default_rng(12), decontam.Decontam()
    items = [(i, " ".join(f"i{i}w{rng.integers(0, 400)}" for _ in range(rng.integers(20, 50)))) for i in range(6)]
    docs = []
    for d in range(60):
        words = [f"c{rng.integers(0, 300)}" for _ in range(60)]
        for _ in range(rng.integers(0, 3)):
            own = items[rng.integers(0, 6)][1].split()
            own = [w if rng.random() > rng.choice([0, 0.1, 0.3, 0.6]) else "edit" for w in own]
            at = rng.integers(0, 60)
            words[at:at] = own
        docs.append((d, " ".join(words)))
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = (np.unique(text.split() + item.split(), return_inverse=True)[1] for _ in range(2))
            n = len(text.split())
            if decontam.align(a[n:], b[:n], p)[0] >= p.min_score * p.match * len(item.split()):
                want.add((d, i))
    got = {(r["id"], r["item_id"]) for r in decontam.leaks(frame(spark, docs), spark.createDataFrame([*items, items[0]], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(13)
    texts = [(100 + i, "\n".join(" ".join(rng.choice(["the", "a", "b", "#c", "é", " "], rng.integers(0, 12))) for _ in range(rng.integers(0, 20)))) for i in range(80)] + list(ODD)
    for r in quality.judge(frame(spark, texts)).collect():
        text = dict(texts)[r["id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 1000 else set(range(len(words)))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_pipeline_of_empty_and_odd_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, None, 1) for i, t in ODD] + [(None, " ".join(BASE), "en", "s", 1)] * 2, kinds)
    for docs, ids in ((odd, {None}), (odd.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert {r["doc_id"] for r in docs.collect()} == ids and docs.columns[:2] == ["doc_id", "piece"]


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    clean = lambda: " ".join(rng.choice([f"word{i}" for i in range(40)] + ["the", "of", "and"], 70))
    docs = spark.createDataFrame([(i, clean(), "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(50).cast("long"))).unionByName(docs.where("doc_id = 4").withColumn("text", F.lit("# # #")))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(30))


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_lines_that_a_polynomial_would_confuse(spark):
    signs = thue_morse(1024)
    one, other = (" ".join("alpha" if s == flip else "beta" for s in signs) for flip in (0, 1))
    got = line_dedup.dedup_lines(frame(spark, [(1, one), (2, other), (3, one)])).collect()
    assert {r["doc_id"]: r["n_dropped_lines"] for r in got} == {1: 0, 2: 0, 3: 1}
    texts = ["".join("ab"[s ^ flip] for s in thue_morse(4096)) for flip in (0, 1)]
    assert len(set(tv.Words(*tv.utf8(pa.array(texts))).hash.tolist())) == 2


def test_line_dedup_of_a_long_document(spark):
    lines = [f"line {i}" for i in range(20_000)]
    docs = frame(spark, [(1, "\n".join(lines[:10_000])), (2, "\n".join(lines))])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2]["n_dropped_lines"] == 10_000 and got[2]["text"] == "\n".join(lines[10_000:]) and got[1]["n_dropped_lines"] == 0


def test_heavy_and_light_keys_join_alike(spark):
    from gramframe.llm.common import join_split

    rows = spark.range(6000).select((F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 3999)).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    got = join_split(rows, keys, ["k"])
    assert got.count() == 6000 and got.select("id").distinct().count() == 6000


def test_near_duplicates_with_repeats_against_brute_force(spark):
    """Recall of links between texts whose shingles repeat, in one group of near copies."""
    rng, base, texts = np.random.default_rng(15), [f"w{i}" for i in range(120)], []
    for k in range(60):
        own = list(base)
        for j in rng.choice(120, rng.integers(1, 6), replace=False):
            own[j] = f"x{k}_{j}"
        texts.append((k, " ".join(own + own[:10] * int(rng.integers(0, 4)))))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(frame(spark, texts), near_dup.NearDup(block=20)).collect()}
    assert got == root and 1 < len(set(root.values())) < 60


def test_distinct_grams_of_each_text():
    rng = np.random.default_rng(16)
    doc, bucket = rng.integers(0, 9, 4000), rng.integers(0, 50, 4000)
    got = toxicity.once_a_text(doc, bucket, 10, 50)
    assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted(set(zip(doc.tolist(), bucket.tolist())))


def test_line_dedup_of_a_long_document_with_near_lines(spark):
    line = lambda i, word: f"the {i} of many long lines says {word} about matter number {i * i}"
    docs = frame(spark, [(1, "\n".join(line(i, "this") for i in range(6000))), (2, "\n".join(line(i, "that" if i % 2 else "this") for i in range(9000)))])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["n_dropped_lines"] == 0 and got[2]["n_dropped_lines"] == 6000
    assert got[2]["text"] == "\n".join(line(i, "that" if i % 2 else "this") for i in range(6000, 9000))
