"""The corpus operators against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tallyframe.llm import queries as Q
from tallyframe.llm.common import read_table
from tallyframe.llm.decontaminate import benchmark_leaks, drop_leaking, lcs
from tallyframe.llm.embedding_neardup import embedding_neardup, quantised
from tallyframe.llm.html_extraction import aligned, extract_main_text, main_slots, main_text, page_wrapper, blocks_of
from tallyframe.llm.licenses import license_scan
from tallyframe.llm.line_dedup import line_dedup
from tallyframe.llm.ngram_join import ngram_jaccard_join, one_of_each_group
from tallyframe.llm.packing import WordIds, best_fit, best_fit_packing
from tallyframe.llm.quality import drop_low_quality, quality_scores
from tallyframe.llm.substring_dedup import substring_dedup
from tallyframe.llm.toxicity import toxicity_scores

SCHEMA = "doc_id long, text string, lang string, text_hash string, leaks int"  # columns with names used inside


def tokens(n: int, seed: int) -> list[str]:
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)]


def odd_docs(spark):
    base, long = tokens(120, 1), tokens(20_000, 2)
    near = [*base[:60], "other", *base[61:]]
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (3, " ".join(base).upper()), (4, None), (5, ""),
        (6, " \n "), (7, "two words"), (8, "two  words"), (None, " ".join(base)), (None, None), (9, " ".join(long)),
        (10, " ".join(tokens(80, 3) + base[:50])), (11, "same " * 90), (12, " ".join(tokens(30, 4))),
    ]
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], SCHEMA)


def docs_of(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    where = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, (_, s) in enumerate(sets):
        for m, both in collections.Counter(m for g in s for m in where[g] if m > k).items():
            if 100 * both >= 75 * (len(s) + len(sets[m][1]) - both):
                group[max(top(k), top(m))] = min(top(k), top(m))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k))) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("kind", ["table", "odd"])
def test_jaccard_join_is_exact(spark, sf_dir, kind):
    docs = docs_of(spark, sf_dir) if kind == "table" else odd_docs(spark)
    got = sorted(map(tuple, ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_one_of_each_group_keeps_columns(spark):
    kept = one_of_each_group(odd_docs(spark))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert 2 not in ids and 3 not in ids and 8 not in ids and {1, 4, 5, 6, 7, 9, 10, 11, 12} <= set(ids)


@pytest.mark.parametrize("kind", ["table", "odd"])
def test_substring_dedup_is_exact(spark, sf_dir, kind):
    docs = docs_of(spark, sf_dir) if kind == "table" else odd_docs(spark)
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.select("doc_id", "text").collect()]
    count = collections.Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = {q for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for q in range(k, k + 35)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == sorted(want, key=str)


def test_vectors_link_as_in_double_precision(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0, 0.1, 0.3, 0.45, 0.5)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0, None]), (104, []), (None, base[0].tolist())]
    got = {r.vec_id: r for r in embedding_neardup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = np.concatenate([x, base[:1]])
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.9) & ~np.eye(len(unit), dtype=bool)
    assert [got[k].n_links for k in range(len(x))] == link.sum(axis=1)[:-1].tolist() and link.any()
    label = np.arange(len(unit))
    for _ in label:
        label = np.minimum(label, np.where(link, label, len(unit)).min(axis=1))
    assert [got[k].component_id for k in range(len(x))] == label[:-1].tolist()
    assert all(got[k].n_links == 0 and got[k].kept for k in range(100, 105))


def test_quantisation_bound_holds():
    rng = np.random.default_rng(6)
    for _ in range(50):
        u, v = rng.normal(size=24), rng.normal(size=24)
        (qu, su, eu), (qv, sv, ev) = quantised(u), quantised(v)
        exact = u @ v / np.linalg.norm(u) / np.linalg.norm(v)
        assert abs(exact - su * sv * (qu.astype(int) @ qv.astype(int))) <= eu + (1 + eu) * ev + 1e-9


def test_ascii_words_are_learned_from_parts(monkeypatch):
    """The whole tokenizer, which is slow for single words, gets only words beyond printable ASCII."""
    from tokenizers import Tokenizer

    texts = [
        "It's WE'LL 12,345.67e-8 __init__ a1b2 ''s $$$ x'llama plain", "caf\u00e9 \x1cx\x7f stra\u00dfe", "<|endoftext|> a <|END|> 'Re", "</w> a</w>b 3\u00bd",
    ]
    tokenizer, asked = Tokenizer.from_file(Q.tokenizer_path()), []
    words = WordIds(Q.tokenizer_path())
    ids_of = words._ids
    monkeypatch.setattr(words, "_ids", lambda part: asked.extend(part) or ids_of(part))
    got = words.texts(texts)
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    assert not any(w.isascii() and w.isprintable() and "<|" not in w for part in asked for w in part.split(" ") if w)


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    docs = docs_of(spark, sf_dir).unionByName(odd_docs(spark).select("doc_id", "text"))
    got = best_fit_packing(docs, Q.tokenizer_path()).collect()
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k // 4096, k, np.array(ids[k : k + 4096], np.uint32).tobytes()) for k in range(0, len(ids), 4096)]
    assert sorted(((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4 for r in got)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 4096
    assert len(places) <= 1.01 * -(-sum(r.length for r in got) // 4096) + 1


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(7)
    n = rng.integers(1, 60, 400).astype(float)
    demand, capacity = np.stack([n, np.ones(400), n * n], axis=1), np.array([100.0, 4.0, 5000.0])
    for rule in ("norm", "dot"):
        bins = best_fit(demand, capacity, np.ones(3), rule)
        assert all((demand[bins == b].sum(axis=0) <= capacity + 1e-6).all() for b in np.unique(bins))


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    for found, label, folds, out, least in ((quality_scores(docs, labels), "quality", 5, 0, 0.98), (toxicity_scores(docs, labels), "toxic", 4, 2, 0.96)):
        rows = found.join(labels, "doc_id").select("doc_id", "held_out", "predicted", label).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.predicted == r[label] for r in held) >= least * len(held)


def test_classifiers_on_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (7, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for score in (quality_scores, toxicity_scores):
        for given in (labels, labels.limit(0)):
            rows = score(docs, given).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert score(docs.limit(0), labels).collect() == []
    assert drop_low_quality(docs, labels).columns == docs.columns


PAGE = (
    "<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><nav><a href=/>Menu</a></nav><!-- <p>no</p> -->"
    "<div class='cookie-notice'>Cookies</div>{open}<h1>Head &amp; {k}</h1><p><b>First\n  part {k}<br>more<p>Second {k}</p>"
    "<form>Name<input></form><div class=comments><p>Nice {k}</p></div>{close}<aside>Side {k}</aside><footer>Foot</footer>"
)


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<div id=content>", "</div>"), ("<MAIN>", "")])
def test_main_text_without_boilerplate(start, end):
    pages = [PAGE.format(k=k, open=start, close=end) for k in range(4)]
    want = "Head & 2\nFirst part 2 more\nSecond 2"
    assert main_text(pages[2], main_slots(page_wrapper(list(blocks_of(pages[2]))))) == want


@pytest.mark.parametrize(
    "around",
    ['<div class="content has-sidebar">{}</div>', '<div class="long-form">{}</div>', '<div class="post no-comments">{}</div>',
     '<form id="aspnetForm">{}</form>', '<div class="sidebar">{}</div>'],
)
def test_an_element_around_the_whole_article_stays(around):
    body = "<h1>Title here</h1>" + "".join(f"<p>Paragraph {k} of the article.</p>" for k in range(6))
    rest = '<p class="alert-free">Not an alert.</p>'
    page = f'<html><body><header><h1>Site</h1></header>{around.format(body + rest)}<div class="comments"><p>A comment.</p></div><footer>End</footer></body></html>'
    want = ["Title here", *(f"Paragraph {k} of the article." for k in range(6)), "Not an alert."]
    assert main_text(page, None).split("\n") == want


def test_html_query_and_odd_pages(spark, sf_dir):
    rows = [(1, "http://a/x", None), (2, None, "<p>alone"), (None, "http://a/y", ""), (3, "x", "a < b > c <"), (4, "http://a/z", "<p " + "x" * 50_000)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got}[2] == ("alone", 5) and len(got) == 5
    pages = {r.page_id: r.html for r in read_table(spark, sf_dir, "pages").collect()}
    for r in Q.op5_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        assert re.sub(r"\s", "", r.text) == re.sub(r"\s", "", __import__("html").unescape(re.sub(r"<!--.*?-->|<[^>]*>", "", inner, flags=re.S)))


def test_leaks_are_found_and_decoys_left(spark, sf_dir):
    assert lcs(np.array([1, 2, 3, 4]), np.array([9, 2, 4, 3, 4])) == 3
    item, other = tokens(40, 11), tokens(300, 12)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "x y z"), (3, "")], "item_id long, text string")
    changed = [w if k % 9 else "changed" for k, w in enumerate(item)]
    rows = [(1, other + item), (2, other[:100] + changed + other[100:]), (3, other + item[:8]), (4, other), (5, [])]
    docs = spark.createDataFrame([(i, " ".join(w), None, "x", 1) for i, w in rows], SCHEMA).unionByName(odd_docs(spark))
    assert sorted((r.doc_id, r.item_id) for r in benchmark_leaks(docs, bench).collect()) == [(1, 1), (2, 1)]
    kept = drop_leaking(docs, bench)
    assert kept.count() == docs.count() - 2 and kept.columns == docs.columns
    assert benchmark_leaks(docs, bench.limit(0)).count() == 0 and drop_leaking(docs.limit(0), bench).count() == 0


def test_one_link_does_not_take_a_hosts_paragraphs(spark):
    page = "<body><div><p>Our motto</p><hr><h4>Part {k}</h4><p>Our address</p></div><article><h1>Head {k}</h1><p>First {k}</p><h2>Sub {k}</h2><p>Last {k}</p>{more}</article></body>"
    more = {7: "<h2>On</h2><p><a href=/x>Read more</a></p>"}
    rows = [(k, "http://a/x", page.format(k=k, more=more.get(k, ""))) for k in range(60)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {k: f"Head {k}\nFirst {k}\nSub {k}\nLast {k}" + ("\nOn" if k == 7 else "") for k in range(60)}
    assert {r.page_id: r.text for r in got} == want
    alone = "<body><div><p>Our motto</p><h4>Part {k}</h4><p>Our address</p><h4>Text {k}</h4></div></body>"
    wrapper = page_wrapper(list(blocks_of(alone.format(k=0))))
    for k in range(1, 5):
        wrapper = aligned(wrapper, page_wrapper(list(blocks_of(alone.format(k=k)))))
    assert main_text(alone.format(k=2), main_slots(wrapper)) == "Part 2\nText 2"


def test_all_items_of_a_large_benchmark_are_found(spark):
    rng = np.random.default_rng(21)
    items = [[f"i{x}" for x in rng.integers(0, 30_000, n)] for n in rng.integers(15, 60, 1000)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    docs = [(k, " ".join(tokens(40, k) + w + tokens(40, 5000 + k))) for k, w in enumerate(items)]
    got = benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(1000)]
    long = tokens(8000, 22)  # more passages than directions
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(items[0]))], "item_id long, text string")
    docs = [(1, " ".join(tokens(40, 23) + long)), (2, " ".join(tokens(90, 24) + items[0]))]
    assert sorted((r.doc_id, r.item_id) for r in benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()) == [(1, 1), (2, 2)]


def test_recurring_lines_go_and_copies_stay(spark):
    rows = [(k, "\n".join([" ".join(tokens(9, 100 + k)), f"Page {k} of the book by us", " ".join(tokens(9, 300 + k)), ""])) for k in range(30)]
    copy = "\n".join(" ".join(tokens(8, 900 + k)) for k in range(4))
    rows += [(100 + k, copy) for k in range(30)] + [(200, None), (201, ""), (None, "Page 7 of the book by us")]
    docs = spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], SCHEMA)
    got = line_dedup(docs, count_col="gone")
    assert got.columns == [*docs.columns, "gone"] and got.count() == len(rows)
    for r in got.collect():
        if r.doc_id is None:
            assert r.text == ""
        elif r.doc_id < 100:
            assert r.gone == 1 and "Page" not in r.text and r.text.endswith("\n")
        else:
            assert r.gone == 0 and r.text == dict(rows)[r.doc_id]
    assert line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_constant_blocks_go_and_near_copies_stay(spark, size):
    prose = lambda n, seed: " ".join(tokens(n, seed)).translate(str.maketrans("0123456789", "abcdefghij"))
    head, foot = ([prose(6, 10 * end + k) for k in range(size)] for end in (1, 2))
    body = {k: [prose(14, 1000 + 10 * k + i) for i in range(8)] for k in range(30)}
    same = [prose(14, 5000 + i) for i in range(8)]
    rows = [(k, "\n".join([*head, *body[k], *foot])) for k in range(30)]
    rows += [(100 + k, "\n".join([*same[:4], prose(14, 6000 + k), *same[4:]])) for k in range(30)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == "\n".join(body[k]) for k in range(30))
    # the lines beside the one that differs have contexts of their own; the others stay
    assert all(set(same[:3] + same[5:]) <= set(got[100 + k].split("\n")) for k in range(30))


def test_native_queries_run_no_python(spark, sf_dir):
    for query in (Q.op8_line_dedup, Q.op9_license_scan):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_license_paragraphs(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "An ordinary line about nothing.", ""]
    rows = [(1, "\n".join(lines)), (2, None), (3, ""), (None, "All rights reserved."), (4, lines[1]), (4, lines[1])] + [(10 + k, " ".join(tokens(20, k))) for k in range(60)]
    docs = spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in license_scan(docs).collect()), key=str)
    assert got == [(1, 0, "Apache-2.0"), (1, 1, "MIT"), (4, 0, "MIT"), (4, 0, "MIT"), (None, 0, "all-rights-reserved")]


def test_pipeline_stages_follow_each_other(spark, sf_dir):
    import corpus_pipeline

    docs = read_table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).persist()
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in packed.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in docs.collect())
