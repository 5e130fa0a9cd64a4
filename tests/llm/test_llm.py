"""The operators of the llm subpackage against brute force, on rows with every edge."""

from __future__ import annotations

import collections
import hashlib
import html
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from runforge.lineage import cut
from runforge.llm import bpe, components, context_tree, decontaminate, html_extract, line_dedup, quality, repeats, set_links, simhash, url_filter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls, empty and odd texts, repeated rows, ties.
EDGES = [
    (1, None), (2, ""), (3, "  \n\t"), (4, "One two"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "another text"), (None, "no id at all"), (None, None), (6, "É é ﬁ İ 日本 <|endoftext|>x"),
    (7, "x" * 3000), (8, "word " * 800), (9, "l1\nl2\nL1 \n\nl2"), (10, "a b c d e f g h"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(3)


def clashing(df):
    """With columns of the names that operators use inside."""
    return df.withColumns({c: F.lit("clash") for c in ("row_key", "words", "lines", "ids", "decoded", "keep_runs", "spans", "block", "fp", "node", "label", "component_id", "host", "path", "slot", "keep_row", "f_row", "g_row")})


def keys(rows, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in rows)


# 1


def test_article_of_a_page():
    page = (
        "<html><head><title>no</title><script>if (a < b) '</p>'</script></head><body class='has-sidebar'><header>no</header><nav>no</nav><div class='cookie-notice'>no</div>"
        "<article><h1>One &amp; two</h1><p>a  <b>b<br>c<p>d &lt; e<!-- no --><aside>no</aside><form>no</form><div id='comments'><p>no</p></div><ul><li>f<li>g</ul></article><footer>no</footer>"
    )
    assert html_extract.article(page, None) == "One & two\na b c\nd < e\nf\ng"
    for n in (5, 70, 5000):
        assert html_extract.article("<body>" + "<div>" * n + "<p>other chrome</p><article>deep article" + "</article>", None) == "deep article"


def test_end_tags_without_a_name_are_markup():
    assert html_extract.article("<article><p>a </ b>c</>d </1 x>e 1 < 2 </p></article>", None) == "a cd e 1 < 2"


def test_names_only_break_ties():
    one = lambda page: html_extract.article(page, None)
    assert one("<body><article><h1>h</h1><div class='related-work'>own words</div><div class='related'>no</div></article></body>") == "h\nown words"
    assert one("<body><article><div class='post-header'><h1>h</h1></div><p>a</article>") == "h\na"
    assert one("<body><article><header><h1>h</h1></header><p>a</article><header>no</header>") == "h\na"
    for name in ("post comments-open", "entry share-enabled", "content header-main"):
        assert one(f"<body><nav>no</nav><div class='{name}'><h1>h</h1><p>{'words ' * 9}</p></div></body>") == "h\n" + ("words " * 9).strip()
    assert one(f"<body><form id=aspnetForm><h1>h</h1><p>{'words ' * 9}</p></form></body>") == "h\n" + ("words " * 9).strip()
    # More comments than article are comments still.
    assert one(f"<body><article><p>short article</p><div id=comments>{'<p>no no no</p>' * 30}</div></article>") == "short article"
    # Links alone make a list in an article boilerplate if its name says so too.
    assert one("<body><article><p>some text</p><div class='more-related'><a href=x>no</a> <a href=y>no</a></div></article>") == "some text"


def made_pages(n, make):
    rng = random.Random(21)
    return [(i, f"http://a.org/{i}", make(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(40)))) for i in range(n)]


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_template_without_names(spark):
    """What a host's pages always say goes although nothing is named; an introduction that all articles share stays, as does what copies of a page share."""
    rows = made_pages(20, lambda i, t: f"<html><body><div class=x1>Home About Contact</div><div class=x2><h1>title {i}</h1><p>same words everywhere</p><p>{t}</p><div class=x4>Read this</div></div><div class=x3>All rights reserved</div></body></html>")
    got = texts_of(spark, rows)
    for i, _, page in rows:
        t = page.split("<p>")[2].split("</p>")[0]
        assert got[i] == f"title {i}\nsame words everywhere\n{t}"
        assert html_extract.article(page, None) != got[i]
    inline = made_pages(20, lambda i, t: f"<body><div class=x1>Home About Contact</div><p>{t}</p><div class=x3>All rights reserved</div>")
    assert all(t.startswith("w") and "Home" not in t and "rights" not in t for t in texts_of(spark, inline).values())
    copies = [(i, f"http://a.org/{i}", "<body><div class=a><div class=b>the only text</div></div>") for i in range(9)]
    assert set(texts_of(spark, copies).values()) == {"the only text"}


def test_token_classes_equal_brute_force(spark):
    rng = random.Random(22)
    make = lambda: "<body>" + "".join(f"<div class={rng.choice('abc')}><p>{rng.choice(['same', str(rng.random())])}</p>{'<b>x</b>' * rng.randint(0, 1)}</div>" for _ in range(rng.randint(1, 3)))
    rows = [(i, f"http://{'ab'[i % 2]}.org", make()) for i in range(30)]
    rows += rows[:4]
    src = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.regexp_extract("url", "://(.*)", 1)).repartition(3)
    want = collections.defaultdict(set)
    for host in ("a.org", "b.org"):
        pages = [(i, html_extract.Page(h).tokens()) for i, u, h in rows if host in u]
        n_host, whole = len(pages), {i: t[0]["said"] for i, t in pages}
        for path in {p for _, t in pages for p in t}:
            has = [(i, t[path]) for i, t in pages if path in t]
            said = collections.defaultdict(list)
            for i, t in has:
                said[t["said"]].append(i)
            constant = max((len(ids) if len({whole[i] for i in ids}) > 1 else 0) for ids in said.values())
            if len(has) >= html_extract.SEEN * n_host:
                vector = tuple(sorted((i, t["count"]) for i, t in has))
                want[host, vector].add((path, len(has), max(t["count"] for _, t in has), constant, sum(t["whole"] for _, t in has), n_host))
    got = collections.defaultdict(set)
    for r in html_extract.token_classes(src).collect():
        got[r.host, r.v1, r.v2].add((r.path, r.n_pages, r.most, r.constant, r.whole, r.n_host))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_extract_text(spark, monkeypatch):
    page = "<html><body><nav>{0}</nav><div class=story><p>same words everywhere</p><p>text {0} &eacute;</p></div><div class=ad>{0}</div></body></html>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(8)] + [(8, "http://a.org/8", None), (9, None, ""), (10, "nohost", "<p>a<p>b"), (11, "http://b.org", "plain"), (11, "http://b.org", "plain"), (12, "http://c.org", "<div>" * 5000 + "deep"), (None, None, None)]
    df = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string")).withColumns({c: F.lit("clash") for c in ("text", "t_host", "page", "found", "n_host", "said")})
    for hot in (html_extract.HOT_HOSTS, 1):
        monkeypatch.setattr(html_extract, "HOT_HOSTS", hot)
        out = html_extract.extract_text(df).collect()
        assert len(out) == len(rows)
        got = {r.page_id: r.text for r in out}
        assert all(got[i] == f"same words everywhere\ntext {i} {html.unescape('&eacute;')}" for i in range(8))
        assert (got[8], got[9], got[10], got[11], got[12], got[None]) == ("", "", "a\nb", "plain", "deep", "")
        assert out[0].host == out[0].found == "clash"
    assert html_extract.extract_text(df.limit(0)).count() == 0


# 2


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_components(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cd ") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    rows = [*EDGES, *((100 + i, t) for i, t in enumerate(texts))]
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)}
    want = collections.Counter((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group, strict=True))
    for limit in (256, 1):
        monkeypatch.setattr(simhash, "LONG_LIST", limit)
        got = simhash.simhash_components(clashing(docs_of(spark, rows))).collect()
        assert keys(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(docs_of(spark, rows).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 200, 300)}


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows, want = list(EDGES), {}
    for g in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        for c in range(5):
            w = list(words)
            for k in rng.sample(range(200), c):
                w[k] = f"new{g}{c}{k}"
            rows.append((1000 + 10 * g + c, " ".join(w)))
            want[1000 + 10 * g + c] = 1000 + 10 * g
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if (r.doc_id or 0) >= 1000} == want
    kept = simhash.keep_one_of_each(clashing(docs_of(spark, rows)))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 5, 6, 7, 8, 9, *(1000 + 10 * g for g in range(12))]
    assert "row_key" in kept.columns


def brute_near_duplicates(rows, t=0.8):
    """The smallest id of every row's component by Jaccard similarity of all pairs."""
    words = [tuple((x or "").encode().lower().split()) for _, x in rows]
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if group[i] != group[j] and (words[i] == words[j] or n and n >= t * (len(sets[i]) + len(sets[j]) - n) - 1e-9):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)}
    return collections.Counter((r[0], least[g]) for r, g in zip(rows, group, strict=True))


@pytest.mark.parametrize("buckets, tile", [(1 << 20, 800), (64, 9)])
def test_near_duplicates_equal_the_exact_join(spark, monkeypatch, buckets, tile):
    """Copies around the threshold, repeats, a passage that a third of all share, groups that only meet by way of others; few buckets are all frequent."""
    rng = random.Random(13)
    monkeypatch.setattr(simhash, "BUCKETS", buckets)
    monkeypatch.setattr(set_links, "TILE_SETS", tile)
    passage = [f"p{i}" for i in range(60)]
    rows = list(EDGES)
    for g in range(40):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([8, 20, 60, 200]))] + (passage if g % 3 == 0 else [])
        for c in range(6):
            v = list(w)
            for k in rng.sample(range(len(v)), min(len(v), rng.choice([0, 1, 2, 3, 5]))):
                v[k] = f"new{rng.random()}"
            if rng.random() < 0.3:
                v = v[: len(v) // 2] + v[len(v) // 3 : len(v) // 2] * 5 + v[len(v) // 2 :]
            rows.append((1000 + 10 * g + c, " ".join(v)))
    rows += [(5000 + i, " ".join([*passage, f"own{i}", f"own{i}b"])) for i in range(30)] + rows[20:40]
    want = brute_near_duplicates(rows)
    got = simhash.near_duplicates(clashing(docs_of(spark, rows))).collect()
    assert keys(got, "doc_id", "component_id") == want
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


# 3


def test_filter_urls(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "a.example.com", "badexample.com", "net", "x.net", "", "com.", "EXAMPLE.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1?q", "/fr/#z", "/e"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://a\nb.com/\n"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("net", "/fr/", "allow"), ("net", "/", "allow"), ("net", "/es/1", "allow"), (None, "/", "block")]
    rows = [(i, u) for i, u in enumerate(urls * 2)]
    rng.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "page_id bigint, url string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        assert got[i] == (host, path, best[2], best[3])
    assert url_filter.filter_urls(df, url_filter.rule_table(spark).limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


# 4


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib = Tokenizer.from_file(path)
    rng = random.Random(7)
    odd = ["\x1c a\x1db \x85 x", "ΑΣ Σς ſt", "I'LL don't 's''t", "ab" * 200 + "!!!", "<|startoftext|><|ENDOFTEXT|>", "🙂👍🏽"]
    odd += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0x36F), rng.randint(0x2000, 0x33FF)])) for _ in range(20)) for _ in range(200)]
    rows = [*EDGES, *((100 + i, t) for i, t in enumerate(odd))]
    out = bpe.bpe_decode(bpe.bpe_encode(clashing(docs_of(spark, rows)), path), path).collect()
    assert len(out) == len(rows)
    for r in out:
        e = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == e
        assert r.decoded == lib.decode(e, skip_special_tokens=False)


def test_empty_tables_of_urls_and_texts(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.filter_urls(none, url_filter.rule_table(spark)).count() == 0
    path = bpe.tokenizer_path()
    assert bpe.bpe_decode(bpe.bpe_encode(docs_of(spark, []), path), path).count() == 0


# 6


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(20, 200)))
    rows, labels = list(EDGES), []
    for i in range(600):
        t, q = good(), int(i % 4 > 0)
        rows.append((1000 + i, t if q else rng.choice([t.upper(), " ".join(w + "###" for w in t.split()), "spam " * 90])))
        labels.append((1000 + i, q))
    marks = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id bigint, quality int")
    out = quality.score_quality(clashing(docs_of(spark, rows)), marks).collect()
    assert len(out) == len(rows)
    of = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in of]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == of[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in quality.score_quality(docs_of(spark, rows), marks.limit(0)).collect()}) == 1


def test_discriminant_equals_densities_by_the_book(spark):
    """Scores from means, covariances and determinants computed at once in numpy, without sums or factors."""
    rng = random.Random(24)
    word = lambda: "".join(rng.choice("abcXYZ.,!#1") for _ in range(rng.randint(1, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) if i % 3 else ("spam " * rng.randint(1, 40)).upper()) for i in range(300)] + [(None, "no id"), (1000, None)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 300, 2)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    x = {i: np.array(quality.statistics(t)) for i, t in rows}
    teach = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    of = [np.array([x[i] for i, q in teach if q == c]) for c in (0, 1)]
    covs = [np.cov(a.T, bias=True) for a in of]
    pooled = sum(len(a) * c for a, c in zip(of, covs, strict=True)) / len(teach)
    pooled = (1 - quality.SHRINK_TO_DIAGONAL) * pooled + quality.SHRINK_TO_DIAGONAL * np.diag(np.diag(pooled))
    covs = [(1 - quality.SHRINK_TO_POOLED) * c + quality.SHRINK_TO_POOLED * pooled + quality.LEAST_VARIANCE * np.eye(len(c)) for c in covs]
    log = lambda v, a, c: -0.5 * ((v - a.mean(0)) @ np.linalg.solve(c, v - a.mean(0)) + np.linalg.slogdet(c)[1])
    odds = math.log((len(of[1]) + 0.5) / (len(of[0]) + 0.5))
    got = {r.doc_id: r.score for r in quality.score_quality(docs_of(spark, rows), marks).collect()}
    for i, v in x.items():
        d = log(v, of[1], covs[1]) - log(v, of[0], covs[0]) + odds
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, d)))), abs=1e-6)
    assert quality.score_quality(docs_of(spark, rows).limit(0), marks).count() == 0


# 7


def brute_ctw(rows, depth):
    low = [(t or "").encode().lower() for _, t in rows]
    teach = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    bits = lambda t: [(tuple(s[p - 1 - k] for k in range(depth)), (1 << b) | s[p] >> 8 - b, s[p] >> 7 - b & 1) for s in [bytes([0xFE]) * depth + t + b"\xff"] for p in range(depth, len(s)) for b in range(8)]
    n = collections.defaultdict(lambda: [0, 0])
    for t in itertools.compress(low, teach):
        for c, node, bit in bits(t):
            for d in range(depth + 1):
                n[c[:d], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, below = {}, collections.defaultdict(float)
    for c, node in sorted(n, key=lambda x: -len(x[0])):
        own = kt(*n[c, node])
        weighted[c, node] = own if len(c) == depth else np.logaddexp(own, below[c, node]) - math.log(2)
        below[c[:-1], node] += weighted[c, node] if c else 0

    def p(c, d, node, bit):
        if (c[:d], node) not in n:
            return 0.5
        a = n[c[:d], node]
        w = 1 if d == depth else math.exp(kt(*a) - math.log(2) - weighted[c[:d], node])
        return w * (a[bit] + 0.5) / (sum(a) + 1) + (1 - w and (1 - w) * p(c, d + 1, node, bit))

    return [sum(math.log10(p(c, 0, node, bit)) for c, node, bit in bits(t)) for t in low]


def test_context_tree(spark):
    rows = [(i, t[:60] if t else t) for i, t in EDGES] + [(100 + i, f"the cat {i % 7} sat") for i in range(25)]
    words = collections.Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in [*(t or "").encode().lower().split(), None])
    total, kinds = sum(words.values()), len(words)
    for depth in (2, 4):
        want = collections.Counter()
        for (i, t), s in zip(rows, brute_ctw(rows, depth), strict=True):
            w = [*(t or "").encode().lower().split(), None]
            want[i, len(w), sum(words[x] > 0 for x in w), total, round(sum(math.log10((words[x] + 1) / (total + kinds + 1)) for x in w), 6), round(s, 6)] += 1
        got = context_tree.score_texts(clashing(docs_of(spark, rows)), depth, block_bytes=200).collect()
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert context_tree.score_texts(docs_of(spark, rows).limit(0)).count() == 0


def test_grams_in_windows_and_trees_in_slices(monkeypatch):
    """Whatever the size of windows and slices, texts give the same grams and no tree is torn apart."""
    import pyarrow as pa

    texts = [b"", b"abcab", "héé".encode(), b"abc" * 9]
    naive = [[tuple(s[p - k] for k in range(1, 5)) + (s[p],) for p in range(4, len(s))] for t in texts for s in [bytes([0xFE]) * 4 + t + b"\xff"]]
    of = np.array([True, False, True, True])
    for window in (1, 7, 1000):
        monkeypatch.setattr(context_tree, "WINDOW", window)
        g = context_tree.Grams(texts, 4)
        k, n = g.counts(of)
        want = collections.Counter()
        for i, x in enumerate(naive):
            for y in x:
                want[int.from_bytes(bytes(y), "big")] += int(of[i])
        assert dict(zip(k.tolist(), n.tolist(), strict=True)) == dict(want)
        value = np.arange(len(k), dtype=float)
        assert g.sums(k, value, 4).tolist() == [sum(value[np.searchsorted(k, int.from_bytes(bytes(y), "big"))] for y in x) for x in naive]
    grams = np.sort(k.view(np.int64))
    monkeypatch.setattr(context_tree, "SLICE", 5)
    parts = [t[0].to_numpy() for t in context_tree._slices((pa.RecordBatch.from_arrays([pa.array(grams[i : i + 3])], names=["gram"]) for i in range(0, len(grams), 3)), 4)]
    assert np.concatenate(parts).tolist() == grams.tolist()
    assert len(parts) > 2
    trees = [set((p >> 16).tolist()) for p in parts]
    assert all(not a & b for a, b in itertools.combinations(trees, 2))


def test_depth_helps_on_held_out_text(spark):
    """The held-out texts cost fewer bits under the tree than under the words alone."""
    rng = random.Random(23)
    rows = [(i, " ".join(rng.choice(["the cat sat", "on the mat", "a dog ran"]) for _ in range(30))) for i in range(200)]
    got = [r for r in context_tree.score_texts(docs_of(spark, rows)).collect() if r.held_out]
    assert len(got) > 10
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# 8


def test_contained_items(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 30)))) for i in range(20)] + [(50, None), (51, "a b"), (52, "a b c d e f")]
    rows = list(EDGES)
    for i in range(60):
        w = [f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 300))]
        part = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 3)):
            if part:
                part[rng.randrange(len(part))] = "changed"
        rows.append((100 + i, " ".join(w[:50] + part + w[50:]).upper()))
    sh = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] if w for i in range(max(1, len(w) - 4))}
    want = collections.Counter()
    for (d, t), (i, q) in itertools.product(dict.fromkeys(rows), items):
        a, b = sh(t), sh(q)
        if b and len(a & b) >= 0.8 * len(b) - 1e-9:
            want[d, i, len(b), len(a & b)] += 1
    got = decontaminate.contained_items(clashing(docs_of(spark, rows)), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(want) > 10
    assert keys(got, "doc_id", "item_id", "n_item", "n_shared") == want
    tables = clashing(docs_of(spark, rows)), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.contained_items(tables[0].limit(0), tables[1]).count() == decontaminate.contained_items(tables[0], tables[1].limit(0)).count() == 0
    # What the search doesn't find is not counted.
    search = decontaminate.candidate_pairs
    monkeypatch.setattr(decontaminate, "candidate_pairs", lambda *a: search(*a).where("item_id % 2 = 0"))
    got = decontaminate.contained_items(*tables).collect()
    assert keys(got, "doc_id", "item_id") == collections.Counter((d, i) for d, i, *_ in want if i % 2 == 0)


def test_sketches_by_size():
    """Any set that holds a share t of an item holds part of the sketch that its size class asks for."""
    for t in (0.5, 0.8, 1.0):
        for n in range(1, 200):
            largest = 2 ** (int(math.log2(n)) + 1) - 1
            sketch = largest - math.ceil(largest * t - 1e-9) + 1
            assert sketch > n - math.ceil(n * t - 1e-9)


# 9


def test_remove_repeats(spark):
    rng = random.Random(10)
    base = "".join(rng.choice("ab ") for _ in range(400))
    rows = [(100 + i, "".join(rng.choice(["a" * rng.randint(0, 130), base[rng.randint(0, 200) :][: rng.randint(0, 200)], "é" * rng.randint(0, 70), str(rng.random()), "xyz" * rng.randint(0, 60)]) for _ in range(rng.randint(0, 6)))) for i in range(50)]
    rows += [r for r in EDGES if r[0] not in (5, None)]
    seen, want = set(), collections.Counter()
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), len(b) - len(kept), len([1 for g, _ in itertools.groupby(gone) if g]), hashlib.sha256(kept).hexdigest()] += 1
    for hot in (repeats.HOT, 1):
        got = repeats.remove_repeats(clashing(docs_of(spark, rows)), hot=hot).select("doc_id", "n_bytes", "n_removed", F.size("removed").alias("n"), F.sha2("kept", 256).alias("h")).collect()
        assert keys(got, "doc_id", "n_bytes", "n_removed", "n", "h") == want
    assert repeats.remove_repeats(docs_of(spark, EDGES)).count() == len(EDGES)
    assert repeats.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_rows_alike_are_one_document(spark):
    """Repeated rows of 100 bytes and more, null ids and one id with two texts, against brute force."""
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, twice = own(150), own(120)
    texts = [(1, own(300)), (2, own(100) + shared + own(50)), (2, own(90) + shared), (3, twice + own(40) + twice), (None, own(200)), (None, own(80) + shared), (4, shared), (5, own(99))]
    rows = [r for r in texts for _ in range(3)] + texts[:2] * 40
    mark = {t: xxhash.xxh64_intdigest(t.encode(), 42) for _, t in texts}
    in_order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, mark[r[1]] - (mark[r[1]] >> 63 << 64)))
    seen, want = set(), {}
    for i, t in in_order:
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(t[k : k + 100])
        want[i, t] = hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()
    expected = collections.Counter((i, want[i, t]) for i, t in rows)
    # Few partitions put rows alike into one chunk, many into several.
    for parts, hot in ((1, repeats.HOT), (7, repeats.HOT), (7, 1)):
        got = repeats.remove_repeats(docs_of(spark, rows).repartition(parts), hot=hot).select("doc_id", F.sha2("kept", 256).alias("h")).collect()
        assert keys(got, "doc_id", "h") == expected


# 10


def test_line_dedup(spark, monkeypatch):
    rows = [*EDGES, *((100 + i, f"  Common LINE\t\nown {i}\n\ncommon line\n{'rare' if i < 9 else 'x'}") for i in range(12))]
    docs = clashing(docs_of(spark, rows))
    out = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in out}
    assert got[100] == (5, 2, "own 0\n\nrare")
    assert got[1] == got[2] == (1, 0, "")
    assert got[9] == (5, 0, "l1\nl2\nL1 \n\nl2")
    assert line_dedup.line_keep_bitmaps(docs.limit(0)).count() == 0
    # Texts of one id are one document, those without an id count each; hot lines and others alike.
    same = docs_of(spark, [(1, f"shared\n{i}") for i in range(12)] + [(None, f"other\n{i}") for i in range(10)])
    for n in (10_000, 1):
        monkeypatch.setattr(line_dedup, "HOT_KEYS", n)
        got = line_dedup.apply_keep_bitmaps(same, line_dedup.line_keep_bitmaps(same)).groupBy("doc_id").agg(F.sum("n_dropped").alias("n")).collect()
        assert {r.doc_id: r.n for r in got} == {1: 0, None: 10}
    first = line_dedup.line_keep_bitmaps(docs, keep_first=True).where("doc_id = 100").first()
    assert [(r.first, r.n) for r in first.keep_runs] == [(0, 3), (4, 1)]


def test_fingerprint_links_count_in_near_dedup(spark):
    """A passage that is repeated sets all bits of both fingerprints, while the sets of shingles are less than 0.8 alike."""
    passage, tail = (" ".join(f"{x}{i}" for i in range(100)) for x in "pt")
    a, b = (" ".join([passage] * 60 + [f"{x} {tail[: len(tail) // 3]}".replace("t", x)]) for x in "ab")
    rows = [(7, a), (3, b), (5, passage), (9, tail), (None, a), (3, b)]
    docs = docs_of(spark, rows)
    labels = {r.doc_id: r.label for r in simhash.near_duplicates(docs).collect()}
    assert labels[7] != labels[3]
    prints = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert prints[7] == prints[3] == 3
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect())
    assert kept == sorted({prints[i] for i in (7, 3, 5, 9)})



def test_sums_of_grams_in_any_order(monkeypatch):
    monkeypatch.setattr(context_tree, "WINDOW", 8)
    texts = [b"banana bandana", b"", b"nab"]
    every, _ = context_tree.Grams(texts).counts(np.ones(3, bool))
    mixed = np.random.default_rng(7).permutation(every)
    value = (mixed % np.uint64(1009)).astype(float)
    of = dict(zip(mixed.tolist(), value.tolist(), strict=True))
    want = [sum(of[g] for g in next(context_tree.Grams([t]).windows(100))[0].tolist()) for t in texts]
    assert context_tree.Grams(texts).sums(mixed, value, 3).tolist() == want



# pipeline


def test_lines_are_shuffled_once_to_their_firsts(spark):
    occ = cut(spark.range(100).selectExpr("id % 7 as h1", "id % 3 as h2", "nullif(id % 20, 1) as doc_id", "case when id % 20 = 1 then id end as no_id", "id as row_key", "1 as pos"))
    firsts = line_dedup.first_occurrences(occ, 5)
    assert firsts.count() == occ.select("h1", "h2", "doc_id", "no_id").distinct().count()
    firsts.collect()
    plan = firsts._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count(" Exchange ") == 1 and "rangepartitioning(h1" in plan


def test_pipeline_stages_keep_columns(spark):
    rng = random.Random(11)
    docs = docs_of(spark, [*EDGES, *((1000 + i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(60))) for i in range(30))])
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == cols, name
    assert docs.where("doc_id >= 1000").count() == 30


def test_pipeline_equals_brute_force(spark):
    """All five stages over the smallest table: lines, pairs and items by loops, tokens by the library; the classifier's own decisions."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scored = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    good = {r.doc_id for r in scored if r.predicted}
    docs = {i: t for i, t in docs.items() if i in good}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = collections.Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    docs = {i: "\n".join(x for x in t.split("\n") if n[key(x)] < 10) for i, t in docs.items()}
    assert any(c >= 10 for c in n.values())
    kept = {c for _, c in brute_near_duplicates(list(docs.items()))}
    assert len(kept) < len(docs)
    sh = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] if w for i in range(max(1, len(w) - 4))}
    items = [sh(r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in kept for a in [sh(docs[i])] if not any(b and len(a & b) >= 0.8 * len(b) - 1e-9 for b in items)}
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == clean
    for i, r in got.items():
        assert r.ids == lib.encode(docs[i], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_rejected_documents_go(spark):
    docs = docs_of(spark, [(i, "good words here. " * 20 if i % 2 else "BUY!!! ### " * 20) for i in range(60)] + EDGES)
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    left = quality.keep_accepted(clashing(docs), marks)
    assert {r.doc_id for r in left.collect() if r.doc_id is not None and r.doc_id > 10} == set(range(11, 60, 2))
    assert "row_key" in left.columns
    assert quality.keep_accepted(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("rows", [[], EDGES])
def test_decontaminate_and_bpe_stages(spark, rows):
    docs = docs_of(spark, rows)
    left = corpus_pipeline.drop_contaminated(spark, docs, "/root/testdata/sf0.001")
    assert left.count() == len(rows)
    assert corpus_pipeline.tokenize(spark, left, "").count() == len(rows)
