"""HTML extraction by equivalence classes of page tokens.

The tokens are the elements of a page, told apart by their path, and what an element says.
Over all pages of a host a path has an occurrence vector, its count in each page; paths with
the same vector form an equivalence class. Classes that enough pages carry, once each, are
valid, and their elements, nested in each other, are the host's template; what lies between
them are its slots. Slots in which the host's pages always say the same are boilerplate, as
are those full of links. The article's slot is the one that holds the text which varies.
Names (tags, classes, ids) only break ties: what is called a sidebar goes unless the host's
article lies in it, what has such a word in its name goes if its text or its links say so
too. A sentence that all articles of a host share stays, as its path also holds other text.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, load
from runforge.llm.url_filter import url_host

#: A valid class occurs in this share of a host's pages at least; paths in fewer than SEEN of them are not judged.
MIN_SUPPORT, SEEN = 0.5, 0.05
#: Pages that must agree before their text counts as held constant, and the share of those with the path that must.
MIN_PAGES, CONSTANT = 3, 0.9
#: Hosts with at least this part of all pages count as hot; there are at most so many.
HOT_HOSTS = 1000

# The names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body center details dialog div dl fieldset footer form header hgroup html main menu nav ol search section table tbody td tr ul".split())
#: Elements that never hold text of a page.
NO_TEXT = frozenset("audio button canvas datalist embed head iframe input map noscript object optgroup option script select style svg template textarea title video".split())
#: Elements that are called no part of an article.
LEFT_OUT = frozenset("aside dialog footer form frameset header menu nav".split())
#: Words of class, id and role that say the same, and words that add nothing to them.
LEFT_OUT_WORDS = frozenset(
    "ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Of both those that some hosts wrap around everything.
WRAPPERS = frozenset("dialog form frameset header masthead menu modal popup share sharing".split())
FILLERS = frozenset("area bar block bottom box container global group inner item left links list outer page right section side site slot top wrap wrapper".split())
#: Words by which another element than article or main says that it holds the article.
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?![a-zA-Z])[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@functools.lru_cache(maxsize=20_000)
def _naming(name: str, attrs: str) -> tuple[str, int, int, bool]:
    """(step of a path, how plainly it is called boilerplate: 3 no text at all, 2 plainly, 1 in part, 0 not; how plainly an article; whether it may wrap one)."""
    labels = sorted({x for _, a, b, c in ATTR.findall(attrs) for x in (a or b or c).split()}) if "=" in attrs else []
    words = [[w.lower() for w in WORD.findall(x) if not w.isdigit()] for x in labels]
    step = ".".join([name, *(re.sub(r"\d{3,}", "0", x) for x in labels)])
    whole = name in ("html", "body", "article", "main")
    plain = name in LEFT_OUT or not whole and any(w and any(x in LEFT_OUT_WORDS for x in w) and all(x in LEFT_OUT_WORDS or x in FILLERS for x in w) for w in words)
    partly = not whole and any(x in LEFT_OUT_WORDS for w in words for x in w)
    article = 4 if name == "article" else 3 if name == "main" or "main" in labels and "role" in attrs else 2 if name in BLOCK and any(x in CONTENT_WORDS for w in words for x in w) else 0
    calls = {name, *(x for w in words for x in w)} & (LEFT_OUT | LEFT_OUT_WORDS)
    return step, 3 if name in NO_TEXT else 2 if plain else 1 if partly else 0, article, calls <= WRAPPERS


def _signed(x: int) -> int:
    return (x & 2**64 - 1) - ((x >> 63 & 1) << 64)


class Page:
    """The elements of a page in order, and its texts with the element and the block they are in."""

    __slots__ = ("article", "key", "kind", "name", "parent", "texts", "wraps")

    def __init__(self, page: str):
        self.name: list[str] = [""]
        self.key: list[int] = [0]
        self.parent: list[int] = [-1]
        self.kind: list[int] = [0]
        self.article: list[int] = [0]
        self.wraps: list[bool] = [True]
        self.texts: list[tuple[int, int, str]] = []
        stack, opened, block, at, n = [0], defaultdict(int), 0, 0, len(page)

        def end(i: int) -> None:
            for x in stack[i:]:
                opened[self.name[x]] -= 1
            del stack[i:]

        while at < n:
            found = TOKEN.search(page, at)
            text = page[at : found.start() if found else n]
            if text:
                self.texts.append((stack[-1], block, text))
            if not found:
                return
            at = found.end()
            name = (found["name"] or "").lower()
            if not name:
                continue
            if name in BLOCK:
                block += 1
            if found["close"]:
                if opened[name]:
                    end(next(i for i in range(len(stack) - 1, -1, -1) if self.name[stack[i]] == name))
                continue
            # A paragraph ends where a block begins, an item where the next one does.
            ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}.get(name, ("p",) if name in BLOCK else ())
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if self.name[stack[i]] in ends:
                    end(i)
                    break
                if self.name[stack[i]] in BLOCK and self.name[stack[i]] != "p":
                    break
            step, kind, says_article, wraps = _naming(name, found["attrs"])
            self.name.append(name)
            self.key.append(_signed(xxhash.xxh64_intdigest(step, self.key[stack[-1]] & 2**64 - 1)) or 1)
            self.parent.append(stack[-1])
            self.kind.append(kind)
            self.article.append(says_article)
            self.wraps.append(wraps)
            if name == "br":
                self.texts.append((stack[-1], block, " "))
            if name in RAW:
                closing = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closing.end() if closing else n
            elif name not in VOID and not found["attrs"].rstrip().endswith("/"):
                stack.append(len(self.key) - 1)
                opened[name] += 1

    def tokens(self) -> dict[int, dict]:
        """By path: count, place of the first, depth, what its name says, and of the text inside: characters in all, those outside of boilerplate further down, those in links, headings, and a hash."""
        n = len(self.key)
        whole, clean, link, said = [0] * n, [0] * n, [0] * n, [0] * n
        depth, headings = [0] * n, [0] * n
        for e, _, text in self.texts:
            bare = text.strip()
            if bare and self.kind[e] < 3:
                whole[e] += len(bare)
                clean[e] += len(bare)
                said[e] += xxhash.xxh64_intdigest(bare)
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
        for i in range(n - 1, 0, -1):
            p, name = self.parent[i], self.name[i]
            if self.kind[i] == 3:
                continue
            headings[i] += name in ("h1", "h2")
            whole[p] += whole[i]
            link[p] += whole[i] if name == "a" else link[i]
            clean[p] += clean[i] if self.kind[i] < 2 else 0
            headings[p] += headings[i]
            said[p] += said[i]
        out: dict[int, dict] = {}
        for i in range(n):
            t = out.get(self.key[i])
            if t is None:
                t = out[self.key[i]] = {
                    "path": self.key[i], "up": self.key[self.parent[i]] if i else 0, "count": 0, "place": i, "depth": depth[i], "kind": self.kind[i], "article": self.article[i],
                    "box": self.name[i] in CONTAINERS, "top": self.name[i] == "header", "wraps": self.wraps[i], "whole": 0, "clean": 0, "link": 0, "headings": 0, "said": 0,
                }
            t["count"] += 1
            for k, v in (("whole", whole[i]), ("clean", clean[i]), ("link", link[i]), ("headings", headings[i]), ("said", said[i])):
                t[k] += v
        return out

    def text(self, slot: int, gone: frozenset[int], kept: frozenset[int]) -> str:
        """The blocks of the slot (0: of the whole page) outside of what is left out."""
        n = len(self.key)
        inside, out = [slot == 0] + [False] * (n - 1), [False] * n
        for i in range(1, n):
            p, k = self.parent[i], self.key[i]
            inside[i] = inside[p] or k == slot
            out[i] = out[p] or self.kind[i] == 3 or k in gone or self.kind[i] == 2 and k not in kept
        blocks: dict[int, list[str]] = {}
        for e, block, text in self.texts:
            if inside[e] and not out[e]:
                blocks.setdefault(block, []).append(text)
        whole = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
        return "\n".join(b for b in whole if b)


def template(tokens: list[dict], n_host: int, min_support: float = MIN_SUPPORT) -> dict:
    """{slot, gone, kept, n_template, n_classes} of a host from its tokens.

    tokens has for each path what Page.tokens() says, added up over pages, and n_pages,
    most (count in a page), vector, constant (most pages that say the same there, while they
    differ elsewhere). gone are paths left out whatever their name, kept those not
    left out although they are named so. slot is 0 if the host has none.
    """
    of = {t["path"]: t for t in tokens}
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in tokens:
        if t["path"] and t["n_pages"] >= min_support * n_host and t["most"] == 1:
            classes[t["vector"]].append(t)
    valid = {t["path"] for c in classes.values() for t in c}
    root = of.get(0, {"whole": 0, "clean": 0})

    def above(t: dict) -> Iterator[dict]:
        while t["path"]:
            yield t
            t = of.get(t["up"]) or {"path": 0}

    def dense(t: dict) -> bool:
        return t["link"] > 0.5 * t["whole"]

    def constant(t: dict) -> bool:
        return t["n_pages"] >= MIN_PAGES and t["constant"] >= CONSTANT * t["n_pages"]

    # What may be wrapped around a page and holds nearly all text of the host is no boilerplate.
    nothing_else = root["clean"] < 0.1 * root["whole"]
    kept = {t["path"] for t in tokens if t["kind"] == 2 and t["wraps"] and nothing_else and t["clean"] > 0.5 * root["whole"] and not dense(t) and not constant(t)}
    # Nor is the head of an article that has its heading.
    kept |= {t["path"] for t in tokens if t["top"] and t["kind"] == 2 and t["headings"] and not dense(t) and not constant(t) and any(x["article"] > 1 for x in above(t))}
    gone = {t["path"] for t in tokens if t["kind"] == 1 and (dense(t) or constant(t))}

    def usable(t: dict) -> bool:
        return all((x["kind"] < 2 or x["path"] in kept) and x["path"] not in gone for x in above(t))

    slots = [t for t in tokens if t["path"] in valid and t["box"] and t["clean"] and not constant(t) and usable(t)]
    most = max((t["clean"] for t in slots), default=0)
    named = [t for t in slots if t["article"] and t["clean"] >= 0.5 * most]
    holding = [t for t in slots if t["clean"] >= 0.9 * most]
    by_heading = [t for t in holding if t["headings"]] or holding
    elected = max(named, key=lambda t: (t["article"], t["depth"], -t["place"]), default=None) or max(by_heading, key=lambda t: (t["depth"], -t["place"]), default=None)
    slot = elected["path"] if elected else 0
    # Inside of it go short boxes in which all pages say the same.
    least = 0.2 * (elected or root)["clean"]
    around = {x["path"] for x in above(elected)} if elected else set()
    gone |= {t["path"] for t in tokens if t["path"] not in around and t["path"] and t["box"] and t["whole"] and constant(t) and t["whole"] <= least * t["n_pages"] / max(1, (elected or {"n_pages": n_host})["n_pages"])}
    return {"slot": slot, "gone": sorted(gone), "kept": sorted(kept), "n_template": len(valid), "n_classes": len(classes)}


def article(page: str, found: dict | None) -> str:
    """The article of a page by its host's template, or by its own elements if there is none or the page lacks its slot."""
    p = Page(page)
    if found is None or found["slot"] not in p.key:
        own = [t | {"n_pages": 1, "most": t["count"], "vector": t["count"], "constant": 0} for t in p.tokens().values()]
        alone = template(own, 1)
        found = alone if found is None else {"slot": alone["slot"], "gone": [*alone["gone"], *found["gone"]], "kept": [*alone["kept"], *found["kept"]]}
    return p.text(found["slot"], frozenset(found["gone"]), frozenset(found["kept"]))


#: Columns of token_classes() after host and path.
SUMS, MOST = ("place", "whole", "clean", "link", "headings"), ("up", "depth", "kind", "article", "box", "top", "wraps")


def token_classes(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, v1, v2, most, constant, n_host, and what Page.tokens() says): each path of each host with its occurrence vector.

    v1 and v2 add up hashes of (page, count) over the pages that have the path: the same for
    paths that occur equally often in every page, however often a row is repeated. constant is
    the largest number of pages that say the same in that path but differ elsewhere. Paths
    in fewer than SEEN of a host's pages are left out, path 0 is the whole page.
    """
    names = ["host", "path", "said", "n_pages", "v1", "v2", "most", "lo", "hi", *SUMS, *MOST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 500):
                rows: dict[tuple, list] = {}
                for host, page_id, page in zip(*(b.slice(part, 500).column(i).to_pylist() for i in range(3)), strict=True):
                    tokens = Page(page or "").tokens()
                    all_of_it = _signed(tokens[0]["said"])
                    for path, t in tokens.items():
                        h = xxhash.xxh64_intdigest(f"{page_id} {t['count']}")
                        new = [1, h & 0x7FFFFFFF, h >> 33, t["count"], all_of_it, all_of_it, *(t[c] for c in SUMS)]
                        key = (host, path, _signed(t["said"]))
                        r = rows.get(key)
                        if r is None:
                            rows[key] = [*new, *(int(t[c]) for c in MOST)]
                        else:
                            r[3], r[4], r[5] = max(r[3], new[3]), min(r[4], new[4]), max(r[5], new[5])
                            for i in (0, 1, 2, *range(6, 6 + len(SUMS))):
                                r[i] += new[i]
                cols = [*zip(*rows, strict=True), *zip(*rows.values(), strict=True)] if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i else pa.string()) for i, c in enumerate(cols)], names=names)

    each = pages.select("host", F.col("page_id").cast("string"), "html").mapInArrow(run, "host string, " + ", ".join(f"{c} bigint" for c in names[1:]))
    added = lambda *more: [*(F.sum(c).alias(c) for c in ("n_pages", "v1", "v2", *SUMS)), *(F.max(c).alias(c) for c in ("most", *MOST)), *more]
    said = each.groupBy("host", "path", "said").agg(*added(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    same = F.when(F.col("lo") != F.col("hi"), F.col("n_pages")).otherwise(0)
    paths = cut(said.withColumn("same", same).groupBy("host", "path").agg(*added(F.max("same").alias("constant"))))
    sizes = paths.where("path = 0").select(F.col("host").alias("h"), F.col("n_pages").alias("n_host"))
    return paths.join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_pages") >= SEEN * F.col("n_host")).drop("h")


def host_templates(pages: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(host, n_host, slot, gone, kept, n_template, n_classes): the template of each host with two pages or more, from pages (host, page_id, html).

    A host's tokens are those in SEEN of its pages at least, so there are no more than one
    page has, divided by SEEN, and they are judged together whatever the number of pages.
    """

    def judge(t: pa.Table) -> pa.Table:
        tokens = [r | {"vector": (r["v1"], r["v2"])} for r in t.to_pylist()]
        found = template(tokens, tokens[0]["n_host"], min_support)
        return pa.table({"host": pa.array([tokens[0]["host"]], pa.string()), "n_host": [tokens[0]["n_host"]], **{k: pa.array([v], pa.list_(pa.int64()) if k in ("gone", "kept") else pa.int64()) for k, v in found.items()}})

    kinds = "host string, n_host bigint, slot bigint, gone array<bigint>, kept array<bigint>, n_template bigint, n_classes bigint"
    return token_classes(pages).where("n_host > 1").groupBy("host").applyInArrow(judge, kinds)


def extract_text(pages: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Adds text to every row of pages (page_id, url, html): the main text of the whole html.

    Without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and reader comments; character references are decoded, white space inside a
    block becomes one space, blocks are joined by \\n in page order. Null or empty html gives
    an empty text, as does a page without any. Pages without a host form a group of their
    own; a host's only page is judged by itself. Broken markup is read to its end: an open
    comment or script takes the rest, other open elements end with what surrounds them.
    Repeated rows are extracted each. A column text is replaced; other columns stay, whatever
    their names.
    """
    names = [c for c in pages.columns if c != "text"]
    src = pages.select(url_host(F.col("url")).alias("t_host"), F.struct(*names).alias("page"))
    plain = src.select(F.col("t_host").alias("host"), "page.page_id", "page.html")
    found = cut(host_templates(plain, min_support)).select(F.col("host").alias("f_host"), "n_host", F.struct("slot", "gone", "kept").alias("found"))
    hot = F.col("n_host") * HOT_HOSTS >= F.lit(src.count())
    first = src.join(F.broadcast(found.where(hot).drop("n_host")), F.col("t_host") == F.col("f_host"), "left")
    rest = first.where("f_host is null").select("t_host", "page").join(found.where(~hot).drop("n_host"), F.col("t_host") == F.col("f_host"), "left")
    joined = first.where("f_host is not null").unionByName(rest).select("page", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 500):
                c = b.slice(part, 500)
                text = [article(p or "", f) for p, f in zip(c.column(0).field("html").to_pylist(), c.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(text, pa.string())], names=["page", "text"])

    done = joined.mapInArrow(run, f"page {joined.schema['page'].dataType.simpleString()}, text string")
    return done.select(*(F.col("page").getField(c).alias(c) for c in names), "text")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
