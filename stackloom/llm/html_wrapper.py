"""Main text of web pages by wrapper induction: pages of a host are aligned by simple tree matching.

1. Each page becomes a tree of its block elements, in which siblings with the same label (tag, class, id) are one repeated
   node, and a list of text blocks with their nodes. Trees are small and few per host, whatever the host's size.
2. Pages of a host with the same tree and texts count once, as copies are no evidence of a template. Counts per (host, tree,
   node): such pages, and the least and greatest hash of the node's text. Both are hash aggregations, so copies and a host with
   a third of all pages are reduced before anything moves.
3. The host's most frequent tree is its reference. Every other tree is aligned with it: the largest matching of nodes that
   keeps labels, parents and the order of siblings. Summed over the alignment, a reference node whose text is the same wherever it
   has one, and that has one on at least MIN_SHARE of the host's pages, is template; one whose text varies is a slot.
4. What is not template makes the wrapper's content: within the article element (or what else the page declares as its
   main part) if there is one, else anywhere. A part without a slot has no template, as nothing tells it from the article.
   Elements whose tag, role, class or id says menu, footer, advert and the like aren't content, but that is evidence and no
   verdict: if the declared main part lies inside of such an element only, and has more text than what is left without it, or if
   nothing is left at all, then the elements around that part (or around most of the page's text) don't count as marked.
   Hosts with under MIN_PAGES different pages have no template to learn, so that for them only declarations count.
5. Pages are joined with the content nodes of their (host, tree) and print those nodes' blocks.

Only steps 1 and 3 are Python: per page, and per distinct tree of a host.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.common import cut_lineage, free_name, table, text_slices

#: Different pages that must agree before a text counts as template, and their least share of the host's.
MIN_PAGES, MIN_SHARE = 3, 0.5

# Elements of HTML, and words by which pages name their parts.
BLOCKS = frozenset("""html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote section article
main header footer nav aside form fieldset legend address figure figcaption details summary dialog menu center hgroup search""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg object select".split())
CLOSES_P = BLOCKS - frozenset("html body".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
NOT_CONTENT_TAGS = frozenset("nav footer aside form button menu dialog search".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOT_CONTENT_WORDS = frozenset("""ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted
promotion banner nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars aside rail footer masthead topbar comment
comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices notification notifications alert
popup modal overlay newsletter subscribe subscription signup login register paywall share sharing social related recommended recommendations
widget widgets pagination pager toolbar form search skip tags""".split())
# of these, words with other meanings: they count as the last word of a name only (a social policy is a policy)
WEAK_WORDS = frozenset("""alert discussion form notice notices notification promotion promotions register related search share sharing signup skip social
subscription tags widget widgets""".split())
# words that say where an element is or how it looks, or that it holds parts; the last word of a name is the last but these
HELPER_WORDS = frozenset("""area bar block body box button buttons center col column container content footer global grid group header holder icon icons inline inner
item items left link links list main mobile outer panel post posts articles stories primary right row secondary section site slot small sticky
text title top bottom unit wrap wrapper""".split())
MAIN_WORDS = ("articlebody", "article", "post", "entry", "story", "content", "main")

# a tag's attributes end at the first > outside quotes, or, with a quote left open, at the first > at all
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                    r"((?:[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?=>)|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


@functools.lru_cache(maxsize=20_000)
def _tag_label(tag: str, rest: str, in_article: bool) -> str:
    """Label of a start tag; empty for an inline element without attributes that matter."""
    attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if "=" in rest else {}
    return _label(tag, attributes, in_article) if tag in BLOCKS or attributes else ""


def _named(attributes: dict[str, str]) -> tuple[set[str], set[str]]:
    """Words of class and id: all, and those that say what the element is; a name with ``no``, ``has`` or ``with`` speaks of another."""
    every: set[str] = set()
    kinds: set[str] = set()
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for name in value.split():
            words = [w.lower() for w in _WORD.findall(name)]
            if not {"no", "has", "with", "without"}.isdisjoint(words):
                continue
            every.update(words)
            kinds.update(w for w in words if w not in WEAK_WORDS)
            kinds.update([w for w in words if w in NOT_CONTENT_WORDS or (w not in HELPER_WORDS and len(w) > 2)][-1:])
    return every, kinds


def _label(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """Tag, mark of its part (- not content, + main part with its rank, or nothing), class and id without digits."""
    mark = ""
    if tag not in ("html", "body"):
        (words, kinds), role = _named(attributes), attributes.get("role", "").lower()
        if tag in ("article", "main") or role in ("main", "article"):
            mark = "-" if tag == "article" and words & {"comment", "comments", "reply"} else "+0" if tag == "article" or role == "article" else "+1"
        elif tag in NOT_CONTENT_TAGS or role in NOT_CONTENT_ROLES or kinds & NOT_CONTENT_WORDS:
            mark = "-"
        elif (tag == "header" or "header" in words) and not in_article:
            mark = "-"
        elif attributes.get("itemprop", "").lower() == "articlebody":
            mark = "+2"
        elif tag in ("div", "section", "td"):
            rank = next((i for i, w in enumerate(MAIN_WORDS) if w in words), None)
            mark = "" if rank is None else f"+{3 + rank}"
    named = ".".join(sorted({*attributes.get("class", "").split()})) + "#" + attributes.get("id", "") if attributes else ""
    return f"{tag}|{mark}|" + re.sub(r"\s+", "_", _DIGITS.sub("0", named))


@functools.lru_cache(maxsize=100)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I)


class Page:
    """Tree and text blocks of a page."""

    def __init__(self, source: str):
        self.labels, self.parents, self.hashes = ["#root"], [-1], [0]
        self.blocks: list[tuple[int, str]] = []
        self._places: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, node; that of the block around for inline elements)
        self._articles = 0
        self._text: list[str] = []
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text.append(html.unescape(source[at:]))
                break
            if m.start() > at:
                text = source[at : m.start()]
                self._text.append(html.unescape(text) if "&" in text else text)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                closed = m[3].endswith("/")
                if tag in RAW:
                    if not closed:
                        end = _end_of(tag).search(source, at)
                        at = end.end() if end else n
                else:
                    self._start(tag, m[3])
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        """The text since the last border of a block, with white space as one space."""
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                node = self._stack[-1][1]
                self.blocks.append((node, text))
                self.hashes[node] = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), self.hashes[node]) or 1

    def _pop(self) -> None:
        tag, node = self._stack[-1]
        if node != self._stack[-2][1]:
            self._flush()
        if tag == "article":
            self._articles -= 1
        self._stack.pop()

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag == "hr":
            self._flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == "p":
                    while len(self._stack) > i:
                        self._pop()
                if i >= len(self._stack) or self._stack[i][0] in BLOCKS:
                    break
        if tag in ENDS:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] in SCOPES[tag] and not (self._stack[i][0] == "tr" and tag == "tr"):
                    break
                if self._stack[i][0] in ENDS[tag]:
                    while len(self._stack) > i:
                        self._pop()
                    break
        label = _tag_label(tag, rest, self._articles > 0)
        if tag in BLOCKS or "|-|" in label:
            self._flush()
            parent = self._stack[-1][1]
            node = self._places.get((parent, label))
            if node is None:
                node = self._places[parent, label] = len(self.labels)
                self.labels.append(label)
                self.parents.append(parent)
                self.hashes.append(0)
            self._stack.append((tag, node))
        else:
            self._stack.append((tag, self._stack[-1][1]))
        if tag == "article":
            self._articles += 1

    def _end(self, tag: str) -> None:
        if tag in ("br", "p") and all(t != tag for t, _ in self._stack):
            self._flush()
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                while len(self._stack) > i:
                    self._pop()
                return
            if tag not in BLOCKS and self._stack[i][0] in BLOCKS:
                return  # an inline element doesn't end outside its block

    def tree(self) -> str:
        """The nodes in the order of their first start tags, with their parents."""
        return "\n".join(f"{p}\t{x}" for p, x in zip(self.parents, self.labels))


def read_tree(tree: str) -> tuple[list[int], list[str]]:
    rows = [row.split("\t", 1) for row in tree.split("\n")]
    return [int(p) for p, _ in rows], [x for _, x in rows]


def align(tree: str, reference: str) -> list[int]:
    """Simple tree matching: of each node of ``tree`` its node in ``reference``, or -1.

    The largest set of pairs with equal labels, paired parents and siblings in the same order. Labels of siblings differ, so
    a node has one possible partner, and what is left to choose is which children to leave out where orders cross.
    """
    (pa_, la), (pb, lb) = read_tree(tree), read_tree(reference)
    place = {(pb[j], lb[j]): j for j in range(1, len(pb))}
    partner = [0] + [-1] * (len(pa_) - 1)
    children: list[list[int]] = [[] for _ in pa_]
    for i in range(1, len(pa_)):  # parents come before their children
        if partner[pa_[i]] >= 0:
            partner[i] = place.get((partner[pa_[i]], la[i]), -1)
            if partner[i] >= 0:
                children[pa_[i]].append(i)
    weight, kept = [1] * len(pa_), [False] * len(pa_)
    chosen: list[list[int]] = [[] for _ in pa_]
    for i in range(len(pa_) - 1, -1, -1):  # children before their parents
        own = children[i]
        if not own:
            continue
        best, back = [], []
        for k, c in enumerate(own):  # heaviest rising run of partners that ends at c
            before = max((x for x in range(k) if partner[own[x]] < partner[c]), key=lambda x: best[x], default=None)
            best.append(weight[c] + (best[before] if before is not None else 0))
            back.append(before)
        at = max(range(len(own)), key=lambda x: best[x])
        weight[i] = 1 + best[at]
        while at is not None:
            chosen[i].append(own[at])
            at = back[at]
    kept[0] = True
    for i in range(len(pa_)):
        if kept[i]:
            for c in chosen[i]:
                kept[c] = True
    return [partner[i] if kept[i] else -1 for i in range(len(pa_))]


def _pool(parents: list[int], marks: list[str]) -> tuple[list[int], bool]:
    """Nodes outside of marked ones, within the best declared main part if there is one, and whether there is."""
    dropped = [False] * len(parents)
    for i in range(1, len(parents)):
        dropped[i] = dropped[parents[i]] or marks[i] == "-"
    ranks = [int(m[1:]) for m, d in zip(marks, dropped) if m.startswith("+") and not d]
    inside = [False] * len(parents)
    for i in range(1, len(parents)):
        inside[i] = not dropped[i] and (inside[parents[i]] or (bool(ranks) and marks[i] == f"+{min(ranks)}"))
    return [i for i in range(len(parents)) if (inside[i] if ranks else not dropped[i])], bool(ranks)


def _without_marks_around(parents: list[int], marks: list[str], nodes: list[int]) -> list[str]:
    """The marks, less those that say not content of elements around the nodes."""
    out = list(marks)
    for i in nodes:
        while i > 0 and parents[i] >= 0:
            i = parents[i]
            out[i] = "" if out[i] == "-" else out[i]
    return out


def content_nodes(tree: str, template: set[int], slots: set[int], unmatched: set[int], sizes: list[int] | None = None) -> list[int]:
    """Nodes whose text is the article. ``template``, ``slots``: nodes of this tree whose text is constant, or varies, on the
    host; ``unmatched``: nodes with text that the host's reference doesn't have; ``sizes``: characters of text in each node,
    without those below it."""
    parents, labels = read_tree(tree)
    marks = [x.split("|")[1] if "|" in x else "" for x in labels]
    sizes = sizes or [0] * len(parents)
    pool, ranks = _pool(parents, marks)
    held = sum(sizes[i] for i in pool)
    declared = [i for i, m in enumerate(marks) if m in ("+0", "+1", "+2")]
    if declared and not any(i in set(pool) for i in declared):
        best = min(marks[i] for i in declared)
        freed = _without_marks_around(parents, marks, [i for i in declared if marks[i] == best])
        other, other_ranks = _pool(parents, freed)
        if sum(sizes[i] for i in other) > held:
            pool, ranks, held = other, other_ranks, sum(sizes[i] for i in other)
    if not held and sum(sizes):
        below = list(sizes)
        for i in range(len(parents) - 1, 0, -1):
            below[parents[i]] += below[i]
        # down to the last element that holds most of the text
        at = max((i for i in range(len(parents)) if 2 * below[i] > sum(sizes)), default=0)
        freed = _without_marks_around(parents, marks, [at])
        freed[at] = "" if freed[at] == "-" else freed[at]
        pool, ranks = _pool(parents, freed)
    # a part in which nothing varies is no template of anything; without a declared part, a text of its own is the article, too
    if slots.intersection(pool) or (not ranks and unmatched.intersection(pool)):
        pool = [i for i in pool if i not in template]
    return pool


def parse(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` (url, html) but html, with the page's host, tree, text hash of each node and blocks."""
    kept = [c for c in pages.columns if c != "html"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html")
    taken = [free_name(kept, n) for n in ("host", "page_tree", "node_hashes", "node_sizes", "blocks")]
    schema = fields + ", " + ", ".join(f"`{n}` {t}" for n, t in zip(taken, (
        "string", "string", "array<bigint>", "array<bigint>", "array<struct<node:int,text:string>>")))
    block = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "html"):
            hosts, trees, hashes, sizes, blocks = [], [], [], [], []
            for url, source in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                page = Page(source or "")
                m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", url or "")
                hosts.append((m[1] if m else "").lower())
                trees.append(page.tree())
                hashes.append([h - 2**64 if h >= 2**63 else h for h in page.hashes])
                size = [0] * len(page.labels)
                for i, t in page.blocks:
                    size[i] += len(t)
                sizes.append(size)
                blocks.append([{"node": i, "text": t} for i, t in page.blocks])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(hosts, pa.string()), pa.array(trees, pa.string()),
                                              pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64())), pa.array(blocks, block)], names=[*kept, *taken])

    return pages.mapInArrow(run, schema)


def _align_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [align(t, r) for t, r in zip(b.column("page_tree").to_pylist(), b.column("reference").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page_tree"), pa.array(made, pa.list_(pa.int32()))],
                                         names=["host", "page_tree", "partners"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for row in zip(*(b.column(c).to_pylist() for c in ("page_tree", "partners", "template", "varying", "with_text"))):
            tree, partners, (constant, varying) = row[0], row[1], (set(x or ()) for x in row[2:4])
            sizes = [0] * len(partners)
            for x in row[4] or ():
                sizes[x["node"]] = x["chars"]
            made.append(content_nodes(tree, {i for i, p in enumerate(partners) if p in constant},
                                      {i for i, p in enumerate(partners) if p in varying},
                                      {i for i, n in enumerate(sizes) if n and partners[i] < 0}, sizes))
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page_tree"), pa.array(made, pa.list_(pa.int32()))],
                                         names=["host", "page_tree", "content"])


def induce(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Wrappers: (host, page_tree, content), the nodes that hold article text in pages of that host and tree."""
    pages = parsed.select("host", "page_tree", F.arrays_zip("node_hashes", "node_sizes").alias("nodes")).distinct()
    nodes = pages.select("host", "page_tree", F.posexplode("nodes").alias("node", "n")).select(
        "host", "page_tree", "node", F.col("n.node_hashes").alias("hash"), F.col("n.node_sizes").alias("size"))
    seen = F.when(F.col("hash") != 0, F.col("hash"))
    counts = cut_lineage(nodes.groupBy("host", "page_tree", "node").agg(F.count("*").alias("pages"), F.count(seen).alias("texts"),
                                                                        F.min(seen).alias("low"), F.max(seen).alias("high"), F.sum("size").alias("chars")))
    # bounded by the nodes of the tree
    trees = counts.groupBy("host", "page_tree").agg(F.max("pages").alias("pages"), F.collect_list(F.when(F.col("texts") > 0, F.struct("node", "chars"))).alias("with_text"))
    references = trees.groupBy("host").agg(F.max_by("page_tree", F.struct("pages", "page_tree")).alias("reference"),
                                           F.sum("pages").alias("host_pages"))
    aligned = cut_lineage(trees.select("host", "page_tree").join(references, "host").mapInArrow(
        _align_trees, "host string, page_tree string, partners array<int>"))
    matched = (counts.join(aligned, ["host", "page_tree"]).withColumn("partner", F.get("partners", F.col("node")))
               .filter("partner >= 0").groupBy("host", "partner")
               .agg(F.sum("texts").alias("texts"), F.min("low").alias("low"), F.max("high").alias("high"))
               .join(references.select("host", "host_pages"), "host"))
    constant = (F.col("texts") >= min_pages) & (F.col("texts") >= min_share * F.col("host_pages")) & (F.col("low") == F.col("high"))
    # bounded by the nodes of the host's reference tree
    known = matched.groupBy("host").agg(F.collect_list(F.when(constant, F.col("partner"))).alias("template"),
                                        F.collect_list(F.when(F.col("low") != F.col("high"), F.col("partner"))).alias("varying"))
    return (aligned.join(known, "host", "left").join(trees.select("host", "page_tree", "with_text"), ["host", "page_tree"])
            .select("host", "page_tree", "partners", "template", "varying", "with_text")
            .mapInArrow(_choose, "host string, page_tree string, content array<int>"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, text: str = "text") -> DataFrame:
    """Replace ``html`` of ``pages`` (url, html, other columns) by ``text``: blocks of the article joined by newlines.

    Every page is returned, repeated ones too; null and empty html give an empty text, a null url an own host of all such
    pages. Character references are decoded and white space in a block is one space. ``text`` gets underscores where taken.
    """
    kept = [c for c in pages.columns if c != "html"]
    text = free_name(kept, text)
    carried = pages.select(F.struct(*kept).alias("kept"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = parse(carried).select("kept", "host", "page_tree", "node_hashes", "node_sizes", "blocks")
    wrappers = induce(parsed, min_pages)
    joined = parsed.join(wrappers, ["host", "page_tree"], "left")
    chosen = F.filter("blocks", lambda x: F.array_contains(F.coalesce(F.col("content"), F.array().cast("array<int>")), x["node"]))
    return joined.select(*[F.col("kept")[c].alias(c) for c in kept], F.array_join(F.transform(chosen, lambda x: x["text"]), "\n").alias(text))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op3_html_extract": op3_html_extract}
