"""HTML -> node table. The library's only per-row Python step.

Each page is parsed once with the standard library ``html.parser`` inside
``mapInArrow`` (Arrow batches, narrow, no shuffle). The output is one row per
node in document order, with pre/post interval encoding so that every tree
question later is a join or a window on ``page_id``:

    x is a descendant of y  <=>  same page and y.node_id < x.node_id <= y.end_id

Tree rules (those of a tolerant, non-HTML5 tree builder): no implied end tags;
an end tag closes the nearest open element of that name and everything opened
after it; an end tag with no open match is ignored; void elements close at once;
script/style content is raw text.

Text layout: the stripped, non-empty text pieces of the page (comments and the
text inside script/style/template/rt/rp excluded) are concatenated into the
document row's ``text``; every node carries ``[text_lo, text_hi)`` offsets into
it, so "all text below an element" is a substring, not a join.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain as url_domain

# Void elements (closed at once) and the elements whose strings are kept
# apart from their ancestors' text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
STRING_CONTAINERS = frozenset(["script", "style", "template", "rt", "rp"])

NODE_SCHEMA = (
    "page_id long, domain string, url string, node_id int, end_id int, parent_id int, depth int, "
    "kind string, tag string, id string, classes array<string>, attrs map<string,string>, "
    "text string, text_lo int, text_hi int"
)

_ARROW_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("domain", pa.string()), ("url", pa.string()),
    ("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()),
    ("kind", pa.string()), ("tag", pa.string()), ("id", pa.string()),
    ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("text_lo", pa.int32()), ("text_hi", pa.int32()),
])


class _Shredder(HTMLParser):
    """Collects one page's nodes as parallel lists (reused across pages)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def run(self, html: str):
        self.reset()
        self._rows = []          # [node_id, end_id, parent_id, depth, kind, tag, id, classes, attrs, text, lo, hi]
        self._stack = []         # open element rows
        self._containers = []    # open string-container rows
        self._pieces = []        # stripped text pieces of the page
        self._offset = 0
        self._pending = []       # consecutive character data, merged into one string
        self._blanks = set()     # ids of the nodes that white space alone stands before
        doc = [0, 0, None, 0, "document", None, None, None, None, None, 0, 0]
        self._rows.append(doc)
        self._stack.append(doc)
        self.feed(html)
        self.close()
        self._flush()
        last = len(self._rows) - 1
        while len(self._stack) > 1:
            self._pop(last)
        doc[1] = last
        doc[9] = "".join(self._pieces)
        doc[11] = self._offset
        return self._rows

    # -- tree building --------------------------------------------------------
    def _flush(self):
        if not self._pending:
            return
        data = "".join(self._pending)
        self._pending = []
        piece = data.strip()
        if not piece:
            self._blanks.add(len(self._rows))
            return
        nid = len(self._rows)
        parent = self._stack[-1]
        lo = self._offset
        if self._containers:
            kind = "rawtext"
            cont = self._containers[-1]
            cont[9] = (cont[9] or "") + piece
        else:
            kind = "text"
            self._pieces.append(piece)
            self._offset += len(piece)
        self._rows.append([nid, nid, parent[0], len(self._stack), kind, None, None, None, None, data, lo, self._offset])

    def _pop(self, last_id):
        row = self._stack.pop()
        row[1] = last_id
        row[11] = self._offset
        if self._containers and self._containers[-1] is row:
            self._containers.pop()

    def handle_starttag(self, tag, attrs):
        self._flush()
        amap = {}
        for k, v in attrs:
            amap[k] = "" if v is None else v
        cls = amap.get("class")
        classes = cls.split() if cls is not None else []
        nid = len(self._rows)
        row = [nid, nid, self._stack[-1][0], len(self._stack), "element", tag, amap.get("id"), classes,
               list(amap.items()), None, self._offset, self._offset]
        self._rows.append(row)
        if tag in VOID_TAGS:
            return
        self._stack.append(row)
        if tag in STRING_CONTAINERS:
            self._containers.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][5] == tag:
                last = len(self._rows) - 1
                while len(self._stack) > i:
                    self._pop(last)
                return
        # no open element of that name: ignored

    def handle_data(self, data):
        self._pending.append(data)

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.startswith("CDATA["):
            self._pending.append(data[6:])
            self._flush()

    def handle_comment(self, data):
        self._flush()
        nid = len(self._rows)
        self._rows.append([nid, nid, self._stack[-1][0], len(self._stack), "comment", None, None, None, None, data,
                          self._offset, self._offset])


def _shred_batches(batches):
    parser = _Shredder()
    for batch in batches:
        cols = {name: [] for name in _ARROW_SCHEMA.names}
        pids = batch.column("page_id").to_pylist()
        doms = batch.column("domain").to_pylist()
        urls = batch.column("url").to_pylist()
        htmls = batch.column("html").to_pylist()
        for pid, dom, url, html in zip(pids, doms, urls, htmls):
            rows = parser.run(html or "")
            n = len(rows)
            cols["page_id"].extend([pid] * n)
            cols["domain"].extend([dom] * n)
            cols["url"].append(url)
            cols["url"].extend([None] * (n - 1))
            for r in rows:
                cols["node_id"].append(r[0])
                cols["end_id"].append(r[1])
                cols["parent_id"].append(r[2])
                cols["depth"].append(r[3])
                cols["kind"].append(r[4])
                cols["tag"].append(r[5])
                cols["id"].append(r[6])
                cols["classes"].append(r[7])
                cols["attrs"].append(r[8])
                cols["text"].append(r[9])
                cols["text_lo"].append(r[10])
                cols["text_hi"].append(r[11])
            if len(cols["node_id"]) >= 20_000:
                yield pa.RecordBatch.from_pydict(cols, schema=_ARROW_SCHEMA)
                cols = {name: [] for name in _ARROW_SCHEMA.names}
        if cols["node_id"]:
            yield pa.RecordBatch.from_pydict(cols, schema=_ARROW_SCHEMA)


def shred(pages: DataFrame, persist: bool = True) -> DataFrame:
    """Node table of ``pages(page_id, url, html)``.

    ``domain`` (F1 of the url) is computed JVM-side before the Python step and
    carried on every node, so site-scoped joins need no page lookup. The nodes are
    hash-partitioned on ``page_id`` once and (by default) persisted to memory and
    disk: every job reads the node table several times (elements, text, page
    rows), the parse runs once, and every later join, window and aggregate keyed
    on ``page_id`` reuses that partitioning instead of shuffling again. Lost
    blocks are recomputed from lineage. Pass ``persist=False`` to get the lazy
    frame (e.g. to write it out as a table).
    """
    src = pages.select("page_id", url_domain("url").alias("domain"), "url", "html")
    # the parse is CPU-bound Python: when the scan yields fewer splits than the cluster has
    # cores (small inputs), spread the pages round-robin first; large inputs keep their splits
    # (only plain scans are asked: counting the partitions of a plan with a shuffle would run it)
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if "Exchange" not in src._jdf.queryExecution().executedPlan().toString() and src.rdd.getNumPartitions() < cores:
        src = src.repartition(cores)
    nodes = src.mapInArrow(_shred_batches, NODE_SCHEMA).repartition("page_id")
    return nodes.persist(StorageLevel.MEMORY_AND_DISK) if persist else nodes


_LINK_SCHEMA = pa.schema([("page_id", pa.int64()), ("domain", pa.string()), ("url", pa.string()),
                          ("pos", pa.int32()), ("node_id", pa.int32()), ("href", pa.string()), ("dst", pa.string())])


def _joined(base: str, href: str) -> str:
    """F5 in plain Python; an href that is no URL at all stands for itself."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _link_batches(batches):
    parser = _Shredder()
    for batch in batches:
        cols = {name: [] for name in _LINK_SCHEMA.names}
        for pid, dom, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "domain", "url", "html"))):
            base, links = None, []  # links resolve against the first base with an href, itself relative to the page
            for r in parser.run(html or ""):
                if r[5] not in ("a", "base"):
                    continue
                attrs = dict(r[8] or ())
                if r[5] == "a" and attrs.get("href"):
                    links.append((r[0], attrs["href"]))
                elif r[5] == "base" and base is None and "href" in attrs:
                    base = _joined(url or "", attrs["href"] or "")
            for pos, (nid, href) in enumerate(links, 1):
                dst = _joined((url or "") if base is None else base, href)
                for name, value in zip(_LINK_SCHEMA.names, (pid, dom, url, pos, nid, href, dst)):
                    cols[name].append(value)
        if cols["page_id"]:
            yield pa.RecordBatch.from_pydict(cols, schema=_LINK_SCHEMA)


def link_rows(pages: DataFrame) -> DataFrame:
    """(page_id, domain, url, pos, node_id, href, dst): only the links of each page leave the parse.

    One narrow step without node table, shuffle or cache, for jobs that need the links alone.
    """
    src = pages.select("page_id", url_domain("url").alias("domain"), "url", "html")
    return src.mapInArrow(_link_batches, "page_id long, domain string, url string, pos int, node_id int, href string, dst string")


PAGE_ELEMENT = "struct<node_id:int,end_id:int,parent_id:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,text:string>"


def page_elements(pages: DataFrame, tags: list[str], text: list[str] = ()) -> DataFrame:
    """(page_id, domain, url, els): one row per page with its elements of ``tags`` in document order, no shuffle or cache.

    For jobs that need few elements of a page and read them inside the row. ``text`` names the tags whose text (F10) is
    wanted; it is null for the others.
    """
    wanted, texts = frozenset(tags), frozenset(text)
    kind = pa.struct([("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
                      ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

    def run(batches):
        parser = _Shredder()
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                rows = parser.run(html or "")
                page = rows[0][9]
                els = []
                for r in rows:
                    if r[4] == "element" and r[5] in wanted:
                        value = None
                        if r[5] in texts:
                            value = (r[9] or "") if r[5] in STRING_CONTAINERS else page[r[10]:r[11]]
                        els.append({"node_id": r[0], "end_id": r[1], "parent_id": r[2], "tag": r[5], "id": r[6], "classes": r[7], "attrs": r[8], "text": value})
                out.append(els)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "domain", "url")), pa.array(out, pa.list_(kind))],
                                             ["page_id", "domain", "url", "els"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), url_domain("url").alias("domain"), "url", "html")
    return src.mapInArrow(run, f"page_id long, domain string, url string, els array<{PAGE_ELEMENT}>")


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "element")


def documents(nodes: DataFrame) -> DataFrame:
    """One row per page: page_id, domain, url and the page text."""
    return nodes.filter(F.col("kind") == "document").select("page_id", "domain", "url", F.col("text").alias("page_text"))
