"""Page renderings: metadata (F14), markdown (F13), cleaned nodes (F11 node form).

Metadata and markdown are our own spec (the reference delegates them to an external crawler). Both leave the parse as one
row per page and are assembled inside the row by built-in functions: no node table, no shuffle, no cache.

Markdown: every piece of text belongs to its nearest open block. Pieces of one block with no block boundary between them
form a line; lines are set apart by an empty line, list items and table rows by a line break, cells by a bar. Headings, list
items (numbered in ``ol``), quotes and preformatted text get their prefixes, nested lists and later blocks of an item are
indented. Inside a line white space counts as one space, links become ``[text](href)``, strong text ``**``, emphasis ``*``,
code backquotes, images ``![alt](src)``, ``br`` a hard break, ``hr`` a rule. Marks that end with their block are closed and
opened again in the next one. Text of head, script, style and the other excluded elements is left out. A page without text
gives ''.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EXCLUDED_TAGS, EXCLUDED_VOID_TAGS
from ..functions.urls import domain as url_domain
from .shred import _Shredder, page_elements

# Elements that end a line of text, and the headings among them with their prefixes.
HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### "}
BLOCKS = frozenset(HEADINGS) | frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header html legend "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset(EXCLUDED_TAGS) | {"head", "title", "template"}
MARKS = {"a": "link", "b": "strong", "strong": "strong", "i": "em", "em": "em", "code": "code", "kbd": "code", "samp": "code"}
_SPACE = re.compile(r"\s+")

# one piece of text: sep is '' inside a line, else what stands before the line; link, strong, em and code are the ids of the
# outermost open elements of that kind (0: none)
_RUN = pa.struct([("sep", pa.string()), ("prefix", pa.string()), ("lead", pa.bool_()), ("trail", pa.bool_()), ("text", pa.string()),
                  ("link", pa.int32()), ("href", pa.string()), ("strong", pa.int32()), ("em", pa.int32()), ("code", pa.int32())])
_RUN_TYPE = ("array<struct<sep:string,prefix:string,lead:boolean,trail:boolean,text:string,"
             "link:int,href:string,strong:int,em:int,code:int>>")


class _Open:
    """What an element hands down to the text below it."""

    __slots__ = ("block", "tag", "unseen", "pre", "quote", "indent", "item", "row", "lists", "top", "marks", "href")

    def __init__(self, above: _Open | None = None):
        for name in self.__slots__:
            setattr(self, name, getattr(above, name) if above else None)
        if above is None:
            self.block, self.tag, self.unseen, self.pre, self.quote, self.indent, self.lists = 0, "", False, False, "", "", 0
            self.marks, self.href = {}, None


def text_runs(rows: list, blanks: set) -> list[dict]:
    """The pieces of text of one shredded page, in document order, each with its line and its marks."""
    opened = {}
    items, counted, first_cells = {}, {}, {}  # per list item: its marker until a line uses it; per ol: items so far
    runs, line, breaks, last = [], None, 0, {}
    starts = 0

    def put(o: _Open, text: str, lead: bool, trail: bool, plain: bool = False) -> None:
        nonlocal line, breaks
        here = (o.block, starts)
        sep, prefix = "", ""
        if here != line or breaks:
            if line is None:
                sep = "\n\n"
            elif here == line:
                sep = "  \n"
            elif o.row is not None and o.row == last.get("row"):
                sep = " | "
            elif (o.row is not None and last.get("row") is not None) or (items.get(o.item) and last.get("item") is not None and last["top"] == o.top):
                sep = "\n"
            else:
                sep = "\n\n"
            if sep != " | ":
                indent = o.indent
                if items.get(o.item):
                    indent = indent[: -len(items[o.item])] + items[o.item]
                    items[o.item] = None
                prefix = o.quote + indent + ("" if sep == "  \n" else HEADINGS.get(o.tag, "")) + ("    " if o.pre else "")
            if o.pre:
                text = text.replace("\n", "\n" + prefix)
        marks = {} if plain else o.marks
        runs.append({"sep": sep, "prefix": prefix, "lead": lead, "trail": trail, "text": text, "href": o.href if marks.get("link") else None,
                     **{m: marks.get(m, 0) for m in ("link", "strong", "em", "code")}})
        line, breaks = here, 0
        last["row"], last["item"], last["top"] = o.row, o.item, o.top

    pending = False  # white space alone since the last piece
    for r in rows:
        nid, kind, tag = r[0], r[4], r[5]
        if nid in blanks:
            pending = True
        above = opened.get(r[2])
        if kind == "document":
            opened[nid] = _Open()
        elif kind == "text" and not above.unseen:
            data = r[9]
            if above.pre:
                put(above, data.strip("\n"), pending, False)
            else:
                put(above, _SPACE.sub(" ", data.strip()), pending or data[0].isspace(), data[-1].isspace())
            pending = False
        elif kind == "element":
            o = opened[nid] = _Open(above)
            attrs = dict(r[8] or ())
            if tag in UNSEEN:
                o.unseen = True
            elif o.unseen:
                continue
            elif tag == "br":
                breaks += 1
            elif tag == "hr":
                starts += 1
                put(o, "---", False, False, plain=True)
                starts += 1
            elif tag == "img" and attrs.get("src"):
                put(o, f"![{_SPACE.sub(' ', attrs.get('alt') or '').strip()}]({attrs['src']})", pending, False)
                pending = False
            elif tag in BLOCKS:
                starts += 1
                o.block, o.tag, pending = nid, tag, False
                if tag == "pre":
                    o.pre = True
                elif tag == "blockquote":
                    o.quote += o.indent + "> "
                    o.indent = ""
                elif tag in ("ul", "ol", "menu"):
                    o.lists, o.top = nid, o.top or nid
                    if tag == "ol":
                        counted[nid] = 0
                elif tag == "li":
                    marker = "- "
                    if o.lists in counted:
                        counted[o.lists] += 1
                        marker = f"{counted[o.lists]}. "
                    o.item, items[nid] = nid, marker
                    o.indent += " " * len(marker)
                elif tag == "tr":
                    o.row = nid
            elif tag in MARKS:
                mark = MARKS[tag]
                if not o.marks.get(mark) and (mark != "link" or attrs.get("href")):
                    o.marks = {**o.marks, mark: nid}
                    if mark == "link":
                        o.href = attrs["href"]
    return runs


def page_runs(pages: DataFrame) -> DataFrame:
    """(page_id, domain, url, runs): the pieces of text of every page as one row; only they leave the parse."""

    def run(batches):
        parser = _Shredder()
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                rows = parser.run(html or "")
                out.append(text_runs(rows, parser._blanks))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "domain", "url")), pa.array(out, pa.list_(_RUN))],
                                             ["page_id", "domain", "url", "runs"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), url_domain("url").alias("domain"), "url", "html")
    return src.mapInArrow(run, f"page_id long, domain string, url string, runs {_RUN_TYPE}")


def assembled(runs: Column) -> Column:
    """The markdown of a page's runs: each piece with the marks that open at it and close after it."""

    def piece(r: Column, i: Column) -> Column:
        before, after = F.get(runs, i - 1), F.get(runs, i + 1)
        goes_on = (i > 0) & (r["sep"] == "")
        stays = F.coalesce(after["sep"] == "", F.lit(False))
        opens, closes = F.lit(""), F.lit("")
        signs = {"link": ("[", F.concat(F.lit("]("), r["href"], F.lit(")"))), "strong": ("**", F.lit("**")), "em": ("*", F.lit("*")), "code": ("`", F.lit("`"))}
        for mark, (sign, end) in signs.items():  # a mark goes on only inside the marks around it
            goes_on, stays = goes_on & (before[mark] == r[mark]), stays & (after[mark] == r[mark])
            open_ = r[mark] > 0
            opens = F.concat(opens, F.when(open_ & ~goes_on, F.lit(sign)).otherwise(F.lit("")))
            closes = F.concat(F.when(open_ & ~stays, end).otherwise(F.lit("")), closes)
        inside = r["sep"] == ""
        space = F.when(inside & (r["lead"] | before["trail"]), F.lit(" ")).otherwise(F.lit(""))
        start = F.when(i > 0, r["sep"]).otherwise(F.lit(""))
        return F.concat(start, r["prefix"], space, opens, r["text"], closes)

    return F.array_join(F.transform(runs, piece), "")


def page_markdown(pages: DataFrame) -> DataFrame:
    """page_id, url, markdown of ``pages(page_id, url, html)``."""
    return page_runs(pages).select("page_id", "url", assembled(F.col("runs")).alias("markdown"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_id, url, title, lang, meta (map name|property -> content, the first of each name), canonical."""
    els = page_elements(pages, ["title", "html", "meta", "link"], text=["title"])

    def first(ok, value) -> Column:
        return F.get(F.transform(F.filter("els", ok), value), F.lit(0))

    def name(e: Column) -> Column:
        return F.coalesce(F.try_element_at(e["attrs"], F.lit("name")), F.try_element_at(e["attrs"], F.lit("property")))

    def attr(e: Column, key: str) -> Column:
        return F.try_element_at(e["attrs"], F.lit(key))

    metas = F.transform(F.filter("els", lambda e: (e["tag"] == "meta") & name(e).isNotNull() & F.map_contains_key(e["attrs"], F.lit("content"))),
                        lambda e: F.struct(name(e).alias("k"), attr(e, "content").alias("v")))
    els = els.select("page_id", "url", "els", metas.alias("metas"))
    names = F.transform("metas", lambda m: m["k"])
    firsts = F.filter("metas", lambda m, i: F.array_position(names, m["k"]) == i + 1)
    rel = lambda e: F.split(F.lower(F.coalesce(attr(e, "rel"), F.lit(""))), r"\s+")
    return els.select(
        "page_id", "url",
        F.coalesce(first(lambda e: e["tag"] == "title", lambda e: e["text"]), F.lit("")).alias("title"),
        first(lambda e: (e["tag"] == "html") & F.map_contains_key(e["attrs"], F.lit("lang")), lambda e: attr(e, "lang")).alias("lang"),
        F.map_from_entries(firsts).alias("meta"),
        first(lambda e: (e["tag"] == "link") & F.array_contains(rel(e), "canonical"), lambda e: attr(e, "href")).alias("canonical"))


def _inside(els: DataFrame, flag, name: str) -> DataFrame:
    """Add boolean ``name``: the element lies strictly inside an element where ``flag`` holds
    (running max of those elements' end_id over earlier rows of the page)."""
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(flag, F.col("end_id"))).over(w)
    return els.withColumn(name, F.coalesce(reach >= F.col("node_id"), F.lit(False)))


def cleaned_nodes(nodes: DataFrame) -> DataFrame:
    """F11 node form: nodes outside excluded elements, without the excluded elements and link/meta."""
    excl = F.col("tag").isin(*EXCLUDED_TAGS)
    n = _inside(nodes, (F.col("kind") == "element") & excl, "_in")
    drop = n["_in"] | ((F.col("kind") == "element") & (excl | F.col("tag").isin(*EXCLUDED_VOID_TAGS)))
    return n.filter(~drop).drop("_in")
